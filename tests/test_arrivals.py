"""Pairs reported by the stream equal the batch pairs, over several arrivals and a restart."""

import random

from imprint.operators.hamming import similar_pairs
from imprint.streaming.arrivals import duplicates_on_arrival, use_state_store


def signed(u):
    return u - (1 << 64) if u >= 1 << 63 else u


def test_stream_pairs_equal_batch_pairs(spark, tmp_path):
    rng = random.Random(8)
    centres = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(90):
        h = rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        rows.append((f"f{i:03d}", signed(h)))
    rows += [(f"g{i}", signed(rng.getrandbits(64))) for i in range(30)] + [("none", None)]
    rng.shuffle(rows)
    arrived, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    use_state_store(spark)

    def arrive(part):
        spark.createDataFrame(part, "path string, h long").coalesce(1).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema("path string, h long").parquet(arrived)
        found = duplicates_on_arrival(stream, 5)
        q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
        q.trigger(availableNow=True).start().awaitTermination()

    arrive(rows[:50])
    arrive(rows[50:80])
    arrive(rows[80:] + rows[:10])  # some come again
    got = {(frozenset([r.path, r.earlier_path]), r.distance) for r in spark.read.parquet(out).collect()}
    h = {p: x for p, x in rows if x is not None}
    want = {
        (frozenset([a, b]), ((h[a] ^ h[b]) & (2**64 - 1)).bit_count())
        for a in h for b in h if a < b and ((h[a] ^ h[b]) & (2**64 - 1)).bit_count() <= 5
    }
    assert got == want and spark.read.parquet(out).count() == len(want)
    batch = similar_pairs(spark.createDataFrame([(x,) for x in h.values()], "h long"), 5).count()
    assert batch == len({frozenset([h[a], h[b]]) for p, _ in want for a, b in [sorted(p)] if h[a] != h[b]})
