"""SimHash near-duplicates with pigeonring candidate filtering (operator 4).

Fingerprints: A-Z lower-cased, words between blanks (space, U+0009 to U+000D), three-word
shingles, XXH64 with seed 42 of each shingle, one vote per shingle and bit.

Candidates: the 64 bits are a ring of ``segments`` equal segments.  If two fingerprints differ
in at most t bits, some rotation has every prefix chain of l segments within the proportional
budget floor(l * t / segments) (pigeonring principle).  The first segments of the chain have
budget zero, the next ones budget one in total, so one half of those is equal as well: exact
segments plus either half form the join keys (eight rotations times two halves, 28 bits each
for 8 segments and t = 3).  A pair that meets on a key must pass all chain budgets at that
rotation before the full Hamming distance is taken, and is kept only at its first rotation.

Skew: equal fingerprints are one node.  Keys of up to SMALL_KEY fingerprints are joined; larger
ones are dealt into blocks of about BLOCK rows, every pair of blocks is one bounded Arrow group,
and it returns a spanning forest of its links instead of all of them, which keeps every
component.  Components come from star joins, written round by round.

Defined results: a null or empty text has fingerprint zero and is linked like any other; a very
long text is read whole, its shingles are counted in blocks; rows
with a null id get their group's smallest non-null id (null if there is none); repeated rows
stay; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imprint._ship import ship_with_tasks
from imprint.llm.common import stage
from imprint.llm.components import components

ship_with_tasks(__name__)

SEED = 42
SHINGLE = 3
MAX_DISTANCE = 3
SEGMENTS = 8
SMALL_KEY = 64  # keys with more fingerprints go through blocks
BLOCK = 1024


# ---------------------------------------------------------------- fingerprints


def text_fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint of one whole text in UTF-8."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, n - shingle + 1
    )
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].astype(">u8")
        votes += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(hashes))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text as a signed 64-bit long."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("b"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [text_fingerprint(b, shingle, seed) for b in batch.column(1).to_pylist()]
            fp = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    return src.mapInArrow(run, f"id {id_type}, fp long")


# ---------------------------------------------------------------- pigeonring links


def _budgets(segments: int, distance: int) -> list[int]:
    """Most differences allowed in a chain of 1, 2, ... segments."""
    return [length * distance // segments for length in range(1, segments + 1)]


def _rotated(x: Column, by: int, width: int) -> Column:
    s = by * width
    return x if not s else F.shiftleft(x, s).bitwiseOR(F.shiftrightunsigned(x, 64 - s))


def _chain(x: Column, by: int, width: int, budgets: list[int]) -> Column:
    """Whether the differing bits ``x`` stay within every chain budget from segment ``by`` on."""
    y = _rotated(x, by, width)
    ok = F.lit(True)
    for length, most in enumerate(budgets, 1):
        ok &= F.bit_count(F.shiftrightunsigned(y, 64 - length * width) if length * width < 64 else y) <= most
    return ok


def _keys(fp: Column, segments: int, budgets: list[int]) -> Column:
    """Array of (slot, key) structs: per rotation the exact segments with one half of the next."""
    width = 64 // segments
    exact = sum(b == 0 for b in budgets) * width
    loose = sum(b == 1 for b in budgets) * width
    out = []
    for by in range(segments):
        y = _rotated(fp, by, width)
        head = F.shiftrightunsigned(y, 64 - exact)
        if not loose:
            out.append(F.struct(F.lit(2 * by).alias("slot"), head.alias("key")))
            continue
        tail = F.shiftrightunsigned(F.shiftleft(y, exact), 64 - loose)
        half = loose // 2
        for side, part in enumerate((F.shiftrightunsigned(tail, half), tail.bitwiseAND(F.lit((1 << half) - 1)))):
            key = F.shiftleft(head, loose - half).bitwiseOR(part)
            out.append(F.struct(F.lit(2 * by + side).alias("slot"), key.alias("key")))
    return F.array(*out)


def _forest(fps: np.ndarray, masks: list[tuple[np.uint64, int]], distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``fps``, tested chain by chain, then in full."""
    left = np.ones(len(fps), bool)
    edges = []
    for root in range(len(fps)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            near = np.flatnonzero(left)
            if not len(near):
                return edges
            x = fps[near] ^ fps[at]
            for mask, most in masks:
                keep = np.bitwise_count(x & mask) <= most
                near, x = near[keep], x[keep]
            near = near[np.bitwise_count(x) <= distance]
            left[near] = False
            queue += near.tolist()
            edges += [(int(fps[at]), int(fps[v])) for v in near]
    return edges


def links(
    nodes: DataFrame, distance: int = MAX_DISTANCE, segments: int = SEGMENTS, small: int = SMALL_KEY, block: int = BLOCK
) -> DataFrame:
    """(a, b) of distinct fingerprints ``fp`` within ``distance``: enough links to connect
    exactly the fingerprints that all links connect."""
    if 64 % segments or not 0 <= distance < segments:
        raise ValueError("segments must divide 64 and exceed the distance")
    budgets, width = _budgets(segments, distance), 64 // segments
    keyed = nodes.select("fp", F.explode(_keys(F.col("fp"), segments, budgets)).alias("k"))
    keyed = stage(keyed.select(F.col("k.slot").alias("slot"), F.col("k.key").alias("key"), "fp"), "simhash-keys")
    counts = keyed.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = stage(keyed.join(stage(counts, "simhash-counts"), ["slot", "key"]), "simhash-met")

    few = met.filter(F.col("n") <= small)
    a = few.select("slot", "key", F.col("fp").alias("a"))
    b = few.select("slot", "key", F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    rotation = F.shiftright("slot", 1)
    chains = [_chain(x, by, width, budgets[:-1]) for by in range(segments)]
    chain = F.coalesce(*(F.when(rotation == by, ok) for by, ok in enumerate(chains)))
    first = F.coalesce(*(F.when(ok, F.lit(by)) for by, ok in enumerate(chains)))
    exact = sum(v == 0 for v in budgets) * width
    loose = sum(v == 1 for v in budgets) * width
    y = F.coalesce(*(F.when(rotation == by, _rotated(x, by, width)) for by in range(segments)))
    front = F.shiftrightunsigned(F.shiftleft(y, exact), 64 - loose + loose // 2) if loose else F.lit(0)
    once = (F.col("slot") % 2 == 0) | (front != 0)  # the second half only where the first differs
    pairs = a.join(b, ["slot", "key"]).filter(
        (F.col("a") < F.col("b")) & chain & (F.bit_count(x) <= distance) & (first == rotation) & once
    )

    many = met.filter(F.col("n") > small)
    many = many.withColumn("nb", F.ceil(F.col("n") / block).cast("int"))
    many = many.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    many = many.select(
        "slot", "key", "fp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")
    )

    def grouped(rows: pd.DataFrame) -> pd.DataFrame:
        by = int(rows["slot"].iloc[0]) // 2
        masks = []
        for length, most in enumerate(budgets[:-1], 1):
            ones = ((1 << length * width) - 1) << (64 - length * width)
            s = by * width
            masks.append((np.uint64(((ones >> s) | (ones << (64 - s))) & (2**64 - 1)), most))
        fps = np.unique(rows["fp"].to_numpy(np.int64).view(np.uint64))
        out = np.array(_forest(fps, masks, distance), np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": out.min(axis=1), "b": out.max(axis=1)})

    trees = many.groupBy("slot", "key", "i", "j").applyInPandas(grouped, "a long, b long")
    return pairs.select("a", "b").unionByName(trees).distinct()


# ---------------------------------------------------------------- groups


def _groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of every row, and (fp, root, component_id) of every fingerprint."""
    marked = stage(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    nodes = stage(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    parts = stage(components(links(nodes, distance), "simhash"), "simhash-parts")
    linked = stage(parts.join(nodes, parts.node == nodes.fp).select("fp", "root", "least"), "simhash-linked")
    lowest = stage(linked.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-lowest")
    grouped = linked.join(lowest, "root").select("fp", "root", "component_id")
    alone = nodes.join(linked.select("fp"), "fp", "left_anti")
    alone = alone.select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return marked, stage(grouped.unionByName(alone), "simhash-named")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    distance: int = MAX_DISTANCE,
) -> DataFrame:
    """(id, fp, component_id) per input row; component_id is the smallest id reachable."""
    marked, named = _groups(docs, id_col, text_col, shingle, distance)
    return marked.join(named, "fp").select("id", "fp", "component_id").withColumnRenamed("id", id_col)


def one_per_group(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    distance: int = MAX_DISTANCE,
) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that of the smallest id.

    Ids that occur in one row are kept by a semi join; for repeated or null ids the rows are
    matched to their group by fingerprint, and one row of each group stays.
    """
    marked, named = _groups(docs, id_col, text_col, shingle, distance)
    lowest = F.col("id").eqNullSafe(F.col("component_id"))
    per_id = marked.join(named, "fp").groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(lowest, 1)).alias("n_lowest")
    )
    per_id = stage(per_id.filter("n_lowest > 0"), "simhash-picks")
    row = docs.select(F.struct(*docs.columns).alias("_row")).withColumn("_id", F.col("_row")[id_col])
    # the texts are shuffled once at every size, and both sides can spill
    single = per_id.filter("n = 1 and id is not null").select("id").hint("merge")
    sure = row.join(single, row._id == single.id, "left_semi").select("_row")
    several = per_id.filter("n > 1 or id is null").select("id")
    if several.isEmpty():  # no id is repeated or null
        return sure.select("_row.*")

    def mark(texts: pd.Series) -> pd.Series:
        fps = np.array([text_fingerprint(b, shingle) for b in texts], np.uint64)
        return pd.Series(fps.view(np.int64))

    fp = F.pandas_udf(mark, "long").asNondeterministic()
    rest = row.join(several, row._id.eqNullSafe(several.id), "left_semi")
    rest = rest.withColumn("_fp", fp(F.col("_row")[text_col].cast("string").cast("binary")))
    rest = rest.join(named, F.col("_fp") == named.fp).filter(F.col("_id").eqNullSafe(F.col("component_id")))
    return sure.unionByName(rest.dropDuplicates(["root"]).select("_row")).select("_row.*")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
