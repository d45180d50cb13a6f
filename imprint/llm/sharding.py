"""Shards by balanced label propagation under row quotas (operator 10, built-in functions only).

Documents with equal texts are linked through a hub.  Rows are first dealt evenly over the
shards; then the rows of every cut hub ask to move to the shard that already holds most of the
hub, by turns among all shards and among those with room.  The wishes are summed for each pair of
shards.  Full shards exchange rows: wishes that run in a circle (A to B and B to A, or longer) are
admitted as far as the least of them, and what is left goes into free places, those left in the
same round included.  A round is a few joins over one row per (hub, shard); rounds repeat while
more cuts are left than pairs of shards and two rounds, one of either kind, take away at least a
tenth of them.

The hubs that are cut then are settled on the places they hold and the free ones: those above
1/FINE of a quota one by one, largest first, into the fullest shard that takes them whole or else
into the emptiest ones; all others are laid in a line, in which only the hub at a shard's end is
cut, and only if the shard has no free place for the rest of it.  The settled state is taken if it
has fewer cuts; at most ``shards - 1`` of its small hubs are cut.  Rows without links fill what is
free, so shard sizes differ by one row at most.

Admission is exact: wishes are admitted by hash bucket, those above 1/FINE of a quota before all
others, and in the bucket that the admitted sum ends in one by one.

Skew: hub counts are pre-aggregated; a hub of any size is one row per shard during propagation.
Its rows get their place in the hub from a range partition with boundary offsets, and meet the
hub's shard intervals in a join of two written tables, which skew handling splits.

Defined results: a null text counts as an empty one (size 1, crc of no bytes); repeated rows are
rows of the same hub; a very long text is one row, whose size is whole; ties between shards go by a
hash of hub and shard; fewer rows than shards leave shards empty; an empty table gives an empty
result; extra columns are ignored; null and repeated ids are kept as they are.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imprint.llm.common import positions_within, row_positions, stage

_LOG = logging.getLogger(__name__)

SHARDS = 8
FINE = 64
BUCKETS = 1024

Matrix = list[list[int]]  # rows from shard to shard


def _per_shard(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), shard + 1)


def _circle(rest: Matrix) -> list[int] | None:
    """A shortest circle of shards with wishes left, each to the next and the last to the first."""
    found = None
    for start in range(len(rest)):
        paths, seen = [[start]], {start}
        while paths and (found is None or len(paths[0]) < len(found)):
            path = paths.pop(0)
            if rest[path[-1]][start]:
                found = path
                break
            for to, n in enumerate(rest[path[-1]]):
                if n and to not in seen:
                    seen.add(to)
                    paths.append([*path, to])
    return found


def admitted(wishes: Matrix, free: list[int]) -> Matrix:
    """Rows admitted from shard to shard: circles of wishes, then what free places take."""
    rest, free = [list(row) for row in wishes], list(free)
    while circle := _circle(rest):
        steps = list(zip(circle, [*circle[1:], circle[0]]))
        least = min(rest[a][b] for a, b in steps)
        for a, b in steps:
            rest[a][b] -= least
    moved = True
    while moved:  # no circles are left, so this ends
        moved = False
        for a, row in enumerate(rest):
            for b, n in enumerate(row):
                if n := min(n, free[b]):
                    row[b], free[a], free[b], moved = row[b] - n, free[a] + n, free[b] - n, True
    return [[w - r for w, r in zip(ws, rs)] for ws, rs in zip(wishes, rest)]


def _round(state: DataFrame, free: list[int], big: int, turn: int) -> DataFrame:
    """One round over (hub, shard, n): moves that keep every shard within its quota."""
    per_hub = Window.partitionBy("hub")
    room = (_per_shard(free, F.col("shard")) > 0) if turn % 2 else F.lit(True)
    rank = F.struct(room.alias("room"), "n", F.xxhash64("hub", "shard", F.lit(turn)).alias("tie"), "shard")
    asked = state.withColumn("best", F.max(rank).over(per_hub))
    asked = asked.withColumn("to", F.col("best.shard")).withColumn("most", F.col("best.n")).drop("best")
    asks = (F.col("shard") != F.col("to")) & (F.col("n") <= F.col("most"))
    bucket = F.pmod(F.xxhash64("hub", F.lit(turn)), F.lit(BUCKETS))
    asked = asked.withColumn("bucket", F.when(asks, F.when(F.col("n") > big, -1).otherwise(bucket)))
    asked = stage(asked.drop("most"), "shard-asked")

    pair = ["shard", "to"]
    sums = asked.filter("bucket is not null").groupBy(*pair, "bucket").agg(F.sum("n").alias("sum"))
    sums = stage(sums, "shard-wishes")
    wishes = [[0] * len(free) for _ in free]
    for r in sums.groupBy(*pair).agg(F.sum("sum").alias("n")).collect():
        wishes[r["shard"]][r["to"]] = r["n"]
    grants = [n for row in admitted(wishes, free) for n in row]
    upto = F.sum("sum").over(Window.partitionBy(*pair).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    left = _per_shard(grants, F.col("shard") * len(free) + F.col("to")) - upto + F.col("sum")
    sums = sums.withColumn("left", left).filter("left > 0")  # places before the bucket's first row

    out = asked.join(F.broadcast(sums), [*pair, "bucket"], "left").drop("bucket")
    whole = out.filter("left is null or left >= sum")
    whole = whole.withColumn("gone", F.when(F.col("left").isNotNull(), F.col("n")).otherwise(0))
    ended = out.filter("left < sum")  # one bucket of each pair
    earlier = F.sum("n").over(Window.partitionBy(*pair).orderBy("hub").rowsBetween(Window.unboundedPreceding, -1))
    gone = F.greatest(F.lit(0), F.least("n", F.col("left") - F.coalesce(earlier, F.lit(0))))
    out = whole.unionByName(ended.withColumn("gone", gone))
    stays = out.select("hub", "shard", (F.col("n") - F.col("gone")).alias("n"))
    comes = out.select("hub", F.col("to").alias("shard"), F.col("gone").alias("n"))
    return stays.unionByName(comes).groupBy("hub", "shard").agg(F.sum("n").alias("n")).filter("n > 0")


def _loads(state: DataFrame, shards: int) -> tuple[list[int], int]:
    """Rows of each shard, and the pieces of all hubs."""
    held = state.groupBy("shard").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pieces")).collect()
    loads = {r["shard"]: r["n"] for r in held}
    return [loads.get(s, 0) for s in range(shards)], sum(r["pieces"] for r in held)


def propagate(
    state: DataFrame, quotas: list[int], settle: bool = True, cuts: list[int] | None = None
) -> tuple[DataFrame, list[int]]:
    """Propagate (hub, shard, n) until a round of either kind lowers the cut no more, then settle
    the hubs still cut; also the linked rows of each shard.  ``cuts`` receives the cut before and
    after every round, and after settling."""
    shards, big = len(quotas), max(quotas) // FINE
    cuts = [] if cuts is None else cuts
    hubs = state.select("hub").distinct().count()
    loads, pieces = _loads(state, shards)
    cuts.append(pieces - hubs)
    idle = rounds = 0
    while cuts[-1] and idle < 2:  # a move joins a piece of its hub, so the cut never grows
        free = [q - n for q, n in zip(quotas, loads)]
        rounds += 1
        state = stage(_round(state, free, big, rounds), "shard-round")
        loads, pieces = _loads(state, shards)
        cuts.append(pieces - hubs)
        idle = 0 if cuts[-1] < cuts[-2] else idle + 1
    _LOG.info("label propagation: %d rounds, cuts %s", rounds, cuts)
    if cuts[-1] and settle:
        settled = stage(_settle(state, quotas, big), "shard-settled")
        after, pieces = _loads(settled, shards)
        _LOG.info("settling: %d cuts left by propagation, %d after", cuts[-1], pieces - hubs)
        if pieces - hubs < cuts[-1]:
            cuts.append(pieces - hubs)
            return settled, after
    return state, loads


def _settle(state: DataFrame, quotas: list[int], big: int) -> DataFrame:
    """(hub, shard, n) with the cut hubs laid anew on the places that whole hubs leave."""
    shards = range(len(quotas))
    hubs = state.groupBy("hub").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("n").alias("n"), F.min("shard").alias("shard")
    )
    hubs = stage(hubs, "shard-hubs")
    kept = hubs.filter("pieces = 1").select("hub", "shard", "n")
    cut = hubs.filter("pieces > 1").select("hub", "n")
    room = [q - n for q, n in zip(quotas, _loads(kept, len(quotas))[0])]

    large = []  # at most FINE * shards hubs
    for r in cut.filter(F.col("n") > big).orderBy(F.desc("n"), "hub").collect():
        n = r["n"]
        while n:
            fits = [s for s in shards if room[s] >= n]
            s = min(fits, key=lambda s: room[s]) if fits else max(shards, key=lambda s: room[s])
            large.append((bytes(r["hub"]), s, min(n, room[s])))
            n, room[s] = n - large[-1][2], room[s] - large[-1][2]
    placed = state.sparkSession.createDataFrame(large, "hub binary, shard int, n long")

    small = cut.filter(F.col("n") <= big).withColumn("bucket", F.pmod(F.xxhash64("hub"), F.lit(BUCKETS)))
    sums = stage(small.groupBy("bucket").agg(F.sum("n").alias("sum")), "shard-line")
    total = sums.agg(F.sum("sum")).first()[0] or 0
    ends, spare, line = [], [], 0  # the line's places in each shard, and free places besides
    for s in shards:
        rest = sum(room[s:])
        n = room[s] * (total - line) // rest if rest else 0
        line += n
        ends.append(line)
        spare.append(room[s] - n)
    base = F.sum("sum").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("bucket", F.coalesce(base, F.lit(0)).alias("base"))
    earlier = F.sum("n").over(Window.partitionBy("bucket").orderBy("hub").rowsBetween(Window.unboundedPreceding, -1))
    small = small.withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(F.broadcast(sums), "bucket")
    small = small.withColumn("start", F.col("base") + F.col("earlier")).withColumn("end", F.col("start") + F.col("n"))
    parts = []
    for s in shards:
        begin, end = F.lit(ends[s - 1] if s else 0), F.lit(ends[s])
        here = (F.col("start") >= begin) & (F.col("start") < end) & (F.col("end") - end <= spare[s])
        n = F.greatest(F.lit(0), F.least("end", end) - F.greatest("start", begin)).cast("long")
        parts.append(F.struct(F.lit(s).alias("shard"), n.alias("n"), here.alias("here")))
    small = small.withColumn("parts", F.array(*parts))
    home = F.filter("parts", lambda p: p["here"])
    one = F.transform(home, lambda p: F.struct(p["shard"].alias("shard"), F.col("n").alias("n"), p["here"].alias("here")))
    pieces = F.when(F.size(home) > 0, one).otherwise(F.filter("parts", lambda p: p["n"] > 0))
    small = small.select("hub", F.explode(pieces).alias("p")).select("hub", "p.shard", "p.n")
    return kept.unionByName(placed).unionByName(small)


def assign_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    settle: bool = True,
    cuts: list[int] | None = None,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; shard sizes differ by at most one row.
    ``settle`` and ``cuts`` are those of ``propagate``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("hub"),
    )
    rows = row_positions(rows, "shard-rows", "rid")
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]

    dealt = rows.groupBy("hub", F.pmod("rid", F.lit(shards)).cast("int").alias("shard"))
    state = dealt.agg(F.count(F.lit(1)).alias("n"))
    state = state.withColumn("all", F.sum("n").over(Window.partitionBy("hub"))).filter("all > 1").drop("all")
    state, loads = propagate(stage(state, "shard-state"), quotas, settle, cuts)

    # the rows of a hub, in order, fill its shards' intervals
    upto = F.sum("n").over(Window.partitionBy("hub").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    held = state.select("hub", F.struct(upto.alias("upto"), "shard").alias("part"))
    held = held.groupBy("hub").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    held = stage(held, "shard-held")
    ordered = rows.repartitionByRange(
        int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "hub", "rid"
    ).sortWithinPartitions("hub", "rid")
    ordered = stage(row_positions(ordered, "shard-ordered"), "shard-placed")
    starts = ordered.groupBy("hub").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"))
    starts = stage(starts.filter("n > 1").drop("n").join(held, "hub"), "shard-starts")
    place = F.col("pos") - F.col("start")
    linked = ordered.join(starts, "hub")
    mine = F.filter("parts", lambda p: place < p["upto"])[0]["shard"]
    linked = linked.select("id", "size", "text_crc32", "rid", mine.alias("shard"))

    # rows without links fill the free places in order
    free = [q - n for q, n in zip(quotas, loads)]
    alone = row_positions(ordered.join(starts.select("hub"), "hub", "left_anti").drop("pos"), "shard-alone")
    ends = [sum(free[: s + 1]) for s in range(shards)]
    into = reduce(lambda c, s: c.when(F.col("pos") < ends[s], s), range(1, shards), F.when(F.col("pos") < ends[0], 0))
    alone = alone.select("id", "size", "text_crc32", "rid", into.cast("int").alias("shard"))

    out = positions_within(linked.unionByName(alone), "shard", ["rid"], "shard-slots", "slot")
    return out.select("id", "size", "text_crc32", "shard", "slot").withColumnRenamed("id", id_col)
