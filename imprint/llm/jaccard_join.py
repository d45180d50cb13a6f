"""N-gram Jaccard join in a metric space: Voronoi regions, windows and recursion (operator 13).

A document is the set of its distinct five-word shingles (64-bit hashes).  Documents link at a
Jaccard distance of at most r = 1 - percent / 100, and the join returns enough links to connect
exactly the documents that all links connect.

Pivots and regions.  Linked documents x and y with n_x and n_y shingles share at least K(n) of
the n - ceil(percent n / 100) + K(n) smallest hashes of either, n being the smaller size.  Each
such hash is owned by the first document (the pivot) that has it, so a pivot's cell is the set of
hashes that it owns, and the mass of a document in a cell is how many of its smallest hashes lie
there.  A document's region is the cell that holds most of it; distances to the cells differ as
the masses do.  Documents whose hashes are nobody else's have no link and leave at once.

Windows.  Swapping x for a linked y moves at most the hashes that they don't share, so x need not
be in cells whose masses sum to at most s(x) = (K(percent n_x / 100) - 1) / 2: of the K shared
hashes fewer than K lie in cells that x or y left out, and the pair meets in another one.  A
boundary document is replicated to all cells beyond that slack, and to no other.

Recursion.  A region of bounded size is joined in one Arrow group, which returns a spanning forest
of its links.  A larger one takes PIVOTS of its documents as new pivots: exact distances to them
are computed block by block, documents within r of a pivot are linked to it, every document goes
to its nearest pivot's cell and, by the triangle inequality, to each cell whose pivot is at most
2 r further; documents further than 1 - 2 r from all pivots, and those at most r nearer, form one
more cell.  Pairs that are both linked to a cell's pivot need no check.  Cells that are still large
are split again; where cells would cost more than they save, or after LEVELS, the region is joined
as pairs of bounded blocks.

Skew: equal sets are one node (and at most one row a task before that), owners are aggregated with
map-side combine, and the joins back to the rows are split by skew handling.

Defined results: a null text, or one without words, has an empty set and is linked with nothing,
its own copies included; a text under five words has one shingle, its whole sequence; texts of any
length are read whole; equal sets are linked; a row with a null id gets its group's smallest id
(null if there is none); rows of a repeated id stand for themselves; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imprint._ship import ship_with_tasks
from imprint.llm.common import stage
from imprint.llm.components import components

ship_with_tasks(__name__)

SHINGLE = 5
PERCENT = 80
#: Shared hashes that a link guarantees among the smallest ones, as a share of the set.
SLACK_PERCENT = 10
#: A region that one group joins: most documents and most shingles.
LEAF_DOCS = 4096
LEAF_SHINGLES = 1 << 22
PIVOTS = 8
LEVELS = 3

_BASE = np.uint64(0x9E3779B97F4A7C15)
_CACHE = 1 << 20  # words, or sets met before, that a task remembers at once


# ---------------------------------------------------------------- sets


def shingle_set(text: bytes | None, words_hashed: dict[bytes, int], shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text in UTF-8."""
    words = (text or b"").lower().split()
    n = len(words)
    if n < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), n)] if n else [], np.uint64)
    if len(words_hashed) > _CACHE:
        words_hashed.clear()
    known = words_hashed.get
    hashes = np.empty(n, np.uint64)
    for i, w in enumerate(words):
        h = known(w)
        if h is None:
            h = words_hashed[w] = xxhash.xxh64_intdigest(w, shingle)
        hashes[i] = h
    grams = hashes[: n - shingle + 1].copy()
    for j in range(1, shingle):
        grams *= _BASE
        grams += hashes[j : j + len(grams)]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    return np.unique(grams)


def set_key(grams: np.ndarray) -> int:
    """Signed 64-bit key of a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), 1)).astype(np.int64))


def shared_least(n: int) -> int:
    """K(n): hashes that a set of n shingles shares with a linked one among their smallest."""
    return max(1, n * SLACK_PERCENT // 100)


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + shared_least(n))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int64)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int64()))


def smallest_hashes(docs: DataFrame, percent: int) -> DataFrame:
    """(id, node, n, smallest) of every row; a set that a task has met before has no ``smallest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed: dict[bytes, int] = {}
        met: set[int] = set()
        for batch in batches:
            nodes, sizes, smallest = [], [], []
            for b in batch.column(1):
                grams = shingle_set(b.as_py(), hashed)
                node = set_key(grams) if len(grams) else None
                new = node is not None and node not in met
                if len(met) > _CACHE:
                    met.clear()
                met.add(node)
                nodes.append(node)
                sizes.append(len(grams))
                smallest.append(grams[: prefix_length(len(grams), percent)] if new else grams[:0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), _lists(smallest)],
                names=["id", "node", "n", "smallest"],
            )

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, node long, n long, smallest array<long>")


def _whole_sets(texts: DataFrame) -> DataFrame:
    """(node, n, grams) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed: dict[bytes, int] = {}
        for batch in batches:
            sets = [s for s in (shingle_set(b.as_py(), hashed) for b in batch.column(0)) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)],
                names=["node", "n", "grams"],
            )

    return texts.mapInArrow(run, "node long, n long, grams array<long>")


# ---------------------------------------------------------------- regions


def regions(rows: DataFrame, percent: int) -> DataFrame:
    """(region, node) of every document in its own region and in those its window reaches.

    ``rows`` (row, node, n, smallest) is a written table; a region is named by its pivot's row.
    """
    hashes = rows.select("row", F.explode("smallest").alias("h"))
    owners = hashes.groupBy("h").agg(F.min("row").alias("owner"), F.max("row").alias("last"))
    # all other hashes are shared with nobody; a written table lets the join split a frequent hash
    owners = stage(owners.filter("owner < last").select("h", "owner"), "jaccard-owners")
    mass = hashes.join(owners, "h").groupBy("row", "owner").agg(F.count(F.lit(1)).alias("mass"))
    mass = mass.join(rows.select("row", "node", "n"), "row")
    # the hashes that a link guarantees, whatever the linked document's size
    least = F.greatest(F.lit(1), F.expr(f"((n * {percent} + 99) div 100) * {SLACK_PERCENT} div 100"))
    per_row = Window.partitionBy("row")
    upto = F.sum("mass").over(per_row.orderBy("mass", "owner").rowsBetween(Window.unboundedPreceding, 0))
    mass = mass.withColumn("upto", upto).withColumn("all", F.sum("mass").over(per_row)).withColumn("least", least)
    near = mass.filter("all >= least and upto > (least - 1) div 2")
    return near.select(F.col("owner").cast("string").alias("region"), "node").distinct()


def _sized(members: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """Members of regions with two or more, with the region's documents ``m`` and shingles ``w``."""
    members = members.join(sets.select("node", "n"), "node")
    sizes = members.groupBy("region").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"), F.count(F.when(~F.col("core"), 1)).alias("free")
    )
    sizes = stage(sizes.filter("m > 1 and free > 0"), f"{label}-sizes")  # written, so that a large region is split
    return stage(members.join(sizes, "region").select("region", "node", "n", "core", "m", "w", "free"), label)


class _Sets:
    """Shingle sets of one Arrow group in flat arrays, compacted as documents leave."""

    def __init__(self, nodes: np.ndarray, grams: pa.Array):
        ends = np.asarray(grams.offsets, np.int64)
        flat = np.asarray(grams.values)[ends[0] : ends[-1]]
        values, codes = np.unique(flat, return_inverse=True)
        self.nodes, self.codes, self.ends = nodes, codes, ends - ends[0]
        self.n = np.diff(self.ends)
        self.mark = np.zeros(len(values), np.int8)
        self.rows = np.arange(len(nodes))  # documents that the compacted arrays hold
        self.flat, self.starts = codes, self.ends[:-1]

    def compact(self, left: np.ndarray) -> None:
        self.rows = np.flatnonzero(left)
        n = self.n[self.rows]
        self.starts = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(self.ends[:-1][self.rows] - self.starts, n)
        self.flat = self.codes[at]

    def shared(self, row: int) -> np.ndarray:
        """Shingles that each of ``rows`` shares with ``row``."""
        own = self.codes[self.ends[row] : self.ends[row + 1]]
        self.mark[own] = 1
        out = np.add.reduceat(self.mark[self.flat], self.starts, dtype=np.int64)
        self.mark[own] = 0
        return out


def spanning_links(nodes: np.ndarray, grams: pa.Array, core: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of a group whose ``core`` documents are connected already."""
    sets, left, out = _Sets(nodes, grams), np.ones(len(nodes), bool), []
    joined = False
    for root in range(len(nodes)):
        queue = [root] if left[root] else []
        left[root] = False
        while queue:
            at = queue.pop()
            if core[at] and not joined:
                joined = True
                rest = np.flatnonzero(left & core)
                left[rest] = False
                queue += rest.tolist()
            if 2 * left.sum() < len(sets.rows):
                sets.compact(left)
            if not len(sets.rows):
                return out
            both = sets.shared(at)
            near = sets.rows[100 * both >= percent * (sets.n[at] + sets.n[sets.rows] - both)]
            near = near[left[near]]
            left[near] = False
            queue += near.tolist()
            out += [(int(nodes[at]), int(nodes[v])) for v in near]
    return out


def _grams_of(table: pa.Table) -> pa.Array:
    grams = table.column("grams").combine_chunks()
    return grams.chunk(0) if isinstance(grams, pa.ChunkedArray) else grams


def _group_links(percent: int):
    def join(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        links = spanning_links(nodes, _grams_of(table), table.column("core").to_numpy(), percent)
        ab = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": ab[:, 0], "b": ab[:, 1]})

    return join


def _leaf_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    rows = members.select("region", "node", "core").join(sets.select("node", "grams"), "node")
    return rows.groupBy("region").applyInArrow(_group_links(percent), "a long, b long")


def _block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of large regions: every pair of blocks with a document not yet linked to the pivot."""
    per_doc = F.col("w") / F.col("m")
    size = F.greatest(F.lit(1), F.least(F.lit(LEAF_DOCS // 2), F.floor(LEAF_SHINGLES / 2 / per_doc)))
    nf, nc = F.ceil(F.col("free") / size).cast("int"), F.ceil((F.col("m") - F.col("free")) / size).cast("int")
    dealt = F.xxhash64("node", F.lit("block"))
    mine = F.when(F.col("core"), nf + F.pmod(dealt, F.greatest(nc, F.lit(1)))).otherwise(F.pmod(dealt, nf))
    last = F.when(F.col("core"), nf).otherwise(nf + nc) - 1
    rows = members.withColumn("mine", mine.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select("region", "node", "core", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    rows = rows.join(sets.select("node", "grams"), "node")
    return rows.groupBy("region", "i", "j").applyInArrow(_group_links(percent), "a long, b long")


def _cells(members: DataFrame, sets: DataFrame, percent: int, level: int) -> DataFrame:
    """(region, cell, pivot, node, core, m): the cells of every document of large regions."""
    picks = [
        F.min(F.struct(F.xxhash64("node", F.lit(level * PIVOTS + i)).alias("h"), "node"))["node"] for i in range(PIVOTS)
    ]
    blocks = F.ceil(F.col("w") / (LEAF_SHINGLES // 4)).cast("int")
    pivots = members.groupBy("region", blocks.alias("blocks")).agg(F.array_distinct(F.array(*picks)).alias("pivots"))
    pivots = pivots.select("region", "blocks", F.explode("pivots").alias("node")).join(sets.select("node", "grams"), "node")
    pivots = pivots.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = members.withColumn("block", F.pmod(F.xxhash64("node", F.lit("cell")), blocks).cast("int"))
    rows = rows.select("region", "block", "node", "m").join(sets.select("node", "grams"), "node")
    r = 1 - percent / 100

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        own, nodes = right.column("pivot_node").to_numpy(), left.column("node").to_numpy()
        grams = _grams_of(pa.concat_tables([right.select(["pivot_grams"]).rename_columns(["grams"]), left.select(["grams"])]))
        sets_ = _Sets(np.concatenate((own, nodes)), grams)
        far, core = np.ones((len(own), len(nodes))), np.zeros((len(own), len(nodes)), bool)
        if len(nodes):
            for p in range(len(own)):
                both = sets_.shared(p)[len(own) :]
                union = sets_.n[p] + sets_.n[len(own) :] - both
                far[p], core[p] = 1 - both / union, 100 * both >= percent * union
        home = far.min(axis=0) if len(own) else np.ones(len(nodes))
        here = (far <= home + 2 * r + 1e-9) & (home <= 1 - 2 * r + 1e-9)
        p, d = np.nonzero(here | core)
        out = np.flatnonzero(home > 1 - 3 * r - 1e-9)
        region = left.column("region")[0].as_py() if len(nodes) else ""
        n, m = len(d) + len(out), left.column("m")[0].as_py() if len(nodes) else 0
        pivot = pa.array([*own[p].tolist(), *[None] * len(out)], pa.int64())
        return pa.table(
            {
                "region": pa.array([region] * n, pa.string()),
                "pivot": pivot,
                "node": pa.array(np.concatenate((nodes[d], nodes[out])), pa.int64()),
                "core": pa.array(np.concatenate((core[p, d], np.zeros(len(out), bool)))),
                "m": pa.array([m] * n, pa.int64()),
            }
        )

    pivots = pivots.select(*(F.col(c).alias(f"pivot_{c}") for c in ("region", "block", "node", "grams")))
    both = rows.groupBy("region", "block").cogroup(pivots.groupBy("pivot_region", "pivot_block"))
    return both.applyInArrow(assign, "region string, pivot long, node long, core boolean, m long")


def links(rows: DataFrame, docs: DataFrame, percent: int, leaf: int = LEAF_DOCS) -> DataFrame:
    """(a, b) of nodes that link, enough of them to connect what all links connect."""
    near = stage(regions(rows, percent), "jaccard-near")
    sizes = near.groupBy("region").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("region")
    sizes = stage(sizes, "jaccard-company")
    near = stage(near.join(sizes, "region").withColumn("core", F.lit(False)), "jaccard-members")

    # whole sets of the documents that have company; the texts are shuffled once
    some = rows.join(near.select("node").distinct(), "node").groupBy("node").agg(F.min("id").alias("id"))
    some = stage(some, "jaccard-some")
    texts = docs.join(some.select("id").distinct().hint("merge"), "id", "left_semi")
    if not some.filter("id is null").isEmpty():  # sets that only rows without an id have
        texts = texts.unionByName(docs.filter("id is null"))
    sets = stage(_whole_sets(texts.select("b")).dropDuplicates(["node"]), "jaccard-sets")

    found = []
    members = _sized(near, sets, "jaccard-sized")
    for level in range(LEVELS + 1):
        small = (F.col("m") <= leaf) & (F.col("w") <= LEAF_SHINGLES)
        found.append(_leaf_links(members.filter(small), sets, percent))
        large = members.filter(~small)
        if large.isEmpty():
            break
        if level == LEVELS:
            found.append(_block_links(large, sets, percent))
            break
        cells = stage(_cells(large, sets, percent, level), "jaccard-cells")
        found.append(cells.filter("core and pivot <> node").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        cost = cells.groupBy("region", "pivot").agg(
            F.count(F.lit(1)).alias("c"), F.count(F.when(~F.col("core"), 1)).alias("f"), F.max("m").alias("m")
        )
        cost = cost.groupBy("region").agg((2 * F.sum(F.col("f").cast("double") * F.col("c")) <= F.max("m") * F.max("m")).alias("pays"))
        cost = stage(cost, "jaccard-costs")
        found.append(_block_links(large.join(cost.filter("not pays").select("region"), "region"), sets, percent))
        deeper = cells.join(cost.filter("pays").select("region"), "region")
        name = F.concat_ws("/", "region", F.coalesce(F.col("pivot").cast("string"), F.lit("out")))
        members = _sized(deeper.select(name.alias("region"), "node", "core"), sets, "jaccard-sized")
    return reduce(DataFrame.unionByName, (x.select("a", "b") for x in found)).distinct()


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, leaf: int = LEAF_DOCS
) -> DataFrame:
    """(id, n_shingles, component_id) per input row; component_id is the smallest id reachable."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("b"))
    rows = stage(smallest_hashes(src, percent).withColumn("row", F.monotonically_increasing_id()), "jaccard-rows")
    slim = rows.select("id", "node", "n")
    parts = components(links(rows, src, percent, leaf), "jaccard")
    nodes = slim.filter("n > 0").groupBy("node").agg(F.min("id").alias("least"))
    nodes = stage(nodes.join(parts, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "jaccard-nodes")
    named = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(nodes.join(named, "root").select("node", "component_id"), "jaccard-named")
    full = slim.filter("n > 0").join(named, "node").select("id", F.col("n").alias("n_shingles"), "component_id")
    empty = slim.filter("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return full.unionByName(empty).withColumnRenamed("id", id_col)
