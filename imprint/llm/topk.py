"""Exact top-k inner products by columnar branch and bound (operator 8).

Vectors become integers floor(scale * x).  Candidates are laid out vertically in blocks: one row
of the block per dimension, dimensions in order of falling mass.  For each query the partial
scores grow by DIMS dimensions at a time; what the other dimensions can still add is bounded by the
product of the remaining masses (Cauchy-Schwarz).  Candidates whose bound falls below the k-th
best lower bound are dropped and the survivors compacted, until the scores are exact.

Queries are a stated set and meet all candidates in bounded blocks: the query blocks are copied
to one slot per candidate block and joined on the slot, so one task row holds one block of each;
it returns at most k rows per query.  The best k of a query are then merged over its blocks.

Products are summed in 64 bits where the components of both blocks allow it, else in Python's
unbounded integers, block by block.

Defined results: vectors that are null or hold null, NaN or infinite components take no part; rows
without an id take no part either; vectors of another length than the query's are not its
candidates; ties go to the smaller id; a query's own row is no candidate (rows of equal id are all
the query's own); each copy of a repeated query row is a query with ``k`` results of its own;
scaled components, and scores, beyond 64 bits are returned as the nearest long (scores are ranked
before that, up to 38 digits); empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imprint._ship import ship_with_tasks
from imprint.llm.common import row_positions, stage

ship_with_tasks(__name__)

K = 5
SCALE = 256
DIMS = 8
NARROW = 1 << 31  # components below it are kept in four bytes
_DIGITS = 10**38 - 1
CANDIDATES = 4096  # per block
QUERIES = 1024  # per block


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """(dim, ids, data) of rows (id, v): blocks of up to ``size`` vectors of one length, as
    little-endian integers of four bytes, or of eight where a component needs them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}

        def block(dim: int, ids: list, vecs: list) -> pa.RecordBatch:
            data = np.array(vecs, "<i8").reshape(len(ids), dim)
            if not data.size or -NARROW <= data.min() and data.max() < NARROW:
                data = data.astype("<i4")
            cols = [[dim], [np.array(ids, "<i8").tobytes()], [data.tobytes()]]
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                names=["dim", "ids", "data"],
            )

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, vecs = waiting.setdefault(len(v), ([], []))
                ids.append(i)
                vecs.append(v)
                if len(ids) == size:
                    yield block(len(v), *waiting.pop(len(v)))
        for dim, (ids, vecs) in waiting.items():
            yield block(dim, ids, vecs)

    return rows.mapInArrow(run, "dim int, ids binary, data binary")


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): the vectors that take part, as arrays of longs."""
    v = F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("f"))
    scaled = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))))
    return rows.filter("f and id is not null").select("id", scaled.alias("v"))


def _unpacked(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, "<i8")
    wide = len(data) == 8 * len(numbers) * dim
    return numbers, np.frombuffer(data, "<i8" if wide else "<i4").reshape(len(numbers), dim).astype(np.int64)


def _exact(queries: np.ndarray, cands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides in a type whose products and sums are exact: 64 bits, or Python's integers."""
    most = [max(-int(x.min()), int(x.max()), 1) if x.size else 1 for x in (queries, cands)]
    if queries.shape[1] * most[0] * most[1] < 1 << 62:
        return queries, cands
    return queries.astype(object), cands.astype(object)


def search_block(
    qids: np.ndarray, queries: np.ndarray, cids: np.ndarray, cands: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the query, candidate ids, scores) of the best k of one candidate block per query."""
    queries, cands = _exact(queries, cands)
    size_c, size_q = cands.astype(np.float64), queries.astype(np.float64)
    order = np.argsort(-np.abs(size_c).sum(axis=0), kind="stable")
    by_id = np.argsort(cids, kind="stable")
    cids, columns = cids[by_id], np.ascontiguousarray(cands[by_id][:, order].T)  # a row per dimension
    queries, size_c, size_q = queries[:, order], size_c[by_id][:, order].T, size_q[:, order]
    dims, wide = len(columns), columns.dtype == object
    edges = [*range(0, dims, DIMS), dims]
    # mass of the dimensions from each edge on
    rest_c = [np.sqrt((size_c[e:] ** 2).sum(axis=0)) for e in edges]
    rest_q = [np.sqrt((size_q[:, e:] ** 2).sum(axis=1)) for e in edges]
    for at, qid in enumerate(qids):
        q = queries[at]
        alive = np.flatnonzero(cids != qid)
        part = np.zeros(len(alive), columns.dtype)
        cut = columns
        whole = len(alive) == len(cids)
        for step, (a, b) in enumerate(zip(edges, edges[1:]), 1):
            block = cut[a:b] if whole else cut[a:b, alive]
            part = part + q[a:b] @ block
            if len(alive) <= k or (wide and b < dims):  # the bounds below are 64-bit sums
                continue
            if b < dims:  # rounded up, so that rounding never drops a candidate
                more = np.ceil(rest_c[step][alive] * rest_q[step][at] * (1 + 1e-9)) + 1
            else:
                more = np.zeros(len(alive), np.int64)
            low = np.sort(part)[len(alive) - k] if wide else np.partition(part - more, len(alive) - k)[len(alive) - k]
            keep = (part >= low) if wide else part + more >= low
            alive, part, whole = alive[keep], part[keep], False
        best = sorted(range(len(alive)), key=lambda i: (-part[i], cids[alive[i]]))[:k] if wide else np.lexsort((cids[alive], -part))[:k]
        yield at, cids[alive][best], part[best]


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = SCALE,
    candidates: int = CANDIDATES,
    queries: int = QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products.

    ``is_query`` is a condition on the column ``id``.
    """
    rows = integers(vectors, id_col, vec_col, scale)
    blocks = row_positions(_packed(rows, candidates), "topk-candidates", "slot")
    # query rows are numbered, so that copies of one are queries of their own
    numbered = stage(rows.filter(is_query).withColumn("number", F.monotonically_increasing_id()), "topk-numbered")
    asked = stage(_packed(numbered.select("number", F.concat(F.array("id"), "v")), queries), "topk-queries")
    asked = asked.select((F.col("dim") - 1).alias("dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    # a copy of every query block in the slot of each candidate block
    slots = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(blocks.count(), 1) - 1).cast("long")))
    copies = asked.withColumn("slot", slots)
    least, most = -(1 << 63), (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                cids, cands = _unpacked(r["ids"], r["data"], r["dim"])
                numbers, asks = _unpacked(r["q_ids"], r["q_data"], r["dim"] + 1)
                qids = asks[:, 0]
                rows = [
                    (int(numbers[at]), int(qids[at]), int(v), int(s))
                    for at, ids, scores in search_block(qids, asks[:, 1:], cids, cands, k)
                    for v, s in zip(ids, scores)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([x[i] for x in rows], pa.int64()) for i in range(3)),
                        pa.array([Decimal(max(-_DIGITS, min(_DIGITS, x[3]))) for x in rows], pa.decimal128(38, 0)),
                    ],
                    names=["number", "query_id", "vec_id", "score"],
                )

    # copies are estimated at the size of one, so they must not be broadcast
    pairs = copies.hint("merge").join(blocks, ["slot", "dim"]).select("dim", "ids", "data", "q_ids", "q_data")
    found = pairs.mapInArrow(run, "number long, query_id long, vec_id long, score decimal(38,0)")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
    held = F.greatest(F.lit(least), F.least(F.lit(most), F.col("score"))).cast("long").alias("score")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", held)
