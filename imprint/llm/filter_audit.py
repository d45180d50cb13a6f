"""Interaction audit of a chain of filters by min-plus removal ranks (operator 12).

Each document has a mask of the filters it fails.  For an order of the filters, the inverse
permutation gives each filter's position; the step that removes a document is the least position
among its failures.  With a mask matrix M (0 where a filter fails, infinite elsewhere) and a
position matrix P (orders x filters) that is the min-plus product  step = min_f (M[., f] + P[., f]),
infinite for documents that stay.  Documents are first counted by (part, mask, quality, toxic), at
most 2^filters x 4 rows for each part, so the matrices are small and every part's product and its
weighted scatter counts are one bounded group.

Filters, on whole texts: A under 200 words; B fewer distinct words than half the words; C over 2 %
of the code points are A-Z; D any of ``#$%&*|``; E the text equals that of a smaller id anywhere
in the table.

Skew: the smallest id of every text is aggregated with map-side combine, and the rows meet only
texts that repeat, in a join whose hot texts skew handling splits; a part of any size is a few
counted rows by then.

Defined results: a null text counts as an empty one; a null source is the part ``''``, together
with empty sources; a null id is never a copy nor the smaller id, and has no labels; repeated ids
with equal texts are not copies of each other; several label rows of an id count once, as good or
toxic if any of them says so; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import permutations
from string import ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint._ship import ship_with_tasks
from imprint.llm.common import stage

ship_with_tasks(__name__)

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
MARKS = b"#$%&*|"
_CAPITALS = ascii_uppercase.encode()

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_mask(text: bytes | None) -> int:
    """Bits 0 to 3: whether a whole text fails A, B, C and D."""
    b = text or b""
    words = b.split()
    chars = len(b) if b.isascii() else int(np.count_nonzero((np.frombuffer(b, np.uint8) & 0xC0) != 0x80))
    fails = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words),
        100 * (len(b) - len(b.translate(None, _CAPITALS))) > MAX_CAPITAL_PERCENT * chars,
        any(m in b for m in MARKS),
    )
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def removal_steps(masks: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Min-plus product (masks x orders): the step that removes a mask, infinite if none does."""
    n = positions.shape[1]
    cost = np.where(masks[:, None] >> np.arange(n) & 1, 0.0, np.inf)
    steps = np.full((len(masks), len(positions)), np.inf)
    for f in range(n):
        np.minimum(steps, cost[:, f, None] + positions[None, :, f], out=steps)
    return steps


def order_positions(filters: str = FILTERS) -> tuple[list[str], np.ndarray]:
    """All orders, and the inverse permutation of each: a filter's step from 1 on."""
    orders = ["".join(p) for p in permutations(filters)]
    return orders, np.array([[o.index(f) + 1 for f in filters] for o in orders], float)


def audit_counts(rows: pd.DataFrame, filters: str = FILTERS) -> pd.DataFrame:
    """COUNTS of every (order, step) from the counted masks of one part."""
    n, (orders, positions) = len(filters), order_positions(filters)
    masks, weight = rows["mask"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    good, toxic = (rows[c].to_numpy(bool) for c in ("good", "toxic"))
    steps = removal_steps(masks, positions)
    left = np.isfinite(steps)
    at = (np.broadcast_to(np.arange(len(orders)) * n, steps.shape)[left] + steps[left] - 1).astype(np.int64)

    def scatter(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(orders) * n, np.int64)
        np.add.at(out, at, np.broadcast_to(values[:, None], steps.shape)[left])
        return out.reshape(len(orders), n)

    removed = scatter(weight)
    filter_at = positions.argsort(axis=1)  # which filter stands at each step
    fails = np.array([weight[masks >> f & 1 == 1].sum() for f in range(n)])
    alone = np.array([weight[masks == 1 << f].sum() for f in range(n)])
    shapley = np.zeros(n, np.int64)
    np.add.at(shapley, filter_at, removed)
    out = {
        "kept": weight.sum() - removed.cumsum(axis=1),
        "removed": removed,
        "redundant": fails[filter_at] - removed,
        "unique_fails": alone[filter_at],
        "good_lost": scatter(weight * good),
        "toxic_lost": scatter(weight * toxic),
        "shapley": shapley[filter_at],
    }
    return pd.DataFrame(
        {
            "filter_order": np.repeat(orders, n),
            "step": np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)),
            **{k: out[k].reshape(-1) for k in COUNTS},
        }
    )


def masked(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, mask of A to D, digest of the text) of every row."""
    src = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.col(text_col).cast("string").cast("binary").alias("b"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b or b"" for b in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array([text_mask(b) for b in texts], pa.int32()),
                    pa.array([blake2b(b, digest_size=16).digest() for b in texts], pa.binary()),
                ],
                names=["id", "part", "mask", "digest"],
            )

    return src.mapInArrow(run, "id long, part string, mask int, digest binary")


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """(part, filter_order, step, COUNTS): what every filter removes at every place in the chain."""
    rows = stage(masked(docs, id_col, text_col, part_col), "audit-masks")
    copies = rows.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    copies = stage(copies.filter("n > 1").select("digest", "least"), "audit-copies")
    rows = rows.join(copies, "digest", "left").drop("digest")
    copy = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    rows = rows.withColumn("mask", F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).drop("least")

    said = labels.select(F.col(id_col).cast("long").alias("id"), "quality", "toxic").filter("id is not null")
    said = said.groupBy("id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    rows = rows.join(said, "id", "left").na.fill(False, ["good", "toxic"])
    counted = rows.groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))

    def part_audit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = audit_counts(group)
        out.insert(0, "part", key[0])
        return out

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return counted.groupBy("part").applyInPandas(part_audit, schema)
