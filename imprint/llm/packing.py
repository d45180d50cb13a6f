"""Packing documents into fixed-length sequences by multiway differencing (operator 9).

Every document becomes its ids and an end id.  Whole windows are cut off first, then pieces of
PIECE ids (a quarter of a window) and what is left.  The pieces are dealt into groups of about GROUP
rows, and each group is divided into near-equal windows by Karmarkar-Karp differencing: the two
partial partitions with the largest imbalance are merged, the fullest window of one onto the
emptiest of the other, until one partition is left.  If its fullest window exceeds the capacity,
the number of windows rises and the group is divided anew.

Defined results: a null or empty text is its end id alone; repeated rows, repeated and null ids
are packed row by row; a very long text gives whole windows and one rest; among equal lengths and
equal imbalances the row that came first goes first; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint._ship import ship_with_tasks
from imprint.llm import wordbpe
from imprint.llm.common import stage
from imprint.llm.wordbpe import MAX_WORD_BYTES, MAX_WORDS, worker_table

ship_with_tasks(__name__)

CAPACITY = 2048
PIECE = 512
GROUP = 1024
END_ID = 1


# ---------------------------------------------------------------- differencing


def _merge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loads of two partitions laid in opposite order, and the order that sorts them again."""
    load = a + b[::-1]
    order = np.argsort(-load, kind="stable")
    return load[order], order


def differencing(lengths: list[int], windows: int) -> np.ndarray:
    """Window of every item, by Karmarkar-Karp multiway differencing into ``windows`` windows."""
    if windows == 1:
        return np.zeros(len(lengths), np.int64)
    loads: list[np.ndarray] = []
    made: list[tuple[int, int, np.ndarray] | None] = []
    heap = []
    for i, n in enumerate(lengths):
        load = np.zeros(windows, np.int64)
        load[0] = n
        loads.append(load)
        made.append(None)
        heap.append((-n, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i = heapq.heappop(heap)
        _, j = heapq.heappop(heap)
        load, order = _merge(loads[i], loads[j])
        loads[i] = loads[j] = None
        loads.append(load)
        made.append((i, j, order))
        heapq.heappush(heap, (-int(load[0] - load[-1]), len(loads) - 1))
    out = np.empty(len(lengths), np.int64)
    todo = [(heap[0][1], np.arange(windows))]
    while todo:  # from the last merge down: which final window each place of a part became
        at, final = todo.pop()
        if made[at] is None:
            out[at] = final[0]
            continue
        i, j, order = made[at]
        place = np.empty(windows, np.int64)
        place[order] = final
        todo += [(i, place), (j, place[::-1])]
    return out


def pack_group(lengths: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """Near-equal windows that all fit: their number rises while one exceeds the capacity."""
    total = sum(lengths)
    windows = max(1, -(-total // capacity))
    while True:
        at = differencing(lengths, windows)
        if np.bincount(at, weights=lengths).max() <= capacity:
            return at
        windows += 1


# ---------------------------------------------------------------- documents to pieces


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: whole windows, then the rest."""
    whole = n // capacity
    out = [(i * capacity, capacity) for i in range(whole)]
    return out + [(at, min(piece, n - at)) for at in range(whole * capacity, n, piece)]


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    piece: int = PIECE,
    tokenizer: str = wordbpe.TOKENIZER,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens) of every piece of every row's whole text."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("b"))
    id_type = src.schema["id"].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table("bytes", wordbpe.tokenizer_path(tokenizer))
        encode, words = table.encoder, table.words

        def missed(word: bytes) -> bytes:
            ids = np.array(encode(word), "<u4").tobytes()
            if len(words) < MAX_WORDS and len(word) <= MAX_WORD_BYTES:
                words[word] = ids
            return ids

        for batch in batches:
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                got = words.get
                ids = b"".join([got(w) or missed(w) for w in (text or b"").split()]) + end
                n = len(ids) // 4
                for start, length in cuts(n, capacity, piece):
                    rows.append(r)
                    starts.append(start)
                    lengths.append(length)
                    sums.append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
                    totals.append(n)
            cols = [batch.column(0).take(pa.array(rows, pa.int64()))]
            cols += [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    schema = f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"
    return src.mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    piece: int = PIECE,
    group: int = GROUP,
    tokenizer: str = wordbpe.TOKENIZER,
) -> DataFrame:
    """One row per piece with its sequence and offset; ``padded_length`` is the sequence's
    length after padding (``capacity``, or its own length if that is a power of two)."""
    cut = pieces(docs, id_col, text_col, capacity, piece, tokenizer)
    t = stage(cut.withColumn("rid", F.monotonically_increasing_id()), "packing-pieces")
    t = t.select("*", F.col("rid").alias("row"))
    whole = t.filter(F.col("length") == capacity).select(
        "id", "start", "length", "ids_crc32", "doc_tokens",
        (2 * F.col("row") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.lit(capacity).cast("long").alias("padded_length"),
    )
    rest = t.filter(F.col("length") < capacity).drop("row")
    groups = max(1, -(-rest.count() // group))
    rest = rest.withColumn("g", F.pmod(F.xxhash64("rid"), F.lit(groups)))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rid", ignore_index=True)
        at = pack_group(rows["length"].tolist(), capacity)
        rows["sequence_id"] = 2 * ((int(rows["g"].iloc[0]) << 20) + at)
        by = rows.groupby("sequence_id")["length"]
        rows["offset"] = by.cumsum() - rows["length"]
        used = by.transform("sum")
        rows["padded_length"] = used.where((used & (used - 1)) == 0, capacity)
        return rows[["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"]]

    packed = rest.groupBy("g").applyInPandas(place, whole.schema)
    return whole.unionByName(packed).withColumnRenamed("id", id_col)
