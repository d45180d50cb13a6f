"""Quality rules by repetition coverage (operator 7).

Words are runs of non-blank characters (blank: space and U+0009 to U+000D).  For each text a
rolling polynomial hash over word hashes gives every n-gram of lengths 5 to 10 in NumPy; the
characters inside n-grams that repeat an earlier one are measured against all word characters,
and repeated lines against all lines.  The base rule counts the words inside 5-grams that occur
twice or more, the first occurrence included.  A text without a repeated
5-gram has no longer one either, so the longer lengths run only where they can matter.

Defined results: a null or empty text has no words and fails the base rules; a text of one
giant line or word is handled whole; repeated rows give repeated results; extra columns of the
input are passed by ``quality_filter`` and ignored by ``repetition_metrics``; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint._ship import ship_with_tasks

ship_with_tasks(__name__)

NGRAMS = (5, 6, 7, 8, 9, 10)
#: Largest share of word characters inside n-grams of each length that repeat an earlier one.
MAX_NGRAM_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of lines, and of line characters, that repeat an earlier line.
MAX_DUP_LINES = 0.30
MAX_DUP_LINE_CHARS = 0.20
#: Most symbols per word.
MAX_SYMBOLS_PER_WORD = 0.10
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

_BLANKS = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_BASE = np.uint64(0x9E3779B97F4A7C15)

METRICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, line_chars long, dup_line_chars long, "
    + ", ".join(f"dup_chars_{n} long" for n in NGRAMS)
)


def code_points(b: bytes) -> int:
    """Characters of a UTF-8 string: the bytes that do not continue one."""
    return len(b) - int(np.count_nonzero((np.frombuffer(b, np.uint8) & 0xC0) == 0x80))


def _inside(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    edge = np.zeros(words + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def covered(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Which words lie in an n-gram found twice or more, and which in one that repeats an earlier
    one; None if no n-gram repeats."""
    m = len(hashes) - n + 1
    if m < 2:
        return None
    gram = hashes[:m].copy()
    for j in range(1, n):
        gram *= _BASE
        gram += hashes[j : j + m]
    order = np.argsort(gram, kind="stable")
    same = gram[order[1:]] == gram[order[:-1]]
    if not same.any():
        return None
    later, every = order[1:][same], np.concatenate((order[1:][same], order[:-1][same]))
    return _inside(every, n, len(hashes)), _inside(later, n, len(hashes))


def text_metrics(text: bytes | None) -> tuple:
    """The counts of METRICS for one whole text given in UTF-8."""
    b = text or b""
    words = b.split()
    n = len(words)
    blanks = len(b) - len(b.translate(None, _BLANKS))
    symbols = len(b) - len(b.translate(None, _SYMBOLS))
    lines = [x for x in b.split(b"\n") if x.strip()]
    seen: set[bytes] = set()
    dup_lines = dup_line_chars = 0
    if len(set(lines)) < len(lines):
        for x in lines:
            if x in seen:
                dup_lines += 1
                dup_line_chars += code_points(x)
            seen.add(x)
    line_chars = sum(map(code_points, lines)) if dup_lines else 0
    repeat = 0
    chars = dict.fromkeys(NGRAMS, 0)
    if n > NGRAMS[0]:
        hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        lens = None
        for k in NGRAMS:
            masks = covered(hashes, k)
            if masks is None:
                break
            if lens is None:
                lens = np.fromiter((len(w) if w.isascii() else code_points(w) for w in words), np.int64, n)
                repeat = int(masks[0].sum())
            chars[k] = int(lens[masks[1]].sum())
    return (
        n, code_points(b) - blanks, symbols, dup_lines, repeat,
        len(lines), line_chars, dup_line_chars, *chars.values(),
    )


def _measure(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_metrics(b) for b in batch.column(1).to_pylist()]
        cols = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * (len(schema) - 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], schema=schema)


def repetition_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and the counts of METRICS, over the whole text."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("b"))
    id_type = src.schema["id"].dataType.simpleString()
    names = [c.split()[0] for c in METRICS.split(", ")]
    id_arrow = pa.string() if id_type == "string" else pa.int32() if id_type == "int" else pa.int64()
    schema = pa.schema([("id", id_arrow), *((n, pa.int64()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _measure(schema, batches)

    return src.mapInArrow(run, f"id {id_type}, {METRICS}").withColumnRenamed("id", id_col)


def judged(metrics: DataFrame) -> DataFrame:
    """Add ``base_failed`` and ``kept``: the base rules, then coverage, line and symbol rules."""
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    fine = F.col("n_symbols") <= MAX_SYMBOLS_PER_WORD * F.col("n_words")
    fine &= F.col("n_dup_lines") <= MAX_DUP_LINES * F.col("n_lines")
    fine &= F.col("dup_line_chars") <= MAX_DUP_LINE_CHARS * F.greatest("line_chars", F.lit(1))
    for n, share in MAX_NGRAM_SHARE.items():
        fine &= F.col(f"dup_chars_{n}") <= share * F.col("word_chars")
    return metrics.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & fine)


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all their columns unchanged.

    The counts are computed beside each row, in the same Arrow batch, so nothing is joined or
    shuffled and repeated or null ids cannot mix rows up.  The input travels as one struct, so
    its columns may have any names.
    """
    names = [c.split()[0] for c in METRICS.split(", ")]

    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_metrics(b) for b in texts], columns=names, dtype="int64")

    counts = F.pandas_udf(measure, METRICS).asNondeterministic()
    row = docs.select(F.struct(*docs.columns).alias("_row"))
    row = row.withColumn("_m", counts(F.col("_row")[text_col].cast("string").cast("binary")))
    return judged(row.select("_row", "_m.*")).filter("kept").select("_row.*")
