"""Periodic runs in word sequences by seed-and-extend diagonals (operator 11).

A run of period q and length L >= max(MIN_LENGTH, 2 q) repeats itself at lag q over a stretch of
L - q >= max(MIN_LENGTH - q, q) words, so two equal k-grams lie q words apart, where k is that
guaranteed overlap: 6 for lags below 12, and k for the lags from k to 2 k - 1 above.  For k = 6,
12, 24, ... the k-grams of a document are indexed by a doubled hash; occurrence pairs whose lag
belongs to k are seeds.  Pairs with equal words before them lie on a diagonal that started
further left, so an occurrence is only paired with those after a change of the preceding word.
Seeds are extended to the right in ascending (lag, start); a table of the furthest covered
position per lag suppresses seeds on a stretch already walked.  Extension compares the words
themselves, so a hash collision adds work and never a run.  A stretch whose smallest period is
smaller has the same bounds as the run of that period, which is found first, and is left out.

Without a repeated 6-gram a text has no run.  Each text is one row: nothing is shuffled.

Defined results: a null or empty text has no words and no runs (null run columns, digests of the
empty string); a text of any length is handled whole; equal texts with different ids may differ,
since the id decides the rewriting; repeated rows give repeated results; a null id is never
rewritten; ties of length go to the smaller start, then period; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint._ship import ship_with_tasks

ship_with_tasks(__name__)

MIN_LENGTH = 12
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PAIRS = 1 << 20  # occurrence pairs looked at in one array step

Run = tuple[int, int, int]  # start, length, period


def guaranteed_overlap(min_length: int = MIN_LENGTH) -> int:
    """Fewest words that any run repeats at its period: the shortest seed."""
    return min(max(min_length - q, q) for q in range(1, min_length + 1))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of grams put together from two neighbouring grams."""
    x = left * _MIX + (right ^ (right >> np.uint64(29)))
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def _grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from every position on, by doubling."""
    n = len(codes)
    if k == 1:
        return codes.astype(np.uint64) * _MIX
    half = _grams(codes, k // 2)
    whole = _joined(half[: n - k + 1], half[k // 2 : k // 2 + n - k + 1]) if k % 2 == 0 else None
    if whole is None:
        rest = codes[k - 1 :].astype(np.uint64) * _MIX
        twice = _joined(half[: n - k + 1], half[k // 2 : k // 2 + n - k + 1])
        whole = _joined(twice, rest)
    return whole


def _seeds(codes: np.ndarray, grams: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lag, start) arrays of equal grams at lags low..high-1 that begin a diagonal."""
    order = np.argsort(grams, kind="stable")
    key = grams[order]
    same = key[1:] == key[:-1]
    again = np.concatenate((same, [False])) | np.concatenate(([False], same))
    at = order[again]  # occurrences of repeated grams, by gram, then position
    if not len(at):
        return
    group = np.cumsum(np.concatenate(([True], key[again][1:] != key[again][:-1])))
    before = np.where(at > 0, codes[at - 1], -1)
    # the first later occurrence with another word before it, and the end of the lag window
    change = np.concatenate(((before[1:] != before[:-1]) | (group[1:] != group[:-1]), [True]))
    ends = np.flatnonzero(change)
    first = ends[np.searchsorted(ends, np.arange(len(at)))] + 1
    place = group.astype(np.int64) * (2 * len(codes) + high + 1) + at
    last = np.searchsorted(place, place + high)
    first = np.maximum(first, np.searchsorted(place, place + low))
    n = np.maximum(last - first, 0)
    rows = np.flatnonzero(n)
    step = 0
    while step < len(rows):
        upto = step + max(1, int(np.searchsorted(np.cumsum(n[rows[step:]]), _PAIRS)))
        some = rows[step:upto]
        a = np.repeat(some, n[some])
        b = np.arange(len(a)) - np.repeat(np.cumsum(n[some]) - n[some], n[some]) + np.repeat(first[some], n[some])
        new = before[a] != before[b]
        yield at[b][new] - at[a][new], at[a][new]
        step = upto


def _match_end(codes: np.ndarray, start: int, lag: int) -> int:
    """First position from ``start`` on whose word differs from that ``lag`` later."""
    n, at, step = len(codes) - lag, start, 64
    while at < n:
        upto = min(n, at + step)
        unequal = codes[at:upto] != codes[at + lag : upto + lag]
        stop = int(unequal.argmax())
        if unequal[stop]:
            return at + stop
        at, step = upto, 4 * step
    return n


def find_runs(codes: np.ndarray, min_length: int = MIN_LENGTH) -> list[Run]:
    """All maximal runs of a word sequence given as integers, by start, then period."""
    n, k, found = len(codes), guaranteed_overlap(min_length), {}
    low, grams = 1, None
    while n >= max(min_length, 2 * low):
        high = max(2 * k, min_length) if low == 1 else 2 * k
        grams = _grams(codes, k) if grams is None else _joined(grams[: n - k + 1], grams[k // 2 : k // 2 + n - k + 1])
        covered: dict[int, int] = {}
        seeds = list(_seeds(codes, grams, low, high))
        if not seeds and low == 1 and not _repeats(grams):
            break
        if seeds:
            lags, starts = (np.concatenate(x) for x in zip(*seeds))
            for i in np.lexsort((starts, lags)):
                lag, start = int(lags[i]), int(starts[i])
                if start < covered.get(lag, 0):
                    continue
                covered[lag] = end = _match_end(codes, start, lag)
                if end - start >= max(min_length - lag, lag):
                    found.setdefault((start, end + lag), lag)
        low, k = high, high
    return sorted((start, end - start, lag) for (start, end), lag in found.items())


def _repeats(grams: np.ndarray) -> bool:
    s = np.sort(grams)
    return bool((s[1:] == s[:-1]).any())


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the tail of every tenth document (by checksum of its id) made periodic."""
    n = len(words)
    if not n or doc_id is None or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds beyond its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop)) if not d]


def coded(words: list[bytes]) -> np.ndarray:
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))


def _digest(parts: bytes) -> str:
    return sha256(parts).hexdigest()


def text_runs(doc_id: int | None, text: bytes | None, min_length: int = MIN_LENGTH) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of a text."""
    words = rewritten((text or b"").split(), doc_id)
    runs = find_runs(coded(words), min_length) if len(words) >= min_length else []
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    return (
        len(runs), *best, best[1] and 1000 * best[1] // best[2],
        _digest(listed), _digest(b" ".join(collapsed(words, runs))),
    )


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH
) -> DataFrame:
    """One row per input row: run count, longest run and the digests of all runs and of what is left."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("b"))
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    types = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_runs(i.as_py(), b.as_py(), min_length) for i, b in zip(batch.column(0), batch.column(1))]
            cols = [[r[c] for r in rows] for c in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["id", *names]
            )

    schema = "id long, " + ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in zip(names, types))
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)
