"""Quality classifier by nearest-neighbour voting over latent-semantic vectors (operator 2).

A text becomes hashed counts of its words and of its words' shapes (case, digits, marks), damped
by log and weighted by inverse document frequency over all documents, and the counts of words
that equal or differ from the one 1 to LAGS places before.  The three blocks weigh alike, and
are projected to RANK latent dimensions by a truncated SVD.  Every document's cosine with every labelled vector is
computed exactly, block by block, and its NEIGHBOURS nearest vote with their similarity.

The fit is bounded: at most SAMPLE_PER_LABEL labelled rows of each label (those of smallest id
hash) give the SVD and the labelled vectors, which go to every task (SAMPLE_PER_LABEL * 2 * RANK
numbers; the weights and projection are DIMS * RANK).  Votes are weighted by the share of their
label in all training rows, so the even sample doesn't move the score.

Defined results: null, empty and blank texts have no neighbours and score the training rows' share
of label 1; so do all texts if no row is labelled (0.5 then) and texts unlike every labelled one;
ties in similarity at the last neighbour are cut in a fixed way; the smallest label counts where an id is
labelled twice; whole texts of any length count; repeated rows give repeated results; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import dataclasses
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imprint._ship import ship_with_tasks

ship_with_tasks(__name__)

WORD_DIMS = 3072
SHAPE_DIMS = 1024
LAGS = 4
HASHED = WORD_DIMS + SHAPE_DIMS
DIMS = HASHED + 2 * LAGS
RANK = 64
SAMPLE_PER_LABEL = 2000
NEIGHBOURS = 25
SHARPNESS = 8  # power of the similarity in a vote
BLOCK = 512
STEPS = 1 << 24  # vectors are rounded to multiples of its inverse before they are multiplied
GRID = 1 << 20  # similarities are rounded to multiples of its inverse
MAX_WORDS = 300_000  # entries of a task's word table

_SHAPES = bytes(
    ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("9") if 48 <= c <= 57 else c
    for c in range(256)
)
_RUNS = re.compile(rb"(.)\1+")
_EDGES = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def learn_from(id_col: str = "doc_id") -> Column:
    """The rows whose labels the registered query may learn from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


class Counter:
    """Hashed counts of a text; keeps the buckets of the words it has met."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def _buckets(self, word: bytes) -> int:
        stem = word.lower().strip(_EDGES)
        shape = _RUNS.sub(rb"\1", word.translate(_SHAPES))
        found = (zlib.crc32(stem) % WORD_DIMS) * SHAPE_DIMS + zlib.crc32(shape) % SHAPE_DIMS
        if len(self.known) < MAX_WORDS and len(word) <= 64:
            self.known[word] = found
        return found

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, counts) of the whole text."""
        words = (text or b"").split()
        got, miss = self.known.get, self._buckets
        both = np.array([got(w, -1) for w in words], np.int64)
        for i in np.flatnonzero(both < 0).tolist():
            both[i] = miss(words[i])
        counts = np.bincount(both // SHAPE_DIMS, minlength=DIMS) + np.bincount(
            WORD_DIMS + both % SHAPE_DIMS, minlength=DIMS
        )
        for lag in range(1, LAGS + 1):
            same = int(np.count_nonzero(both[lag:] == both[:-lag]))
            counts[HASHED + 2 * lag - 2 : HASHED + 2 * lag] = same, max(0, len(both) - lag) - same
        at = np.flatnonzero(counts)
        return at, counts[at]


@dataclasses.dataclass
class Model:
    weights: np.ndarray  # inverse document frequencies
    projection: np.ndarray  # DIMS x RANK
    vectors: np.ndarray  # labelled vectors of length one
    votes: np.ndarray  # weight of each labelled row's vote
    labels: np.ndarray
    prior: float

    def latent(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return _unit(_steps(_dense(texts, self.weights)) @ _steps(self.projection))

    def score(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The vote of each text's nearest labelled vectors."""
        if not len(self.vectors):
            return np.full(len(texts), self.prior)
        alike = _steps(self.latent(texts)) @ _steps(self.vectors).T
        grid = np.rint(alike * (GRID / STEPS**2)).astype(np.int64)
        m = alike.shape[1]
        k = min(NEIGHBOURS, m)
        key = grid * m - np.arange(m)  # ties go to the labelled row that comes first
        near = np.sort(np.argpartition(-key, k - 1, axis=1)[:, :k], axis=1)
        vote = (np.maximum(np.take_along_axis(grid, near, 1), 0) / GRID) ** SHARPNESS * self.votes[near]
        total = vote.sum(axis=1)
        ones = (vote * self.labels[near]).sum(axis=1)
        return np.where(total > 0, ones / np.where(total > 0, total, 1), self.prior).clip(0, 1)


def _dense(texts: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    x = np.zeros((len(texts), DIMS), np.float32)
    for row, (at, counts) in zip(x, texts):
        row[at] = np.where(at < HASHED, np.log1p(counts) * weights[at], counts)
    for a, b in ((0, WORD_DIMS), (WORD_DIMS, HASHED), (HASHED, DIMS)):
        x[:, a:b] = _unit(x[:, a:b])
    return x


def _steps(x: np.ndarray) -> np.ndarray:
    """Whole numbers of 1 / STEPS.  Products of such vectors, no longer than 2 each, are exact in doubles in
    any order, so a row scores the same at any place of any block."""
    return np.rint(x * STEPS).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, and documents with a word, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter()
        held = np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                at, _ = count(text)
                held[at] += 1
                held[DIMS] += len(at) > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(held)], names=["bucket", "n"])

    parts = docs.select(F.col(text_col).cast("string").cast("binary").alias("b")).mapInArrow(run, "bucket long, n long")
    held = np.zeros(DIMS + 1, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        held[r["bucket"]] = r["n"]
    return held[:DIMS], int(held[DIMS])


def _svd(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors (seeded subspace iteration)."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(7).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank].astype(np.float32)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    where: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_label: int = SAMPLE_PER_LABEL,
) -> Model:
    """A model from the rows of ``labels`` (id, label 0 or 1) that ``where`` holds."""
    held, n = document_frequencies(docs, text_col)
    weights = np.log((1 + n) / (1 + held)) + 0.1
    marked = labels.filter(where).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    marked = marked.filter("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
    share = F.coalesce(*(F.when(F.col("y") == y, F.lit(min(1.0, 2 * per_label / m))) for y, m in sizes.items()), F.lit(0.0))
    h = F.xxhash64(F.col("id").cast("string"), F.lit("quality"))
    near = marked.withColumn("h", h).filter(F.pmod("h", F.lit(1 << 48)) < share * (1 << 48))
    cut = [near.filter(F.col("y") == y).orderBy("h", "id").limit(per_label).select("id", "y") for y in (0, 1)]
    picked = cut[0].unionByName(cut[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter()
        for batch in batches:
            found = [count(t) for t in batch.column(2).to_pylist()]
            cols = [pa.array([f[j].tolist() for f in found], pa.list_(pa.int64())) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *cols], names=["key", "y", "at", "counts"])

    # the sample is bounded by per_label, so it may be sent to every task
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("b"))
    sample = texts.join(F.broadcast(picked), "id").select(F.col("id").cast("string").alias("key"), "y", "b")
    rows = sample.mapInArrow(run, "key string, y int, at array<long>, counts array<long>")
    # one row per id, so a repeated id does not add to what is collected
    rows = rows.groupBy("key").agg(F.max(F.struct("at", "counts", "y")).alias("r")).select("key", "r.*")
    rows = sorted(rows.collect(), key=lambda r: r["key"])
    rows = [r for r in rows if r["at"]]
    if not rows:
        return Model(weights, np.zeros((DIMS, 0), np.float32), np.zeros((0, 0)), np.zeros(0), np.zeros(0), prior)
    x = _dense([(np.array(r["at"]), np.array(r["counts"])) for r in rows], weights)
    projection = _svd(x, RANK)
    y = np.array([r["y"] for r in rows])
    shares = np.array([1 - prior, prior])
    votes = (shares / np.maximum(np.bincount(y, minlength=2), 1))[y]
    return Model(weights, projection, _unit(x @ projection), votes, y, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row's whole text."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("b"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(at, BLOCK)
                found = model.score([count(t) for t in rows.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.float64())], names=["id", "score"])

    out = src.mapInArrow(run, f"id {id_type}, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumnRenamed("id", id_col)
