"""BPE encoding and decoding over a distinct-word table (operator 5).

Texts are cut into blank-delimited words, block by block: a block is a run of rows of one task,
about BLOCK_BYTES of text.  The distinct words of a block, in order of appearance, are dealt by
word hash into the parts of one word table; all copies of a word meet in one part, where it is
encoded once.  The ids return to their block in the same order, so they are joined back by
position with the block's texts, which travel compressed.  For decoding, the distinct ids of a
block are joined with the id-to-piece table (an Arrow join in the task with the tokenizer's
vocabulary, of fixed size), and the pieces of each word are put back beside its ids; pieces are
joined by one space, as the tokenizer's decode does.  ``decode`` does the same for any table of ids
as a broadcast join of Spark's.  Digests are taken where the strings are made, so that neither ids
nor decoded texts leave the task for them.

Skew: a word is sent once per block however often it occurs, so the hottest word is no more than
one entry per block; blocks are bounded by bytes (a longer text is a block of its own).  A
block's name is a hash of its rows: if a recomputed scan ever dealt rows differently, a block
would miss its ids and the task would fail instead of giving wrong ones.

Defined results: a null text counts as an empty one (no ids); repeated rows give repeated
results; texts of any length are encoded whole; an empty table gives an empty result; extra
columns are ignored; special-token strings in a text are the tokenizer's special tokens.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imprint._ship import ship_with_tasks
from imprint.llm import wordbpe
from imprint.llm.common import partitions
from imprint.llm.wordbpe import worker_table

ship_with_tasks(__name__)

BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 1 << 16
PARTS_PER_PARTITION = 2
MAX_KNOWN = 1 << 18  # words whose ids a task of the word table holds at once
TEXTS = -1  # the part that marks a block's texts

Row = tuple[int, int, bytes, bytes | None]
SCHEMA = "block long, part int, data binary, ids binary"


def _rows(rows: list[Row]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    names = ["block", "part", "data", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes]]]:
    """(name, ids as text, texts) of bounded runs of rows."""

    def named(ids: list, texts: list[bytes]) -> tuple[int, list, list[bytes]]:
        h = hashlib.blake2b(digest_size=8)
        for i, t in zip(ids, texts):
            h.update(f"{i} {len(t)} ".encode())
            h.update(t)
        return int.from_bytes(h.digest(), "little", signed=True), ids, texts

    ids: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            t = t or b""
            if ids and (size + len(t) > BLOCK_BYTES or len(ids) == BLOCK_ROWS):
                yield named(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if ids:
        yield named(ids, texts)


def _word_parts(texts: list[bytes], parts: int) -> list[list[bytes]]:
    """The distinct words of a block in order of appearance, by part of the word table."""
    out: list[list[bytes]] = [[] for _ in range(parts)]
    crc = zlib.crc32
    for w in dict.fromkeys(w for t in texts for w in t.split()):
        out[crc(w) % parts].append(w)
    return out


def _pieces_of(tokens: list[np.ndarray], path: str) -> dict[int, str]:
    """Id to piece, by a join of the distinct ids with the id-to-piece table."""
    shared = worker_table("words", path)
    if not hasattr(shared, "piece_table"):
        n = len(shared.pieces)
        shared.piece_table = pa.table({"token": pa.array(range(n), pa.uint32()), "piece": shared.pieces})
    distinct = np.unique(np.concatenate(tokens)) if tokens else np.zeros(0, np.uint32)
    found = pa.table({"token": pa.array(distinct, pa.uint32())}).join(shared.piece_table, "token", join_type="inner", use_threads=False)
    return dict(zip(found.column("token").to_pylist(), found.column("piece").to_pylist()))


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = wordbpe.TOKENIZER,
    digests: bool = False,
) -> DataFrame:
    """(id, n_tokens, ids, decoded) of every row's whole text; ``ids`` in decimal, joined by one
    space, ``decoded`` the pieces of the ids joined by one space.  With ``digests`` both are the
    lowercase hex SHA-256 of that string in UTF-8."""
    parts = partitions(docs) * PARTS_PER_PARTITION
    src = docs.select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").cast("binary").alias("b")
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pressed = zstandard.ZstdCompressor(level=3)
        for block, _, texts in _blocks(batches):
            words = enumerate(_word_parts(texts, parts))
            yield _rows([(block, p, pressed.compress(b" ".join(w)), None) for p, w in words if w])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pressed = zstandard.ZstdCompressor(level=3)
        for block, ids, texts in _blocks(batches):
            sizes = np.array([len(t) for t in texts], "<i8").tobytes()
            data = pressed.compress(sizes + b"".join(texts))
            yield _rows([(block, TEXTS, data, json.dumps(ids).encode())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_table("words", wordbpe.tokenizer_path(tokenizer)).encoder
        pressed, plain = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        known: dict[bytes, list[int]] = {}  # the words of this task's parts
        for batch in batches:
            out: list[Row] = []
            for block, part, data, _ in zip(*(c.to_pylist() for c in batch.columns)):
                found = []
                for w in plain.decompress(data).split(b" "):
                    ids = known.get(w)
                    if ids is None:
                        if len(known) >= MAX_KNOWN:  # encoded again if they come again
                            known.clear()
                        ids = known[w] = encoder(w)
                    found.append(ids)
                counts = np.fromiter(map(len, found), "<u4", len(found))
                flat = np.fromiter((i for ids in found for i in ids), "<u4", int(counts.sum()))
                out.append((block, part, pressed.compress(counts.tobytes() + flat.tobytes()), counts.size.to_bytes(4, "little")))
            yield _rows(out)

    def put_back(rows: pd.DataFrame) -> pd.DataFrame:
        path = wordbpe.tokenizer_path(tokenizer)
        plain = zstandard.ZstdDecompressor()
        answers: dict[int, tuple[int, np.ndarray]] = {}
        for p, d, n in zip(rows["part"], rows["data"], rows["ids"]):
            if p != TEXTS:
                answers[p] = int.from_bytes(n, "little"), np.frombuffer(plain.decompress(bytes(d)), "<u4")
        pieces = _pieces_of([numbers[n:] for n, numbers in answers.values()], path)
        out = []
        for p, data, names in zip(rows["part"], rows["data"], rows["ids"]):
            if p != TEXTS:
                continue
            ids = json.loads(bytes(names))
            raw = plain.decompress(bytes(data))
            ends = np.cumsum(np.frombuffer(raw[: 8 * len(ids)], "<i8")) + 8 * len(ids)
            texts = [raw[a:b] for a, b in zip([8 * len(ids), *ends[:-1].tolist()], ends.tolist())]
            decimal: dict[bytes, str] = {}
            spelled: dict[bytes, str] = {}
            silent = False
            for part, words in enumerate(_word_parts(texts, parts)):
                if not words:
                    continue
                n, numbers = answers[part]
                if n != len(words):
                    raise RuntimeError("a block's words changed between two scans of the input")
                stops = np.cumsum(numbers[:n]).tolist()
                flat = numbers[n:].tolist()
                at = 0
                for w, stop in zip(words, stops):
                    got = flat[at:stop]
                    decimal[w] = " ".join(map(str, got))
                    spelled[w] = " ".join([pieces[i] for i in got])
                    silent |= at == stop
                    at = stop
            for i, t in zip(ids, texts):
                words = t.split()
                if silent:  # words that the tokenizer drops
                    words = [w for w in words if decimal[w]]
                line = " ".join([decimal[w] for w in words])
                n_tokens, again = line.count(" ") + 1 if line else 0, " ".join([spelled[w] for w in words])
                if digests:
                    line, again = (hashlib.sha256(x.encode()).hexdigest() for x in (line, again))
                out.append((i, n_tokens, line, again))
        return pd.DataFrame(out, columns=["id", "n_tokens", "ids", "decoded"])

    words = src.mapInArrow(split, SCHEMA).repartition("part").mapInArrow(number, SCHEMA)
    together = src.mapInArrow(keep, SCHEMA).unionByName(words)
    out = together.groupBy("block").applyInPandas(put_back, "id string, n_tokens long, ids string, decoded string")
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def pieces_table(spark: SparkSession, tokenizer: str = wordbpe.TOKENIZER) -> DataFrame:
    """(token, piece): the id-to-piece table of the tokenizer, special tokens included."""
    pieces = worker_table("words", wordbpe.tokenizer_path(tokenizer)).pieces
    return spark.createDataFrame(list(enumerate(pieces)), "token int, piece string")


def decode(encoded: DataFrame, pieces: DataFrame, id_col: str, ids_col: str) -> DataFrame:
    """(id, decoded) of rows with an array of token ids and a unique id, by an id-to-piece join."""
    rows = encoded.select(F.col(id_col).alias("id"), F.posexplode_outer(ids_col).alias("pos", "token"))
    found = rows.join(F.broadcast(pieces), "token", "left")
    part = F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "piece"))))
    out = found.groupBy("id").agg(F.array_join(F.transform(part, lambda x: x["piece"]), " ").alias("decoded"))
    return out.withColumnRenamed("id", id_col)
