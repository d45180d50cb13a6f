"""Language identification by compression (operator 6).

Every language's training text becomes a raw-content zstandard dictionary.  A text is put in
lower case, ASCII other than letters becomes blank, and it is cut into blocks of BLOCK bytes; each
block is compressed with every dictionary, and the language with the smallest total wins.  The
score is the saving over the runner-up; narrow margins are rejected.

The dictionaries are fitted on a bounded sample: SAMPLE_DOCS ids per language (those of smallest id
hash, one row each), and of each text a window of at most WINDOW bytes, placed by the hash anywhere
in the whole text.  All windows fit into DICT_BYTES, so a dictionary holds one of every sampled row
(up to 200 rows of a language).  Only these bytes reach the driver, at most TOTAL_BYTES for all
languages; more than MAX_LANGS languages raise an error.  Prediction reads every whole text.

Defined results: null, empty and letterless texts are ``und`` with score 0; equal sizes go to
the language with more training rows (then the first by name) with score 0; a text far longer than a block is scored
over all its blocks; rows without a language are predicted, never learned from; with no training
rows at all every text is ``und``; repeated rows give repeated results; an empty table gives an
empty result; extra columns are ignored, or kept by ``language_filter``.
"""

from __future__ import annotations

from collections.abc import Iterator  # noqa: F401 (also read by pandas_udf)

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imprint._ship import ship_with_tasks

ship_with_tasks(__name__)

UND = "und"
LEVEL = 5
MIN_MATCH = 3
BLOCK = 32 * 1024
DICT_BYTES = 160 * 1024
SAMPLE_DOCS = 200
WINDOW = 800
OVERSAMPLE = 4
MAX_LANGS = 200
TOTAL_BYTES = 16 << 20
#: Least saving of the winner over the runner-up; below it a text is rejected.
MIN_MARGIN = 0.004


def learn_from(id_col: str = "doc_id") -> Column:
    """The training rows of the registered query and of the pipeline."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def train_dictionaries(
    docs: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> dict[str, bytes]:
    """Language -> dictionary bytes, from the rows ``where`` holds with a language and a text.

    The sample is even over the ids: a first aggregate counts the rows of each language, and a
    threshold on the id hash admits about OVERSAMPLE * SAMPLE_DOCS of them, whatever their number;
    the SAMPLE_DOCS smallest hashes of each language are kept, with one window each, before anything
    is collected.
    """
    rows = docs.select(
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.col(id_col).cast("string"), F.lit("langid")).alias("h"),
        where.alias("use"),
    ).filter("use and lang is not null")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("ids"))
    sizes = {r["lang"]: (r["n"], r["ids"]) for r in counts.limit(MAX_LANGS + 1).collect()}
    if not sizes:
        return {}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages to learn")
    shares = [(lang, min(1.0, OVERSAMPLE * SAMPLE_DOCS / max(ids, 1))) for lang, (_, ids) in sizes.items()]
    shares = docs.sparkSession.createDataFrame(shares, "lang string, share double")
    near = rows.join(F.broadcast(shares), "lang").filter(F.pmod("h", F.lit(1 << 48)) < F.col("share") * (1 << 48))
    b = F.encode(F.trim("text"), "UTF-8")
    start = F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.length(b) - F.lit(WINDOW - 1))).cast("int")
    near = near.select("lang", "h", F.substring(b, start + 1, F.lit(WINDOW)).alias("b")).filter(F.length("b") > 0)
    near = near.groupBy("lang", "h").agg(F.min("b").alias("b"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    near = near.withColumn("place", first).filter(F.col("place") <= SAMPLE_DOCS)
    sample: dict[str, list] = {}
    for row in sorted(near.collect(), key=lambda x: (x["lang"], x["h"])):
        sample.setdefault(row["lang"], []).append(plain(bytes(row["b"]).decode("utf-8", "ignore")))
    order = sorted(sample, key=lambda lang: (-sizes[lang][0], lang))
    most = min(DICT_BYTES, TOTAL_BYTES // len(order)) if order else 0
    # the smallest hashes last, nearest to what is compressed
    return {lang: b"\n".join(sample[lang][::-1])[-most:] + b"\n" for lang in order}


_PLAIN = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain(text: str) -> bytes:
    """Lower case, with a blank for every ASCII character that is no letter."""
    return text.lower().encode().translate(_PLAIN)


class Classifier:
    """Compressors of one task; built from the dictionaries once per worker task."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = list(dictionaries)  # more training rows first
        self.compressors = []
        how = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=BLOCK, dict_size=DICT_BYTES, min_match=MIN_MATCH, write_content_size=False
        )
        for content in dictionaries.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UND, 0.0
        b = plain(text)
        blocks = [b[i : i + BLOCK] for i in range(0, len(b), BLOCK)]
        sizes = [sum(len(c.compress(x)) for x in blocks) for c in self.compressors]
        best = min(sizes)
        at = sizes.index(best)
        second = min(sizes[:at] + sizes[at + 1 :], default=len(b) + 1)
        return self.langs[at], max(0.0, min(1.0, 1 - best / max(second, 1)))


def predict(
    docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, lang_pred, score, accepted) per row; ``accepted`` is false for ``und`` and narrow margins."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(dictionaries)
        for batch in batches:
            found = [classify(t) for t in batch.column(1).to_pylist()]
            lang = pa.array([x[0] for x in found], pa.string())
            score = pa.array([x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), lang, score], names=["id", "lang_pred", "score"])

    out = src.mapInArrow(run, f"id {id_type}, lang_pred string, score double")
    accepted = (F.col("lang_pred") != UND) & (F.col("score") >= MIN_MARGIN)
    return out.withColumn("accepted", accepted).withColumnRenamed("id", id_col)


def language_filter(
    docs: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The rows whose language is recognised, all their columns unchanged."""
    dictionaries = train_dictionaries(docs, learn_from(id_col) if where is None else where, id_col, text_col, lang_col)

    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        classify = Classifier(dictionaries)
        for texts in batches:
            found = [classify(t) for t in texts]
            yield pd.Series([lang != UND and score >= MIN_MARGIN for lang, score in found], dtype=bool)

    accept = F.pandas_udf(decide, "boolean").asNondeterministic()
    row = docs.select(F.struct(*docs.columns).alias("_row"))
    row = row.withColumn("_ok", accept(F.col("_row")[text_col].cast("string")))
    return row.filter("_ok").select("_row.*")
