"""Registered queries of the operators: (spark, sf_dir) -> DataFrame, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imprint.llm import (
    distinct_bpe,
    filter_audit,
    fixtures,
    html_text,
    jaccard_join,
    knn_quality,
    langid,
    packing,
    repetition,
    revisits,
    runs,
    sharding,
    simhash,
    sql,
    topk,
)
from imprint.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit record with its outcome, response and merged headers."""
    out = revisits.resolve_revisits(fixtures.archive_records(spark, sf_dir))
    out = out.withColumn("captured", F.date_format("captured", "yyyy-MM-dd HH:mm:ss"))
    return out.withColumn("headers", revisits.header_lines(F.col("headers")))


def op2_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by its nearest labelled documents."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = knn_quality.fit(docs, labels, knn_quality.learn_from())
    out = knn_quality.score(docs, model)
    return out.select("doc_id", (~knn_quality.learn_from()).alias("held_out"), "score", "predicted")


def op3_flat_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op5_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and the decoded text of every document."""
    out = distinct_bpe.encode(read_table(spark, sf_dir, "documents"), digests=True)
    return out.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by compression, learned from the training rows only."""
    docs = read_table(spark, sf_dir, "documents")
    dictionaries = langid.train_dictionaries(docs, langid.learn_from())
    out = langid.predict(docs, dictionaries)
    return out.select("doc_id", (~langid.learn_from()).alias("held_out"), "lang_pred", "score", "accepted")


def op7_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition counts and verdict of every document."""
    return repetition.judged(repetition.repetition_metrics(read_table(spark, sf_dir, "documents")))


def op8_branch_and_bound_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every 50th vector."""
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op9_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and offset."""
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op10_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the row law."""
    out = sharding.assign_shards(read_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, and the digest of its words without their repetitions."""
    return runs.periodic_runs(read_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in each of their 120 orders, for every source."""
    return filter_audit.filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document linked at a Jaccard similarity of 0.8."""
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline from documents to packed sequences."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def registry() -> dict[str, Query]:
    named = (
        op1_revisit_resolution,
        op2_neighbour_quality,
        op3_flat_block_text,
        op4_simhash_near_dedup,
        op5_distinct_word_bpe,
        op6_language_id,
        op7_repetition_rules,
        op8_branch_and_bound_topk,
        op9_differencing_packing,
        op10_label_propagation_shards,
        op11_periodic_runs,
        op12_filter_audit,
        op13_jaccard_join,
        pipeline,
    )
    return {q.__name__: q for q in named}


def oracle_queries() -> dict[str, str]:
    return {
        "op1_revisit_resolution": sql.OP1,
        "op7_repetition_rules": sql.OP7,
        "op8_branch_and_bound_topk": sql.OP8,
        "op12_filter_audit": sql.OP12,
    }
