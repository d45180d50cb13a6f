"""The corpus pipeline: four stages over ``documents``, each one of the operators in llm/.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return the
columns of documents; the last returns the packed pieces.  ``run`` writes each stage's result to
the shared checkpoint folder and gives it to the next.

Defined results, for every stage: an empty table gives an empty result with the stage's columns;
extra columns, whatever their names, travel with their rows (the last stage leaves them out);
texts of any length are read whole.  The rest is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from imprint.llm.common import stage
from imprint.llm.langid import language_filter
from imprint.llm.packing import pack
from imprint.llm.repetition import quality_filter
from imprint.llm.simhash import one_per_group
from imprint.session import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the quality rules reject go.

    Null, empty and short texts (under ten words) are rejected; repeated rows, null and repeated
    ids are judged row by row, so all copies of a row stay or go.
    """
    return quality_filter(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents without a clear language go.

    Null, empty and letterless texts go, and so do ties and narrow margins between two languages; a
    null ``lang`` is not learned from and its row is judged by its text; rows of repeated and null
    ids are judged one by one (one row of an id is learned from, of a null id none).  Without any
    row to learn from no text has a language, and all go.
    """
    return language_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each SimHash group stays, that of the smallest id.

    Null and empty texts have one fingerprint and are one group; of repeated rows, of rows that
    share an id, and of groups with null ids only, one row of each group stays.
    """
    return one_per_group(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the remaining documents as pieces of packed sequences.

    A null or empty text is its end id alone; repeated rows, repeated and null ids are packed row by
    row; equal lengths go in the order of their rows.
    """
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

#: Compression, fingerprints and tokenization have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
