"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

Null texts count as empty in every stage; null ids, sources and languages are fine, and so are empty tables
and further columns. Texts are always read whole, however long they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from viewloom.llm import exact_dedup, packing, quality_crf, secret_scan, simhash
from viewloom.llm.common import table
from viewloom.llm.vocabulary import Vocabulary
from viewloom.llm.workload import LEAST_QUALITY, quality_model
from viewloom.operators.staging import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below 0.7 go; a null or empty text is scored as one empty line.

    Repeated rows get the same score, so they go or stay together."""
    return quality_crf.accepted(docs, quality_model(spark, sf_dir), LEAST_QUALITY)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays; null and empty texts are equal to each other.

    A null id stays only where no copy has one; of rows repeated as a whole one stays."""
    return exact_dedup.survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; texts without a word are alike.

    A group without any id keeps one row."""
    return simhash.representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark, and n_chars set anew; no document goes, and null texts stay null."""
    return secret_scan.redacted(docs, Vocabulary())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of the permitted lengths; a null or empty text is its end alone.

    Repeated rows are packed as often as they come."""
    return packing.pack(stored(packing.token_lengths(docs, Vocabulary())))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact", exact),
    ("near", near),
    ("secrets", secrets),
    ("packing", packed),
]

#: SQL cannot express the classifier, the fingerprints or best fit; see tests/llm/test_pipeline.py.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result stored in the session's shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
