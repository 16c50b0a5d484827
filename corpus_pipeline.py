"""The corpus pipeline: quality classifier, exact dedup, near-duplicate join, source mixing, BPE.

run() writes each stage's result as Parquet to the shared folder and gives it to the next. All but the last stage return the columns of
documents. The quality weights of the mixing stage are the labels', and for documents without one the mean of their source, as in its query; its targets are the module's.

Defined cases: an empty table gives no rows in any stage; a null or empty text, or one without a word, goes in the first stage; texts of any length go through whole;
a row with a null doc_id is kept by both deduplications and never taken into the mixture; rows repeated with one doc_id are one document to
both, all of them stay, and each is mixed by itself; of equal or similar documents (ties) the smallest doc_id stays; further columns, whatever
their names, are carried up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, exact, mixing, near, quality
from textloom.llm.common import cut, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF keeps; the rejected ones go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal bytes the one with the smallest doc_id stays."""
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest doc_id stays."""
    return near.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture; a document taken for several epochs has as many rows."""
    return mixing.mixed(docs, mixing.label_weights(table(spark, sf_dir, "labels")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the proof that they decode to its text."""
    return bpe.encoded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: The classifier and BPE can't be expressed in SQL; tests/llm holds run() against a brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
