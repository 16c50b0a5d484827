"""Made-up inputs of any size: numbers, documents of random words, and URLs; the same rows for the same seed, whatever the number of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def drawn(seed: int, n: int, *at: Column) -> Column:
    """A number below n from a hash of the places."""
    return F.pmod(F.xxhash64(F.lit(seed), *at), F.lit(n))


def integers(spark: SparkSession, rows: int, below: int = 1 << 31, seed: int = 1) -> DataFrame:
    """id, v."""
    return spark.range(rows).select("id", drawn(seed, below, F.col("id")).alias("v"))


def forward_documents(spark: SparkSession, rows: int = 100, words: int = 1000, most: int = 50, seed: int = 1) -> DataFrame:
    """doc, words: up to `most` distinct words below `words` a document."""
    n = drawn(seed, most, F.col("id"), F.lit(-1)) + 1
    return spark.range(1, rows + 1).select(F.col("id").alias("doc"), F.array_distinct(F.transform(F.sequence(F.lit(1).cast("bigint"), n), lambda k: drawn(seed, words, F.col("id"), k))).alias("words"))


def urls(spark: SparkSession, rows: int, hosts: int = 20, seed: int = 1) -> DataFrame:
    """page_id, url with 1 to 4 segments and, of every third, a query."""
    part = lambda k: F.concat(F.element_at(F.lit(["news", "item", "user", "tag", "archive"]), (drawn(seed, 5, F.col("id"), k) + 1).cast("int")), drawn(seed + 1, 50, F.col("id"), k).cast("string"))
    path = F.array_join(F.transform(F.sequence(F.lit(1).cast("bigint"), drawn(seed + 2, 4, F.col("id")) + 1), part), "/")
    query = F.when(F.col("id") % 3 == 0, F.concat(F.lit("?page="), drawn(seed + 3, 10, F.col("id")).cast("string"))).otherwise("")
    return spark.range(rows).select(F.col("id").alias("page_id"), F.concat(F.lit("http://host"), drawn(seed + 4, hosts, F.col("id")).cast("string"), F.lit(".org/"), path, query).alias("url"))
