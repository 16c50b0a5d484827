"""URL feature mining: feature bags, support filters, binary matrices and the overlap of two feature lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import urls as U
from textloom.operators.invert import ranked

SUPPORT = 0.05


def feature_rows(pages: DataFrame, key: str = "page_id", url: str = "url", lengths: bool = True) -> DataFrame:
    """key, feature: one row for each feature of each URL; a null URL has none."""
    return pages.where(F.col(url).isNotNull()).select(key, F.explode(U.features(F.col(url), lengths)).alias("feature"))


def feature_counts(pages: DataFrame, support: float = SUPPORT, url: str = "url") -> DataFrame:
    """feature, cnt of the features that at least the share `support` of the URLs has.

    The number of URLs is one row, joined, not collected."""
    total = pages.where(F.col(url).isNotNull()).agg(F.count("*").alias("total"))
    counts = feature_rows(pages.withColumn("_", F.lit(0)), "_", url).groupBy("feature").agg(F.count("*").alias("cnt"))
    return counts.join(F.broadcast(total), F.col("cnt") >= F.col("total") * F.lit(float(support))).select("feature", "cnt")


def binary_matrix(pages: DataFrame, more_than: int, key: str = "page_id", url: str = "url") -> DataFrame:
    """key and present: the ids (by feature name, from 0) of a URL's features that more than `more_than` URLs have; a sparse 0/1 row.

    Feature ids are places in the total order of the supported features; no task sees all of them."""
    rows = feature_rows(pages, key, url, lengths=False)
    kept = rows.groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") > more_than)
    ids = ranked(kept.select("feature"), "feature").select("feature", (F.col("rank") - 1).alias("id"))
    return rows.join(ids, "feature").groupBy(key).agg(F.array_sort(F.collect_list("id")).alias("present"))


def sample(pages: DataFrame, n: int, key: str = "page_id", seed: str = "s") -> DataFrame:
    """n rows without replacement in the order of a hash of the key: the same rows in every run."""
    return pages.orderBy(F.md5(F.concat(F.lit(seed + "-"), F.col(key).cast("string"))), key).limit(n)


def overlap(found: DataFrame, golden: DataFrame) -> DataFrame:
    """share of golden's features that found has, and the ratio of the lists' lengths."""
    g, f = golden.select("feature").distinct(), found.select("feature").distinct()
    both = g.join(f.withColumn("hit", F.lit(1)), "feature", "left").agg(F.count("*").alias("n_golden"), F.count("hit").alias("n_hit"))
    return both.crossJoin(f.agg(F.count("*").alias("n_found"))).select(
        "n_golden", "n_found", "n_hit", F.round(F.col("n_hit") / F.col("n_golden"), 6).alias("share"), F.round(F.col("n_found") / F.col("n_golden"), 6).alias("ratio")
    )
