"""URL segmentation and crawl quotas: clusters of URLs, a quota for each by its share, ordered admission, and its F1."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import CountVectorizer, UnivariateFeatureSelector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import urls as U

QUOTA = 10_000


def cluster_quota(sample: DataFrame, quota: float, cluster: str = "cluster") -> DataFrame:
    """cluster, n, quota: the quota divided by the clusters' shares of the sample."""
    n = sample.groupBy(cluster).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("all"))), F.lit(True)).select(cluster, "n", (F.col("n") / F.col("all") * quota).alias("quota"))


def admit(stream: DataFrame, quotas: DataFrame, cap: int = QUOTA, cluster: str = "cluster", order: str = "arrival", block: int = 1 << 16) -> DataFrame:
    """Rows of stream with accepted: within a cluster the first ceil(quota) by arrival, and of those the first `cap` of all.

    Neither rank is one window over everything, nor over a cluster, which may hold most rows: ranks inside blocks of arrival
    numbers are added to the running totals of a cluster's blocks, and of all blocks, which are few."""
    joined = stream.withColumn("_b", F.expr(f"{order} div {block}")).join(quotas.select(cluster, "quota"), cluster, "left")
    size = joined.groupBy(cluster, "_b").agg(F.count("*").alias("_n"))
    size = size.select(F.col(cluster).alias("_c"), F.col("_b").alias("_cb"), (F.sum("_n").over(W.partitionBy(cluster).orderBy("_b")) - F.col("_n")).alias("_of"))
    counted = joined.join(size, F.col(cluster).eqNullSafe(F.col("_c")) & (F.col("_b") == F.col("_cb")))
    place = F.col("_of") + F.row_number().over(W.partitionBy(cluster, "_b").orderBy(order))
    ranked = counted.withColumn("within", F.coalesce(place <= F.ceil(F.col("quota")), F.lit(False)))
    before = ranked.groupBy("_b").agg(F.count_if("within").alias("_n"))
    before = before.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_before"))
    inside = F.count_if("within").over(W.partitionBy("_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    accepted = ranked.join(before, "_b").withColumn("accepted", F.col("within") & (F.col("_before") + inside <= cap))
    return accepted.select(*stream.columns, "accepted")


def crawl_f1(admitted: DataFrame, wanted: str = "wanted") -> DataFrame:
    """fetched, the accepted share of what is wanted (recall), the wanted share of what is accepted (precision), and f1."""
    n = admitted.agg(F.count_if("accepted").alias("fetched"), F.count_if(F.col(wanted)).alias("wanted"), F.count_if(F.col("accepted") & F.col(wanted)).alias("hit"))
    p, r = F.coalesce(F.try_divide("hit", "fetched"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "wanted"), F.lit(0.0))
    return n.select("fetched", "wanted", "hit", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def segmenter(clusters: int, more_than: int = 8, seed: int = 1) -> Pipeline:
    """Binary features with support, then bisecting k-means: stands in for BIRCH, which Spark lacks."""
    return Pipeline(stages=[
        CountVectorizer(inputCol="features_of_url", outputCol="features", binary=True, minDF=float(more_than + 1)),
        BisectingKMeans(k=clusters, seed=seed, featuresCol="features", predictionCol="first_cluster"),
    ])


def best_features(k: int = 30, label: str = "first_cluster") -> UnivariateFeatureSelector:
    """The k features whose means differ most between classes, by the F test."""
    return UnivariateFeatureSelector(featuresCol="features", outputCol="best", labelCol=label, selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k)


def url_clusters(pages: DataFrame, clusters: int = 8, url: str = "url", model: PipelineModel | None = None, k: int = 30, seed: int = 1) -> DataFrame:
    """pages with cluster, from a model fitted on them unless one is given; pages with a null URL are left out.

    The URLs are clustered on all their features, the k features that tell these clusters apart best are selected, and the URLs are clustered again on those."""
    rows = pages.where(F.col(url).isNotNull()).withColumn("features_of_url", U.features(F.col(url), lengths=False))
    if model is None:
        first = segmenter(clusters).fit(rows)
        told = first.transform(rows)
        again = Pipeline(stages=[best_features(k), BisectingKMeans(k=clusters, seed=seed, featuresCol="best", predictionCol="cluster")]).fit(told)
        model = PipelineModel([*first.stages, *again.stages])
    return model.transform(rows).select(*pages.columns, "cluster")


def segment_key(url: Column) -> Column:
    """A cluster key made of the URL alone: host's first label, number of segments, and whether it has a query."""
    return F.concat_ws("|", F.substring_index(U.host(url), ".", 1), F.size(U.segments(U.decoded(url))).cast("string"), (U.query(url) != "").cast("string"))
