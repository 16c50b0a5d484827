"""Queries on inversion, order, statistics, trees and networks."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import boost, invert, neural, stats, trees
from textloom.plans.registry import query
from textloom.storage import table


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def _joined(df: DataFrame, c: str):
    return df.withColumn(c, F.array_join(F.transform(c, lambda x: x.cast("string")), " "))


@query("SELECT l_partkey AS word, l_orderkey // 1048576 AS block, array_to_string(list(DISTINCT l_orderkey ORDER BY l_orderkey), ' ') AS docs FROM lineitem GROUP BY 1, 2")
def invert_words_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(invert.inverted(_lineitem(spark, sf_dir), "l_orderkey", "l_partkey", "word", "docs"), "docs")


@query("SELECT l_orderkey AS doc, l_partkey // 1048576 AS block, array_to_string(list(DISTINCT l_partkey ORDER BY l_partkey), ' ') AS words FROM lineitem GROUP BY 1, 2")
def reinvert(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = invert.inverted(_lineitem(spark, sf_dir), "l_orderkey", "l_partkey", "word", "docs")
    return _joined(invert.reinverted(lists, "word", "docs", "doc", "words"), "words")


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_partkey, l_orderkey, l_linenumber) AS rank FROM lineitem")
def sort_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invert.ranked(_lineitem(spark, sf_dir).select("l_partkey", "l_orderkey", "l_linenumber"), "l_partkey", "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invert.top(_lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_extendedprice"), 100, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")


@query("""WITH r AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM r) SELECT user_id, min(event_id) AS first, min(event_type) AS event_type, count(*) AS length FROM i GROUP BY user_id, run""")
def run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invert.runs(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 49)
SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'bag', (SELECT count(*) FROM a) + (SELECT count(*) FROM b)""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lineitem(spark, sf_dir)
    a, b = (li.where(c).select(F.col("l_partkey").alias("k")).distinct() for c in ("l_returnflag = 'R'", "l_quantity > 49"))
    sets = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "bag": a.unionAll(b)}
    out = None
    for name, s in sets.items():
        one = s.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionAll(one)
    return out


COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for k, a in enumerate(COLUMNS) for b in COLUMNS[k + 1 :]))
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.correlations(_lineitem(spark, sf_dir), COLUMNS)


@query("""WITH c AS (SELECT unnest(['l_discount', 'l_quantity', 'l_tax']) AS feature, unnest([corr(l_discount, l_extendedprice), corr(l_quantity, l_extendedprice), corr(l_tax, l_extendedprice)]) AS r FROM lineitem)
SELECT 1::BIGINT AS place, feature, round(r, 6) AS merit FROM c ORDER BY r DESC, feature LIMIT 1""")
def cfs_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cfs(_lineitem(spark, sf_dir), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], 1)


@query()
def cfs_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return stats.cfs_array(e.select("embedding", F.col("label").cast("double").alias("y")), "embedding", "y")


@query("""SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity,
round((l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER (), 6) AS l_tax FROM lineitem""")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.standardised(_lineitem(spark, sf_dir), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"])


@query("""WITH v AS (SELECT 'l_quantity' AS feature, l_quantity AS v, l_extendedprice AS y FROM lineitem UNION ALL SELECT 'l_discount', l_discount, l_extendedprice FROM lineitem),
b AS (SELECT feature, v, count(*) AS n, sum(y) AS s FROM v GROUP BY 1, 2),
r AS (SELECT feature, v, lead(v) OVER w AS nxt, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY feature) AS n, sum(s) OVER (PARTITION BY feature) AS s FROM b WINDOW w AS (PARTITION BY feature ORDER BY v)),
g AS (SELECT *, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain FROM r WHERE nxt IS NOT NULL)
SELECT feature, round((v + nxt) / 2, 6) AS threshold, round(gain / n, 0) AS gain, nl::BIGINT AS n_left FROM g QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, v) = 1""")
def cart_best_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lineitem(spark, sf_dir)
    n = li.agg(F.count("*").alias("n"))
    best = stats.best_split(li, ["l_quantity", "l_discount"], "l_extendedprice")
    return best.join(F.broadcast(n), F.lit(True)).select("feature", F.round("threshold", 6).alias("threshold"), F.round(F.col("gain") / F.col("n"), 0).alias("gain"), "n_left")


@query("""SELECT count(*) FILTER (p >= 0.1) AS n_train, count(*) FILTER (p < 0.1) AS n_held, min(o_orderkey) FILTER (p < 0.1) AS first_held
FROM (SELECT o_orderkey, ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT / 4294967296 AS p FROM orders)""")
def hold_out_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, held = trees.hold_out(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    one = held.agg(F.count("*").alias("n_held"), F.min("o_orderkey").alias("first_held"))
    return train.agg(F.count("*").alias("n_train")).join(F.broadcast(one), F.lit(True))


@query("""WITH r AS (SELECT (('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 4) AS fold, o_custkey::DOUBLE AS x, o_totalprice AS y FROM orders),
m AS (SELECT f.fold, regr_slope(r.y, r.x) AS slope, regr_intercept(r.y, r.x) AS icpt FROM (SELECT DISTINCT fold FROM r) f JOIN r ON r.fold <> f.fold GROUP BY f.fold)
SELECT fold, count(*) AS n, round(avg((y - slope * x - icpt) ** 2) / 1e6, 2) AS mse_m FROM r JOIN m USING (fold) GROUP BY fold""")
def kfold_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = stats.line_by_fold(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "o_totalprice", 4)
    return k.select("fold", "n", F.round(F.col("mse") / 1e6, 2).alias("mse_m"))


@query("""WITH n AS (SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS tp, count(*) FILTER (quality <> 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic <> 1) AS fn, count(*) FILTER (quality <> 0 AND toxic <> 1) AS tn FROM labels),
f AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1p, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f1n FROM n)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
round(f1p, 6) AS f1_pos, round(f1n, 6) AS f1_neg, round(abs(f1p - f1n), 6) AS imbalance FROM f""")
def prf_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.prf(table(spark, sf_dir, "labels"), F.col("quality") == 0, F.col("toxic") == 1)


@query("""SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
round(sqrt(greatest(regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity), 0) / count(*)), 4) AS rmse FROM lineitem GROUP BY l_returnflag""")
def lin_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.regression(_lineitem(spark, sf_dir), "l_quantity", "l_extendedprice", ["l_returnflag"])


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings), m AS (SELECT label AS c, i, avg(x) AS m FROM x GROUP BY 1, 2),
d AS (SELECT vec_id, label, c, sum((x - m) * (x - m)) AS d FROM x JOIN m USING (i) GROUP BY 1, 2, 3) SELECT vec_id, label, c AS nearest FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1""")
def nearest_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.nearest_centroid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)
SELECT vec_id, i::BIGINT AS i, (((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ())) >= 0.5)::INT AS bit FROM x""")
def binarized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled to 0 ... 1 by the table's range, then cut at 0.5."""
    x = stats.unpivot_array(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return x.join(F.broadcast(ends), F.lit(True)).select("vec_id", "i", ((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) >= 0.5).cast("int").alias("bit"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, 4))
    return df


@query()
def cart_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = trees.split(_vectors(spark, sf_dir), "vec_id")
    return _rounded(trees.cart().fit(train).transform(test).select("vec_id", "label", "prediction"), "prediction")


@query()
def gbt_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trees.importances(_vectors(spark, sf_dir)), "importance")


@query()
def gbt_top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trees.top_features(_vectors(spark, sf_dir), 10), "importance")


@query()
def gbt_importance_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trees.select_embedded(_vectors(spark, sf_dir), "vec_id"), "mse")


@query()
def gbt_error_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trees.error_curve(_vectors(spark, sf_dir), "vec_id", 10), "mse")


@query()
def forward_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(boost.forward_selection(_vectors(spark, sf_dir), "vec_id", 3, trees=30, rate=0.1, depth=3), "mse")


@query()
def feature_error_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    order = [r.feature for r in trees.importances(v).orderBy(F.desc("importance"), "feature").collect()]  # a row for each dimension
    return _rounded(boost.error_by_features(v, "vec_id", order, trees=30, rate=0.1, depth=3), "mse")


@query()
def pruned_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(boost.pruned_boosting(_vectors(spark, sf_dir), "vec_id", trees=50, rate=0.03, depth=4, leaf=5), "plain", "pruned")


@query()
def noise_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trees.noise_robustness(_vectors(spark, sf_dir), "vec_id"), "importance")


@query()
def ols_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trees.linear(_vectors(spark, sf_dir), "vec_id"), "rmse")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 5) AS y FROM embeddings")
def outside_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program outside the engine is asked for each point: here another Python, that reads points and prints their squared length."""
    program = [sys.executable, "-c", "import sys\nfor line in sys.stdin: print(repr(sum(float(x) ** 2 for x in line.split())))"]
    answers = trees.asked_program(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), program, "embedding")
    return answers.select("vec_id", F.round("y", 5).alias("y"))


@query()
def mlp_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neural.mlp_labels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


@query()
def autoencoder_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neural.autoencoder_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query()
def deep_autoencoder_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neural.autoencoder_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", hidden=(32,))


@query()
def sparse_autoencoder_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neural.autoencoder_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", noise=0.0, sparsity=0.01)


@query()
def rbm_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neural.rbm_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query()
def stacked_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neural.stacked_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
