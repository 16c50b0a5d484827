"""Statistics and evaluation: correlations, standardising, splits, errors, confusion counts, regression, greedy filter selection."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unpivot_array(df: DataFrame, key: str, array: str) -> DataFrame:
    """key, i (from 0), x of an array column's elements."""
    return df.select(key, F.posexplode(array).alias("i", "x")).select(key, F.col("i").cast("bigint").alias("i"), F.col("x").cast("double").alias("x"))


def correlations(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """a, b, r for all a < b, in one pass: one aggregate of all pairs, then rows of it. A constant column gives null."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("p")).select("p.a", "p.b", F.round(F.nanvl("p.r", F.lit(None).cast("double")), digits).alias("r"))


def greedy_merit(corr_y: dict[str, float], corr_ff: dict[tuple[str, str], float], most: int | None = None) -> list[tuple[str, float]]:
    """(feature, merit) in the order of choice: each step takes the feature with the largest sum(r_cf) / sqrt(k + 2 sum(r_ff)),
    correlations with their sign, as long as the merit grows. Ties go to the first by name."""
    chosen: list[str] = []
    out, best = [], -math.inf
    while len(chosen) < (most or len(corr_y)):
        step = None
        for f in sorted(set(corr_y) - set(chosen)):
            s = [*chosen, f]
            under = len(s) + 2 * sum(corr_ff.get((a, b), corr_ff.get((b, a), 0.0)) for k, a in enumerate(s) for b in s[k + 1 :])
            merit = sum(corr_y[x] for x in s) / math.sqrt(under) if under > 0 else -math.inf
            if step is None or merit > step[1]:
                step = (f, merit)
        if step is None or step[1] <= best:
            break
        chosen.append(step[0])
        best = step[1]
        out.append(step)
    return out


def cfs(df: DataFrame, target: str, columns: list[str], most: int | None = None) -> DataFrame:
    """place, feature, merit: correlation-based selection. One pass over the data; the greedy choice works on the k x k correlations."""
    r = {(x.a, x.b): x.r if x.r is not None else 0.0 for x in correlations(df, [*columns, target], 12).collect()}
    got = greedy_merit({c: r[(c, target)] for c in columns}, {p: v for p, v in r.items() if target not in p}, most)
    return df.sparkSession.createDataFrame([(k + 1, f, round(m, 6)) for k, (f, m) in enumerate(got)], "place bigint, feature string, merit double")


def cfs_array(df: DataFrame, array: str, target: str, most: int | None = None) -> DataFrame:
    """place, feature (index), merit of correlation-based selection over all elements of an array column.

    One pass: every task adds up the products of its rows (a matrix of the array's width), and the sums of the tasks are added in Spark."""
    import numpy as np

    def products(batches):
        n, total = 0, None
        for b in batches:
            if len(b):
                v = np.column_stack([np.stack(b[array].to_list()).astype(float), b[target].to_numpy(float), np.ones(len(b))])
                total, n = v.T @ v if total is None else total + v.T @ v, n + len(b)
        if n:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    rows = df.where(F.col(array).isNotNull() & F.col(target).isNotNull()).select(array, target)
    sums = rows.mapInPandas(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    if sums.empty:
        return df.sparkSession.createDataFrame([], "place bigint, feature bigint, merit double")
    k = int(sums.i.max())
    m = np.zeros((k + 1, k + 1))
    m[sums.i, sums.j] = sums.s
    n, mean = m[k, k], m[k, :k] / m[k, k]
    cov = m[:k, :k] / n - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    r = np.divide(cov, np.outer(sd, sd), out=np.zeros_like(cov), where=np.outer(sd, sd) > 1e-12)
    name = [f"{f:06d}" for f in range(k)]
    got = greedy_merit({name[f]: float(r[f, k - 1]) for f in range(k - 1)}, {(name[a], name[b]): float(r[a, b]) for a in range(k - 1) for b in range(a + 1, k - 1)}, most)
    return df.sparkSession.createDataFrame([(p + 1, int(f), round(v, 6)) for p, (f, v) in enumerate(got)], "place bigint, feature bigint, merit double")


def standardised(df: DataFrame, key: str, columns: list[str], digits: int = 6) -> DataFrame:
    """key and (x - mean) / population deviation of each column; a constant column gives null."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    return df.join(F.broadcast(stats), F.lit(True)).select(*([key] if isinstance(key, str) else key), *[F.round(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), digits).alias(c) for c in columns])


def best_split(df: DataFrame, features: list[str], target: str, min_leaf: int = 1) -> DataFrame:
    """feature, threshold, gain, n_left of the best split of each feature: what a regression tree's root would try.

    Rows are first summed by distinct value, so the running sums go over values, not rows; gain is the fall in squared error, the threshold
    the middle between neighbouring values, rows below it go left."""
    values = df.select(F.col(target).cast("double").alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("p")).where("p.v is not null and y is not null")
    by = values.groupBy("p.feature", "p.v").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    w, every = W.partitionBy("feature").orderBy("v"), W.partitionBy("feature")
    run = by.select(
        "feature", "v", F.lead("v").over(w).alias("nxt"),
        F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("nl"), F.sum("s").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("sl"),
        F.sum("n").over(every).alias("n"), F.sum("s").over(every).alias("s"),
    ).where("nxt is not null")
    run = run.where((F.col("nl") >= min_leaf) & (F.col("n") - F.col("nl") >= min_leaf))
    gain = F.col("sl") ** 2 / F.col("nl") + (F.col("s") - F.col("sl")) ** 2 / (F.col("n") - F.col("nl")) - F.col("s") ** 2 / F.col("n")
    best = run.withColumn("gain", gain).withColumn("rn", F.row_number().over(W.partitionBy("feature").orderBy(F.desc("gain"), "v"))).where("rn = 1")
    return best.select("feature", ((F.col("v") + F.col("nxt")) / 2).alias("threshold"), F.col("gain").alias("gain"), F.col("nl").alias("n_left"))


def folds(key: Column, k: int) -> Column:
    """A fold number from a hash of the key that other engines can compute as well."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(k))


def line_by_fold(df: DataFrame, key: str, x: str, y: str, k: int) -> DataFrame:
    """fold, n, mse: a line fitted on the other folds by their sums, its error on this one. One pass for the sums, one for the errors."""
    rows = df.select(folds(F.col(key), k).alias("fold"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    sums = rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    every = W.partitionBy(F.lit(1))
    rest = sums.select("fold", *[(F.sum(c).over(every) - F.col(c)).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") ** 2)
    lines = rest.withColumn("slope", slope).withColumn("icpt", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).select("fold", "slope", "icpt")
    err = F.pow(F.col("y") - F.col("slope") * F.col("x") - F.col("icpt"), F.lit(2))
    return rows.join(F.broadcast(lines), "fold").groupBy("fold").agg(F.count("*").alias("n"), F.avg(err).alias("mse"))


def prf(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1 of the positive class, f1 of the negative, and the balance of the two f1s."""
    t, g = F.coalesce(truth, F.lit(False)), F.coalesce(guess, F.lit(False))
    n = df.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f_pos, f_neg = div(2 * tp, 2 * tp + fp + fn), div(2 * tn, 2 * tn + fp + fn)
    return n.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(a) for c, a in ((div(tp + tn, tp + tn + fp + fn), "accuracy"), (div(tp, tp + fp), "precision"), (div(tp, tp + fn), "recall"), (f_pos, "f1_pos"), (f_neg, "f1_neg"), (F.abs(f_pos - f_neg), "imbalance"))])


def regression(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """slope, intercept and rmse of the least-squares line of y on x, for each group of by, from one pass of sums."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    n = df.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_sxx(b, a).alias("sxx"), F.regr_syy(b, a).alias("syy"), F.regr_sxy(b, a).alias("sxy"))
    sse = F.greatest(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0))
    return n.select(*by, "n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round(F.sqrt(sse / F.col("n")), 4).alias("rmse"))


def nearest_centroid(df: DataFrame, key: str, array: str, label: str) -> DataFrame:
    """key, label, nearest: each row's nearest class mean. The means are a row for each class and dimension and are joined as one small array."""
    means = unpivot_array(df.withColumn("_", F.struct(label)).select("_", array), "_", array).groupBy(F.col(f"_.{label}").alias("c"), "i").agg(F.avg("x").alias("m"))
    cents = means.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    every = cents.agg(F.array_sort(F.collect_list(F.struct("c", "m"))).alias("cents"))
    dist = lambda m: F.aggregate(F.zip_with(F.col(array), m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = F.array_min(F.transform("cents", lambda c: F.struct(dist(c["m"]).alias("d"), c["c"].alias("c"))))
    return df.join(F.broadcast(every), F.lit(True)).select(key, label, near["c"].alias("nearest"))
