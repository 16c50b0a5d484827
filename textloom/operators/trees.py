"""Trees, boosting and feature selection over vectors: embedded, wrapper and noise experiments, with Spark ML."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.stats import folds


def vectors(df: DataFrame, key: str, array: str, label: str) -> DataFrame:
    """key, label, features."""
    return df.where(F.col(array).isNotNull() & F.col(label).isNotNull()).select(key, F.col(label).cast("double").alias("label"), array_to_vector(F.transform(array, lambda x: x.cast("double"))).alias("features"))


def cart(depth: int = 5, leaf: int = 5) -> DecisionTreeRegressor:
    return DecisionTreeRegressor(maxDepth=depth, minInstancesPerNode=leaf, impurity="variance")


def boosting(trees: int = 20, rate: float = 0.1, depth: int = 3, columns: float = 0.7, rows: float = 0.5, loss: str = "squared", seed: int = 1) -> GBTRegressor:
    """Stochastic gradient boosting; loss squared or absolute, columns and rows the shares drawn for each node and tree."""
    return GBTRegressor(maxIter=trees, stepSize=rate, maxDepth=depth, featureSubsetStrategy=str(columns), subsamplingRate=rows, lossType=loss, seed=seed)


def mse(predicted: DataFrame) -> float:
    return RegressionEvaluator(metricName="mse").evaluate(predicted)


def split(rows: DataFrame, key: str, k: int = 4) -> tuple[DataFrame, DataFrame]:
    """(training, test): test is one of k folds by a hash of the key."""
    fold = folds(F.col(key), k)
    return rows.where(fold != 0), rows.where(fold == 0)


def importances(rows: DataFrame, model: GBTRegressor | None = None) -> DataFrame:
    """feature (index) and importance of the features a boosted model uses, the importance summing to 1."""
    fitted = (model or boosting()).fit(rows)
    got = [(int(i), float(v)) for i, v in enumerate(fitted.featureImportances.toArray()) if v > 0]
    return rows.sparkSession.createDataFrame(got, "feature bigint, importance double")


def top_features(rows: DataFrame, n: int, model: GBTRegressor | None = None) -> DataFrame:
    """The n features that contribute most, ties by index."""
    return importances(rows, model).orderBy(F.desc("importance"), "feature").limit(n)


def hold_out(rows: DataFrame, key: str, share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(training, held out): a share of the rows by a hash of the key, the same in every run."""
    place = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.where(place >= share), rows.where(place < share)


def select_embedded(rows: DataFrame, key: str, threshold: float = 0.02) -> DataFrame:
    """n_features, mse of the full model and of the refit on the features whose importance reaches the threshold."""
    train, test = split(rows, key)
    full = boosting().fit(train)
    keep = [i for i, v in enumerate(full.featureImportances.toArray()) if v >= threshold]
    slicer = VectorSlicer(inputCol="features", outputCol="kept", indices=keep or [0])
    small = boosting().setFeaturesCol("kept").fit(slicer.transform(train))
    got = [("all", full.numFeatures, mse(full.transform(test))), ("kept", len(keep or [0]), mse(small.transform(slicer.transform(test))))]
    return rows.sparkSession.createDataFrame(got, "model string, n_features bigint, mse double")


def error_curve(rows: DataFrame, key: str, trees: int = 20) -> DataFrame:
    """n_trees and the test error after each stage of boosting."""
    train, test = split(rows, key)
    errors = boosting(trees).fit(train).evaluateEachIteration(test, "squared")
    return rows.sparkSession.createDataFrame([(k + 1, float(e)) for k, e in enumerate(errors)], "n_trees bigint, mse double")


def noise_robustness(rows: DataFrame, key: str, noise: int = 7, seed: int = 3) -> DataFrame:
    """feature, importance, is_noise after `noise` random columns are added: they should get little importance."""
    extra = rows.select(key, "label", "features", *[F.randn(seed + k).alias(f"noise_{k}") for k in range(noise)])
    joined = VectorAssembler(inputCols=["features", *[f"noise_{k}" for k in range(noise)]], outputCol="wide").transform(extra).select(key, "label", F.col("wide").alias("features"))
    got = importances(joined)
    width = len(rows.select("features").first()[0]) if not rows.isEmpty() else 0
    return got.withColumn("is_noise", F.col("feature") >= width)


def linear(rows: DataFrame, key: str) -> DataFrame:
    """n, rmse of ordinary least squares on a held-out fold."""
    train, test = split(rows, key)
    p = LinearRegression(solver="normal").fit(train).transform(test)
    return p.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("label") - F.col("prediction"), F.lit(2)))).alias("rmse"))


def asked(points: DataFrame, oracle, array: str = "x") -> DataFrame:
    """points with y, the answers of an outside function (array -> number) that is called on the executors, batch by batch."""
    @F.pandas_udf("double")
    def ask(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else float(oracle(v)))

    return points.withColumn("y", ask(F.col(array)))


def asked_program(points: DataFrame, command: list[str], array: str = "x", as_arguments: bool = False, timeout_s: int = 600) -> DataFrame:
    """points with y, the answers of an outside program that must be there on the executors: a process for each batch that reads the points, a line
    of numbers each, and prints a number for each; or (as_arguments) a process for each point, which has its numbers as arguments.

    A program that fails, or doesn't print as many numbers, fails the query; a null point has a null answer."""

    @F.pandas_udf("double")
    def ask(x: pd.Series) -> pd.Series:
        import subprocess

        def run(more: list[str], text: str) -> list[float]:
            return [float(v) for v in subprocess.run([*command, *more], input=text, capture_output=True, text=True, check=True, timeout=timeout_s).stdout.split()]

        have = x[x.notna()]
        lines = [[repr(float(v)) for v in point] for point in have]
        got = [run(line, "")[0] for line in lines] if as_arguments else run([], "".join(" ".join(line) + "\n" for line in lines)) if lines else []
        if len(got) != len(lines):
            raise ValueError(f"{command[0]} gave {len(got)} answers for {len(lines)} points")
        return pd.Series(got, index=have.index, dtype="float64").reindex(x.index)

    return points.withColumn("y", ask(F.col(array)))
