"""Gradient boosting of regression trees in numpy over binned features, and feature searches that fit very many small models.

A wrapper search fits a model for every candidate feature and fold, hundreds of models on the same few rows: too small for a distributed trainer.
So the rows are a bounded sample of labelled rows (SAMPLE, a parameter, in hash order), binned once, and the models are the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import invert

SAMPLE, BINS = 20_000, 64


def quantiles(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """The edges of each column's bins."""
    return [np.unique(np.quantile(x[:, c], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for c in range(x.shape[1])]


def binned(x: np.ndarray, edges: list[np.ndarray] | None = None) -> np.ndarray:
    """Each column's values as the number of their bin."""
    edges = quantiles(x) if edges is None else edges
    return np.stack([np.searchsorted(e, x[:, c], "right") for c, e in enumerate(edges)], axis=1) if edges else np.zeros(x.shape, np.int64)


@dataclass
class Tree:
    """Nodes in breadth-first order: feature (-1 for a leaf), last bin that goes left, children, mean."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def leaves(self, b: np.ndarray, without: int | None = None) -> np.ndarray:
        """The node each row ends in; the splits on feature `without` count as leaves."""
        at, f = np.zeros(len(b), np.int64), np.array(self.feature)
        if without is not None:
            f = np.where(f == without, -1, f)
        cut, left = np.array(self.bin), np.array(self.left)
        while (go := np.flatnonzero(f[at] >= 0)).size:
            n = at[go]
            at[go] = left[n] + (b[go, f[n]] > cut[n])
        return at

    def predict(self, b: np.ndarray, without: int | None = None) -> np.ndarray:
        return np.array(self.value)[self.leaves(b, without)]

    def prune(self, feature: int) -> None:
        self.feature = [-1 if f == feature else f for f in self.feature]

    def used(self) -> list[int]:
        """Features of the splits that can be reached."""
        out, todo = set(), [0]
        while todo:
            n = todo.pop()
            if self.feature[n] >= 0:
                out.add(self.feature[n])
                todo += [self.left[n], self.left[n] + 1]
        return sorted(out)


def grow(b: np.ndarray, y: np.ndarray, depth: int, leaf: int, bins: int = BINS) -> Tree:
    """The tree whose splits each lower the squared error most; ties go to the first feature and bin."""
    t, groups = Tree([-1], [0], [0], [float(y.mean()) if len(y) else 0.0]), [(0, np.arange(len(y)))]
    for _ in range(depth):
        after = []
        for node, rows in groups:
            n, s, width = len(rows), y[rows].sum(), b.shape[1]
            if n < 2 * leaf:
                continue
            at = (b[rows] + np.arange(width) * bins).ravel()
            nl = np.cumsum(np.bincount(at, minlength=width * bins).reshape(width, bins), axis=1)[:, :-1]
            sl = np.cumsum(np.bincount(at, np.repeat(y[rows], width), width * bins).reshape(width, bins), axis=1)[:, :-1]
            ok = (nl >= leaf) & (n - nl >= leaf)
            gain = np.where(ok, sl * sl / np.maximum(nl, 1) + (s - sl) ** 2 / np.maximum(n - nl, 1) - s * s / n, 0)
            best = divmod(int(gain.argmax()), bins - 1)
            if gain[best] <= 1e-12:
                continue
            best = (gain[best], *best)
            right = b[rows, best[1]] > best[2]
            t.feature[node], t.bin[node], t.left[node] = best[1], best[2], len(t.feature)
            for part in (rows[~right], rows[right]):
                after.append((len(t.feature), part))
                t.feature.append(-1)
                t.bin.append(0)
                t.left.append(0)
                t.value.append(float(y[part].mean()))
        groups = after
    return t


@dataclass
class Boosted:
    trees: int = 50
    rate: float = 0.05
    depth: int = 4
    leaf: int = 2
    rows: float = 1.0  # share drawn for each tree
    columns: float = 1.0
    prune: float | None = None  # a tree loses a feature without which its squared error grows by less than this
    loss: str = "squared"  # or log: labels 0 and 1, predictions are log-odds
    seed: int = 1

    def fit(self, b: np.ndarray, y: np.ndarray) -> Boosted:
        rng = np.random.default_rng(self.seed)
        mean, log = float(y.mean()), self.loss == "log"
        self.base, self.fitted, self.pruned = float(np.log((mean + 1e-6) / (1 - mean + 1e-6))) if log else mean, [], 0
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score)) if log else score
            left = y - p
            own = rng.permutation(len(y))[: max(1, int(self.rows * len(y)))] if self.rows < 1 else np.arange(len(y))
            cols = np.sort(rng.choice(b.shape[1], max(1, int(self.columns * b.shape[1])), replace=False)) if self.columns < 1 else np.arange(b.shape[1])
            t = grow(b[np.ix_(own, cols)], left[own], self.depth, self.leaf)
            t.feature = [int(cols[f]) if f >= 0 else -1 for f in t.feature]
            if self.prune is not None:
                for f in t.used():
                    now, then = (np.mean((t.predict(b, w) - left) ** 2) for w in (None, f))
                    if then - now < self.prune:
                        t.prune(f)
                        self.pruned += 1
            if log:  # a Newton step in each leaf
                at = t.leaves(b)
                n = len(t.value)
                t.value = (np.bincount(at, left, n) / np.maximum(np.bincount(at, p * (1 - p), n), 1e-6)).clip(-8, 8).tolist()
            score = score + self.rate * t.predict(b)
            self.fitted.append(t)
        return self

    def stages(self, b: np.ndarray) -> Iterator[np.ndarray]:
        """Predictions after each tree."""
        p = np.full(len(b), self.base)
        for t in self.fitted:
            p = p + self.rate * t.predict(b)
            yield p

    def predict(self, b: np.ndarray) -> np.ndarray:
        p = np.full(len(b), self.base)
        for p in self.stages(b):  # noqa: B007
            pass
        return p


def sampled(rows: DataFrame, key: str, n: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(binned features, labels) of at most n rows of (key, label, features) in hash order."""
    from pyspark.ml.functions import vector_to_array

    got = invert.sampled(rows.select(key, "label", vector_to_array("features").alias("x")), key, n).toPandas()
    x = np.stack(got["x"].to_list()).astype(float) if len(got) else np.zeros((0, 0))
    return binned(x), got["label"].to_numpy(float)


def fitted_by_fold(spark, x: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: int, **model) -> list[tuple[list[np.ndarray], Boosted] | None]:
    """For each fold (edges, model) fitted on the rows of the others, each by a task; None where those have one class."""
    data = spark.sparkContext.broadcast((x, y, fold))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        x, y, fold = data.value
        for batch in batches:
            out = []
            for k in batch["id"]:
                own = fold != k
                edges = quantiles(x[own])
                got = (edges, Boosted(**model).fit(binned(x[own], edges), y[own])) if len(np.unique(y[own])) > 1 else None
                out.append((k, pickle.dumps(got)))
            yield pd.DataFrame(out, columns=["k", "model"])

    import pickle

    got = {r.k: pickle.loads(r.model) for r in spark.range(0, folds, 1, folds).mapInPandas(fit, "k long, model binary").collect()}
    data.unpersist()
    return [got[k] for k in range(folds)]


def errors(rows: DataFrame, b: np.ndarray, y: np.ndarray, sets: list[list[int]], folds: int = 4, **model) -> list[float]:
    """Mean squared error over the folds of a boosted model on each set of features; every (set, fold) is a task of its own."""
    spark = rows.sparkSession
    data = spark.sparkContext.broadcast((b, y, sets))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b, y, sets = data.value
        fold = np.arange(len(y)) % folds
        for batch in batches:
            out = []
            for task in batch["id"]:
                s, k = divmod(int(task), folds)
                x, held = b[:, sets[s]], fold == k
                p = Boosted(**model).fit(x[~held], y[~held]).predict(x[held])
                out.append((s, float(((p - y[held]) ** 2).sum())))
            yield pd.DataFrame(out, columns=["s", "sse"])

    n = len(sets) * folds
    got = spark.range(0, n, 1, min(n, spark.sparkContext.defaultParallelism * 4)).mapInPandas(score, "s long, sse double").groupBy("s").agg(F.sum("sse").alias("sse")).collect()
    data.unpersist()
    by = {r.s: r.sse / max(len(y), 1) for r in got}
    return [by[s] for s in range(len(sets))]


def forward_selection(rows: DataFrame, key: str, most: int = 15, sample: int = SAMPLE, **model) -> DataFrame:
    """place, feature, mse: wrapper selection. Each step tries every feature that isn't chosen yet and takes the one with which boosting errs least over
    4 folds, as long as the error falls."""
    b, y = sampled(rows, key, sample)
    chosen, out, best = [], [], float("inf")
    while len(y) > 4 and len(chosen) < min(most, b.shape[1]):
        rest = [f for f in range(b.shape[1]) if f not in chosen]
        tried = errors(rows, b, y, [[*chosen, f] for f in rest], **model)
        err, f = min(zip(tried, rest, strict=True))
        if err >= best:
            break
        best = err
        chosen.append(f)
        out.append((len(chosen), f, err))
    return rows.sparkSession.createDataFrame(out, "place bigint, feature bigint, mse double")


def error_by_features(rows: DataFrame, key: str, order: list[int], sample: int = SAMPLE, **model) -> DataFrame:
    """n_features, mse of boosting over 4 folds on the first 1, 2, ... features of an order (of importance, say)."""
    b, y = sampled(rows, key, sample)
    got = errors(rows, b, y, [order[: k + 1] for k in range(len(order))], **model) if len(y) > 4 else []
    return rows.sparkSession.createDataFrame([(k + 1, e) for k, e in enumerate(got)], "n_features bigint, mse double")


def pruned_boosting(rows: DataFrame, key: str, least: float = 0.01, sample: int = SAMPLE, **model) -> DataFrame:
    """n_trees, plain, pruned: error on a fourth of the sample after each tree, of boosting as it is and with each tree losing the features without
    which its squared error grows by less than `least`; and n_pruned, how many were lost in all."""
    b, y = sampled(rows, key, sample)
    held = np.arange(len(y)) % 4 == 0
    fits = [Boosted(prune=p, **model).fit(b[~held], y[~held]) for p in (None, least)] if held.sum() > 1 else []
    curves = [[float(np.mean((p - y[held]) ** 2)) for p in m.stages(b[held])] for m in fits]
    out = [(k + 1, a, c, fits[1].pruned) for k, (a, c) in enumerate(zip(*curves, strict=True))] if fits else []
    return rows.sparkSession.createDataFrame(out, "n_trees bigint, plain double, pruned double, n_pruned bigint")
