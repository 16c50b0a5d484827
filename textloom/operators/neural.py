"""Small networks in numpy: multi-layer perceptron, sparse and denoising autoencoders, restricted Boltzmann machines.

A classifier is fitted on a bounded sample of labelled rows (SAMPLE rows in hash order, a parameter). What has no labels is trained on all rows, where
they are: in each round every task goes through its rows in mini-batches from the common weights, and the tasks' weights are averaged by
their rows (averaged() below). The trained network is a few matrices, and it is applied
to all rows by Arrow batches on the executors. Rows with a null vector are left out; a table without any gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import invert

SAMPLE = 20_000


def sample(df: DataFrame, key: str, array: str, *more: str, rows: int = SAMPLE) -> pd.DataFrame:
    """At most `rows` rows in hash order."""
    return invert.sampled(df.where(F.col(array).isNotNull()).select(key, array, *more), key, rows).toPandas()


def matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_list()).astype(np.float64) if len(values) else np.zeros((0, 0))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.clip(1 / (1 + np.exp(-np.clip(x, -40, 40))), 0.001, 0.999)


ACT: dict[str, tuple[Callable, Callable]] = {
    "sigmoid": (sigmoid, lambda a: a * (1 - a)),
    "tanh": (np.tanh, lambda a: 1 - a * a),
    "identity": (lambda x: x, np.ones_like),
}


@dataclass
class Net:
    """A chain of dense layers; the last layer's cost is logistic (sigmoid output) or square."""

    sizes: list[int]
    hidden: str = "tanh"
    output: str = "identity"
    rate: float = 0.05
    decay: float = 0.0
    decay_kind: str = "l2"
    sparsity: float = 0.0
    target: float = 0.05
    noise: float = 0.0
    seed: int = 1
    w: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.rng = np.random.default_rng(self.seed)
        if not self.w:
            self.w = [self.rng.normal(0, 1 / np.sqrt(a + 1), (a + 1, b)) for a, b in zip(self.sizes, self.sizes[1:], strict=False)]

    def layers(self, x: np.ndarray) -> list[np.ndarray]:
        """Activations of every layer, the input first."""
        out = [x]
        for k, w in enumerate(self.w):
            act = ACT[self.output if k == len(self.w) - 1 else self.hidden][0]
            out.append(act(np.hstack([out[-1], np.ones((len(x), 1))]) @ w))
        return out

    def step(self, x: np.ndarray, y: np.ndarray) -> None:
        a = self.layers(x + self.rng.normal(0, self.noise, x.shape) if self.noise else x)
        # for logistic cost with sigmoid output, and square cost with identity, the error at the output is the difference
        d = (a[-1] - y) / len(x)
        if self.output == "tanh":
            d = d * ACT["tanh"][1](a[-1])
        for k in range(len(self.w) - 1, -1, -1):
            g = np.hstack([a[k], np.ones((len(x), 1))]).T @ d
            back = d @ self.w[k][:-1].T
            if k:
                if self.sparsity:
                    act = a[k] if self.hidden == "sigmoid" else (a[k] + 1) / 2
                    p = np.clip(act.mean(0), 0.001, 0.999)
                    back = back + self.sparsity * ((1 - self.target) / (1 - p) - self.target / p) / len(x)
                d = back * ACT[self.hidden][1](a[k])
            if self.decay:
                g[:-1] += self.decay * (np.sign(self.w[k][:-1]) if self.decay_kind == "l1" else self.w[k][:-1])
            self.w[k] = self.w[k] - self.rate * g

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.w])

    def with_flat(self, v: np.ndarray) -> Net:
        at = np.cumsum([0, *[w.size for w in self.w]])
        return replace(self, w=[v[a:b].reshape(w.shape) for a, b, w in zip(at, at[1:], self.w, strict=False)])

    def copy(self) -> Net:
        return self.with_flat(self.flat())

    def train(self, x: np.ndarray, turn: int, batch: int = 32, epochs: int = 3) -> Net:
        """An autoencoder's passes over the rows of one Arrow batch."""
        self.rng = np.random.default_rng((self.seed, turn))
        for _ in range(epochs):
            order = self.rng.permutation(len(x))
            for k in range(0, len(x), batch):
                self.step(x[order[k : k + batch]], x[order[k : k + batch]])
        return self

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 50, batch: int = 32, patience: int = 9) -> list[float]:
        """Mini-batch descent; error on the last tenth after each epoch, stopping when it is not below that of `patience` epochs before."""
        n = max(1, len(x) * 9 // 10)
        curve: list[float] = []
        for _ in range(epochs):
            order = self.rng.permutation(n)
            for k in range(0, n, batch):
                self.step(x[order[k : k + batch]], y[order[k : k + batch]])
            held = slice(n, None) if n < len(x) else slice(None)
            curve.append(float(np.mean((self.layers(x[held])[-1] - y[held]) ** 2)))
            if len(curve) > patience and curve[-1] >= curve[-1 - patience]:
                break
        return curve


@dataclass
class Rbm:
    """Restricted Boltzmann machine trained by one step of contrastive divergence with momentum; visible units bernoulli or gaussian."""

    n_hidden: int
    visible: str = "gaussian"
    rate: float = 0.05
    momentum: float = 0.5
    seed: int = 1
    below: list[Rbm] = field(default_factory=list)  # trained layers that the rows go through first
    w: np.ndarray | None = None
    v: np.ndarray | None = None
    h: np.ndarray | None = None

    def prepared(self, width: int) -> Rbm:
        return replace(self, w=np.random.default_rng(self.seed).normal(0, 0.01, (width, self.n_hidden)), v=np.zeros(width), h=np.zeros(self.n_hidden))

    def up(self, v: np.ndarray) -> np.ndarray:
        return sigmoid(v @ self.w + self.h)

    def down(self, h: np.ndarray) -> np.ndarray:
        x = h @ self.w.T + self.v
        return sigmoid(x) if self.visible == "bernoulli" else x

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w.ravel(), self.v, self.h])

    def with_flat(self, a: np.ndarray) -> Rbm:
        n = self.w.size
        return replace(self, w=a[:n].reshape(self.w.shape), v=a[n : n + len(self.v)], h=a[n + len(self.v) :])

    def copy(self) -> Rbm:
        return self.with_flat(self.flat())

    def train(self, x: np.ndarray, turn: int, batch: int = 32, epochs: int = 3) -> Rbm:
        """Passes over the rows of one Arrow batch."""
        for r in self.below:
            x = r.up(x)
        rng = np.random.default_rng((self.seed, turn))
        m = [np.zeros_like(self.w), np.zeros_like(self.v), np.zeros_like(self.h)]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(x), batch):
                v0 = x[order[k : k + batch]]
                h0 = self.up(v0)
                v1 = self.down((rng.random(h0.shape) < h0).astype(float))
                h1 = self.up(v1)
                grads = ((v0.T @ h0 - v1.T @ h1) / len(v0), (v0 - v1).mean(0), (h0 - h1).mean(0))
                for i, g in enumerate(grads):
                    m[i] = self.momentum * m[i] + self.rate * g
                self.w, self.v, self.h = self.w + m[0], self.v + m[1], self.h + m[2]
        return self

    def error(self, x: np.ndarray) -> float:
        return float(np.mean((x - self.down(self.up(x))) ** 2))


#: Rounds of averaging, and how many parts the tasks' weights are averaged in before they meet.
ROUNDS, MEET = 6, 16


def averaged(rows: DataFrame, array: str, start, rounds: int = ROUNDS):
    """A network trained on all rows: start is a network with flat() and train(x, round), which returns the network after a pass over x.

    A round is one job over the rows: tasks train copies, batch by batch of the Arrow stream, so no task holds its rows; the copies' weights, weighted by rows, are
    averaged in MEET groups by Spark and then here, so the driver sees MEET sets of weights, however many tasks there are."""
    net = start
    for k in range(rounds):

        def work(batches: Iterator[pd.DataFrame], net=net, k=k) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            own, n = net.copy(), 0
            for b in batches:
                if len(b):
                    own = own.train(matrix(b[array]), k)
                    n += len(b)
            if n:
                yield pd.DataFrame({"part": [TaskContext.get().partitionId() % MEET], "n": [float(n)], "w": [own.flat() * n]})

        def mean(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": part["part"][:1], "n": [part["n"].sum()], "w": [np.sum(np.stack(part["w"].to_list()), axis=0)]})

        kind = "part int, n double, w array<double>"
        got = rows.select(array).mapInPandas(work, kind).groupBy("part").applyInPandas(mean, kind).toPandas().sort_values("part")
        if got.empty:
            return net
        net = net.with_flat(np.sum(np.stack(got["w"].to_list()), axis=0) / got["n"].sum())
    return net


def stacked(rows: DataFrame, array: str, width: int, sizes: list[int], seed: int = 1, rounds: int = ROUNDS) -> Net:
    """Layer-wise pre-training by Boltzmann machines, unrolled into an autoencoder and fine-tuned. sizes: the code's layers, input left out."""
    layers: list[Rbm] = []
    for k, n in enumerate(sizes):
        start = Rbm(n, "gaussian" if k == 0 else "bernoulli", seed=seed + k, below=list(layers)).prepared(sizes[k - 1] if k else width)
        layers.append(averaged(rows, array, start, rounds))
    w = [np.vstack([r.w, r.h]) for r in layers] + [np.vstack([r.w.T, r.v]) for r in reversed(layers)]
    net = Net([width, *sizes, *sizes[-2::-1], width], "sigmoid", "identity", seed=seed, w=w)
    return averaged(rows, array, net, rounds)


def vector_width(df: DataFrame, array: str) -> int:
    row = df.where(F.col(array).isNotNull()).select(F.size(array)).first()
    return row[0] if row else 0


def applied(df: DataFrame, key: str, array: str, f: Callable[[np.ndarray], np.ndarray], name: str = "code") -> DataFrame:
    """key and f of the vectors of all rows, as array<double>."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({key: b[key], name: list(f(matrix(b[array])))})

    kind = dict(df.dtypes)[key]
    return df.where(F.col(array).isNotNull()).select(key, array).mapInPandas(run, f"{key} {kind}, {name} array<double>")


def mlp_labels(df: DataFrame, key: str, array: str, label: str, hidden: int = 32, epochs: int = 60) -> DataFrame:
    """key, label, predicted: a perceptron with logistic outputs, one for each class."""
    rows = sample(df.where(F.col(label).isNotNull()), key, array, label)
    x, classes = matrix(rows[array]), np.unique(rows[label])
    y = (rows[label].to_numpy()[:, None] == classes).astype(float)
    net = Net([x.shape[1], hidden, len(classes)], "tanh", "sigmoid", rate=0.5)
    net.fit(x, y, epochs)
    scored = applied(df, key, array, lambda m: net.layers(m)[-1], "p")
    best = F.array_position("p", F.array_max("p")) - 1
    return scored.join(df.select(key, label), key).select(key, label, F.get(F.lit([int(c) for c in classes]), best.cast("int")).cast("int").alias("predicted"))


def autoencoder_codes(df: DataFrame, key: str, array: str, code: int = 8, noise: float = 0.05, sparsity: float = 0.0, hidden: tuple[int, ...] = (), rounds: int = ROUNDS) -> DataFrame:
    """key, code, error: the code layer of a (denoising, or sparse) autoencoder and the squared error of reconstruction. hidden: layers
    between input and code, mirrored behind it."""
    rows, width = df.where(F.col(array).isNotNull()), vector_width(df, array)
    net = averaged(rows, array, Net([width, *hidden, code, *hidden[::-1], width], "tanh", "identity", rate=0.1, noise=noise, sparsity=sparsity), rounds)

    def both(m: np.ndarray) -> np.ndarray:
        a = net.layers(m)
        return np.hstack([a[len(hidden) + 1], ((m - a[-1]) ** 2).mean(1, keepdims=True)])

    return applied(df, key, array, both).select(key, F.slice("code", 1, code).alias("code"), F.round(F.col("code")[code], 6).alias("error"))


def rbm_codes(df: DataFrame, key: str, array: str, code: int = 16, rounds: int = ROUNDS) -> DataFrame:
    """key and the hidden probabilities of a Boltzmann machine."""
    r = averaged(df.where(F.col(array).isNotNull()), array, Rbm(code).prepared(vector_width(df, array)), rounds)
    return applied(df, key, array, r.up)


def stacked_codes(df: DataFrame, key: str, array: str, sizes: tuple[int, ...] = (32, 8), rounds: int = ROUNDS) -> DataFrame:
    """key and the code of an autoencoder pre-trained layer by layer."""
    net = stacked(df.where(F.col(array).isNotNull()), array, vector_width(df, array), list(sizes), rounds=rounds)
    return applied(df, key, array, lambda m: net.layers(m)[len(sizes)])
