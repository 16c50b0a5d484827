"""Toxicity: a convolutional text classifier in numpy with thresholds by language.

A word (letters and digits, lower case) has a row in each of HASHES embedding tables, concatenated: two rows by independent
hashes of the word, so that words are alike only if both collide, and one by the hash of its first HEAD bytes, so that forms
of one stem share what is learned. Filters of each width in WIDTHS slide over a text's words (in a text
shorter than a width a window begins at each word, with zeros behind the last), ReLU, the maximum over the text, then a logistic layer. Training is Adam on mini-batches;
the gradient of a maximum reaches only the window that has it. The first dimension of the embeddings and the first
filter of each width start from the log-odds of the table's rows on the training texts.

Fitted on a bounded sample, at most SAMPLE labelled documents of each class in hash order, one fifth of them held out. A language's
threshold is the cut with the best F1 on all its labelled documents that the network wasn't fitted on, weighted to the labels' mix of
classes, and on those of all languages together, which weigh as much as PRIOR toxic ones of its own: the fewer a language has, the nearer it is
to the common threshold. It is chosen from histograms of scores. Scoring covers whole texts of all documents.

Defined cases: an empty table gives no rows; texts of any length are scored whole; rows repeated with one doc_id have a result each; a null text or one without a word has score 0 and isn't toxic; without labels of both classes all scores
are 0; an unknown or null language has the threshold of all languages; a null doc_id is scored like any other; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, renamed
from textloom.llm.textbytes import U, Words, mix, slices, words

#: BINS: of scores, for each unit of log-odds.
SAMPLE, PRIOR, BINS = 2000, 8, 50
ROWS, DIM, HASHES, WIDTHS, FILTERS, HEAD = 1 << 16, 8, 3, (1, 2, 3), 8, 5
EPOCHS, BATCH, RATE, DECAY, SEED = 6, 64, 0.02, 1e-4, 5
_SALT = [U(0x51ED270B0A1F39C1), U(0xB492B66FBE98F273), U(0x9AE16A3B2F90404F)]


def codes(w: Words) -> np.ndarray:
    """Hash of each word and of its head."""
    return np.stack([w.hash, w.heads(HEAD)], axis=1)


def buckets(c: np.ndarray) -> np.ndarray:
    """Rows of each word in the tables."""
    return np.stack([(mix(c[:, k] ^ s) >> U(64 - 16)).astype(np.int32) for k, s in zip((0, 0, 1), _SALT, strict=True)], axis=1)


@dataclass
class Net:
    emb: np.ndarray  # HASHES x ROWS x DIM
    conv: list[np.ndarray]  # for each width: width x (HASHES * DIM) x FILTERS
    bias: np.ndarray  # len(WIDTHS) x FILTERS
    out: np.ndarray
    out_bias: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    default: float = 0.5
    fitted: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # identifiers of the training documents

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and offset: the filters' response to each table row, hash by hash."""
        return [[[self.emb[h] @ c[k, h * DIM : (h + 1) * DIM] for h in range(HASHES)] for k in range(len(c))] for c in self.conv]

    def pooled(self, b: np.ndarray, first: np.ndarray, tables=None, where: bool = False):
        """Maximum response of every filter in each text (texts x widths x filters), and with `where` the word it is at."""
        tables = tables or self.tables()
        n = len(first) - 1
        size = np.diff(first)
        out = np.zeros((n, len(WIDTHS), FILTERS), np.float32)
        arg = np.full(out.shape, -1, np.int64)
        doc = np.repeat(np.arange(n), size)
        have = np.flatnonzero(size > 0)
        if not len(have):
            return (out, arg) if where else out
        to_end = first[1:][doc] - np.arange(len(b))
        for w, width in enumerate(WIDTHS):
            r = np.zeros((len(b), FILTERS), np.float32)
            for k in range(width):
                for h in range(HASHES):
                    t = tables[w][k][h]
                    if k == 0:
                        r += t[b[:, h]]
                    else:
                        r[:-k] += t[b[k:, h]] * (to_end[:-k] > k)[:, None]
            # windows that leave the text count only where it is shorter than the width
            r[(to_end < width) & (size[doc] >= width)] = -np.inf
            top = np.maximum.reduceat(r, first[:-1][have], axis=0)
            out[have, w] = top
            if where:
                full = np.zeros((n, FILTERS), np.float32)
                full[have] = top
                hit = r == full[doc]
                for f in range(FILTERS):
                    at = np.flatnonzero(hit[:, f])[::-1]
                    arg[doc[at], w, f] = at
        out[have] += self.bias
        out[size == 0] = 0
        return (out, arg) if where else out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0).reshape(len(pooled), -1) @ self.out + self.out_bias

    def score(self, b: np.ndarray, first: np.ndarray, tables=None) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(b, first, tables)), -40, 40)))
        return np.where(np.diff(first) > 0, p, 0.0)


def start(b: np.ndarray, first: np.ndarray, y: np.ndarray) -> Net:
    """Weights before training; dimension 0 of the tables holds log-odds."""
    rng = np.random.default_rng(SEED)
    emb = rng.normal(0, 0.3, (HASHES, ROWS, DIM)).astype(np.float32)
    doc = np.repeat(np.arange(len(y)), np.diff(first))
    for h in range(HASHES):
        seen = np.unique(b[:, h].astype(np.int64) * len(y) + doc)
        row, d = seen // len(y), seen % len(y)
        pos = np.bincount(row, y[d], ROWS)
        neg = np.bincount(row, 1 - y[d], ROWS)
        odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / ((1 - y).sum() + 1))
        sure = 2 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))  # two standard errors nearer to 0: rare words say little
        emb[h, :, 0] = np.where(pos + neg > 0, np.sign(odds) * np.maximum(np.abs(odds) - sure, 0), 0)
    # filters that start dead would never learn: random ones answer to about half of the texts
    conv = [rng.normal(0, 1.4 / np.sqrt(w * HASHES * DIM), (w, HASHES * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
    for c in conv:
        c[:, :, 0] *= 0.2
        c[:, ::DIM, 0] = 0.5 / len(c)
    bias[:, 0] = -0.5
    out = rng.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32)
    out[0] = 2.0
    return Net(emb, conv, bias, out, -3.0)


def gradients(net: Net, bb: np.ndarray, ff: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Gradients of a batch's weighted mean cross-entropy and the output layer's decay, for the filters, bias, output weights and bias, and as (table, rows,
    gradients) for the embeddings' rows, which may repeat."""
    used, inv = zip(*(np.unique(bb[:, h], return_inverse=True) for h in range(HASHES)), strict=True)
    small = Net(None, net.conv, net.bias, net.out, net.out_bias)
    tables = [[[net.emb[h][used[h]] @ c[j, h * DIM : (h + 1) * DIM] for h in range(HASHES)] for j in range(len(c))] for c in net.conv]
    bi = np.stack(inv, axis=1)
    pooled, arg = small.pooled(bi, ff, tables, where=True)
    p = 1 / (1 + np.exp(-np.clip(small.logits(pooled), -40, 40)))
    g = ((p - y) * weight / len(y)).astype(np.float32)
    act = np.maximum(pooled, 0).reshape(len(y), -1)
    g_out = act.T @ g + DECAY * net.out
    g_pool = (g[:, None] * net.out).reshape(pooled.shape) * (pooled > 0)
    g_conv = [np.zeros_like(c) for c in net.conv]
    g_emb: list[tuple[int, np.ndarray, np.ndarray]] = []
    for w, width in enumerate(WIDTHS):
        d, f = np.nonzero((g_pool[:, w] != 0) & (arg[:, w] >= 0))
        at, gg = arg[d, w, f], g_pool[d, w, f]
        for j in range(width):
            ok = at + j < ff[d + 1]
            for h in range(HASHES):
                rows = used[h][bi[at[ok] + j, h]]
                sl = slice(h * DIM, (h + 1) * DIM)
                np.add.at(g_conv[w][j, sl].T, f[ok], gg[ok, None] * net.emb[h][rows])
                g_emb.append((h, rows, gg[ok, None] * net.conv[w][j, sl][:, f[ok]].T))
    return g_conv, g_pool.sum(0), g_out, float(g.sum()), g_emb


def fit(b: np.ndarray, first: np.ndarray, y: np.ndarray) -> Net:
    net = start(b, first, y)
    rng = np.random.default_rng(SEED)
    params = [*net.conv, net.bias, net.out]
    mom = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    step, bm, bv = 0, 0.0, 0.0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            pick = np.sort(order[k : k + BATCH])
            idx = np.concatenate([np.arange(first[d], first[d + 1]) for d in pick])
            ff = np.concatenate([[0], np.cumsum(first[pick + 1] - first[pick])])
            g_conv, g_bias, g_out, gb, g_emb = gradients(net, b[idx], ff, y[pick], weight[pick])
            step += 1
            for prm, (m, v), gr in zip(params, mom, [*g_conv, g_bias, g_out], strict=True):
                m += 0.1 * (gr - m)
                v += 0.01 * (gr * gr - v)
                prm -= RATE * 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            for h, rows, gr in g_emb:
                np.add.at(net.emb[h], rows, -RATE * 5 * gr)
            bm, bv = bm + 0.1 * (gb - bm), bv + 0.01 * (gb * gb - bv)
            net.out_bias -= RATE * 0.25 * (bm / (1 - 0.9**step)) / (np.sqrt(bv / (1 - 0.99**step)) + 1e-8)
    return net


def best_cut(low: np.ndarray, high: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The threshold with the best F1, in the middle of the widest such gap; bins of scores in order, with the least and greatest score of each."""
    tp = np.concatenate([np.cumsum(toxic[::-1])[::-1], [0]])
    n = tp + np.concatenate([np.cumsum(clean[::-1])[::-1], [0]])
    f1 = 2 * tp / np.maximum(n + toxic.sum(), 1e-9)
    below, above = np.concatenate([[0], high]), np.concatenate([low, [1]])
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    k = best[np.argmax((above - below)[best])]
    return float(max((below[k] + above[k]) / 2, 1e-6))


def known(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of every labelled document."""
    return labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def calibrate(net: Net, scored: DataFrame, labels: DataFrame) -> None:
    """Sets the thresholds from all labelled rows of scored (doc_id, lang, score) that the network wasn't fitted on.

    These weigh as much as all labelled rows of their class and language, so that the mix of classes is the labels'."""
    ids = scored.sparkSession.createDataFrame([(int(k),) for k in net.fitted], "doc_id bigint").withColumn("own", F.lit(True))
    s = F.least(F.greatest(F.col("score"), F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = scored.where("doc_id is not null").join(known(labels), "doc_id").join(F.broadcast(ids), "doc_id", "left")
    bins = rows.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "toxic", F.col("own").isNotNull().alias("own"), F.floor(F.log(s / (1 - s)) * BINS).alias("bin"))
    t = bins.agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).toPandas()
    if t.empty:
        return

    def histogram(t):
        """Scores of the held-out rows in bins, with the weight of toxic and clean ones; empty where a class has none."""
        held = t[~t.own]
        n, h = t.groupby("toxic").n.sum(), held.groupby("toxic").n.sum()
        up = held.toxic.map(lambda c: n[c] / h[c])
        return held.assign(pos=held.n * up * (held.toxic == 1), neg=held.n * up * (held.toxic == 0))[["bin", "low", "high", "pos", "neg"]]

    def chosen(t) -> float:
        by = t.groupby("bin").agg({"low": "min", "high": "max", "pos": "sum", "neg": "sum"}).sort_index()
        return best_cut(*(by[c].to_numpy(float) for c in ("low", "high", "pos", "neg")))

    every = histogram(t)
    if not every.pos.sum() or not every.neg.sum():
        return
    net.default = chosen(every)
    prior = every.assign(pos=every.pos * PRIOR / every.pos.sum(), neg=every.neg * PRIOR / every.pos.sum())
    for name, own in t.groupby("lang"):
        if name:
            net.thresholds[str(name)] = chosen(pd.concat([histogram(own), prior]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Net | None:
    """Fitted on at most sample labelled documents of each class; None where a class has none."""
    have = known(labels)
    picked = None
    for q in (0, 1):
        part = have.where(F.col("toxic") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = part if picked is None else picked.unionAll(part)

    def coded(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", "toxic")] + [pa.ListArray.from_arrays(pa.array(w.first * 2, pa.int32()), pa.array(codes(w).view(np.int64).ravel()))], ["doc_id", "toxic", "words"])

    src = renamed(docs, doc_id="doc_id", text="text").where("doc_id is not null and text is not null")
    rows = src.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text").mapInArrow(coded, "doc_id bigint, toxic int, words array<bigint>").toArrow().sort_by("doc_id")
    rows = rows.filter(pa.compute.greater(pa.compute.list_value_length(rows["words"]), 0))
    y = rows["toxic"].to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return None
    first = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(rows["words"]).to_numpy() // 2)]).astype(np.int64)
    b = buckets(rows["words"].combine_chunks().flatten().to_numpy().view(U).reshape(-1, 2))
    held = np.arange(len(y)) % 5 == 4
    if not (y[held].max() == 1 and y[~held].max() == 1 and y[held].min() == 0):
        held[:] = False

    def part(mask):
        d = np.flatnonzero(mask)
        return b[np.concatenate([np.arange(first[k], first[k + 1]) for k in d])], np.concatenate([[0], np.cumsum(np.diff(first)[d])])

    tb, tf = part(~held)
    net = fit(tb, tf, y[~held])
    # too few for a held-out part: calibrated on all labels
    net.fitted = np.unique(rows["doc_id"].to_numpy()[~held]) if held.any() else np.zeros(0, np.int64)
    return net


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, lang, score, threshold (of the language), toxic of every row of docs."""
    net = train(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast((net, net.tables() if net else None))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        model, tables = shared.value
        out = [np.zeros(0)]
        for part in slices(pa.RecordBatch.from_arrays([text], ["text"]), "text"):
            w = words(part.column("text"))
            out.append(model.score(buckets(codes(w)), w.first, tables) if model else np.zeros(len(part)))
        return pa.array(np.round(np.concatenate(out), 6))

    src = renamed(docs, doc_id="doc_id", text="text", lang="lang")
    scored = src.select("doc_id", "lang", score("text").alias("score"))
    if net:
        scored = cut(scored, "scores")  # read twice: for the thresholds and for the result
        calibrate(net, scored, labels)
    limit = F.lit(net.default if net else 1.0)
    for name, value in (net.thresholds if net else {}).items():
        limit = F.when(F.col("lang") == name, F.lit(value)).otherwise(limit)
    return scored.withColumn("threshold", F.round(limit, 6)).withColumn("toxic", F.col("score") >= F.col("threshold"))
