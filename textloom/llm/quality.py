"""Document quality from a linear-chain conditional random field over lines.

Each line with a word is a position; its state is good or bad. Emissions are linear in the line's features and those of the lines before and after it,
transitions are learned. Forward-backward gives each line's probability of being good; a document's quality is their
mean weighted by line length in bytes, and it is kept if that reaches a threshold chosen on held-out labelled documents.

Training: labels.quality marks documents, not lines. Lines start with their document's label; then lines of bad
documents that the model holds for good are relabelled (one bad line at least remains) and it is fitted again.
It is fitted on a bounded sample, SAMPLE labelled documents of each class in hash order; scoring covers whole texts of all documents.

Defined cases: an empty table gives no rows; a null or empty text, or one without a word, has quality 0 and isn't kept; texts of any length are scored whole;
a null doc_id is scored like any other, and rows repeated with one doc_id have a result each; without
labels of both classes every text with a word has quality 1 and is kept; a document with both labels counts as bad; a quality of just the threshold (a tie) is kept;
a document's other columns, whatever their names, are ignored by quality() and kept by keep_good().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import renamed
from textloom.llm.textbytes import SOLID, slices, words

SAMPLE, ROUNDS, STEPS, L2 = 1500, 3, 200, 1e-3
FEATURES = 16

_CLASS = np.zeros((5, 256), np.int32)
_CLASS[0, 65:91] = 1  # upper case
_CLASS[1, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1  # letters
_CLASS[2, 48:58] = 1  # digits
_CLASS[3, [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?"]] = 1  # symbols
_CLASS[4, [ord(c) for c in ".,;:?!"]] = 1


@dataclass
class Lines:
    """Features (n x FEATURES), byte length and text number of lines; first: where each text's lines begin."""

    x: np.ndarray
    size: np.ndarray
    first: np.ndarray


def lines(arr: pa.Array) -> Lines:
    w = words(arr, SOLID, lower=False)
    data, offs = w.data, w.offs
    nl = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offs[:-1], nl + 1]))
    start = start[start < len(data)]
    doc = np.searchsorted(offs, start, "right") - 1
    end = np.minimum(np.append(nl, len(data))[np.searchsorted(nl, start)], offs[doc + 1])
    at = np.searchsorted(start, w.start, "right") - 1
    n = np.bincount(at, minlength=len(start))
    again = np.zeros(len(at))
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (at[1:] == at[:-1])
    last = data[w.end - 1] if len(at) else np.zeros(0, np.uint8)
    upper, letters, digits, symbols, points = (np.concatenate([[0], np.cumsum(c[data])]) for c in _CLASS)
    have = n > 0
    start, end, doc, n, again, tail = start[have], end[have], doc[have], n[have], np.bincount(at, again, len(start))[have], np.bincount(at, _CLASS[3][last], len(start))[have]
    count = [c[end] - c[start] for c in (upper, letters, digits, symbols, points)]
    size = end - start
    up, sym, dig, rep, end_sym = count[0] / np.maximum(count[1], 1), count[3] / size, count[2] / size, again / n, tail / n
    closing = _CLASS[4][data[end - 1]]
    x = np.stack(
        [np.ones(len(n)), np.log1p(size) / 6, up, up > 0.5, dig, dig > 0.2, sym, sym > 0.08, count[4] / size, rep, rep > 0.3, end_sym, end_sym > 0.4, size / n / 10, closing, n <= 2], axis=1
    ).astype(np.float32)
    return Lines(x, size, np.searchsorted(doc, np.arange(len(offs))))


def neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features with those of the line before and after it in its text (zeros beyond the ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    b = first[:-1][np.diff(first) > 0]
    before[b] = 0
    after[np.append(b[1:], len(x))[: len(b)] - 1] = 0
    return np.concatenate([x, before, after], axis=1)


def _buckets(first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in groups of like length: line index matrix (texts x longest) and its mask."""
    n = np.diff(first)
    out = []
    for k in np.unique(np.ceil(np.log2(n[n > 0])).astype(int)) if (n > 0).any() else []:
        d = np.flatnonzero((n > 0) & (np.ceil(np.log2(np.maximum(n, 1))).astype(int) == k))
        pos = np.arange(n[d].max())
        mask = pos < n[d][:, None]
        out.append((d, np.where(mask, first[d][:, None] + pos, 0), mask))
    return out


def marginals(score: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected transition counts, log partition; score: log potential of good against bad."""
    p, pairs, logz = np.zeros(len(score)), np.zeros((2, 2)), 0.0
    for _, at, mask in _buckets(first):
        n, length = at.shape
        e = np.zeros((length, n, 2))
        e[:, :, 1] = score[at].T
        m = mask.T
        fwd = np.zeros((length, n, 2))
        fwd[0] = e[0]
        for t in range(1, length):
            s = fwd[t - 1][:, :, None] + trans
            nxt = np.logaddexp(s[:, 0], s[:, 1]) + e[t]
            fwd[t] = np.where(m[t][:, None], nxt, fwd[t - 1])
        z = np.logaddexp(fwd[-1, :, 0], fwd[-1, :, 1])
        logz += z.sum()
        bwd = np.zeros((n, 2))
        out = np.zeros((length, n))
        for t in range(length - 1, -1, -1):
            out[t] = np.exp(fwd[t, :, 1] + bwd[:, 1] - z)
            if t:
                step = (e[t] + bwd)[:, None, :] + trans
                q = np.exp(fwd[t - 1][:, :, None] + step - z[:, None, None])
                pairs += q[m[t]].sum(0)
                bwd = np.where(m[t][:, None], np.logaddexp(step[:, :, 0], step[:, :, 1]), bwd)
        p[at[mask]] = out.T[mask]
    return p, pairs, logz


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    threshold: float

    def score(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Quality, number of lines and of bad lines of each text."""
        ln = lines(text)
        p, _, _ = marginals(neighbours(ln.x, ln.first) @ self.weights, ln.first, self.trans)
        n = np.diff(ln.first)
        doc = np.repeat(np.arange(len(n)), n)
        total = np.bincount(doc, ln.size, len(n))
        return np.bincount(doc, ln.size * p, len(n)) / np.maximum(total, 1), n, np.bincount(doc, p < 0.5, len(n)).astype(np.int64)


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, w: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the conditional log-likelihood of line labels y, texts weighted so that both classes count alike."""
    n = np.diff(first)
    inner = np.ones(len(y), bool)
    inner[first[:-1][n > 0]] = False
    prev = np.zeros(len(y), int)
    prev[1:] = y[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (prev[inner], y[inner]), 1)
    theta = np.concatenate([w, trans.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, STEPS + 1):
        p, pairs, _ = marginals(x @ theta[:-4], first, theta[-4:].reshape(2, 2))
        g = np.concatenate([x.T @ (y - p), (seen - pairs).ravel()]) / len(y) - L2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.98**k)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def threshold(score: np.ndarray, good: np.ndarray) -> float:
    """The cut with the fewest errors on good plus bad documents, each class weighing the same; the middle of the best gap."""
    order = np.argsort(score)
    s, g = score[order], good[order]
    err = np.concatenate([[0], np.cumsum(g) / max(g.sum(), 1)]) + np.concatenate([np.cumsum((~g)[::-1])[::-1], [0]]) / max((~g).sum(), 1)
    edge = np.concatenate([[0], s, [1]])
    best = np.flatnonzero(err <= err.min() + 1e-12)
    k = best[np.argmax(edge[best + 1] - edge[best])]
    return float((edge[k] + edge[k + 1]) / 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fitted on at most sample labelled documents of each class; None where a class has none."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    src = renamed(docs, doc_id="doc_id", text="text").where("doc_id is not null and text is not null")
    picked = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = part if picked is None else picked.unionAll(part)

    def features(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ln = lines(part.column("text"))
                at = pa.array(ln.first * FEATURES, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.ListArray.from_arrays(at, pa.array(ln.x.ravel(), pa.float32())), pa.ListArray.from_arrays(pa.array(ln.first, pa.int32()), pa.array(ln.size, pa.int64()))], ["doc_id", "quality", "x", "size"])

    rows = src.join(F.broadcast(picked), "doc_id").mapInArrow(features, "doc_id bigint, quality int, x array<float>, size array<bigint>").toArrow().sort_by("doc_id")
    rows = rows.filter(pa.compute.greater(pa.compute.list_value_length(rows["size"]), 0))
    good = rows["quality"].to_numpy() == 1
    if good.all() or not good.any():
        return None
    size = rows["size"].combine_chunks().flatten().to_numpy()
    first = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(rows["size"]).to_numpy())])
    x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES).astype(np.float64)
    x = neighbours(x, first)
    held = np.arange(len(good)) % 4 == 3  # for the threshold
    doc = np.repeat(np.arange(len(good)), np.diff(first))
    own = ~held[doc]
    tx, tdoc = x[own], np.unique(doc[own], return_inverse=True)[1]
    tfirst = np.searchsorted(tdoc, np.arange(tdoc.max() + 2))
    base = good[~held].astype(int)[tdoc]
    y, w, trans = base.copy(), np.zeros(x.shape[1]), np.zeros((2, 2))
    for _ in range(ROUNDS):
        w, trans = fit(tx, tfirst, y, w, trans)
        p = marginals(tx @ w, tfirst, trans)[0]
        y = np.where(base == 1, 1, (p > 0.5).astype(int))
        worst = np.lexsort((p, tdoc))[tfirst[:-1]]
        y[worst[base[worst] == 0]] = 0
    p = marginals(x @ w, first, trans)[0]
    q = np.bincount(doc, size * p) / np.bincount(doc, size)
    pick = held if (good & held).any() and (~good & held).any() else np.ones(len(good), bool)
    return Model(w, trans, threshold(q[pick], good[pick]))


def scorer(model: Model | None):
    """Column function text -> struct<quality double, n_lines bigint, n_bad bigint, keep boolean>."""
    kind = pa.struct([("quality", pa.float64()), ("n_lines", pa.int64()), ("n_bad", pa.int64()), ("keep", pa.bool_())])

    @F.arrow_udf("quality double, n_lines bigint, n_bad bigint, keep boolean")
    def score(text: pa.Array) -> pa.Array:
        parts = []
        for part in slices(pa.RecordBatch.from_arrays([text], ["text"]), "text"):
            if model is None:
                n = np.diff(lines(part.column("text")).first)
                q, bad = (n > 0).astype(float), np.zeros(len(n), np.int64)
            else:
                q, n, bad = model.score(part.column("text"))
            keep = (n > 0) & (q >= (model.threshold if model else 0))
            parts.append(pa.StructArray.from_arrays([pa.array(np.round(q, 6)), pa.array(n, pa.int64()), pa.array(bad), pa.array(keep)], fields=list(kind)))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return score


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, quality, n_lines, n_bad (lines more likely bad), keep of every row of docs."""
    score = scorer(train(docs, labels, sample))
    src = renamed(docs, doc_id="doc_id", text="text")
    return src.select("doc_id", score("text").alias("q")).select("doc_id", "q.*")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, whose text is kept."""
    return docs.where(scorer(train(docs, labels, sample))(F.col("text"))["keep"])
