"""Suffix-array deduplication of passages by a common-prefix-aware distributed merge sort.

A window of LENGTH words that occurs more than once in the corpus (in other documents or in its own) stays at its first
occurrence by (doc_id, position) and is removed elsewhere; removed windows of a document are united into spans of words.

Sorting the suffix at every word would move the corpus many times over, so the suffix array is sparse, without losing a window: of the
ANCHOR-word grams in a window the one with the smallest hash is its anchor (the rightmost among equals). This depends on
the window's words alone, so equal windows have equal anchors at the same place. Suffixes start at anchors, and only at
those whose gram occurs more than once; each reaches to the end of the last window it is the anchor of and carries the words before it as left context.

  1. anchors of all texts: gram hash and place, and of one in SAMPLE the suffix's first HEAD bytes; grams that occur once are dropped;
  2. every task sorts its suffixes into a run, of those that agree in all (left context, suffix and windows) only the first goes on and the others
     are removed at once, and cuts it at splitters (quantiles of the sampled beginnings, several words each) and front-codes it:
     length of the prefix shared with the suffix before, and the rest; the pieces are exchanged;
  3. a task merges the pieces of its range with a loser tree that keeps with each run's head its common prefix with the last
     winner: of two heads the one that shares more is smaller, bytes are compared only from a shared length on, and never twice;
  4. the merge yields the common prefixes of neighbours; windows are equal where right parts lie in one stretch of long enough
     common prefixes and left contexts agree.

A common first word doesn't make a large range, as splitters go on behind it; a passage that very many documents hold sends one suffix a run
(RUN_BYTES of them). There are at most TARGETS ranges, so the splitters have a bounded size.

Defined cases: an empty table gives no rows; null texts, null doc_ids and texts of fewer than LENGTH words have no window; texts of any length are taken whole; words are cut at ASCII
white space and compared as they are; rows repeated with one doc_id are one document; of equal windows (ties) the first by (doc_id, position) stays; other columns are
ignored, whatever their names, and without_spans() keeps them.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textloom.llm.common import cut, private, renamed
from textloom.llm.textbytes import _WORDS_BASE, SOLID, U, Words, mix, prefix, ranges, slices, words

LENGTH, PER_TARGET, CHUNK, RUN_BYTES = 50, 40_000, 8_000, 16 << 20
SAMPLE, HEAD, PER_SPLIT, TARGETS = 16, 32, 20, 100_000


def owners(w: Words, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, owner, gram): first word of every window, the first word of its anchor, and hash of the gram at each word."""
    n, doc = len(w.start), w.doc
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - anchor + 1)
    gram = ranges(prefix(w.hash, _WORDS_BASE), at, at + anchor, _WORDS_BASE)
    width, step, low = length - anchor + 1, 1, at.copy()
    while step * 2 <= width:
        a, b = low[:-step], low[step:]
        low = np.where(gram[a] < gram[b], a, b)
        step *= 2
    if step < width:
        a, b = low[: len(low) - (width - step)], low[width - step :]
        low = np.where(gram[a] < gram[b], a, b)
    inside = np.flatnonzero(doc[: n - length + 1] == doc[length - 1 :])
    return inside, low[inside], gram


def _anchors(batches: Iterator[pa.RecordBatch], length: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            w = words(part.column("text"), SOLID, lower=False)
            _, own, gram = owners(w, length, anchor)
            own = np.unique(own)
            if not len(own):
                continue
            ids, word = part.column("doc_id").take(pa.array(w.doc[own])), own - w.first[w.doc[own]]
            some = mix(gram[own] ^ mix(ids.to_numpy().astype(U) * U(0x9E3779B97F4A7C15) + word.astype(U))) % U(SAMPLE) == 0
            heads = [_head(w, k, k + anchor) if s else None for k, s in zip(own.tolist(), some.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(gram[own].view(np.int64)), ids, pa.array(word.astype(np.int32)), pa.array(heads, pa.binary())], ["gram", "doc_id", "word", "head"])


def _head(w: Words, a: int, b: int) -> bytes:
    """The first HEAD bytes of the words a to b, one space after each."""
    out = b""
    while a < b and len(out) < HEAD:
        out += w.data[w.start[a] : w.end[a]].tobytes() + b" "
        a += 1
    return out[:HEAD]


def _head_of(suffix: bytes, anchor: int) -> bytes:
    """The same of a suffix's first anchor words: suffixes that share a window have it in common."""
    out = suffix[:HEAD]
    return b" ".join([*out.split(b" ")[:anchor], b""]) if out.count(b" ") >= anchor else out


RUN = "target int, n int, doc_id binary, word binary, before binary, after binary, shared binary, rest_len binary, rest binary, left_text binary, gone binary"


def front_code(sorted_suffixes: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Length of the prefix shared with the suffix before (0 for the first), and the rest of each."""
    shared = [0]
    for a, b in zip(sorted_suffixes, sorted_suffixes[1:], strict=False):
        shared.append(mismatch(a, b, 0))
    return np.array(shared, np.int32), [s[k:] for s, k in zip(sorted_suffixes, shared, strict=True)]


def mismatch(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, of which the first `at` bytes are known to agree."""
    top, step = min(len(a), len(b)), 8
    while at < top:
        if a[at : at + step] == b[at : at + step]:
            at += step
            step *= 2
        elif step == 1:
            return at
        else:
            step = max(1, step // 8)
    return top


def _runs(batches: Iterator[pa.RecordBatch], splitters: list[bytes], length: int, anchor: int) -> Iterator[pa.RecordBatch]:
    key: list[bytes] = []
    left: list[bytes] = []
    meta: list[tuple[int, int, int, int]] = []  # doc_id, anchor word, windows before and after the anchor's place
    held = 0

    def flush() -> pa.RecordBatch:
        order = sorted(range(len(key)), key=lambda k: (key[k], left[k], meta[k][2:], meta[k][:2]))
        first, gone = order[:1], []
        for k in order[1:]:
            f = first[-1]
            if key[k] == key[f] and left[k] == left[f] and meta[k][2:] == meta[f][2:]:
                if meta[k][:2] != meta[f][:2]:
                    doc, word, before, after = meta[k]
                    gone.append((doc, word - before, word - after))
            else:
                first.append(k)
        at = np.array([bisect.bisect_right(splitters, _head_of(key[k], anchor)) for k in first])
        rows = []
        for t in np.unique(at):
            own = [first[k] for k in np.flatnonzero(at == t)]
            shared, rest = front_code([key[k] for k in own])
            m = np.array([meta[k] for k in own], np.int64)
            rows.append([int(t), len(own), m[:, 0].tobytes(), *(m[:, c].astype(np.int32).tobytes() for c in (1, 2, 3)), shared.tobytes(), np.array([len(r) for r in rest], np.int32).tobytes(), b"".join(rest), b"\n".join(left[k] for k in own), b""])
        rows[meta[0][0] % len(rows)][-1] = np.array(gone, np.int64).tobytes()  # goes along with some piece
        key.clear()
        left.clear()
        meta.clear()
        names = [c.split()[0] for c in RUN.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k < 2 else pa.binary()) for k, c in enumerate(zip(*rows, strict=True))], names)

    for batch in batches:
        for part in slices(batch, "text"):
            w = words(part.column("text"), SOLID, lower=False)
            win, own, _ = owners(w, length, anchor)
            if not len(win):
                continue
            wanted = part.column("anchors")
            base = w.first[:-1][np.repeat(np.arange(len(part)), wanted.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
            wanted = np.unique(wanted.flatten().to_numpy() + base)
            # windows of one anchor are consecutive
            edge = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (win[1:] != win[:-1] + 1)]))
            lo, hi, j = win[edge], win[np.append(edge[1:], len(win)) - 1], own[edge]
            ok = np.isin(j, wanted)
            ids = part.column("doc_id").to_numpy()
            # the words of this part with one space after each
            size = w.end - w.start
            begin = np.concatenate([[0], np.cumsum(size + 1)])
            flat = np.full(begin[-1], 32, np.uint8)
            src = np.arange(int(size.sum())) + np.repeat(w.start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            flat[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = w.data[src]
            flat = flat.tobytes()
            for a, b, k in zip(lo[ok].tolist(), hi[ok].tolist(), j[ok].tolist(), strict=True):
                d = w.doc[k]
                key.append(flat[begin[k] : begin[b + length]])
                left.append(flat[begin[a] : begin[k]])
                meta.append((ids[d], k - w.first[d], k - a, k - b))
                held += len(key[-1])
        if held > RUN_BYTES:
            held = 0
            yield flush()
    if key:
        yield flush()


class LoserTree:
    """Merges front-coded runs. Of each run's head it knows the common prefix with the last winner (all heads that lost to it
    on its path do); a game is decided by these lengths, and by bytes from the common length on if they are equal."""

    def __init__(self, runs: list[Iterator[tuple[bytes, int, int]]]):
        self.runs = runs
        self.heads: list[tuple[bytes, int] | None] = []
        self.lcp = [0] * len(runs)  # with the last winner that the head was compared against
        for r in runs:
            first = next(r, None)
            self.heads.append((first[0], first[2]) if first else None)
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.tree = [-1] * self.size
        self.top = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size if node - self.size < len(self.runs) else -1
        winner, loser = self._play(self._build(2 * node), self._build(2 * node + 1))
        self.tree[node] = loser
        return winner

    def _play(self, x: int, y: int) -> tuple[int, int]:
        """(winner, loser) of two runs whose heads know their common prefix with the same string."""
        if x < 0 or self.heads[x] is None:
            return y, x
        if y < 0 or self.heads[y] is None:
            return x, y
        if self.lcp[x] > self.lcp[y]:
            return x, y  # y leaves the winner's prefix earlier and is larger; its length with x stays the same
        if self.lcp[x] < self.lcp[y]:
            return y, x
        a, b = self.heads[x][0], self.heads[y][0]
        k = mismatch(a, b, self.lcp[x])
        if a[k : k + 1] <= b[k : k + 1]:
            self.lcp[y] = k
            return x, y
        self.lcp[x] = k
        return y, x

    def __iter__(self) -> Iterator[tuple[bytes, int, int]]:
        """(suffix, prefix shared with the one before, payload) in order."""
        while self.top >= 0 and self.heads[self.top] is not None:
            r = self.top
            suffix, what = self.heads[r]
            yield suffix, self.lcp[r], what
            new = next(self.runs[r], None)
            self.heads[r] = (new[0], new[2]) if new else None
            self.lcp[r] = new[1] if new else 0  # front coding: shared with the winner just given out
            node = (r + self.size) // 2
            while node:
                r, self.tree[node] = self._play(r, self.tree[node])
                node //= 2
            self.top = r


def _decoded(row: dict, base: int) -> Iterator[tuple[bytes, int, int]]:
    shared, size, rest = np.frombuffer(row["shared"], np.int32).tolist(), np.frombuffer(row["rest_len"], np.int32).tolist(), row["rest"]
    last, at = b"", 0
    for k, (s, n) in enumerate(zip(shared, size, strict=True)):
        last = last[:s] + rest[at : at + n]
        at += n
        yield last, s, base + k


def _by_target(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The pieces of each target; rows come sorted by target, so one target is held at a time."""
    rows: list[dict] = []
    for batch in batches:
        for k in range(len(batch)):
            row = batch.slice(k, 1).to_pylist()[0]
            if rows and row["target"] != rows[0]["target"]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _merged(batches: Iterator[pa.RecordBatch], length: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for rows in _by_target(batches):
        base = np.concatenate([[0], np.cumsum([r["n"] for r in rows])])
        col = {c: np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("doc_id", np.int64), ("word", np.int32), ("before", np.int32), ("after", np.int32))}
        left = b"\n".join(r["left_text"] for r in rows)
        ends = np.append(np.flatnonzero(np.frombuffer(left, np.uint8) == 10), len(left))
        common, order = [], []
        for suffix, shared, what in LoserTree([_decoded(r, int(b)) for r, b in zip(rows, base, strict=False)]):
            n = suffix.count(b" ", 0, shared)  # whole words, as each ends with a space
            if len(order) >= CHUNK and n < anchor:  # no window reaches across: what came before is complete
                yield _removed(np.array(order), np.array(common), col, left, ends, length, anchor)
                common, order = [], []
            common.append(n)
            order.append(what)
        yield _removed(np.array(order), np.array(common), col, left, ends, length, anchor)
        gone = np.concatenate([np.frombuffer(r["gone"], np.int64) for r in rows]).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in gone.T.copy()], ["doc_id", "first", "last"])


def _removed(order: np.ndarray, common: np.ndarray, col: dict[str, np.ndarray], left: bytes, ends: np.ndarray, length: int, anchor: int) -> pa.RecordBatch:
    """Stretches of removed windows of merged suffixes, as (first, last) windows; common: words shared with the suffix before."""
    doc, word, before, after = (col[c][order] for c in ("doc_id", "word", "before", "after"))
    begin = np.where(order > 0, ends[order - 1] + 1, 0)
    lw = words(pa.array([left[a:b] for a, b in zip(begin.tolist(), ends[order].tolist(), strict=True)], pa.binary()), SOLID, lower=False)
    pre, last = prefix(lw.hash, _WORDS_BASE), lw.first[1:]
    removed = np.zeros((len(order), length - anchor + 1), bool)
    for d in range(length - anchor + 1):  # windows that begin d words before the anchor
        k = np.flatnonzero((after <= d) & (d <= before))
        if len(k) < 2:
            continue
        right = np.cumsum(common < length - d)[k]
        hist = ranges(pre, last[k] - d, last[k], _WORDS_BASE)
        s = np.lexsort((word[k], doc[k], hist, right))
        k, right, hist = k[s], right[s], hist[s]
        new = np.concatenate([[True], (right[1:] != right[:-1]) | (hist[1:] != hist[:-1])])
        first = k[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
        removed[k, d] = (doc[k] != doc[first]) | (word[k] != word[first])
    pad = np.zeros((len(order), removed.shape[1] + 2), np.int8)
    pad[:, 1:-1] = removed
    step = np.diff(pad, axis=1)
    i, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    return pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array((word[i] - b + 1).astype(np.int64)), pa.array((word[i] - a).astype(np.int64))], ["doc_id", "first", "last"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int | None = None) -> DataFrame:
    """The removed spans: doc_id, start, stop (words, from 0) and n_words."""
    anchor = anchor or max(1, length // 2)
    spark = docs.sparkSession
    src = renamed(docs, doc_id="doc_id", text="text").where("doc_id is not null and text is not null")
    anchors = cut(src.mapInArrow(lambda it: _anchors(it, length, anchor), "gram bigint, doc_id bigint, word int, head binary"), "anchors")
    many = anchors.groupBy("gram").count().where("count > 1").select("gram")
    again = cut(anchors.join(many, "gram").select("doc_id", "word", "head"), "again")
    n, sampled = again.agg(F.count("*"), F.count("head")).first()
    targets = min(max(1, -(-n // PER_TARGET)), TARGETS)
    splitters: list[bytes] = []
    if targets > 1:
        rate = min(1.0, PER_SPLIT * targets / max(sampled, 1))  # PER_SPLIT beginnings a target, whatever the size
        some = again.where(F.col("head").isNotNull() & (F.pmod(F.xxhash64("doc_id", "word", F.lit(5)), F.lit(1 << 20)) < int(rate * (1 << 20)))).select("head").toArrow()["head"]
        heads = sorted(some.to_pylist())
        splitters = sorted({heads[k * len(heads) // targets] for k in range(1, targets)}) if heads else []
    wanted = cut(again.groupBy("doc_id").agg(F.collect_set("word").alias("anchors")), "wanted")
    texts = src.join(wanted, "doc_id").select("doc_id", "text", "anchors")  # by shuffle: the anchors grow with the texts
    runs = texts.mapInArrow(lambda it: _runs(it, splitters, length, anchor), RUN)
    width = max(len(splitters) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = runs.repartition(width, "target").sortWithinPartitions("target").mapInArrow(lambda it: _merged(it, length, anchor), "doc_id bigint, first bigint, last bigint")
    ends = found.select("doc_id", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    w = W.partitionBy("doc_id").orderBy("start", "stop")
    island = F.when(F.col("start") > F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1)), 1).otherwise(0)
    spans = ends.withColumn("new", island).withColumn("island", F.sum("new").over(w)).groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return spans.select("doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"))


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the spans' words, and the white space after each, cut from text."""
    at, mine, new = (private(docs, c) for c in ("cut_id", "cuts", "cut_text"))
    cuts = cut(spans.groupBy(F.col("doc_id").alias(at)).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(mine)), "cuts")

    @F.arrow_udf("string")
    def less(text: pa.Array, cut_at: pa.Array) -> pa.Array:
        out = []
        w = words(text, SOLID, lower=False)
        for k, (t, c) in enumerate(zip(text, cut_at.to_pylist(), strict=True)):
            if not c or not t.is_valid:
                out.append(t.as_py())
                continue
            data = w.data[w.offs[k] : w.offs[k + 1]]
            begin = np.append(w.start[w.first[k] : w.first[k + 1]] - w.offs[k], len(data))
            keep = np.ones(len(data), bool)
            for s in c:
                keep[begin[min(s["start"], len(begin) - 1)] : begin[min(s["stop"], len(begin) - 1)]] = False
            out.append(data[keep].tobytes().decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    joined = docs.join(cuts, docs["doc_id"] == cuts[at], "left").withColumn(new, less(F.col("text"), F.col(mine)))
    return joined.select(*[F.col(new).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
