"""Byte-pair encoding and decoding with a contiguous rank array.

A text is cut into words by the vocabulary's pattern. A word is an array of parts (first its bytes) and the array of
the ranks of adjacent pairs. The minimum rank is found by scanning, the boundary between its two parts is deleted, the ranks
of the two neighbouring pairs are refreshed, until no pair has a rank. Words of one length are done together, one row each; a
batch encodes each distinct word once, and a worker remembers words up to CACHE. Long words (over LONG bytes) hold the same
array with a heap of ranks, as repeated scans would take quadratic time.

The vocabulary is a file of base64 token and rank lines; its path is a parameter, default VOCABULARY, and must be readable on the
executors.

Defined cases: an empty table gives no rows; rows repeated with one doc_id, and rows with a null one, have a result each; pairs of equal rank (ties) join from the left; a null text has null tokens and decodes to null; an empty text has no tokens; texts of any length are
encoded whole; special-token strings in a text are ordinary text; other columns are ignored by encoded().
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import renamed
from textloom.llm.textbytes import raw, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG, CACHE = 48, 300_000
NONE = np.int64(1 << 40)


class Encoder:
    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        self.size = max(self.ranks.values()) + 1
        tokens = [b""] * self.size
        for t, r in self.ranks.items():
            tokens[r] = t
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.byte_id = np.array([self.ranks[bytes([k])] for k in range(256)], np.int64)
        self._pairs()
        self._forget()

    def _forget(self) -> None:
        """Empty the memory of words: each has a number, and by number its tokens lie one after another in a flat array."""
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _pairs(self) -> None:
        """Open-addressing table (left id, right id) -> id of the joined token, which is also its rank."""
        keys, vals = [], []
        for t, r in self.ranks.items():
            for k in range(1, len(t)):
                a, b = self.ranks.get(t[:k]), self.ranks.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    vals.append(r)
        self.bits = max(10, int(len(keys) * 4).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_val = np.full(1 << self.bits, NONE, np.int64)
        left, val = np.array(keys, np.int64), np.array(vals, np.int64)
        at = self._slot(left)
        while len(left):
            free = self.slot_key[at] < 0
            _, one = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = one[free[one]]
            self.slot_key[at[put]], self.slot_val[at[put]] = left[put], val[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, val, at = left[rest], val[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of adjacent pairs; NONE where they don't join or b is -1."""
        key = np.where((a >= 0) & (b >= 0), a * self.size + b, -2)
        at = self._slot(key)
        out = np.full(key.shape, NONE)
        todo = np.flatnonzero(key >= 0)
        at, k = at[todo], key[todo]
        while len(todo):
            got = self.slot_key[at]
            hit = got == k
            out[todo[hit]] = self.slot_val[at[hit]]
            more = ~hit & (got >= 0)
            todo, k, at = todo[more], k[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out

    def rows(self, parts: np.ndarray) -> np.ndarray:
        """Encode words of equal byte length, a row each; merged rows are padded with -1 at the end."""
        n, length = parts.shape
        out = np.full((n, length), -1, np.int64)
        live = np.arange(n)
        ranks = np.full((n, length), NONE)
        if length > 1:
            ranks[:, :-1] = self.rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, length - 1)
        while len(live):
            at = ranks.argmin(1)
            row = np.arange(len(live))
            low = ranks[row, at]
            done = low >= NONE
            if done.any():
                out[live[done], : parts.shape[1]] = parts[done]
                parts, ranks, live, at, low = parts[~done], ranks[~done], live[~done], at[~done], low[~done]
                if not len(live):
                    break
                row = np.arange(len(live))
            # delete the boundary after part `at`: everything behind it moves one place to the left
            width = parts.shape[1]
            src = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
            parts, ranks = np.take_along_axis(parts, src, 1), np.take_along_axis(ranks, src, 1)
            parts[row, at] = low
            left = np.where(at > 0, parts[row, np.maximum(at - 1, 0)], -1)
            right = np.where(at + 1 < width - 1, parts[row, np.minimum(at + 1, width - 2)], -1)
            fresh = self.rank(np.concatenate([left, low]), np.concatenate([np.where(left >= 0, low, -1), right]))
            has = at > 0
            ranks[row[has], at[has] - 1] = fresh[: len(row)][has]
            ranks[row, at] = fresh[len(row) :]
        return out

    def long(self, word: bytes) -> np.ndarray:
        """The same merges for one long word, with the boundaries in linked arrays and the ranks in a heap."""
        part = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(part)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.rank(np.array(part[:-1]), np.array(part[1:]))
        heap = [(int(r), k, part[k], part[k + 1]) for k, r in enumerate(first) if r < NONE]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            m = nxt[k]
            if part[k] != a or m >= n or part[m] != b:
                continue
            part[k], part[m] = r, -1
            nxt[k] = nxt[m]
            if nxt[k] < n:
                prv[nxt[k]] = k
            for x, y in ((prv[k], k), (k, nxt[k])):
                if x >= 0 and y < n:
                    q = int(self._rank_one(part[x], part[y]))
                    if q < NONE:
                        heapq.heappush(heap, (q, x, part[x], part[y]))
        return np.array([p for p in part if p >= 0], np.int64)

    def _rank_one(self, a: int, b: int) -> int:
        token = self.bytes[self.begin[a] : self.begin[a] + self.length[a]].tobytes() + self.bytes[self.begin[b] : self.begin[b] + self.length[b]].tobytes()
        return self.ranks.get(token, int(NONE))

    def learn(self, new: list[str]) -> None:
        """Encode new distinct words into the pool."""
        coded = [w.encode("utf-8", "surrogatepass") for w in new]
        size = np.array([len(c) for c in coded])
        found: list[np.ndarray | None] = [None] * len(new)
        for length in np.unique(size):
            which = np.flatnonzero(size == length)
            if length > LONG:
                for k in which:
                    found[k] = self.long(coded[k])
                continue
            for a in range(0, len(which), 20_000):
                some = which[a : a + 20_000]
                got = self.rows(self.byte_id[np.frombuffer(b"".join(coded[k] for k in some), np.uint8).reshape(len(some), length)])
                lens = (got >= 0).sum(1)
                flat = got[got >= 0]
                for k, x in zip(some, np.split(flat, np.cumsum(lens)[:-1]), strict=True):
                    found[k] = x
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.flat = np.concatenate([self.flat, *[x.astype(np.int32) for x in found]])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in found])])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts in a row, and how many each has."""
        if len(self.known) > CACHE:
            self._forget()
        words = [self.find(t) if t else [] for t in texts]
        known = self.known
        new = {w for ws in words for w in ws if w not in known}
        if new:
            self.learn(sorted(new))
        at = np.fromiter((known[w] for ws in words for w in ws), np.int64, sum(map(len, words)))
        begin = self.ends[at]
        n = self.ends[at + 1] - begin
        ends = np.cumsum(n)
        out = self.flat[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - begin, n)]
        per = np.array([len(ws) for ws in words])
        edge = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per)])]
        return out, np.diff(edge)

    def decode(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all texts in a row, and how many each has."""
        n = self.length[tokens]
        ends = np.cumsum(n)
        data = self.bytes[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - self.begin[tokens], n)]
        return data.tobytes(), np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])])


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker; its word memory serves all its tasks."""
    return Encoder(path)


def _lists(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    counts = np.nan_to_num(pa.compute.fill_null(pa.compute.list_value_length(arr), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts


def _list_array(values: np.ndarray, counts: np.ndarray, null: np.ndarray) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs, mask=np.append(null, False)) if null.any() else pa.array(offs), pa.array(values.astype(np.int32)))


def encode(path: str = VOCABULARY):
    """Column function text -> array<int> of token ids."""

    @F.arrow_udf("array<int>")
    def tokens(text: pa.Array) -> pa.Array:
        out = []
        for part in slices(pa.RecordBatch.from_arrays([text], ["text"]), "text", 1 << 21):
            col = part.column("text")
            values, counts = encoder(path).encode(col.to_pylist())
            out.append(_list_array(values, counts, col.is_null().to_numpy(zero_copy_only=False)))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return tokens


def decode(path: str = VOCABULARY):
    """Column function array<int> of token ids -> text."""

    @F.arrow_udf("string")
    def text(tokens: pa.Array) -> pa.Array:
        values, counts = _lists(tokens)
        data, sizes = encoder(path).decode(values, counts)
        offs = np.concatenate([[0], np.cumsum(sizes)])
        null = tokens.is_null().to_numpy(zero_copy_only=False)
        return pa.array([None if z else data[a:b].decode("utf-8", "replace") for a, b, z in zip(offs, offs[1:], null, strict=False)], pa.string())

    return text


def _checked(path: str):
    """text -> tokens with the proof that decoding gives the text's bytes again."""

    @F.arrow_udf("tokens array<int>, n_tokens bigint, round_trip boolean")
    def both(text: pa.Array) -> pa.Array:
        out = []
        kind = pa.struct([("tokens", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("round_trip", pa.bool_())])
        for part in slices(pa.RecordBatch.from_arrays([text], ["text"]), "text", 1 << 21):
            col = part.column("text")
            enc = encoder(path)
            values, counts = enc.encode(col.to_pylist())
            data, sizes = enc.decode(values, counts)
            source, offs = raw(col)
            same = np.diff(offs) == sizes
            ends = np.concatenate([[0], np.cumsum(sizes)])
            if same.all() and source.tobytes() == data:
                pass
            else:
                same &= np.array([data[ends[k] : ends[k + 1]] == source[offs[k] : offs[k + 1]].tobytes() for k in range(len(same))], bool)
            null = col.is_null().to_numpy(zero_copy_only=False)
            out.append(pa.StructArray.from_arrays([_list_array(values, counts, null), pa.array(counts, pa.int64(), mask=null), pa.array(same, mask=null)], fields=list(kind)))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    return both


def encoded(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens, n_tokens, round_trip (decoding the tokens gave the text) of every row of docs."""
    src = renamed(docs, doc_id="doc_id", text="text")
    return src.select("doc_id", _checked(path)(F.col("text")).alias("t")).select("doc_id", "t.*")
