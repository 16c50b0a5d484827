"""Vectorised tokenising and hashing of Arrow string columns over their raw UTF-8 bytes.

A word is a maximal run of bytes of one class, so no Python object is made for a word: word and word-range hashes come
from prefix sums of a polynomial over 2^64 (odd base, hence invertible) and a final mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE, _WORDS_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Byte classes. ALNUM: ASCII letters and digits and every byte of a non-ASCII character. SOLID: all but ASCII white space.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _pow.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, U)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        have = _pow[base] = (both[0], both[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on every other."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * _powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def ranges(pre: np.ndarray, a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
    """Hash of each range [a, b) of the sequence whose prefix sums are pre."""
    return mix((pre[b] - pre[a]) * _powers(base, len(pre))[1][a] + (b - a).astype(U) * U(0xA0761D6478BD642F))


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array (nulls empty) and its offsets from 0."""
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) else "")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    offs = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about limit bytes of text, or one longer text, each; all rows are in one."""
    _, offs = raw(batch.column(column))
    i = 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


@dataclass
class Words:
    """Words of n texts: byte range, text number and hash of each, and where each text's words begin."""

    data: np.ndarray
    offs: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    pre: np.ndarray

    def heads(self, n: int) -> np.ndarray:
        """Hash of the first n bytes of each word."""
        return ranges(self.pre, self.start, np.minimum(self.start + n, self.end), _BASE)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text number of every k-word window; a text of 1 to k-1 words has one window with all of them."""
        n = np.diff(self.first)
        per = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
        doc = np.repeat(np.arange(len(n)), per)
        begin = np.concatenate([[0], np.cumsum(per)[:-1]]) if len(per) else per
        a = self.first[:-1][doc] + np.arange(len(doc)) - begin[doc]
        return ranges(prefix(self.hash, _WORDS_BASE), a, np.minimum(a + k, self.first[1:][doc]), _WORDS_BASE), doc


def words(arr: pa.Array, kind: np.ndarray = ALNUM, lower: bool = True) -> Words:
    data, offs = raw(pc.utf8_lower(arr) if lower else arr)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[data]
    edge = inside[1:] != inside[:-1]
    start = np.flatnonzero(edge & inside[1:])
    end = np.flatnonzero(edge & inside[:-1])
    # a text that begins inside a run cuts the run
    b = offs[1:-1]
    b = b[(b > 0) & (b < len(data))]
    b = np.unique(b[inside[b] & inside[b + 1]]) if len(b) else b
    if len(b):
        start, end = np.sort(np.concatenate([start, b])), np.sort(np.concatenate([end, b]))
    first = np.searchsorted(start, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    pre = prefix(data.astype(U) + U(1), _BASE)
    return Words(data, offs, start, end, doc, ranges(pre, start, end, _BASE), first, pre)
