"""Integer codecs of posting lists, and compression, as Arrow functions."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Simple9: how many integers of how many bits a word's 28 payload bits hold, by selector.
SIMPLE9 = ((28, 1), (14, 2), (9, 3), (7, 4), (5, 5), (4, 7), (3, 9), (2, 14), (1, 28))


def varbyte(values) -> bytes:
    """7 bits a byte, most significant first; the high bit marks a number's last byte."""
    return varbytes(np.asarray(values, np.int64))[0].tobytes()


def varbytes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, length of each number's code) of many numbers at once."""
    if len(v) and v.min() < 0:
        raise ValueError("varbyte needs numbers of 0 or more")
    size = np.ones(len(v), np.int64)
    for k in range(1, 9):
        size += v >= np.int64(1) << (7 * k)
    ends = np.cumsum(size)
    back = np.repeat(ends, size) - 1 - np.arange(ends[-1] if len(ends) else 0)  # how many bytes of the number come after
    out = ((np.repeat(v, size) >> (7 * back)) & 127).astype(np.uint8)
    out[back == 0] |= 128
    return out, size


def from_varbyte(data: bytes) -> np.ndarray:
    return from_varbytes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]


def from_varbytes(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, how many each list has) of many lists at once; list k is b[ends[k]:ends[k + 1]]."""
    last = np.flatnonzero(b & 128)
    if not len(last):
        return np.zeros(0, np.int64), np.zeros(len(ends) - 1, np.int64)
    begin = np.concatenate([[0], last[:-1] + 1])
    shift = 7 * (np.repeat(last, last - begin + 1) - np.arange(last[-1] + 1))
    return np.add.reduceat((b[: last[-1] + 1] & 127).astype(np.int64) << shift, begin), np.diff(np.searchsorted(last, ends))


def simple9(values) -> bytes:
    """Little-endian words of a 4-bit selector and 28 payload bits; each takes the selector that holds the most numbers to come.

    The last word is filled up with zeros, so the number of values goes before it as one word."""
    v = np.asarray(values, np.int64)
    return simple9_lists(v, np.array([0, len(v)]))[0].tobytes()


def simple9_lists(v: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, their number in each list) of many lists at once; list k is v[ends[k]:ends[k + 1]].

    The selector that would be taken at each number, were it the first of a word, comes from how far numbers that fit go on; each list then goes
    from word to word, and the words are filled by selector."""
    if len(v) and (v.min() < 0 or v.max() >= 1 << 28):
        raise ValueError("simple9 needs numbers of 0 to 2^28 - 1")
    at, last = np.arange(len(v)), np.repeat(ends[1:], np.diff(ends))
    choice = np.full(len(v), len(SIMPLE9) - 1)
    for sel in range(len(SIMPLE9) - 2, -1, -1):
        n, bits = SIMPLE9[sel]
        wide = np.flatnonzero(v >= 1 << bits)
        to = np.append(wide, len(v))[np.searchsorted(wide, at)]  # the first that doesn't fit
        choice[to >= np.minimum(at + n, last)] = sel
    count = np.array([n for n, _ in SIMPLE9])
    step, begin = (at + count[choice]).tolist(), []
    for here, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        while here < end:
            begin.append(here)
            here = step[here]
    begin = np.array(begin, np.int64)
    sel, words = choice[begin], choice[begin].astype(np.int64) << 28
    for s, (n, bits) in enumerate(SIMPLE9):
        own = np.flatnonzero(sel == s)
        for k in range(n):
            own = own[begin[own] + k < last[begin[own]]]
            words[own] |= v[begin[own] + k] << bits * k
    n = np.bincount(np.searchsorted(ends, begin, "right") - 1, minlength=len(ends) - 1)
    return np.insert(words, np.cumsum(n) - n, np.diff(ends)).astype("<u4"), n + 1


def from_simple9(data: bytes) -> np.ndarray:
    words = np.frombuffer(data, "<u4")
    return from_simple9_lists(words, np.array([0, len(words)]))[0]


def from_simple9_lists(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, how many each list has) of many lists at once; list k is words[ends[k]:ends[k + 1]], its length first."""
    words, some = words.astype(np.int64), np.diff(ends) > 0
    n = np.zeros(len(ends) - 1, np.int64)
    n[some] = words[ends[:-1][some]]
    coded = np.ones(len(words), bool)
    coded[ends[:-1][some]] = False
    words, owner = words[coded], np.repeat(np.arange(len(n)), np.diff(ends))[coded]
    count, bits = (np.array(x)[words >> 28] for x in zip(*SIMPLE9, strict=True))
    begin = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.int64)
    for sel, (many, width) in enumerate(SIMPLE9):
        own = np.flatnonzero(words >> 28 == sel)
        for k in range(many):
            out[begin[own] + k] = words[own] >> width * k & (1 << width) - 1
    whose, held = np.repeat(owner, count), np.bincount(owner, count, len(n)).astype(np.int64)
    return out[np.arange(len(out)) - (np.cumsum(held) - held)[whose] < n[whose]], n  # the last word is filled up


def _null(f):
    return lambda x: None if x is None or x is pd.NA or isinstance(x, float) else f(x)


def offsets(lists: pa.Array) -> np.ndarray:
    """Where each list, or string, begins and the last ends, in their values; a null one is empty."""
    size = pc.list_value_length(lists) if pa.types.is_list(lists.type) or pa.types.is_large_list(lists.type) else pc.binary_length(lists)
    return np.cumsum(np.append(0, size.fill_null(0).to_numpy(zero_copy_only=False)), dtype=np.int64)


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where a row's keys differ from those of the row before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _numbers(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False), offsets(lists)


def _like(values: np.ndarray, ends: np.ndarray, like: pa.Array, kind: pa.DataType | None = None) -> pa.Array:
    """Lists, or with a kind of bytes those, that are null where like is."""
    if kind is None:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values), mask=like.is_null() if like.null_count else None)
    raw = pa.BinaryArray.from_buffers(kind, len(like), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])
    return pc.if_else(like.is_valid(), raw, pa.scalar(None, kind)) if like.null_count else raw


def _bytes(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if data.null_count:
        data = data.fill_null(b"")
    ends = offsets(data)
    if not len(data) or not ends[-1]:
        return np.zeros(0, np.uint8), ends
    begin = np.frombuffer(data.buffers()[1], np.int32)[data.offset]
    return np.frombuffer(data.buffers()[2], np.uint8)[begin : begin + ends[-1]], ends


@F.arrow_udf(T.BinaryType())
def varbyte_encode(values: pa.Array) -> pa.Array:
    v, ends = _numbers(values)
    data, size = varbytes(v)
    return _like(data, np.append(0, np.cumsum(size))[ends], values, pa.binary())


@F.arrow_udf(T.ArrayType(T.LongType()))
def varbyte_decode(data: pa.Array) -> pa.Array:
    v, n = from_varbytes(*_bytes(data))
    return _like(v, np.append(0, np.cumsum(n)), data)


@F.arrow_udf(T.BinaryType())
def simple9_encode(values: pa.Array) -> pa.Array:
    words, n = simple9_lists(*_numbers(values))
    return _like(words, 4 * np.append(0, np.cumsum(n)), values, pa.binary())


@F.arrow_udf(T.ArrayType(T.LongType()))
def simple9_decode(data: pa.Array) -> pa.Array:
    b, ends = _bytes(data)
    v, n = from_simple9_lists(b.view("<u4"), ends // 4)
    return _like(v, np.append(0, np.cumsum(n)), data)


@F.pandas_udf(T.LongType())
def deflated_size(text: pd.Series) -> pd.Series:
    """Bytes of the text as UTF-8 after deflating."""
    return text.map(_null(lambda t: len(zlib.compress(t.encode("utf-8"))))).astype("Int64")


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """The x86 32-bit MurmurHash3, signed."""
    mask, h, n = 0xFFFFFFFF, seed, len(data)

    def scramble(k: int) -> int:
        k = k * 0xCC9E2D51 & mask
        k = (k << 15 | k >> 17) & mask
        return k * 0x1B873593 & mask

    for at in range(0, n - n % 4, 4):
        h ^= scramble(int.from_bytes(data[at : at + 4], "little"))
        h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & mask
    if n % 4:
        h ^= scramble(int.from_bytes(data[n - n % 4 :], "little"))
    h ^= n
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (h >> 31 << 32)


def murmur3_many(texts: list[bytes], seed: int = 0) -> np.ndarray:
    """murmur3_32 of many strings, four bytes of all of them at a time."""
    n = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(n) - n
    data = np.frombuffer(b"".join(texts) + bytes(4), np.uint8).astype(np.uint32)
    u, h = np.uint32, np.full(len(texts), seed, np.uint32)

    def turned(x: np.ndarray, r: int) -> np.ndarray:
        return x << u(r) | x >> u(32 - r)

    def scramble(k: np.ndarray) -> np.ndarray:
        return turned(k * u(0xCC9E2D51), 15) * u(0x1B873593)

    def four(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return sum((data[np.minimum(at + k, len(data) - 1)] * (k < size) << u(8 * k) for k in range(4)), np.zeros(len(at), np.uint32))

    for step in range(int(n.max()) // 4 if len(n) else 0):
        k = np.flatnonzero(n >= 4 * step + 4)
        h[k] = turned(h[k] ^ scramble(four(begin[k] + 4 * step, np.full(len(k), 4))), 13) * u(5) + u(0xE6546B64)
    k = np.flatnonzero(n % 4)
    h[k] ^= scramble(four(begin[k] + n[k] // 4 * 4, n[k] % 4))
    h ^= n.astype(np.uint32)
    h = (h ^ h >> u(16)) * u(0x85EBCA6B)
    h = (h ^ h >> u(13)) * u(0xC2B2AE35)
    return (h ^ h >> u(16)).view(np.int32)


@F.pandas_udf(T.IntegerType())
def murmur3(text: pd.Series) -> pd.Series:
    have = text[text.notna()]
    return pd.Series(murmur3_many([t.encode("utf-8") for t in have]), index=have.index).astype("Int32").reindex(text.index)


@F.arrow_udf(T.ArrayType(T.LongType()))
def cumulated(values: pa.Array) -> pa.Array:
    """Prefix sums of each array."""
    v, ends = _numbers(values)
    total = np.append(0, np.cumsum(v))
    return _like(total[1:] - np.repeat(total[ends[:-1]], np.diff(ends)), ends, values)


@F.arrow_udf(T.ArrayType(T.LongType()))
def differences(values: pa.Array) -> pa.Array:
    """The inverse of prefix sums: the first number of each array and the differences that follow."""
    v, ends = _numbers(values)
    gaps = np.diff(v, prepend=0)
    some = ends[:-1][np.diff(ends) > 0]
    gaps[some] = v[some]
    return _like(gaps, ends, values)
