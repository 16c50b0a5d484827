"""Exact deduplication with a log-structured merge index of text digests.

Map side: a memtable takes digest -> smallest doc_id; when full it is flushed as a run sorted by digest, cut at shard
borders. A document whose digest the memtable already holds is a hit at once and goes no further, so a text that a third of all
documents have sends one digest a memtable. Reduce side, for each shard: runs enter an index of levels, each sorted and with a Bloom filter. A
level is asked only if its filter may hold the digest; what a level knows is a hit, the smaller identifier stays, and what none
knows becomes a new level. Levels are compacted as soon as one isn't twice as large as the one after it, so their number is logarithmic, as
is what a digest costs. The number of shards follows the number of documents. A shard holds its distinct digests only; hits leave it as they are found, and get their
keeper by a join.

Hits are verified byte by byte against the kept document's text, so a digest collision can't remove a document: a keeper with more
than SALT hits is compared in several tasks, and hits that differ from the keeper's text are compared among themselves.

Defined cases: an empty table gives no rows; a null text equals nothing, an empty text equals an empty text; texts of any length are compared whole; rows with a null
doc_id are never reported (and stay in drop_copies()); rows repeated with the same doc_id are one document and not reported against themselves, and a doc_id with
several texts is reported if one of them is a copy; among equal texts (ties) the smallest doc_id stays; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, join_ids, renamed
from textloom.llm.textbytes import U, raw

MEMTABLE, PER_SHARD, FILTER_BITS, FILTER_HASHES, SALT = 200_000, 1_000_000, 10, 4, 10_000
DIGEST = np.dtype([("hi", ">u8"), ("lo", ">u8")])


class Filter:
    """Bloom filter over 16-byte digests (double hashing of the digest's halves)."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _at(d: np.ndarray, m: int) -> np.ndarray:
        hi, lo = d["hi"].astype(U), d["lo"].astype(U) | U(1)
        return np.stack([(hi + U(k) * lo) % U(m) for k in range(FILTER_HASHES)]).astype(np.int64)

    @classmethod
    def of(cls, d: np.ndarray) -> Filter:
        m = max(64, len(d) * FILTER_BITS // 8 * 8)
        flags = np.zeros(m, np.uint8)
        flags[cls._at(d, m).ravel()] = 1
        return cls(np.packbits(flags, bitorder="little"))

    def may_hold(self, d: np.ndarray) -> np.ndarray:
        at = self._at(d, len(self.bits) * 8)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0)


def compact(d: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests and identifiers sorted, each digest once with its smallest identifier; and digest and identifier of those that lost."""
    order = np.lexsort((i, d["lo"], d["hi"]))
    d, i = d[order], i[order]
    new = np.ones(len(d), bool)
    new[1:] = d[1:] != d[:-1]
    return d[new], i[new], d[~new], i[~new]


class Level:
    """A sorted run of distinct digests with a filter; hit: those of which another document was seen."""

    def __init__(self, d: np.ndarray, i: np.ndarray, hit: np.ndarray):
        order = np.lexsort((d["lo"], d["hi"]))
        self.d, self.i, self.hit, self.filter = d[order], i[order], hit[order], Filter.of(d)
        self.hi, self.lo = self.d["hi"].astype(U), self.d["lo"].astype(U)

    def find(self, d: np.ndarray) -> np.ndarray:
        """Place of each digest, -1 where it isn't here."""
        out = np.full(len(d), -1, np.int64)
        todo = np.flatnonzero(self.filter.may_hold(d))
        hi, lo = d["hi"].astype(U)[todo], d["lo"].astype(U)[todo]
        at = np.searchsorted(self.hi, hi)
        while len(todo):
            more = at < len(self.hi)
            more[more] = self.hi[at[more]] == hi[more]
            same = more.copy()
            same[more] = self.lo[at[more]] == lo[more]
            out[todo[same]] = at[same]
            more &= ~same  # the next of those with an equal first half
            todo, hi, lo, at = todo[more], hi[more], lo[more], at[more] + 1
        return out


class Index:
    """The levels of one shard, the largest first."""

    def __init__(self) -> None:
        self.levels: list[Level] = []

    def add(self, d: np.ndarray, i: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes a run of distinct digests; returns digest and identifier of the documents that lost."""
        lost_d, lost_i = [d[:0]], [i[:0]]
        for level in self.levels:
            at = level.find(d)
            k = np.flatnonzero(at >= 0)
            if not len(k):
                continue
            old, new = level.i[at[k]], i[k]
            differ = old != new
            level.i[at[k]] = np.minimum(old, new)
            level.hit[at[k]] |= differ | hit[k]
            lost_d.append(d[k][differ])
            lost_i.append(np.maximum(old, new)[differ])
            d, i, hit = d[at < 0], i[at < 0], hit[at < 0]
        if len(d):
            self.levels.append(Level(d, i, hit))
        while len(self.levels) > 1 and len(self.levels[-2].d) < 2 * len(self.levels[-1].d):
            y, x = self.levels.pop(), self.levels.pop()  # they have no digest in common
            self.levels.append(Level(np.concatenate([x.d, y.d]), np.concatenate([x.i, y.i]), np.concatenate([x.hit, y.hit])))
        return np.concatenate(lost_d), np.concatenate(lost_i)


RUN = "shard int, digests binary, ids binary, hit binary, lost_digests binary, lost_ids binary"
#: A document of which a smaller one with its digest is known, or (keeper) the smallest of a digest that has such.
SEEN = "hi bigint, lo bigint, doc_id bigint, keeper boolean"


def _rows(d: np.ndarray, i: np.ndarray, keeper: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(d["hi"].astype(U).view(np.int64)), pa.array(d["lo"].astype(U).view(np.int64)), pa.array(i), pa.array(np.full(len(d), keeper))], [c.split()[0] for c in SEEN.split(", ")])


def _runs(batches: Iterator[pa.RecordBatch], shards: int, memtable: int, size: int) -> Iterator[pa.RecordBatch]:
    table: dict[bytes, int] = {}
    lost: list[tuple[bytes, int]] = []

    def flush() -> pa.RecordBatch:
        d = np.frombuffer(b"".join(table), DIGEST)
        i = np.fromiter(table.values(), np.int64, len(table))
        d, i, _, _ = compact(d, i)
        ld = np.frombuffer(b"".join(x for x, _ in lost), DIGEST)
        li = np.array([x for _, x in lost], np.int64)
        hit = np.isin(d, np.unique(ld)) if len(ld) else np.zeros(len(d), bool)
        ends = np.searchsorted(((d["hi"].astype(U) >> U(32)) * U(shards)) >> U(32), np.arange(shards + 1, dtype=U))
        rows = [(s, d[a:b].tobytes(), i[a:b].tobytes(), hit[a:b].tobytes(), b"", b"") for s, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if a < b]
        rows[0] = (*rows[0][:4], ld.tobytes(), li.tobytes())  # of all shards: they don't go there
        table.clear()
        lost.clear()
        kinds = [pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in RUN.split(", ")])

    for batch in batches:
        data, offs = raw(batch.column("text"))
        view = memoryview(data)
        for k, doc in enumerate(batch.column("doc_id").to_pylist()):
            key = hashlib.blake2b(view[offs[k] : offs[k + 1]], digest_size=size).digest().ljust(16, b"\0")
            old = table.get(key)
            if old is None:
                table[key] = doc
            elif old != doc:
                lost.append((key, max(old, doc)))
                table[key] = min(old, doc)
        if len(table) + len(lost) >= memtable:
            yield flush()
    if table:
        yield flush()


def _lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, i in zip(batch.column("lost_digests").to_pylist(), batch.column("lost_ids").to_pylist(), strict=True):
            if d:
                yield _rows(np.frombuffer(d, DIGEST), np.frombuffer(i, np.int64), False)


def _compacted(batches: Iterator[pa.RecordBatch], memtable: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard: one shard's index is held at a time, and a buffer of small runs."""
    index, shard, held = Index(), None, 0
    parts: list[tuple[bytes, bytes, bytes]] = []

    def settle() -> Iterator[pa.RecordBatch]:
        nonlocal held
        if parts:
            d, i, hit = (np.frombuffer(b"".join(c), t) for c, t in zip(zip(*parts, strict=True), (DIGEST, np.int64, bool), strict=True))
            one, least, ld, li = compact(d, i)
            flag = np.isin(one, np.unique(np.concatenate([ld, d[hit]]))) if len(ld) or hit.any() else np.zeros(len(one), bool)
            yield _rows(ld, li, False)
            yield _rows(*index.add(one, least, flag), False)
            parts.clear()
            held = 0

    def close() -> Iterator[pa.RecordBatch]:
        yield from settle()
        for level in index.levels:
            yield _rows(level.d[level.hit], level.i[level.hit], True)
        index.levels.clear()

    for batch in batches:
        for s, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "digests", "ids", "hit")), strict=True):
            if s != shard:
                yield from close()
                shard = s
            parts.append(tuple(row))
            held += len(row[2])
            if held >= memtable:
                yield from settle()
    yield from close()


def exact_copies(docs: DataFrame, memtable: int = MEMTABLE, digest_bytes: int = 16) -> DataFrame:
    """(doc_id, keep_id): each document whose bytes equal those of one with a smaller doc_id, and the smallest such."""
    spark = docs.sparkSession
    shards = max(-(-docs.count() // PER_SHARD), int(spark.conf.get("spark.sql.shuffle.partitions")))
    src = renamed(docs, doc_id="doc_id", text="text").where("doc_id is not null and text is not null")
    runs = cut(src.mapInArrow(lambda it: _runs(it, shards, memtable, digest_bytes), RUN), "runs")
    merged = runs.select("shard", "digests", "ids", "hit").repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(lambda it: _compacted(it, memtable), SEEN)
    seen = cut(merged.unionAll(runs.select("lost_digests", "lost_ids").mapInArrow(_lost, SEEN)), "seen")
    keepers = cut(seen.where("keeper").select("hi", "lo", F.col("doc_id").alias("keeper")), "keepers")
    hits = cut(join_ids(seen.where("not keeper").select("hi", "lo", "doc_id"), keepers, ["hi", "lo"], "inner").where("doc_id <> keeper").select("doc_id", "keeper").distinct(), "hits")

    hot = cut(hits.groupBy("keeper").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts")).where("salts > 1"), "hot")
    salts = F.coalesce("salts", F.lit(1))
    few = join_ids(hits, hot, "keeper", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int")).select("doc_id", "keeper", "salt")
    kept = join_ids(hits.select("keeper").distinct(), hot, "keeper", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("keeper", "salt")
    kept = join_ids(src.select(F.col("doc_id").alias("keeper"), F.col("text").alias("kept")), cut(kept, "kept"), "keeper", "inner")
    checked = join_ids(src, cut(few, "few"), "doc_id", "inner").join(kept, ["keeper", "salt"]).select("doc_id", "keeper", (F.col("text") == F.col("kept")).alias("same"))
    checked = cut(checked.groupBy("doc_id", "keeper").agg(F.max("same").alias("same")), "checked")
    out = checked.where("same").select("doc_id", F.col("keeper").alias("keep_id"))
    other = checked.where("not same").select("doc_id", "keeper")
    if not other.isEmpty():  # equal digests of different bytes
        texts = src.join(other, "doc_id")
        first = texts.groupBy("keeper", "text").agg(F.min("doc_id").alias("keep_id"))
        out = out.unionAll(texts.join(first, ["keeper", "text"]).where("doc_id <> keep_id").select("doc_id", "keep_id"))
    # a document may lose more than once on its way: its last keeper is the smallest
    return out.groupBy("doc_id").agg(F.min("keep_id").alias("keep_id"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs less every document that exact_copies reports."""
    return join_ids(docs, cut(exact_copies(docs).select("doc_id"), "copies"), "doc_id", "left_anti")
