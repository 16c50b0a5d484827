"""Inverted index: distinct terms, posting lists in blocks of document ids, delta coding and its inverse.

A term that every document has would make one posting list as long as the corpus, so a list is cut into blocks of BLOCK consecutive
document ids; a row's size is bounded whatever the corpus. Null texts and null ids have no postings.

Each task inverts CHUNK words at a time, so that a list is shuffled in a few parts and not as a row a document. The parts of many lists go
together in a row, by buckets of terms and blocks; a bucket's parts are sorted where they arrive, and those of a list merged as they pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.codecs import cumulated, differences, offsets, starts
from textloom.functions.words import bytes_of, splitter, word_edges

#: Consecutive document ids of a list; words, repeats counted, and their bytes, that a task inverts at a time; rows and numbers of a batch that leaves it.
BLOCK, CHUNK, CHUNK_BYTES, ROWS = 1 << 20, 1 << 21, 1 << 25, 1 << 15
TYPES = {"term": "string", "docs": "array<bigint>"}
PARTS = pa.schema([("term", pa.string()), ("block", pa.int64()), ("at", pa.list_(pa.int32()))])
POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


@dataclass(frozen=True)
class Stored:
    """A written index: posting lists (term, block, df, docs), sorted by term within each file, and the identifiers of all documents."""

    postings: DataFrame
    universe: DataFrame

    def docs(self, *terms: str) -> DataFrame:
        """term, doc_id of the terms. The filter reaches the Parquet scan, where pages and row groups are in the order of terms."""
        one = F.col("term") == terms[0] if len(terms) == 1 else F.col("term").isin(*terms)
        return self.postings.where(one).select("term", F.explode("docs").alias("doc_id"))

    def df(self, *terms: str) -> dict[str, int]:
        """Document frequency of the terms that are known: a row for each."""
        rows = self.postings.where(F.col("term").isin(*terms)).groupBy("term").agg(F.sum("df").alias("df")).collect()
        return {r.term: r.df for r in rows}


def store(docs: DataFrame, path: str) -> Stored:
    """Writes the index of docs to path, once for all searches."""
    postings(docs).write.mode("overwrite").parquet(f"{path}/postings")
    docs.where("doc_id is not null").select("doc_id").distinct().write.mode("overwrite").parquet(f"{path}/documents")
    return opened(docs.sparkSession, path)


def opened(spark: SparkSession, path: str) -> Stored:
    return Stored(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/documents"))


def term_docs(docs: DataFrame) -> DataFrame:
    """Distinct (term, doc_id). Terms are made distinct within the row, so nothing is shuffled; repeated rows of a document repeat."""
    return docs.where("doc_id is not null and text is not null").select("doc_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("term")).select("term", "doc_id")


def term_df(docs: DataFrame) -> DataFrame:
    """term and its document frequency."""
    return term_docs(docs).groupBy("term").agg(F.countDistinct("doc_id").alias("df"))


def ordered(key: np.ndarray) -> np.ndarray:
    """The distinct numbers, ascending; sorts key."""
    key.sort()
    return key[starts(key)]


def parts_of(block: int, edges: np.ndarray | None = None):
    """Batches of (doc_id, words) to the parts of lists: term, block, at (ascending places in the block). With edges, of (doc_id, lower-case text),
    which is split here."""

    def part(docs: list[pa.Array], words: list[pa.Array], sizes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        coded = pa.concat_arrays(words).dictionary_encode()
        ids, rank = np.unique(pa.concat_arrays(docs).to_numpy(), return_inverse=True)
        # one number for a term and a document: sorted and without repeats, this is the lists
        key = ordered(coded.indices.to_numpy().astype(np.int64) << 32 | np.repeat(rank, np.concatenate(sizes)))
        term, doc = key >> 32, ids[key & 0xFFFFFFFF]
        home = np.where(doc < 0, -(-doc // block), doc // block)
        begin = starts(term, home)
        ends = np.append(begin, len(key))
        for rows, values in sliced(ends):
            at = pa.ListArray.from_arrays(pa.array(ends[rows.start : rows.stop + 1] - values.start, pa.int32()), pa.array((doc - home * block)[values], pa.int32()))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(term[begin[rows]])), pa.array(home[begin[rows]]), at], ["term", "block", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = (lambda lists: (lists.flatten(), np.diff(offsets(lists)))) if edges is None else splitter(edges)
        docs, words, sizes, n, size = [], [], [], 0, 0
        for batch in batches:
            for at in range(0, len(batch), 200):  # long texts: a batch may have more than a chunk
                few = batch.slice(at, 200)
                values, each = split(few.column(1))
                docs.append(few.column(0))
                words.append(values)
                sizes.append(each)
                n, size = n + len(values), size + pc.sum(pc.binary_length(values), min_count=0).as_py()
                if n >= CHUNK or size >= CHUNK_BYTES:
                    yield from part(docs, words, sizes)
                    docs, words, sizes, n, size = [], [], [], 0, 0
        if docs:
            yield from part(docs, words, sizes)

    return run


def hashed(term: pa.StringArray, home: np.ndarray) -> np.ndarray:
    """A number from 0 to 2^31 of each term and block, the same in all tasks."""
    raw, ends = bytes_of(term)
    place = np.arange(len(raw)) - np.repeat(ends[:-1], np.diff(ends))
    sums = np.append(np.uint64(0), np.cumsum((raw + np.uint64(1)) * POWERS[place % len(POWERS)]))
    mixed = (sums[ends[1:]] - sums[ends[:-1]] + home.astype(np.uint64)) * POWERS[0]
    return ((mixed ^ mixed >> np.uint64(32)) * POWERS[1] >> np.uint64(33)).astype(np.int64)


def packed(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Parts of lists to bucket, parts: those of a bucket in one value, an Arrow message, as a row for each costs far more to shuffle and to sort."""

    def pack(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = joined(parts)
        bucket = hashed(rows.column(0), rows.column(1).to_numpy()) % buckets
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows.take(pa.array(order)), bucket[order]
        at = np.append(starts(bucket), len(bucket))
        for k in range(0, len(at) - 1, 1000):
            few = at[k : k + 1001]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[few[:-1]], pa.int32()), pa.array([rows.slice(a, b - a).serialize().to_pybytes() for a, b in zip(few, few[1:])], pa.binary())], ["bucket", "parts"])

    few, n = [], 0
    for batch in batches:
        few.append(batch)
        n += len(batch.column(2).flatten())
        if n >= CHUNK // 2:
            yield from pack(few)
            few, n = [], 0
    if n:
        yield from pack(few)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of packed in the order of buckets to parts of lists, those of a list one after another. Whole buckets are held at a time."""

    def group(values: list[pa.Buffer]) -> Iterator[pa.RecordBatch]:
        rows = joined([pa.ipc.read_record_batch(v, PARTS) for v in values])
        blocks, home = np.unique(rows.column(1).to_numpy(), return_inverse=True)
        order = np.argsort(rows.column(0).dictionary_encode().indices.to_numpy().astype(np.int64) * len(blocks) + home, kind="stable")
        for k in range(0, len(order), ROWS):
            yield rows.take(pa.array(order[k : k + ROWS]))

    few, size, last = [], 0, None
    for batch in batches:
        for bucket, value in zip(batch.column(0).to_numpy(), batch.column(1)):
            if bucket != last and size >= CHUNK_BYTES // 8:
                yield from group(few)
                few, size = [], 0
            few.append(value.as_buffer())
            size, last = size + few[-1].size, bucket
    if few:
        yield from group(few)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(k) for b in batches]) for k in range(len(PARTS))], schema=PARTS)


def bucket_count(docs: DataFrame) -> int:
    """So many that a bucket has a few MB of texts, as the plan estimates them, and a shuffle partition several buckets."""
    estimate = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), estimate >> 22), 1 << 16)


def sliced(ends: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Rows, and the values of their lists, of batches of at most ROWS rows and little more than 16 * ROWS values; list k is ends[k]:ends[k + 1]."""
    at, n = 0, len(ends) - 1
    while at < n:
        to = min(at + ROWS, n, max(at + 1, int(np.searchsorted(ends, ends[at] + 16 * ROWS))))
        yield slice(at, to), slice(int(ends[at]), int(ends[to]))
        at = to


def merged(block: int, long: bool):
    """Parts of lists in the order of (term, block) to whole ones: term, block, df, docs; long: term, block, doc_id, gap and nth (from 1) of each posting."""

    def out(term: pa.Array, home: np.ndarray, at: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = np.diff(ends)
        docs = at + np.repeat(home, size) * block
        if not long:
            for rows, values in sliced(ends):
                lists = pa.ListArray.from_arrays(pa.array(ends[rows.start : rows.stop + 1] - values.start, pa.int32()), pa.array(docs[values]))
                yield pa.RecordBatch.from_arrays([term.slice(rows.start, rows.stop - rows.start), pa.array(home[rows]), pa.array(size[rows]), lists], ["term", "block", "df", "docs"])
            return
        gap, nth, owner = np.diff(docs, prepend=0), np.arange(1, len(docs) + 1) - np.repeat(ends[:-1], size), np.repeat(np.arange(len(size)), size)
        gap[ends[:-1]] = docs[ends[:-1]]
        for k in range(0, len(docs), ROWS):
            few = slice(k, k + ROWS)
            yield pa.RecordBatch.from_arrays([term.take(pa.array(owner[few])), pa.array(home[owner[few]]), pa.array(docs[few]), pa.array(gap[few]), pa.array(nth[few])], ["term", "block", "doc_id", "gap", "nth"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the list that may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            term, home, at, ends = batch.column(0), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy(), offsets(batch.column(2))
            if last:
                term, home, at, ends = pa.concat_arrays([last[0], term]), np.append(last[1], home), np.append(last[2], at), np.append(0, ends + len(last[2]))
            coded = pc.run_end_encode(term).run_ends.to_numpy()
            first = starts(np.searchsorted(coded, np.arange(len(term)), "right"), home)
            run_of_row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(term))))
            key = ordered(np.repeat(run_of_row, np.diff(ends)) << 32 | at.astype(np.int64) + (1 << 31))
            owner, at = key >> 32, (key & 0xFFFFFFFF) - (1 << 31)
            term, home, ends = term.take(pa.array(first)), home[first], np.searchsorted(owner, np.arange(len(first) + 1))
            cut = int(ends[-2])
            yield from out(term.slice(0, len(term) - 1), home[:-1], at[:cut], ends[:-1])
            last = term.slice(len(term) - 1), home[-1:], at[cut:]
        if last:
            yield from out(*last, np.array([0, len(last[2])]))

    return run


def _lists(docs: DataFrame, block: int, *names: str) -> DataFrame:
    """The columns of merged that are named, long if there is one of a posting; the others never leave Python."""
    if block > 1 << 31:
        raise ValueError("a block has at most 2^31 document ids")
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), F.lower("text").alias("text"))
    inverted, whole, buckets = parts_of(block, word_edges()), merged(block, "doc_id" in names), bucket_count(docs)
    parts = rows.mapInArrow(lambda batches: packed(inverted(batches), buckets), "bucket int, parts binary").repartition("bucket").sortWithinPartitions("bucket")
    return parts.mapInArrow(lambda batches: (b.select(names) for b in whole(unpacked(batches))), ", ".join(f"{n} {TYPES.get(n, 'bigint')}" for n in names))


def postings(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """term, block, df (in the block) and ascending docs; each partition is in the order of (term, block)."""
    return _lists(docs, block, "term", "block", "df", "docs").sortWithinPartitions("term", "block")


def deltas(posting: DataFrame) -> DataFrame:
    """postings with gaps instead of docs; the first of a block is whole."""
    return posting.select("term", "block", "df", differences("docs").alias("gaps"))


def undelta(coded: DataFrame) -> DataFrame:
    """postings back from gaps, by prefix sums."""
    return coded.select("term", "block", "df", cumulated("gaps").alias("docs"))


def delta_rows(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """term, doc_id, gap, block: long form of the coded index."""
    return _lists(docs, block, "term", "doc_id", "gap").withColumn("block", F.expr(f"doc_id div {block}"))


def decoded_rows(coded: DataFrame) -> DataFrame:
    """term, doc_id from rows of (term, block, gap) in the order of ord."""
    w = W.partitionBy("term", "block").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return coded.select("term", F.sum("gap").over(w).alias("doc_id"))


def skips(docs: DataFrame, every: int = 50, block: int = BLOCK) -> DataFrame:
    """term, nth (place in the list, from 1), doc_id and gap to the skip before, of every 50th posting."""
    w = W.partitionBy("term", "block").orderBy("doc_id")
    kept = _lists(docs, block, "term", "block", "doc_id", "nth").where(F.col("nth") % every == 0)
    return kept.select("term", "nth", "doc_id", (F.col("doc_id") - F.coalesce(F.lag("doc_id").over(w), F.lit(0))).alias("gap"))
