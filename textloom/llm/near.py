"""N-gram Jaccard join with signature trees.

Every document becomes the set of its word 3-grams (words: runs of letters and digits, lower case; a text of one or two
words has one gram). Documents with equal sets are one node of the join, with the number of its documents. Band keys of min-hashes route
sets that may be similar to the same group; inside a group two signature trees are joined: leaves are sets, inner nodes hold the
OR of their children's token bitmaps, the size range and the largest number of tokens that share a bit. The dual
traversal drops a pair of nodes when no pair below it can reach the needed overlap. What remains is verified on the exact sets.

A group of more than BLOCK sets, or of more than BLOCK_TOKENS tokens a block, is split: its sets fall into blocks by hash, and every
pair of blocks (and every block by itself) is a cell of its own, so that a hot group is many tasks' work of bounded size. Groups
are only ever counted and hashed as wholes, and groups of the same sets in several bands are worked off once.

A cell gives what follows from its pairs: for each set the number of similar documents, and a star of links to the smallest set
of each connected part. So what leaves the cells grows with the sets, though the pairs of a family grow with its square; similar_pairs() lists them.

Routing is the only approximate step: a pair of similarity s is missed with probability (1 - s^2)^BANDS, 3e-4 at 0.5
and 2e-8 at 0.7. No group, partner list or candidate list is capped.

Defined cases: an empty table gives no rows; a row with a null doc_id is left out of the join (and stays in drop_near_copies()); a null or empty text,
or one without a word, has no partner and a class of its own; texts of any length are taken whole; rows repeated with one doc_id
are one document, and a doc_id with several texts has the links of each of them; equal texts have Jaccard 1; a class is named
by its smallest doc_id, so ties don't matter; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, join_ids, renamed
from textloom.llm.textbytes import U, mix, slices, words

NGRAM, THRESHOLD, BANDS, FANOUT = 3, 0.5, 28, 8
#: Bytes of bitmaps that a traversal compares at once.
FRONTIER = 4 << 20
#: Largest number of sets, and of their tokens, in a block of a group.
BLOCK, BLOCK_TOKENS = 2048, 1 << 20
_SEEDS = mix(np.arange(1, 2 * BANDS + 1, dtype=U)) | U(1)

SKETCH = "doc_id bigint, h1 bigint, h2 bigint, size int, bands array<bigint>, bits binary"
SKETCH_NAMES = [c.split()[0] for c in SKETCH.split(", ")]


def bitmap(grams: np.ndarray) -> bytes:
    """One bit for each token, in 2 to 4 bits a token; halves of a wider bitmap may be ORed to get a narrower one."""
    n = max(64, 1 << int(2 * len(grams) - 1).bit_length())
    out = np.zeros(n, np.uint8)
    out[(grams & U(n - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _sketches(batches: Iterator[pa.RecordBatch], ngram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            g, doc = words(part.column("text")).grams(ngram)
            g_of = np.bincount(doc, minlength=len(part)) if len(g) else np.zeros(len(part), np.int64)
            if len(none := np.flatnonzero(g_of == 0)):
                zero = pa.array(np.zeros(len(none), np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(none)), zero, zero, zero.cast(pa.int32()), pa.array([[]] * len(none), pa.list_(pa.int64())), pa.array([b""] * len(none), pa.binary())], SKETCH_NAMES)
            if not len(g):
                continue
            have, begin = np.unique(doc, return_index=True)
            low = np.stack([np.minimum.reduceat(g * s, begin) for s in _SEEDS], axis=1)
            bands = mix(low[:, 0::2] * U(0x9E3779B97F4A7C15) + mix(low[:, 1::2].copy())) ^ _SEEDS[:BANDS]
            h1, h2, size, bits = [], [], [], []
            for a, b in zip(begin, [*begin[1:], len(g)], strict=True):
                s = np.sort(g[a:b])
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
                h1.append(int(s.sum().view(np.int64)))
                h2.append(int(mix(s * U(0xFF51AFD7ED558CCD)).sum().view(np.int64)))
                size.append(len(s))
                bits.append(bitmap(s))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(have)),
                    pa.array(h1, pa.int64()),
                    pa.array(h2, pa.int64()),
                    pa.array(size, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(have) + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64).ravel())),
                    pa.array(bits, pa.binary()),
                ],
                SKETCH_NAMES,
            )


class Tree:
    """Levels from the documents up; each has bitmaps, size range and largest excess (tokens less bits) of its nodes."""

    def __init__(self, bits: np.ndarray, size: np.ndarray):
        excess = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, size, size, excess)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, ex = self.levels[-1]
            at = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at)))


def dual(x: Tree, y: Tree, same: bool, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of documents that may have Jaccard of t or more; with same, each unordered pair once."""
    lx, ly = len(x.levels) - 1, len(y.levels) - 1
    most_pairs = max(256, FRONTIER // x.levels[0][0][0].nbytes)
    todo = [(lx, ly, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        a, b, i, j = todo.pop()
        if len(i) > most_pairs:
            todo += [(a, b, i[k : k + most_pairs], j[k : k + most_pairs]) for k in range(0, len(i), most_pairs)]
            continue
        bx, lox, hix, ex = x.levels[a]
        by, loy, hiy, ey = y.levels[b]
        ok = (hix[i] >= t * loy[j]) & (hiy[j] >= t * lox[i])
        if same and a == b == 0:
            ok &= i < j
        i, j = i[ok], j[ok]
        most = np.bitwise_count(bx[i] & by[j]).sum(1, dtype=np.int64) + np.minimum(ex[i], ey[j])
        ok = np.minimum(most, np.minimum(hix[i], hiy[j])) >= t / (1 + t) * (lox[i] + loy[j]) - 1e-6
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if a == b == 0:
            yield i, j
            continue
        if a >= b:
            c = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            j = np.repeat(j, FANOUT)
            keep = c < len(x.levels[a - 1][0])
            i, j, a = c[keep], j[keep], a - 1
        else:
            c = (j[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            i = np.repeat(i, FANOUT)
            keep = c < len(y.levels[b - 1][0])
            i, j, b = i[keep], c[keep], b - 1
        if same and a == b:
            ok = i <= j
            i, j = i[ok], j[ok]
        todo.append((a, b, i, j))


def _wide(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps folded to width bytes."""
    return np.stack([np.bitwise_or.reduce(np.frombuffer(b, U).reshape(-1, width // 8), axis=0) for b in bits])


def tree_join(bits: list[bytes], size: np.ndarray, order: np.ndarray, t: float, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate index pairs of one group; with side only pairs of a document with side False and one with side True.

    Documents are treed by bitmap width, so that a node's OR stays telling."""
    width = np.array([len(b) for b in bits])

    def by_width(which: np.ndarray) -> dict[int, np.ndarray]:
        return {w: (k := np.flatnonzero(which & (width == w)))[np.lexsort((size[k], order[k]))] for w in np.unique(width[which])}

    def tree(k: np.ndarray, w: int) -> Tree:
        return Tree(_wide([bits[i] for i in k], w), size[k])

    if side is None:
        at = by_width(np.ones(len(bits), bool))
        for w, own in at.items():
            mine = tree(own, w)
            for i, j in dual(mine, mine, True, t):
                yield own[i], own[j]
            for v, other in at.items():
                if w < v <= w * 2 / t:
                    for i, j in dual(mine, tree(other, w), False, t):
                        yield own[i], other[j]
        return
    left, right = by_width(~side), by_width(side)
    for w, own in left.items():
        for v, other in right.items():
            if max(v, w) <= min(v, w) * 2 / t:
                for i, j in dual(tree(own, min(v, w)), tree(other, min(v, w)), False, t):
                    yield own[i], other[j]


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal key of the sorted rows of a partition."""
    rest: list[pa.Table] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        tab, k = pa.Table.from_batches([batch]), batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if rest and k[a] != last:
                yield pa.concat_tables(rest)
                rest = []
            rest.append(tab.slice(a, b - a))
            last = k[a]
    if rest:
        yield pa.concat_tables(rest)


#: A set in a cell: its partners there, by number; sets without any are left out unless they are a partner.
ROLE = "gid bigint, sid bigint, partners array<bigint>"


def _candidates(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    for g in _groups(batches, "gid"):
        sid, one = np.unique(g.column("sid").to_numpy(), return_index=True)
        g = g.take(pa.array(one))
        size, block, band = (g.column(c).to_numpy() for c in ("size", "block", "band"))
        side = None if g.column("diagonal")[0].as_py() else block > block.min()
        if len(sid) < 2 or (side is not None and not side.any()):
            continue
        bands = g.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        before, a, b = bands[:, : band[0]], [], []
        for i, j in tree_join(g.column("bits").to_pylist(), size.astype(np.int64), bands[:, 0], t, side):
            # each pair belongs to the first band in which its keys agree
            own = ~(before[i] == before[j]).any(1)
            a.append(np.minimum(i[own], j[own]).astype(np.int32))
            b.append(np.maximum(i[own], j[own]).astype(np.int32))
        if not sum(map(len, a)):
            continue
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.argsort(a, kind="stable")
        named = np.unique(np.concatenate([a, b]))
        n = np.bincount(a, minlength=len(sid))[named]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(named), g.column("gid")[0].as_py())), pa.array(sid[named]), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(sid[b[order]]))],
            ["gid", "sid", "partners"],
        )


def _verified(batches: Iterator[pa.RecordBatch], ngram: int, t: float) -> Iterator[tuple[np.ndarray, ...]]:
    """For each cell: sid and weight of its sets, and of its similar pairs both indices, the common grams and the Jaccard similarity."""
    for g in _groups(batches, "gid"):
        sets: list[np.ndarray] = []
        for batch in g.select(["text"]).combine_chunks().to_batches():
            for part in slices(batch, "text"):
                h, doc = words(part.column("text")).grams(ngram)
                sets += [np.unique(x) for x in np.split(h, np.searchsorted(doc, np.arange(1, len(part))))]
        # a doc_id with several texts comes with each of them: the one that made the set counts
        right = np.array([int(s.sum().view(np.int64)) for s in sets]) == g.column("h1").to_numpy()
        sid, one = np.unique(g.column("sid").to_numpy()[right], return_index=True)
        g = g.take(pa.array(np.flatnonzero(right)[one]))
        sets = [sets[k] for k in np.flatnonzero(right)[one]]
        ids, local = np.unique(np.concatenate(sets), return_inverse=True)
        size = np.array([len(s) for s in sets])
        begin = np.cumsum(size) - size
        mark = np.zeros(len(ids), bool)
        found: list[list[np.ndarray]] = [[], [], [], []]
        partners = g.column("partners").combine_chunks()
        lists, ends = partners.flatten().to_numpy(), np.cumsum(partners.value_lengths().fill_null(0).to_numpy())
        for k in range(len(sid)):
            q = np.searchsorted(sid, lists[ends[k - 1] if k else 0 : ends[k]])
            if not len(q):
                continue
            own = local[begin[k] : begin[k] + size[k]]
            mark[own] = True
            upto = np.cumsum(size[q])
            both = np.add.reduceat(mark[local[np.arange(upto[-1]) + np.repeat(begin[q] - upto + size[q], size[q])]], upto - size[q], dtype=np.int64)
            mark[own] = False
            union = size[k] + size[q] - both
            ok = both >= t * union - 1e-9
            for c, v in zip(found, (np.full(int(ok.sum()), k), q[ok], both[ok], both[ok] / union[ok]), strict=True):
                c.append(v)
        if found[0]:
            yield sid, g.column("weight").to_numpy(), *(np.concatenate(c) for c in found)


PAIR = "sid_a bigint, sid_b bigint, n bigint, jaccard double"
#: A link of a set to the smallest of its part of a cell, and the number of documents similar to it there.
LINK = "a bigint, b bigint, links bigint"


def _pairs(batches: Iterator[pa.RecordBatch], ngram: int, t: float) -> Iterator[pa.RecordBatch]:
    for sid, _, a, b, n, jaccard in _verified(batches, ngram, t):
        yield pa.RecordBatch.from_arrays([pa.array(sid[a]), pa.array(sid[b]), pa.array(n), pa.array(jaccard)], [c.split()[0] for c in PAIR.split(", ")])


def _links(batches: Iterator[pa.RecordBatch], ngram: int, t: float) -> Iterator[pa.RecordBatch]:
    for sid, weight, a, b, _, _ in _verified(batches, ngram, t):
        n = np.bincount(a, weight[b], len(sid)) + np.bincount(b, weight[a], len(sid))
        root = np.arange(len(sid))
        while True:  # the smallest index of each connected part
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            low = np.minimum(low, low[low])
            if (low == root).all():
                break
            root = low
        k = np.flatnonzero(n > 0)
        yield pa.RecordBatch.from_arrays([pa.array(sid[k]), pa.array(sid[root[k]]), pa.array(n[k].astype(np.int64))], ["a", "b", "links"])


def similar_sets(docs: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, members, cells): sets has sid, rep (its smallest doc_id), size and weight (number of documents) of each distinct set;
    members has doc_id and sid; cells has the rows that _verified() takes."""
    src = renamed(docs, doc_id="doc_id", text="text").where("doc_id is not null")
    sketch = cut(src.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lambda it: _sketches(it, ngram), SKETCH), "sketches")
    sets = sketch.where("size > 0").groupBy("h1", "h2", "size").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    sets = cut(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")
    members = cut(sketch.select("doc_id", "h1", "h2", "size").join(sets.select("h1", "h2", "size", "sid"), ["h1", "h2", "size"], "left").select("doc_id", "sid").distinct(), "members")
    weights = cut(members.where("sid is not null").groupBy("sid").agg(F.count("*").alias("weight")).where("weight > 1"), "weights")
    sets = join_ids(sets, weights, "sid", "left").withColumn("weight", F.coalesce("weight", F.lit(1)))

    keys = sets.select("sid", "size", F.posexplode("bands").alias("band", "key"))
    groups = keys.groupBy("key").agg(
        F.min("band").alias("band"), F.count("*").alias("n"), F.sum("size").alias("tokens"), F.bit_xor(F.xxhash64("sid")).alias("x1"), F.bit_xor(F.xxhash64("sid", F.lit(7))).alias("x2")
    ).where("n > 1")
    # groups of the same sets: the first band's stays
    groups = groups.groupBy("n", "x1", "x2").agg(F.min(F.struct("band", "key")).alias("first"), F.max("tokens").alias("tokens"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    groups = cut(groups.select("first.key", F.col("first.band").alias("own_band"), blocks.alias("blocks")), "groups")
    rows = join_ids(keys.select("sid", "key"), groups, "key", "inner").withColumnRenamed("own_band", "band")
    rows = rows.join(sets.select("sid", "size", "bands", "bits"), "sid").withColumn("block", F.expr("cast(pmod(xxhash64(sid, 3), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("diagonal", F.col("block") == F.col("other"))
    rows = rows.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("gid"), "sid", "band", "size", "bands", "bits", "block", "diagonal")
    roles = cut(rows.repartition("gid").sortWithinPartitions("gid").mapInArrow(lambda it: _candidates(it, threshold), ROLE), "candidates")
    named = cut(join_ids(sets.select("sid", "rep", "h1", "weight"), cut(roles.select("sid").distinct(), "named"), "sid"), "reps")
    texts = join_ids(src.where("text is not null"), named.withColumnRenamed("rep", "doc_id"), "doc_id", "inner").select("sid", "h1", "weight", "text")
    cells = roles.join(texts, "sid").select("gid", "sid", "h1", "weight", "partners", "text").repartition("gid").sortWithinPartitions("gid")
    return sets.select("sid", "rep", "size", "weight"), members, cells


def similar_pairs(docs: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs doc_a < doc_b with n-gram Jaccard of threshold or more: doc_a, doc_b, n_common, jaccard."""
    sets, members, cells = similar_sets(docs, ngram, threshold)
    pairs = cut(cells.mapInArrow(lambda it: _pairs(it, ngram, threshold), PAIR), "pairs")
    same = sets.where("weight > 1").select(F.col("sid").alias("sid_a"), F.col("sid").alias("sid_b"), F.col("size").cast("bigint").alias("n"), F.lit(1.0).alias("jaccard"))
    sides = [members.select(F.col("sid").alias(f"sid_{c}"), F.col("doc_id").alias(c)) for c in "ab"]
    return (
        pairs.unionAll(same).join(sides[0], "sid_a").join(sides[1], "sid_b").where("a <> b and (sid_a <> sid_b or a < b)")
        .groupBy(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).agg(F.max(F.struct("jaccard", "n")).alias("best"))
        .select("doc_a", "doc_b", F.col("best.n").alias("n_common"), F.round("best.jaccard", 6).alias("jaccard"))
    )


def classes(docs: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and n_links of every document: the smallest doc_id of its class (of documents that links connect), and with how
    many other documents its n-gram Jaccard is threshold or more."""
    sets, members, cells = similar_sets(docs, ngram, threshold)
    links = cut(cells.mapInArrow(lambda it: _links(it, ngram, threshold), LINK), "links")
    several = members.where("sid is not null").groupBy("doc_id").agg(F.min("sid").alias("a"), F.count("*").alias("n")).where("n > 1").select("doc_id", "a")
    several = members.join(several, "doc_id").select("a", F.col("sid").alias("b"))
    roots = components(links.select("a", "b").unionAll(several))
    counts = cut(links.groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links")), "counts")
    linked = cut(join_ids(join_ids(sets, roots.withColumnRenamed("id", "sid"), "sid", "left"), counts, "sid", "left").select("sid", "rep", F.coalesce("root", "sid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")), "linked")
    named = linked.groupBy("root").agg(F.min("rep").alias("class_id"))
    every = members.join(linked.join(named, "root").select("sid", "class_id", "links"), "sid", "left")
    return every.groupBy("doc_id").agg(F.coalesce(F.min("class_id"), F.col("doc_id")).alias("class_id"), F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of the connected component of each id in edges (a, b), by hooking and pointer jumping."""
    both = cut(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    state = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        seen = both.join(state.withColumnsRenamed({"id": "b", "root": "r"}), "b").groupBy(F.col("a").alias("id")).agg(F.min("r").alias("r"))
        low = state.join(seen, "id", "left").select("id", "root", F.least("root", F.coalesce("r", "root")).alias("low"))
        # follow the new root to its own root
        up = state.select(F.col("id").alias("low"), F.col("root").alias("above"))
        after = cut(low.join(up, "low", "left").select("id", "root", F.least("low", F.coalesce("above", "low")).alias("new")), "roots")
        if after.where("new <> root").isEmpty():
            return after.select("id", "root")
        state = after.select("id", F.col("new").alias("root"))


def drop_near_copies(docs: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """docs less all but the smallest doc_id of each class of similar documents.

    Rows without doc_id, text or words stay, and so do all rows of a doc_id that stays."""
    gone = cut(classes(docs, ngram, threshold).where("class_id <> doc_id").select("doc_id"), "gone")
    return join_ids(docs, gone, "doc_id", "left_anti")
