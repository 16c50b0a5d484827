"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document of source s gets the key -ln(u) / w: u in (0, 1) from a hash of seed and doc_id, w its quality weight.
Documents sorted by key within their source are a weighted random order without replacement. With a budget of B_s
tokens and T_s tokens in all, every document is taken floor(B_s / T_s) times (complete epochs), and then the first documents
of the order whose prefix sum of tokens stays within the rest are taken once more. A document whose weight isn't known has the mean
weight of the known ones of its source.

The prefix sums don't sort a source in one task: keys fall into buckets in key order, bucket totals are summed over
the (few) buckets, and only the documents of the bucket at the border are sorted. The buckets are even whatever the weights are, as the bucket is the
share of the source's documents that have a smaller key by the weights' distribution; their number follows the number of documents.

Defined cases: an empty table gives no rows; a null source is a source of its own; a null doc_id, or a null or empty text (no token), is never
taken; texts of any length count whole; a weight of 0 or less excludes from the fractional pass, a null one is unknown, and where none of a source is known
it is DEFAULT_WEIGHT; ties in the key go by doc_id, then by number of tokens; rows repeated with one doc_id count one after another, in selected() and in mixed();
sources without a target share what the targets leave, by tokens; other columns, whatever their names, are ignored by selected() and kept by mixed().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textloom.llm.common import BROADCAST_IDS, cut, private, renamed

SEED, PER_BUCKET, DEFAULT_WEIGHT = 17, 20_000, 1.0
#: Target shares of the mixture; all other sources share the rest in proportion to their tokens.
TARGETS = {"src0": 0.15, "src1": 0.15, "src2": 0.10, "src3": 0.05}
#: The mixture's tokens as a multiple of the corpus's.
BUDGET = 0.6


def tokens(text: Column) -> Column:
    """White-space-separated words of a text."""
    return F.regexp_count(text, F.lit("[^ \\t\\r\\n\\f\\x0b]+")).cast("bigint")


def uniform(seed: int, doc_id: Column) -> Column:
    """(h + 1) / (2^52 + 2) with h the first 52 bits of md5(seed-doc_id)."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), doc_id.cast("string"))), 1, 13), 16, 10).cast("double") + 1) / F.lit(float(2**52 + 2))


def selected(docs: DataFrame, weights: DataFrame | None, targets: dict[str, float] | None = None, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """doc_id, source, n_tokens, key, copies of each row of docs that is taken at least once.

    weights has doc_id and weight."""
    targets = TARGETS if targets is None else targets
    src = renamed(docs, doc_id="doc_id", text="text", source="source").where("doc_id is not null").select("doc_id", "source", tokens(F.col("text")).alias("n_tokens")).where("n_tokens > 0")
    if weights is not None:
        one = weights.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("weight").cast("double").alias("w")).where("doc_id is not null").groupBy("doc_id").agg(F.max("w").alias("w"))
        src = src.join(one, "doc_id", "left")
    else:
        src = src.withColumn("w", F.lit(None).cast("double"))
    src = cut(src, "tokens")

    # a few rows: one for each source
    share = F.lit(None).cast("double")
    for s, t in targets.items():
        share = F.when(F.col("source") == s, F.lit(float(t))).otherwise(share)
    sources = src.groupBy("source").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("n"), F.avg("w").alias("mean")).withColumn("share", share)
    # of each source the share of documents by the power of 2 of their weight
    kinds = src.where("w is null or w > 0").groupBy("source", F.floor(F.log2("w")).alias("p")).agg(F.count("*").alias("c"))
    kinds = kinds.groupBy("source").agg(F.collect_list(F.struct((1.5 * F.pow(F.lit(2.0), "p")).alias("w"), "c")).alias("kinds")).withColumnRenamed("source", "k")
    every = W.partitionBy(F.lit(1))
    rest = F.greatest(1 - F.sum("share").over(every), F.lit(0.0))
    free = F.sum(F.when(F.col("share").isNull(), F.col("total"))).over(every)
    sources = sources.join(kinds, F.col("source").eqNullSafe(F.col("k")), "left")
    sources = cut(
        sources.withColumn("budget", F.floor(F.lit(float(budget)) * F.sum("total").over(every) * F.coalesce("share", F.coalesce(rest, F.lit(1.0)) * F.col("total") / free)))
        .select(F.col("source").alias("s"), "n", "mean", "kinds", F.expr("budget div total").alias("epochs"), F.expr("budget % total").alias("left"), F.ceil(F.col("n") / PER_BUCKET).alias("buckets")),
        "sources",
    )
    rows = src.join(sources, F.col("source").eqNullSafe(F.col("s"))).withColumn("w", F.coalesce("w", "mean", F.lit(DEFAULT_WEIGHT)))
    rows = rows.withColumn("key", F.when(F.col("w") > 0, -F.log(uniform(seed, F.col("doc_id"))) / F.col("w")))
    # the share of the source's documents with a smaller key: increasing in the key, and even over (0, 1)
    before = F.aggregate("kinds", F.lit(0.0), lambda x, k: x + k["c"] * (1 - F.exp(-F.col("key") * F.coalesce(k["w"], "mean", F.lit(DEFAULT_WEIGHT))))) / F.aggregate("kinds", F.lit(0.0), lambda x, k: x + k["c"])
    rows = cut(rows.withColumn("bucket", F.floor(before * F.col("buckets"))).select("doc_id", "source", "n_tokens", "key", "s", "epochs", "left", "bucket"), "keys")
    b = rows.where("key is not null").groupBy("s", "bucket").agg(F.sum("n_tokens").alias("t"))
    b = cut(b.withColumn("before", F.sum("t").over(W.partitionBy("s").orderBy("bucket")) - F.col("t")).select(F.col("s").alias("s2"), F.col("bucket").alias("b2"), "before", (F.col("before") + F.col("t")).alias("upto")), "buckets")
    rows = rows.join(b, F.col("s").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")), "left")
    # whole buckets are inside the rest or beyond it but for one of each source; only its rows need an order
    border = F.coalesce((F.col("before") < F.col("left")) & (F.col("upto") > F.col("left")), F.lit(False))
    w = W.partitionBy("s", "bucket").orderBy("key", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    clear = rows.where(~border).withColumn("extra", F.when(F.col("upto") <= F.col("left"), 1).otherwise(0))
    edge = rows.where(border).withColumn("extra", F.when(F.col("before") + F.sum("n_tokens").over(w) <= F.col("left"), 1).otherwise(0))
    return clear.unionByName(edge).withColumn("copies", (F.col("epochs") + F.col("extra")).cast("bigint")).where("copies > 0").select("doc_id", "source", "n_tokens", F.round("key", 9).alias("key"), "copies")


def label_weights(labels: DataFrame, low: float = 0.25) -> DataFrame:
    """Quality weight of the labelled documents: 1 for good ones, low for bad ones."""
    return labels.where("quality in (0, 1)").select("doc_id", F.when(F.col("quality") == 1, 1.0).otherwise(low).alias("weight"))


def mixed(docs: DataFrame, weights: DataFrame | None, targets: dict[str, float] | None = None, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """The rows of docs in the mixture, all their columns, each as often as it is taken."""
    at, n, copy, row = (private(docs, c) for c in ("mix_id", "copies", "mix_copy", "mix_row"))
    taken = cut(selected(docs, weights, targets, budget, seed).select(F.col("doc_id").alias(at), "source", "n_tokens", F.col("copies").cast("int").alias(n)), "taken")
    # rows of one doc_id that aren't one row: those of one source and length are alike to the mixture, and are numbered
    repeated = cut(docs.groupBy(F.col("doc_id").alias(at)).agg(F.count("*").alias(n)).where(F.col(n) > 1).where(F.col(at).isNotNull()).select(at), "repeated")
    few = taken.join(repeated, at).withColumn(row, F.row_number().over(W.partitionBy(at, "source", "n_tokens").orderBy(F.desc(n))))
    few = few.withColumnsRenamed({"source": "mix_of", "n_tokens": "mix_size"})
    numbered = docs.join(repeated, docs["doc_id"] == repeated[at]).drop(at)
    length = private(numbered, "mix_length")
    numbered = numbered.withColumn(length, tokens(F.col("text")))
    numbered = numbered.withColumn(row, F.row_number().over(W.partitionBy("doc_id", "source", length).orderBy("text")))
    several = numbered.alias("d").join(few.alias("t"), (F.col("d.doc_id") == F.col(f"t.{at}")) & F.col("d.source").eqNullSafe(F.col("t.mix_of")) & (F.col(f"d.{length}") == F.col("t.mix_size")) & (F.col(f"d.{row}") == F.col(f"t.{row}")))
    several = several.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col(f"t.{n}"))
    single = cut(taken.join(repeated, at, "left_anti").select(at, n), "single")
    ids = F.broadcast(single) if single.count() <= BROADCAST_IDS else single
    out = docs.join(ids, docs["doc_id"] == single[at]).select(*[F.col(f"`{c}`") for c in docs.columns], n).unionAll(several)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])
