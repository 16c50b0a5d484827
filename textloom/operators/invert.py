"""Inversion of keyed lists, total order and bag operations: what external sorts did, as shuffles that spill by themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.storage import cut


BLOCK = 1 << 20


def inverted(pairs: DataFrame, key: str, value: str, out_key: str, out_list: str, block: int = BLOCK) -> DataFrame:
    """out_key (each value), block, and the ascending distinct keys of the block that it occurs with: keys are whole numbers, and a list is cut into blocks of
    `block` consecutive ones, so that a value that most keys have doesn't make one huge row."""
    rows = pairs.select(key, value).where(F.col(key).isNotNull() & F.col(value).isNotNull())
    return rows.groupBy(F.col(value).alias(out_key), F.expr(f"`{key}` div {block}").alias("block")).agg(F.array_sort(F.collect_set(key)).alias(out_list))


def reinverted(lists: DataFrame, key: str, values: str, out_key: str, out_list: str, block: int = BLOCK) -> DataFrame:
    """The inverse of inverted(): each element of the lists with the ascending keys of the lists it is in, in blocks of these."""
    return inverted(lists.select(key, F.explode(values).alias("_v")), key, "_v", out_key, out_list, block)


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """df with rank, its row's place (from 1) in the total order of all columns named.

    The rows are range-partitioned, written, counted by partition, and numbered within it: no task sees all rows. They are written since the bounds of
    the ranges come from a sample: what is counted must be what is numbered."""
    parts = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_before"))
    numbered = parts.withColumn("_at", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    return numbered.join(F.broadcast(sizes), "_p").select(*df.columns, (F.col("_before") + F.col("_at")).cast("bigint").alias("rank"))


def runs(df: DataFrame, partition: str, order: str, value: str) -> DataFrame:
    """Run-length coding: partition, first order of each run of equal values, value and length."""
    w = W.partitionBy(partition).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    islands = df.select(partition, order, value, new.alias("new")).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(partition, "run").agg(F.min(order).alias("first"), F.min(value).alias(value), F.count("*").alias("length")).drop("run")


def top(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows: each task keeps n, and only those meet."""
    return df.orderBy(*order).limit(n)


def sampled(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows in the order of shuffled(), for the driver. A limit alone lets each task send n rows; here the rows are counted by the head of
    the hash first (2^16 numbers at most), and those beyond the head that the n-th row has are left out: about n rows are sent, whatever the tasks."""
    head = F.shiftright(F.xxhash64(key), 48)
    seen, last = 0, None
    for r in sorted(df.groupBy(head.alias("head")).agg(F.count("*").alias("n")).collect()):
        if seen >= n:
            break
        seen, last = seen + r.n, r.head
    near = df if last is None else df.where(head <= last)
    return near.orderBy(F.xxhash64(key), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """df in a random order that is the same in every run: that of a hash of seed and key."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
