"""Streaming keyed values with expiry: a stateful processor whose state is one value a key, and its runner.

Expiry goes by event time, so a rerun after a loss gives the same answers. A value that is set with a time to live has a timer for its end: when the
watermark passes it, the value leaves the state store. Values without a time to live (ttl 0) stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textloom.storage import scratch

STATE = "ts timestamp, ttl int, value double"
OUTPUT = "event_id bigint, key bigint, answer double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(ts: datetime) -> int:
    return round(ts.timestamp() * 1e6)


def timer(us: int, ttl: int) -> int:
    """When a value's time to live is over, in milliseconds."""
    return us // 1000 + ttl * 1000


class Expiring(StatefulProcessor):
    """set keeps (ts, ttl, value); get answers with the value if it is alive at the time of the get. Most keys have few rows in a batch, so rows are taken as
    they are: a data frame a key would cost more than its rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        old, new = self.kept.get(), None
        last = (micros(old[0]), old[1], old[2]) if old else None
        ended = timer(*last[:2]) if last and last[1] else None
        for r in sorted(rows, key=lambda r: (r.us, r.event_id)):
            if r.op == "set":
                new, last = r, (r.us, int(r.ttl), r.value)
            else:
                alive = last is not None and (last[1] == 0 or r.us < last[0] + last[1] * 1_000_000)
                yield Row(event_id=r.event_id, key=key[0], answer=last[2] if alive else None)
        if new is not None:
            self.kept.update((new.ts, last[1], last[2]))
            end = timer(*last[:2]) if last[1] else None
            if end != ended:  # each call is a round trip to the JVM
                if ended is not None:
                    self.handle.deleteTimer(ended)
                if end is not None:
                    self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def answers(cmds: DataFrame, late: str = "1 hour") -> DataFrame:
    """The streaming twin of operators.kv.answers. Rows of a key are put in order within a micro-batch; batches may
    overlap by `late`, rows that come later still are dropped."""
    return cmds.withWatermark("ts", late).withColumn("us", F.unix_micros("ts")).groupBy("key").transformWithState(Expiring(), OUTPUT, "Append", "EventTime")


def run_once(spark: SparkSession, out: DataFrame, timeout_s: int = 600, path: str | None = None) -> DataFrame:
    """Runs a streaming result over all that is there now and returns what it wrote to the shared folder (to path, where it goes on from
    an earlier run; its state is in path-checkpoint)."""
    path = path or scratch(spark, "stream")
    query = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-checkpoint").outputMode("append").trigger(availableNow=True).start()
    try:
        if not query.awaitTermination(timeout_s):
            raise TimeoutError(f"the stream didn't end within {timeout_s} s")
    finally:
        query.stop()
    return spark.read.schema(out.schema).parquet(path)


def use_rocksdb(spark: SparkSession) -> None:
    """State on local disk with changelog checkpoints, not on the heap; needed by stateful processors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
