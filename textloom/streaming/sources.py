"""Streams of files and sockets, stream-static search and fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import boolquery
from textloom.operators.index import Stored


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A table's files as a stream; the schema is read from the table."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # a pattern, as the file source wants a folder or a pattern and a table may be one file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{name}[.]parquet")


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a TCP connection with the time they came."""
    return spark.readStream.format("socket").option("host", host).option("port", port).option("includeTimestamp", "true").load().withColumnRenamed("value", "line")


def search_stream(asked: DataFrame, index: Stored, path: str, timeout_s: int = 600) -> DataFrame:
    """query, n of a stream of boolean queries (column query) against a stored index, over all that is there now.

    A micro-batch's queries are parsed on the driver (there are as many as the source's limit lets into a batch) and answered together. An answer's
    folder is named by its batch, so a batch that runs again after a loss overwrites its own. A query that isn't well formed has a null n."""
    spark = asked.sparkSession

    def answer(batch: DataFrame, number: int) -> None:
        queries = sorted(r.query for r in batch.where("query is not null").select("query").distinct().collect())
        good, bad = [], []
        for q in queries:
            try:
                boolquery.parse(q)
                good.append(q)
            except ValueError:
                bad.append(q)
        out = boolquery.report(boolquery.search_many(index, good), good)
        if bad:
            out = out.unionAll(spark.createDataFrame([(q, None) for q in bad], "query string, n bigint"))
        out.write.mode("overwrite").parquet(f"{path}/answers/batch={number}")

    spark.createDataFrame([], "query string, n bigint").write.mode("overwrite").parquet(f"{path}/answers/batch=-1")
    stream = asked.writeStream.foreachBatch(answer).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    try:
        if not stream.awaitTermination(timeout_s):
            raise TimeoutError(f"the stream didn't end within {timeout_s} s")
    finally:
        stream.stop()
    return spark.read.parquet(f"{path}/answers").select("query", "n")


def socket_sink(host: str, port: int):
    """A foreachBatch function that sends the column line of each row to a TCP server, a line each, partition by partition from the executors."""

    def send(rows) -> None:
        import socket

        lines = [r.line for r in rows if r.line is not None]
        if lines:
            with socket.create_connection((host, port), timeout=30) as out:
                out.sendall("".join(x + "\n" for x in lines).encode())

    return lambda batch, number: batch.select("line").foreachPartition(send)


def broadcast_lines(messages: DataFrame, deliver, checkpoint: str):
    """Gives every micro-batch of a stream of lines to deliver(DataFrame, batch id)."""
    return messages.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).start()


def admit_batch(quotas: DataFrame, stream: DataFrame, cluster: str = "cluster", order: str = "arrival") -> DataFrame:
    """Admission by cluster quota as keyed state: how many each cluster has let in so far."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    left = stream.join(quotas.select(cluster, F.ceil("quota").alias("quota")), cluster)
    kinds = {f.name: f.dataType.simpleString() for f in left.schema}

    def step(key, batches, state):
        used = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(order)
        rank = used + pd.RangeIndex(1, len(rows) + 1)
        state.update((used + len(rows),))
        yield rows.assign(accepted=rank <= rows["quota"].to_numpy())

    out = ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", accepted boolean"
    return left.groupBy(cluster).applyInPandasWithState(step, out, "used bigint", "append", GroupStateTimeout.NoTimeout)
