"""Queries on keyed values with expiry, chat fan-out and commands, as batch and as stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import kv
from textloom.plans.registry import query
from textloom.storage import table
from textloom.streaming import kv as stream
from textloom.streaming.sources import table_stream

ANSWERS = """WITH c AS (SELECT event_id, ts, user_id AS key, CASE WHEN event_type IN ('purchase', 'signup') THEN 'set' WHEN event_type IN ('view', 'click') THEN 'get' END AS op, value FROM events),
l AS (SELECT *, last_value(CASE WHEN op = 'set' THEN {'ts': ts, 'value': value} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM c WHERE op IS NOT NULL)
SELECT event_id, key, CASE WHEN ts < last.ts + INTERVAL 3600 SECOND THEN last.value END AS answer FROM l WHERE op = 'get'"""


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.event_commands(table(spark, sf_dir, "events"))


@query(ANSWERS)
def kv_ttl_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.answers(_commands(spark, sf_dir))


@query(ANSWERS)
def kv_ttl_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream.use_rocksdb(spark)
    return stream.run_once(spark, stream.answers(kv.event_commands(table_stream(spark, sf_dir, "events"))))


@query("SELECT user_id AS key, event_id, value FROM events WHERE event_type IN ('purchase', 'signup') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.last_write(_commands(spark, sf_dir))


SESSIONS = """WITH e AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER w AS bef FROM events WHERE event_type IN ('signup', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts AS connect, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS disconnect, event_type FROM e WHERE bef IS NULL OR bef <> event_type)"""


@query(SESSIONS + " SELECT user_id, count(*) AS n, count(disconnect) AS n_closed, min(epoch_us(connect)) AS first_us FROM s WHERE event_type = 'signup' GROUP BY user_id")
def chat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.sessions(table(spark, sf_dir, "events")).groupBy("user_id").agg(F.count("*").alias("n"), F.count("disconnect").alias("n_closed"), F.min(F.unix_micros("connect")).alias("first_us"))


@query(SESSIONS + """, m AS (SELECT event_id, ts, user_id % 50 AS room FROM events WHERE event_type = 'purchase')
SELECT event_id, user_id AS receiver FROM m JOIN s ON s.event_type = 'signup' AND s.user_id % 50 = m.room AND m.ts >= connect AND (disconnect IS NULL OR m.ts < disconnect)""")
def chat_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = kv.stamped(table(spark, sf_dir, "events"))
    sent = e.where("event_type = 'purchase'").select("event_id", "ts", (F.col("user_id") % 50).alias("room"))
    return kv.fan_out(sent, kv.sessions(e).withColumn("room", F.col("user_id") % 50))


@query("""WITH l AS (SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'set ' || (event_id % 7 - 1) || ' k' || user_id || ' ' || props WHEN event_type = 'error' THEN 'drop k' || user_id ELSE 'get k' || user_id END AS line, event_type, user_id, props FROM events)
SELECT event_id, CASE WHEN event_type <> 'error' THEN CASE WHEN starts_with(line, 'set') THEN 'set' ELSE 'get' END END AS op, event_type <> 'error' AND (NOT starts_with(line, 'set') OR event_id % 7 > 0) AS valid,
CASE WHEN starts_with(line, 'set') THEN props END AS value FROM l""")
def command_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.concat(F.lit("k"), F.col("user_id").cast("string"))
    line = (
        F.when(F.col("event_type").isin("purchase", "signup"), F.concat_ws(" ", F.lit("set"), (F.col("event_id") % 7 - 1).cast("string"), user, "props"))
        .when(F.col("event_type") == "error", F.concat_ws(" ", F.lit("drop"), user)).otherwise(F.concat_ws(" ", F.lit("get"), user))
    )
    return kv.commands(table(spark, sf_dir, "events").select("event_id", line.alias("line"))).select("event_id", "op", "valid", "value")


@query("""WITH l AS (SELECT conv_id * 1000 + turn AS sender, string_split(text, chr(10)) AS p FROM conversations WHERE text IS NOT NULL),
m AS (SELECT sender, unnest(p[1:-2]) AS line, unnest(range(0, len(p) - 1)) AS k FROM l), x AS (SELECT sender, k, line, unnest(range(0, (length(line) + 63) // 64)) AS j FROM m)
SELECT sender, row_number() OVER (PARTITION BY sender ORDER BY k, j) - 1 AS n, substr(line, j * 64 + 1, 64) AS part FROM x""")
def line_framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("text is not null")
    return kv.framed(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("sender"), F.col("text").alias("data")), 64)


@query("SELECT user_id, ('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT % 4 AS worker, count(*) AS n FROM events GROUP BY 1, 2")
def worker_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", kv.worker(F.col("user_id"), 4).alias("worker")).agg(F.count("*").alias("n"))
