"""Keyed values with expiry and chat fan-out, over tables: the batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TTL = 3600
KEY_BYTES, VALUE_BYTES = 32, 256


def commands(lines: DataFrame) -> DataFrame:
    """lines (with column line) and op, key, ttl, value, valid: `set ttl key value` or `get key`. A value may hold spaces.

    Invalid: another word, a missing part, a ttl that isn't a whole number of 0 or more, a key or value that is too long."""
    p = F.split(F.trim("line"), " +", 4)
    op = F.when(p[0].isin("set", "get"), p[0])
    is_set = op == "set"
    key = F.when(is_set, F.get(p, F.lit(2))).otherwise(F.get(p, F.lit(1)))
    ttl = F.when(is_set, F.get(p, F.lit(1)).try_cast("int"))
    value = F.when(is_set, F.get(p, F.lit(3)))
    fits = (F.octet_length(key).between(1, KEY_BYTES)) & F.when(is_set, (ttl >= 0) & F.octet_length(value).between(1, VALUE_BYTES)).otherwise(F.size(p) == 2)
    return lines.select("*", op.alias("op"), key.alias("key"), ttl.alias("ttl"), value.alias("value"), F.coalesce(op.isNotNull() & fits, F.lit(False)).alias("valid"))


def stamped(events: DataFrame) -> DataFrame:
    """events with ts as a timestamp of the session's zone, whatever kind of timestamp the file has."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def event_commands(events: DataFrame, ttl: int = TTL) -> DataFrame:
    """Events as commands: purchase and signup set the user's value, view and click get it; other types are none."""
    op = F.when(F.col("event_type").isin("purchase", "signup"), "set").when(F.col("event_type").isin("view", "click"), "get")
    return stamped(events).select("event_id", "ts", F.col("user_id").alias("key"), op.alias("op"), "value", F.lit(ttl).alias("ttl")).where("op is not null and key is not null and ts is not null")


def answers(cmds: DataFrame) -> DataFrame:
    """event_id, key, answer of every get: the value of the key's last set before it, null if there is none or it has expired.

    A value lives from its set up to, not including, ttl seconds later; ttl 0 never expires. Rows go by (ts, event_id)."""
    w = W.partitionBy("key").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op") == "set", F.struct("ts", "ttl", "value")), ignorenulls=True).over(w)
    alive = (F.col("last.ttl") == 0) | (F.unix_micros("ts") < F.unix_micros("last.ts") + F.col("last.ttl").cast("bigint") * 1_000_000)
    return cmds.withColumn("last", last).where("op = 'get'").select("event_id", "key", F.when(alive, F.col("last.value")).alias("answer"))


def last_write(cmds: DataFrame) -> DataFrame:
    """key, event_id, value of each key's last set; partial aggregation, no sort."""
    top = cmds.where("op = 'set'").groupBy("key").agg(F.max(F.struct("ts", "event_id", "value")).alias("m"))
    return top.select("key", "m.event_id", "m.value")


def sessions(events: DataFrame) -> DataFrame:
    """user_id, connect, disconnect: from a signup to the user's next error (null: still connected). A signup while connected is none."""
    rows = stamped(events).where("event_type in ('signup', 'error') and user_id is not null and ts is not null")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    marked = rows.withColumn("before", F.lag("event_type").over(w)).where("not (event_type = before) or before is null")
    ends = marked.withColumn("disconnect", F.lead("ts").over(w)).where("event_type = 'signup'")
    return ends.select("user_id", F.col("ts").alias("connect"), "disconnect")


def fan_out(messages: DataFrame, live: DataFrame, room: str = "room", width_s: int = 86_400) -> DataFrame:
    """event_id, receiver: each message for everybody connected in its room when it was sent, its sender included.

    A range join made an equi-join: sessions are laid out over the time slots they cover, messages fall into one. Open sessions end with the last message."""
    end = messages.agg(F.max("ts").alias("end"))
    slot = lambda c: F.expr(f"unix_seconds({c}) div {width_s}")
    closed = live.join(F.broadcast(end), F.lit(True)).where("connect <= end").withColumn("until", F.least(F.coalesce("disconnect", "end"), "end"))
    spread = closed.select(room, F.col("user_id").alias("receiver"), "connect", "disconnect", F.explode(F.sequence(slot("connect"), slot("until"))).alias("slot"))
    sent = messages.select("event_id", "ts", room, slot("ts").alias("slot"))
    return sent.join(spread, [room, "slot"]).where("ts >= connect and (disconnect is null or ts < disconnect)").select("event_id", "receiver")


def framed(lines: DataFrame, size: int = 1024) -> DataFrame:
    """sender, n, part: messages cut at line ends and then into parts of at most `size` characters; an incomplete last line is kept back."""
    whole = F.slice(F.split("data", "\n", -1), F.lit(1), F.greatest(F.size(F.split("data", "\n", -1)) - 1, F.lit(0)))
    parts = F.flatten(F.transform(whole, lambda s: F.regexp_extract_all(s, F.lit("(?s).{1,%d}" % size), F.lit(0))))
    return lines.select("sender", F.posexplode(parts).alias("n", "part")).select("sender", F.col("n").cast("bigint").alias("n"), "part")


def worker(key, n: int):
    """The worker of a key: the same in every run and engine."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(n))
