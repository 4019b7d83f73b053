"""The stored tables seen as notes, messages and activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every query that needs a clock takes this one: 2024-02-01 00:00 UTC, in milliseconds.
NOW_MS = 1706745600000
DAY_MS = 86_400_000
START_MS = 1704067200000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: doc_id, path, name, folder, extension, size, modified (ms), content, lang, source."""
    d = load(spark, sf_dir, "documents")
    folder = F.concat_ws("/", "lang", "source")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    extension = F.when(F.col("doc_id") % 4 == 0, "txt").otherwise("md")
    return d.select(
        "doc_id", F.concat(folder, F.lit("/"), name, F.lit("."), extension).alias("path"), name.alias("name"), folder.alias("folder"), extension.alias("extension"),
        F.col("n_chars").alias("size"), (F.lit(START_MS) + F.col("doc_id") % 700 * 3_600_000).alias("modified"), F.col("text").alias("content"), "lang", "source",
    )


NOTES = """SELECT doc_id, lang || '/' || source || '/doc_' || doc_id || '.' || CASE WHEN doc_id % 4 = 0 THEN 'txt' ELSE 'md' END AS path,
  'doc_' || doc_id AS name, lang || '/' || source AS folder, CASE WHEN doc_id % 4 = 0 THEN 'txt' ELSE 'md' END AS extension,
  n_chars AS size, 1704067200000 + doc_id % 700 * 3600000 AS modified, text AS content, lang, source FROM documents"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns: id, conv_id, seq, role, content, ms."""
    c = load(spark, sf_dir, "conversations")
    return c.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "conv_id", F.col("turn").alias("seq"), "role", F.col("text").alias("content"),
        (F.lit(START_MS) + F.col("conv_id") * 3_600_000 + F.col("turn") * 60_000).alias("ms"),
    )


MESSAGES = "SELECT conv_id || ':' || turn AS id, conv_id, turn AS seq, role, text AS content, 1704067200000 + conv_id * 3600000 + turn * 60000 AS ms FROM conversations"


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of tool calls and memory traces: id, ms, workspace, session, device, type, value, k, success, content."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("user_id").alias("workspace"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("session"), (F.col("user_id") % 3).alias("device"), F.col("event_type").alias("type"), "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"), (F.col("event_type") != "error").alias("success"), F.concat_ws(" ", F.lit("User"), F.col("user_id").cast("string"), "event_type", "props").alias("content"),
    )


ACTIVITY = """SELECT event_id AS id, epoch_us(ts) // 1000 AS ms, user_id AS workspace, user_id || '-' || strftime(ts, '%Y%m%d') AS session, user_id % 3 AS device,
  event_type AS type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type <> 'error' AS success, 'User ' || user_id || ' ' || event_type || ' ' || props AS content FROM events"""


def with_views(sql: str) -> str:
    """Oracle SQL with the views it names put before it."""
    views = {"notes": NOTES, "messages": MESSAGES, "activity": ACTIVITY}
    used = [f"{k} AS ({v})" for k, v in views.items() if f" {k}" in sql]
    if not used:
        return sql
    return f"WITH {', '.join(used)}, " + sql[5:] if sql.startswith("WITH ") else f"WITH {', '.join(used)} {sql}"
