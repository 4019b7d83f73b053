"""Scalar rules applied to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import paths
from marginalia.functions import scalars as sc
from marginalia.plans.registry import query
from marginalia.sources.tables import NOW_MS, activity, load, messages, notes, with_views


@query("path_functions", with_views("SELECT doc_id, lang || '/' || source || '/doc_' || doc_id || '.' || extension AS normal, folder, extension, name || '.' || extension AS file, 'a_b_c' || doc_id AS safe, CASE WHEN extension = 'md' THEN path ELSE path || '.md' END AS md, doc_id % 2 = 0 AS valid FROM notes"))
def path_functions(spark: SparkSession, sf: str) -> DataFrame:
    path, number = F.col("path"), F.col("doc_id").cast("string")
    raw = F.concat(F.lit("\\"), F.regexp_replace(path, "/", "//"), F.lit("/"))
    return notes(spark, sf).select(
        "doc_id", paths.normalized(raw).alias("normal"), paths.folder(path).alias("folder"), paths.extension(path).alias("extension"), paths.file_name(path).alias("file"),
        paths.sanitized_name(F.concat(F.lit('a:b"c'), number)).alias("safe"), paths.with_md(path).alias("md"), paths.valid_path(F.when(F.col("doc_id") % 2 == 0, path).otherwise(F.concat(F.lit("a/../"), path))).alias("valid"),
    )


@query("similarity", "SELECT p_partkey, round(1.0 - levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type)), 6) AS similarity FROM part")
def similarity(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", F.round(sc.similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query("find_replace", with_views("SELECT id, replace(content, 'er', '<$1>') AS new_content, CAST(len(string_split(content, 'er')) - 1 AS BIGINT) AS replacements FROM messages"))
def find_replace(spark: SparkSession, sf: str) -> DataFrame:
    new, n = sc.replaced(F.col("content"), "er", "<$1>")
    return messages(spark, sf).select("id", new.alias("new_content"), n.cast("long").alias("replacements"))


@query("replace_by_line", with_views("SELECT doc_id, array_to_string(list_concat(list_slice(lines, 1, 1), ['one', 'two'], list_slice(lines, 4, len(lines))), chr(10)) AS new_content FROM (SELECT doc_id, string_split(content, chr(10)) AS lines FROM notes)"))
def replace_by_line(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select("doc_id", sc.lines_replaced(F.col("content"), 2, 3, ["one", "two"]).alias("new_content"))


@query("date_parts", with_views("SELECT id, strftime(make_timestamp(ms * 1000), '%Y-%m-%d') AS iso_date, strftime(make_timestamp(ms * 1000), '%Y-%m') AS month, CAST(floor((1706745600000 - ms) / 86400000) AS BIGINT) AS age_days FROM activity"))
def date_parts(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.col("ms")
    return activity(spark, sf).select("id", sc.iso_date(ms).alias("iso_date"), sc.month_key(ms).alias("month"), sc.age_days(ms, NOW_MS).alias("age_days"))


@query("token_estimate", with_views("SELECT id, CAST(ceil(length(content) / 4) AS BIGINT) AS by_length, CAST(greatest(ceil(length(content) / 4), ceil(len(regexp_extract_all(content, '[^\\x20\\x09-\\x0D]+')) * 1.3::DOUBLE)) AS BIGINT) AS estimate FROM messages"))
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).select("id", sc.tokens_by_length(F.col("content")).alias("by_length"), sc.tokens_estimate(F.col("content")).cast("long").alias("estimate"))


@query("token_cost", with_views("SELECT id, round(k * 80 / 1e6 * 2.5 + k * 20 / 1e6 * 2.5 * (1 - CASE type WHEN 'view' THEN 0.5::DOUBLE WHEN 'click' THEN 0.75::DOUBLE WHEN 'purchase' THEN 0.9::DOUBLE ELSE 0 END), 10) AS cost FROM activity"))
def token_cost(spark: SparkSession, sf: str) -> DataFrame:
    return activity(spark, sf).select("id", F.round(sc.token_cost(F.col("type"), F.col("k") * 100, F.col("k") * 20, F.lit(2.5)), 10).alias("cost"))


@query("usage_band", with_views("SELECT id, value AS percent, CASE WHEN value < 50 THEN 'safe' WHEN value < 70 THEN 'moderate' WHEN value < 85 THEN 'warning' ELSE 'critical' END AS band, value + k > 100 AS overflows FROM activity"))
def usage_band(spark: SparkSession, sf: str) -> DataFrame:
    return activity(spark, sf).select("id", F.col("value").alias("percent"), sc.usage_band(F.col("value")).alias("band"), (F.col("value") + F.col("k") > 100).alias("overflows"))


@query("cache_priority", with_views("SELECT id, round(0.5 * k + 0.4 / (floor((1706745600000 - ms) / 3600000) + 1) + 0.1 / (floor((1706745600000 - ms) / 86400000) + 1), 8) AS priority FROM activity"))
def cache_priority(spark: SparkSession, sf: str) -> DataFrame:
    age = lambda unit: F.floor((F.lit(NOW_MS) - F.col("ms")) / unit)
    return activity(spark, sf).select("id", F.round(sc.cache_priority(F.col("k"), age(sc.HOUR_MS), age(sc.DAY_MS)), 8).alias("priority"))


@query("active_alternative", with_views("SELECT id, CASE WHEN seq % 4 IN (1, 2) THEN ['first ' || role, 'second ' || role][seq % 4] ELSE content END AS shown FROM messages"))
def active_alternative(spark: SparkSession, sf: str) -> DataFrame:
    others = F.array(F.concat(F.lit("first "), "role"), F.concat(F.lit("second "), "role"))
    return messages(spark, sf).select("id", sc.active_alternative(F.col("content"), others, (F.col("seq") % 4).cast("int")).alias("shown"))


@query("json_usage", "SELECT event_id, coalesce(nullif(CAST(json_extract_string(props, '$.usage.total') AS BIGINT), 0), nullif(CAST(json_extract_string(props, '$.k') AS BIGINT), 0), 0) AS tokens FROM events")
def json_usage(spark: SparkSession, sf: str) -> DataFrame:
    number = lambda p: F.get_json_object("props", p).cast("long")
    return load(spark, sf, "events").select("event_id", sc.first_number(number("$.usage.total"), number("$.k")).alias("tokens"))


@query("tool_name_split", with_views("SELECT id, CASE WHEN id % 5 = 0 THEN type ELSE 'agent_' || type END AS agent, CASE WHEN id % 5 = 0 THEN 'unknown' ELSE 'm' || k END AS mode FROM activity"))
def tool_name_split(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("id") % 5 == 0, F.col("type")).otherwise(F.concat(F.lit("agent_"), "type", F.lit("_m"), F.col("k").cast("string")))
    return activity(spark, sf).select("id", *sc.tool_parts(name))


@query("format_title", with_views("SELECT id, CASE WHEN success THEN type ELSE type || ' (failed)' END || ' - ' || session AS title, CASE WHEN length(content) > 30 THEN substr(content, 1, 30) || '...' ELSE content END AS preview FROM activity"))
def format_title(spark: SparkSession, sf: str) -> DataFrame:
    title = F.concat_ws(" - ", F.when(F.col("success"), F.col("type")).otherwise(F.concat("type", F.lit(" (failed)"))), "session")
    preview = F.when(F.length("content") > 30, F.concat(F.left("content", F.lit(30)), F.lit("..."))).otherwise(F.col("content"))
    return activity(spark, sf).select("id", title.alias("title"), preview.alias("preview"))


@query("sanitize_text", with_views("SELECT id, trim(substr(content || 'end', 1, 50000)) AS clean FROM messages"))
def sanitize_text(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).select("id", sc.sanitized(F.concat(F.lit("\x01"), "content", F.lit("\x07e\x1fnd"))).alias("clean"))
