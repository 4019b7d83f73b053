"""Scans, filters and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.paths import depth, file_name, glob_to_regex
from marginalia.operators import filters as flt
from marginalia.plans.registry import query
from marginalia.sources import eventlog
from marginalia.sources.tables import activity, load, messages, notes, with_views

LOG_COLUMNS = ("id", "ms", "workspace", "device", "type", "value")


@query("events_json_scan", with_views("SELECT CAST(id AS VARCHAR) AS id, type, CAST(device AS VARCHAR) AS device, ms FROM activity WHERE id % 97 <> 0 AND id % 101 <> 0"))
def events_json_scan(spark: SparkSession, sf: str) -> DataFrame:
    event = F.to_json(F.struct(F.col("id").cast("string").alias("id"), "type", F.col("device").cast("string").alias("deviceId"), F.col("ms").alias("timestamp")))
    line = F.when(F.col("id") % 101 == 0, "   ").when(F.col("id") % 97 == 0, F.substring(event, 1, 20)).otherwise(event)
    return eventlog.parse_lines(activity(spark, sf).select(line.alias("value"))).select("id", "type", F.col("deviceId").alias("device"), F.col("timestamp").alias("ms"))


@query("events_since", with_views("SELECT id, ms, workspace, device, type, value FROM activity WHERE ms > 1705276800000"))
def events_since(spark: SparkSession, sf: str) -> DataFrame:
    return eventlog.since(activity(spark, sf), 1705276800000).select(*LOG_COLUMNS)


@query("events_from_device", with_views("SELECT id, ms, workspace, device, type, value FROM activity WHERE device = 1"))
def events_from_device(spark: SparkSession, sf: str) -> DataFrame:
    return eventlog.from_device(activity(spark, sf), 1).select(*LOG_COLUMNS)


@query("events_remote", with_views("SELECT id, ms, workspace, device, type, value FROM activity WHERE device <> 1 AND ms > 1705276800000"))
def events_remote(spark: SparkSession, sf: str) -> DataFrame:
    return eventlog.remote(activity(spark, sf), 1, 1705276800000).select(*LOG_COLUMNS)


@query("events_unapplied", with_views("SELECT id, type FROM activity WHERE device <> 0 AND id NOT IN (SELECT event_id FROM events WHERE event_id % 5 = 0)"))
def events_unapplied(spark: SparkSession, sf: str) -> DataFrame:
    log = activity(spark, sf)
    return eventlog.unapplied(eventlog.remote(log, 0), log.where("id % 5 = 0")).select("id", "type")


@query("point_lookup", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").where(flt.equals(c_custkey=42)).select("c_custkey", "c_name", "c_acctbal")


@query("dynamic_filter", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND o_totalprice <= 200000")
def dynamic_filter(spark: SparkSession, sf: str) -> DataFrame:
    wanted = flt.conjunction([flt.equals(o_orderstatus="F", o_custkey=None), flt.between("o_totalprice", 100_000, 200_000)])
    return load(spark, sf, "orders").where(wanted).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("name_or_id", "SELECT c_custkey, c_name FROM customer WHERE CAST(c_custkey AS VARCHAR) = '17' OR lower(c_name) = '17' ORDER BY CASE WHEN CAST(c_custkey AS VARCHAR) = '17' THEN 0 ELSE 1 END, c_custkey LIMIT 1")
def name_or_id(spark: SparkSession, sf: str) -> DataFrame:
    return flt.by_name_or_id(load(spark, sf, "customer"), "17", "c_custkey", "c_name").select("c_custkey", "c_name")


@query("latest_active", "SELECT o_orderkey, o_custkey, epoch_ms(o_orderdate) AS ms FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def latest_active(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").where("o_orderstatus = 'O'")
    return orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(1).select("o_orderkey", "o_custkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms"))


@query("trace_like", with_views("SELECT id, workspace, content FROM activity WHERE content ILIKE '%PURCHASE%'"))
def trace_like(spark: SparkSession, sf: str) -> DataFrame:
    return activity(spark, sf).where(F.col("content").ilike("%PURCHASE%")).select("id", "workspace", "content")


#: States with tags: a user's events, tagged by type, device and whether k is even.
TAGGED = "SELECT id, workspace, [type, 'dev' || device, CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END] AS tags FROM activity"


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.array("type", F.concat(F.lit("dev"), F.col("device").cast("string")), F.when(F.col("k") % 2 == 0, "even").otherwise("odd"))
    return activity(spark, sf).select("id", "workspace", tags.alias("tags"))


@query("json_contains", with_views(f"SELECT id FROM ({TAGGED}) WHERE list_contains(tags, 'click')"))
def json_contains(spark: SparkSession, sf: str) -> DataFrame:
    stored = tagged(spark, sf).select("id", F.to_json("tags").alias("tags_json"))
    return stored.where(F.array_contains(F.from_json("tags_json", "array<string>"), "click")).select("id")


@query("arrays_overlap", with_views(f"SELECT id, workspace FROM ({TAGGED}) WHERE list_has_any(tags, ['error', 'dev2'])"))
def arrays_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return tagged(spark, sf).where(F.arrays_overlap("tags", F.array(F.lit("error"), F.lit("dev2")))).select("id", "workspace")


@query("array_except", with_views(f"SELECT id, array_to_string(list_filter(tags, lambda x: x NOT IN ('click', 'odd')), ',') AS tags FROM ({TAGGED})"))
def array_except(spark: SparkSession, sf: str) -> DataFrame:
    return tagged(spark, sf).select("id", F.array_join(F.array_except("tags", F.array(F.lit("click"), F.lit("odd"))), ",").alias("tags"))


@query("date_range", with_views("SELECT id, ms FROM activity WHERE ms BETWEEN 1704844800000 AND 1705449600000"))
def date_range(spark: SparkSession, sf: str) -> DataFrame:
    return activity(spark, sf).where(flt.between("ms", 1704844800000, 1705449600000)).select("id", "ms")


@query("content_filter", with_views("SELECT doc_id, contains(lower(content), 'the and') AS has_phrase, regexp_matches(content, '[0-9]{4}') AS has_number, regexp_matches(content, '(?i)\\bthe\\b') AS has_word FROM notes WHERE contains(lower(content), 'the and') OR regexp_matches(content, '[0-9]{4}')"))
def content_filter(spark: SparkSession, sf: str) -> DataFrame:
    phrase, number = flt.contains_text("content", "The and"), flt.contains_text("content", "[0-9]{4}", "regex", True)
    return notes(spark, sf).where(phrase | number).select("doc_id", phrase.alias("has_phrase"), number.alias("has_number"), flt.contains_text("content", "the", "word").alias("has_word"))


@query("tool_call_filter", with_views("SELECT id, type, value FROM activity WHERE type NOT IN ('click', 'purchase') OR (success AND value >= 10 AND value <= 90)"))
def tool_call_filter(spark: SparkSession, sf: str) -> DataFrame:
    call = F.col("type").isin("click", "purchase")
    return activity(spark, sf).where(flt.tool_calls(call, F.col("success"), F.col("value") >= 10, F.col("value") <= 90)).select("id", "type", "value")


@query("score_threshold", with_views("SELECT id, round(value / 100, 6) AS score FROM activity WHERE round(value / 100, 6) >= 0.5"))
def score_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return activity(spark, sf).select("id", F.round(F.col("value") / 100, 6).alias("score")).where("score >= 0.5D")


@query("in_list", with_views("SELECT id, workspace, type FROM activity WHERE workspace IN (1, 2, 3, 5, 8) AND type IN ('view', 'error')"))
def in_list(spark: SparkSession, sf: str) -> DataFrame:
    wanted = flt.conjunction([flt.among("workspace", [1, 2, 3, 5, 8]), flt.among("type", ["view", "error"]), flt.among("session", [])])
    return activity(spark, sf).where(wanted).select("id", "workspace", "type")


@query("exec_time_range", with_views("SELECT id, value FROM activity WHERE success AND value BETWEEN 20 AND 60"))
def exec_time_range(spark: SparkSession, sf: str) -> DataFrame:
    return activity(spark, sf).where(flt.conjunction([F.col("success"), flt.between("value", 20, 60)])).select("id", "value")


@query("composite_filter", with_views("SELECT id, workspace, type, value FROM activity WHERE ms BETWEEN 1704240000000 AND 1706054400000 AND contains(lower(content), 'user 1') AND (type <> 'click' OR (success AND value >= 5)) AND workspace < 120 AND value >= 1 AND type IN ('click', 'view', 'purchase')"))
def composite_filter(spark: SparkSession, sf: str) -> DataFrame:
    wanted = flt.conjunction([
        flt.between("ms", 1704240000000, 1706054400000), flt.contains_text("content", "user 1"), flt.tool_calls(F.col("type") == "click", F.col("success"), F.col("value") >= 5),
        F.col("workspace") < 120, flt.between("value", 1), flt.among("type", ["click", "view", "purchase"]), flt.among("session", None),
    ])
    return activity(spark, sf).where(wanted).select("id", "workspace", "type", "value")


@query("filter_stats", with_views("SELECT type, count(*) AS before_filter, CAST(sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS after_filter, round(100.0 * sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) / count(*), 3) AS passed_percent FROM activity GROUP BY type"))
def filter_stats(spark: SparkSession, sf: str) -> DataFrame:
    passed = F.count_if(F.col("value") >= 50)
    return activity(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("before_filter"), passed.alias("after_filter"), F.round(100.0 * passed / F.count(F.lit(1)), 3).alias("passed_percent"))


@query("file_filters", with_views("SELECT path, size FROM notes WHERE extension IN ('md') AND path ILIKE 'en/src1%' AND modified BETWEEN 1704067200000 AND 1706000000000"))
def file_filters(spark: SparkSession, sf: str) -> DataFrame:
    return flt.file_filter(notes(spark, sf), [".MD"], 3, "^EN/src1", (1704067200000, 1706000000000)).select("path", "size")


@query("path_scope", with_views("SELECT path FROM notes WHERE starts_with(path, 'fr/') OR regexp_matches(path, '^en/[^/]*/doc_1[^/]*\\.md$')"))
def path_scope(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).where(flt.in_scope("path", ["fr/", "en/*/doc_1*.md"])).select("path")


@query("name_filter", with_views("SELECT name, folder FROM notes WHERE regexp_matches(name, '^doc_[0-9]{2}$')"))
def name_filter(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).where(F.col("name").rlike("^doc_[0-9]{2}$")).select("name", "folder")


@query("metadata_semi", with_views("SELECT path, lang FROM notes WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) AND lang = 'en'"))
def metadata_semi(spark: SparkSession, sf: str) -> DataFrame:
    good = load(spark, sf, "labels").where("quality = 1 AND toxic = 0")
    return notes(spark, sf).where("lang = 'en'").join(good, "doc_id", "left_semi").select("path", "lang")


@query("cost_range", "SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_retailprice BETWEEN 950 AND 960")
def cost_range(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").where(flt.between("p_retailprice", 950, 960)).select("p_partkey", "p_brand", "p_retailprice")


@query("entity_projection", with_views("SELECT 's' || id AS id, workspace AS workspace_id, coalesce(k, 0) AS state_k, success AS is_active, ms AS created, CASE WHEN type = 'error' THEN 'failed' ELSE type END AS name FROM activity"))
def entity_projection(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("type") == "error", "failed").otherwise(F.col("type"))
    return activity(spark, sf).select(
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), F.col("workspace").alias("workspace_id"), F.coalesce("k", F.lit(0)).cast("long").alias("state_k"), F.col("success").alias("is_active"), F.col("ms").alias("created"), name.alias("name")
    )


@query("context_fallback", "SELECT event_id, coalesce(json_extract_string(props, '$.context.k'), json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.title'), event_type) AS title FROM events")
def context_fallback(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda p: F.get_json_object("props", p)
    return load(spark, sf, "events").select("event_id", F.coalesce(at("$.context.k"), at("$.k"), F.lit("none")).alias("k"), F.coalesce(at("$.title"), F.col("event_type")).alias("title"))


@query("dir_scan_glob", with_views("SELECT DISTINCT path FROM notes WHERE regexp_matches(path, '^(?:.*/)?doc_[^/]*5\\.(?:md|txt)$') OR starts_with(path, 'de/src2/')"))
def dir_scan_glob(spark: SparkSession, sf: str) -> DataFrame:
    files = notes(spark, sf).select("path")
    found = [files.where(F.col("path").rlike(glob_to_regex("**/doc_*5.{md,txt}"))), files.where(F.col("path").startswith("de/src2/"))]
    return found[0].union(found[1]).dropDuplicates(["path"])


@query("list_directory", with_views("SELECT 'folder' AS kind, folder AS path, CAST(NULL AS BIGINT) AS modified, count(*) AS items FROM notes WHERE lang = 'en' GROUP BY folder UNION ALL SELECT 'file', path, modified, 1 FROM notes WHERE folder = 'en/src1'"))
def list_directory(spark: SparkSession, sf: str) -> DataFrame:
    files = notes(spark, sf).where(F.col("folder").startswith("en/"))
    folders = files.where(depth(F.col("folder")) <= 2).groupBy("folder").agg(F.count(F.lit(1)).alias("items"))
    listed = files.where("folder = 'en/src1'").select(F.lit("file").alias("kind"), "path", "modified", F.lit(1).cast("long").alias("items"))
    return folders.select(F.lit("folder").alias("kind"), F.col("folder").alias("path"), F.lit(None).cast("long").alias("modified"), "items").union(listed).orderBy(F.desc("kind"), F.desc("modified"), "path")


@query("front_matter", "SELECT conv_id, turn, regexp_extract('---' || chr(10) || 'title: t' || turn || chr(10) || 'description: ' || role || chr(10) || '---' || chr(10) || text, 'description:\\s*([^\\n]+)', 1) AS description FROM conversations")
def front_matter(spark: SparkSession, sf: str) -> DataFrame:
    head = F.concat(F.lit("---\ntitle: t"), F.col("turn").cast("string"), F.lit("\ndescription: "), "role", F.lit("\n---\n"), "text")
    block = F.regexp_extract(head, r"^---\n([\s\S]*?)\n---", 1)
    return load(spark, sf, "conversations").select("conv_id", "turn", F.regexp_extract(block, r"description:\s*([^\n]+)", 1).alias("description"))


@query("read_lines", with_views("SELECT doc_id, line_number, line FROM (SELECT doc_id, unnest(range(1, 1 + len(string_split(content, chr(10))))) AS line_number, unnest(string_split(content, chr(10))) AS line FROM notes) WHERE line_number BETWEEN 2 AND 4"))
def read_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines 2 to 4 of every note, numbered from 1; past the end there are fewer."""
    lines = F.slice(F.split("content", "\n"), 2, 3)
    return notes(spark, sf).select("doc_id", F.posexplode(lines).alias("at", "line")).select("doc_id", (F.col("at") + 2).cast("long").alias("line_number"), "line")


@query("file_names", with_views("SELECT path, name || '.' || extension AS file, len(string_split(path, '/')) AS parts FROM notes"))
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select("path", file_name(F.col("path")).alias("file"), depth(F.col("path")).cast("long").alias("parts"))


@query("messages_of", with_views("SELECT id, role, seq FROM messages WHERE conv_id = 3"))
def messages_of(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).where("conv_id = 3").select("id", "role", "seq")
