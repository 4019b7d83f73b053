"""Edits of texts, merges of maps, trees, documents kept as files, and the filters of results and commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import scalars as sc
from marginalia.functions.locate import locate
from marginalia.operators import aggregates as agg
from marginalia.operators import filters as flt
from marginalia.operators import graph
from marginalia.plans.registry import query
from marginalia.sources import eventlog
from marginalia.sources.tables import activity, load, messages, notes, with_views
from marginalia.streaming.live import shared_dir


@query("text_edits", with_views("SELECT id, content || ' End.' AS appended, 'Start: ' || content AS prepended, replace(content, 'er', '') AS deleted, length(content) + 5 AS total_length FROM messages"))
def text_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Append, prepend and delete."""
    text = F.col("content")
    appended = F.concat(text, F.lit(" End."))
    return messages(spark, sf).select("id", appended.alias("appended"), F.concat(F.lit("Start: "), text).alias("prepended"), sc.replaced(text, "er", "")[0].alias("deleted"), F.length(appended).cast("long").alias("total_length"))


@query("fuzzy_locate")
def fuzzy_locate(spark: SparkSession, sf: str) -> DataFrame:
    """Where each note holds words best, some letters wrong; SQL has no such search, tests hold it against all places."""
    return notes(spark, sf).select("doc_id", locate("wnd the words", 0.6)(F.col("content")).alias("place"))


@query("map_merge", with_views("SELECT workspace, string_agg(key || '=' || value, ',' ORDER BY key) AS merged FROM (SELECT workspace, key, arg_max(value, (ms, id)) AS value FROM (SELECT workspace, ms, id, type AS key, session AS value FROM activity UNION ALL SELECT workspace, ms, id, 'last', CAST(id AS VARCHAR) FROM activity) GROUP BY workspace, key) GROUP BY workspace"))
def map_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Maps of all results of a workspace in one: of equal keys the later value."""
    own = activity(spark, sf)
    merged = agg.merged_maps(own.withColumn("meta", F.create_map("type", "session", F.lit("last"), F.col("id").cast("string"))), "workspace", "meta", ["ms", "id"])
    return merged.select("workspace", F.array_join(F.transform(F.sort_array(F.map_entries("meta")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("merged"))


@query("json_arrays", with_views("SELECT id, k % 4 = 0 AS is_array, CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END AS items, CASE k % 4 WHEN 0 THEN '[' || k || ', 7]' WHEN 1 THEN '[' || k || ', 7' WHEN 2 THEN '[' || k || ', ]' ELSE type END AS raw FROM activity"))
def json_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Arguments that look like JSON arrays are read as such, what can't be read stays a text."""
    k = F.col("k").cast("string")
    raw = F.when(F.col("k") % 4 == 0, F.concat(F.lit("["), k, F.lit(", 7]"))).when(F.col("k") % 4 == 1, F.concat(F.lit("["), k, F.lit(", 7"))).when(F.col("k") % 4 == 2, F.concat(F.lit("["), k, F.lit(", ]"))).otherwise(F.col("type"))
    items = sc.json_array(F.col("raw"))
    return activity(spark, sf).select("id", raw.alias("raw")).select("id", items.isNotNull().alias("is_array"), F.coalesce(F.size(items), F.lit(0)).alias("items"), "raw")


@query("tree_flatten", "SELECT 'r' || r_regionkey AS id, r_name AS path, 0 AS level FROM region UNION ALL SELECT 'n' || n_nationkey, r_name || '/' || n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'c' || c_custkey, r_name || '/' || n_name || '/' || c_name, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def tree_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """All files and folders of the tree region / nation / customer by path."""
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    nodes = load(spark, sf, "region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nodes = nodes.union(load(spark, sf, "nation").select(key("n", "n_nationkey"), key("r", "n_regionkey"), "n_name")).union(load(spark, sf, "customer").select(key("c", "c_custkey"), key("n", "c_nationkey"), "c_name"))
    return graph.flattened(nodes, 2)


@query("batch_filter", with_views("SELECT id FROM activity WHERE success AND type = 'click' AND k % 3 = 1 AND session LIKE '%5'"))
def batch_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Results of a batch: successful ones of a provider, place in the sequence and group."""
    results = activity(spark, sf).select("id", "success", F.col("type").alias("provider"), (F.col("k") % 3).alias("sequence"), F.right("session", F.lit(1)).alias("parallel_group"))
    return flt.batch_results(results, only_successful=True, provider="click", sequence=1, parallel_group="5").select("id")


@query("command_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), '1') OR contains(lower(p_type), 'steel')")
def command_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Commands whose name or id holds a text, whatever its case."""
    own = load(spark, sf, "part")
    return own.where(flt.disjunction([flt.contains_text("p_name", "1"), flt.contains_text("p_type", "STEEL")])).select("p_partkey", "p_name")


@query("unique_name", "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = 'customer#000000021'")
def unique_name(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").where(F.lower("c_name") == "customer#000000021").select("c_custkey", "c_name")


@query("extension_search", with_views("SELECT path, name FROM notes WHERE extension = 'txt' ORDER BY name, path"))
def extension_search(spark: SparkSession, sf: str) -> DataFrame:
    return flt.file_filter(notes(spark, sf), extensions=[".TXT"]).orderBy("name", "path").select("path", "name")


@query("event_files", with_views("SELECT device, type, count(*) AS items, max(ms) AS newest, 1 AS files FROM activity GROUP BY device, type"))
def event_files(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended to a log of JSON lines, a folder a device, and read back with their files."""
    folder = shared_dir(spark)
    events = activity(spark, sf).select(F.col("id").cast("string").alias("id"), "type", F.col("device").cast("string").alias("deviceId"), F.col("ms").alias("timestamp"))
    eventlog.append_log(events, folder, by="deviceId")
    found = eventlog.read_log(spark, folder).withColumn("folder", F.element_at(F.split("file", "/"), -2))
    counted = found.groupBy(F.col("deviceId").cast("long").alias("device"), "type").agg(F.count(F.lit(1)).alias("items"), F.max("timestamp").alias("newest"), F.count_distinct("folder").cast("int").alias("files"))
    return counted


@query("legacy_documents", "SELECT r_regionkey AS id, r_name AS name, string_agg(n_name, ',' ORDER BY n_nationkey) AS items FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def legacy_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A collection kept as a JSON document a region, written and read back."""
    path = shared_dir(spark)
    items = load(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))).alias("items"))
    eventlog.write_documents(load(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")).join(items, "id"), "id", path)
    back = eventlog.read_documents(spark, path, "id int, name string, items array<struct<key: int, name: string>>")
    return back.select("id", "name", F.array_join("items.name", ",").alias("items"))
