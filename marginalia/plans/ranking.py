"""Sorting, paging, top rows, numbering, merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import index
from marginalia.operators import ranking as rank
from marginalia.plans.registry import query
from marginalia.plans.relations import PRICES_SQL, prices
from marginalia.sources.tables import DAY_MS, NOW_MS, activity, load, messages, notes, with_views

SCORED = "SELECT id, type, workspace, session, ms, round(value / 100, 6) AS score FROM activity"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return activity(spark, sf).select("id", "type", "workspace", "session", "ms", F.round(F.col("value") / 100, 6).alias("score"))


@query("seq_renumber", with_views("SELECT id, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY ms, id) - 1 AS sequence_number FROM messages"))
def seq_renumber(spark: SparkSession, sf: str) -> DataFrame:
    return rank.numbered(messages(spark, sf), "conv_id", ["ms", "id"], "sequence_number", F.floor(F.col("ms") / 600_000)).select("id", "conv_id", "sequence_number")


@query("diversity_penalty", with_views(f"SELECT id, workspace, round(greatest(0.0, score - 0.1 * (row_number() OVER (PARTITION BY workspace ORDER BY score DESC, id) - 1)), 6) AS score FROM ({SCORED}) WHERE type = 'click'"))
def diversity_penalty(spark: SparkSession, sf: str) -> DataFrame:
    return rank.diversified(scored(spark, sf).where("type = 'click'"), "workspace", "score", "id", bucket=F.floor(F.col("score") * -4)).select("id", "workspace", F.round("score", 6).alias("score"))


@query("first_wins", with_views("SELECT session, id, type FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ms, id) AS r FROM activity) WHERE r = 1"))
def first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return rank.first_of(activity(spark, sf).select("session", "id", "type", "ms"), ["session"], [F.col("ms"), F.col("id")]).select("session", "id", "type")


@query("paginate", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200 OFFSET 400")
def paginate(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of at most 200 rows, though 500 were asked for."""
    return rank.page(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 2, 500)


@query("page_meta", with_views("SELECT workspace, count(*) AS total, CAST(ceil(count(*) / 25) AS BIGINT) AS total_pages, ceil(count(*) / 25) > 2 AS has_next, TRUE AS has_previous, CAST(greatest(0, least(25, count(*) - 25)) AS BIGINT) AS on_page FROM activity GROUP BY workspace"))
def page_meta(spark: SparkSession, sf: str) -> DataFrame:
    counted = activity(spark, sf).groupBy("workspace").agg(F.count(F.lit(1)).alias("total"))
    return counted.select("workspace", "total", *rank.page_info(F.col("total"), 1))


@query("dynamic_sort", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 50")
def dynamic_sort(spark: SparkSession, sf: str) -> DataFrame:
    allowed = {"name": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment"}
    return rank.sorted_by(load(spark, sf, "customer"), allowed, "balance", True, "c_custkey").limit(50).select("c_custkey", "c_name", "c_acctbal")


@query("result_sort", with_views(f"SELECT id, score, ms FROM ({SCORED}) ORDER BY score DESC, ms DESC, id LIMIT 100"))
def result_sort(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).orderBy(F.desc("score"), F.desc("ms"), "id").limit(100).select("id", "score", "ms")


@query("relevance_sort", with_views(f"SELECT id, round(score + CASE WHEN type = 'click' THEN 0.1 ELSE 0.0 END + CASE WHEN (SELECT max(ms) FROM activity) - ms < 86400000 THEN 0.05 ELSE 0.0 END, 6) AS relevance FROM ({SCORED}) ORDER BY relevance DESC, id LIMIT 100"))
def relevance_sort(spark: SparkSession, sf: str) -> DataFrame:
    own = scored(spark, sf)
    newest = own.agg(F.max("ms")).scalar()
    relevance = F.col("score") + F.when(F.col("type") == "click", 0.1).otherwise(0.0) + F.when(newest - F.col("ms") < DAY_MS, 0.05).otherwise(0.0)
    return own.select("id", F.round(relevance, 6).alias("relevance")).orderBy(F.desc("relevance"), "id").limit(100)


@query("recent_files", with_views("SELECT path, modified FROM notes WHERE starts_with(path, 'en/') ORDER BY modified DESC, path LIMIT 20"))
def recent_files(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).where(F.col("path").startswith("en/")).orderBy(F.desc("modified"), "path").limit(20).select("path", "modified")


@query("mixed_sort", with_views("SELECT kind, name FROM (SELECT DISTINCT 'folder' AS kind, folder AS name, 0 AS modified FROM notes UNION ALL SELECT 'file', path, modified FROM notes) ORDER BY kind DESC, CASE WHEN kind = 'folder' THEN name END, CASE WHEN kind = 'file' THEN -modified END, name LIMIT 100"))
def mixed_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Folders first by name, then files by change, newest first."""
    own = notes(spark, sf)
    both = own.select(F.lit("folder").alias("kind"), F.col("folder").alias("name"), F.lit(0).cast("long").alias("modified")).distinct().union(own.select(F.lit("file"), "path", "modified"))
    return both.orderBy(F.desc("kind"), F.when(F.col("kind") == "folder", F.col("name")), F.when(F.col("kind") == "file", -F.col("modified")), "name").limit(100).select("kind", "name")


@query("batch_order", with_views("SELECT batch, steps, row_number() OVER (ORDER BY batch <> 'default', batch) AS position FROM (SELECT CASE WHEN type = 'view' THEN 'default' ELSE type END AS batch, count(*) AS steps FROM activity GROUP BY 1)"))
def batch_order(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    groups = activity(spark, sf).groupBy(F.when(F.col("type") == "view", "default").otherwise(F.col("type")).alias("batch")).agg(F.count(F.lit(1)).alias("steps"))
    place = F.row_number().over(Window.orderBy(F.col("batch") != "default", "batch"))  # over a row per group
    return groups.select("batch", "steps", place.cast("long").alias("position"))


@query("compare_costs", with_views(f"SELECT model, round(1000 / 1e6 * price_in + 500 / 1e6 * price_out, 8) AS total FROM (VALUES ('view'), ('click'), ('unknown'), ('purchase')) AS asked(model) JOIN {PRICES_SQL} USING (model)"))
def compare_costs(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.createDataFrame([("view",), ("click",), ("unknown",), ("purchase",)], "model string")
    total = F.round(F.lit(1000) / 1e6 * F.col("price_in") + F.lit(500) / 1e6 * F.col("price_out"), 8)
    return asked.join(F.broadcast(prices(spark)), "model").select("model", total.alias("total")).orderBy("total", "model")


@query("lru_cutoff", with_views("SELECT doc_id, CAST(running AS BIGINT) AS running, running > 800000 AS evicted FROM (SELECT doc_id, sum(size) OVER (ORDER BY modified DESC, doc_id) AS running FROM notes)"))
def lru_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """Oldest out until the rest fits in 80 percent of a million characters."""
    own = notes(spark, sf).select("doc_id", "size", "modified")
    age = F.floor((F.lit(NOW_MS) - F.col("modified")) / DAY_MS)
    return rank.running_sum(own, age, [F.desc("modified"), F.col("doc_id")], "size", "running").select("doc_id", "running", (F.col("running") > 800_000).alias("evicted"))


@query("merge_results", with_views(f"SELECT session, id, score FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, id) AS r FROM ({SCORED}) WHERE type IN ('view', 'click', 'purchase')) WHERE r = 1"))
def merge_results(spark: SparkSession, sf: str) -> DataFrame:
    own = scored(spark, sf)
    together = reduce(DataFrame.unionByName, (own.where(F.col("type") == t) for t in ("view", "click", "purchase")))
    return rank.first_of(together.select("session", "id", "score"), ["session"], [-F.col("score"), F.col("id")]).select("session", "id", "score")


@query("batch_merge", with_views(f"SELECT type, position, workspace, score, total > 10 AS has_more FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, workspace) AS position, count(*) OVER (PARTITION BY type) AS total FROM (SELECT *, row_number() OVER (PARTITION BY type, workspace ORDER BY ms, id) AS r FROM ({SCORED})) WHERE r = 1) WHERE position <= 10"))
def batch_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Per category: the first of each id, the ten best of these, and whether there are more."""
    once = rank.first_of(scored(spark, sf), ["type", "workspace"], [F.col("ms"), F.col("id")]).select("type", "workspace", "score")
    totals = once.groupBy("type").agg((F.count(F.lit(1)) > 10).alias("has_more"))
    best = rank.top_per(once, "type", [F.desc("score"), F.col("workspace")], 10)
    return best.join(totals, "type").select("type", "position", "workspace", "score", "has_more")


TERMS_SQL = "SELECT DISTINCT unnest(list_filter(string_split_regex(regexp_replace(lower(content), '[^A-Za-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2)) AS word, doc_id AS id, lang FROM notes"


@query("postings_or", with_views(f"SELECT id, count(*) AS matched FROM ({TERMS_SQL}) WHERE word IN ('the', 'and', 'nicht') GROUP BY id"))
def postings_or(spark: SparkSession, sf: str) -> DataFrame:
    """Without a kept index: each text is looked at once, and no words are dealt out."""
    found = index.matched(F.col("content"), ["The", "and", "nicht"]).cast("long").alias("matched")
    return notes(spark, sf).select(F.col("doc_id").alias("id"), found).where("matched > 0")
