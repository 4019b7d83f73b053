"""Joins, groupings and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.paths import depth
from marginalia.operators import aggregates as agg
from marginalia.operators import joins
from marginalia.plans.registry import query
from marginalia.sources.tables import START_MS, activity, load, messages, notes, with_views


def rows() -> Column:
    return F.count(F.lit(1))


#: The price list: a fixed dimension of five models, dollars per million tokens in and out.
PRICES = [("view", "acme", 0.5, 1.5, 8000), ("click", "acme", 1.0, 3.0, 16000), ("purchase", "bolt", 10.0, 30.0, 128000), ("signup", "bolt", 2.5, 10.0, 64000), ("error", "cosa", 0.0, 0.0, 4000)]
PRICES_SQL = "(VALUES " + ", ".join(f"('{m}', '{p}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({w} AS BIGINT))" for m, p, a, b, w in PRICES) + ") AS prices(model, provider, price_in, price_out, context_window)"


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, provider string, price_in double, price_out double, context_window long")


def usage(spark: SparkSession, sf: str) -> DataFrame:
    """Activity as model requests: tokens and cost."""
    calls = activity(spark, sf).withColumns({"model": F.col("type"), "tokens_in": F.col("k") * 100, "tokens_out": F.floor(F.col("value")).cast("long")})
    priced = calls.join(F.broadcast(prices(spark)), "model")  # five rows
    return priced.withColumn("cost", F.col("tokens_in") / 1e6 * F.col("price_in") + F.col("tokens_out") / 1e6 * F.col("price_out"))


USAGE = f"SELECT a.*, type AS model, k * 100 AS tokens_in, CAST(floor(value) AS BIGINT) AS tokens_out, provider, context_window, k * 100 / 1e6 * price_in + CAST(floor(value) AS BIGINT) / 1e6 * price_out AS cost FROM activity a JOIN {PRICES_SQL} ON type = model"


@query("hierarchy_nest", "SELECT c_custkey, count(DISTINCT o_orderkey) AS sessions, coalesce(string_agg(o_orderkey || '/' || n, ',' ORDER BY o_orderkey), '') AS tree FROM (SELECT c_custkey, o_orderkey, count(l_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1")
def hierarchy_nest(spark: SparkSession, sf: str) -> DataFrame:
    """Workspaces with their sessions and the number of traces in each; workspaces without sessions stay."""
    lines = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(rows().alias("n"))
    orders = load(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(lines, "o_orderkey", "left").na.fill(0, ["n"])
    tree = joins.nested(load(spark, sf, "customer").select("c_custkey"), orders, "c_custkey", "o_orderkey", ["n"], "sessions")
    text = F.array_join(F.transform("sessions", lambda s: F.concat_ws("/", s["o_orderkey"].cast("string"), s["n"].cast("string"))), ",")
    return tree.select("c_custkey", F.size("sessions").cast("long").alias("sessions"), text.alias("tree"))


@query("export_nested", with_views("SELECT conv_id, count(*) AS message_count, string_agg(role || ':' || length(content), ' ' ORDER BY seq) AS outline FROM messages GROUP BY conv_id"))
def export_nested(spark: SparkSession, sf: str) -> DataFrame:
    own = messages(spark, sf)
    nest = joins.nested(own.select("conv_id").distinct(), own, "conv_id", "seq", ["role", "content"], "messages")
    outline = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["content"]).cast("string"))), " ")
    return nest.select("conv_id", F.size("messages").cast("long").alias("message_count"), outline.alias("outline"))


@query("left_lookup", "SELECT o_orderkey, o_custkey, coalesce(c_name, 'Unknown Workspace') AS workspace_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON o_custkey = c_custkey")
def left_lookup(spark: SparkSession, sf: str) -> DataFrame:
    known = load(spark, sf, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("workspace_name"))
    return joins.lookup(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey", "workspace_name", "Unknown Workspace")


@query("bucket_range_join", with_views("SELECT b AS bucket, count(*) AS items, min(id) AS first_id FROM (SELECT range AS b, 1704067200000 + range * 432000000 AS lo, 1704067200000 + range * 432000000 + 518400000 AS hi FROM range(0, 7)) r JOIN activity ON ms >= lo AND ms <= hi GROUP BY b"))
def bucket_range_join(spark: SparkSession, sf: str) -> DataFrame:
    """Events in each of seven overlapping six-day ranges."""
    ranges = spark.range(7).select(F.col("id").alias("bucket"), (F.lit(START_MS) + F.col("id") * 432_000_000).alias("lo"), (F.lit(START_MS) + F.col("id") * 432_000_000 + 518_400_000).alias("hi"))
    spans = activity(spark, sf).select("id", F.col("ms").alias("start"), F.col("ms").alias("end"))
    return joins.overlapping(ranges, spans, 86_400_000).groupBy("bucket").agg(rows().alias("items"), F.min("id").alias("first_id"))


@query("link_resolve", with_views("SELECT DISTINCT s.path AS src, t.path AS dst FROM notes s JOIN notes t ON t.name = 'doc_' || (s.doc_id * 7 % 500) WHERE s.path <> t.path"))
def link_resolve(spark: SparkSession, sf: str) -> DataFrame:
    own = notes(spark, sf)
    target = F.concat(F.lit("Some/Folder/DOC_"), (F.col("doc_id") * 7 % 500).cast("string"), F.lit(".md#part"))
    return joins.resolve_links(own.select(F.col("path").alias("src"), target.alias("link")), own.select("path", "name"))


@query("fuzzy_theta", """WITH p AS (SELECT p_partkey, lower(replace(p_brand, '#', '')) AS a FROM part), s AS (SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN '' || s_nationkey ELSE 'brand' || s_nationkey END AS b FROM supplier),
near AS (SELECT a, b, parts, suppliers FROM (SELECT a, count(*) AS parts FROM p GROUP BY a) JOIN (SELECT b, count(*) AS suppliers FROM s GROUP BY b) ON contains(a, b) OR contains(b, a))
SELECT 'pair' AS kind, NULL::BIGINT AS id, a, b, parts * suppliers AS links FROM near
UNION ALL SELECT 'part', p_partkey, p.a, NULL, coalesce(n, 0)::BIGINT FROM p LEFT JOIN (SELECT a, sum(suppliers) AS n FROM near GROUP BY a) t ON p.a = t.a
UNION ALL SELECT 'supplier', s_suppkey, NULL, s.b, coalesce(n, 0)::BIGINT FROM s LEFT JOIN (SELECT b, sum(parts) AS n FROM near GROUP BY b) t ON s.b = t.b""")
def fuzzy_theta(spark: SparkSession, sf: str) -> DataFrame:
    """Names that hold one another, and what parts and suppliers have them: a row for each pair of names, and for each part and each supplier with its name and number of links. Parts and suppliers of names that are a pair are linked, all with all."""
    nation = F.col("s_nationkey").cast("string")
    parts = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("a"))
    suppliers = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") % 5 == 0, nation).otherwise(F.concat(F.lit("brand"), nation)).alias("b"))
    counted = lambda df, name, n: df.groupBy(name).agg(F.count(F.lit(1)).alias(n))
    near = joins.holding_one_another(parts.select("a"), suppliers.select("b")).join(counted(parts, "a", "parts"), "a").join(counted(suppliers, "b", "suppliers"), "b")
    linked = lambda df, name, n: df.join(near.groupBy(name).agg(F.sum(n).alias("links")), name, "left").withColumn("links", F.coalesce("links", F.lit(0)))
    own = linked(parts, "a", "suppliers").select(F.lit("part").alias("kind"), "id", "a", F.lit(None).cast("string").alias("b"), "links")
    theirs = linked(suppliers, "b", "parts").select(F.lit("supplier").alias("kind"), "id", F.lit(None).cast("string").alias("a"), "b", "links")
    pairs = near.select(F.lit("pair").alias("kind"), F.lit(None).cast("long").alias("id"), "a", "b", (F.col("parts") * F.col("suppliers")).alias("links"))
    return pairs.unionByName(own).unionByName(theirs)


@query("price_lookup", with_views(f"SELECT id, type AS model, provider, price_in FROM activity JOIN {PRICES_SQL} ON type = model"))
def price_lookup(spark: SparkSession, sf: str) -> DataFrame:
    named = activity(spark, sf).withColumn("asked", F.when(F.col("id") % 3 == 0, F.concat("type", F.lit(":online"))).otherwise(F.col("type")))
    return named.withColumn("model", joins.model_key(F.col("asked"))).join(F.broadcast(prices(spark)), "model").select("id", "model", "provider", "price_in")


@query("prior_results", with_views("SELECT id, coalesce(string_agg(role, ',' ORDER BY seq) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS earlier FROM messages"))
def prior_results(spark: SparkSession, sf: str) -> DataFrame:
    return joins.earlier_results(messages(spark, sf), "conv_id", "seq", "role", ",").select("id", "earlier")


@query("count_all", "SELECT o_orderstatus, count(*) AS items, count(CASE WHEN o_totalprice > 250000 THEN 1 END) AS large FROM orders GROUP BY o_orderstatus")
def count_all(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").groupBy("o_orderstatus").agg(rows().alias("items"), F.count_if(F.col("o_totalprice") > 250_000).alias("large"))


@query("db_stats", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ("customer", "orders", "events", "documents", "conversations")) + " UNION ALL SELECT 'total', CAST((SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM events) + (SELECT count(*) FROM documents) + (SELECT count(*) FROM conversations) AS BIGINT)")
def db_stats(spark: SparkSession, sf: str) -> DataFrame:
    return agg.row_counts({t: load(spark, sf, t) for t in ("customer", "orders", "events", "documents", "conversations")})


@query("next_sequence", "SELECT c_custkey, coalesce(max(n), -1) + 1 AS next_sequence FROM customer LEFT JOIN (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders) ON o_custkey = c_custkey GROUP BY c_custkey")
def next_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """Orders are numbered from 0 within a customer, so the next number is how many there are."""
    held = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(rows().alias("n"))
    return load(spark, sf, "customer").select("c_custkey").join(held, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("next_sequence"))


@query("conv_rollup", with_views("SELECT conv_id, count(DISTINCT id) AS message_count, max(ms) AS updated FROM messages GROUP BY conv_id"))
def conv_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Replayed messages count once."""
    own = messages(spark, sf)
    return own.union(own.where("seq = 0")).groupBy("conv_id", "id").agg(F.max("ms").alias("ms")).groupBy("conv_id").agg(rows().alias("message_count"), F.max("ms").alias("updated"))


@query("group_by_key", with_views("SELECT CASE WHEN type = 'error' THEN 'none' ELSE type END AS kind, count(*) AS items, round(sum(value), 4) AS total_score, round(avg(value), 6) AS average_score FROM activity GROUP BY 1"))
def group_by_key(spark: SparkSession, sf: str) -> DataFrame:
    labelled = activity(spark, sf).withColumn("kind_or_null", F.when(F.col("type") != "error", F.col("type")))
    return agg.grouped(labelled, {"kind": ("kind_or_null", "none")}, "value")


@query("group_by_two", with_views("SELECT type AS kind, CAST(device AS VARCHAR) AS part, count(*) AS items, round(sum(value), 4) AS total_score, round(avg(value), 6) AS average_score FROM activity GROUP BY 1, 2"))
def group_by_two(spark: SparkSession, sf: str) -> DataFrame:
    return agg.grouped(activity(spark, sf), {"kind": ("type", "none"), "part": ("device", "none")}, "value")


@query("group_stats", with_views("SELECT workspace, count(*) AS items, min(value) AS min_score, max(value) AS max_score, round(stddev_pop(value), 6) AS deviation, count(CASE WHEN type = 'click' THEN 1 END) AS clicks, count(CASE WHEN type = 'view' THEN 1 END) AS views, min(ms) AS oldest, max(ms) AS newest FROM activity GROUP BY workspace"))
def group_stats(spark: SparkSession, sf: str) -> DataFrame:
    return activity(spark, sf).groupBy("workspace").agg(
        rows().alias("items"), *agg.spread("value"), F.count_if(F.col("type") == "click").alias("clicks"), F.count_if(F.col("type") == "view").alias("views"), F.min("ms").alias("oldest"), F.max("ms").alias("newest")
    )


@query("stats_of_groups", with_views("SELECT band, count(*) AS groups, max(items) AS largest, min(items) AS smallest, round(avg(items), 6) AS mean_size FROM (SELECT workspace, count(*) AS items, CASE WHEN s < 0.2 THEN 'very low' WHEN s < 0.4 THEN 'low' WHEN s < 0.6 THEN 'medium' WHEN s < 0.8 THEN 'high' WHEN s < 1.0 THEN 'very high' ELSE 'top' END AS band FROM (SELECT workspace, round(avg(value) OVER (PARTITION BY workspace) / 50, 6) AS s FROM activity) GROUP BY workspace, s) GROUP BY band"))
def stats_of_groups(spark: SparkSession, sf: str) -> DataFrame:
    groups = activity(spark, sf).groupBy("workspace").agg(rows().alias("items"), F.round(F.avg("value") / 50, 6).alias("s"))
    return groups.groupBy(agg.band(F.col("s")).alias("band")).agg(rows().alias("groups"), F.max("items").alias("largest"), F.min("items").alias("smallest"), F.round(F.avg("items"), 6).alias("mean_size"))


@query("result_summary", with_views("SELECT count(*) AS total, round(avg(value), 3) AS average_score, count(DISTINCT type) AS types, min(ms) AS oldest, max(ms) AS newest FROM activity WHERE success"))
def result_summary(spark: SparkSession, sf: str) -> DataFrame:
    return activity(spark, sf).where("success").agg(rows().alias("total"), F.round(F.avg("value"), 3).alias("average_score"), F.countDistinct("type").alias("types"), F.min("ms").alias("oldest"), F.max("ms").alias("newest"))


@query("conv_stats", with_views("SELECT vault, count(*) AS conversations, CAST(sum(n) AS BIGINT) AS message_total, min(created) AS first_created, max(created) AS last_created FROM (SELECT CASE WHEN conv_id % 4 = 0 THEN 'Unknown' ELSE 'vault' || conv_id % 4 END AS vault, conv_id, count(*) AS n, min(ms) AS created FROM messages GROUP BY 1, 2) GROUP BY vault"))
def conv_stats(spark: SparkSession, sf: str) -> DataFrame:
    vault = F.when(F.col("conv_id") % 4 != 0, F.concat(F.lit("vault"), (F.col("conv_id") % 4).cast("string")))
    one = messages(spark, sf).groupBy("conv_id").agg(rows().alias("n"), F.min("ms").alias("created"))
    return one.groupBy(F.coalesce(vault, F.lit("Unknown")).alias("vault")).agg(rows().alias("conversations"), F.sum("n").alias("message_total"), F.min("created").alias("first_created"), F.max("created").alias("last_created"))


@query("ws_counters", with_views("SELECT workspace, count(DISTINCT session) AS sessions, count(*) AS traces FROM activity GROUP BY workspace"))
def ws_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counted by session first, so distinct sessions need no second shuffle of the traces."""
    one = activity(spark, sf).groupBy("workspace", "session").agg(rows().alias("n"))
    return one.groupBy("workspace").agg(rows().alias("sessions"), F.sum("n").alias("traces"))


@query("ext_histogram", with_views("SELECT extension, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM notes GROUP BY extension"))
def ext_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).groupBy("extension").agg(rows().alias("files"), F.sum("size").alias("bytes"))


TAG_ROWS = "(SELECT id, type AS tag FROM activity UNION ALL SELECT id, 'user' || workspace % 40 FROM activity)"


def tag_rows(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.array("type", F.concat(F.lit("user"), (F.col("workspace") % 40).cast("string")))
    return activity(spark, sf).select("id", F.explode(tags).alias("tag"))


@query("popular_tags", with_views(f"SELECT tag, count(*) AS uses, least(1.0::DOUBLE, count(*) / 1000.0::DOUBLE) AS score FROM {TAG_ROWS} GROUP BY tag ORDER BY uses DESC, tag LIMIT 20"))
def popular_tags(spark: SparkSession, sf: str) -> DataFrame:
    counted = tag_rows(spark, sf).groupBy("tag").agg(rows().alias("uses"))
    return counted.withColumn("score", F.least(F.lit(1.0), F.col("uses") / 1000.0)).orderBy(F.desc("uses"), "tag").limit(20)


@query("tag_stats", with_views(f"SELECT count(DISTINCT tag) AS tags, count(*) AS uses, count(DISTINCT id) AS items FROM {TAG_ROWS}"))
def tag_stats(spark: SparkSession, sf: str) -> DataFrame:
    return tag_rows(spark, sf).agg(F.countDistinct("tag").alias("tags"), rows().alias("uses"), F.countDistinct("id").alias("items"))


@query("tree_stats", with_views("SELECT count(*) AS files, count(DISTINCT folder) AS folders, count(CASE WHEN lang = 'en' THEN 1 END) AS related, max(len(string_split(path, '/'))) AS max_depth FROM notes"))
def tree_stats(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).agg(rows().alias("files"), F.countDistinct("folder").alias("folders"), F.count_if(F.col("lang") == "en").alias("related"), F.max(depth(F.col("path"))).cast("long").alias("max_depth"))


@query("usage_rollup", with_views(f"SELECT coalesce(month, 'all') AS month, provider, count(*) AS requests, round(sum(cost), 8) AS cost FROM (SELECT *, strftime(make_timestamp(ms * 1000), '%Y-%m') AS month FROM ({USAGE})) GROUP BY GROUPING SETS ((month, provider), (provider))"))
def usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """By month and provider, and by provider over all time, in one pass of grouping sets."""
    monthly = usage(spark, sf).withColumn("month", F.date_format(F.timestamp_millis("ms"), "yyyy-MM"))
    rolled = monthly.groupingSets([["month", "provider"], ["provider"]], "month", "provider").agg(rows().alias("requests"), F.round(F.sum("cost"), 8).alias("cost"))
    return rolled.select(F.coalesce("month", F.lit("all")).alias("month"), "provider", "requests", "cost")


@query("budget_status", with_views(f"SELECT provider, CASE WHEN b > 0 THEN round(100 * c / b, 2) ELSE 0.0 END AS percent_used, b > 0 AND c >= b AS exceeded, CASE WHEN b > 0 THEN round(greatest(0.0, b - c), 2) END AS remaining FROM (SELECT provider, round(sum(cost), 8) AS c, CASE provider WHEN 'acme' THEN 5.0::DOUBLE WHEN 'bolt' THEN 1000.0::DOUBLE ELSE 0.0::DOUBLE END AS b FROM ({USAGE}) GROUP BY provider)"))
def budget_status(spark: SparkSession, sf: str) -> DataFrame:
    spent = usage(spark, sf).groupBy("provider").agg(F.round(F.sum("cost"), 8).alias("c"))
    limit = F.when(F.col("provider") == "acme", 5.0).when(F.col("provider") == "bolt", 1000.0).otherwise(0.0)
    return spent.select("provider", *agg.budget(F.col("c"), limit))


@query("cost_by_model", with_views(f"SELECT provider || '/' || model AS model, count(*) AS requests, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(sum(cost), 8) AS cost, round(avg(cost), 8) AS average_cost FROM ({USAGE}) GROUP BY 1"))
def cost_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return usage(spark, sf).groupBy(F.concat_ws("/", "provider", "model").alias("model")).agg(
        rows().alias("requests"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost"), 8).alias("cost"), F.round(F.avg("cost"), 8).alias("average_cost")
    )


@query("cost_share", with_views(f"SELECT provider, round(sum(cost), 8) AS cost, round(100 * sum(cost) / sum(sum(cost)) OVER (), 4) AS percent FROM ({USAGE}) GROUP BY provider"))
def cost_share(spark: SparkSession, sf: str) -> DataFrame:
    own = usage(spark, sf).groupBy("provider").agg(F.sum("cost").alias("c"))
    total = F.sum("c").over(Window.partitionBy())  # over a row per provider
    return own.select("provider", F.round("c", 8).alias("cost"), F.round(100 * F.col("c") / total, 4).alias("percent"))


@query("cost_argmax", with_views(f"SELECT arg_max(model, (c, model)) AS dearest, arg_min(model, (c, model)) AS cheapest FROM (SELECT model, round(sum(cost), 8) AS c FROM ({USAGE}) GROUP BY model)"))
def cost_argmax(spark: SparkSession, sf: str) -> DataFrame:
    own = usage(spark, sf).groupBy("model").agg(F.round(F.sum("cost"), 8).alias("c"))
    return own.agg(F.max_by("model", F.struct("c", "model")).alias("dearest"), F.min_by("model", F.struct("c", "model")).alias("cheapest"))


@query("cost_once", with_views(f"SELECT workspace, round(sum(cost), 8) AS cost, count(*) AS requests FROM ({USAGE}) GROUP BY workspace"))
def cost_once(spark: SparkSession, sf: str) -> DataFrame:
    """A message that was recorded twice costs once."""
    own = usage(spark, sf).select("id", "workspace", "cost")
    once = own.union(own.where("id % 3 = 0")).groupBy("workspace", "id").agg(F.max("cost").alias("cost"))
    return once.groupBy("workspace").agg(F.round(F.sum("cost"), 8).alias("cost"), rows().alias("requests"))


@query("batch_stats", with_views("SELECT session, count(*) AS total, count(CASE WHEN success THEN 1 END) AS succeeded, count(CASE WHEN NOT success THEN 1 END) AS failed, round(sum(value), 4) AS total_time, round(avg(value), 6) AS average_time, round(100.0 * count(CASE WHEN success THEN 1 END) / count(*), 3) AS success_rate, CAST(sum(CASE WHEN success THEN k END) AS BIGINT) AS tokens, count(DISTINCT type) AS models FROM activity GROUP BY session"))
def batch_stats(spark: SparkSession, sf: str) -> DataFrame:
    good = F.count_if("success")
    return activity(spark, sf).groupBy("session").agg(
        rows().alias("total"), good.alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.round(F.sum("value"), 4).alias("total_time"), F.round(F.avg("value"), 6).alias("average_time"),
        F.round(100.0 * good / rows(), 3).alias("success_rate"), F.sum(F.when(F.col("success"), F.col("k"))).alias("tokens"), F.size(F.collect_set("type")).cast("long").alias("models"),
    )


@query("ordered_concat", with_views("SELECT conv_id, string_agg(role || ' ' || seq, ' | ' ORDER BY seq) AS merged FROM messages GROUP BY conv_id"))
def ordered_concat(spark: SparkSession, sf: str) -> DataFrame:
    step = messages(spark, sf).withColumn("step", F.concat_ws(" ", "role", F.col("seq").cast("string")))
    return step.groupBy("conv_id").agg(agg.ordered_text("seq", "step", " | ").alias("merged"))


@query("catalogue_stats", "SELECT p_brand, count(*) AS models, round(avg(p_size), 6) AS average_context, max(p_size) AS largest_context, min(p_retailprice) AS cheapest, max(p_retailprice) AS dearest FROM part GROUP BY p_brand")
def catalogue_stats(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").groupBy("p_brand").agg(rows().alias("models"), F.round(F.avg("p_size"), 6).alias("average_context"), F.max("p_size").alias("largest_context"), F.min("p_retailprice").alias("cheapest"), F.max("p_retailprice").alias("dearest"))


@query("payload_ratio", with_views("SELECT lang, count(*) AS results, round(avg(length(content)), 4) AS average_length, round(150.0 * count(*) / sum(length(content)), 8) AS ratio FROM notes GROUP BY lang"))
def payload_ratio(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("content")
    return notes(spark, sf).groupBy("lang").agg(rows().alias("results"), F.round(F.avg(n), 4).alias("average_length"), F.round(F.lit(150.0) * rows() / F.sum(n), 8).alias("ratio"))


@query("related_files", with_views("SELECT session, array_to_string(list_sort(list_distinct(flatten(list([type, 'user' || workspace])))), ',') AS files FROM activity GROUP BY session"))
def related_files(spark: SparkSession, sf: str) -> DataFrame:
    named = activity(spark, sf).select("session", F.explode(F.array("type", F.concat(F.lit("user"), F.col("workspace").cast("string")))).alias("file"))
    return named.groupBy("session").agg(F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"))
