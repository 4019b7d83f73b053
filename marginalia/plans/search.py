"""Search: scores, snippets, the inverted index, several sources at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.operators import index
from marginalia.operators.ranking import top_per
from marginalia.plans.ranking import SCORED, TERMS_SQL, scored
from marginalia.plans.registry import query
from marginalia.plans.relations import TAG_ROWS, tag_rows
from marginalia.sources.tables import DAY_MS, NOW_MS, activity, load, messages, notes, with_views
from marginalia.streaming import live

QUERY = "the and ingthe"


def _score_sql(text: str, phrase: str) -> str:
    words = [w for w in phrase.lower().split() if len(w) > 2]
    n = " + ".join(f"CAST(contains(lower({text}), '{w}') AS INTEGER)" for w in words)
    return f"CASE WHEN contains(lower({text}), '{phrase}') THEN 0.9::DOUBLE WHEN {n} > 0 THEN greatest(0.3::DOUBLE, 0.8::DOUBLE * ({n}) / {len(words)}) END"


def _fuzzy_sql(name: str, wanted: str) -> str:
    return f"CASE WHEN lower({name}) LIKE '%{'%'.join(wanted)}%' THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - (length({name}) - {len(wanted)}) / 100.0::DOUBLE)) END"


def _at_sql(text: str, phrase: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(instr(lower({text}), '{q}'), 0)" for q in [phrase, *(w for w in phrase.split() if len(w) > 2)]) + ", 0)"


def _snippet_sql(text: str, at: str, width: int, half: int = 75) -> str:
    start = f"CASE WHEN {at} > 0 THEN greatest(0, {at} - 1 - {half}) ELSE 0 END"
    end = f"CASE WHEN {at} > 0 THEN least(length({text}), {at} - 1 + {width} + {half}) ELSE least(length({text}), {2 * half}) END"
    return f"CASE WHEN ({start}) > 0 THEN '...' ELSE '' END || trim(substr({text}, ({start}) + 1, ({end}) - ({start}))) || CASE WHEN ({end}) < length({text}) THEN '...' ELSE '' END"


_KW, _FZ, _AT = _score_sql("content", QUERY), _fuzzy_sql("name", "doc1"), _at_sql("content", QUERY)


@query("content_search", with_views(f"SELECT doc_id, path, round(score, 6) AS score, {_snippet_sql('content', 'place', len(QUERY))} AS snippet FROM (SELECT *, coalesce(0.6::DOUBLE * kw + 0.4::DOUBLE * fz, kw, fz) AS score, {_AT} AS place FROM (SELECT *, {_KW} AS kw, {_FZ} AS fz FROM notes)) WHERE score IS NOT NULL ORDER BY round(score, 6) DESC, doc_id LIMIT 10"))
def content_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best notes by keywords in the content and letters of the name, with a snippet of each.

    Scores come first and snippets only for the ten rows that are left.
    """
    score = tx.combined(tx.keyword_score(F.col("low"), QUERY, lowered=True), tx.fuzzy_score(F.col("name"), "doc1"))
    scored_notes = notes(spark, sf).withColumn("low", F.lower("content")).select("doc_id", "path", "content", F.round(score, 6).alias("score"))
    # Notes without a score go after the limit: a filter before it would be pushed to the scan and work every score out twice.
    best = scored_notes.orderBy(F.col("score").desc_nulls_last(), "doc_id").limit(10).where("score is not null")
    return best.select("doc_id", "path", "score", tx.snippet(F.col("content"), tx.found_at(F.col("content"), QUERY), len(QUERY)).alias("snippet"))


@query("keyword_score", with_views(f"SELECT doc_id, round({_KW}, 6) AS score FROM notes WHERE {_KW} IS NOT NULL"))
def keyword_score(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select("doc_id", F.round(tx.keyword_score(F.col("content"), QUERY), 6).alias("score")).where("score is not null")


@query("snippet", with_views(f"SELECT doc_id, {_snippet_sql('content', 'place', len(QUERY))} AS snippet FROM (SELECT *, {_AT} AS place FROM notes)"))
def snippet(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select("doc_id", tx.snippet(F.col("content"), tx.found_at(F.col("content"), QUERY), len(QUERY)).alias("snippet"))


@query("fuzzy_names", with_views(f"SELECT path, round(greatest({_fuzzy_sql('name', 'dc12')}, 0.8::DOUBLE * {_fuzzy_sql('path', 'dc12')}), 6) AS score FROM notes WHERE {_fuzzy_sql('path', 'dc12')} IS NOT NULL"))
def fuzzy_names(spark: SparkSession, sf: str) -> DataFrame:
    score = tx.best((1.0, tx.fuzzy_score(F.col("name"), "dc12")), (0.8, tx.fuzzy_score(F.col("path"), "dc12")))
    return notes(spark, sf).select("path", F.round(score, 6).alias("score")).where("score is not null")


@query("fuzzy_weighted", f"SELECT p_partkey, round(score, 6) AS score FROM (SELECT p_partkey, greatest({_fuzzy_sql('p_name', 'an')}, 0.8::DOUBLE * {_fuzzy_sql('p_type', 'an')}, 0.6::DOUBLE * {_fuzzy_sql('p_brand', 'an')}) AS score FROM part) WHERE score IS NOT NULL ORDER BY round(score, 6) DESC, p_partkey LIMIT 50")
def fuzzy_weighted(spark: SparkSession, sf: str) -> DataFrame:
    score = tx.best(*((w, tx.fuzzy_score(F.col(c), "an")) for c, w in (("p_name", 1.0), ("p_type", 0.8), ("p_brand", 0.6))))
    return load(spark, sf, "part").select("p_partkey", F.round(score, 6).alias("score")).where("score is not null").orderBy(F.desc("score"), "p_partkey").limit(50)


@query("path_rank", with_views("SELECT path, round(CASE WHEN path = 'src1' THEN 1.0 WHEN instr(path, 'src1') = 1 THEN 0.8 ELSE greatest(0.1::DOUBLE, 0.5::DOUBLE - (instr(path, 'src1') - 1) / length(path)) END::DOUBLE, 6) AS score FROM notes WHERE contains(path, 'src1')"))
def path_rank(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select("path", F.round(tx.path_rank(F.col("path"), "SRC1"), 6).alias("score")).where("score is not null")


@query("tag_search", with_views(f"SELECT tag, CASE WHEN tag = 'user1' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS score, count(*) AS items FROM {TAG_ROWS} WHERE contains(tag, 'user1') GROUP BY tag"))
def tag_search(spark: SparkSession, sf: str) -> DataFrame:
    found = tag_rows(spark, sf).where(F.contains("tag", F.lit("user1"))).groupBy("tag").agg(F.count(F.lit(1)).alias("items"))
    return found.select("tag", F.when(F.col("tag") == "user1", 1.0).otherwise(0.8).alias("score"), "items")


@query("property_search", "SELECT event_id, 'k' AS property, json_extract_string(props, '$.k') AS value, CASE WHEN json_extract_string(props, '$.k') = '7' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS score FROM events WHERE contains(json_extract_string(props, '$.k'), '7')")
def property_search(spark: SparkSession, sf: str) -> DataFrame:
    """Properties whose value holds the text asked for; 1 for the value itself."""
    rows = load(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("property", "value"))
    return rows.where(F.contains("value", F.lit("7"))).withColumn("score", F.when(F.col("value") == "7", 1.0).otherwise(0.8))


_SOURCES_SQL = """
SELECT 'workspace' AS source, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS description FROM customer
UNION ALL SELECT 'session', CAST(o_orderkey AS VARCHAR), o_orderpriority, o_orderstatus FROM orders
UNION ALL SELECT 'trace', CAST(id AS VARCHAR), type, content FROM activity
UNION ALL SELECT 'message', id, role, content FROM messages
UNION ALL SELECT 'note', CAST(doc_id AS VARCHAR), name, content FROM notes"""


@query("memory_search", with_views(f"SELECT source, id, score FROM (SELECT source, id, CASE WHEN contains(lower(name), 'user') THEN 0.9::DOUBLE ELSE 0 END + CASE WHEN contains(lower(description), 'user') THEN 0.8::DOUBLE ELSE 0 END AS score FROM ({_SOURCES_SQL})) WHERE score > 0 ORDER BY score DESC, source, id LIMIT 100"))
def memory_search(spark: SparkSession, sf: str) -> DataFrame:
    """Five sources at once: 0.9 for the name, 0.8 more for the description; the hundred best."""
    text = lambda c: F.col(c).cast("string")
    sources = {
        "workspace": load(spark, sf, "customer").select(text("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description")),
        "session": load(spark, sf, "orders").select(text("o_orderkey"), "o_orderpriority", "o_orderstatus"), "trace": activity(spark, sf).select(text("id"), "type", "content"),
        "message": messages(spark, sf).select("id", "role", "content"), "note": notes(spark, sf).select(text("doc_id"), "name", "content"),
    }
    together = reduce(DataFrame.union, (df.select(F.lit(k).alias("source"), "*") for k, df in sources.items()))
    hit = lambda c, s: F.when(F.contains(F.lower(c), F.lit("user")), s).otherwise(0.0)
    return together.select("source", "id", (hit("name", 0.9) + hit("description", 0.8)).alias("score")).where("score > 0").orderBy(F.desc("score"), "source", "id").limit(100)


@query("type_infer", with_views("SELECT id, CASE WHEN type = 'click' THEN 'toolCall' WHEN type = 'signup' THEN 'session' WHEN k > 50 THEN 'state' ELSE 'trace' END AS kind FROM activity"))
def type_infer(spark: SparkSession, sf: str) -> DataFrame:
    """The kind of a result by the first of its fields that is there."""
    own = activity(spark, sf).select("id", F.when(F.col("type") == "click", F.col("id")).alias("tool"), F.when(F.col("type") == "signup", F.col("session")).alias("session_id"), F.when(F.col("k") > 50, F.col("k")).alias("state"))
    return own.select("id", F.when(F.col("tool").isNotNull(), "toolCall").when(F.col("session_id").isNotNull(), "session").when(F.col("state").isNotNull(), "state").otherwise("trace").alias("kind"))


@query("highlight", with_views("SELECT doc_id, CASE WHEN p > 0 THEN substr(content, greatest(0, p - 51) + 1, least(length(content), p + 52) - greatest(0, p - 51)) ELSE left(content, 200) END AS highlight FROM (SELECT *, instr(lower(content), 'der') AS p FROM notes)"))
def highlight(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select("doc_id", tx.highlight(F.col("content"), "der").alias("highlight"))


@query("multi_highlight", with_views("WITH a AS (SELECT doc_id, content, lower(content) AS low, instr(lower(content), 'ana') AS p FROM notes), b AS (SELECT *, CASE WHEN p > 0 AND instr(substr(low, p + 1), 'ana') > 0 THEN p + instr(substr(low, p + 1), 'ana') ELSE 0 END AS q FROM a), c AS (SELECT *, CASE WHEN q > 0 AND instr(substr(low, q + 1), 'ana') > 0 THEN q + instr(substr(low, q + 1), 'ana') ELSE 0 END AS r FROM b) SELECT doc_id, array_to_string(list_transform(list_filter([p, q, r], lambda x: x > 0), lambda x: substr(content, greatest(1, x - 20), least(x + 23, length(content) + 1) - greatest(1, x - 20))), '|') AS highlights FROM c"))
def multi_highlight(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select("doc_id", F.array_join(tx.highlights(F.col("content"), "ana"), "|").alias("highlights"))


_ASKED_SQL = "SELECT id, '#' || role || ' find \"note ' || seq || '\" turn:' || seq || ' about  it #t/' || conv_id AS asked FROM messages"


@query("query_parse", with_views(f"SELECT id, array_to_string(regexp_extract_all(asked, '#([A-Za-z0-9_/-]+)', 1), ',') AS tags, array_to_string(regexp_extract_all(asked, '([A-Za-z0-9_]+:[^\\s]+)', 1), ',') AS properties, array_to_string(regexp_extract_all(asked, '\"([^\"]*)\"', 1), ',') AS phrases, 'find about it' AS clean, 3::BIGINT AS words FROM ({_ASKED_SQL})"))
def query_parse(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    asked = F.concat(F.lit("#"), "role", F.lit(' find "note '), text("seq"), F.lit('" turn:'), text("seq"), F.lit(" about  it #t/"), text("conv_id"))
    parsed = messages(spark, sf).select("id", *tx.parsed_query(asked))
    return parsed.select("id", *(F.array_join(c, ",").alias(c) for c in ("tags", "properties", "phrases")), "clean", F.size(F.split("clean", " ")).cast("long").alias("words"))


@query("postings_build", with_views(f"SELECT word, count(*) AS documents, min(id) AS first_id FROM ({TERMS_SQL}) GROUP BY word"))
def postings_build(spark: SparkSession, sf: str) -> DataFrame:
    return index.postings(notes(spark, sf), "doc_id", "content").groupBy("word").agg(F.count(F.lit(1)).alias("documents"), F.min("id").alias("first_id"))


@query("postings_update", with_views(f"SELECT word, count(*) AS documents FROM (SELECT word, id FROM ({TERMS_SQL}) WHERE id % 5 > 1 UNION ALL SELECT unnest(['new', 'the', 'words']), doc_id FROM notes WHERE doc_id % 5 = 1) GROUP BY word"))
def postings_update(spark: SparkSession, sf: str) -> DataFrame:
    """Notes divisible by 5 are deleted, the next ones have a new text."""
    own = notes(spark, sf)
    stale = own.where("doc_id % 5 <= 1").select(F.col("doc_id").alias("id"))
    fresh = index.postings(own.where("doc_id % 5 = 1").withColumn("content", F.lit("The new words")), "doc_id", "content")
    return index.updated(index.postings(own, "doc_id", "content"), stale, fresh).groupBy("word").agg(F.count(F.lit(1)).alias("documents"))


def consolidated(results: DataFrame) -> DataFrame:
    """Results (workspace, type, session, score, snippet) to a row a workspace: methods and sessions of all its results, snippets that differ in more than case and blanks at their ends."""
    clean = results.withColumn("snippet", F.lower(F.trim("snippet")))
    once = clean.groupBy("workspace", "snippet", "type", "session").agg(F.max("score").alias("score"))
    files = once.groupBy("workspace").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("methods"), F.count_distinct("session").alias("sessions"))
    first = top_per(once.select("workspace", "snippet").distinct(), "workspace", [F.col("snippet")], 3).groupBy("workspace").agg(F.array_join(F.array_sort(F.collect_list("snippet")), " ... ").alias("snippets"))
    return files.join(first, "workspace").select("workspace", "score", "methods", "sessions", "snippets")


@query("consolidate", with_views(f"SELECT workspace, max(score) AS score, array_to_string(list_sort(list(DISTINCT type)), ',') AS methods, count(DISTINCT session) AS sessions, array_to_string(list_slice(list_sort(list(DISTINCT lower(trim(type || ' ' || session)))), 1, 3), ' ... ') AS snippets FROM ({SCORED}) GROUP BY workspace"))
def consolidate(spark: SparkSession, sf: str) -> DataFrame:
    """One row a file: best score, methods, and three snippets. Distinct snippets are found before they are gathered."""
    return consolidated(scored(spark, sf).withColumn("snippet", F.concat_ws(" ", "type", "session")))


@query("consolidation_stats", with_views(f"SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS results, max(n) AS most, round(avg(n), 6) AS mean, max(m) AS methods FROM (SELECT workspace, count(*) AS n, count(DISTINCT type) AS m FROM ({SCORED}) GROUP BY workspace)"))
def consolidation_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Results per file, and the most methods that found one."""
    files = scored(spark, sf).groupBy("workspace").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("type").alias("m"))
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("results"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.max("m").alias("methods"))


@query("bold_terms", with_views("SELECT id, regexp_replace(content, '(er)', '**\\1**', 'gi') AS bolded FROM messages"))
def bold_terms(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).select("id", tx.bold(F.col("content"), "er").alias("bolded"))


@query("time_buckets", with_views("SELECT CAST(floor((1706745600000 - ms) / 2592000000) AS BIGINT) AS bucket, count(*) AS items, min(id) AS first_id FROM activity WHERE floor((1706745600000 - ms) / 2592000000) BETWEEN 0 AND 11 GROUP BY 1"))
def time_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve ranges of 30 days back from now."""
    bucket = F.floor((F.lit(NOW_MS) - F.col("ms")) / (30 * DAY_MS))
    return activity(spark, sf).select("id", bucket.alias("bucket")).where("bucket between 0 and 11").groupBy("bucket").agg(F.count(F.lit(1)).alias("items"), F.min("id").alias("first_id"))


@query("fts_and", with_views(f"SELECT path, modified FROM notes WHERE doc_id IN (SELECT id FROM ({TERMS_SQL}) WHERE word IN ('the', 'and', 'with') GROUP BY id HAVING count(*) = 3) ORDER BY modified DESC, path LIMIT 50"))
def fts_and(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).where(index.holding(F.col("content"), ["the", "and", "with"])).orderBy(F.desc("modified"), "path").limit(50).select("path", "modified")


_MESSAGE_TERMS = TERMS_SQL.replace("doc_id AS id, lang FROM notes", "id, conv_id FROM messages")


@query("fts_messages", with_views(f"SELECT id FROM ({_MESSAGE_TERMS}) WHERE word IN ('the', 'and') GROUP BY id HAVING count(*) = 2"))
def fts_messages(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).where(index.holding(F.col("content"), ["the", "and"])).select("id")


@query("fts_scoped", with_views(f"SELECT id FROM ({_MESSAGE_TERMS}) WHERE conv_id % 7 = 3 AND word IN ('the', 'and') GROUP BY id HAVING count(*) = 2"))
def fts_scoped(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).where("conv_id % 7 = 3").where(index.holding(F.col("content"), ["the", "and"])).select("id")


@query("fts_stored", with_views(f"SELECT id FROM ({TERMS_SQL}) WHERE word IN ('the', 'and') GROUP BY id HAVING count(*) = 2"))
def fts_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The same from postings that are kept: only the buckets of the two words are read."""
    path = live.shared_dir(spark)
    index.store(index.postings(notes(spark, sf), "doc_id", "content"), path)
    return index.all_of(index.stored(spark, path, ["the", "and"]), ["the", "and"])


@query("fts_stemmed")
def fts_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    """All notes as full-text search with a stemming tokenizer has them, whatever their language: no SQL counterpart; the stemmer is tested against known stems."""
    return index.stemmed(notes(spark, sf), "doc_id", "content").groupBy("word").agg(F.count(F.lit(1)).alias("documents"))
