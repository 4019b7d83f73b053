"""Searches of a kept index with positions, as notes come, change and go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.textindex import TextIndex
from marginalia.plans.registry import query
from marginalia.sources.tables import messages, notes, with_views
from marginalia.streaming import live

_WORDS = r"regexp_extract_all(translate(coalesce(content, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')"
_T = f"SELECT CAST(doc_id AS VARCHAR) AS id, unnest({_WORDS}) AS w, generate_subscripts({_WORDS}, 1) - 1 AS i FROM notes"


def indexed(spark: SparkSession, sf: str) -> TextIndex:
    """All notes, in two segments, since they come in two batches."""
    own = notes(spark, sf).select(F.col("doc_id").alias("id"), F.col("content").alias("text"))
    index = TextIndex(spark, live.shared_dir(spark))
    index.update(own.where("id % 3 > 0"))
    index.update(own.where("id % 3 = 0"))
    return index


@query("fts_phrase", with_views(f"WITH t AS ({_T}) SELECT a.id, CAST(count(*) AS BIGINT) AS times FROM t a JOIN t b ON a.id = b.id AND b.i = a.i + 1 JOIN t c ON a.id = c.id AND c.i = a.i + 2 WHERE a.w = 'the' AND b.w = 'of' AND c.w = 'the' GROUP BY a.id"))
def fts_phrase(spark: SparkSession, sf: str) -> DataFrame:
    """Notes that hold three words one after the other, and how often."""
    return indexed(spark, sf).phrase("The", "of", "the").select("id", F.size("starts").cast("long").alias("times"))


@query("fts_near", with_views(f"WITH t AS ({_T}) SELECT DISTINCT a.id FROM t a JOIN t b ON a.id = b.id AND a.w = 'nicht' AND b.w = 'eine' AND abs(a.i - b.i) <= 6"))
def fts_near(spark: SparkSession, sf: str) -> DataFrame:
    """Notes where two words have at most five words between them."""
    return indexed(spark, sf).near("nicht", "eine", between=5).select("id")


@query("fts_prefix", with_views(f"WITH t AS ({_T}) SELECT id, count(DISTINCT w) AS words, count(*) AS times FROM t WHERE w LIKE 'tha%' GROUP BY id"))
def fts_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Notes that hold words with a beginning, with how many of them."""
    return indexed(spark, sf).prefix("tha").groupBy("id").agg(F.count(F.lit(1)).alias("words"), F.sum(F.size("places")).alias("times"))


@query("fts_either", with_views(f"WITH t AS ({_T}) SELECT id, count(DISTINCT w) AS matched FROM t WHERE w IN ('with', 'nicht', 'dans') GROUP BY id HAVING id NOT IN (SELECT id FROM t WHERE w = 'from')"))
def fts_either(spark: SparkSession, sf: str) -> DataFrame:
    """Notes that hold one of some words, without those that hold another one."""
    index = indexed(spark, sf)
    return index.without(index.any_of("with", "nicht", "dans"), "from")


@query("fts_kept", with_views(f"WITH t AS ({_T.replace('FROM notes', 'FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN name ELSE content END AS content FROM notes WHERE doc_id % 5 > 0) notes')}) SELECT w AS word, id, count(*) AS times FROM t WHERE w IN ('doc', 'the', 'von') GROUP BY w, id"))
def fts_kept(spark: SparkSession, sf: str) -> DataFrame:
    """A fifth of the notes is deleted, a fifth has a new text, and the index is searched as it then is, without being built anew."""
    own, index = notes(spark, sf), indexed(spark, sf)
    index.update(own.where("doc_id % 5 = 1").select(F.col("doc_id").alias("id"), F.col("name").alias("text")), own.where("doc_id % 5 = 0").select(F.col("doc_id").alias("id")))
    return index.held(["doc", "the", "von"]).select("word", "id", F.size("places").cast("long").alias("times"))


_M = _T.replace("CAST(doc_id AS VARCHAR) AS id", "id").replace("FROM notes", "FROM messages")


@query("fts_messages_phrase", with_views(f"WITH t AS ({_M}) SELECT DISTINCT conv_id FROM messages WHERE id IN (SELECT a.id FROM t a JOIN t b ON a.id = b.id AND b.i = a.i + 1 WHERE a.w = 'of' AND b.w = 'the')"))
def fts_messages_phrase(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations of which a message holds two words in a row."""
    own, index = messages(spark, sf), TextIndex(spark, live.shared_dir(spark))
    index.update(own.select("id", F.col("content").alias("text")))
    return own.join(index.phrase("of", "the").select("id"), "id").select("conv_id").distinct()
