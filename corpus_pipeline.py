"""A corpus prepared in five stages: quality rules, near-duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of documents, the
last one the placed pieces. ``run`` writes each stage's rows to the shared folder and reads them again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.mixing import apply_mix
from marginalia.llm.neardup import BROADCAST_IDS, near_duplicates
from marginalia.llm.packing import pack_documents
from marginalia.llm.pii import redact
from marginalia.llm.quality import keep_good
from marginalia.llm.tables import bound_batches, read, scratch, unused_prefix, written

#: No single SQL statement has the trees, the tokenizer and the seeded mix; tests hold each stage against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with their failing lines removed."""
    bound_batches(spark)
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates; of rows with equal id and text one.

    A row of null id goes where a row with an id, or another row of null id, has the same text.
    """
    bound_batches(spark)
    p = unused_prefix(docs)
    apart, stays, n, rest, known = (p + x for x in ("apart", "stays", "n", "rest", "known"))
    # Ids that go or have several rows are set apart: fewer than those that stay, so up to a stated number they are broadcast and no text is shuffled.
    found = near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias(stays), F.count(F.lit(1)).alias(n)).where(F.col("doc_id").isNotNull() & (~F.col(stays) | (F.col(n) > 1)))
    ids = written(found.select(F.col("doc_id").alias(apart), stays), "ids-apart")
    rows = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, docs["doc_id"] == F.col(apart), "left")
    alone = rows.where(F.col("doc_id").isNotNull() & F.col(apart).isNull()).select(*docs.columns)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    again = rows.where(F.col("doc_id").isNull() | F.col(stays))
    # Of rows with equal id and text the one whose other columns come first as JSON, which maps have too.
    picked = F.min_by(F.struct(*others), F.to_json(F.struct(*others))) if others else F.lit(None)
    again = again.groupBy("doc_id", "text").agg(picked.alias(rest)).select("doc_id", "text", *(F.col(rest)[c].alias(c) for c in others)).select(*docs.columns)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    texts = docs.where("doc_id is not null").select(digest.alias(known))
    bare = again.where("doc_id is null").join(texts, digest == F.col(known), "left_anti")
    return alone.unionByName(again.where("doc_id is not null")).unionByName(bare)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind."""
    return redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole or in part."""
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces with their ids and places in sequences."""
    bound_batches(spark)
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("personal data", pii),
    ("source mix", source_mix),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    with scratch(spark):  # of the stages' tables the last alone is left
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=name == STAGES[-1][0])
    return docs
