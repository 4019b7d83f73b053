"""The registered queries of this subpackage: thin wrappers that apply an operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import sql
from marginalia.llm.tables import read


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.neardup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), words=2)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.linededup import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.mixing import mix

    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "shard")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.warc import roundtrip

    return roundtrip(read(spark, sf_dir, "pages")).drop("url")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.pii import report

    return report(read(spark, sf_dir, "documents"))


def op6_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.ann import nearest

    return nearest(read(spark, sf_dir, "embeddings"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), with_ids=False)  # digests stand for them


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.quality import quality

    return quality(read(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.licenses import scan

    return scan(read(spark, sf_dir, "documents"))


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.htmltext import extract

    return extract(read(spark, sf_dir, "pages"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.divergence import divergence

    return divergence(read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.merkle import audit, leaf_digest

    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf_digest(text=F.translate("text", "\n", "")))
    return audit(read(spark, sf_dir, "documents"), claimed=tampered).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.passages import fit, scores

    docs = read(spark, sf_dir, "documents")
    return scores(docs, fit(docs, read(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_source_mix": op3_source_mix,
    "op4_warc": op4_warc,
    "op5_pii": op5_pii,
    "op6_projected_neighbours": op6_projected_neighbours,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_license_scan": op9_license_scan,
    "op10_html_main_text": op10_html_main_text,
    "op11_source_divergence": op11_source_divergence,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_passage_quality": op13_passage_quality,
}

ORACLE: dict[str, str] = {"op1_minhash_near_dedup": sql.OP1, "op3_source_mix": sql.OP3, "op4_warc": sql.OP4, "op8_quality_rules": sql.OP8, "op11_source_divergence": sql.OP11, "op12_merkle_manifest": sql.OP12}
