"""Folding the event log into tables: latest rows, field-wise last writer, tombstones, sessions, fragments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.ranking import scanned


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key: an upsert replayed. An aggregate with partial results, not a sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")


def last_where(value: Column, given: Column, order: Sequence[str]) -> Column:
    """The value of the last row in which the field was given, null included where that was what it gave."""
    return F.max_by(value, F.when(given, F.struct(*order)))


def given(json: str, field: str) -> Column:
    """Whether a JSON object has the field, be it null."""
    return F.coalesce(F.array_contains(F.json_object_keys(json), field), F.lit(False))


def folded(log: DataFrame, key: str, patch: str, fields: Sequence[str], order: Sequence[str] = ("ms", "id")) -> DataFrame:
    """Rows (key, patch JSON, is_create, is_delete, order) to the entities that exist at the end.

    An entity exists if its last create comes after its last delete. Each field has the value that was given last since any time:
    absent fields leave it, null sets it. One shuffle, whatever the number of fields.
    """
    time = F.struct(*order)
    values = [last_where(F.get_json_object(patch, f"$.{f}"), given(patch, f), order).alias(f) for f in fields]
    born, gone = F.max(F.when(F.col("is_create"), time)).alias("_born"), F.max(F.when(F.col("is_delete"), time)).alias("_gone")
    out = log.groupBy(key).agg(*values, born, gone, F.count(F.lit(1)).alias("changes"))
    return out.where("_born is not null and (_gone is null or _born > _gone)").drop("_born", "_gone")


def without_deleted(rows: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    """Rows (key, ms) that no delete (key, deleted_ms) came after."""
    last = deletes.groupBy(key).agg(F.max("deleted_ms").alias("deleted_ms"))
    return rows.join(last, key, "left").where("deleted_ms is null or ms > deleted_ms").drop("deleted_ms")


def gap_sessions(df: DataFrame, key: str, gap_ms: int, bucket_ms: int | None = None) -> DataFrame:
    """(key, session, items, begun, ended): a session ends where the next row is more than gap_ms later.

    bucket_ms: rows are looked at in spans of so much time, and each span gets from the ones before it when they ended and how many sessions they
    opened, so that a key of very many rows is no single task's work.
    """
    rows = df.withColumn("_span", F.floor(F.col("ms") / bucket_ms) if bucket_ms else F.lit(0).cast("long"))
    order, spans = Window.partitionBy(key, "_span").orderBy("ms", "id"), Window.partitionBy("_key").orderBy("_of")
    ended = rows.groupBy(F.col(key).alias("_key"), F.col("_span").alias("_of")).agg(F.max("ms").alias("_last"))
    ended = ended.select("_key", "_of", F.lag("_last").over(spans).alias("_before"))
    joined = rows.join(ended, rows[key].eqNullSafe(F.col("_key")) & (rows["_span"] == F.col("_of"))).drop("_key", "_of")
    last = F.coalesce(F.lag("ms").over(order), "_before")
    opened = joined.withColumn("_opens", (last.isNull() | (F.col("ms") - last > gap_ms)).cast("long")).drop("_before")
    numbers = scanned(opened, key, ["ms", "id"], "_opens", "session", F.col("_span"))
    return numbers.groupBy(key, "session").agg(F.count(F.lit(1)).alias("items"), F.min("ms").alias("begun"), F.max("ms").alias("ended"))


def throttled(df: DataFrame, key: str, order: str, length: str, every: int = 50, bucket: Column | None = None) -> DataFrame:
    """Rows at which the running length has passed another multiple of ``every``. bucket: rises along with order, see ``scanned``."""
    rows = scanned(df, key, [order], length, "running", bucket)
    return rows.where(F.floor(F.col("running") / every) > F.floor((F.col("running") - F.col(length)) / every))
