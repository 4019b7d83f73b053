"""Groupings, statistics and rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped(df: DataFrame, keys: dict[str, tuple[str, str]], score: str) -> DataFrame:
    """Count, sum and mean of score by keys {name: (column, label for null)}, largest group first."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(label)).alias(k) for k, (c, label) in keys.items()]
    out = df.groupBy(*named).agg(F.count(F.lit(1)).alias("items"), F.round(F.sum(score), 4).alias("total_score"), F.round(F.avg(score), 6).alias("average_score"))
    return out.orderBy(F.desc("items"), *keys)


def spread(score: str) -> list[Column]:
    """Least, greatest and population deviation (0 for a single row)."""
    return [F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.round(F.stddev_pop(score), 6).alias("deviation")]


#: Bands of an average score, upper ends exclusive but for the last.
BANDS = ((0.2, "very low"), (0.4, "low"), (0.6, "medium"), (0.8, "high"), (1.0, "very high"))


def band(score: Column) -> Column:
    return reduce(lambda acc, b: acc.when(score < b[0], b[1]), BANDS[1:], F.when(score < BANDS[0][0], BANDS[0][1])).otherwise("top")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A row per table, and one of the total."""
    counts = reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()))
    return counts.unionByName(counts.agg(F.sum("row_count").alias("row_count")).select(F.lit("total").alias("table_name"), "row_count"))


def budget(spent: Column, limit: Column) -> list[Column]:
    """Percent, exceeded and remaining, to cents; a limit of 0 or less is none."""
    limited = limit > 0
    return [
        F.when(limited, F.round(100 * spent / limit, 2)).otherwise(0.0).alias("percent_used"), (limited & (spent >= limit)).alias("exceeded"),
        F.when(limited, F.round(F.greatest(F.lit(0.0), limit - spent), 2)).alias("remaining"),
    ]


def ordered_text(order: str, text: str, separator: str) -> Column:
    """The texts of a group in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), separator)


def merged_maps(df: DataFrame, key: str, maps: str, order: list[str]) -> DataFrame:
    """(key, map): the maps of a key in one, of equal entries the value that comes last in order. The values are compared before they are gathered."""
    entries = df.select(key, F.struct(*order).alias("_at"), F.explode_outer(maps).alias("_k", "_v"))  # a key whose maps are all empty stays
    last = entries.groupBy(key, "_k").agg(F.max_by("_v", "_at").alias("_v"))
    held = F.filter(F.collect_list(F.struct("_k", "_v")), lambda e: e["_k"].isNotNull())
    return last.groupBy(key).agg(F.map_from_entries(held).alias(maps))
