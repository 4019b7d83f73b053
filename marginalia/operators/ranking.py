"""Order: pages, top rows, numbering, first of a kind, running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_SIZE, MAX_PAGE_SIZE = 25, 200


def page_size(asked: int | None) -> int:
    return max(1, min(PAGE_SIZE if asked is None else asked, MAX_PAGE_SIZE))


def page(df: DataFrame, order: Sequence[Column | str], number: int = 0, size: int | None = None) -> DataFrame:
    """Page ``number`` (from 0). The order must end with a unique column, or pages may share rows."""
    n = page_size(size)
    return df.orderBy(*order).offset(number * n).limit(n)


def page_info(total: Column, number: int, size: int | None = None) -> list[Column]:
    """What a page says of itself, from the number of all rows."""
    n = page_size(size)
    pages = F.ceil(total / n)
    return [pages.alias("total_pages"), (F.lit(number + 1) < pages).alias("has_next"), F.lit(number > 0).alias("has_previous"), F.greatest(F.lit(0), F.least(F.lit(n), total - number * n)).cast("long").alias("on_page")]


def sorted_by(df: DataFrame, allowed: dict[str, str], by: str, descending: bool, tie: str) -> DataFrame:
    """By a caller's choice among ``allowed`` {public name: column}; anything else is refused."""
    if by not in allowed:
        raise ValueError(f"can't sort by {by!r}; choose one of {', '.join(sorted(allowed))}")
    key = F.col(allowed[by])
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), tie)


def scanned(df: DataFrame, key: str, order: Sequence[Column | str], value: str, name: str, bucket: Column | None = None) -> DataFrame:
    """Running sum of value within each key, this row included.

    bucket: rises along with order; then rows are summed inside (key, bucket), and what the key's earlier buckets sum to is carried over, so a key of
    very many rows is as many tasks' work as it has buckets, and a window by key sees a row a bucket. Without it a key is one task's sort.
    """
    upto = Window.unboundedPreceding, 0
    if bucket is None:
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(*upto)))
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_of")).agg(F.sum(value).alias("_sum"))
    totals = totals.select("_key", "_of", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = rows.withColumn("_inside", F.sum(value).over(Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(*upto)))
    both = inside.join(totals, inside[key].eqNullSafe(F.col("_key")) & inside["_bucket"].eqNullSafe(F.col("_of")))
    return both.withColumn(name, F.col("_before") + F.coalesce("_inside", F.lit(0))).drop("_bucket", "_inside", "_before", "_key", "_of")


def numbered(df: DataFrame, key: str, order: Sequence[Column | str], name: str, bucket: Column | None = None) -> DataFrame:
    """Numbers from 0 within each key; bucket as for ``scanned``."""
    return scanned(df.withColumn("_one", F.lit(1).cast("long")), key, order, "_one", name, bucket).withColumn(name, F.col(name) - 1).drop("_one")


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order, as an aggregate: rows that can't win never leave the map side."""
    best = F.min_by(F.struct(*df.columns), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))).alias("_row")
    return df.groupBy(*keys).agg(best).select("_row.*")


def top_per(df: DataFrame, key: str, order: Sequence[Column], k: int, rank: str = "position") -> DataFrame:
    """The first k rows of each key; Spark keeps only k of a key in each task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).where(F.col(rank) <= k)


def diversified(df: DataFrame, key: str, score: str, tie: str, step: float = 0.1, bucket: Column | None = None) -> DataFrame:
    """A later result of the same key loses step for each better one, down to 0. bucket: falls as score rises, as for ``scanned``."""
    placed = numbered(df, key, [F.desc(score), F.col(tie)], "_place", bucket)
    return placed.withColumn(score, F.greatest(F.lit(0.0), F.col(score) - step * F.col("_place"))).drop("_place")


def running_sum(df: DataFrame, bucket: Column, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Sum of value over all rows up to this one, where bucket rises along with order.

    Rows are summed inside their buckets, and only bucket totals are summed in one place, so the whole table never is sorted
    in one task.
    """
    rows = df.withColumn("_bucket", bucket)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_bucket").agg(F.sum(value).alias("_total")).select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_inside", inside).join(totals, "_bucket").withColumn(name, F.col("_before") + F.col("_inside")).drop("_bucket", "_inside", "_before")
