"""Lookups and nesting as joins; Spark picks broadcast or shuffle from sizes, skewed keys are split at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, dimension: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """df with value looked up by key; rows without a match get the default. dimension has a row per key."""
    return df.join(dimension.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def nested(parents: DataFrame, children: DataFrame, key: str, order: str, fields: list[str], name: str) -> DataFrame:
    """parents with an array of their children in order; parents without any get an empty one. An array holds one parent's children only."""
    packed = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *(f for f in fields if f != order)))).alias(name))
    own = parents.join(packed, key, "left")
    return own.withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))


def overlapping(ranges: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """Pairs of (range_id, lo, hi) and (span_id, start, end) whose closed intervals meet.

    Both sides are dealt to buckets of ``width`` and joined on the bucket, so that the plan is an equi-join; a pair is kept only in
    the first bucket that both share.
    """
    dealt = lambda df, a, b: df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))))
    both = dealt(ranges, "lo", "hi").join(dealt(spans, "start", "end"), "_bucket")
    first = F.greatest(F.floor(F.col("lo") / width), F.floor(F.col("start") / width))
    return both.where((F.col("_bucket") == first) & (F.col("lo") <= F.col("end")) & (F.col("start") <= F.col("hi"))).drop("_bucket")


def link_key(text: Column) -> Column:
    """A link as it is compared: small letters, no extension, no heading, no folders."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[#|].*$", ""), r"\.(md|txt|html)$", ""), "^.*/", ""))


def resolve_links(links: DataFrame, names: DataFrame) -> DataFrame:
    """(src, link) met with (path, name) on the normalised name; a file never links to itself."""
    keyed = names.select(F.col("path").alias("dst"), link_key(F.col("name")).alias("_key"))
    return links.withColumn("_key", link_key(F.col("link"))).join(keyed, "_key").where("src <> dst").select("src", "dst").distinct()


def model_key(name: Column) -> Column:
    """A model's name without the suffix of a variant that costs the same."""
    return F.regexp_replace(name, r":(online|1m)$", "")


def holding_one_another(left: DataFrame, right: DataFrame, piece: int = 5) -> DataFrame:
    """(a, b): distinct names of left (a) and right (b) of which one holds the other; empty names hold nothing and are held by none.

    A name that is held shows by its first ``piece`` letters, or all if it has fewer; one that holds has them among its pieces of up to so many. So
    candidates come from an equi-join of distinct names, and are then looked at.
    """
    def pieces(c: str) -> Column:
        lengths = F.sequence(F.lit(1), F.least(F.lit(piece), F.length(c)))
        return F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(F.col(c), i, n))))

    a, b = left.select("a").where("a <> ''").distinct(), right.select("b").where("b <> ''").distinct()
    found = []
    for holder, held, names in ((a, b, ("a", "b")), (b, a, ("b", "a"))):
        wide = holder.select(names[0], F.explode(F.array_distinct(pieces(names[0]))).alias("_piece"))
        found.append(wide.join(held.withColumn("_piece", F.left(names[1], F.lit(piece))), "_piece").where(F.contains(*names)).select("a", "b"))
    return found[0].union(found[1]).distinct()


def earlier_results(steps: DataFrame, key: str, order: str, text: str, separator: str = "\n") -> DataFrame:
    """Each step with the texts of all earlier steps of its key, in order.

    A window per key, not a self-join: linear in rows read, and the key's own steps are all a task holds.
    """
    from pyspark.sql import Window

    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("earlier", F.array_join(F.collect_list(text).over(before), separator))
