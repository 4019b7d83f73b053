"""Link graphs as edge tables: extraction, symmetric closure, score propagation, folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOOST, DISTANCE = 0.3, 1
LINK = r"\[\[([^\]|#]+)"
MARKDOWN_LINK = r"\]\(([^)#]+)"
HREF = r'href="([^"]*)"'


def links_in(text: Column, patterns: tuple[str, ...] = (LINK, MARKDOWN_LINK)) -> Column:
    """Targets of all links in a text, in the order of the patterns."""
    return F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns))


def undirected(links: DataFrame) -> DataFrame:
    """(src, dst) both ways, once each, without loops."""
    own = links.select("src", "dst").where("src <> dst")
    return own.union(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def propagated(scores: DataFrame, edges: DataFrame, boost: float = BOOST, distance: int = DISTANCE) -> DataFrame:
    """(node, score) after ``distance`` rounds, in round d of which every node gains boost / d of each neighbour's score.

    Each round is one join and one sum, combined before its shuffle; nodes outside ``scores`` neither give nor gain.
    """
    own = scores.select("node", "score")
    for d in range(1, distance + 1):
        gain = edges.join(own.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * (boost / d)).alias("gain"))
        own = own.join(gain, "node", "left").select("node", (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"))
    return own


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def seeded(df: DataFrame, seeds: list[Column]) -> DataFrame:
    """score times 1.5 for a seed's path, times 1.3 for the base name of one. Seeds are values, or scalar subqueries of other tables."""
    own = df.withColumn("_base", base_name(F.col("path")))
    exact, named = (reduce(lambda a, b: a | b, found) for found in ([F.col("path") == s for s in seeds], [F.col("_base") == base_name(s) for s in seeds]))
    return own.withColumn("score", F.col("score") * F.when(exact, 1.5).when(named, 1.3).otherwise(1.0)).drop("_base")


def below(path: Column, folder: str | Column) -> Column:
    """Everything in a folder, at any depth; the empty folder is the root."""
    if isinstance(folder, Column):
        return path.startswith(F.concat(folder, F.lit("/")))
    return path.startswith(folder.rstrip("/") + "/") if folder.strip("/") else F.lit(True)


def flattened(parents: DataFrame, depth: int) -> DataFrame:
    """(id, parent, name) to (id, path, level) of a tree of at most ``depth`` levels below its roots, whose parent is null: a join a level.

    Nodes deeper than that, or in a circle, have no path and are absent.
    """
    level = parents.where("parent is null").select("id", F.col("name").alias("path"), F.lit(0).alias("level"))
    found = level
    for k in range(1, depth + 1):
        above = level.select(F.col("id").alias("parent"), F.col("path").alias("_above"))
        level = parents.join(above, "parent").select("id", F.concat_ws("/", "_above", "name").alias("path"), F.lit(k).alias("level"))
        found = found.union(level)
    return found
