"""Connected components by repeated contraction: every node hooks on to its neighbour of least hash, and the graph of the hooks' targets is next.

Each round is a grouped minimum (combined before the shuffle) and two joins, which Spark splits where a node has very
many edges; nothing is gathered per component. The number of nodes left with edges falls by a constant factor a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) to (node, root): each node that has an edge to another, and the smallest node it can reach.

    Loops, repeated and reversed edges are harmless; edges with a null end are ignored; no edges give no rows.
    """
    both = edges.select("a", "b").where("a <> b")
    both = written(both.union(both.select("b", "a")).distinct(), "links")
    hooks: list[DataFrame] = []
    while not both.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("to"))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("low")).select("a", F.least("low", rank("a"))["to"].alias("to"))
        least = written(least, "hooks")
        hooks.append(least)
        moved = both.join(least.withColumnRenamed("to", "x"), "a").select("x", "b")
        moved = moved.join(least.select(F.col("a").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        both = written(moved.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    if not hooks:
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = hooks[0].withColumnsRenamed({"a": "node"})
    for step in hooks[1:]:
        found = found.join(step.withColumnRenamed("to", "next"), found["to"] == step["a"], "left").select("node", F.coalesce("next", "to").alias("to"))
    found = written(found, "roots")
    smallest = found.groupBy("to").agg(F.min("node").alias("root"))
    return written(found.join(smallest, "to").select("node", "root"), "components")
