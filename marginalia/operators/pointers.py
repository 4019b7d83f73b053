"""Chains followed by pointer doubling: paths in trees of any depth, and files through their renames.

Each round joins what every row has reached so far with what that one has reached, so a chain of n links takes log2(n) rounds, each one shuffled join and
one written table of the rows whose chains go on (lineage is cut, and lost executors cost a task). A round in which no further chain came to its end is the last: what is
left then goes in circles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.streaming.live import shared_dir


def _kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def chased(links: DataFrame, more: dict[str, Column]) -> DataFrame:
    """(id, next, others) to the same rows with next null where the chain came to its end, ``last`` being the row it ended in; in a circle next stays.

    more: for some of the others, what a row has after a step, from its own (``a.x``) and those of the row that it has reached (``b.x``).
    """
    folder = shared_dir(links.sparkSession)
    others = [c for c in links.columns if c not in ("id", "next")]
    start = _kept(links.withColumn("last", F.col("id")), folder, "round=0")
    # Rows that came to their end are written once and only looked up from then on: with those that go on they'd all meet the null of next in one task.
    done, rows, step = [start.where("next is null")], start.where("next is not null"), 0
    while not rows.isEmpty():
        step += 1
        whole = reduce(DataFrame.unionByName, [*done, rows])
        a, b = rows.alias("a"), whole.alias("b")
        taken = F.col("b.id").isNotNull()
        kept = [F.when(taken, more[c]).otherwise(F.col(f"a.{c}")).alias(c) if c in more else F.col(f"a.{c}").alias(c) for c in others]
        # A next that is no row ends the chain too.
        found = a.join(b, F.col("a.next") == F.col("b.id"), "left").select(F.col("a.id").alias("id"), F.col("b.next").alias("next"), *kept, F.coalesce("b.last", "a.last").alias("last"))
        found = _kept(found, folder, f"round={step}")
        ended, rows = found.where("next is null"), found.where("next is not null")
        if ended.isEmpty():
            break
        done.append(ended)
    return reduce(DataFrame.unionByName, [*done, rows])


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(id, parent, name) to (id, path, level) of trees of any depth: roots, whose parent is null, are level 0. Nodes in a circle, below one, or below a parent that isn't there have neither path nor level."""
    known = nodes.select(F.col("id").alias("_id"))
    lost = nodes.join(known, nodes["parent"] == known["_id"], "left").where("parent is not null and _id is null").select("id")
    start = nodes.select("id", F.col("parent").alias("next"), F.col("name").alias("path"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("level"))
    found = chased(start, {"path": F.concat(F.col("b.path"), F.lit("/"), F.col("a.path")), "level": F.col("a.level") + F.col("b.level")})
    below = found.join(lost.select(F.col("id").alias("last"), F.lit(True).alias("lost")), "last", "left")
    whole = F.col("next").isNull() & F.col("lost").isNull()
    return below.select("id", F.when(whole, F.col("path")).alias("path"), F.when(whole, F.col("level")).alias("level"))


def renamed(events: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """File events (id, at, type, path, new_path, carried) to files (id, path, born, renames, ending, carried): one row for each file that ever was.

    type is create, rename (path to new_path), modify or delete; events of one path are taken in order of (at, id). id is that of the event that the file came
    with: its creation, or a rename or change of a path where nothing was, which came from elsewhere. path is the last one; ending is null for
    files that are there, deleted, or replaced by another that came to the same path. Deletions of paths where nothing is are ignored. carried
    columns have what the last event of the file gave that wasn't null.
    """
    comes = F.col("type").isin("create", "rename", "modify")
    arrives = events.where(comes).select(F.when(F.col("type") == "rename", F.col("new_path")).otherwise(F.col("path")).alias("path"), "at", "id", F.lit(True).alias("arrival"), F.lit(None).cast("string").alias("does"))
    leaves = events.where("type in ('rename', 'modify', 'delete')").select("path", "at", "id", F.lit(False).alias("arrival"), F.col("type").alias("does"))
    order = Window.partitionBy("path").orderBy("at", "id", "arrival")  # a change leaves a path and comes back to it
    line = arrives.unionByName(leaves).withColumns({"next_id": F.lead("id").over(order), "next_does": F.lead("does").over(order), "next_arrival": F.lead("arrival").over(order), "held": F.lag("arrival").over(order)})
    # A rename or change takes a file along only where one is; else the file came with it.
    took = line.where("not arrival and does <> 'delete'").select("id", F.coalesce("held", F.lit(False)).alias("took"))
    ending = F.when(F.col("next_arrival"), "replaced").when(F.col("next_does") == "delete", "deleted")
    moves = F.when(F.col("next_does") == "rename", 1).otherwise(0)
    start = line.where("arrival").select("id", F.when(F.col("next_does").isin("rename", "modify"), F.col("next_id")).alias("next"), "path", ending.alias("ending"), moves.alias("renames"))
    if carried:
        start = start.join(events.select("id", *carried), "id")
    more = {"path": F.col("b.path"), "ending": F.col("b.ending"), "renames": F.col("a.renames") + F.col("b.renames")} | {c: F.coalesce(f"b.{c}", f"a.{c}") for c in carried}
    found = chased(start, more)
    first = events.where(comes).join(took, "id", "left").where("took is null or not took").select("id", F.col("at").alias("born"))
    return found.join(first, "id").select("id", "path", "born", "renames", "ending", *carried)
