"""A kept index of files by path, folder and tag, which follows batches of file events and changes only the keys that they touch.

Three bucketed tables below one shared folder: ``files`` by path, ``folders`` by folder and ``tags`` by tag. A batch reads the buckets of the paths that its events
name, follows every file through its renames, changes and deletions (``pointers.renamed``), and adds a segment with what is now at these paths:
a row that is there, or one that says gone. Of the rows of a key and path the one of the last version counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.paths import folder
from marginalia.operators.pointers import renamed
from marginalia.sources.buckets import Buckets

#: Events of files: tags and modified are null where an event doesn't give them.
EVENTS = "id string, at long, type string, path string, new_path string, tags array<string>, modified long"


class FileIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.files = Buckets(spark, f"{path}/files", "path string, tags array<string>, modified long, gone boolean", ["path"], buckets)
        self.folders = Buckets(spark, f"{path}/folders", "folder string, path string, gone boolean", ["folder"], buckets)
        self.tags = Buckets(spark, f"{path}/tags", "tag string, path string, gone boolean", ["tag"], buckets)

    @staticmethod
    def _now(rows: DataFrame, *keys: str) -> DataFrame:
        """Of the rows of a key the last one."""
        others = [c for c in rows.columns if c not in (*keys, "version", "bucket")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "version").alias("_row")).select(*keys, "_row.*")

    def update(self, events: DataFrame, version: int | None = None) -> int:
        """Takes a batch of EVENTS, whose ids are unique in it. version: the number to make, to do a batch again; else the one after the last."""
        version = version or max(self.tags.versions(), default=0) + 1
        touched = events.select("path").union(events.where("new_path is not null").select("new_path")).distinct()
        held = self._now(self.files.lookup(touched, version - 1), "path").where("not gone").join(touched, "path")
        # What was there before is taken as created before all events.
        old = held.select(F.concat(F.lit("old:"), "path").alias("id"), F.lit(-(1 << 62)).alias("at"), F.lit("create").alias("type"), "path", F.lit(None).cast("string").alias("new_path"), "tags", "modified")
        own = events.select(F.concat(F.lit("new:"), "id").alias("id"), "at", "type", "path", "new_path", "tags", "modified")
        there = renamed(old.unionByName(own), ("tags", "modified")).where("ending is null").select("path", "tags", "modified")
        rows = touched.join(there.withColumn("there", F.lit(True)), "path", "left").select("path", "tags", "modified", F.col("there").isNull().alias("gone"))
        self.files.add(rows, version)
        made = self.files.read(upto=version).where(F.col("version") == version)
        self.folders.add(made.select(folder(F.col("path")).alias("folder"), "path", "gone"), version)
        # A tag that the path has no longer is gone from it.
        tagged = lambda df: df.select("path", F.explode("tags").alias("tag")).distinct()
        before, after = tagged(held), tagged(made.where("not gone"))
        lost = before.join(after, ["path", "tag"], "left_anti").select("tag", "path", F.lit(True).alias("gone"))
        self.tags.add(after.select("tag", "path", F.lit(False).alias("gone")).unionByName(lost), version)
        return version

    def file(self, paths: DataFrame) -> DataFrame:
        """(path, tags, modified) of those of the paths (path) that are there."""
        return self._now(self.files.lookup(paths), "path").where("not gone").drop("gone").join(paths, "path", "left_semi")

    def in_folder(self, folders: DataFrame) -> DataFrame:
        """(folder, path) of the files of these folders (folder), from their buckets alone."""
        return self._now(self.folders.lookup(folders).join(folders, "folder", "left_semi"), "folder", "path").where("not gone").select("folder", "path")

    def with_tag(self, tags: DataFrame) -> DataFrame:
        """(tag, path) of the files that have these tags (tag), from their buckets alone."""
        return self._now(self.tags.lookup(tags).join(tags, "tag", "left_semi"), "tag", "path").where("not gone").select("tag", "path")

    def all_files(self) -> DataFrame:
        return self._now(self.files.read(), "path").where("not gone").drop("gone")
