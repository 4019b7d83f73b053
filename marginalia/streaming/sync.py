"""Incremental synchronisation: new log files applied to kept accounts, each event once by its id, whatever its device, order or time.

Three bucketed tables are kept below one shared folder: ``accounts`` of entities, ``applied`` ids, and ``marks`` of devices. A micro-batch is the log
files that came since the last run (the stream's checkpoint holds which were read). Its events that aren't applied yet are summed to accounts and added
as a segment; nothing else is read or written but the buckets of the ids asked for. Since accounts are maxima, a late file gives what a rebuild
would. A batch that is done again after a failure starts from the version before it, and so changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import entities as ent
from marginalia.sources import eventlog
from marginalia.sources.buckets import Buckets

APPLIED = "id string, device string, timestamp long, conversation string"
MARKS = "device string, last long, applied long, skipped long"


def _totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket", "device").agg(F.max("last").alias("last"), F.sum("applied").alias("applied"), F.sum("skipped").alias("skipped"))


class Sync:
    """A store that logs are synchronised into. own: a device whose events are left out, since it applied them itself."""

    def __init__(self, spark: SparkSession, path: str, own: str | None = None, buckets: int = 16):
        self.spark, self.path, self.own = spark, path.rstrip("/"), own
        self.accounts = Buckets(spark, f"{self.path}/accounts", ent.ACCOUNT, ["entity", "key"], buckets)
        self.applied = Buckets(spark, f"{self.path}/applied", APPLIED, ["id"], buckets)
        self.marks = Buckets(spark, f"{self.path}/marks", MARKS, ["device"], 1)

    def apply(self, lines: DataFrame, version: int) -> None:
        """One batch of log lines (value) as a version."""
        events = eventlog.parse_lines(lines.select("value"), ent.ENVELOPE)
        if self.own is not None:
            events = events.where(~F.col("deviceId").eqNullSafe(F.lit(self.own)))
        first = ["timestamp", "type", "data"]  # what an event is ordered by comes first in the struct, so that it is shuffled once
        once = events.groupBy("id").agg(F.min(F.struct(*first, *(c for c in events.columns if c not in ("id", *first)))).alias("e"), F.count(F.lit(1)).alias("sent")).select("id", "e.*", "sent")
        # Written, since it is read four times, and so that all three tables take the same events.
        path = f"{self.path}/batch/version={version}"
        once.write.mode("overwrite").parquet(path)
        once = self.spark.read.schema(once.schema).parquet(path)
        known = self.applied.lookup(once, version - 1).select("id", F.lit(True).alias("known"))
        events = once.join(known, "id", "left")
        fresh = events.where("known is null")
        at = F.coalesce("deviceId", F.lit(""))
        marks = events.groupBy(at.alias("device")).agg(
            F.max("timestamp").alias("last"), F.count_if(F.col("known").isNull()).alias("applied"), F.sum(F.col("sent") - F.when(F.col("known").isNull(), 1).otherwise(0)).cast("long").alias("skipped")
        )
        self.accounts.add(ent.accounts(fresh.drop("known", "sent")), version)
        conversation = F.when((F.col("type") == "message") & F.col("why").isNull(), F.col("conversationId")).alias("conversation")
        self.applied.add(ent.addressed(fresh).select("id", at.alias("device"), "timestamp", conversation), version)
        self.marks.add(marks, version)
        fs, batch = self.accounts._fs(path)
        fs.delete(batch, True)

    def compact(self, version: int) -> None:
        """Folds the segments that batches have left; afterwards as much is read as if all had come at once."""
        self.accounts.compact(version, lambda parts: ent.summed(parts, "bucket"))
        self.applied.compact(version, lambda rows: rows)
        self.marks.compact(version, _totals)

    def drain(self, log: str, glob: str = eventlog.GLOB) -> None:
        """Applies the files below log whose names match and that no run before has read. Batches make odd versions, compacting after one makes the even one that follows."""
        lines = self.spark.readStream.schema("value string").format("text").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(log)
        run = lines.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True)
        run.start().awaitTermination()

    def _batch(self, lines: DataFrame, batch: int) -> None:
        self.apply(lines, 2 * batch + 1)
        if self.accounts.wants_compacting():
            self.compact(2 * batch + 2)

    def tables(self) -> dict[str, DataFrame]:
        """The six tables as they are now."""
        found = ent.summed(self.accounts.read())
        touched = self.applied.read().where("conversation is not null").select("conversation", "timestamp", "id")
        return {name: ent.table(found, name, touched) for name in ent.ENTITIES}

    def since(self, ms: int) -> DataFrame:
        """Ids applied with a later time."""
        return self.applied.read().where(F.col("timestamp") > ms).select("id", "timestamp")

    def devices(self) -> DataFrame:
        """(device, last, applied, skipped): the time of its last event, and how many of its events were applied, or had been before."""
        return _totals(self.marks.read()).drop("bucket")
