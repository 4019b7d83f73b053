"""The append-only event log: JSON lines in, JSON lines out, with scans by time and device."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Common fields; everything a variant adds stays in data as a JSON text until its handler reads it.
SCHEMA = "id string, type string, deviceId string, timestamp long, workspaceId string, sessionId string, conversationId string, data string"


#: Logs that others append to, and those that append_log adds.
GLOB = "*.{jsonl,json}"


def parse_lines(lines: DataFrame, schema: str = SCHEMA) -> DataFrame:
    """Lines (value) to events; blank and malformed lines, and lines without an id, are skipped."""
    event = F.from_json(F.trim("value"), f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    more = [c for c in lines.columns if c != "value"]
    return lines.where(F.trim("value") != "").select(event.alias("e"), *more).where("e._bad is null and e.id is not null").select("e.*", *more).drop("_bad")


def read_log(spark: SparkSession, path: str, schema: str = SCHEMA, glob: str = GLOB) -> DataFrame:
    """Every event of the JSON lines files below path whose names match, with the ``file`` it came from. A missing folder is an error of Spark's, an empty one has no events."""
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    return parse_lines(lines.select("value", F.col("_metadata.file_path").alias("file")), schema)


def unread(spark: SparkSession, path: str, schema: str = SCHEMA, glob: str = GLOB) -> DataFrame:
    """(file, line, why, value) of the lines of a log that parse_lines skips; blank ones aside. The line is a number within its file, from 1.

    A file is read as one text, so that its lines can be counted; files must fit a task, as a log's do that is cut by size.
    """
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    lines = files.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "value"))
    event = F.from_json(F.trim("value"), f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    read = lines.where(F.trim("value") != "").select("file", (F.col("at") + 1).alias("line"), "value", event.alias("e"))
    why = F.when(F.col("e._bad").isNotNull(), "no JSON object of an event").when(F.col("e.id").isNull(), "no id")
    return read.select("file", "line", why.alias("why"), "value").where("why is not null")


def file_stats(spark: SparkSession, path: str, glob: str = GLOB) -> DataFrame:
    """One row per log file: name, bytes, time of change and number of events."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "modificationTime")
    lines = spark.read.option("pathGlobFilter", glob).text(path).select("value", F.col("_metadata.file_path").alias("path")).where(F.trim("value") != "")
    return files.join(lines.groupBy("path").agg(F.count(F.lit(1)).alias("events")), "path", "left").na.fill(0, ["events"])


def append_log(events: DataFrame, path: str, device: str | None = None, by: str | None = None) -> None:
    """Adds events as JSON lines; files are added, none is rewritten. device: stamps events that have no id, device or time with a new id, this one and now. by: a folder for each value of a column, null too."""
    if device is not None:
        held = lambda c, kind: F.col(c) if c in events.columns else F.lit(None).cast(kind)
        events = events.withColumns({
            "id": F.coalesce(held("id", "string"), F.uuid()), "deviceId": F.coalesce(held("deviceId", "string"), F.lit(device)), "timestamp": F.coalesce(held("timestamp", "long"), F.unix_millis(F.current_timestamp())),
        })
    if by is not None:
        events.withColumn("_of", F.col(by)).write.mode("append").partitionBy("_of").json(path)
    else:
        events.write.mode("append").json(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents (an object or an array a file), as older stores leave them, with their file; one that can't be read has null fields."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def write_documents(df: DataFrame, key: str, path: str) -> None:
    """A JSON document a row, in a folder of its key."""
    df.withColumn("_key", F.col(key)).write.mode("overwrite").partitionBy("_key").json(path)


def since(events: DataFrame, ms: int) -> DataFrame:
    return events.where(F.col("ms") > ms)


def from_device(events: DataFrame, device: int) -> DataFrame:
    return events.where(F.col("device") == device)


def remote(events: DataFrame, device: int, ms: int | None = None) -> DataFrame:
    """Events of other devices, after ms where it is given."""
    found = events.where(F.col("device") != device)
    return found if ms is None else since(found, ms)


def unapplied(events: DataFrame, applied: DataFrame) -> DataFrame:
    """Events whose id isn't among the applied ones: an anti-join, so it neither grows on the driver nor counts an event twice."""
    return events.join(applied.select("id"), "id", "left_anti")
