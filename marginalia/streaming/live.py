"""Structured Streaming twins of the log's operators.

Late data: the watermark is one day. A row that is later than that is dropped by the stateful operators and shows in the
query's progress, which ``late_rows`` keeps as a table. Streams run on whatever is there and end (availableNow), and resume from their
checkpoint; results go to files in the folder that the cluster shares, one set for each micro-batch.
"""

from __future__ import annotations

import json
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "1 day"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share, which the session names in spark.checkpoint.dir; where it names none, one of its own if all is in one process, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{named.rstrip('/')}/live-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A stored table as a stream, be it one file or a folder of part files."""
    path = f"{sf_dir}/{table}.parquet"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    one = any(s.isFile() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or ())
    # A stream takes its path as the base of partition columns, which must be a folder, but not if it is a pattern.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/[{table[0]}]{table[1:]}.parquet" if one else path)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream with an event time that watermarks accept."""
    return table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str, schema: str, folder: str | None = None) -> DataFrame:
    """Run a stream over all there is; its output with a column batch. A stream without input has no rows."""
    spark = stream.sparkSession
    folder = folder or shared_dir(spark)
    out = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    out.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(out)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")  # again after a failure: the same files anew

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{schema}, batch int").option("recursiveFileLookup", "false").parquet(f"{folder}/out")


LATE = "name string, batch long, rows long, dropped long"


class _Late(StreamingQueryListener):
    """Notes the progress of each micro-batch of the queries that start while it listens."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.open: set[str] = set()
        self.changed = threading.Condition()

    def _note(self, act) -> None:
        with self.changed:
            act()
            self.changed.notify_all()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._note(lambda: self.open.add(str(event.runId)))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        dropped = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        self._note(lambda: self.rows.append({"name": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "dropped": dropped}))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._note(lambda: self.open.discard(str(event.runId)))


@contextmanager
def late_rows(spark: SparkSession, path: str) -> Iterator[None]:
    """While it is open, every micro-batch leaves a row (query, batch, rows read, rows dropped as later than the watermark), which are added to a table of JSON lines at its end."""
    listener = _Late()
    spark.streams.addListener(listener)
    try:
        yield
    finally:
        with listener.changed:  # the last events come by themselves, soon after a query has ended
            listener.changed.wait_for(lambda: not listener.open, timeout=30)
        spark.streams.removeListener(listener)
        spark.createDataFrame(listener.rows, LATE).coalesce(1).write.mode("append").json(path)


def newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Of the updates of a key, the one of the last batch."""
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in updates.columns if c != "batch")), "batch").alias("_row")).select("_row.*")


def deduplicated(stream: DataFrame, key: str) -> DataFrame:
    """Each key once within the watermark: exactly once by id, however often a device sends it."""
    return stream.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark([key])


def tumbling_counts(stream: DataFrame, width: str = "1 day") -> DataFrame:
    """(begins, event_type, items, total), as updates of each window; events without a time, which are in no window, come as rows of their own, to be summed."""
    counted = stream.withWatermark("ts", WATERMARK).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("items"), F.sum("value").alias("total"))
    untimed = stream.where("ts is null").select(F.lit(None).cast("long").alias("begins"), "event_type", F.lit(1).cast("long").alias("items"), F.col("value").alias("total"))
    return counted.select(F.unix_millis("window.start").alias("begins"), "event_type", "items", "total").unionByName(untimed)


def session_counts(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, begun, items): a user's events, parted where the user is silent for the gap or longer; an event without a time is a session of its own."""
    # Spark's sessions also hold events that are exactly the gap apart, so theirs is the shortest time less.
    window = F.session_window("ts", f"{gap} -1 microsecond")
    counted = stream.withWatermark("ts", WATERMARK).groupBy(window, "user_id").agg(F.count(F.lit(1)).alias("items"))
    untimed = stream.where("ts is null").select("user_id", F.lit(None).cast("long").alias("begun"), F.lit(1).cast("long").alias("items"))
    return counted.select("user_id", F.unix_millis("session_window.start").alias("begun"), "items").unionByName(untimed)


def keyed_fold(stream: DataFrame) -> DataFrame:
    """(user_id, items, total, last_ms): an account per user, which Spark keeps as state from batch to batch."""
    return stream.groupBy("user_id").agg(F.count(F.lit(1)).alias("items"), F.sum("value").alias("total"), F.max(F.unix_millis("ts")).alias("last_ms"))


#: Buckets of keys whose state is kept together; fixed for as long as a stream has its checkpoint.
KEYS = 4096


def folded(rows: DataFrame, key: str, fold: Callable, schema: str, timed: bool = True, buckets: int = KEYS) -> DataFrame:
    """A stream folded by key, with a text as state for each key that waits for more.

    fold(key, new, held, mark) gets the new rows of a key as tuples of rows' columns but for timestamps, its state (None for a new key) and the watermark in milliseconds (0 if not
    timed), and gives (tuples of schema, state or None, the time when the key is over or None). When that time has passed, it is called with new as None.
    Spark's groups are buckets of keys: calling Python for every key takes milliseconds, so keys with a row or two would take longer than their rows. A bucket's state
    is written anew with the keys that it still has when one of them has rows.
    """
    names, columns = rows.sparkSession.createDataFrame([], schema).columns, [c for c, kind in rows.dtypes if kind != "timestamp"]
    at = columns.index(key)

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs() if timed else 0
        held = {k: (text, due) for k, text, due in zip(*state.get, strict=True)} if state.exists else {}
        came, out = {}, []
        if not state.hasTimedOut:
            for frame in frames:
                for row in zip(*(frame[c].tolist() for c in columns), strict=True):
                    came.setdefault(row[at], []).append(row)
        over = [k for k, (_, due) in held.items() if timed and due <= mark and k not in came]
        for k, new in [*came.items(), *((k, None) for k in over)]:
            found, text, due = fold(k, new, held.pop(k, (None, 0))[0], mark)
            out.extend(found)
            if text is not None:
                held[k] = (text, due or 0)
        if held:
            state.update((list(held), [x[0] for x in held.values()], [x[1] for x in held.values()]))
            if timed:
                state.setTimeoutTimestamp(min(x[1] for x in held.values()))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).groupBy("_bucket")
    return dealt.applyInPandasWithState(step, schema, "keys array<string>, held array<string>, due array<bigint>", "append", GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout)


def fragment_fold(fragments: DataFrame, expires_ms: int = 86_400_000) -> DataFrame:
    """(call, seq, part, last) to (call, text, fragments): the parts of each call joined in order once the last and all before it are there.

    Fragments may come in any order and batch, and more than once; what is waiting is a call's own parts, and goes when the call is complete, or has
    had no fragment for ``expires_ms`` of event time, where fragments have a column ts: then its text is null and fragments the number of those that came.
    """
    timed = "ts" in fragments.columns
    rows = (fragments.withWatermark("ts", WATERMARK) if timed else fragments).withColumn("ms", F.unix_millis("ts") if timed else F.lit(0).cast("long"))

    def fold(call: str, new: list[tuple] | None, held: str | None, mark: int) -> tuple[list[tuple], str | None, int | None]:
        parts, end = json.loads(held) if held else ({}, -1)
        if new is None:
            return [(call, None, len(parts))], None, None
        parts |= {str(seq): part for _, seq, part, *_ in new}
        end = max([end, *(seq for _, seq, _, last, *_ in new if last)])
        if end >= 0 and len(parts) == end + 1:
            return [(call, "".join(parts[k] or "" for k in sorted(parts, key=int)), end + 1)], None, None
        return [], json.dumps([parts, end]), max([mark, *(row[4] for row in new)]) + expires_ms

    return folded(rows.select("call", "seq", "part", "last", "ms", *(["ts"] if timed else [])), "call", fold, "call string, text string, fragments long", timed)
