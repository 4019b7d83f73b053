"""Reading tables, shared folders and text primitives used by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bounds of an Arrow batch between the JVM and a Python worker, set in the session by ``bound_batches``.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batch bounds, rows and bytes: texts may be long, and Spark's default is 10,000 rows of any size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``BATCH_BYTES`` and ``BATCH_ROWS`` rows at most, one row at least."""
    rows = max(1, min(BATCH_ROWS, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Run) -> Run:
    """A function for mapInArrow that gets small batches, and hands memory back to the system when its task is over.

    Workers live on after a task and their allocators keep what was freed; the executor's JVM needs that room.
    """

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(part for batch in batches for part in small(batch))
        hand_back()

    return inner


def hand_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the session names in spark.checkpoint.dir. Where it names none, one of its own if all is in one process, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Tables that each scratch() will delete, the innermost last.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and outlives lost executors. keep: beyond the innermost scratch(), until the one around it ends, if there is one."""
    path = fresh_path(df.sparkSession, label)
    own = _scratch.get()[: -1 if keep else None]
    if own:
        own[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was written within, but for what is kept: for operators whose result is a written table itself."""
    paths: list[str] = []
    token = _scratch.set((*_scratch.get(), paths))
    try:
        yield
    finally:
        _scratch.reset(token)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for name in paths:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def unused_prefix(df: DataFrame, prefix: str = "_") -> str:
    """A prefix that no column of df has, whatever its case: for derived columns beside columns of any name."""
    names = [c.lower() for c in df.columns]
    while any(c.startswith(prefix) for c in names):
        prefix += "_"
    return prefix


def take_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name can't clash with derived ones."""
    return df.select(*(df[n] for n in names))


#: ASCII white space as the contracts have it; bytes.split() and bytes.strip() use the same six characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def utf8(text: str | None) -> bytes:
    """Bytes of a text; null is empty. Lone surrogates can't come from Parquet strings."""
    return text.encode() if text else b""
