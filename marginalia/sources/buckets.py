"""A table kept in hash buckets of Parquet files that grows a batch at a time; a batch writes, and a lookup reads, only the buckets that its keys fall into.

Layout below one folder that driver and executors share: ``rows/version=N/bucket=B`` holds the rows that version N wrote for a bucket, ``manifest/N.json``
the versions of which each bucket consists. A version is made from the one before it and from its batch alone, rows before manifest, and the
manifest is moved to its name when it is whole, so doing a version again after a failure writes the same rows, and readers never see half of one. A
bucket is one task's work: choose their number so that a bucket fits (it is fixed when the table is made). Buckets gather segments until ``compact``
folds them. The manifest has a number for each segment of each bucket, and is all that the driver holds.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A bucket of more segments wants compacting.
SEGMENTS = 8


class Buckets:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, name: str) -> list[str]:
        fs, path = self._fs(f"{self.path}/{name}")
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _numbers(self, name: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self._names(name) if "=" in n)

    def versions(self) -> list[int]:
        """Those that were made to their end."""
        return sorted(int(n[:-5]) for n in self._names("manifest") if n.endswith(".json"))

    def manifest(self, upto: int | None = None) -> dict[int, list[int]]:
        """bucket -> the versions it consists of, at the last version, or at the last one up to a number."""
        done = [v for v in self.versions() if upto is None or v <= upto]
        if not done:
            return {}
        fs, path = self._fs(f"{self.path}/manifest/{done[-1]}.json")
        stream = fs.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return {int(b): held for b, held in json.loads(text).items()}

    def read(self, buckets: Iterable[int] | None = None, upto: int | None = None) -> DataFrame:
        """The rows with their bucket and version; of some buckets only, or as they were at a version."""
        held = self.manifest(upto)
        wanted = sorted(held if buckets is None else set(buckets) & set(held))
        paths = [f"{self.path}/rows/version={v}/bucket={b}" for b in wanted for v in held[b]]
        schema = f"{self.schema}, version int, bucket int"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(*paths)

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets that keys fall into: as many numbers as there are buckets at most."""
        return sorted(r["bucket"] for r in keys.select(self.bucket().alias("bucket")).distinct().collect())

    def lookup(self, keys: DataFrame, upto: int | None = None) -> DataFrame:
        """All rows of the buckets that keys fall into; no other file is read."""
        return self.read(self.buckets_of(keys), upto)

    def add(self, rows: DataFrame, version: int) -> list[int]:
        """Makes a version with some rows more, as a segment of the buckets that they fall into, which it returns. One shuffle, by bucket; Spark cuts large buckets to several tasks, which write a file each."""
        before = self.manifest(version - 1)
        return self._write(rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket"), version, before)

    def wants_compacting(self) -> bool:
        return max(map(len, self.manifest().values()), default=0) > SEGMENTS

    def compact(self, version: int, fold: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Makes a version in which every bucket of several segments is one again; returns these buckets.

        fold gets their rows with version and bucket, and groups by bucket and keys, which the one shuffle here has together. What readers make of its
        rows must be what they would have made of those that it got.
        """
        before = self.manifest(version - 1)
        many = [b for b, held in before.items() if len(held) > 1]
        return self._write(fold(self.read(many, version - 1).repartition(self.buckets, "bucket")), version, {b: v for b, v in before.items() if b not in many})

    def _write(self, rows: DataFrame, version: int, held: dict[int, list[int]]) -> list[int]:
        """The rows of a version, then its manifest: what is held besides, and what was written."""
        rows.drop("version").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={version}")
        wrote = self._numbers(f"rows/version={version}")
        held = held | {b: [*held.get(b, []), version] for b in wrote}
        name = f"{self.path}/manifest/{version}.json"
        fs, half = self._fs(name + ".half")
        stream = fs.create(half, True)
        try:
            stream.write(bytearray(json.dumps(held, sort_keys=True).encode()))
        finally:
            stream.close()
        whole = self._fs(name)[1]
        fs.delete(whole, False)
        fs.rename(half, whole)
        return wrote

    def forget(self, version: int) -> None:
        """Deletes what only versions before this one read. Readers of those must have ended."""
        kept = [v for v in self.versions() if v >= version]
        if not kept:
            return
        needed = {(v, b) for n in kept for b, held in self.manifest(n).items() for v in held}
        for v in self._numbers("rows"):
            for b in self._numbers(f"rows/version={v}"):
                if v <= kept[-1] and (v, b) not in needed:
                    self._delete(f"rows/version={v}/bucket={b}")
        for v in self.versions():
            if v < version:
                self._delete(f"manifest/{v}.json")

    def _delete(self, name: str) -> None:
        fs, path = self._fs(f"{self.path}/{name}")
        fs.delete(path, True)
