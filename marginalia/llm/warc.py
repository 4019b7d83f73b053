"""WARC archives: whole-file gzip streams written, then normalised to one gzip member a record with a sidecar offset index.

``write_archives`` writes one archive a partition as a single gzip stream, the way many crawlers leave them: no record can
be reached without inflating all before it. ``normalise`` inflates each such stream once, in chunks, writes every record
anew as its own member and a sidecar (JSON lines: offset, length, type, id). ``read_archives`` then reads records by the
sidecar alone. Of pages with equal payloads of ``min_revisit_bytes`` or more, the one with the smallest page_id is a
response and the others are revisit records, which repeat its HTTP header and digest but not its payload.

Files go to the folder the cluster shares, under a name of their own for each attempt, and are then moved to their final
name, so a lost executor's task can run again. Null html counts as empty, null urls as an empty one; a null page_id never is
the smallest; repeated rows are records of their own, and equal smallest ids are all responses. No pages, no archives.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.tables import fresh_path, take_columns, tidy, written

CHUNK = 1 << 20
WARC_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z][a-z0-9+.-]*://|file:", uri) else (fs.LocalFileSystem(), uri)


def mark_revisits(pages: DataFrame, min_revisit_bytes: int = 100) -> DataFrame:
    """(page_id, url, html) with digest, payload_bytes and refers_to (null for responses)."""
    html = F.coalesce("html", F.lit(""))
    own = take_columns(pages, "page_id", "url", "html").select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    shared = own.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    shared = written(shared.where("n > 1").select(F.col("digest").alias("_digest"), "first_id"), "warc-shared")
    # Two plain exchanges below the join: a digest with very many pages is split at run time.
    found = own.join(shared, own["digest"] == shared["_digest"], "left")
    return found.select("page_id", "url", "html", "digest", "payload_bytes", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")), F.col("first_id")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {WARC_DATE}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or ""), f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Placed:
    """A file that appears under its final name only when complete."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = located(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.part, compression=None)

    def done(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Each partition as one archive, a single gzip stream. Returns (archive, records), written already."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, pack, n = None, zlib.compressobj(6, zlib.DEFLATED, 31), 0
        uri = f"{folder}/crawl-{TaskContext.get().partitionId():06d}.warc.gz"
        for batch in batches:
            for page, url, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                out = out or Placed(uri)
                out.out.write(pack.compress(record(page, url, html.encode(), digest, refers)))
                n += 1
        if out:
            out.out.write(pack.flush())
            out.done()
            yield pa.RecordBatch.from_pydict({"archive": [uri], "records": pa.array([n], pa.int64())})

    where, path = located(folder)
    where.create_dir(path)
    return written(marked.mapInArrow(tidy(write), "archive string, records long"), "warc-archives")


def records(stream: BinaryIO) -> Iterator[bytes]:
    """Whole records of a gzip stream of any number of members, holding one record and a chunk at a time."""
    unzip, held = zlib.decompressobj(31), bytearray()

    def more() -> bool:
        nonlocal unzip
        data = unzip.unused_data if unzip.eof else b""
        if unzip.eof:
            unzip = zlib.decompressobj(31)
        data = data or stream.read(CHUNK)
        if not data:
            return False
        held.extend(unzip.decompress(data))
        return True

    while True:
        searched = 0
        while (end := held.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(held) - 3)
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a record")
                return
        size = re.search(rb"(?im)^content-length:\s*(\d+)", held[:end])
        if not size:
            raise ValueError("a record has no Content-Length")
        stop = end + 4 + int(size[1]) + 4
        while len(held) < stop:
            if not more():
                raise ValueError("the archive ends within a record")
        yield bytes(held[:stop])
        del held[:stop]


def parsed(whole: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = whole[:-4].partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}, block


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Archives of any gzip layout anew with a member a record, each with a sidecar. Returns (archive, sidecar, records), written already."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                name = uri.rsplit("/", 1)[1].removesuffix(".warc.gz")
                out, side, at, n = Placed(f"{folder}/{name}.warc.gz"), Placed(f"{folder}/{name}.index.jsonl"), 0, 0
                where, path = located(uri)
                with where.open_input_stream(path, compression=None) as stream:
                    for whole in records(stream):
                        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = pack.compress(whole) + pack.flush()
                        head, _ = parsed(whole)
                        out.out.write(member)
                        side.out.write((json.dumps({"offset": at, "length": len(member), "type": head["warc-type"], "id": head["warc-record-id"]}) + "\n").encode())
                        at, n = at + len(member), n + 1
                out.done()
                side.done()
                yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}.warc.gz"], "sidecar": [f"{folder}/{name}.index.jsonl"], "records": pa.array([n], pa.int64())})

    where, path = located(folder)
    where.create_dir(path)
    n = archives.count()
    return written(archives.select("archive").repartition(max(1, n), "archive").mapInArrow(tidy(rewrite), "archive string, sidecar string, records long"), "warc-normalised")


def read_archives(normalised: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records (page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) read member by member through the sidecars."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else "")
    number = lambda x: int(m[1]) if x and (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, side in zip(batch.column("archive").to_pylist(), batch.column("sidecar").to_pylist(), strict=True):
                where, path = located(uri)
                rows: list[tuple] = []
                with where.open_input_file(path) as archive, where.open_input_stream(located(side)[1], compression=None) as lines:
                    for line in lines.read().splitlines():
                        entry = json.loads(line)
                        head, block = parsed(zlib.decompress(archive.read_at(entry["length"], entry["offset"]), 31))
                        http, _, payload = block.partition(b"\r\n\r\n")
                        said = head["warc-payload-digest"].removeprefix("sha256:")
                        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
                        if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != said):
                            raise ValueError(f"{uri} at {entry['offset']}: the payload isn't the one that was written")
                        rows.append((number(head["warc-record-id"]), head["warc-target-uri"], size, said, head["warc-type"], number(head.get("warc-refers-to")), payload)[: len(names)])
                        if len(rows) == 1000:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    n = normalised.count()
    return normalised.select("archive", "sidecar").repartition(max(1, n), "archive").mapInArrow(tidy(read), schema)


def roundtrip(pages: DataFrame, min_revisit_bytes: int = 100) -> DataFrame:
    """Write all pages as archives, normalise them and read them back."""
    folder = fresh_path(pages.sparkSession, "warc")
    archives = write_archives(mark_revisits(pages, min_revisit_bytes), f"{folder}/crawl")
    return read_archives(normalise(archives, f"{folder}/normal"))
