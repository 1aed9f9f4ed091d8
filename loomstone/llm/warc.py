"""WARC archives packaged as ZIP files, and a reader that range-reads records without extraction.

Writer: every task packs its rows into archives of bounded size: a gzip-per-record WARC member and an index
member with each record's offset and length, both stored uncompressed in a ZIP. Of records with equal payloads
the one with the smallest key is the response; the others are revisits that refer to it.

Reader: finds the end-of-central-directory record (and its ZIP64 forms), reads the central directory, resolves
stored members through their local headers, reads the index and then only the byte ranges of the records.

Archives live in the folder spark.checkpoint.dir names and are opened through pyarrow's file systems, so any
shared store works. A file carries the name of the task's attempt, and the manifest, which Spark commits once for
each task, says which files count: lost, repeated or doubled tasks neither lose nor double a record. The reader
trusts each archive's own directory and index only.

Edge cases. A null payload is empty; equal empty payloads are revisits like others. A null key is never a
response where its payload has a keyed row, else it is. Rows that repeat a response's key are responses too. A null
URL writes no target header; control characters in URLs are percent-encoded. Extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import STAGED, arrow_map, new_path, stage

ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "key long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


# ---- records ---------------------------------------------------------------------------------------------


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC record, gzip-compressed by itself."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if key is None else key}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=5, mtime=0) as z:
        z.write("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")
    return out.getvalue()


def headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v for k, v in (x.split(": ", 1) for x in lines if ": " in x)}


def parse_record(data: bytes) -> tuple:
    """A row of READ_SCHEMA from one gzip member; a response's digest is computed anew and must agree."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = headers(head)
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda v: int(v[10:-1]) if v and v[10:-1] else None
    digest, kind = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"]
    size = int(headers(http)["content-length"])
    if kind == "response":
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size:
            raise ValueError(f"payload of {h['warc-record-id']} does not match its headers")
    return number(h["warc-record-id"]), h.get("warc-target-uri"), kind, digest, size, number(h.get("warc-refers-to", "")), payload if kind == "response" else None


# ---- ZIP -------------------------------------------------------------------------------------------------


class ZipDirectory:
    """Members of a ZIP archive from its central directory; read(member, offset, n) reads a range of a stored one."""

    def __init__(self, file: pa.NativeFile):
        self.file, size = file, file.size()
        tail_at = max(0, size - (1 << 16) - 22 - 20)
        tail = file.read_at(size - tail_at, tail_at)
        end = tail.rfind(b"PK\x05\x06", 0, max(0, len(tail) - 18))
        # the signature may occur in the comment: the record's own comment length must reach the end
        while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
            end = tail.rfind(b"PK\x05\x06", 0, end + 3)
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
            at = struct.unpack_from("<Q", tail, end - 12)[0]
            record = file.read_at(56, at)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        self.members: dict[str, tuple[int, int, int, int]] = {}
        directory, pos = file.read_at(length, start), 0
        for _ in range(count):
            if directory[pos : pos + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", directory, pos + 8)
            packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, pos + 20)
            header = struct.unpack_from("<I", directory, pos + 42)[0]
            name = directory[pos + 46 : pos + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = directory[pos + 46 + n_name : pos + 46 + n_name + n_extra], 0
            while e + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, e)
                if kind == 1:
                    wide, w = [struct.unpack_from("<Q", extra, e + 4 + i)[0] for i in range(0, n - n % 8, 8)], 0
                    if full == 0xFFFFFFFF:
                        full, w = wide[w], w + 1
                    if packed == 0xFFFFFFFF:
                        packed, w = wide[w], w + 1
                    if header == 0xFFFFFFFF:
                        header = wide[w]
                e += 4 + n
            self.members[name] = (method, packed, full, header)
            pos += 46 + n_name + n_extra + n_comment

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin: behind its local header, whose name and extra lengths are its own."""
        method, _, _, header = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; its records cannot be read by range")
        local = self.file.read_at(30, header)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"{name} has no local header")
        return header + 30 + sum(struct.unpack_from("<HH", local, 26))

    def read(self, name: str, offset: int = 0, n: int | None = None) -> bytes:
        size = self.members[name][1]
        n = size - offset if n is None else n
        if offset < 0 or offset + n > size:
            raise ValueError(f"range outside {name}")
        return self.file.read_at(n, self.start(name) + offset)


def zipped(data: bytes, index: list[tuple[int | None, int, int]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        z.writestr(zipfile.ZipInfo(DATA), data)
        z.writestr(zipfile.ZipInfo(INDEX), "".join(json.dumps({"key": k, "offset": o, "length": n}) + "\n" for k, o, n in index))
    return out.getvalue()


# ---- Spark -----------------------------------------------------------------------------------------------


def assign_roles(df: DataFrame, key: str, url: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """key, url, payload, refers_to, revisit. Only digests and keys are grouped; a hot digest is aggregated first."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.when(F.octet_length("payload") >= least_bytes, F.sha1("payload")))
    first = rows.where("sha is not null").groupBy("sha").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    # a plain equi-join: adaptive execution splits a hot digest's side
    joined = rows.join(first, "sha", "left")
    revisit = F.col("first").isNotNull() & ~F.coalesce(F.col("key") == F.col("first"), F.lit(False))
    return joined.select("key", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(roles: DataFrame, root: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives now; returns the table of their paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(root)
        store.create_dir(top, recursive=True)
        task, done = TaskContext.get(), 0
        data, index = io.BytesIO(), []

        def close() -> pa.RecordBatch:
            # of the attempt, as another one may deal its rows otherwise; the manifest names those of the one that counts
            name = f"part-{task.partitionId():06d}-{done:04d}-{task.taskAttemptId()}.wacz"
            with store.open_output_stream(f"{top}/{name}") as f:
                f.write(zipped(data.getvalue(), index))
            return pa.RecordBatch.from_pydict({"name": [name], "records": pa.array([len(index)], pa.int64())})

        for batch in batches:
            for i in range(batch.num_rows):
                key, url, payload, refers_to, revisit = (c[i].as_py() for c in batch.columns)
                one = record(key, url, payload, refers_to, revisit)
                index.append((key, data.tell(), len(one)))
                data.write(one)
                if data.tell() >= archive_bytes:
                    yield close()
                    data, index, done = io.BytesIO(), [], done + 1
        if index:
            yield close()

    STAGED.append(root)
    return stage(arrow_map(roles, run, "name string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, root: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives named in manifest. with_payload=False leaves payloads out of the rows, not of the check."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{top}/{name}") as f:
                    yield from records_of(ZipDirectory(f), with_payload)

    n = max(1, manifest.count())
    return arrow_map(manifest.select("name").repartition(n, "name"), run, READ_SCHEMA)


def records_of(archive: ZipDirectory, with_payload: bool) -> Iterator[pa.RecordBatch]:
    ranges = sorted((x["offset"], x["length"]) for x in map(json.loads, archive.read(INDEX).splitlines()))
    at = 0
    while at < len(ranges):
        # neighbouring records are fetched in one range
        end, last = at + 1, ranges[at][0] + ranges[at][1]
        while end < len(ranges) and ranges[end][0] == last and last + ranges[end][1] - ranges[at][0] <= RANGE_BYTES:
            last += ranges[end][1]
            end += 1
        data, base = archive.read(DATA, ranges[at][0], last - ranges[at][0]), ranges[at][0]
        rows = [parse_record(data[o - base : o - base + n]) for o, n in ranges[at:end]]
        cols = list(zip(*rows, strict=True))
        if not with_payload:
            cols[6] = [None] * len(rows)
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in READ_SCHEMA.split(", ")])
        at = end


def warc_round_trip(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", root: str | None = None, with_payload: bool = False) -> DataFrame:
    root = root or new_path(df.sparkSession, "warc")
    manifest = write_archives(assign_roles(df, key, url, payload), root)
    return read_archives(manifest, root, with_payload).withColumnRenamed("key", key)


def op7_warc_zip(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return warc_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
