"""WARC archives: a deterministic sharded writer and the reader that goes with it.

Rows are cut into ranges of keys by exact byte counts, each range is sorted and written by one task, and
files roll when their compressed size is reached. A file is written under a temporary name and renamed when
it is whole; the manifest of all files is written last, and a reader sees only what the manifest lists.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelworks.llm.common import new_path, saved

#: Raw payload bytes of a shard (one task writes it), and compressed bytes at which its file rolls.
SHARD_BYTES, ROLL_BYTES = 32 << 20, 16 << 20
CELL = 1024
#: Rows without a key are dealt to so many cells by their payload. Bytes of rows that a Python worker gets at a time (a row more at most).
NULL_CELLS, BATCH_BYTES = 4096, 8 << 20
SENT_ROWS = 1_000_000
DATE = "1970-01-01T00:00:00Z"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{nth}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, nth: int, refers_to: int | None, revisit: bool) -> bytes:
    """One record, compressed as a gzip member of its own. A revisit has the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, nth)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to, digest, 0)}", f"WARC-Profile: {PROFILE}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page: {refers_to}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines.append(f"Content-Length: {len(block)}")
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n") + squeeze.flush()


class _Files:
    """The files of one shard, one open at a time."""

    def __init__(self, base: str, shard: int, roll: int):
        self.fs, self.dir = pafs.FileSystem.from_uri(base)
        self.shard, self.roll, self.at, self.out = shard, roll, 0, None

    def write(self, data: bytes) -> dict | None:
        if self.out is None:
            self.temp = f"{self.dir}/_temporary-{uuid.uuid4().hex}.warc.gz"
            self.out, self.size, self.n, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.size, self.n = self.size + len(data), self.n + 1
        self.sha.update(data)
        return self.close() if self.size >= self.roll else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        name = f"part-{self.shard:06d}-{self.at:04d}.warc.gz"
        self.at += 1
        # a repeated task writes the same bytes, so it doesn't matter whose file stays
        try:
            self.fs.move(self.temp, f"{self.dir}/{name}")
        except OSError:
            if self.digest_of(f"{self.dir}/{name}") != self.sha.hexdigest():
                raise
            self.fs.delete_file(self.temp)
        return {"file": name, "shard": self.shard, "records": self.n, "bytes": self.size, "sha256": self.sha.hexdigest()}

    def digest_of(self, path: str, chunk: int = 1 << 20) -> str:
        sha = hashlib.sha256()
        with self.fs.open_input_stream(path, compression=None) as stream:
            while data := stream.read(chunk):
                sha.update(data)
        return sha.hexdigest()


MANIFEST = "file string, shard long, records long, bytes long, sha256 string"


def writer(base: str, roll: int):
    """The map function: rows sorted by (shard, page_id, kind) to manifest rows. Kind 0 tells that a payload of a page is a revisit, kind 1 is the page."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, page, marks, seen = None, object(), {}, {}

        def rows(done: list[dict | None]) -> pa.RecordBatch:
            done = [x for x in done if x]
            return pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), ("shard", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

        for batch in batches:
            done = []
            for shard, page_id, kind, url, html, sha1, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if files is None or files.shard != shard:
                    done.append(files.close() if files else None)
                    files, page = _Files(base, shard, roll), object()
                if page_id != page:
                    page, marks, seen = page_id, {}, {}
                if kind == 0:
                    marks[sha1] = refers_to
                    continue
                payload = (html or "").encode()
                raw = hashlib.sha1(payload)
                digest, nth = base64.b32encode(raw.digest()).decode(), seen.get(raw.hexdigest(), 0)
                seen[raw.hexdigest()] = nth + 1
                revisit, to = raw.hexdigest() in marks, marks.get(raw.hexdigest())
                if not revisit and nth and sha1 is not None:
                    revisit, to = True, page_id
                done.append(files.write(record(page_id, url, payload, digest, nth, to, revisit)))
            yield rows(done)
        if files:
            yield rows([files.close()])

    return write


@contextmanager
def small_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of about ``most`` bytes for what runs inside."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(most))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def ranges(pages: DataFrame, key: str, size: str, shard_bytes: int) -> DataFrame:
    """(cell, shard): cells of CELL keys dealt to shards in key order by running bytes. Exact, so reruns agree."""
    cells = pages.groupBy("cell").agg(F.sum(F.col(size) + 512).alias("b")).withColumn("_up", F.floor(F.col("cell") / CELL))
    cells = saved(cells, "cells")
    ups = cells.groupBy("_up").agg(F.sum("b").alias("_b"))
    ups = ups.select("_up", F.coalesce(F.sum("_b").over(Window.orderBy("_up").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inner = F.coalesce(F.sum("b").over(Window.partitionBy("_up").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cells.withColumn("_in", inner).join(ups, "_up").select("cell", F.floor((F.col("_base") + F.col("_in")) / shard_bytes).cast("long").alias("shard"))


def write_warc(pages: DataFrame, base: str, key: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = 0,
               shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes ``pages`` under ``base`` (a URI that every executor reaches) and returns the committed manifest.

    Of rows with equal payloads of at least ``revisit_bytes`` bytes, that with the largest key is the response and the
    others are revisits of it; of rows that share that key too, the first stays and the rest revisit it. A null html
    is an empty payload; a null url has no target; a null key counts as smaller than any other. Keys are longs.
    Rows without a key are spread by payload, so only equal payloads of theirs meet in a task. Payloads reach Python in
    batches of about BATCH_BYTES, so a task holds few of them whatever their size. Other columns are ignored, so none
    can clash; an empty table gives an empty manifest."""
    own = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    unkeyed = F.lit(-(1 << 54)) - F.pmod(F.xxhash64("html"), F.lit(NULL_CELLS))
    own = own.withColumn("cell", F.when(F.col("page_id").isNull(), unkeyed).otherwise(F.shiftright("page_id", 10)))
    narrow = saved(own.select("page_id", "cell", F.octet_length("html").cast("long").alias("n"), F.sha1(F.col("html").cast("binary")).alias("sha1")), "digests")
    groups = narrow.where(F.col("n") >= revisit_bytes).groupBy("sha1").agg(F.max("page_id").alias("to"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    groups = saved(groups.drop("rows"), "payloads")
    marks = narrow.where(F.col("n") >= revisit_bytes).join(groups, "sha1").where("not page_id <=> to").select("cell", "page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "sha1", "to").distinct()
    shards = saved(ranges(narrow, "page_id", "n", shard_bytes), "shards")
    rows = marks.unionByName(own.select("cell", "page_id", F.lit(1).alias("kind"), "url", "html", F.when(F.octet_length("html") >= revisit_bytes, F.lit("")).alias("sha1"), F.lit(None).cast("long").alias("to")))
    rows = rows.join(F.broadcast(shards) if shards.count() <= SENT_ROWS else shards, "cell")
    n_shards = (shards.agg(F.max("shard")).first()[0] or 0) + 1
    rows = rows.select("shard", "page_id", "kind", "url", "html", "sha1", "to").repartitionByRange(min(n_shards, 10_000), "shard").sortWithinPartitions("shard", "page_id", "kind", F.xxhash64("url", "html"), "url")
    fs, where = pafs.FileSystem.from_uri(base)
    fs.create_dir(where, recursive=True)
    manifest = rows.mapInArrow(writer(base, roll_bytes), MANIFEST)
    with small_batches(pages.sparkSession, BATCH_BYTES):
        manifest.write.parquet(f"{base}/manifest")
    return pages.sparkSession.read.parquet(f"{base}/manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unzip, parts = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            parts.append(unzip.decompress(data))
            if not unzip.eof:
                break
            yield b"".join(parts)
            data, unzip, parts = unzip.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the file ends inside a record")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def reader(base: str):
    """The map function: (file) to one row for each record. Every digest is computed again and must agree."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = pafs.FileSystem.from_uri(base)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out = []
                with fs.open_input_stream(f"{where}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        head, _, rest = raw.partition(b"\r\n\r\n")
                        h = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                        block = rest[:int(h["Content-Length"])]
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(re.search(rb"Content-Length: (\d+)", http)[1])
                        if "sha1:" + base32_sha1(block) != h["WARC-Block-Digest"] or h["WARC-Type"] == "response" and (base32_sha1(payload) != digest or len(payload) != size):
                            raise ValueError(f"{name}: a record of page {h.get('X-Page-Id')} is damaged")
                        out.append({"page_id": int(h["X-Page-Id"]) if "X-Page-Id" in h else None, "payload_bytes": size, "payload_digest": digest, "record_type": h["WARC-Type"],
                                    "refers_to": int(h["X-Refers-To-Page"]) if "X-Refers-To-Page" in h else None, "url": h.get("WARC-Target-URI")})
                        if len(out) >= 4096:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    return read


def read_warc(spark: SparkSession, base: str) -> DataFrame:
    """The records of the files that the manifest under ``base`` lists, a task for each file."""
    files = spark.read.parquet(f"{base}/manifest").select("file")
    return files.repartition(max(1, min(files.count(), 10_000)), "file").mapInArrow(reader(base), READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to a new folder in the shared folder and reads the archives back."""
    base = new_path(pages.sparkSession, "warc")
    write_warc(pages, base)
    return read_warc(pages.sparkSession, base)
