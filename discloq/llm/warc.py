"""WARC archives: a deterministic sharded writer and its reader.

Records are range-sorted by page and each range is written by one task, which rolls to a new
file when the compressed size is reached. Headers and digests are made anew from the payload.
A file is written under a temporary name of its attempt and renamed when it is whole; the
driver then writes a manifest of the files that tasks named, and readers read only those. A
task that runs again writes the same bytes under the same names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discloq.llm.batches import by_bytes
from discloq.llm.common import join_hot, table
from discloq.session import shared_dir, written

ROLL_BYTES = 64 << 20
SHORTEST_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY = b""


def record(page: int | None, url: str | None, payload: bytes, refers: int | None) -> bytes:
    """One record with its blank lines. A revisit has no payload but its digest and length."""
    sha = hashlib.sha256(payload).hexdigest()
    name = lambda p: f"<urn:x-page:{p}:{sha[:16]}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:x-page:{page}"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    if refers is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers)}"]
    lines += [f"WARC-Payload-Digest: sha256:{sha}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member of its own, without a time, so the same bytes give the same bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def refer_back(pages: DataFrame, shortest: int = SHORTEST_REVISIT) -> DataFrame:
    """(page_id, refers_to, digest) of the pages whose payload a page with a smaller id has.
    Payloads under ``shortest`` bytes don't count. A null page_id comes last."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    signed = written(pages.select("page_id", F.octet_length(body).alias("n"), F.sha2(body, 256).alias("digest")).filter(F.col("n") >= shortest).drop("n"), "payloads")
    groups = signed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("size")).filter("size > 1 and refers_to is not null")
    out = join_hot(signed, groups, "digest", "size", signed.count(), "inner")
    return out.filter("page_id is null or page_id != refers_to").select("page_id", "refers_to", "digest")


def located(spark: SparkSession, folder: str) -> str:
    """``folder`` with its file system: one without a scheme is in the default file system, as it
    is for Spark's own tables."""
    if "://" in folder or folder.startswith("file:"):
        return folder
    default = spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return default.rstrip("/") + "/" + folder.lstrip("/") if not default.startswith("file:") else f"file://{folder}"


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, tasks: int | None = None) -> list[dict]:
    """Writes pages(page_id, url, html) as gzipped WARC files to ``folder`` and commits them by
    manifest.json. Null html is an empty payload. Repeated rows are written as often as they are
    there. An empty table gives an empty manifest. Returns the manifest's entries."""
    back = refer_back(pages).select("page_id", F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "refers_to", "digest")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(1).alias("_kind"), "url", "html", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("digest"))
    both = own.unionByName(back)
    spark = pages.sparkSession
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a page's decisions fall into its range and come before it: one shuffle of the payloads
    laid = both.repartitionByRange(n, "page_id").sortWithinPartitions("page_id", "_kind", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        made: list[tuple] = []
        sink = None
        known: tuple = (None, {})

        def close():
            nonlocal sink
            sink.close()
            files.move(temp, f"{base}/{made[-1][0]}")
            sink = None

        for batch in by_bytes(batches, "html"):
            for r in batch.to_pylist():
                page = r["page_id"]
                if known[0] != page or not known[1] and r["_kind"] == 0:
                    known = (page, {})
                if r["_kind"] == 0:
                    known[1][r["digest"]] = r["refers_to"]
                    continue
                payload = (r["html"] or "").encode("utf-8", "replace")
                refers = known[1].get(hashlib.sha256(payload).hexdigest()) if known[1] else None
                data = member(record(page, r["url"], payload, refers))
                if sink is not None and made[-1][2] + len(data) > roll_bytes:
                    close()
                if sink is None:
                    made.append((f"shard-{shard:06d}-{len(made):06d}.warc.gz", 0, 0))
                    temp = f"{base}/.{made[-1][0]}.{attempt}.tmp"
                    sink = files.open_output_stream(temp)
                sink.write(data)
                made[-1] = (made[-1][0], made[-1][1] + 1, made[-1][2] + len(data))
        if sink is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    files, base = pafs.FileSystem.from_uri(folder)
    files.create_dir(base)
    # one entry a file of up to roll_bytes; sorted here, as a sort in Spark would write twice
    entries = sorted((r.asDict() for r in laid.mapInArrow(run, "file string, records long, bytes long").collect()), key=lambda e: e["file"])
    temp = f"{base}/.manifest.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(temp) as out:
        out.write(json.dumps({"files": entries}, indent=1).encode())
    files.move(temp, f"{base}/manifest.json")
    return entries


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-cased names) and block of each record of an uncompressed stream."""
    while True:
        line = stream.readline()
        while line == b"\r\n":
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"{headers['warc-record-id']}: cut off")
        yield headers, block


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of the manifest's files, a task a file; block digests are verified. A
    revisit's html is null: it's the one of the page that it refers to."""
    files, base = pafs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{base}/manifest.json") as source:
        names = [e["file"] for e in json.loads(source.read())["files"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        page_of = lambda x: None if (p := x.split(":")[2]) == "None" else int(p)

        def batch_of(rows):
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])

        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with files.open_input_stream(f"{base}/{name}", compression=None) as raw, gzip.open(io.BufferedReader(_Raw(raw), 1 << 20)) as stream:
                    for h, block in records(stream):
                        if f"sha256:{hashlib.sha256(block).hexdigest()}" != h["warc-block-digest"]:
                            raise ValueError(f"{name}, {h['warc-record-id']}: block digest differs")
                        head, _, body = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                        whole = h["warc-type"] == "response"
                        rows.append((page_of(h["warc-record-id"]), h["warc-target-uri"], size, h["warc-payload-digest"].removeprefix("sha256:"), h["warc-type"],
                                     None if whole else page_of(h["warc-refers-to"]), body.decode("utf-8", "replace") if payload and whole else None))
                        held += len(body) if payload else 200
                        if held > 1 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    if not names:
        return spark.createDataFrame([], RECORD)
    listed = spark.createDataFrame([(x,) for x in names], "file string").repartition(min(len(names), 10_000))
    return listed.mapInArrow(run, RECORD)


class _Raw(io.RawIOBase):
    """A raw stream over a file of pyarrow, for gzip."""

    def __init__(self, source):
        self.source = source

    def readable(self):
        return True

    def readinto(self, target):
        data = self.source.read(len(target))
        target[: len(data)] = data
        return len(data)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = located(spark, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder, payload=False).drop("url", "html")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
k AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM k
"""
