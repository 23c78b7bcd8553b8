"""WARC output: a deterministic sharded writer and its reader.

Records are sorted by range of ``page_id``, with borders that follow from the ids alone; every range is one task that rolls its
files by compressed size. Headers, record ids, dates and digests are made anew from
the page alone, so a rerun writes the same bytes. A file is written under a
temporary name and moved when whole; the table of moved files is the manifest, and
only files in it count.

Pages with equal payloads (of at least ``min_bytes``) share one response record, that
of the largest ``page_id``; the others are revisit records without payload that
name it. The choice is made on digests alone; each page's decision is sorted next to
its page, so the payload is shuffled once.

Defined results: null html is an empty payload; a null url becomes ``urn:page:<id>``;
rows with a null id come first and are revisits wherever an equal payload has an id;
of repeated rows with one id and payload one is the response and the others
revisit it; an empty table writes no file and gives no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import Committed, deal_by, exact_borders, parts, prepare, read_shared, save
from vacantia.session import scratch_path

ROLL_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"   # one date for all records: reruns write the same bytes
SPACE = uuid.UUID("6f1c1c52-8c2e-5f4e-9d6b-2f0f5f3b7a10")
MANIFEST = "file string, records long, bytes long, first_id long, last_id long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, as its own gzip member."""
    digest = bare_digest(payload)
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = head if revisit else head + payload
    uri = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response",
             f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{bare_digest(block)}",
             f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-Id: {refers_to}")
    text = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode()
    return gzip.compress(text + block + b"\r\n\r\n", compresslevel=5, mtime=0)


def decisions(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, digest, response_id`` of every row; only digests are shuffled."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(body).alias("digest"),
                        (F.length(body) >= min_bytes).alias("shared"))
    largest = keys.filter("shared").groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
    several = largest.filter("n > 1").select(F.col("digest").alias("d"), "response_id")
    return (keys.join(several, F.col("digest") == F.col("d"), "left").withColumn("known", F.col("d").isNotNull())
            .select("page_id", "digest", "response_id", "known"))


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shards: int | None = None) -> DataFrame:
    """Write all pages; returns the manifest, one row per file."""
    spark = prepare(pages.sparkSession)
    n = shards or parts(spark)
    body = F.coalesce(F.col("html"), F.lit(""))
    chosen = save(decisions(pages, min_bytes), "warc-decisions")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(body.cast("binary")).alias("digest"), F.lit(1).alias("kind"),
                        "url", body.alias("html"), F.lit(None).cast("long").alias("response_id"))
    facts = chosen.filter("known").distinct().select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"),
                          F.lit(None).cast("string").alias("html"), "response_id")
    # a decision sorts right before the pages it is for
    ordered = (deal_by(rows.unionByName(facts), "page_id", exact_borders(pages.select("page_id"), "page_id", n), n)
               .sortWithinPartitions("page_id", "digest", "kind", "url"))

    def write(batches):
        shard, roll, out, told = TaskContext.get().partitionId(), 0, None, None
        records, first, last, done = 0, None, None, None

        def close():
            out.commit()
            return pa.RecordBatch.from_arrays(
                [pa.array([out.final.rsplit("/", 1)[1]]), pa.array([records], pa.int64()), pa.array([out.size], pa.int64()),
                 pa.array([first], pa.int64()), pa.array([last], pa.int64())],
                names=["file", "records", "bytes", "first_id", "last_id"])

        for batch in batches:
            for page, digest, kind, url, html, response in zip(*(batch.column(c).to_pylist() for c in (
                    "page_id", "digest", "kind", "url", "html", "response_id")), strict=True):
                if kind == 0:
                    told = (page, digest, response)
                    continue
                known = told is not None and told[:2] == (page, digest)
                response = told[2] if known else None
                # the first row of the response's id and payload carries it
                revisit = known and (page != response or done == (page, digest))
                done = (page, digest)
                if out is None:
                    out = Committed(folder, f"pages-{shard:05d}-{roll:04d}.warc.gz")
                    records, first = 0, page
                out.write(record(page, url, html.encode("utf-8", "surrogatepass"), response, revisit))
                records, last = records + 1, page
                if out.size >= roll_bytes:
                    yield close()
                    out, roll = None, roll + 1
        if out is not None:
            yield close()

    return save(ordered.mapInArrow(write, MANIFEST), "warc-manifest")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a compressed archive."""
    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if line.strip() != b"WARC/1.1":
                raise ValueError("no record where one should start")
            head = {}
            while (line := f.readline()).strip():
                name, _, value = line.decode().partition(":")
                head[name.lower()] = value.strip()
            block = f.read(int(head["content-length"]))
            if len(block) != int(head["content-length"]) or f.read(4) != b"\r\n\r\n":
                raise ValueError("cut record")
            yield head, block


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """The archives of a manifest, one row per record; digests are checked against the bytes."""
    def number(text):
        return None if text is None else int(text)

    def run(batches):
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows = []
                with read_shared(folder, file) as stream:
                    for head, block in parse(stream):
                        digest, n = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                        if head["warc-block-digest"] != f"sha1:{bare_digest(block)}":
                            raise ValueError("block digest differs")
                        if head["warc-type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if bare_digest(payload) != digest or len(payload) != n:
                                raise ValueError("payload digest differs")
                        rows.append((number(head.get("x-page-id")), n, digest, head["warc-type"], number(head.get("x-refers-to-page-id"))))
                        if len(rows) == 4096:
                            yield listed(rows)
                            rows = []
                if rows:
                    yield listed(rows)

    def listed(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = manifest.select("file").repartition(parts(prepare(manifest.sparkSession)), "file")
    return files.mapInArrow(run, READ)


def warc_digest(pages: DataFrame) -> DataFrame:
    folder = scratch_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder), folder)
