"""Token-ID output: length-delimited, checksummed binary records with a separate offset index.

File format (all integers little-endian), one shard per range of ``doc_id``:

``shard-NNNNN.bin``: records of ``u64 length | u32 check(length) | payload | u32 check(payload)``;
``shard-NNNNN.idx``: per record ``u64 offset | u64 tokens``, for shuffled reads.
payload: ``u8 null_id | u8 width | i64 doc_id | ids of width bytes each``.

``check`` is the CRC-32 of the bytes, rotated and offset ("masked"), so that a
file holding checksums does not check to itself. Shards are in ascending order of
``doc_id`` (nulls first, ties by a hash of the text), and so are their names.

Defined results: a null text is empty and has the end id alone; a null
``doc_id`` stays null; repeated rows give one record each; an empty table
gives no record. Other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import Committed, deal_by, exact_borders, parts, prepare, read_shared, save, shared_fs, with_base
from vacantia.llm.tokens import as_u32, default_path, encoder, gathered, with_end
from vacantia.session import scratch_path

MASK = 0xA282EAD8
MANIFEST = "shard int, file string, records long, tokens long, bytes long"
READ = "shard int, doc_id long, start_in_shard long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(stream) -> Iterator[bytes]:
    """Payloads of an open shard; raises on a broken checksum or a cut record."""
    while head := stream.read(12):
        if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
            raise ValueError("broken record length")
        n = struct.unpack("<Q", head[:8])[0]
        body = stream.read(n + 4)
        if len(body) < n + 4 or struct.unpack("<I", body[n:])[0] != masked(body[:n]):
            raise ValueError("broken record")
        yield body[:n]


def write_records(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0,
                  special_as_text: bool = False, shards: int | None = None) -> DataFrame:
    """Tokenize ``docs`` and write its shards and indexes; returns the manifest, one row per shard.

    The ranges follow from the ids alone, so a rerun writes the same files.
    """
    spark, path = prepare(docs.sparkSession), tokenizer or default_path()
    n = shards or parts(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = (deal_by(rows, "doc_id", exact_borders(docs.select("doc_id"), "doc_id", n), n)
            .sortWithinPartitions("doc_id", F.xxhash64("text"), "text"))

    def write(batches):
        enc, shard = encoder(path, special_as_text), TaskContext.get().partitionId()
        name, data, records, tokens = f"shard-{shard:05d}", None, 0, 0
        for batch in gathered(batches):
            if data is None:
                data, index = Committed(folder, f"{name}.bin"), Committed(folder, f"{name}.idx")
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for doc, encoded in zip(ids, enc.encode(texts), strict=True):
                encoded = with_end(encoded, enc.dtype, end_id)
                n = len(encoded) // enc.dtype.itemsize
                index.write(struct.pack("<QQ", data.size, n))
                data.write(frame(struct.pack("<BBq", doc is None, enc.dtype.itemsize, doc or 0) + encoded))
                records, tokens = records + 1, tokens + n
        if data is not None:
            data.commit()
            index.commit()
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "file": [f"{name}.bin"], "records": [records],
                "tokens": [tokens], "bytes": [data.size]})

    return save(rows.mapInArrow(write, MANIFEST), "records-manifest")


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the shards back: one row per record, with the checksum of its ids.

    ``start`` counts the ids of all records before it, over all shards.
    """
    spark = prepare(manifest.sparkSession)

    def read(batches):
        for batch in batches:
            for shard, file in zip(batch.column("shard").to_pylist(), batch.column("file").to_pylist(), strict=True):
                start, rows = 0, []
                with read_shared(folder, file) as stream:
                    for payload in unframe(stream):
                        null, width, doc = struct.unpack("<BBq", payload[:10])
                        n = (len(payload) - 10) // width
                        crc = zlib.crc32(as_u32(payload[10:], np.dtype(f"<u{width}")))
                        rows.append((shard, None if null else doc, start, n, crc))
                        start += n
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    # one task per few shards: a manifest row stands for a whole file
    files = manifest.select("shard", "file").repartition(parts(spark), "shard")
    base = with_base(manifest, "shard", "tokens", "base")  # one row per shard, as many as shuffle partitions
    return (files.mapInArrow(read, READ).join(F.broadcast(base), "shard")
            .select("doc_id", (F.col("base") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32"))


def read_at(folder: str, shard: int, position: int) -> tuple[int | None, np.ndarray]:
    """One record through the index, for shuffled reads."""
    fs, root = shared_fs(folder)
    with fs.open_input_file(f"{root}/shard-{shard:05d}.idx") as f:
        f.seek(16 * position)
        offset = struct.unpack("<QQ", f.read(16))[0]
    with fs.open_input_file(f"{root}/shard-{shard:05d}.bin") as f:
        f.seek(offset)
        payload = next(unframe(f))
    null, width, doc = struct.unpack("<BBq", payload[:10])
    return None if null else doc, np.frombuffer(payload[10:], np.dtype(f"<u{width}"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ("shard", "doc_id", "start_in_shard", "n_tokens", "ids_crc32")
    types = (pa.int32(), *[pa.int64()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def record_digest(docs: DataFrame) -> DataFrame:
    """Write ``docs`` to the shared folder in this format and read it back."""
    folder = scratch_path(docs.sparkSession, "records")
    return read_records(write_records(docs, folder), folder)
