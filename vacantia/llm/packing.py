"""Packing: concatenate and cut, by two-pass prefix sums over partition token totals.

Pass one encodes each partition of documents and saves the ids with their place
in the partition. The totals of the partitions (one row each) give every
partition its global offset. Pass two cuts every document at the fixed window
borders, so each partition works alone; a piece is the boundary record of one
document in one window. Only the last window can be short, and is padded.

Defined results: a null text is empty and has the end id alone; null ids stay
null; repeated rows are packed once each; an empty table gives no piece; other
columns are ignored. Documents lie in the order in which Spark reads them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import prepare, save, with_base
from vacantia.llm.tokens import default_path, encoder, gathered, with_end

ENCODED = "part int, doc_id long, start_in_part long, n_tokens long, width int, ids binary"
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, ids binary")
OUT = 2048  # pieces per Arrow batch


def encode(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, special_as_text: bool = False) -> DataFrame:
    """Pass one: ids of every document with its place in its partition."""
    path = tokenizer or default_path()

    def run(batches):
        enc, part, start = encoder(path, special_as_text), TaskContext.get().partitionId(), 0
        for batch in gathered(batches):
            all_ids = [with_end(b, enc.dtype, end_id) for b in enc.encode(batch.column("text").to_pylist())]
            counts = [len(b) // enc.dtype.itemsize for b in all_ids]
            starts = start + np.cumsum([0, *counts], dtype=np.int64)
            start, n = int(starts[-1]), len(counts)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, part, np.int32)), batch.column("doc_id"), pa.array(starts[:-1]),
                pa.array(counts, pa.int64()), pa.array(np.full(n, enc.dtype.itemsize, np.int32)),
                pa.array(all_ids, pa.binary())],
                names=["part", "doc_id", "start_in_part", "n_tokens", "width", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, ENCODED)


def pack(docs: DataFrame, window: int = 1024, tokenizer: str | None = None, end_id: int = 0,
         keep_ids: bool = True, special_as_text: bool = False) -> DataFrame:
    """Pieces of all documents; with ``keep_ids`` their ids as ``u32`` bytes."""
    prepare(docs.sparkSession)
    encoded = save(encode(docs, tokenizer, end_id, special_as_text), "packing-ids")
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    base = with_base(totals, "part", "tokens", "base")  # one row per partition of the first pass

    def cut(batches):
        for batch in batches:
            rows = []
            for doc, base, inner, width, ids in zip(*(batch.column(c).to_pylist() for c in (
                    "doc_id", "base", "start_in_part", "width", "ids")), strict=True):
                at = base + inner
                data = np.frombuffer(ids, np.dtype(f"<u{width}")).astype("<u4")
                n, start = len(data), 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    piece = data[start:start + window - offset].tobytes()
                    rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), n, sequence, offset,
                                 piece if keep_ids else None))
                    start += window - offset
                    if len(rows) == OUT:
                        yield _pieces(rows)
                        rows = []
            if rows:
                yield _pieces(rows)

    return encoded.join(F.broadcast(base), "part").select(
        "doc_id", "base", "start_in_part", "width", "ids").mapInArrow(cut, PIECES)


def sequences(pieces: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """The filled windows: ``sequence_id``, ``length`` and ``ids``, padded to ``window``.

    A window whose length is a power of two stays as it is.
    """
    def fill(pdf):
        import pandas as pd

        pdf = pdf.sort_values("offset")
        data = np.frombuffer(b"".join(pdf["ids"]), "<u4")
        n = len(data)
        size = n if n & (n - 1) == 0 else window
        return pd.DataFrame({"sequence_id": pdf["sequence_id"][:1].values, "length": [n],
                             "ids": [np.pad(data, (0, size - n), constant_values=pad_id).astype(np.int64)]})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(
        fill, "sequence_id long, length long, ids array<long>")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.binary())],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])


def packed_digest(docs: DataFrame) -> DataFrame:
    return pack(docs, keep_ids=False).drop("ids")
