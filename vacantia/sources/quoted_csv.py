"""CSV files with quoted line breaks, read by many tasks each.

A line begins either outside or inside a quoted field, and its text alone says how it
ends in both cases. So every block of a file is read as lines and yields how it
maps the state before it to the state after it; these maps (one row per block) are
chained along each file, and then every block knows where its records begin. Records of one line, nearly all,
are complete where they lie; only lines of records with a break inside a
field are brought together.

A quote opens a field only as its first character and is doubled inside; elsewhere it is text.
Lines end with LF or CRLF. A quote that is never closed takes the rest of its file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.session import stash

_PLAIN, _CLOSED = '(?:[^",][^,]*+)?', '(?:[^"]++|"")*+"[^,]*+'
_REST = f'(?:,(?:"{_CLOSED}|{_PLAIN}))*+$'
FROM_OUTSIDE = f'(?s)^(?:"{_CLOSED}|{_PLAIN}){_REST}'  # lines that end outside when they begin outside
FROM_INSIDE = f'(?s)^{_CLOSED}{_REST}'                 # ... and when they begin inside a field
_LINES = "file string, block long, at long, value string, opens boolean, stays boolean"
SCANNED = f"{_LINES}, in0 boolean, start0 long, in1 boolean, start1 long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a block that begins outside (0) or inside (1) a field: whether each line does, and where its record began in the block."""
    now, state, start = None, [False, True], [-1, -1]
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        blocks = list(zip(columns["file"].to_pylist(), columns["block"].to_pylist(), strict=True))
        at, n = columns["at"].to_numpy(), batch.num_rows
        opens, stays = (columns[c].to_numpy(zero_copy_only=False) for c in ("opens", "stays"))
        inside, starts = np.zeros((2, n), bool), np.zeros((2, n), np.int64)
        new = np.array([i == 0 and b != now or i > 0 and b != blocks[i - 1] for i, b in enumerate(blocks)], bool)
        # only lines that open a field or close one can change the state
        turns = np.flatnonzero(new | opens | ~stays).tolist()
        for a, b in zip([-1, *turns], [*turns, n], strict=True):
            if a >= 0:
                if new[a]:
                    state, start = [False, True], [-1, -1]
                for h in (0, 1):
                    inside[h, a] = state[h]
                    start[h] = start[h] if state[h] else int(at[a])
                    starts[h, a] = start[h]
                    state[h] = bool(stays[a] if state[h] else opens[a])
            for h in (0, 1):
                inside[h, a + 1:b] = state[h]
                starts[h, a + 1:b] = start[h] if state[h] else at[a + 1:b]
                if not state[h] and b > a + 1:
                    start[h] = int(at[b - 1])
        if n:
            now = blocks[-1]
        for h in (0, 1):
            columns[f"in{h}"] = pa.array(inside[h])
            columns[f"start{h}"] = pa.array(starts[h], mask=starts[h] < 0)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def scanned_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines with file, block and order, saved, as their places are used several times."""
    value = F.col("value")
    quoted = F.contains(value, F.lit('"'))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    return stash(lines.select("file", "block", "at", "value", (quoted & ~value.rlike(FROM_OUTSIDE)).alias("opens"),
                              (~quoted | ~value.rlike(FROM_INSIDE)).alias("stays")).mapInArrow(_scan, SCANNED), "csv-lines")


def _chain(blocks: pd.DataFrame) -> pd.DataFrame:
    """Follow the state through the blocks of one file."""
    inside, start, out = False, None, []
    for r in blocks.sort_values("block").itertuples():
        out.append((r.file, r.block, inside, start))
        began = r.last1 if inside else r.last0
        start = start if began is None or pd.isna(began) else int(began)
        inside = bool(r.end1 if inside else r.end0)
    return pd.DataFrame(out, columns=["file", "block", "inside", "carried"]).astype({"carried": "Int64"})


def records(lines: DataFrame) -> DataFrame:
    """``file, at, value``: the records of all files; ``at`` is the place of the first line."""
    def end(h: int):
        return F.when(F.col(f"in{h}"), F.col("stays")).otherwise(F.col("opens"))

    ends = [F.max_by(c, "at").alias(n) for n, c in (("end0", end(0)), ("end1", end(1)), ("last0", F.col("start0")), ("last1", F.col("start1")))]
    blocks = stash(lines.groupBy("file", "block").agg(*ends).groupBy("file").applyInPandas(
        _chain, "file string, block long, inside boolean, carried long"), "csv-blocks")  # one row per block
    known = lines.join(blocks, ["file", "block"])
    begins = F.when(F.col("inside"), F.col("in1")).otherwise(F.col("in0"))
    known = known.select(
        "file", "block", "at", "value", begins.alias("within"),
        F.when(F.col("inside"), end(1)).otherwise(end(0)).alias("open"),
        F.coalesce(F.when(F.col("inside"), F.col("start1")).otherwise(F.col("start0")), "carried").alias("record"))
    whole = known.filter("NOT within AND NOT open").select("file", "at", "value")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda r: r["value"]), "\n")
    broken = known.filter("within OR open").groupBy("file", F.col("record").alias("at")).agg(text.alias("value"))
    # a line break inside a field stays as it is; the end of the record may be CRLF
    return whole.unionByName(broken).withColumn("value", F.regexp_replace("value", "\r\\z", ""))


def headed_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``file, value`` of all records but the first of each file, and ``file, header, at`` of these."""
    lines = scanned_lines(spark, path)
    found = records(lines)
    first = lines.groupBy("file").agg(F.min_by("at", F.struct("block", "at")).alias("at"))
    headers = stash(found.join(first, ["file", "at"]).select("file", F.col("value").alias("header"), "at"), "csv-headers")
    rest = found.join(headers.select("file", F.col("at").alias("header_at")), "file").filter("at <> header_at")
    return rest.select("file", "value"), headers
