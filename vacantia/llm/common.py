"""Shared pieces of the training-data operators: saved steps, shared files, prefix sums."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vacantia.session import configure, scratch_path

ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512"}


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of this subpackage: small Arrow batches, as texts may be long."""
    configure(spark)
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark


def save(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` (zstd Parquet) to the shared scratch folder and return the written table.

    Cuts the lineage: later steps survive lost executors and see true sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def with_base(totals: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Exclusive prefix sum of ``value`` by ``key``.

    ``totals`` has one row per partition or file, never one per document, so
    the single-partition window stays small.
    """
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, F.coalesce(F.sum(value).over(before), F.lit(0)).alias(name))


# -- ranges of a key that depend on the data alone ----------------------------------------------

BUCKETS = 1 << 14  # counted at a time


def exact_borders(rows: DataFrame, key: str, n: int) -> list[int]:
    """At most ``n - 1`` borders that cut the long column ``key`` into ranges of about equal rows.

    Counts of equal buckets, refined where a bucket holds more than a quarter of a range, so the
    borders follow from the values: any order, file layout or rerun gives the same.
    Nulls belong to the first range. Only ``BUCKETS`` counts (in each round) come to the driver.
    """
    values = rows.select(F.col(key).cast("long").alias("k")).filter("k IS NOT NULL")
    low, high, total = values.agg(F.min("k"), F.max("k"), F.count("*")).first()
    if not total or n < 2:
        return []
    step = (high - low) // BUCKETS + 1

    def counts(of: DataFrame, start: int, step: int) -> list[tuple[int, int, int]]:
        # in decimals, as the span of two longs may be none
        found = of.groupBy(F.expr(f"(CAST(k AS DECIMAL(20,0)) - {start}BD) div {step}BD").alias("b")).count().collect()
        return [(start + r["b"] * step, step, r["count"]) for r in found]

    buckets, share = counts(values, low, step), max(total // (4 * n), 1)
    while large := [(a, w) for a, w, c in buckets if c > share and w > 1]:
        buckets = [b for b in buckets if not (b[2] > share and b[1] > 1)]
        for a, w in large:  # fewer than 4 n
            buckets += counts(values.filter(F.col("k").between(a, min(a + w - 1, high))), a, (w - 1) // BUCKETS + 1)
    borders, held = [], 0
    for a, _, c in sorted(buckets):
        if held >= total * (len(borders) + 1) / n and len(borders) < n - 1:
            borders.append(a)
        held += c
    return borders


def deal_by(rows: DataFrame, key: str, borders: list[int], n: int) -> DataFrame:
    """``rows`` in ``n`` partitions, one for each range of ``key``; nulls go first."""
    edges = np.array(borders, np.int64)

    @F.pandas_udf("int")
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, k.to_numpy(), side="right").astype(np.int32))

    return rows.repartitionById(n, shard(F.coalesce(F.col(key).cast("long"), F.lit(-1 << 63))))


# -- files in a folder that all executors share -----------------------------------------------

def shared_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a folder given as URI or plain path."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


class Committed:
    """A file written under a temporary name and moved to its final one on commit.

    A task that is lost or runs twice leaves at most a temporary file; final
    names depend on the data alone and their content is the same each time. So a file
    that is there stays, and a later attempt ends by removing its own copy.
    """

    def __init__(self, folder: str, name: str):
        self.fs, root = shared_fs(folder)
        self.final = f"{root}/{name}"
        self.temp = f"{root}/_temporary-{uuid.uuid4().hex}-{name}"
        self.fs.create_dir(root, recursive=True)
        self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        there = self.fs.get_file_info(self.final)
        if there.type == pafs.FileType.NotFound:
            self.fs.move(self.temp, self.final)
        elif there.size == self.size:
            self.fs.delete_file(self.temp)
        else:
            raise FileExistsError(f"{self.final} holds something else; write to a new folder")


def read_shared(folder: str, name: str):
    fs, root = shared_fs(folder)
    return fs.open_input_stream(f"{root}/{name}", compression=None)
