"""File-stream form of the load: landing files in, new postings out.

What is known of earlier batches is keyed state, not a table: the keys alone, without a value, so that a key that
comes again is looked up and not written. It lies in RocksDB, partitioned by key. A batch reads only its own files, first for
the keys, then for the whole rows: all of them while it brings a new key, else those that hold rows without a key. It
reads nothing that an earlier batch wrote. What the state says of a batch is saved, so it is asked once.

Each micro-batch writes its own ``batch_id=n`` folder. A replayed batch starts from the
state before it, so it overwrites its own output with the same rows, and a restart adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from vacantia import schemas
from vacantia.operators.load import JOB_KEY, first_arrivals
from vacantia.session import stash
from vacantia.sources.payloads import all_postings

POSTING_ORDER = ["fetched_at", "ats", "token", "position"]
STATE = {"spark.sql.streaming.stateStore.providerClass":
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         # counting the rows of the state would look each key up once more
         "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}


def landing_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.LANDING)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per Arrow batch each key once and each file once, without key, also as one that holds rows without a key."""
    def once(rows: pa.Table, columns: list[str]) -> pa.Table:
        return rows.group_by(columns).aggregate([]).select(columns)

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        keyed = once(rows.filter(pc.invert(rows["keyless"])), rows.column_names[:-2])
        files, loose = once(rows, ["file"]), once(rows.filter(rows["keyless"]), ["file"])
        named = [t.append_column("keyless", pa.repeat(flag, len(t))) for t, flag in ((files, False), (loose, True))]
        yield from (pa.concat_tables([keyed, *named], promote_options="default").select(rows.column_names)
                    .combine_chunks().to_batches())


def first_seen(rows: DataFrame, order_by: list[str], keys: tuple[str, ...] = JOB_KEY) -> DataFrame:
    """``keys, file, keyless`` of what comes for the first time, as a stream in append mode.

    New keys have no ``file``. Each file with rows has an entry by name, without keys; as rows with a NULL key
    conflict with nothing, a second one, with ``keyless``, tells that it holds such rows. The state knows neither times
    nor places, so a batch finds its first rows by ``order_by`` when it reads them.
    """
    keyless = F.expr(" OR ".join(f"{k} IS NULL" for k in keys))
    narrow = rows.select(*keys, F.input_file_name().alias("file"), keyless.alias("keyless"))
    entry = StructType([StructField(f.name, f.dataType) for f in narrow.schema])
    return narrow.mapInArrow(_entries, entry).dropDuplicates([*keys, "file", "keyless"])


def insert_stream(stream: DataFrame, read_files: Callable[[list[str]], DataFrame],
                  to_rows: Callable[[DataFrame], DataFrame], table: str, checkpoint: str,
                  order_by: list[str], keys: tuple[str, ...] = JOB_KEY) -> StreamingQuery:
    """Run all available files of ``stream`` through insert-if-absent into ``table``.

    ``read_files`` reads some of its files as a table; ``to_rows`` works row by
    row and is applied to the stream and to these.
    """
    spark = stream.sparkSession
    rows_of_stream = to_rows(stream)
    # Batch -1 holds no rows; it gives the table a schema before the first batch.
    none = spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows_of_stream.schema])
    none.write.mode("ignore").parquet(f"{table}/batch_id=-1")
    keyless = F.expr(" OR ".join(f"{k} IS NULL" for k in keys))

    def load(batch: DataFrame, batch_id: int) -> None:
        seen = stash(batch, "stream-seen")
        fresh = seen.filter("file IS NULL")
        named = seen.filter("file IS NOT NULL" if not fresh.isEmpty() else "keyless")
        # at most the files of one batch
        files = sorted(unquote(r.file) for r in named.select("file").distinct().collect())
        arrived = to_rows(read_files(files)) if files else none
        keyed = arrived.filter(~keyless).join(fresh.select(*keys), list(keys), "left_semi")
        (first_arrivals(keyed, order_by, keys).select(*arrived.columns).unionByName(arrived.filter(keyless))
         .write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}"))

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:  # a query keeps the settings it starts with
        return (first_seen(rows_of_stream, order_by, keys).writeStream.foreachBatch(load).outputMode("append")
                .trigger(availableNow=True).option("checkpointLocation", checkpoint).start())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ingest_postings(spark: SparkSession, landing: str, table: str, checkpoint: str,
                    files_per_batch: int | None = None) -> StreamingQuery:
    """Landing files of all providers to a postings table."""
    return insert_stream(landing_stream(spark, landing, files_per_batch),
                         lambda files: spark.read.schema(schemas.LANDING).json(files), all_postings,
                         table, checkpoint, POSTING_ORDER)
