"""Stored keys in hash buckets with a Bloom filter: which arrivals are new.

The keys lie in a bucketed table, so a join brings the arrivals to them and never shuffles
them. A filter in the same folder is asked first: it is cut into blocks of 32,768 bits, a key
sets a few bits of one block, and only arrivals whose bits are all set go on to the
stored keys. What the filter says no to is new for sure; what may be known is decided exactly.

Each addition writes the blocks it touched, then its keys, so a lost job leaves at worst a filter
that lets more through. Blocks of several additions are combined when read. A filter made
for fewer keys than there are lets more arrivals through and changes no answer.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.session import configure, stash

BLOCK_BITS = 1 << 15   # one bitmap of Spark's bitmap functions
PROBES = 5
BITS_PER_KEY = 10      # about 1 % of new keys pass the filter
USELESS = 0.5          # a filter that lets more new keys pass is not worth asking


class KeyStore:
    """A set of keys in a shared folder; ``buckets`` and ``expected`` are fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], buckets: int = 64,
                 expected: int = 10_000_000):
        self.spark, self.path, self.keys, self.buckets = configure(spark), path, tuple(keys), buckets
        self.blocks = max(-(-expected * BITS_PER_KEY // BLOCK_BITS), 1)
        self.table = f"keys_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
        columns, by = ", ".join(f"{k} {t}" for k, t in keys.items()), ", ".join(keys)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({columns}) USING parquet "
                  f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}/keys'")
        (spark.createDataFrame([], "block long, bits binary").write.mode("ignore").parquet(f"{path}/filter"))

    def _keyless(self) -> Column:
        return F.expr(" OR ".join(f"{k} IS NULL" for k in self.keys))

    def _block(self) -> Column:
        return F.pmod(F.xxhash64(F.lit("block"), *self.keys), F.lit(self.blocks))

    def _places(self) -> Column:
        return F.array(*[F.pmod(F.xxhash64(F.lit(i), *self.keys), F.lit(BLOCK_BITS)) for i in range(PROBES)])

    def stored(self) -> DataFrame:
        return self.spark.table(self.table)

    def filter(self) -> DataFrame:
        """``block, bits``, one row per block that holds a key."""
        parts = self.spark.read.schema("block long, bits binary").parquet(f"{self.path}/filter")
        return parts.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))

    def add(self, rows: DataFrame) -> None:
        """Add the keys of ``rows``; keys with a NULL are no keys."""
        keys = stash(rows.select(*self.keys).filter(~self._keyless()).distinct(), "keystore-add")
        bits = keys.select(self._block().alias("block"), F.explode(self._places()).alias("place"))
        # equal places are combined before the shuffle
        (bits.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))
         .write.mode("append").parquet(f"{self.path}/filter"))
        keys.repartition(self.buckets, *self.keys).write.insertInto(self.table)

    def asked(self, arrivals: DataFrame) -> DataFrame:
        """``arrivals`` with ``maybe``: whether the filter lets their key through; no for keys with a NULL."""
        def is_set(place: Column) -> Column:
            byte = F.substring("bits", F.floor(place / 8).cast("int") + 1, F.lit(1))
            return F.bit_get(F.ascii(F.decode(byte, "ISO-8859-1")), (place % 8).cast("int")) == 1

        there = F.forall("places", is_set)
        with_bits = (arrivals.withColumns({"block": F.when(~self._keyless(), self._block()), "places": self._places()})
                     .join(self.filter(), "block", "left"))
        return with_bits.select(*arrivals.columns, F.coalesce(F.col("bits").isNotNull() & there, F.lit(False)).alias("maybe"))

    def passing(self) -> float:
        """The share of unknown keys that the filter lets through, by the bits that are set."""
        filled = F.bitmap_count("bits") / F.lit(BLOCK_BITS)
        return self.filter().agg(F.coalesce(F.sum(F.pow(filled, F.lit(PROBES))) / F.lit(self.blocks), F.lit(0.0))).first()[0]

    def absent(self, arrivals: DataFrame) -> DataFrame:
        """The arrivals whose key is not stored; those with a NULL in the key all are.

        A filter that many more keys were added to than expected refuses next to nothing; it is not asked then.
        """
        if self.passing() > USELESS:
            dealt = arrivals.repartition(self.buckets, *self.keys)  # as the stored keys are
            # an anti join would be moved below that, to where the stored keys have to be shuffled
            known = self.stored().withColumn("known", F.lit(True)).hint("merge")
            return dealt.join(known, list(self.keys), "left").filter("known IS NULL").select(*arrivals.columns)
        asked = stash(self.asked(arrivals), "keystore-asked")
        checked = asked.filter("maybe").join(self.stored(), list(self.keys), "left_anti")
        return asked.filter("NOT maybe").unionByName(checked.select(*asked.columns)).drop("maybe")
