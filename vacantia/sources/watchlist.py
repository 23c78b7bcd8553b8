"""The boards to expect, and their shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia import schemas
from vacantia.functions.text import shard_of


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.WATCHLIST).csv(path, header=True)


def shard(watchlist: DataFrame, index: int, shards: int) -> DataFrame:
    """The boards of one shard; shards are disjoint and complete."""
    return watchlist.filter(shard_of(F.col("token"), shards) == index)


def coverage(watchlist: DataFrame, landing: DataFrame) -> DataFrame:
    """Watched boards with the number of landed responses each."""
    seen = landing.groupBy("ats", "token").agg(F.count("*").alias("n"))
    return (watchlist.join(seen, ["ats", "token"], "left")
            .select("ats", "token", F.coalesce("n", F.lit(0)).cast("bigint").alias("responses")))
