"""Registry of the driver queries and their oracle texts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.plans.views import VIEWS
from vacantia.session import configure


class Tables:
    """Driver tables and domain views of one scale factor, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = configure(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            base, text = VIEWS[name]
            return self.spark.sql(text, base=getattr(self, base))
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix the oracle text with the domain views it names."""
    used, todo = [], [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    for v in todo:
        base, text = VIEWS[v]
        used.append(f"{v} AS ({text.format(base=base).strip()})")
    if not used:
        return sql.strip()
    body = sql.strip()
    head = "WITH "
    if body.upper().startswith("WITH RECURSIVE"):
        head, body = "WITH RECURSIVE ", body[len("WITH RECURSIVE"):].strip()
    elif body.upper().startswith("WITH"):
        body = body[len("WITH"):].strip()
    else:
        return head + ",\n".join(used) + "\n" + body
    return head + ",\n".join(used) + ",\n" + body


def wall_clock(df: DataFrame) -> DataFrame:
    """Instants as UTC wall-clock values, the form the oracle returns."""
    instants = {f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema
                if f.dataType.typeName() == "timestamp"}
    return df.withColumns(instants) if instants else df


def query(name: str, oracle: str | None = None):
    """Register a function of :class:`Tables` as a driver query."""
    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: wall_clock(build(Tables(spark, sf_dir)))
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return build
    return add
