"""Constraint checks: keys, references, enumerations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(table: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once; a NULL key conflicts with nothing."""
    present = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return (table.filter(present).groupBy(*keys).agg(F.count("*").alias("n"))
            .filter("n > 1"))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose reference has no parent."""
    return (child.filter(F.col(column).isNotNull())
            .join(parent.select(F.col(key).alias(column)), column, "left_anti"))


def exactly_one(*cols: str) -> Column:
    """True where exactly one of the columns is set."""
    present = [F.col(c).isNotNull().cast("int") for c in cols]
    return sum(present[1:], present[0]) == 1


def unexpected_values(table: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    return (table.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
            .groupBy(column).agg(F.count("*").alias("n")))
