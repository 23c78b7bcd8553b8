"""Fiscal year and sponsor score in exact integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fiscal_year(day: Column) -> Column:
    """US federal fiscal year: the year that starts in October counts as the next."""
    return F.year(day) + (F.month(day) >= 10).cast("int")


def score_milli(approvals: Column, denials: Column, latest_year: Column,
                now_year: Column) -> Column:
    """Score in thousandths.

    Volume weighs half and saturates at 50 approvals, the smoothed approval
    rate weighs 0.3 and is rounded half up, recency weighs 0.2.
    """
    a = F.coalesce(approvals, F.lit(0)).cast("bigint")
    n = F.greatest(a, F.lit(1)) + F.coalesce(denials, F.lit(0)).cast("bigint") + 5
    recent = F.coalesce(latest_year, F.lit(0)) >= now_year - 2
    rate = F.call_function("div", a * 600 + n, n * 2)
    scored = F.least(a, F.lit(50)) * 10 + F.when(recent, 200).otherwise(120) + rate
    return F.when(a <= 0, F.lit(50)).otherwise(scored).cast("bigint")


def score_value(milli: Column) -> Column:
    return (milli.cast("decimal(10,0)") / F.lit(1000)).cast("decimal(4,3)")


def score_status(milli: Column) -> Column:
    return F.when(milli >= 500, "verified").when(milli >= 200, "likely").otherwise("unlikely")
