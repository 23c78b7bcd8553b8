"""Run log rows, per-run counts and source freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as fv


def poll_summary(status: DataFrame, new_jobs: DataFrame, seconds: Column | None = None,
                 ran_at: Column | None = None, watchlist: DataFrame | None = None) -> DataFrame:
    """One run-log row per provider: boards ok of all, new rows, seconds.

    ``status(ats, token, outcome)`` has one row per response, ``new_jobs(ats)``
    one per inserted posting. A board fails if any of its pages does, or, with a
    ``watchlist(ats, token)``, if it never answered. A run is ok when no board failed.
    """
    per_board = status.groupBy("ats", "token").agg(F.max(F.col("outcome") == "failed").alias("failed"))
    if watchlist is not None:
        per_board = (watchlist.select("ats", "token").distinct().join(per_board, ["ats", "token"], "full")
                     .withColumn("failed", F.coalesce("failed", F.lit(True))))
    boards = per_board.groupBy("ats").agg(
        F.count("*").alias("boards"), F.count_if("failed").alias("failed"))
    added = new_jobs.groupBy("ats").agg(F.count("*").alias("added"))
    counted = boards.join(added, "ats", "left").select(
        F.col("ats").alias("source"), (F.col("failed") == 0).alias("ok"),
        (F.col("boards") - F.col("failed")).alias("boards_ok"), "boards",
        F.coalesce("added", F.lit(0)).alias("new_rows"))
    detail = F.concat(F.col("boards_ok"), F.lit("/"), F.col("boards"),
                      F.when(F.col("source") == "github_repos", " repos, ").otherwise(" boards, "),
                      F.col("new_rows"), F.lit(" new"))
    if seconds is not None:
        detail = F.concat(detail, F.lit(", "), F.round(seconds, 0).cast("bigint"), F.lit("s"))
    out = counted.withColumn("detail", detail)
    return out if ran_at is None else out.withColumn("ran_at", ran_at)


def run_row(counts: DataFrame, source: str, ok: Column, ran_at: Column, detail: Column) -> DataFrame:
    """A run-log row from a one-row table of counts."""
    return counts.select(F.lit(source).alias("source"), ok.alias("ok"),
                         ran_at.alias("ran_at"), detail.alias("detail"))


def append_run_log(rows: DataFrame, path: str) -> None:
    rows.select("source", "ok", "ran_at", "detail").write.mode("append").parquet(path)


def freshness(run_log: DataFrame, as_of: Column, minutes: int = fv.FRESH_MINUTES) -> DataFrame:
    """Latest successful run per source; red after ``minutes`` of silence."""
    last = run_log.groupBy("source").agg(F.max(F.when(F.col("ok"), F.col("ran_at"))).alias("last_ok"))
    limit = as_of - F.make_dt_interval(mins=F.lit(minutes))
    return last.select("source", "last_ok",
                       F.coalesce(F.col("last_ok") < limit, F.lit(True)).alias("red"))
