"""Retention of postings and run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as fv
from vacantia.operators.runlog import run_row


def _days_before(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(days=F.lit(days))


def is_stale(as_of: Column, days: int = fv.RETENTION_DAYS,
             new_grad_days: int = fv.NEW_GRAD_RETENTION_DAYS) -> Column:
    """Past retention by age; never NULL, so an undated row is not stale."""
    seen = F.col("first_seen_at")
    spared = F.col("is_new_grad").eqNullSafe(True)
    old = (seen < _days_before(as_of, days)) & (
        ~spared | (seen < _days_before(as_of, new_grad_days)))
    return F.coalesce(old, F.lit(False))


def references(*tables: DataFrame) -> DataFrame:
    """Distinct job ids that applications or resume versions point to."""
    ids = tables[0].select("job_id")
    for t in tables[1:]:
        ids = ids.union(t.select("job_id"))
    return ids.filter("job_id IS NOT NULL").distinct()


def doomed_jobs(jobs: DataFrame, applications: DataFrame, resumes: DataFrame,
                as_of: Column) -> DataFrame:
    """Stale postings that nothing refers to."""
    return (jobs.filter(is_stale(as_of))
            .join(applications.select(F.col("job_id").alias("id")), "id", "left_anti")
            .join(resumes.select(F.col("job_id").alias("id")), "id", "left_anti"))


def retained_jobs(jobs: DataFrame, applications: DataFrame, resumes: DataFrame,
                  as_of: Column) -> DataFrame:
    """The postings table after retention.

    Current rows pass without a shuffle; only stale ones meet the reference
    tables, as a semi join.
    """
    stale = is_stale(as_of)
    kept_by = references(applications, resumes).withColumnRenamed("job_id", "id")
    rescued = jobs.filter(stale).join(kept_by, "id", "left_semi").select(*jobs.columns)
    return jobs.filter(~stale).unionByName(rescued)


def retained_run_log(run_log: DataFrame, as_of: Column,
                     days: int = fv.RETENTION_DAYS) -> DataFrame:
    return run_log.filter(~F.coalesce(F.col("ran_at") < _days_before(as_of, days), F.lit(False)))


def retention_counts(jobs: DataFrame, applications: DataFrame, resumes: DataFrame,
                     run_log: DataFrame, as_of: Column) -> DataFrame:
    """Rows pruned per table and the run-log text, in one row."""
    gone = doomed_jobs(jobs, applications, resumes, as_of).agg(F.count("*").alias("jobs_pruned"))
    old = F.coalesce(F.col("ran_at") < _days_before(as_of, fv.RETENTION_DAYS), F.lit(False))
    log = run_log.agg(F.count_if(old).alias("run_log_pruned"))
    both = gone.withColumn("k", F.lit(1)).join(log.withColumn("k", F.lit(1)), "k").drop("k")
    return both.withColumn("detail", F.concat(
        F.col("jobs_pruned"), F.lit(" jobs, "), F.col("run_log_pruned"),
        F.lit(" heartbeats pruned")))


def run_log(jobs: DataFrame, applications: DataFrame, resumes: DataFrame, log: DataFrame,
            as_of: Column) -> DataFrame:
    """The run-log row of a retention run."""
    counts = retention_counts(jobs, applications, resumes, log, as_of)
    return run_row(counts, "retention", F.lit(True), as_of, F.col("detail"))
