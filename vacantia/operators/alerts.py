"""Alert selection and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia import fixed_values as fv
from vacantia.functions.text import alert_text


def with_company(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Postings with company attributes; a posting without a company drops out."""
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"),
                         "sponsor_status", "sponsor_score")
    return jobs.join(c, "company_id")


def select_alerts(new_jobs: DataFrame, companies: DataFrame, cap: int = fv.ALERT_CAP,
                  run: tuple[str, ...] = ("source", "run_id"),
                  insert_order: tuple[str, ...] = ("first_seen_at", "id"),
                  notified: DataFrame | None = None,
                  only_where: Column | None = None) -> DataFrame:
    """Alerts of a run: new-grad postings only, in insert order, capped per run.

    The filter comes first, so other postings do not use up the cap. The cap
    is a per-task limit before the shuffle. ``notified(job_id)`` holds alerts
    already sent; ``only_where`` is an optional further condition.
    """
    chosen = new_jobs.filter("is_new_grad")
    if only_where is not None:
        chosen = chosen.filter(only_where)
    if notified is not None:
        chosen = chosen.join(notified.select(F.col("job_id").alias("id")), "id", "left_anti")
    order = Window.partitionBy(*run).orderBy(*insert_order)
    return (with_company(chosen, companies)
            .withColumn("alert_no", F.row_number().over(order))
            .filter(F.col("alert_no") <= cap)
            .withColumn("content", alert_text(F.col("sponsor_status"), F.col("company"),
                                              F.col("title"), F.col("location"), F.col("url"))))
