"""Funnel, channel, speed and activity reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as fv
from vacantia.session import stash

BUCKETS = 4096  # key ranges counted at a time


def _share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage with half-up rounding on exact decimals."""
    exact = part.cast("decimal(20,0)") * 100 / F.greatest(whole, F.lit(1)).cast("decimal(20,0)")
    return F.round(exact, digits).cast(f"decimal(10,{digits})")


def funnel(applications: DataFrame) -> DataFrame:
    status = F.col("status")
    return applications.agg(
        F.count_if(status.isNotNull()).alias("applied"),
        F.count_if(status.isin(*fv.RESPONDED)).alias("responded"),
        F.count_if(status.isin(*fv.INTERVIEWING)).alias("interviewing"),
        F.count_if(status == "offer").alias("offers"))


def channel_performance(applications: DataFrame) -> DataFrame:
    positive = ~F.col("status").isin(*fv.NOT_POSITIVE)
    return (applications.groupBy("channel")
            .agg(F.count("*").alias("n"), F.count_if(positive).alias("p"))
            .select("channel", "n", _share(F.col("p"), F.col("n")).alias("positive_pct")))


def median(rows: DataFrame, column: str) -> float | None:
    """Exact median of a whole-number column; NULLs do not count.

    Values are counted by key range and only the range that holds the middle is
    looked at closer, until it is a single value. So no task sees more than its
    share of the distinct values, and ``BUCKETS`` counts a round come to the driver.
    """
    value = F.col(column).cast("bigint")
    counted = stash(rows.select(value.alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n")), "median")
    low, high, total = counted.agg(F.min("v"), F.max("v"), F.sum("n")).first()
    if not total:
        return None
    middle, before, width = (total - 1) // 2, 0, (high - low) // BUCKETS + 1
    while True:
        # in decimals, as the span of two longs may be none
        found = (counted.filter(F.col("v").between(low, high))
                 .groupBy(F.expr(f"(CAST(v AS DECIMAL(20,0)) - {low}BD) div {width}BD").alias("b")).agg(F.sum("n").alias("n")).collect())
        for b, n in sorted(tuple(r) for r in found):
            if before + n > middle:
                break
            before += n
        low = low + b * width
        if width == 1:
            break
        high, width = min(low + width - 1, high), (width - 1) // BUCKETS + 1
    if total % 2 or before + n > middle + 1:
        return float(low)
    return (low + counted.filter(F.col("v") > low).agg(F.min("v")).first()[0]) / 2


def apply_speed(applications: DataFrame) -> DataFrame:
    """Median minutes after posting."""
    found = median(applications, "minutes_after_posting")
    return applications.sparkSession.createDataFrame([(found,)], "median_minutes double")


def weekly_activity(applications: DataFrame, interactions: DataFrame) -> DataFrame:
    """Applications per week with the outbound interactions of the same week."""
    apps = (applications.groupBy(F.date_trunc("week", "applied_at").alias("week"))
            .agg(F.count("*").alias("applications")))
    out = (interactions.filter("direction = 'outbound'")
           .groupBy(F.date_trunc("week", "occurred_at").alias("week"))
           .agg(F.count("*").alias("n")))
    return (apps.join(out, "week", "left")
            .select("week", "applications", F.coalesce("n", F.lit(0)).alias("outreach")))


def apply_queue(jobs: DataFrame, companies: DataFrame, size: int = fv.APPLY_QUEUE_SIZE) -> DataFrame:
    """The top queued postings by fit times sponsor score."""
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"),
                         "sponsor_status", "sponsor_score")
    return (jobs.filter("status = 'queued'").join(c, "company_id")
            .withColumn("priority", F.col("fit_score") * F.col("sponsor_score"))
            .orderBy(F.col("priority").desc_nulls_last(), "id").limit(size)
            .select("id", "company", "title", "fit_score", "sponsor_status", "url", "priority"))


def due_follow_ups(follow_ups: DataFrame, as_of: Column) -> DataFrame:
    due = (~F.col("done")) & (F.col("due_at") < as_of + F.make_dt_interval(days=F.lit(1)))
    return follow_ups.filter(due).orderBy("due_at")


def response_by_channel(applications: DataFrame) -> DataFrame:
    responded = F.col("status").isin(*fv.RESPONDED)
    return (applications.groupBy("channel")
            .agg(F.count("*").alias("n"), F.count_if(responded).alias("responded"))
            .select("channel", "n", "responded",
                    _share(F.col("responded"), F.col("n")).alias("response_pct")))


def application_shares(applications: DataFrame, jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Share of applications to verified sponsors and share by referral."""
    status = (jobs.select(F.col("id").alias("job_id"), "company_id")
              .join(companies.select(F.col("id").alias("company_id"), "sponsor_status"),
                    "company_id", "left"))
    return (applications.select("job_id", "channel").join(status, "job_id", "left")
            .agg(F.count("*").alias("n"),
                 F.count_if(F.col("sponsor_status") == "verified").alias("v"),
                 F.count_if(F.col("channel") == "referral").alias("r"))
            .select(F.col("n").alias("applications"),
                    _share(F.col("v"), F.col("n")).alias("verified_pct"),
                    _share(F.col("r"), F.col("n")).alias("referral_pct")))


def reply_rate(interactions: DataFrame) -> DataFrame:
    """Inbound over outbound interactions."""
    return (interactions.agg(
        F.count_if(F.col("direction") == "inbound").alias("inbound"),
        F.count_if(F.col("direction") == "outbound").alias("outbound"))
        .select("inbound", "outbound",
                _share(F.col("inbound"), F.col("outbound")).alias("reply_pct")))


def stage_pass_rates(applications: DataFrame) -> DataFrame:
    """Pass rates from assessment to interview and from interview to offer."""
    status = F.col("status")
    return (applications.agg(
        F.count_if(status.isin(*fv.RESPONDED)).alias("assessed"),
        F.count_if(status.isin(*fv.INTERVIEWING)).alias("interviewed"),
        F.count_if(status == "offer").alias("offered"))
        .select("assessed", "interviewed", "offered",
                _share(F.col("interviewed"), F.col("assessed")).alias("interview_pct"),
                _share(F.col("offered"), F.col("interviewed")).alias("offer_pct")))
