"""Applications, follow-ups, inbound replies and spaced review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia import fixed_values as fv


def rules(spark) -> DataFrame:
    return spark.createDataFrame(list(fv.FOLLOW_UP_RULES), "event string, days int, action string")


def contact_events(contacts: DataFrame, interactions: DataFrame) -> DataFrame:
    """The latest interaction of each contact as a rule event.

    A contact without interactions is new. The latest outbound message counts
    as a bump when an earlier outbound message exists.
    """
    last = interactions.groupBy("contact_id").agg(
        F.max_by(F.struct("direction", "channel", "occurred_at"),
                 F.struct("occurred_at", "direction", "channel")).alias("l"),
        F.count_if(F.col("direction") == "outbound").alias("sent"))
    event = (F.when(F.col("l").isNull(), "new_contact")
             .when(F.col("l.channel").isin("phone", "irl"), "call")
             .when((F.col("l.direction") == "outbound") & (F.col("sent") > 1), "bump_no_reply")
             .when(F.col("l.direction") == "outbound", "outbound_no_reply"))
    return (contacts.select(F.col("id").alias("contact_id"), "created_at")
            .join(last, "contact_id", "left")
            .select("contact_id", event.alias("event"),
                    F.coalesce("l.occurred_at", "created_at").alias("occurred_at"))
            .filter("event IS NOT NULL"))


def application_events(applications: DataFrame, interviews: DataFrame, jobs: DataFrame,
                       contacts: DataFrame) -> DataFrame:
    """Rule events of the contacts at the company that was applied to.

    Application -> job -> company -> contacts. The rules take the first event of a
    kind, so each company keeps one row per kind before it meets its contacts, and a
    company with many applications and many contacts does not multiply them. Thanks
    for an interview go to contacts with a known address.
    """
    of_company = applications.join(jobs.select(F.col("id").alias("job_id"), "company_id"), "job_id")
    asked = of_company.filter("status = 'submitted'").select(
        "company_id", F.lit("application_with_contact").alias("event"),
        F.col("applied_at").alias("occurred_at"))
    closed = of_company.filter(F.col("status").isin("offer", "rejected")).select(
        "company_id", F.lit("outcome").alias("event"),
        F.col("status_updated_at").alias("occurred_at"))
    met = (interviews.filter("outcome IS NOT NULL AND outcome <> 'pending'")
           .join(of_company.select(F.col("id").alias("application_id"), "company_id"), "application_id")
           .select("company_id", F.lit("interview_completed").alias("event"),
                   F.col("scheduled_at").alias("occurred_at")))
    first = (asked.unionByName(closed).unionByName(met).groupBy("company_id", "event")
             .agg(F.min("occurred_at").alias("occurred_at")))
    known = contacts.select(F.col("id").alias("contact_id"), "company_id", "email")
    return (known.join(first, "company_id")
            .filter((F.col("event") != "interview_completed") | F.col("email").isNotNull())
            .select("contact_id", "event", "occurred_at"))


def next_actions(events: DataFrame, follow_ups: DataFrame) -> DataFrame:
    """Follow-ups to insert: one per contact and action, unless one is pending."""
    table = F.broadcast(rules(events.sparkSession))  # seven rows
    wanted = (events.join(table, "event")
              .groupBy("contact_id", "action")
              .agg(F.min(F.col("occurred_at") + F.make_dt_interval(days=F.col("days")))
                   .alias("due_at")))
    pending = follow_ups.filter("NOT done").select("contact_id", "action")
    return wanted.join(pending, ["contact_id", "action"], "left_anti")


def inbound_replies(mail: DataFrame, contacts: DataFrame) -> DataFrame:
    """Mail from known senders as inbound interactions."""
    known = contacts.filter("email IS NOT NULL").select(
        F.col("id").alias("contact_id"), F.lower("email").alias("sender"))
    return (mail.withColumn("sender", F.lower("sender")).join(known, "sender")
            .select("contact_id", F.lit("email").alias("channel"),
                    F.lit("inbound").alias("direction"), "summary", "occurred_at"))


def close_answered(follow_ups: DataFrame, replies: DataFrame) -> DataFrame:
    """Mark follow-ups done that were pending when the contact replied."""
    last = replies.groupBy("contact_id").agg(F.max("occurred_at").alias("replied_at"))
    answered = F.coalesce(F.col("created_at") <= F.col("replied_at"), F.lit(False))
    return (follow_ups.join(last, "contact_id", "left")
            .withColumn("done", F.col("done") | answered).select(*follow_ups.columns))


def previous_value(df: DataFrame, key: str, at: str, bucket: Column, tie: str) -> DataFrame:
    """``lag(at)`` per key, safe for a key that holds most of the rows.

    The window runs per key and time bucket; the first row of a bucket takes
    the last value of the nearest earlier bucket, from one row per bucket.
    """
    inside = Window.partitionBy(key, "bucket").orderBy(at, tie)
    rows = df.withColumn("bucket", bucket)
    lagged = rows.withColumn("previous", F.lag(at).over(inside))
    ends = rows.groupBy(key, "bucket").agg(F.max(at).alias("last"))
    before = ends.select(F.col(key).alias("end_key"), F.col("bucket").alias("end_bucket"),
                         F.lag("last").over(Window.partitionBy(key).orderBy("bucket"))
                         .alias("carried"))
    same = F.col(key).eqNullSafe(F.col("end_key")) & F.col("bucket").eqNullSafe(F.col("end_bucket"))
    return (lagged.join(before, same, "left")
            .withColumn("previous", F.coalesce("previous", "carried"))
            .select(*df.columns, "previous"))


def next_reviews(prep_log: DataFrame) -> DataFrame:
    """Next review per attempt: solved stretches the last interval by 2.5, hints
    come back after three days, failures after one. A first solve counts as a
    one-day interval."""
    rows = previous_value(prep_log, "ref", "done_at", F.date_trunc("day", F.col("done_at")), "id")
    done = F.unix_micros(F.col("done_at").cast("timestamp"))
    day = 86_400_000_000
    gap = F.coalesce(done - F.unix_micros(F.col("previous").cast("timestamp")), F.lit(day))
    wait = (F.when(F.col("result") == "solved", F.call_function("div", gap * 5, F.lit(2)))
            .when(F.col("result") == "solved_with_hints", F.lit(3 * day))
            .otherwise(F.lit(day)))
    return rows.select("id", "ref", "result", "done_at", "previous",
                       F.timestamp_micros(done + wait).alias("next_review_at"))


def log_applications(submitted: DataFrame, jobs: DataFrame, applications: DataFrame) -> DataFrame:
    """Application rows to insert, once per job: ``submitted(job_id, applied_at)``."""
    first = submitted.groupBy("job_id").agg(F.min("applied_at").alias("applied_at"))
    minutes = F.call_function(
        "div", F.unix_micros(F.col("applied_at").cast("timestamp"))
        - F.unix_micros(F.col("posted_at").cast("timestamp")), F.lit(60_000_000))
    return (first.join(applications.select("job_id"), "job_id", "left_anti")
            .join(jobs.select(F.col("id").alias("job_id"), "posted_at"), "job_id")
            .select("job_id", F.lit("ats_direct").alias("channel"), "applied_at",
                    minutes.cast("int").alias("minutes_after_posting"),
                    F.lit("submitted").alias("status"),
                    (F.col("applied_at") + F.make_dt_interval(
                        days=F.lit(fv.APPLIED_FOLLOW_UP_DAYS))).alias("follow_up_at"),
                    F.lit(fv.APPLIED_FOLLOW_UP_ACTION).alias("follow_up_action")))


def mark_applied(jobs: DataFrame, submitted: DataFrame) -> DataFrame:
    ids = submitted.select(F.col("job_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    return (jobs.join(ids, "id", "left")
            .withColumn("status", F.when(F.col("hit"), "applied").otherwise(F.col("status")))
            .select(*jobs.columns))
