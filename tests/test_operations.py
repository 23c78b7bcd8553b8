"""Retention, alerts, health, run log, follow-ups, triage and checks."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vacantia.operators import alerts, checks, followups, health, metrics, retention, runlog, triage
from vacantia.session import scratch_dir, stash
from vacantia.sources import watchlist

NOW = datetime(2026, 7, 1)


def now():
    return F.lit("2026-07-01 00:00:00").cast("timestamp")


def ago(**by):
    return NOW - timedelta(**by)


def test_retention_of_postings(spark):
    rows = [("fresh", ago(days=29), False), ("edge", ago(days=30), False), ("old", ago(days=31), False),
            ("null flag", ago(days=31), None), ("grad", ago(days=31), True), ("grad edge", ago(days=90), True),
            ("old grad", ago(days=91), True), ("undated", None, False), ("applied", ago(days=400), False),
            ("resume", ago(days=400), True)]
    jobs = spark.createDataFrame(rows, "id string, first_seen_at timestamp, is_new_grad boolean")
    applications = spark.createDataFrame([("applied",), ("applied",), (None,)], "job_id string")
    resumes = spark.createDataFrame([("resume",)], "job_id string")
    gone = {r.id for r in retention.doomed_jobs(jobs, applications, resumes, now()).collect()}
    kept = [r.id for r in retention.retained_jobs(jobs, applications, resumes, now()).collect()]
    assert gone == {"old", "null flag", "old grad"}
    assert sorted(kept) == sorted({r[0] for r in rows} - gone)
    log = spark.createDataFrame([("a", ago(days=31)), ("b", ago(days=30)), ("c", None)],
                                "source string, ran_at timestamp")
    assert {r.source for r in retention.retained_run_log(log, now()).collect()} == {"b", "c"}
    counts = retention.retention_counts(jobs, applications, resumes, log, now()).first()
    assert tuple(counts) == (3, 1, "3 jobs, 1 heartbeats pruned")


JOBS = ("id string, source string, run_id string, company_id string, title string, location string, "
        "url string, is_new_grad boolean, first_seen_at timestamp")
COMPANIES = "id string, name string, sponsor_status string, sponsor_score decimal(4,3)"


def test_alert_cap_counts_qualifying_rows_only(spark):
    rows = [(f"{i:03}", "lever", "r", "c" if i % 10 else "missing", "SWE", None, "u", i % 2 == 0, NOW)
            for i in range(100)]
    companies = spark.createDataFrame([("c", "Acme", "verified", None)], COMPANIES)
    jobs = spark.createDataFrame(rows, JOBS)
    got = [r.id for r in alerts.select_alerts(jobs, companies).orderBy("alert_no").collect()]
    want = [f"{i:03}" for i in range(100) if i % 2 == 0 and i % 10][:15]
    assert got == want
    sent = spark.createDataFrame([(want[0],)], "job_id string")
    assert want[0] not in {r.id for r in alerts.select_alerts(jobs, companies, notified=sent).collect()}
    few = alerts.select_alerts(jobs, companies, only_where=F.col("id") < "010").collect()
    assert {r.id for r in few} == {"002", "004", "006", "008"}


def test_board_health(spark):
    watch = spark.createDataFrame(
        [("greenhouse", t) for t in ("ok", "empty", "gone", "down", "silent")]
        + [("lever", "l"), ("smartrecruiters", "wrong"), ("smartrecruiters", "right")],
        "ats string, token string")
    rows = [("greenhouse", "ok", NOW, 200, '{"jobs":[{},{}]}'), ("greenhouse", "empty", NOW, 200, "{}"),
            ("greenhouse", "ok", ago(days=1), 404, ""), ("greenhouse", "gone", NOW, 404, ""),
            ("greenhouse", "down", NOW, 503, ""), ("lever", "l", NOW, 200, "[1,2,3]"),
            ("smartrecruiters", "wrong", NOW, 200, '{"totalFound":0,"content":[]}'),
            ("smartrecruiters", "right", NOW, 200, '{"totalFound":250,"content":[{}]}')]
    landing = spark.createDataFrame(rows, "ats string, token string, fetched_at timestamp, status int, body string")
    got = {r.token: (r.alive, r.detail) for r in health.board_health(watch, landing).collect()}
    assert got == {"ok": (True, "2 postings"), "empty": (True, "0 postings"), "gone": (False, "404"),
                   "down": (False, "HTTP 503"), "silent": (False, "no response"), "l": (True, "3 postings"),
                   "wrong": (False, "0 postings (token likely wrong — SR never 404s)"),
                   "right": (True, "250 postings")}
    dead = {r.ats: (r.boards, r.dead) for r in health.dead_boards(health.board_health(watch, landing)).collect()}
    assert dead == {"greenhouse": (5, 3), "lever": (1, 0), "smartrecruiters": (2, 1)}


def test_shards_split_the_watchlist(spark):
    boards = spark.createDataFrame([("lever", f"Board{i}") for i in range(40)], "ats string, token string")
    parts = [{r.token for r in watchlist.shard(boards, i, 3).collect()} for i in range(3)]
    assert sum(map(len, parts)) == 40 and len(set.union(*parts)) == 40


def test_run_summary_and_freshness(spark):
    status = spark.createDataFrame([("lever", "x", "ok"), ("lever", "y", "ok"), ("lever", "y", "failed"),
                                    ("ashby", "x", "missing"), ("ashby", "y", "ok")],
                                   "ats string, token string, outcome string")
    new = spark.createDataFrame([("lever",), ("lever",)], "ats string")
    rows = {r.source: (r.ok, r.detail) for r in
            runlog.poll_summary(status, new, seconds=F.lit(3.6), ran_at=now()).collect()}
    assert rows == {"lever": (False, "1/2 boards, 2 new, 4s"), "ashby": (True, "2/2 boards, 0 new, 4s")}
    watch = spark.createDataFrame([("lever", "x"), ("lever", "silent")], "ats string, token string")
    watched = {r.source: (r.boards_ok, r.boards) for r in runlog.poll_summary(status, new, watchlist=watch).collect()}
    assert watched == {"lever": (1, 3), "ashby": (2, 2)}
    log = spark.createDataFrame([("a", True, ago(minutes=60)), ("b", True, ago(minutes=61)),
                                 ("b", False, NOW), ("c", False, NOW)],
                                "source string, ok boolean, ran_at timestamp")
    red = {r.source: r.red for r in runlog.freshness(log, now()).collect()}
    assert red == {"a": False, "b": True, "c": True}


def test_run_log_append(spark, tmp_path):
    path = str(tmp_path / "log")
    row = runlog.run_row(spark.range(1), "dedup", F.lit(True), now(), F.lit("x"))
    runlog.append_run_log(row, path)
    runlog.append_run_log(row, path)
    assert spark.read.parquet(path).count() == 2


def test_next_actions(spark):
    contacts = spark.createDataFrame([(c, NOW) for c in ("new", "one", "two", "call", "in")],
                                     "id string, created_at timestamp")
    interactions = spark.createDataFrame([
        ("one", "outbound", "email", ago(days=1)), ("two", "outbound", "email", ago(days=9)),
        ("two", "outbound", "email", ago(days=2)), ("call", "inbound", "phone", ago(days=3)),
        ("in", "inbound", "email", ago(days=3))],
        "contact_id string, direction string, channel string, occurred_at timestamp")
    events = followups.contact_events(contacts, interactions)
    open_ = spark.createDataFrame([("one", "polite bump #1", False), ("two", "final bump, then park", True)],
                                  "contact_id string, action string, done boolean")
    got = {(r.contact_id, r.action, r.due_at) for r in followups.next_actions(events, open_).collect()}
    assert got == {("new", "send intro message (draft ready)", NOW),
                   ("two", "final bump, then park", NOW + timedelta(days=8)),
                   ("call", "thank-you note", ago(days=2))}


def test_reviews_over_buckets_and_a_hot_key(spark):
    times = [ago(days=d, hours=h) for d in (40, 12, 12, 3) for h in (1, 0)]
    rows = [(i, "hot", r, t) for i, (t, r) in enumerate(zip(times, ["solved"] * 6 + ["failed", "solved_with_hints"]))]
    df = spark.createDataFrame(rows, "id int, ref string, result string, done_at timestamp")
    got = [(r.done_at, r.previous, r.next_review_at) for r in followups.next_reviews(df).orderBy("done_at", "id").collect()]
    ordered = sorted((r[3], r[0], r[2]) for r in rows)
    want, before = [], None
    for at, _, result in ordered:
        gap = at - before if before else timedelta(days=1)
        wait = {"solved": gap * 2.5, "solved_with_hints": timedelta(days=3), "failed": timedelta(days=1)}[result]
        want.append((at, before, at + wait))
        before = at
    assert got == want
    undated = spark.createDataFrame([(1, "a", "solved", None), (2, None, "failed", NOW)],
                                    "id int, ref string, result string, done_at timestamp")
    assert {r.id: r.next_review_at for r in followups.next_reviews(undated).collect()} == {
        1: None, 2: NOW + timedelta(days=1)}


def test_close_answered(spark):
    pending = spark.createDataFrame([("1", "a", ago(days=5), False), ("2", "a", NOW, False), ("3", "b", ago(days=5), False)],
                                    "id string, contact_id string, created_at timestamp, done boolean")
    mail = spark.createDataFrame([("Jane@X.com", "hi", ago(days=2)), ("who@x.com", "spam", NOW)],
                                 "sender string, summary string, occurred_at timestamp")
    contacts = spark.createDataFrame([("a", "jane@x.com"), ("b", None)], "id string, email string")
    replies = followups.inbound_replies(mail, contacts)
    assert {r.id: r.done for r in followups.close_answered(pending, replies).collect()} == {"1": True, "2": False, "3": False}


@pytest.mark.parametrize("text,want", [
    ("We are unable to sponsor visas", "jd_says_no_sponsor"), ("Visa sponsorship is available", "jd_says_yes"),
    ("No sponsorship", "jd_says_no_sponsor"), ("", "jd_silent"), (None, "jd_silent")])
def test_visa_flag(spark, text, want):
    assert spark.range(1).select(triage.visa_flag(F.lit(text).cast("string")).alias("x")).first().x == want


def test_mail_class(spark):
    def label(s):
        return spark.range(1).select(triage.mail_class(F.lit(s)).alias("x")).first().x
    assert [label(s) for s in ("Unfortunately, no interview", "Online assessment", "Pleased to offer",
                               "Schedule a call", "Newsletter")] == ["rejection", "oa", "offer", "interview", "other"]


def test_job_links(spark):
    html = ('<a class="x" href="https://l.com/jobs/view/1?trk=mail&amp;x=1"><b>SWE</b> I</a>'
            "<A HREF='https://a.myworkdayjobs.com/2'>Two</A><a href=https://l.com/job/3&amp;trk=m1>R&amp;D</a><a href=\"/about\">no</a><a name='job'>no</a>")
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    got = [(r.url, r.title) for r in triage.job_links(df).collect()]
    assert got == [("https://l.com/jobs/view/1", "SWE I"), ("https://a.myworkdayjobs.com/2", "Two"),
                   ("https://l.com/job/3", "R&D")]


def test_tokens_and_keywords(spark):
    bad = spark.range(1).select(triage.unsupported_tokens(
        F.lit("Built 3 services in Python"), F.lit("Built 40 services in Rust and Python")).alias("x")).first().x
    assert bad == ["40", "Rust"]
    row = triage.keyword_coverage(spark.createDataFrame([("We use PostgreSQL",)], "t string"), "t",
                                  F.array(F.lit("postgres"), F.lit("Rust"))).first()
    assert (row.hits, row.missing) == (1, ["Rust"])


def test_percentages_of_nothing(spark):
    none = spark.createDataFrame([], "channel string, status string, direction string, minutes_after_posting int")
    assert metrics.reply_rate(none).first().reply_pct == 0
    assert metrics.apply_speed(none).first().median_minutes is None
    assert metrics.funnel(none).first().applied == 0


def test_checks(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", None), ("a", None)], "source string, external_id string")
    assert [tuple(r) for r in checks.duplicate_keys(df, "source", "external_id").collect()] == [("a", "1", 2)]
    parent = spark.createDataFrame([("1",)], "id string")
    child = spark.createDataFrame([("1",), ("2",), (None,)], "ref string")
    assert [r.ref for r in checks.orphans(child, "ref", parent, "id").collect()] == ["2"]


def test_scratch_folder_comes_from_the_session(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    table = stash(spark.range(5), "probe")
    assert table.count() == 5 and table.inputFiles()[0].startswith(f"file://{scratch_dir(spark)}/vacantia/probe-")


def test_follow_ups_reach_the_contacts_of_the_company(spark):
    applications = spark.createDataFrame([("a1", "j1", "submitted", "2026-01-02", "2026-01-03"), ("a2", "j2", "rejected", "2026-01-01", "2026-01-05"),
                                          ("a3", "j1", "submitted", "2026-01-01", "2026-01-09"), ("a4", None, "submitted", "2026-01-01", "2026-01-09"),
                                          ("a5", "j3", "offer", "2026-01-01", "2026-01-09")],
                                         "id string, job_id string, status string, applied_at string, status_updated_at string")
    interviews = spark.createDataFrame([("a1", "2026-02-01", "pass"), ("a1", "2026-01-20", "pass"), ("a2", "2026-01-10", "pending"), ("a2", "2026-01-11", None)],
                                       "application_id string, scheduled_at string, outcome string")
    jobs = spark.createDataFrame([("j1", "c1"), ("j2", "c2"), ("j3", None)], "id string, company_id string")
    contacts = spark.createDataFrame([("p1", "c1", "p1@x.com"), ("p2", "c1", None), ("p3", "c2", None), ("p4", None, "p4@x.com"), ("p5", "c9", None)],
                                     "id string, company_id string, email string")
    got = {tuple(r) for r in followups.application_events(applications, interviews, jobs, contacts).collect()}
    assert got == {("p1", "application_with_contact", "2026-01-01"), ("p2", "application_with_contact", "2026-01-01"),
                   ("p1", "interview_completed", "2026-01-20"), ("p3", "outcome", "2026-01-05")}


@pytest.mark.parametrize("values", [[5], [1, 2], [7] * 9 + [None], [3, 3, 4, 4], [-(1 << 63), (1 << 63) - 1, 0], list(range(0, 10**15, 10**12)),
                                    [2, 2, 2, 9, 9, 9], [], [None]])
def test_median_by_refined_ranges(spark, values):
    known = sorted(v for v in values if v is not None)
    want = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2 if known else None
    assert metrics.median(spark.createDataFrame([(v,) for v in values], "v long"), "v") == want
