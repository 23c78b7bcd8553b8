"""A body is parsed once and the fields of an element are read once, whatever is asked of them."""

import json

import pytest
from pyspark.sql import functions as F

from vacantia.sources import payloads


def landed(spark, *rows):
    return spark.createDataFrame([(a, t, f"2026-07-01T12:{m:02d}:00Z", s, b if isinstance(b, str) else json.dumps(b)) for a, t, m, s, b in rows],
                                 "ats string, token string, fetched_at string, status int, body string").withColumn(
                                     "fetched_at", F.col("fetched_at").cast("timestamp"))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def landing(spark, tmp_path):
    landed(spark, ("greenhouse", "b", 0, 200, {"jobs": [{"id": 1}]})).write.parquet(str(tmp_path / "landing"))
    return spark.read.parquet(str(tmp_path / "landing"))


def test_fields_are_read_once(landing):
    # five reads by provider, and one of the value of each of the three flags
    counts = payloads.all_postings(landing).groupBy("source").agg(F.count("posted_at"))
    assert plan(counts).count("try_variant_get(") == 8


def test_only_answers_are_read(landing):
    text = plan(payloads.all_postings(landing).select("source", "posted_at"))
    assert "Filter" in text.split("Generate")[1].split("from_json")[-1]


def test_boards_parse_a_body_once(landing):
    # by shape: an object with jobs, a page, an array
    assert plan(payloads.board_companies(payloads.typed(landing))).count("from_json(") == 3


def test_unreadable_page_does_not_join_two_runs(spark):
    def page(minute, name, body=None):
        return ("smartrecruiters", "sn", minute, 200, body or {"offset": minute, "totalFound": 1, "content": [
            {"id": name, "company": {"name": name}}]})
    rows = payloads.typed(landed(spark, page(0, "First"), page(4, "", "<html>"), page(8, "Second")))
    names = {r.fetched_at.minute: r.name for r in payloads.board_companies(rows).collect()}
    assert names == {0: "First", 8: "Second"}
    rows = payloads.typed(landed(spark, page(0, "First"), page(4, "", {"content": []}), page(8, "Second")))
    assert {r.name for r in payloads.board_companies(rows).collect()} == {"First"}


def test_flags_and_times_of_odd_kinds(spark):
    flags = [True, "true", 1, "x", [0], {"a": 1}, False, "False", 0, "0", "", None]
    jobs = [{"id": str(i), "isListed": f} for i, f in enumerate(flags)] + [{"id": "none"}]
    kept = payloads.all_postings(landed(spark, ("ashby", "a", 0, 200, {"jobs": jobs}))).collect()
    assert {r.external_id for r in kept} == {"0", "1", "2", "3", "4", "5", "none"}
    times = {"no": "soon", "yes": "1767225600000", "list": [1], "zero": 0}
    rows = payloads.all_postings(landed(spark, *[("lever", k, 0, 200, [{"id": k, "createdAt": v}]) for k, v in times.items()]))
    assert {r.token: r.posted_at is not None for r in rows.collect()} == {"no": False, "yes": True, "list": False, "zero": False}
