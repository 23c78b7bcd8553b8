"""Payload readers over landing files of every provider shape."""

import json

import pytest
from pyspark.sql import functions as F

from vacantia.sources import payloads

AT = "2026-07-01T12:00:00Z"


def land(spark, path, *rows):
    """Landing files on disk, read back through the reader."""
    lines = [json.dumps({"ats": a, "token": t, "fetched_at": AT, "status": s,
                         "body": b if isinstance(b, str) else json.dumps(b)})
             for a, t, s, b in rows]
    (path / "part.json").write_text("\n".join(lines))
    return payloads.read_landing(spark, str(path))


def rows_of(landing):
    cols = ["source", "external_id", "title", "location", "url", "description",
            F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss.SSS").alias("posted")]
    return {r.external_id: r for r in payloads.all_postings(landing).select(*cols).collect()}


def test_greenhouse(spark, tmp_path):
    job = {"id": 101, "title": "SWE", "location": {"name": "NYC"}, "absolute_url": "https://g/101",
           "content": "&lt;p&gt;", "first_published": "2026-01-02T00:00:00-05:00",
           "updated_at": "2026-06-01T00:00:00-04:00", "company_name": "Duolingo"}
    rows = rows_of(land(spark, tmp_path, ("greenhouse", "duolingo", 200, {"jobs": [
        job, {**job, "id": 102, "location": None, "first_published": ""},
        {"id": 103, "title": "T", "absolute_url": "u", "first_published": None}]})))
    assert tuple(rows["101"]) == ("greenhouse", "101", "SWE", "NYC", "https://g/101", "&lt;p&gt;",
                                  "2026-01-02 05:00:00.000")
    assert rows["102"].location is None and rows["102"].posted == "2026-06-01 04:00:00.000"
    assert rows["103"].posted is None and rows["103"].description is None


def test_lever(spark, tmp_path):
    job = {"id": "x", "text": "SWE", "categories": {"location": "SF"}, "hostedUrl": "https://l/x",
           "descriptionPlain": "plain", "description": "<p>", "createdAt": 1767225600123}
    rows = rows_of(land(spark, tmp_path, ("lever", "palantir", 200, [
        job, {**job, "id": "y", "categories": None, "descriptionPlain": "", "createdAt": 0}])))
    assert tuple(rows["x"]) == ("lever", "x", "SWE", "SF", "https://l/x", "plain",
                                "2026-01-01 00:00:00.123")
    assert (rows["y"].location, rows["y"].description, rows["y"].posted) == (None, "<p>", None)


def test_ashby_hides_unlisted(spark, tmp_path):
    job = {"title": " SWE", "location": "Remote", "jobUrl": "https://a", "descriptionPlain": None,
           "descriptionHtml": "<p>", "publishedAt": "2026-01-02T03:04:05.678+00:00"}
    flags = {"yes": {"isListed": True}, "missing": {}, "no": {"isListed": False},
             "null": {"isListed": None}, "zero": {"isListed": 0}}
    rows = rows_of(land(spark, tmp_path, ("ashby", "ramp", 200, {
        "jobs": [{**job, "id": k, **v} for k, v in flags.items()]})))
    assert set(rows) == {"yes", "missing"}
    assert (rows["yes"].title, rows["yes"].description) == (" SWE", "<p>")
    assert rows["yes"].posted == "2026-01-02 03:04:05.678"


def test_smartrecruiters_pages(spark, tmp_path):
    item = {"name": "SWE", "company": {"name": "ServiceNow"}, "releasedDate": "2026-01-02T03:04:05.000Z",
            "location": {"fullLocation": "Austin, TX", "city": "Austin"}}
    landing = land(
        spark, tmp_path,
        ("smartrecruiters", "sn", 200, {"offset": 100, "totalFound": 2, "content": [
            {**item, "id": "2", "company": {"name": "Other"}, "location": {"fullLocation": "", "city": "Oslo"}}]}),
        ("smartrecruiters", "sn", 200, {"offset": 0, "totalFound": 2, "content": [{**item, "id": "1"}]}),
        ("smartrecruiters", "empty", 200, {"offset": 0, "totalFound": 0, "content": []}))
    rows = rows_of(landing)
    assert rows["1"].url == "https://jobs.smartrecruiters.com/sn/1"
    assert (rows["1"].location, rows["2"].location) == ("Austin, TX", "Oslo")
    assert rows["1"].source == "smartrec" and rows["1"].description is None
    boards = payloads.board_companies(payloads.typed(landing)).select("token", "name").collect()
    assert [tuple(r) for r in boards] == [("sn", "ServiceNow")]


def test_listings(spark, tmp_path):
    item = {"company_name": "Acme", "title": "SWE", "url": "https://r", "date_posted": 1767225600}
    rows = rows_of(land(spark, tmp_path, ("github_repos", "repo", 200, [
        {**item, "id": "a", "locations": ["NYC", "Remote"]},
        {**item, "id": "b", "locations": [], "date_posted": 0},
        {**item, "id": "c", "active": False}, {**item, "id": "d", "is_visible": False},
        {**item, "id": "e", "active": None}, {**item, "id": "f", "active": True, "is_visible": True}])))
    assert set(rows) == {"a", "b", "f"}
    assert (rows["a"].location, rows["a"].posted) == ("NYC, Remote", "2026-01-01 00:00:00.000")
    assert (rows["b"].location, rows["b"].posted, rows["f"].location) == (None, None, None)


def test_raw_is_kept_whole(spark, tmp_path):
    job = {"id": 1, "title": "T", "absolute_url": "u", "extra": {"deep": [1, {"x": None}]}}
    landing = land(spark, tmp_path, ("greenhouse", "b", 200, {"jobs": [job]}))
    payloads.all_postings(landing).write.parquet(str(tmp_path / "out"))
    raw = spark.read.parquet(str(tmp_path / "out")).select(F.to_json("raw").alias("r")).first().r
    assert json.loads(raw) == job


def test_outcomes_and_board_names(spark, tmp_path):
    rows = payloads.typed(land(
        spark, tmp_path,
        ("greenhouse", "ok", 200, {"jobs": [{"id": 1, "title": "T", "absolute_url": "u", "company_name": "Name"}]}),
        ("greenhouse", "empty", 200, {"jobs": []}), ("greenhouse", "bare", 200, {}),
        ("greenhouse", "gone", 404, ""), ("lever", "down", 503, "oops"), ("lever", "none", 200, []),
        ("ashby", "broken", 200, "{not json"), ("lever", "broken2", 200, "<html>"),
        ("smartrecruiters", "gone2", 404, ""), ("github_repos", "gone3", 404, "")))
    got = {r.token: r.outcome for r in payloads.board_status(rows).collect()}
    assert got == {"ok": "ok", "empty": "ok", "bare": "ok", "none": "ok", "gone": "missing",
                   "down": "failed", "broken": "failed", "broken2": "failed", "gone2": "failed",
                   "gone3": "failed"}
    names = {r.token: r.name for r in payloads.board_companies(rows).collect()}
    assert names == {"ok": "Name", "empty": "empty", "bare": "bare", "none": "none"}


@pytest.mark.parametrize("sections,want", [
    ([("jobDescription", "The job", "Do it"), ("about", "", "We are"), ("more", None, "Apply")],
     "The job\nDo it\n\nWe are\n\nApply"),
    ([("z", "Last name first", "one"), ("a", "Two", ""), ("b", "Three", None)], "Last name first\none"),
    ([], ""),
])
def test_section_text_in_document_order(spark, sections, want):
    body = json.dumps({"postingUrl": "https://exact", "jobAd": {"sections": {
        k: {"title": t, "text": x} for k, t, x in sections}}})
    df = spark.createDataFrame([("1", body)], "external_id string, body string")
    row = payloads.smartrecruiters_details(df).first()
    assert (row.description, row.url) == (want, "https://exact")
    none = spark.createDataFrame([("1", "{}")], "external_id string, body string")
    assert payloads.smartrecruiters_details(none).first().description == ""


def test_whole_rows_equal_rows_read_by_field(spark):
    from datetime import datetime

    from vacantia import schemas

    odd = [{"id": 7, "title": ["x"], "text": 3.5, "name": None, "location": "text", "company": 4, "categories": {"location": {"a": 1}},
            "descriptionPlain": "", "description": "d", "absolute_url": True, "locations": ["a", 1]},
           {"id": {"a": 1}, "title": "t", "location": {"name": 5, "city": "c", "fullLocation": ""}, "company": {"name": "n"},
            "locations": "here", "company_name": 9}, "no object", None, [], {}]
    rows = [(ats, "t", datetime(2026, 1, 1), 200, json.dumps(body)) for ats, body in [
        ("greenhouse", {"jobs": odd}), ("ashby", {"jobs": odd}), ("lever", odd), ("github_repos", odd),
        ("smartrecruiters", {"totalFound": 6, "offset": 0, "content": odd})]]
    landed = spark.createDataFrame(rows, schemas.LANDING)

    def got(whole):
        out = payloads.typed(landed, whole)
        return sorted((str(r) for r in out.withColumn("raw", F.to_json("raw")).collect()))
    assert got(True) == got(False) and len(got(True)) == 30
