"""Insert-if-absent, company upsert, details, streams and the poll cycle."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vacantia.operators import load
from tests.conftest import SMALL
from vacantia.plans import cycle
from vacantia.plans import ingest as plans
from vacantia.plans.registry import Tables
from vacantia.sources import payloads
from vacantia import schemas
from vacantia.streaming import ingest

ROWS = "source string, external_id string, n int, title string"


def test_first_writer_wins(spark):
    stored = spark.createDataFrame([("lever", "1", 0, "old")], ROWS)
    new = spark.createDataFrame([
        ("lever", "1", 1, "ignored"), ("lever", "2", 3, "second"), ("lever", "2", 2, "first"),
        ("ashby", "1", 4, "other source"), ("lever", None, 5, "loose"), ("lever", None, 5, "loose")], ROWS)
    got = sorted(tuple(r) for r in load.insert_if_absent(new, stored, ["n", "title"])
                 .select(F.coalesce("external_id", F.lit("-")), "title").collect())
    assert got == [("-", "loose"), ("-", "loose"), ("1", "other source"), ("2", "first")]


def test_second_load_adds_nothing(spark):
    new = spark.createDataFrame([("lever", str(i % 7), i, "t") for i in range(50)], ROWS)
    once = load.insert_if_absent(new, new.limit(0), ["n"])
    assert once.count() == 7
    assert load.insert_if_absent(new, once, ["n"]).count() == 0


COMPANIES = ("id string, name string, name_normalized string, ats_type string, ats_token string, "
             "sponsor_status string")


def test_upsert_company(spark):
    stored = spark.createDataFrame(
        [("id1", "Stripe, Inc.", "stripe", "greenhouse", "stripe", "verified")], COMPANIES)
    incoming = spark.createDataFrame([
        ("Stripe", None, None, 1), ("STRIPE LLC", "", "", 2),         # no board: keeps the token
        ("Figma", None, None, 3), ("Figma, Inc.", "ashby", "figma", 4), ("figma", "", None, 5),
        ("Ramp", "lever", "ramp1", 6), ("Ramp", "ashby", "ramp2", 7),
        ("Blank", "", "", 8)], "name string, ats_type string, ats_token string, seq long")
    got = {r.name_normalized: r for r in load.upsert_companies(stored, incoming).collect()}
    assert tuple(got["stripe"]) == ("id1", "Stripe, Inc.", "stripe", "greenhouse", "stripe", "verified")
    assert got["figma"][1:] == ("Figma", "figma", "ashby", "figma", "unknown")
    assert got["ramp"][3:5] == ("ashby", "ramp2")
    assert got["blank"][3:5] == ("", "")
    assert len(got) == 4 and len({r.id for r in got.values()}) == 4
    again = load.upsert_companies(spark.createDataFrame(list(got.values()), COMPANIES), incoming)
    assert {r.name_normalized: tuple(r) for r in again.collect()} == {k: tuple(v) for k, v in got.items()}


def test_ids_tell_keyless_rows_apart(spark):
    df = spark.createDataFrame([("s", "1", "u"), ("s", None, "u"), ("s", None, "v"), ("t", "1", "u")],
                               "source string, external_id string, url string")
    ids = [r.x for r in df.select(load.job_id(F.col("source"), F.col("external_id"), F.col("url")).alias("x")).collect()]
    assert len(set(ids)) == 4


def test_details_follow_each_provider(spark):
    jobs = spark.createDataFrame([
        ("greenhouse", "1", "SWE", "old", "u", False), ("greenhouse", "2", "SWE", "old", "u", True),
        ("greenhouse", "3", "SWE", "old", "u", False), ("smartrec", "4", "SWE", "old", "u", True),
        ("smartrec", "5", "SWE", None, "u", False), ("lever", "6", "SWE", "old", "u", False)],
        "source string, external_id string, title string, description string, url string, is_new_grad boolean")
    details = spark.createDataFrame([
        ("greenhouse", "1", "entry level", None), ("greenhouse", "2", "", None), ("smartrec", "4", "", "exact"),
        ("smartrec", "5", "new grad", None), ("lever", "6", None, "x")],
        "source string, external_id string, description string, url string")
    got = {r.external_id: tuple(r)[3:] for r in load.apply_details(jobs, details).collect()}
    assert got == {"1": ("entry level", "u", True), "2": ("old", "u", True), "3": ("old", "u", False),
                   "4": ("", "exact", False), "5": ("new grad", "u", True), "6": ("old", "u", False)}


def test_newest_readable_detail_counts(spark):
    jobs = spark.createDataFrame([("smartrec", "4", "SWE", "old", "u", True), ("smartrec", "5", "SWE", "old", "u", True)],
                                 "source string, external_id string, title string, description string, url string, is_new_grad boolean")
    body = '{"jobAd": {"sections": {"a": {"text": "%s"}}}}'
    answers = spark.createDataFrame([
        ("4", body % "first", datetime(2026, 1, 1), 200), ("4", body % "second", datetime(2026, 1, 2), 200),
        ("4", "<html>", datetime(2026, 1, 3), 200), ("4", body % "third", datetime(2026, 1, 4), 500), ("5", "<html>", datetime(2026, 1, 1), 200)],
        "external_id string, body string, fetched_at timestamp, status int")
    got = load.apply_details(jobs, payloads.smartrecruiters_details(answers)).orderBy("external_id").collect()
    assert [(r.external_id, r.description) for r in got] == [("4", "second"), ("5", "old")]


def test_detail_selection_caps_and_order(spark):
    start = datetime(2026, 1, 1)
    rows = [(s, "b", str(i), None if i == 99 else start + timedelta(days=i), start, i)
            for s in ("greenhouse", "smartrec", "lever") for i in range(100)]
    df = spark.createDataFrame(rows, "source string, token string, external_id string, posted_at timestamp, "
                                     "fetched_at timestamp, position int")
    got = load.detail_selection(df).collect()
    by = {s: {int(r.external_id) for r in got if r.source == s} for s in ("greenhouse", "smartrec", "lever")}
    assert by == {"greenhouse": set(range(25)), "smartrec": set(range(59, 99)), "lever": set()}


def lever_body(*ids):
    return json.dumps([{"id": i, "text": f"SWE New Grad {i}", "hostedUrl": f"https://l/{i}",
                        "createdAt": 1767225600000} for i in ids])


def drop(folder, name, fetched, *boards):
    lines = [json.dumps({"ats": "lever", "token": t, "fetched_at": fetched, "status": 200, "body": b})
             for t, b in boards]
    (folder / name).write_text("\n".join(lines))


def test_stream_of_overlapping_drops_equals_one_load(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    table, marks = str(tmp_path / "jobs"), str(tmp_path / "marks")

    def run():
        query = ingest.ingest_postings(spark, str(landing), table, marks, files_per_batch=1)
        query.awaitTermination()
        return sorted(r.external_id for r in spark.read.parquet(table).collect())

    drop(landing, "1.json", "2026-01-01T00:00:00Z", ("a", lever_body("1", "2")), ("b", lever_body("3")))
    assert run() == ["1", "2", "3"]
    drop(landing, "2.json", "2026-01-02T00:00:00Z", ("a", lever_body("2", "4")), ("b", lever_body("3", "5", "5")))
    drop(landing, "3.json", "2026-01-03T00:00:00Z", ("a", lever_body("1", "2", "4", "6")))
    assert run() == ["1", "2", "3", "4", "5", "6"]
    assert run() == ["1", "2", "3", "4", "5", "6"]
    whole = payloads.all_postings(payloads.read_landing(spark, str(landing)))
    batch = load.insert_if_absent(whole, whole.limit(0), ingest.POSTING_ORDER)
    assert sorted(r.external_id for r in batch.collect()) == ["1", "2", "3", "4", "5", "6"]


def test_replayed_batch_overwrites_itself(spark, tmp_path):
    landing, table, marks = tmp_path / "in", str(tmp_path / "t"), tmp_path / "marks"
    landing.mkdir()

    def run():
        ingest.ingest_postings(spark, str(landing), table, str(marks), files_per_batch=1).awaitTermination()
        return sorted((r.external_id, r.batch_id) for r in spark.read.parquet(table).collect())

    drop(landing, "1.json", "2026-01-01T00:00:00Z", ("a", lever_body("1", "2")))
    run()
    drop(landing, "2.json", "2026-01-02T00:00:00Z", ("a", lever_body("2", "3")))
    first = run()
    assert first == [("1", 0), ("2", 0), ("3", 1)]
    # as if the run had ended after the table was written and before the batch counted as done
    for name in ("1", ".1.crc"):
        (marks / "commits" / name).unlink()
    assert run() == first


def test_a_batch_scans_only_its_own_files(spark, tmp_path):
    landing, table, marks = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "marks")
    landing.mkdir()
    reads = []

    def read_files(files):
        reads.append([f.rsplit("/", 1)[1] for f in files])
        return spark.read.schema(schemas.LANDING).json(files)

    for k, ids in enumerate((("1", "2"), ("2", "1"), ("2", "3"))):
        drop(landing, f"{k} +.json", f"2026-01-0{k + 1}T00:00:00Z", ("a", lever_body(*ids)))
        ingest.insert_stream(ingest.landing_stream(spark, str(landing)), read_files, payloads.all_postings,
                             table, marks, ingest.POSTING_ORDER).awaitTermination()
    # the second file brings nothing new and is not read again
    assert reads == [["0 +.json"], ["2 +.json"]]
    stream = ingest.first_seen(payloads.all_postings(ingest.landing_stream(spark, str(landing))), ingest.POSTING_ORDER)
    assert stream.isStreaming
    assert sorted(r.external_id for r in spark.read.parquet(table).collect()) == ["1", "2", "3"]


def test_poll_cycle_twice(spark, tmp_path):
    drop(tmp_path, "1.json", "2026-01-01T00:00:00Z", ("acme", lever_body(*[str(i) for i in range(20)])),
         ("empty", "[]"))
    landing = payloads.read_landing(spark, str(tmp_path))
    none = spark.createDataFrame([], COMPANIES + ", sponsor_score decimal(4,3)")
    keys = spark.createDataFrame([], "source string, external_id string")
    now = F.lit("2026-01-01 01:00:00").cast("timestamp")
    first = cycle.poll(landing, none, keys, now)
    assert {r.name for r in first.companies.collect()} == {"acme", "empty"}
    assert first.new_jobs.count() == 20 and first.new_jobs.filter("is_new_grad").count() == 20
    assert first.alerts.count() == 15
    log, = first.run_log.collect()
    assert (log.source, log.ok, log.detail) == ("lever", True, "2/2 boards, 20 new")
    second = cycle.poll(landing, first.companies, first.new_jobs, now)
    assert second.new_jobs.count() == 0 and second.alerts.count() == 0
    assert second.run_log.first().detail == "2/2 boards, 0 new"
    assert second.companies.count() == 2


def test_poll_cycle_skips_sent_alerts(spark, tmp_path):
    drop(tmp_path, "1.json", "2026-01-01T00:00:00Z", ("acme", lever_body("1", "2")))
    landing = payloads.read_landing(spark, str(tmp_path))
    none = spark.createDataFrame([], COMPANIES + ", sponsor_score decimal(4,3)")
    keys = spark.createDataFrame([], "source string, external_id string")
    now = F.lit("2026-01-01").cast("timestamp")
    sent = cycle.poll(landing, none, keys, now).alerts.filter("external_id = '1'").select(F.col("id").alias("job_id"))
    again = cycle.poll(landing, none, keys, now, notified=sent)
    assert [r.external_id for r in again.alerts.collect()] == ["2"]


@pytest.mark.parametrize("hot", [2000])
def test_hot_key_in_one_batch(spark, hot):
    rows = spark.range(hot).select(F.lit("lever").alias("source"), F.lit("same").alias("external_id"),
                                   F.col("id").cast("int").alias("n"), F.lit("t").alias("title"))
    row, = load.insert_if_absent(rows, rows.limit(0), ["n"]).collect()
    assert row.n == 0


def test_poll_of_a_response_landed_twice(spark, tmp_path):
    """Copies of a response, an id on two boards and postings without an id."""
    loose = json.dumps([{"text": "SWE New Grad", "hostedUrl": "https://l/x"}])
    for name in ("1.json", "2.json"):
        drop(tmp_path, name, "2026-01-01T00:00:00Z", ("acme", lever_body("1", "2")), ("loose", loose))
    drop(tmp_path, "3.json", "2026-01-02T00:00:00Z", ("other", lever_body("2", "3")))
    landing = payloads.read_landing(spark, str(tmp_path))
    none = spark.createDataFrame([], COMPANIES + ", sponsor_score decimal(4,3)")
    keys = spark.createDataFrame([("lever", "1")], "source string, external_id string")
    now = F.lit("2026-01-03").cast("timestamp")
    rows = cycle.poll(landing, none, keys, now).new_jobs.collect()
    got = sorted((r.external_id or "-", r.token) for r in rows)
    assert got == [("-", "loose"), ("-", "loose"), ("2", "acme"), ("3", "other")]


def test_one_per_key(spark):
    rows = spark.createDataFrame([("lever", "1", 2, "late"), ("lever", "1", 1, "early"), ("lever", "2", 3, "only"),
                                  ("lever", None, 4, "a"), ("lever", None, 4, "a")], ROWS)
    got = sorted((r.n, r.title) for r in load.one_per_key(rows, ["n"]).collect())
    assert got == [(1, "early"), (3, "only"), (4, "a"), (4, "a")]
    assert load.one_per_key(rows.limit(0), ["n"]).count() == 0


def test_wide_rows_are_written_once(spark, tmp_path, monkeypatch):
    """A poll without repeated keys and details neither shuffles nor writes its new rows again."""
    labels, stash = [], cycle.stash
    monkeypatch.setattr(cycle, "stash", lambda df, label: labels.append(label) or stash(df, label))
    drop(tmp_path, "1.json", "2026-01-01T00:00:00Z", ("acme", lever_body("1", "2")))
    none = spark.createDataFrame([], COMPANIES + ", sponsor_score decimal(4,3)")
    keys = spark.createDataFrame([], "source string, external_id string")
    done = cycle.poll(payloads.read_landing(spark, str(tmp_path)), none, keys, F.lit("2026-01-03").cast("timestamp"))
    assert done.new_jobs.count() == 2 and "cycle-inserted" in labels and "cycle-new" not in labels


def test_few_repeated_keys_move_no_other_rows(spark, tmp_path):
    path = str(tmp_path / "rows")
    (spark.range(1000).select(F.lit("lever").alias("source"), (F.col("id") % 999).cast("string").alias("external_id"),
                              F.col("id").alias("n")).write.parquet(path))
    rows = load.one_per_key(spark.read.parquet(path), ["n"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 999 and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_stream_state_holds_keys_alone(spark, tmp_path):
    landing, table, marks = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "marks")
    landing.mkdir()
    for n in range(3):  # in one batch: a new key in two files, and a file without one
        drop(landing, f"{n}.json", f"2026-01-0{3 - n}T00:00:00Z", ("a", lever_body(*[["1"], ["1", "2"], []][n])))
    reads = []

    def read_files(files):
        reads.append(sorted(f.rsplit("/", 1)[1] for f in files))
        return spark.read.schema(schemas.LANDING).json(files)

    ingest.insert_stream(ingest.landing_stream(spark, str(landing)), read_files, payloads.all_postings,
                         table, marks, ingest.POSTING_ORDER).awaitTermination()
    assert reads == [["0.json", "1.json"]]
    # the first row of key 1 lies in the file with the earlier time
    got = {r.external_id: str(r.fetched_at) for r in spark.read.parquet(table).collect()}
    assert got == {"1": "2026-01-02 00:00:00", "2": "2026-01-02 00:00:00"}
    state = spark.read.format("statestore").load(marks)
    assert state.filter("key.file IS NULL").count() == 2


def test_details_are_built_by_all_tasks(spark):
    # the small table is one row group, so one task read it and built every body
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert plans._details(Tables(spark, SMALL)).rdd.getNumPartitions() == 2 * parts


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    import time

    before = shuffle_files(spark)
    rows = cycle.stash(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")), "sums")
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and rows.count() == 7


def test_a_poll_saves_payloads_once_and_no_ids_that_can_be_made(spark, tmp_path, monkeypatch):
    saved, stash = {}, cycle.stash
    monkeypatch.setattr(cycle, "stash", lambda df, label: saved.setdefault(label, stash(df, label)))
    loose = json.dumps([{"text": "SWE New Grad", "hostedUrl": "https://l/x"}])
    drop(tmp_path, "1.json", "2026-01-01T00:00:00Z", ("acme", lever_body("1", "2")), ("old", lever_body("3")), ("loose", loose))
    old = spark.createDataFrame([("own", "old", "old")], "id string, name string, name_normalized string")
    old = old.withColumns({c: F.lit(None).cast("string") for c in ("ats_type", "ats_token", "sponsor_status")}).withColumn(
        "sponsor_score", F.lit(None).cast("decimal(4,3)"))
    keys = spark.createDataFrame([], "source string, external_id string")
    done = cycle.poll(payloads.read_landing(spark, str(tmp_path)), old, keys, F.lit("2026-01-03").cast("timestamp"))
    assert [label for label, df in saved.items() if "raw" in df.columns] == ["cycle-rows"]
    assert sorted(map(tuple, saved["cycle-inserted"].select("external_id", "own_id").collect()), key=str) == [
        ("1", None), ("2", None), ("3", "own"), (None, None)]
    def key(source, external_id, *rest):
        return load.job_id(F.lit(source), F.lit(external_id), *map(F.lit, rest))
    ids = spark.range(1).select(key("lever", "1"), key("lever", "2"), key("lever", "3"),
                                key("lever", None, "https://l/x", "SWE New Grad", None), load.company_id(F.lit("acme")),
                                load.company_id(F.lit("loose"))).first()
    rows = {r.external_id: r for r in done.new_jobs.collect()}
    assert [rows[x].id for x in ("1", "2", "3", None)] == list(ids[:4])
    assert [rows[x].company_id for x in ("1", "2", "3", None)] == [ids[4], ids[4], "own", ids[5]]
    assert rows[None].title == "SWE New Grad" and rows[None].raw is not None and rows[None].is_new_grad
    # keys and flags alone do not meet the payload
    plan = done.new_jobs.select("source", "external_id", "is_new_grad")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_first_arrival_of_rows_with_a_payload(spark):
    rows = spark.sql("""SELECT 'lever' AS source, cast(id % 3 AS string) AS external_id, 10 - id AS n, 'b' || id AS other,
        parse_json(concat('{"n":', id, '}')) AS raw FROM range(9)""")
    wide = {r.external_id: (r.n, r.other) for r in load.first_arrivals(rows, ["n"]).collect()}
    narrow = {r.external_id: (r.n, r.other) for r in load.first_arrivals(rows.drop("raw"), ["n"]).collect()}
    assert wide == narrow == {"0": (4, "b6"), "1": (3, "b7"), "2": (2, "b8")}
    assert load.first_arrivals(rows, ["n"]).columns == rows.columns


def test_large_lookups_are_not_collected(spark, tmp_path):
    spark.range(10).select(F.lit("x").alias("id"), F.col("id").cast("string").alias("name_normalized")).write.parquet(str(tmp_path / "c"))
    rows = load.with_company_id(spark.range(5).select(F.col("id").cast("string").alias("name")), spark.read.parquet(str(tmp_path / "c")))
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 5
