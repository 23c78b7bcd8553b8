"""Filings from CSV files with varying headers."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from vacantia.operators import load
from vacantia.plans import ingest
from vacantia.plans.registry import Tables
from vacantia.sources import filings, quoted_csv

MODERN = ("Fiscal Year,Employer (Petitioner) Name,Initial Approval,Initial Denial,Continuing Approval\n"
          '2025,"STRIPE, INC.",12,1,30\n'
          '2025,Big Co,"1,234",0,"2,500"\n'
          "2025,  ,9,9,9\n"
          "abc,X Co,N/A,-,?\n")
OLDER = ("﻿fiscal_year, Employer ,initial_approval,Initial Denials,continuing_approval\n"
         "2024,Acme Corp,3,,\n"
         "0,Zero Year LLC,+4,-2,1\n")
NO_EMPLOYER = "Fiscal Year,Initial Approval\n2025,3\n"


def test_layouts_load_together(spark, tmp_path):
    for name, body in (("a.csv", MODERN), ("b.csv", OLDER), ("c.csv", NO_EMPLOYER), ("d.csv", OLDER)):
        (tmp_path / name).write_text(body, encoding="utf-8")
    df = filings.read_filings(spark, str(tmp_path))
    rows = sorted(tuple(r) for r in df.select(
        F.coalesce("fiscal_year", F.lit(-1)), "employer_raw", "employer_norm", "initial_approvals",
        "initial_denials", "continuing_approvals").distinct().collect())
    assert rows == [
        (-1, "X Co", "x", 0, 0, 0), (-1, "Zero Year LLC", "zero year", 4, -2, 1),
        (2024, "Acme Corp", "acme", 3, 0, 0), (2025, "Big Co", "big", 1234, 0, 2500),
        (2025, "STRIPE, INC.", "stripe", 12, 1, 30)]
    assert df.count() == 7  # the older layout came in two files


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'Fiscal Year,Employer,Initial Approval\n2025,"Two\nLines Inc",5\n')
    row = filings.read_filings(spark, str(tmp_path)).first()
    assert (row.employer_raw, row.initial_approvals) == ("Two\nLines Inc", 5)


@pytest.mark.parametrize("text,want", [("1,234", 1234), (" 7 ", 7), ("", 0), (None, 0), ("1.5", 0),
                                       ("-3", -3), ("9" * 30, 0), ("N/A", 0)])
def test_tolerant_int(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(filings.tolerant_int(F.col("t")).alias("x"))
    assert df.first().x == want


def test_first_header_with_a_value_wins(spark):
    df = spark.createDataFrame([("", "B"), ("A", "B")], "c0 string, c1 string")
    got = [r.x for r in df.select(filings.pick(["Employer", " EMPLOYER NAME"], ("employer", "employer name")).alias("x")).collect()]
    assert got == ["B", "A"]


@pytest.fixture
def small_blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(4))
def test_records_of_files_cut_into_blocks(spark, tmp_path, small_blocks, seed):
    draw, folder = random.Random(seed), tmp_path / "in"
    folder.mkdir()
    want = []
    for k in range(3):
        end = draw.choice(["\n", "\r\n"])
        text = io.StringIO(newline="")
        out = csv.writer(text, lineterminator=end)
        for _ in range(draw.choice([1, 60])):
            out.writerow([draw.choice(["", "a", 'say "x"', "one\ntwo", "long\n\n\nfield " * draw.randint(1, 30), 'q"\n"', "a,b", "\r\n", "é"]) for _ in range(3)])
        # a quote inside a plain field is text
        body = text.getvalue() + f'plain 5" pipe,x,7{end}' + f"last,,3{draw.choice([end, ''])}"
        (folder / f"{k}.csv").write_text(body, encoding="utf-8", newline="")
        rows = [r for r in csv.reader(io.StringIO(body, newline="")) if r]
        want += [(str(k), *r) for r in rows[1:]]
    lines = quoted_csv.scanned_lines(spark, str(folder))
    assert lines.select("file", "block").distinct().count() > 5
    rest, headers = quoted_csv.headed_records(spark, str(folder))
    got = [(r.file.rsplit("/", 1)[1][0], *(next(csv.reader(io.StringIO(r.value, newline=""))))) for r in rest.filter("value <> ''").collect()]
    assert sorted(got) == sorted(want)
    assert headers.count() == 3


def test_one_file_is_read_by_several_tasks(spark, tmp_path, small_blocks):
    body = "Fiscal Year,Employer,Initial Approval\n" + "".join(f'2025,"Firm\n{i}, Inc.",{i}\n' for i in range(100))
    (tmp_path / "a.csv").write_text(body)
    assert quoted_csv.scanned_lines(spark, str(tmp_path)).select("block").distinct().count() > 10
    rows = filings.read_filings(spark, str(tmp_path)).collect()
    assert sorted((r.employer_raw, r.initial_approvals) for r in rows) == sorted((f"Firm\n{i}, Inc.", i) for i in range(100))


def test_no_files(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    stored = filings.read_filings(spark, str(tmp_path / "absent"))
    assert stored.count() == 0
    for name in ("absent", "empty"):
        state, log = filings.filings_load(spark, str(tmp_path / name), stored, F.lit("2026-01-01").cast("timestamp"))
        assert state.count() == 0 and log.select("ok", "detail").first() == (False, "no input files")
    (tmp_path / "empty" / "a.csv").write_text("")
    assert filings.read_filings(spark, str(tmp_path / "empty")).count() == 0


def test_reload_touches_one_slice(spark, tmp_path):
    path = str(tmp_path / "filings")
    table = "src string, n int"
    load.write_slice(spark.createDataFrame([("uscis_hub", 1), ("dol_lca", 2)], table), path)
    load.write_slice(spark.createDataFrame([("uscis_hub", 7), ("uscis_hub", 8)], table), path)
    got = spark.read.parquet(path).select("src", "n").collect()
    assert sorted(tuple(r) for r in got) == [("dol_lca", 2), ("uscis_hub", 7), ("uscis_hub", 8)]
    old = spark.createDataFrame([("uscis_hub", 1), ("dol_lca", 2), (None, 3)], table)
    new = spark.createDataFrame([("uscis_hub", 9), ("other", 4)], table)
    state = load.replace_slice(old, new, "uscis_hub").collect()
    assert {tuple(r) for r in state} == {("dol_lca", 2), (None, 3), ("uscis_hub", 9)}


def test_software_occupations_only(spark):
    raw = spark.createDataFrame(
        [(2025, " Acme Inc ", "15-1252", "SWE", 100.5, "WA"), (2025, "Acme", "11-3021", "M", 1.0, "WA")],
        "fiscal_year int, employer_raw string, soc_code string, job_title string, wage double, worksite_state string")
    row, = filings.software_filings(raw).collect()
    assert (row.src, row.employer_raw, row.employer_norm, str(row.wage)) == ("dol_lca", "Acme Inc", "acme", "100.50")


def test_rows_are_dealt_evenly_to_files(spark):
    t = Tables(spark, SMALL)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    try:
        for most, files in ((5, 5), (None, 10)):
            sizes = [r["count"] for r in spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(
                f"{ingest._filing_files(t, most)}/*").groupBy(F.input_file_name()).count().collect()]
            assert len(sizes) == files and sum(sizes) == t.lineitem.count()
            assert max(sizes) < 1.2 * sum(sizes) / files
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
