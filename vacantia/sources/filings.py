"""Employer filings from CSV exports whose headers vary by year."""

from __future__ import annotations

import csv
import io

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia import fixed_values as fv
from vacantia.functions.text import first_non_empty, normalize_company
from vacantia.operators.load import replace_slice
from vacantia.operators.runlog import run_row
from vacantia.session import stash
from vacantia.sources.quoted_csv import headed_records

_FILINGS = ("src string, fiscal_year int, employer_raw string, employer_norm string, "
            "initial_approvals bigint, initial_denials bigint, continuing_approvals bigint")


def stripped(text: Column) -> Column:
    """Text without leading and trailing whitespace of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tolerant_int(text: Column) -> Column:
    """Integer with thousands commas; anything else is 0."""
    plain = stripped(F.replace(text, F.lit(","), F.lit("")))
    whole = F.when(plain.rlike(r"^[+-]?[0-9]+$"), plain.try_cast("bigint"))
    return F.coalesce(whole, F.lit(0).cast("bigint"))


def pick(header: list[str], variants: tuple[str, ...]) -> Column:
    """The first header variant with a non-empty value, compared trimmed and folded; ``c<i>`` holds field i."""
    present = {name.lstrip("\ufeff").strip().lower(): f"c{i}" for i, name in enumerate(header)}
    found = [F.col(present[v]) for v in variants if v in present]
    return first_non_empty(*found) if found else F.lit(None).cast("string")


def normalize_filings(raw: DataFrame, src: str = "uscis_hub") -> DataFrame:
    """Picked texts to the filings table; blank employers drop out."""
    employer = stripped(F.col("employer"))
    year = F.nullif(tolerant_int(F.col("fiscal_year")), F.lit(0))
    return raw.select(
        F.lit(src).alias("src"), year.try_cast("int").alias("fiscal_year"),
        employer.alias("employer_raw"), normalize_company(employer).alias("employer_norm"),
        *[tolerant_int(F.col(c)).alias(c) for c in ("initial_approvals", "initial_denials", "continuing_approvals")],
    ).filter(F.col("employer_raw") != "")


def read_filings(spark: SparkSession, path: str, src: str = "uscis_hub") -> DataFrame:
    """All CSV files under ``path``, each by its own header; a file may be read by many tasks.

    Every record is parsed once into as many fields as the widest header has;
    the driver sees the distinct headers only. No file, or none that exists, gives no rows.
    """
    try:
        rest, headers = headed_records(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _FILINGS)
    layouts = sorted(r.header for r in headers.select("header").distinct().collect())
    names = [next(csv.reader(io.StringIO(h.lstrip("\ufeff"), newline="")), []) for h in layouts]
    width = max(map(len, names), default=0)
    if not width:
        return spark.createDataFrame([], _FILINGS)
    known = spark.createDataFrame(list(enumerate(layouts)), "layout int, header string")
    of_file = headers.join(F.broadcast(known), "header").select("file", "layout")  # one row per header
    fields = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)), {"escape": '"', "multiLine": "true"})
    raw = rest.join(of_file, "file").select("layout", fields.alias("c")).select("layout", "c.*")
    picked = {}
    for name, variants in fv.FILING_COLUMNS.items():
        picked[name] = F.coalesce(*[F.when(F.col("layout") == k, pick(header, variants)) for k, header in enumerate(names)])
    return normalize_filings(raw.select(*[c.alias(n) for n, c in picked.items()]), src)


def filings_load(spark: SparkSession, path: str, stored: DataFrame, as_of: Column,
                 src: str = "uscis_hub") -> tuple[DataFrame, DataFrame]:
    """The filings table after the load of ``path`` and the run-log row; without files the table stays."""
    rows = stash(read_filings(spark, path, src), "filings-rows")
    files = _files(spark, path)
    counts = rows.agg(F.count("*").alias("n"))
    if not files:
        return stored, run_row(counts, src, F.lit(False), as_of, F.lit("no input files"))
    detail = F.concat(F.col("n"), F.lit(f" rows from {files} files"))
    return replace_slice(stored, rows, src), run_row(counts, src, F.lit(True), as_of, detail)


def _files(spark: SparkSession, path: str) -> int:
    try:
        return spark.read.format("binaryFile").load(path).select("path").distinct().count()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def software_filings(raw: DataFrame) -> DataFrame:
    """Labour-condition filings of software occupations."""
    employer = stripped(F.col("employer_raw"))
    return (raw.filter(F.col("soc_code").startswith(fv.SOFTWARE_SOC_PREFIX))
            .select(F.lit("dol_lca").alias("src"), "fiscal_year", employer.alias("employer_raw"),
                    normalize_company(employer).alias("employer_norm"), "soc_code", "job_title",
                    F.col("wage").cast("decimal(18,2)").alias("wage"), "worksite_state")
            .filter(F.col("employer_raw") != ""))
