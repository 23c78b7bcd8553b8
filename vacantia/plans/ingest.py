"""Queries on landed payloads, filings, incremental load and board health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.operators import checks, health, load, runlog
from vacantia.operators.keystore import KeyStore
from vacantia.plans import cycle
from vacantia.plans import oracle_parts as o
from vacantia.plans.enrich import ORDERS_AS_OF, at, companies, jobs
from vacantia.plans.landing import ANSWERED, BAD_TIME, BODIES, CUT, EXPECTED, EXPECTED_ALL, NAME, landing, ok
from vacantia.plans.registry import Tables, query
from vacantia.plans.views import VIEWS
from vacantia.session import scratch_path, spread, stash
from vacantia.sources import filings as filing_source
from vacantia.sources import payloads, watchlist
from vacantia.streaming import ingest as stream

FIELDS = ["source", "external_id", "title", "location", "url", "description", "posted_at"]
_FIELDS = ", ".join(FIELDS)


# --- payloads -------------------------------------------------------------------

def _register_source(ats: str) -> None:
    @query(f"source_{ats}", f"SELECT {_FIELDS} FROM ({EXPECTED[ats]})")
    def _(t):
        return payloads.postings_of(landing(t, ats), ats).select(*FIELDS)


for _ats in BODIES:
    _register_source(_ats)


@query("source_union", f"SELECT source, CAST(count(*) AS BIGINT) AS postings, count(posted_at) AS dated FROM ({EXPECTED_ALL}) GROUP BY 1")
def _(t):
    return (payloads.all_postings(landing(t)).groupBy("source")
            .agg(F.count("*").alias("postings"), F.count("posted_at").alias("dated")))


@query("raw_payload", f"SELECT source, external_id, external_id AS raw_id FROM ({EXPECTED_ALL})")
def _(t):
    rows = payloads.all_postings(landing(t))
    return rows.select("source", "external_id", payloads.text_at(F.col("raw"), "$.id").alias("raw_id"))


@query("posting_company", f"SELECT source, external_id, company FROM ({EXPECTED_ALL})")
def _(t):
    rows = stash(payloads.typed(landing(t)).select(*payloads.KEYS), "named-typed")
    named = payloads.with_company_name(payloads.postings(rows), payloads.board_companies(rows))
    return named.select("source", "external_id", F.col("name").alias("company"))


@query("board_runs", f"""
SELECT 'c'||o_custkey AS token, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_custkey%3=0 THEN 'c'||o_custkey ELSE {NAME}||' '||min(o_orderkey) FILTER (WHERE o_orderkey%9<>0) END AS name,
  count(DISTINCT o_orderkey%200) AS times
FROM orders WHERE {ok('smartrecruiters')} GROUP BY o_custkey, o_orderdate HAVING count(*) FILTER (WHERE o_orderkey%9<>0) > 0""")
def _(t):
    # the pages of a board are fetched up to 200 seconds apart and still have one name
    landed = landing(t, "smartrecruiters")
    apart = F.timestamp_add("SECOND", F.get_json_object("body", "$.offset").cast("long") % 200, "fetched_at")
    seen = payloads.board_companies(payloads.typed(landed.withColumn("fetched_at", F.coalesce(apart, "fetched_at"))))
    return seen.groupBy("token", F.to_date("fetched_at").alias("day"), "name").agg(F.count("*").alias("times"))


@query("board_companies", f"""
SELECT 'greenhouse' AS ats, 'board'||o_orderkey AS token, CASE WHEN o_orderkey%4<2 THEN 'board'||o_orderkey ELSE {NAME} END AS name FROM orders WHERE {ok('greenhouse')}
UNION ALL SELECT 'lever', 'board'||o_orderkey, 'board'||o_orderkey FROM orders WHERE {ok('lever')}
UNION ALL SELECT 'ashby', 'board'||o_orderkey, 'board'||o_orderkey FROM orders WHERE {ok('ashby')}
UNION ALL SELECT 'smartrecruiters', 'c'||o_custkey, CASE WHEN o_custkey%3=0 THEN 'c'||o_custkey ELSE {NAME}||' '||min(o_orderkey) END
  FROM orders WHERE {ok('smartrecruiters')} AND o_orderkey%9<>0 GROUP BY o_custkey, o_orderdate""")
def _(t):
    return payloads.board_companies(payloads.typed(landing(t))).select("ats", "token", "name")


_LOST = f"({CUT} OR CASE ats {' '.join(f"WHEN '{a}' THEN {c}" for a, c in BAD_TIME.items())} END)"


@query("board_status", f"""
SELECT ats, CASE WHEN o_orderpriority='1-URGENT' THEN CASE WHEN ats IN ('greenhouse','lever','ashby') THEN 'missing' ELSE 'failed' END
  WHEN o_orderpriority='2-HIGH' OR {_LOST} THEN 'failed' ELSE 'ok' END AS outcome, CAST(count(*) AS BIGINT) AS responses
FROM orders, (VALUES ('greenhouse'),('lever'),('ashby'),('smartrecruiters'),('github_repos')) x(ats) GROUP BY ALL""")
def _(t):
    return (payloads.board_status(payloads.typed(landing(t))).groupBy("ats", "outcome")
            .agg(F.count("*").alias("responses")))


@query("run_summary", f"""
WITH p AS (SELECT ats, CASE ats WHEN 'smartrecruiters' THEN 'c'||o_custkey WHEN 'github_repos' THEN 'listings' ELSE 'board'||o_orderkey END AS token,
  bool_or(o_orderpriority='2-HIGH' OR (o_orderpriority='1-URGENT' AND ats IN ('smartrecruiters','github_repos')) OR ({ANSWERED} AND {_LOST})) AS failed
  FROM orders, (VALUES ('greenhouse'),('lever'),('ashby'),('smartrecruiters'),('github_repos')) x(ats) GROUP BY 1, 2),
b AS (SELECT ats, count(*) AS boards, count(*) FILTER (WHERE failed) AS failed FROM p GROUP BY 1),
n AS (SELECT CASE source WHEN 'smartrec' THEN 'smartrecruiters' WHEN 'github_repo' THEN 'github_repos' ELSE source END AS ats, count(*) AS added FROM ({EXPECTED_ALL}) GROUP BY 1)
SELECT b.ats AS source, failed=0 AS ok, boards-failed AS boards_ok, boards, coalesce(added,0) AS new_rows,
  (boards-failed)||'/'||boards||CASE WHEN b.ats='github_repos' THEN ' repos, ' ELSE ' boards, ' END||coalesce(added,0)||' new' AS detail
FROM b LEFT JOIN n USING (ats)""")
def _(t):
    rows = stash(payloads.typed(landing(t)).select(*payloads.KEYS), "summary-typed")
    return runlog.poll_summary(payloads.board_status(rows), payloads.postings(rows))


_SECTIONS = """map('jobDescription', named_struct('title', CASE WHEN o_orderkey%3=0 THEN '' ELSE 'The job' END, 'text', o_orderpriority),
  'companyDescription', named_struct('title', 'About', 'text', CASE WHEN o_orderkey%4=0 THEN '' ELSE o_orderstatus END),
  'additional', named_struct('title', CAST(NULL AS STRING), 'text', CASE WHEN o_orderkey%5=0 THEN NULL WHEN o_orderkey%5=1 THEN 'We hire new grad engineers' ELSE 'more' END))"""

_DETAIL_TEXT = """concat_ws(chr(10)||chr(10), CASE WHEN o_orderkey%3=0 THEN o_orderpriority ELSE 'The job'||chr(10)||o_orderpriority END,
  CASE WHEN o_orderkey%4=0 THEN NULL ELSE 'About'||chr(10)||o_orderstatus END,
  CASE WHEN o_orderkey%5=0 THEN NULL WHEN o_orderkey%5=1 THEN 'We hire new grad engineers' ELSE 'more' END)"""


def _details(t: Tables, which: str = "WHERE o_orderpriority<>'5-LOW'") -> DataFrame:
    """Detail responses for two providers; low-priority postings have none by default."""
    text_body = f"""to_json(named_struct('id', CAST(o_orderkey AS STRING),
        'postingUrl', CASE WHEN o_orderkey%2=0 THEN concat('https://exact.example.com/', o_orderkey) END,
        'jobAd', named_struct('sections', {_SECTIONS})))"""
    plain_body = """to_json(named_struct('id', CAST(o_orderkey AS STRING),
        'content', CASE WHEN o_orderkey%2=0 THEN '' ELSE 'Entry level role' END))"""
    base = t.spark.sql(f"""SELECT CAST(o_orderkey AS STRING) AS external_id, {text_body} AS paged, {plain_body} AS plain
        FROM {{orders}} {which}""", orders=spread(t.orders))  # a body costs far more than the bytes of its order

    def answers(body: str) -> DataFrame:
        """Each answer, an older one of other content, and a newer one that is an error page."""
        row = base.select("external_id", F.col(body).alias("body"))
        kinds = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("kind")
        other = F.replace("body", F.lit("e"), F.lit("o"))
        return row.select("*", kinds).select(
            "external_id", F.when(F.col("kind") == 1, row.body).when(F.col("kind") == 0, other).otherwise("<html>busy</html>").alias("body"),
            F.timestamp_seconds(F.col("kind")).alias("fetched_at"))

    paged = payloads.smartrecruiters_details(answers("paged"))
    green = payloads.greenhouse_details(answers("plain"))
    return paged.unionByName(green)


@query("detail_text", f"""
SELECT CAST(o_orderkey AS STRING) AS external_id, {_DETAIL_TEXT} AS description FROM orders""")
def _(t):
    # the newest readable answers; the older ones were fetched at second 0
    newest = F.col("fetched_at") == F.timestamp_seconds(F.lit(1))
    return _details(t, "").filter("source = 'smartrec'").filter(newest).select("external_id", "description")


@query("detail_update", f"""
WITH d AS (SELECT o_orderkey, {_DETAIL_TEXT} AS paged, CASE WHEN o_orderkey%2=0 THEN '' ELSE 'Entry level role' END AS plain,
    CASE WHEN o_orderkey%2=0 THEN 'https://exact.example.com/'||o_orderkey END AS exact FROM orders WHERE o_orderpriority<>'5-LOW'),
x AS (SELECT j.*, CASE WHEN d.o_orderkey IS NOT NULL AND (j.source='smartrec' OR (j.source='greenhouse' AND d.plain<>'')) THEN 1 ELSE 0 END AS hit,
    CASE j.source WHEN 'smartrec' THEN d.paged ELSE d.plain END AS fresh, CASE WHEN j.source='smartrec' THEN d.exact END AS exact
  FROM jobs_v j LEFT JOIN d ON d.o_orderkey=j.id),
y AS (SELECT id, title, CASE WHEN hit=1 THEN fresh ELSE description END AS description, CASE WHEN hit=1 THEN coalesce(exact,url) ELSE url END AS url FROM x)
SELECT id, description, url, {o.grad('title', 'description')} AS is_new_grad FROM y""")
def _(t):
    return load.apply_details(jobs(t), _details(t)).select("id", "description", "url", "is_new_grad")


@query("detail_topk", """
WITH x AS (SELECT *, company_id%20 AS token, CASE WHEN id%10=3 THEN NULL ELSE first_seen_at END AS posted_at FROM jobs_v WHERE source IN ('greenhouse','smartrec'))
SELECT source, token, id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source, token ORDER BY
  CASE WHEN source='smartrec' THEN posted_at END DESC NULLS LAST, first_seen_at, id, external_id) AS INT) AS rank FROM x)
WHERE rank <= CASE source WHEN 'greenhouse' THEN 25 ELSE 40 END""")
def _(t):
    rows = t.jobs_v.withColumns({
        "token": F.col("company_id") % 20, "fetched_at": F.col("first_seen_at"),
        "position": F.col("id"),
        "posted_at": F.when(F.col("id") % 10 != 3, F.col("first_seen_at"))})
    return load.detail_selection(rows).select("source", "token", "id", "rank")


# --- filings --------------------------------------------------------------------

def _filing_files(t: Tables, most: int | None = None) -> str:
    """Folder of filing rows written as CSV files in two header layouts, all rows of the table.

    Three files of five have the first layout. A file is written by one task, so there are about as many as tasks, and at least
    five, unless ``most`` gives their number. Every file gets an equal part of the rows, which are dealt as numbers, before they become texts.
    One layout starts with a byte order mark; some values hold a line break.
    """
    cells = """CASE kind WHEN 2 THEN '' WHEN 3 THEN concat('F', chr(10), 'Y') ELSE CAST(year AS STRING) END AS fy,
        CASE WHEN kind=1 THEN '  ' ELSE concat(' Employer ', l_suppkey, ', Inc. ') END AS name,
        CASE WHEN no_tax THEN 'N/A' ELSE format_number(price, 0) END AS ia,
        CASE WHEN no_discount THEN '-' ELSE CAST(l_partkey AS STRING) END AS idn,
        CASE WHEN l_linenumber=3 THEN NULL ELSE concat(' ', l_linenumber) END AS ca"""
    numbers = t.spark.sql("""SELECT l_linenumber, year(l_shipdate) AS year, CAST(CASE WHEN l_quantity IN (1, 2, 3) THEN l_quantity ELSE 0 END AS TINYINT) AS kind, l_suppkey, l_tax=0 AS no_tax,
        CAST(floor(l_extendedprice) AS BIGINT) AS price, l_discount=0 AS no_discount, l_partkey,
        pmod(xxhash64(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice), 5) AS share FROM {lineitem}""", lineitem=t.lineitem)
    fifth = max(1, int(t.spark.conf.get("spark.sql.shuffle.partitions")) // 5) if most is None else most // 5
    path = scratch_path(t.spark, "filings-csv")
    for name, of, shares in (("modern", "share < 3", 3), ("other", "share >= 3", 2)):
        dealt = numbers.filter(of).drop("share").repartition(shares * fifth)
        rows = t.spark.sql(f"SELECT {cells} FROM {{dealt}}", dealt=dealt)
        part = rows.select(
            F.col("fy").alias("\ufeffFiscal Year"), F.col("name").alias("Employer (Petitioner) Name"),
            F.col("ia").alias("Initial Approval"), F.col("idn").alias("Initial Denial"),
            F.col("ca").alias("Continuing Approval")) if name == "modern" else rows.select(
            F.col("fy").alias(" fiscal_year"), F.lit("").alias("Employer"),
            F.col("name").alias("EMPLOYER NAME "), F.col("ia").alias("initial_approval"),
            F.col("idn").alias("Initial Denials"), F.col("ca").alias("continuing_approval"))
        (part.write.option("escape", '"')
         .csv(f"{path}/{name}", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))
    return path


@query("filings_parse", f"""
SELECT 'uscis_hub' AS src, CASE WHEN l_quantity IN (2,3) THEN NULL ELSE CAST(year(l_shipdate) AS INT) END AS fiscal_year,
  'Employer '||l_suppkey||', Inc.' AS employer_raw, {o.norm("'Employer '||l_suppkey||', Inc.'")} AS employer_norm,
  CASE WHEN l_tax=0 THEN 0 ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS initial_approvals,
  CASE WHEN l_discount=0 THEN 0 ELSE l_partkey END AS initial_denials,
  CASE WHEN l_linenumber=3 THEN 0 ELSE CAST(l_linenumber AS BIGINT) END AS continuing_approvals
FROM lineitem WHERE l_quantity<>1""")
def _(t):
    return filing_source.read_filings(t.spark, f"{_filing_files(t)}/*")


@query("filings_run_log", """
SELECT 'uscis_hub' AS source, true AS ok, count(*)||' rows from 5 files' AS detail, CAST(count(*)+1 AS BIGINT) AS stored FROM lineitem WHERE l_quantity<>1
UNION ALL SELECT 'uscis_hub', false, 'no input files', 2""")
def _(t):
    # two rows are stored, one of another source; the second load finds no file and changes nothing
    stored = t.spark.createDataFrame([("uscis_hub",), ("dol_lca",)], "src string")
    columns = filing_source.read_filings(t.spark, scratch_path(t.spark, "no-filings")).columns
    stored = stored.select("src", *[F.lit(None).alias(c) for c in columns if c != "src"])
    out = []
    for path in (f"{_filing_files(t, most=5)}/*", scratch_path(t.spark, "no-filings")):
        state, log = filing_source.filings_load(t.spark, path, stored, at(ORDERS_AS_OF))
        out.append(log.select("source", "ok", "detail", F.lit(state.count()).alias("stored").cast("long")))
    return out[0].unionByName(out[1])


_SLICES = "CASE WHEN l_linenumber%3=0 THEN 'dol_lca' ELSE 'uscis_hub' END"


@query("filings_reload", f"""
SELECT src, CAST(count(*) AS BIGINT) AS n, CAST(sum(initial_approvals) AS BIGINT) AS approvals FROM (
  SELECT {_SLICES} AS src, l_partkey AS initial_approvals FROM lineitem WHERE {_SLICES}='dol_lca'
  UNION ALL SELECT 'uscis_hub', initial_approvals FROM filings_v) GROUP BY 1""")
def _(t):
    old = t.lineitem.select(F.expr(_SLICES).alias("src"), F.col("l_partkey").alias("initial_approvals"))
    new = t.filings_v.select("src", F.col("initial_approvals").cast("bigint"))
    return (load.replace_slice(old, new, "uscis_hub").groupBy("src")
            .agg(F.count("*").alias("n"), F.sum("initial_approvals").alias("approvals")))


@query("filings_overwrite", f"""
SELECT src, CAST(count(*) AS BIGINT) AS n, CAST(sum(initial_approvals) AS BIGINT) AS approvals FROM (
  SELECT {_SLICES} AS src, l_partkey AS initial_approvals FROM lineitem WHERE {_SLICES}='dol_lca'
  UNION ALL SELECT 'uscis_hub', initial_approvals FROM filings_v) GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "filings")
    load.write_slice(t.lineitem.select(F.expr(_SLICES).alias("src"),
                                       F.col("l_partkey").alias("initial_approvals")), path)
    load.write_slice(t.filings_v.select("src", F.col("initial_approvals").cast("bigint")), path)
    return (t.spark.read.schema("initial_approvals bigint, src string").parquet(path).groupBy("src")
            .agg(F.count("*").alias("n"), F.sum("initial_approvals").alias("approvals")))


@query("software_filings", f"""
SELECT 'dol_lca' AS src, CAST(year(l_shipdate) AS INT) AS fiscal_year, employer_raw, {o.norm('employer_raw')} AS employer_norm, soc_code,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS wage FROM (
  SELECT *, 'Employer '||l_suppkey||' LLC' AS employer_raw, CASE l_linenumber%3 WHEN 0 THEN '15-1252' WHEN 1 THEN '15-1132' ELSE '11-3021' END AS soc_code FROM lineitem)
WHERE soc_code LIKE '15-12%'""")
def _(t):
    raw = t.spark.sql("""SELECT CAST(year(l_shipdate) AS INT) AS fiscal_year, concat('Employer ', l_suppkey, ' LLC') AS employer_raw,
        CASE l_linenumber%3 WHEN 0 THEN '15-1252' WHEN 1 THEN '15-1132' ELSE '11-3021' END AS soc_code,
        'Engineer' AS job_title, l_extendedprice AS wage, 'WA' AS worksite_state FROM {lineitem}""", lineitem=t.lineitem)
    return filing_source.software_filings(raw).drop("job_title", "worksite_state")


# --- incremental load -----------------------------------------------------------

ORDER = ["posted_at", "payload_value", "quantity", "suppkey", "company_id", "tax", "discount"]
_ORDER = ", ".join(ORDER)
_SPLIT = "TIMESTAMP '1999-01-01'"


def _stored_and_new(t: Tables) -> tuple[DataFrame, DataFrame]:
    old = F.col("posted_at") < at("1999-01-01")
    return t.arrivals_v.filter(old), t.arrivals_v.filter(~old)


_INSERT = f"""
WITH fresh AS (SELECT * FROM arrivals_v a WHERE posted_at>={_SPLIT} AND (external_id IS NULL OR NOT EXISTS (
    SELECT 1 FROM arrivals_v s WHERE s.posted_at<{_SPLIT} AND s.source=a.source AND s.external_id=a.external_id))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY {_ORDER}) AS rn FROM fresh)
SELECT source, external_id, {_ORDER} FROM ranked WHERE rn=1 OR external_id IS NULL"""


@query("insert_if_absent", _INSERT)
def _(t):
    stored, new = _stored_and_new(t)
    return load.insert_if_absent(new, stored, ORDER).select("source", "external_id", *ORDER)


# as a store that was filled by two additions
@query("insert_bucketed", _INSERT)
def _(t):
    stored, new = _stored_and_new(t)
    store = KeyStore(t.spark, scratch_path(t.spark, "insert-store"), load.KEY_TYPES, buckets=8, expected=100_000)
    for part in range(2):
        store.add(stored.filter(F.pmod(F.xxhash64("external_id"), F.lit(2)) == part))
    return load.insert_if_absent(new, store, ORDER).select("source", "external_id", *ORDER)


@query("insert_twice", """
SELECT source, CAST(count(DISTINCT external_id) + count(*) FILTER (WHERE external_id IS NULL) AS BIGINT) AS stored,
  CAST(count(*) FILTER (WHERE external_id IS NULL) AS BIGINT) AS added_again
FROM arrivals_v GROUP BY 1""")
def _(t):
    # rows without a key conflict with nothing, so a second load adds them again
    rows = t.arrivals_v
    first = stash(load.insert_if_absent(rows, rows.limit(0), ORDER), "insert-first")
    again = load.insert_if_absent(rows, first, ORDER)
    counted = (first.select("source", F.lit(0).alias("again"))
               .unionAll(again.select("source", F.lit(1).alias("again"))))
    return counted.groupBy("source").agg(F.count_if(F.col("again") == 0).alias("stored"),
                                         F.count_if(F.col("again") == 1).alias("added_again"))


@query("stream_ingest", f"""
SELECT source, external_id, {_ORDER} FROM (
  SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY {_ORDER}) AS rn FROM arrivals_v)
WHERE rn=1 OR external_id IS NULL
UNION ALL SELECT source, external_id, {_ORDER} FROM arrivals_v WHERE external_id IS NULL""")
def _(t):
    # every row arrives twice, in several files and batches, the second time after a restart; rows without a key are added both times
    # three batches of as many files as keep all tasks busy; small row groups, so that a file is read by many tasks
    each = 2 * max(1, int(t.spark.conf.get("spark.sql.shuffle.partitions")) // 6)
    drops, half = scratch_path(t.spark, "stream-drops"), t.lineitem.repartition(3 * each, "l_orderkey")
    table, marks = scratch_path(t.spark, "stream-table"), scratch_path(t.spark, "stream-marks")
    view = VIEWS["arrivals_v"][1]
    for _ in range(2):
        half.write.mode("append").option("parquet.block.size", 16 << 20).parquet(drops)
        source = t.spark.readStream.schema(t.lineitem.schema).option("maxFilesPerTrigger", each).parquet(drops)
        stream.insert_stream(source, lambda files: t.spark.read.parquet(*files),
                             lambda df: df.sparkSession.sql(view, base=df), table, marks, ORDER).awaitTermination()
    return t.spark.read.parquet(table).select("source", "external_id", *ORDER)


def _incoming(t: Tables) -> DataFrame:
    """Company sightings, one per order; some sources carry no board."""
    return t.spark.sql(f"""SELECT concat(CASE WHEN o_orderkey%50=0 THEN 'New ' ELSE '' END, {NAME}, CASE WHEN o_orderkey%2=0 THEN ' Corp' ELSE '' END) AS name,
        CASE o_orderkey%3 WHEN 0 THEN 'lever' WHEN 1 THEN '' ELSE NULL END AS ats_type,
        CASE o_orderkey%3 WHEN 0 THEN concat('t', o_orderkey) WHEN 1 THEN '' ELSE NULL END AS ats_token, o_orderkey AS seq
        FROM {{orders}}""", orders=t.orders)


_INCOMING = f"""SELECT {o.norm('name')} AS name_normalized, * FROM (SELECT (CASE WHEN o_orderkey%50=0 THEN 'New ' ELSE '' END)||{NAME}||(CASE WHEN o_orderkey%2=0 THEN ' Corp' ELSE '' END) AS name,
  CASE o_orderkey%3 WHEN 0 THEN 'lever' WHEN 1 THEN '' ELSE NULL END AS ats_type,
  CASE o_orderkey%3 WHEN 0 THEN 't'||o_orderkey WHEN 1 THEN '' ELSE NULL END AS ats_token, o_orderkey AS seq FROM orders)"""


@query("upsert_company", f"""
WITH u AS (SELECT {o.norm('name')} AS name_normalized, name, ats_type, ats_token, CAST(-1 AS BIGINT) AS seq, sponsor_status FROM companies_v
  UNION ALL SELECT name_normalized, name, ats_type, ats_token, seq, NULL FROM ({_INCOMING}))
SELECT name_normalized, arg_min(name, seq) AS name,
  coalesce(arg_max(ats_type, seq) FILTER (WHERE nullif(ats_type,'') IS NOT NULL), first(ats_type ORDER BY seq)) AS ats_type,
  coalesce(arg_max(ats_token, seq) FILTER (WHERE nullif(ats_token,'') IS NOT NULL), first(ats_token ORDER BY seq)) AS ats_token,
  coalesce(max(sponsor_status),'unknown') AS sponsor_status
FROM u GROUP BY 1""")
def _(t):
    stored = companies(t).select(F.col("id").cast("string").alias("id"), "name", "name_normalized",
                                 "ats_type", "ats_token", "sponsor_status")
    return load.upsert_companies(stored, _incoming(t)).drop("id")


@query("company_lookup", f"""
SELECT i.seq, c.id AS company_id FROM ({_INCOMING}) i JOIN (SELECT id, {o.norm('name')} AS name_normalized FROM companies_v) c USING (name_normalized)""")
def _(t):
    return load.with_company_id(_incoming(t), companies(t)).select("seq", "company_id")


_CYCLE = f"""WITH x AS ({EXPECTED_ALL}), y AS (
SELECT source, external_id, {o.norm('company')} AS company, {o.grad('title', 'description')} AS is_new_grad, 'new' AS status, token, posted_at, seen, ord, pos FROM x)"""


def _cycle(t: Tables, keys: DataFrame | KeyStore | None = None, details: DataFrame | None = None) -> cycle.Cycle:
    """A poll; by default the first one, with nothing stored yet."""
    none = t.spark.createDataFrame([], "id string, name string, name_normalized string, ats_type string, "
                                       "ats_token string, sponsor_score decimal(4,3), sponsor_status string")
    if keys is None:
        keys = t.spark.createDataFrame([], "source string, external_id string")
    return cycle.poll(landing(t), none, keys, F.lit(ORDERS_AS_OF).cast("timestamp"), details=details)


@query("poll_cycle", f"{_CYCLE} SELECT source, external_id, company, is_new_grad, status FROM y")
def _(t):
    done = _cycle(t)
    names = done.companies.select(F.col("id").alias("company_id"), F.col("name_normalized").alias("company"))
    return (done.new_jobs.join(names.hint("merge"), "company_id")
            .select("source", "external_id", "company", "is_new_grad", "status"))


@query("poll_cycle_alerts", f"""{_CYCLE}
SELECT source, external_id, alert_no FROM (SELECT source, external_id, CAST(row_number() OVER (PARTITION BY source ORDER BY token,
    CASE WHEN source='smartrec' THEN posted_at END DESC NULLS LAST, seen, CASE WHEN source='smartrec' THEN ord ELSE 0 END, pos,
    sha256(source||chr(0)||external_id)) AS INT) AS alert_no FROM y WHERE is_new_grad) WHERE alert_no<=15""")
def _(t):
    return _cycle(t).alerts.select("source", "external_id", "alert_no")


_PREFIXES = {"greenhouse": "", "lever": "l", "ashby": "a", "smartrec": "s", "github_repo": "r"}


def _posting_ids(t: Tables, sources: dict[str, str], where: str) -> DataFrame:
    """``source, external_id`` of the two postings of each order."""
    pairs = ", ".join(f"('{s}', '{p}')" for s, p in sources.items())
    return t.spark.sql(f"""SELECT source, concat(prefix, CAST(2*o_orderkey+i AS STRING)) AS external_id, o_orderkey
        FROM {{orders}}, VALUES {pairs} AS s(source, prefix), VALUES (0), (1) AS v(i) WHERE {where}""", orders=t.orders)


@query("poll_cycle_repoll", f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY source, token ORDER BY
    CASE WHEN source='smartrec' THEN posted_at END DESC NULLS LAST, seen, pos, external_id) AS rank FROM ({EXPECTED_ALL}) WHERE ord%2<>0),
d AS (SELECT *, source='smartrec' AND rank<=40 OR source='greenhouse' AND rank<=25 AS hit FROM x),
y AS (SELECT source, external_id, title, CASE WHEN hit THEN CASE WHEN ord%3=0 THEN 'An entry level role' ELSE 'A role' END ELSE description END AS description FROM d)
SELECT source, external_id, description, {o.grad('title', 'description')} AS is_new_grad FROM y""")
def _(t):
    # half of the postings are stored; two providers give details for any posting
    stored = _posting_ids(t, _PREFIXES, "o_orderkey%2=0").select("source", "external_id")
    some = {s: _PREFIXES[s] for s in ("greenhouse", "smartrec")}
    details = _posting_ids(t, some, "true").select("source", "external_id", F.expr(
        "CASE WHEN o_orderkey%3=0 THEN 'An entry level role' ELSE 'A role' END").alias("description"),
        F.lit(None).cast("string").alias("url"))
    store = KeyStore(t.spark, scratch_path(t.spark, "cycle-store"), load.KEY_TYPES, buckets=8, expected=100_000)
    store.add(stored)
    return _cycle(t, store, details).new_jobs.select("source", "external_id", "description", "is_new_grad")


# --- boards ---------------------------------------------------------------------

_HEALTH_STATUS = "CASE WHEN o_orderkey%7=0 THEN 404 WHEN o_orderkey%7=1 THEN 503 ELSE 200 END"


def _health_landing(t: Tables) -> DataFrame:
    """Responses per watched board, several per board, in the provider shapes."""
    n = "CAST(o_orderkey%4 AS INT)"
    cut = "o_orderkey%13=0"  # answers that cannot be read
    jobs_ = f"CASE WHEN {n}=0 THEN array() ELSE transform(sequence(1, {n}), i -> named_struct('id', i)) END"
    body = f"""CASE o_custkey%4 WHEN 1 THEN to_json({jobs_}) WHEN 3 THEN to_json(named_struct('totalFound', {n}))
        ELSE to_json(named_struct('jobs', {jobs_})) END"""
    return t.spark.sql(f"""SELECT split_part('greenhouse,lever,ashby,smartrecruiters',',',CAST(o_custkey%4+1 AS INT)) AS ats,
        concat('Board', o_custkey) AS token, o_orderdate + make_dt_interval(0,0,0,o_orderkey) AS fetched_at,
        {_HEALTH_STATUS} AS status, CASE WHEN {cut} THEN '<html>' ELSE {body} END AS body FROM {{orders}}""", orders=t.orders)


_HEALTH = f"""WITH l AS (SELECT o_custkey, CASE WHEN o_orderkey%13<>0 THEN o_orderkey%4 END AS n, {_HEALTH_STATUS} AS status,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate + to_seconds(o_orderkey) DESC) AS rn FROM orders),
h AS (SELECT w.ats, w.token, coalesce(l.status=200 AND n IS NOT NULL AND NOT (w.ats='smartrecruiters' AND n=0), false) AS alive,
  CASE WHEN l.status=200 THEN n END AS postings,
  CASE WHEN l.status IS NULL THEN 'no response' WHEN l.status=404 THEN '404' WHEN l.status<>200 THEN 'HTTP '||l.status
    WHEN n IS NULL THEN 'unreadable answer' WHEN w.ats='smartrecruiters' AND n=0 THEN '0 postings (token likely wrong — SR never 404s)' ELSE n||' postings' END AS detail
  FROM watchlist_v w LEFT JOIN l ON l.o_custkey=w.board AND rn=1)"""


@query("board_health", f"{_HEALTH} SELECT * FROM h")
def _(t):
    return health.board_health(t.watchlist_v.select("ats", "token"), _health_landing(t))


@query("dead_boards", f"{_HEALTH} SELECT ats, CAST(count(*) AS BIGINT) AS boards, CAST(count(*) FILTER (WHERE NOT alive) AS BIGINT) AS dead FROM h GROUP BY 1")
def _(t):
    return health.dead_boards(health.board_health(t.watchlist_v.select("ats", "token"), _health_landing(t)))


@query("watchlist_coverage", """
SELECT ats, token, CAST((SELECT count(*) FROM orders WHERE o_custkey=board) AS BIGINT) AS responses FROM watchlist_v""")
def _(t):
    return watchlist.coverage(t.watchlist_v, _health_landing(t))


# --- constraints ----------------------------------------------------------------

@query("duplicate_keys", """
SELECT source, external_id, CAST(count(*) AS BIGINT) AS n FROM arrivals_v WHERE external_id IS NOT NULL GROUP BY 1,2 HAVING count(*)>1""")
def _(t):
    return checks.duplicate_keys(t.arrivals_v, "source", "external_id")


@query("orphan_references", """
SELECT o_custkey, o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey)""")
def _(t):
    return checks.orphans(t.orders, "o_orderkey", t.lineitem, "l_orderkey").select("o_custkey", "o_orderkey")


@query("one_target", """
SELECT o_orderkey, (o_orderkey%3=0) <> (o_custkey%2=0) AS valid FROM orders""")
def _(t):
    rows = t.orders.withColumns({"application_id": F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")),
                                 "contact_id": F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey"))})
    return rows.select("o_orderkey", checks.exactly_one("application_id", "contact_id").alias("valid"))


@query("unexpected_status", """
SELECT status, CAST(count(*) AS BIGINT) AS n FROM applications_v WHERE status NOT IN ('submitted','oa','phone','onsite','offer') GROUP BY 1""")
def _(t):
    return checks.unexpected_values(t.applications_v, "status", ("submitted", "oa", "phone", "onsite", "offer"))
