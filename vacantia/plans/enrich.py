"""Queries on names, titles, duplicates, sponsors, alerts and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions import scoring, similarity, text
from vacantia.operators import alerts, dedup, load, retention, runlog, sponsor
from vacantia.plans import oracle_parts as o
from vacantia.plans.registry import Tables, query
from vacantia.session import scratch_path, stash

ORDERS_AS_OF = "2001-08-01"
EVENTS_AS_OF = "2024-02-15"


def at(day: str):
    return F.lit(day).cast("timestamp_ntz")


def companies(t: Tables) -> DataFrame:
    """Companies with their identity key and score."""
    return t.companies_v.withColumns({
        "name_normalized": text.normalize_company(F.col("name")),
        "sponsor_score": scoring.score_value(F.col("score_milli"))}).drop("score_milli")


def jobs(t: Tables) -> DataFrame:
    """Postings with the new-grad flag."""
    return t.jobs_v.withColumns({
        "is_new_grad": text.is_new_grad(F.col("title"), F.col("description")),
        "fit_score": scoring.score_value(F.col("fit_milli"))}).drop("fit_milli")


def filings(t: Tables) -> DataFrame:
    return t.filings_v.withColumn("employer_norm", text.normalize_company(F.col("employer_raw")))


# --- text functions -------------------------------------------------------------

@query("normalize_company", f"""
SELECT id, name, {o.norm('name')} AS name_normalized FROM companies_v""")
def _(t):
    return t.companies_v.select("id", "name", text.normalize_company(F.col("name")).alias("name_normalized"))


@query("new_grad_flag", f"""
SELECT id, title, {o.grad('title', 'description')} AS is_new_grad FROM jobs_v""")
def _(t):
    return jobs(t).select("id", "title", "is_new_grad")


@query("new_grad_filter", f"""
SELECT id, title FROM jobs_v WHERE {o.grad('title', 'description')}""")
def _(t):
    return jobs(t).filter("is_new_grad").select("id", "title")


@query("new_grad_text_scan", f"""
SELECT doc_id, {o.grad("source", "text")} AS flagged FROM documents""")
def _(t):
    return t.documents.select("doc_id", text.is_new_grad(F.col("source"), F.col("text")).alias("flagged"))


@query("first_non_empty", """
SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey%3=0 THEN '' WHEN o_orderkey%3=1 THEN NULL ELSE o_orderstatus END,''),
  nullif(o_orderpriority,'')) AS chosen FROM orders""")
def _(t):
    first = F.expr("CASE WHEN o_orderkey%3=0 THEN '' WHEN o_orderkey%3=1 THEN NULL ELSE o_orderstatus END")
    return t.orders.select("o_orderkey", text.first_non_empty(first, F.col("o_orderpriority")).alias("chosen"))


@query("location_groups", """
SELECT company_id, CASE WHEN location IS NULL THEN '' ELSE '='||lower(trim(location)) END AS place,
  CAST(count(*) AS BIGINT) AS postings FROM jobs_v GROUP BY ALL""")
def _(t):
    return (t.jobs_v.groupBy("company_id", text.location_key(F.col("location")).alias("place"))
            .agg(F.count("*").alias("postings")))


@query("token_sort_ratio", f"""
SELECT p, a, b, 200.0::DOUBLE*{o.lcs('a', 'b')}/(length(a)+length(b)) AS ratio
FROM (SELECT p_partkey AS p, {o.tokens('p_name')} AS a, {o.tokens("p_brand||' '||p_type")} AS b FROM part)""")
def _(t):
    key = similarity.sorted_tokens
    pairs = t.part.select(F.col("p_partkey").alias("p"), key(F.col("p_name")).alias("a"),
                          key(F.concat("p_brand", F.lit(" "), "p_type")).alias("b"))
    n = F.length("a") + F.length("b")
    return (pairs.withColumn("lcs", similarity.lcs_length("a", "b"))
            .select("p", "a", "b", (F.col("lcs") * F.lit(200.0) / n).alias("ratio")))


@query("trigram_similarity", f"""
SELECT p_partkey, CAST(len(list_intersect(x,y)) AS INT) AS common,
  CAST(len(x)+len(y)-len(list_intersect(x,y)) AS INT) AS united
FROM (SELECT p_partkey, {o.trigrams('p_name')} AS x, {o.trigrams("p_type||' '||p_brand")} AS y FROM part)""")
def _(t):
    x, y = similarity.trigrams(F.col("p_name")), similarity.trigrams(F.concat("p_type", F.lit(" "), "p_brand"))
    common, union = similarity.trigram_counts(x, y)
    return t.part.select("p_partkey", common.alias("common"), union.alias("united"))


@query("fiscal_year", """
SELECT o_orderkey, CAST(year(o_orderdate) + CASE WHEN month(o_orderdate)>=10 THEN 1 ELSE 0 END AS INT) AS fiscal_year
FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", scoring.fiscal_year(F.col("o_orderdate")).alias("fiscal_year"))


_CRC = ("xor(list_reduce(list_transform(range(1,length(s)+1), lambda i: ord(substr(s,i,1))::BIGINT), lambda c, b: "
        "list_reduce(range(8), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295)")


@query("shard_assign", f"""
SELECT ats, token, CAST({_CRC} % 4 AS BIGINT) AS shard FROM (SELECT ats, token, lower(token) AS s FROM watchlist_v)""")
def _(t):
    return t.watchlist_v.select("ats", "token", text.shard_of(F.col("token"), 4).alias("shard"))


# --- alerts ---------------------------------------------------------------------

_ALERT = f"""
SELECT j.*, c.name AS company, c.sponsor_status FROM
  (SELECT *, 'run'||CAST(month(first_seen_at) AS STRING) AS run_id FROM jobs_v WHERE {o.grad('title', 'description')}) j
  JOIN companies_v c ON c.id = j.company_id"""


def _runs(t: Tables) -> DataFrame:
    return jobs(t).withColumn("run_id", F.concat(F.lit("run"), F.month("first_seen_at")))


@query("alert_feed", f"""
WITH a AS ({_ALERT})
SELECT source, run_id, id, alert_no, content FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY source, run_id ORDER BY first_seen_at, id) AS INT) AS alert_no,
    {o.badge('sponsor_status')}||' **'||company||'** — '||title||' ('||coalesce(nullif(location,''),'location n/a')||')'||chr(10)||url AS content
  FROM a) WHERE alert_no<=15""")
def _(t):
    return (alerts.select_alerts(_runs(t), companies(t))
            .select("source", "run_id", "id", "alert_no", "content"))


@query("alert_feed_unsent", f"""
WITH a AS ({_ALERT})
SELECT source, run_id, id, alert_no FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY source, run_id ORDER BY first_seen_at, id) AS INT) AS alert_no
  FROM a WHERE id NOT IN (SELECT job_id FROM applications_v)) WHERE alert_no<=15""")
def _(t):
    return (alerts.select_alerts(_runs(t), companies(t), notified=t.applications_v)
            .select("source", "run_id", "id", "alert_no"))


@query("jobs_with_company", """
SELECT j.id, c.name AS company, c.sponsor_status FROM jobs_v j JOIN companies_v c ON c.id=j.company_id""")
def _(t):
    return alerts.with_company(t.jobs_v, companies(t)).select("id", "company", "sponsor_status")


@query("badge_counts", f"""
SELECT {o.badge('sponsor_status')} AS badge, CAST(count(*) AS BIGINT) AS n FROM companies_v GROUP BY 1""")
def _(t):
    return t.companies_v.groupBy(text.badge(F.col("sponsor_status")).alias("badge")).agg(F.count("*").alias("n"))


# --- sponsors -------------------------------------------------------------------

_EMPLOYERS = f"""employers AS (
  SELECT {o.norm('employer_raw')} AS employer_norm, CAST(sum(initial_approvals) AS BIGINT) AS approvals,
    CAST(sum(initial_denials) AS BIGINT) AS denials, max(fiscal_year) AS latest_year
  FROM filings_v GROUP BY 1)"""

_MATCH = f"""unknown AS (
  SELECT DISTINCT {o.norm('name')} AS name_normalized FROM companies_v WHERE sponsor_status='unknown'),
lefts AS (SELECT name_normalized, {o.tokens('name_normalized')} AS a, {o.trigrams('name_normalized')} AS x FROM unknown),
rights AS (SELECT employer_norm, {o.tokens('employer_norm')} AS b, {o.trigrams('employer_norm')} AS y FROM employers),
near AS MATERIALIZED (SELECT name_normalized, employer_norm, a, b FROM lefts, rights
  WHERE 200*least(length(a),length(b)) >= 90*(length(a)+length(b))
    AND 10*len(list_intersect(x,y)) >= 3*(len(x)+len(y)-len(list_intersect(x,y)))),
scored AS MATERIALIZED (SELECT name_normalized, employer_norm, {o.lcs('a', 'b')} AS l, length(a)+length(b) AS n FROM near),
hits AS (SELECT name_normalized, employer_norm, 200.0::DOUBLE*l/n AS ratio FROM scored WHERE 200*l >= 90*n),
best AS (SELECT name_normalized, employer_norm, ratio FROM (
  SELECT *, row_number() OVER (PARTITION BY name_normalized ORDER BY ratio DESC, employer_norm) AS rn FROM hits) WHERE rn=1)"""

_FY = 2001
_SCORES = f"""WITH {_EMPLOYERS}, {_MATCH},
scores AS (SELECT c.id, c.name_normalized, b.employer_norm,
    CAST(CASE WHEN b.employer_norm IS NULL THEN 0 ELSE {o.milli('e.approvals', 'e.denials', 'e.latest_year', str(_FY))}/1000.0 END AS DECIMAL(4,3)) AS sponsor_score,
    CASE WHEN b.employer_norm IS NULL THEN 'unknown' ELSE {o.status(o.milli('e.approvals', 'e.denials', 'e.latest_year', str(_FY)))} END AS sponsor_status
  FROM (SELECT id, {o.norm('name')} AS name_normalized FROM companies_v WHERE sponsor_status='unknown') c
  LEFT JOIN best b USING (name_normalized) LEFT JOIN employers e ON e.employer_norm=b.employer_norm)"""


def _scores(t: Tables) -> DataFrame:
    return sponsor.score_companies(companies(t), t.filings_v, at(ORDERS_AS_OF))


@query("employer_aggregate", f"WITH {_EMPLOYERS} SELECT * FROM employers")
def _(t):
    return sponsor.employer_totals(filings(t))


@query("employer_totals_reloaded", f"""
SELECT {o.norm('employer_raw')} AS employer_norm, CAST(sum(initial_approvals + fiscal_year%2) AS BIGINT) AS approvals,
  CAST(sum(initial_denials) AS BIGINT) AS denials, max(fiscal_year) AS latest_year FROM filings_v GROUP BY 1""")
def _(t):
    # odd years are one slice and are loaded again with one approval more; the other slice is read once, for its first totals
    odd, path = F.col("fiscal_year") % 2 == 1, scratch_path(t.spark, "slice-totals")
    both = filings(t).withColumn("src", F.when(odd, "uscis_hub").otherwise("dol_lca"))
    load.write_slice(sponsor.slice_totals(both), path)
    again = both.filter(odd).withColumn("initial_approvals", F.col("initial_approvals") + 1)
    load.write_slice(sponsor.slice_totals(again), path)
    return sponsor.totals_of_slices(t.spark.read.parquet(path))


@query("sponsor_score", f"""
WITH {_EMPLOYERS}, m AS (SELECT employer_norm, {o.milli('approvals', 'denials', 'latest_year', str(_FY))} AS milli FROM employers)
SELECT employer_norm, CAST(milli/1000.0 AS DECIMAL(4,3)) AS sponsor_score, {o.status('milli')} AS sponsor_status FROM m""")
def _(t):
    milli = scoring.score_milli(F.col("approvals"), F.col("denials"), F.col("latest_year"),
                                scoring.fiscal_year(at(ORDERS_AS_OF)))
    return sponsor.employer_totals(filings(t)).select(
        "employer_norm", scoring.score_value(milli).alias("sponsor_score"),
        scoring.score_status(milli).alias("sponsor_status"))


@query("unknown_companies", """
SELECT id, name FROM companies_v WHERE sponsor_status='unknown'""")
def _(t):
    return sponsor.unknown_companies(companies(t)).select("id", "name")


@query("sponsor_match", f"WITH {_EMPLOYERS}, {_MATCH} SELECT name_normalized, employer_norm, ratio FROM best")
def _(t):
    todo = sponsor.unknown_companies(companies(t))
    totals = stash(sponsor.employer_totals(t.filings_v), "sponsor-totals")
    return sponsor.best_employer(todo, totals)


@query("sponsor_scores", f"{_SCORES} SELECT * FROM scores")
def _(t):
    return _scores(t)


@query("sponsor_apply", f"""{_SCORES}
SELECT c.id, CASE WHEN s.sponsor_status<>'unknown' THEN s.sponsor_score ELSE CAST(c.score_milli/1000.0 AS DECIMAL(4,3)) END AS sponsor_score,
  CASE WHEN s.sponsor_status<>'unknown' THEN s.sponsor_status ELSE c.sponsor_status END AS sponsor_status
FROM companies_v c LEFT JOIN scores s ON s.id=c.id""")
def _(t):
    return sponsor.apply_scores(companies(t), _scores(t)).select("id", "sponsor_score", "sponsor_status")


@query("sponsor_run_detail", f"""{_SCORES}, n AS (SELECT sponsor_status||'='||CAST(count(*) AS STRING) AS part FROM scores GROUP BY sponsor_status)
SELECT 'sponsor_match' AS source, true AS ok, coalesce(nullif(string_agg(part, ', ' ORDER BY part),''),'0 companies') AS detail FROM n""")
def _(t):
    _, log = sponsor.scoring_run(companies(t), t.filings_v, at(ORDERS_AS_OF))
    return log.select("source", "ok", "detail")


@query("sponsor_gate", """
SELECT 'sponsor_match' AS source, count(*)>0 AS ok,
  CASE WHEN count(*)=0 THEN 'no sponsor data' ELSE 'ready' END AS detail FROM filings_v WHERE fiscal_year>2100""")
def _(t):
    # No filing is that recent: the gate has to report a failed run.
    scores, log = sponsor.scoring_run(companies(t), filings(t).filter("fiscal_year > 2100"), at(ORDERS_AS_OF))
    return log.select("source", "ok", "detail")


# --- duplicates -----------------------------------------------------------------

_CANDIDATES = f"""cand AS (
  SELECT j.id, {o.norm('c.name')} AS company_norm, j.title, j.location, j.source, j.first_seen_at
  FROM jobs_v j JOIN companies_v c ON c.id=j.company_id WHERE j.status='new')"""

_PAIRS = f"""keyed AS (
  SELECT id, source, first_seen_at, company_norm, CASE WHEN location IS NULL THEN '' ELSE '='||lower(trim(location)) END AS place,
    {o.tokens('title')} AS tk FROM cand),
titles AS (SELECT DISTINCT tk FROM keyed),
alike AS MATERIALIZED (SELECT a.tk AS a, b.tk AS b FROM titles a, titles b
  WHERE 200*{o.lcs('a.tk', 'b.tk')} >= 92*(length(a.tk)+length(b.tk)))"""

_DECISIONS = f"""{_CANDIDATES}, {_PAIRS},
edges AS MATERIALIZED (
  SELECT l.id AS later, e.id AS earlier FROM keyed l JOIN keyed e
    ON l.company_norm=e.company_norm AND l.place=e.place
    AND (e.first_seen_at<l.first_seen_at OR (e.first_seen_at=l.first_seen_at AND e.id<l.id))
    AND l.first_seen_at<=e.first_seen_at + INTERVAL 14 DAY
  JOIN alike ON alike.a=l.tk AND alike.b=e.tk),
asks AS MATERIALIZED (
  SELECT k.id, row_number() OVER (ORDER BY k.first_seen_at, k.id) AS n, x.earlier
  FROM keyed k JOIN (SELECT later, list(earlier) AS earlier FROM edges GROUP BY later) x ON x.later=k.id),
walk AS (
  SELECT 0::BIGINT AS n, []::BIGINT[] AS dropped
  UNION ALL
  SELECT a.n, CASE WHEN len(list_filter(a.earlier, lambda e: NOT list_contains(w.dropped, e)))>0
                   THEN list_append(w.dropped, a.id) ELSE w.dropped END
  FROM walk w JOIN asks a ON a.n=w.n+1),
gone AS (SELECT unnest(dropped) AS id FROM (SELECT dropped FROM walk ORDER BY n DESC LIMIT 1)),
decisions AS (
  SELECT later AS dup_id, kept_id, 'duplicate of '||CAST(kept_id AS STRING)||' via '||source AS note FROM (
    SELECT x.later, k.id AS kept_id, k.source,
      row_number() OVER (PARTITION BY x.later ORDER BY k.first_seen_at, k.id) AS rn
    FROM edges x JOIN gone g ON g.id=x.later JOIN keyed k ON k.id=x.earlier
    WHERE x.earlier NOT IN (SELECT id FROM gone)) WHERE rn=1)"""


def _new_jobs(t: Tables) -> DataFrame:
    return dedup.candidates(t.jobs_v, companies(t), None)


@query("dedup_candidates", f"""
SELECT j.id, {o.norm('c.name')} AS company_norm, j.title FROM jobs_v j JOIN companies_v c ON c.id=j.company_id
WHERE j.status='new' AND j.first_seen_at > TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 30 DAY""")
def _(t):
    return dedup.candidates(t.jobs_v, companies(t), at(ORDERS_AS_OF)).select("id", "company_norm", "title")


@query("dedup_title_pairs", f"""WITH {_CANDIDATES}, {_PAIRS},
g AS (SELECT DISTINCT company_norm, place, tk FROM keyed)
SELECT x.company_norm, x.place, x.tk AS first_title, y.tk AS second_title
FROM g x JOIN g y ON x.company_norm=y.company_norm AND x.place=y.place AND x.tk<y.tk
JOIN alike ON alike.a=x.tk AND alike.b=y.tk""")
def _(t):
    titles = dedup.keyed(_new_jobs(t)).select(*dedup.TITLE).distinct()
    return dedup.similar_titles(titles).select(
        "company_norm", "place", F.least("a", "b").alias("first_title"),
        F.greatest("a", "b").alias("second_title"))


@query("dedup_decisions", f"WITH RECURSIVE {_DECISIONS} SELECT dup_id, kept_id, note FROM decisions")
def _(t):
    return dedup.find_duplicates(_new_jobs(t))


@query("dedup_decisions_crowded", f"WITH RECURSIVE {_DECISIONS} SELECT dup_id, kept_id, note FROM decisions")
def _(t):
    """Groups of more than four titles take the way of crowded groups: segment keys, batch by batch."""
    return dedup.find_duplicates(_new_jobs(t), direct=4, first_batch=8)


@query("dedup_incremental", f"""WITH RECURSIVE {_DECISIONS}, split AS (SELECT to_timestamp(median(epoch(first_seen_at))) AS at FROM cand),
second AS (SELECT cand.id FROM cand, split WHERE first_seen_at >= split.at)
SELECT dup_id, kept_id, note, CASE WHEN second.id IS NULL THEN 1 ELSE 2 END AS run FROM decisions LEFT JOIN second ON second.id = dup_id""")
def _(t):
    """Two runs in the order of time decide as one; a third one finds nothing new."""
    rows = stash(_new_jobs(t), "incremental-rows")
    split = rows.agg(F.percentile(F.unix_seconds(F.col("first_seen_at").cast("timestamp")), 0.5)).first()[0] or 0
    later = F.unix_seconds(F.col("first_seen_at").cast("timestamp")) >= split
    out, kept = None, rows.limit(0)
    for run, new in enumerate((rows.filter(~later), rows.filter(later), rows.filter(later).limit(0)), 1):
        found = stash(dedup.find_duplicates(new, kept_before=kept), "incremental-found")
        kept = stash(kept.unionByName(new.join(found.select(F.col("dup_id").alias("id")), "id", "left_anti").select(*rows.columns)),
                     "incremental-kept")
        part = found.withColumn("run", F.lit(run))
        out = part if out is None else out.unionByName(part)
    return out


@query("dedup_apply", f"""WITH RECURSIVE {_DECISIONS}
SELECT j.id, CASE WHEN d.dup_id IS NOT NULL THEN 'skipped' ELSE j.status END AS status, d.note
FROM jobs_v j LEFT JOIN decisions d ON d.dup_id=j.id""")
def _(t):
    rows = t.jobs_v.withColumn("note", F.lit(None).cast("string"))
    return (dedup.apply_duplicates(rows, dedup.find_duplicates(_new_jobs(t)))
            .select("id", "status", "note"))


@query("dedup_summary", f"""WITH RECURSIVE {_DECISIONS},
n AS (SELECT (SELECT count(*) FROM decisions) AS duplicates, (SELECT count(*) FROM cand) AS candidates)
SELECT duplicates, candidates, CAST(duplicates AS STRING)||' duplicates skipped of '||CAST(candidates AS STRING)||' candidates' AS detail FROM n""")
def _(t):
    rows = _new_jobs(t)
    return dedup.run_counts(rows, dedup.find_duplicates(rows))


@query("earliest_per_company", """
SELECT company_id, id, first_seen_at FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY first_seen_at, id) AS rn FROM jobs_v) WHERE rn=1""")
def _(t):
    first = F.min_by(F.struct("id", "first_seen_at"), F.struct("first_seen_at", "id"))
    return t.jobs_v.groupBy("company_id").agg(first.alias("f")).select("company_id", "f.*")


# --- retention ------------------------------------------------------------------

_STALE = f"""first_seen_at < TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 30 DAY
  AND (NOT coalesce({o.grad('title', 'description')}, false) OR first_seen_at < TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 90 DAY)
  AND NOT EXISTS (SELECT 1 FROM applications_v a WHERE a.job_id=j.id)
  AND NOT EXISTS (SELECT 1 FROM resumes_v r WHERE r.job_id=j.id)"""


@query("retention_postings", f"SELECT id, first_seen_at FROM jobs_v j WHERE NOT ({_STALE})")
def _(t):
    kept = retention.retained_jobs(jobs(t), t.applications_v, t.resumes_v, at(ORDERS_AS_OF))
    return kept.select("id", "first_seen_at")


@query("retention_doomed", f"SELECT id, first_seen_at FROM jobs_v j WHERE {_STALE}")
def _(t):
    gone = retention.doomed_jobs(jobs(t), t.applications_v, t.resumes_v, at(ORDERS_AS_OF))
    return gone.select("id", "first_seen_at")


@query("retention_run_log", f"""
SELECT source, ok, ran_at, detail FROM run_log_v WHERE NOT (ran_at < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 30 DAY)""")
def _(t):
    return retention.retained_run_log(t.run_log_v, at(EVENTS_AS_OF))


@query("retention_summary", f"""
WITH n AS (SELECT (SELECT count(*) FROM jobs_v j WHERE {_STALE.replace(ORDERS_AS_OF, EVENTS_AS_OF)}) AS jobs_pruned,
  (SELECT count(*) FROM run_log_v WHERE ran_at < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 30 DAY) AS run_log_pruned)
SELECT *, CAST(jobs_pruned AS STRING)||' jobs, '||CAST(run_log_pruned AS STRING)||' heartbeats pruned' AS detail FROM n""")
def _(t):
    return retention.retention_counts(jobs(t), t.applications_v, t.resumes_v, t.run_log_v, at(EVENTS_AS_OF))


@query("enrichment_run_log", f"""WITH RECURSIVE {_DECISIONS},
n AS (SELECT (SELECT count(*) FROM decisions) AS duplicates, (SELECT count(*) FROM cand) AS candidates),
r AS (SELECT (SELECT count(*) FROM jobs_v j WHERE {_STALE.replace(ORDERS_AS_OF, EVENTS_AS_OF)}) AS jobs_pruned,
  (SELECT count(*) FROM run_log_v WHERE ran_at < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 30 DAY) AS run_log_pruned)
SELECT 'dedup' AS source, true AS ok, TIMESTAMP '{EVENTS_AS_OF}' AS ran_at, CAST(duplicates AS STRING)||' duplicates skipped of '||CAST(candidates AS STRING)||' candidates' AS detail FROM n
UNION ALL SELECT 'retention', true, TIMESTAMP '{EVENTS_AS_OF}', CAST(jobs_pruned AS STRING)||' jobs, '||CAST(run_log_pruned AS STRING)||' heartbeats pruned' FROM r""")
def _(t):
    """The rows that the duplicate and the retention run append to the run log, read from the log again."""
    rows, path = _new_jobs(t), scratch_path(t.spark, "run-log")
    now = F.lit(EVENTS_AS_OF).cast("timestamp")
    runlog.append_run_log(dedup.run_log(rows, dedup.find_duplicates(rows), now), path)
    runlog.append_run_log(retention.run_log(jobs(t), t.applications_v, t.resumes_v, t.run_log_v, now), path)
    return t.spark.read.parquet(path)


@query("unreferenced_jobs", """
SELECT id FROM jobs_v j WHERE NOT EXISTS (SELECT 1 FROM applications_v a WHERE a.job_id=j.id)
  AND NOT EXISTS (SELECT 1 FROM resumes_v r WHERE r.job_id=j.id)""")
def _(t):
    refs = retention.references(t.applications_v, t.resumes_v).withColumnRenamed("job_id", "id")
    return t.jobs_v.join(refs, "id", "left_anti").select("id")


@query("not_true_flag", f"""
SELECT id, coalesce(NOT f, true) AS not_new_grad FROM (
  SELECT id, CASE WHEN location IS NULL THEN NULL ELSE {o.grad('title', 'description')} END AS f FROM jobs_v)""")
def _(t):
    flag = F.when(F.col("location").isNotNull(), F.col("is_new_grad"))
    return jobs(t).select("id", (~flag.eqNullSafe(True)).alias("not_new_grad"))
