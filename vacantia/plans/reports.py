"""Queries on metrics, triage, links, keywords, follow-ups and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as fv
from vacantia.functions.text import badge
from vacantia.operators import followups, metrics, runlog, triage
from vacantia.operators.alerts import with_company
from vacantia.plans import oracle_parts as o
from vacantia.plans.enrich import ORDERS_AS_OF, at, companies, jobs
from vacantia.plans.registry import Tables, query

# --- funnel and channels ----------------------------------------------------------

def _among(states: tuple[str, ...]) -> str:
    return f"CAST(coalesce(sum(CASE WHEN list_contains({list(states)!r}, status) THEN 1 ELSE 0 END), 0) AS BIGINT)"


@query("funnel", f"""
SELECT count(status) AS applied, {_among(fv.RESPONDED)} AS responded, {_among(fv.INTERVIEWING)} AS interviewing,
  {_among(('offer',))} AS offers FROM applications_v""")
def _(t):
    return metrics.funnel(t.applications_v)


@query("channel_performance", """
SELECT channel, count(*) AS n, CAST(round(CAST(count(*) FILTER (WHERE status NOT IN ('submitted','ghosted','rejected')) * 100000000 // count(*) AS DECIMAL(20,0))/1000000, 1) AS DECIMAL(10,1)) AS positive_pct
FROM applications_v GROUP BY 1""")
def _(t):
    return metrics.channel_performance(t.applications_v)


@query("apply_speed", "SELECT median(CAST(minutes_after_posting AS DOUBLE)) AS median_minutes FROM applications_v")
def _(t):
    return metrics.apply_speed(t.applications_v)


@query("apply_speed_nanos", """
SELECT median(CAST(60000000000 * minutes_after_posting + job_id AS DOUBLE)) AS median_nanos FROM applications_v""")
def _(t):
    # nearly all values differ
    nanos = t.applications_v.select((F.lit(60_000_000_000) * F.col("minutes_after_posting") + F.col("job_id")).alias("nanos"))
    return t.spark.createDataFrame([(metrics.median(nanos, "nanos"),)], "median_nanos double")


@query("weekly_activity", """
WITH a AS (SELECT CAST(date_trunc('week', applied_at) AS TIMESTAMP) AS week, count(*) AS applications FROM applications_v GROUP BY 1),
i AS (SELECT CAST(date_trunc('week', occurred_at) AS TIMESTAMP) AS week, count(*) AS n FROM interactions_v WHERE direction='outbound' GROUP BY 1)
SELECT week, applications, coalesce(n,0) AS outreach FROM a LEFT JOIN i USING (week)""")
def _(t):
    return metrics.weekly_activity(t.applications_v, t.interactions_v)


@query("weekly_outreach", """
WITH a AS (SELECT CAST(date_trunc('week', l_shipdate + INTERVAL '8000' DAY) AS TIMESTAMP) AS week, count(*) AS applications FROM lineitem GROUP BY 1),
i AS (SELECT CAST(date_trunc('week', occurred_at) AS TIMESTAMP) AS week, count(*) AS n FROM interactions_v WHERE direction='outbound' GROUP BY 1)
SELECT week, applications, coalesce(n,0) AS outreach FROM a LEFT JOIN i USING (week)""")
def _(t):
    # Shipments moved into the years of the events table, so that weeks overlap.
    apps = t.lineitem.select((F.col("l_shipdate") + F.expr("INTERVAL '8000' DAY")).alias("applied_at"))
    return metrics.weekly_activity(apps, t.interactions_v)


@query("apply_queue", """
SELECT id, company, title, fit_score, sponsor_status, url, priority FROM (
  SELECT j.id, c.name AS company, j.title, CAST(fit_milli/1000.0 AS DECIMAL(4,3)) AS fit_score, c.sponsor_status, j.url,
    CAST(CAST(fit_milli/1000.0 AS DECIMAL(4,3))*CAST(score_milli/1000.0 AS DECIMAL(4,3)) AS DECIMAL(9,6)) AS priority
  FROM jobs_v j JOIN companies_v c ON c.id=j.company_id WHERE j.status='queued') ORDER BY priority DESC NULLS LAST, id LIMIT 25""")
def _(t):
    return metrics.apply_queue(jobs(t), companies(t))


@query("due_follow_ups", f"""
SELECT id, due_at, action FROM follow_ups_v WHERE NOT done AND due_at < TIMESTAMP '{ORDERS_AS_OF}' + INTERVAL 1 DAY""")
def _(t):
    return metrics.due_follow_ups(t.follow_ups_v, at(ORDERS_AS_OF)).select("id", "due_at", "action")


def _pct(part: str, whole: str) -> str:
    """Half-up percentage with one decimal, in integers."""
    return f"CAST((2000*({part})+greatest({whole},1))//(2*greatest({whole},1))/10.0 AS DECIMAL(10,1))"


@query("response_by_channel", f"""
WITH n AS (SELECT channel, count(*) AS n, count(*) FILTER (WHERE status IN ('oa','phone','onsite','offer')) AS responded FROM applications_v GROUP BY 1)
SELECT channel, n, responded, {_pct('responded', 'n')} AS response_pct FROM n""")
def _(t):
    return metrics.response_by_channel(t.applications_v)


@query("application_shares", f"""
WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE c.sponsor_status='verified') AS v, count(*) FILTER (WHERE a.channel='referral') AS r
  FROM applications_v a LEFT JOIN jobs_v j ON j.id=a.job_id LEFT JOIN companies_v c ON c.id=j.company_id)
SELECT n AS applications, {_pct('v', 'n')} AS verified_pct, {_pct('r', 'n')} AS referral_pct FROM n""")
def _(t):
    return metrics.application_shares(t.applications_v, t.jobs_v, companies(t))


@query("reply_rate", f"""
WITH n AS (SELECT count(*) FILTER (WHERE direction='inbound') AS inbound, count(*) FILTER (WHERE direction='outbound') AS outbound FROM interactions_v)
SELECT inbound, outbound, {_pct('inbound', 'outbound')} AS reply_pct FROM n""")
def _(t):
    return metrics.reply_rate(t.interactions_v)


@query("stage_pass_rates", f"""
WITH n AS (SELECT count(*) FILTER (WHERE status IN ('oa','phone','onsite','offer')) AS assessed,
  count(*) FILTER (WHERE status IN ('phone','onsite','offer')) AS interviewed, count(*) FILTER (WHERE status='offer') AS offered FROM applications_v)
SELECT assessed, interviewed, offered, {_pct('interviewed', 'assessed')} AS interview_pct, {_pct('offered', 'interviewed')} AS offer_pct FROM n""")
def _(t):
    return metrics.stage_pass_rates(t.applications_v)


@query("source_freshness", """
WITH m AS (SELECT source, max(ran_at) FILTER (WHERE ok) AS last_ok FROM run_log_v GROUP BY 1)
SELECT source, last_ok, coalesce(last_ok < TIMESTAMP '2024-01-31' - INTERVAL 60 MINUTE, true) AS red FROM m""")
def _(t):
    return runlog.freshness(t.run_log_v, at("2024-01-31"))


# --- triage -------------------------------------------------------------------------

_FLAG = """CASE WHEN regexp_matches(coalesce({0},''),'unable to sponsor|(not|cannot|can''t|won''t) (offer |provide )?(visa )?sponsor|without (visa )?sponsorship|no (visa )?sponsorship','i') THEN 'jd_says_no_sponsor'
  WHEN regexp_matches(coalesce({0},''),'will sponsor|(visa )?sponsorship (is )?(available|offered|provided)|we sponsor','i') THEN 'jd_says_yes' ELSE 'jd_silent' END"""


@query("visa_flag", f"SELECT id, {_FLAG.format('description')} AS visa_flag FROM jobs_v")
def _(t):
    return t.jobs_v.select("id", triage.visa_flag(F.col("description")).alias("visa_flag"))


@query("visa_flag_documents", f"SELECT doc_id, {_FLAG.format('text')} AS visa_flag FROM documents")
def _(t):
    return t.documents.select("doc_id", triage.visa_flag(F.col("text")).alias("visa_flag"))


@query("triage_routing", f"""
WITH j AS (SELECT j.id, {_FLAG.format('j.description')} AS flag, fit_milli, c.sponsor_status, c.score_milli, j.first_seen_at
  FROM jobs_v j LEFT JOIN companies_v c ON c.id=j.company_id)
SELECT id, CASE WHEN flag='jd_says_no_sponsor' THEN 'skipped' WHEN fit_milli>=550 AND sponsor_status='verified' THEN 'queued' ELSE 'triaged' END AS status,
  CASE WHEN flag<>'jd_says_no_sponsor' AND fit_milli>=550 AND sponsor_status='verified' THEN
    CAST(round(fit_milli/1000.0*score_milli/1000.0*pow(0.5, greatest(0, epoch_us(TIMESTAMP '{ORDERS_AS_OF}')-epoch_us(first_seen_at))/86400000000.0/7.0)*1000000, 3) AS DECIMAL(18,3)) END AS priority_ppm FROM j""")
def _(t):
    flagged = jobs(t).withColumn("visa_flag", triage.visa_flag(F.col("description")))
    fresh = triage.freshness_decay(F.col("first_seen_at"), at(ORDERS_AS_OF))
    return triage.triage(flagged, companies(t), fresh).select(
        "id", "status", F.round(F.col("priority") * 1_000_000, 3).cast("decimal(18,3)").alias("priority_ppm"))


@query("html_job_links", r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)[^>]*>(.*?)</a>', 1)) AS quoted,
  unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)[^>]*>(.*?)</a>', 2)) AS txt FROM pages),
b AS (SELECT *, replace(replace(replace(replace(replace(replace(trim(quoted, '"'''),'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',''''),'&nbsp;',' '),'&amp;','&') AS href FROM a)
SELECT page_id, regexp_replace(href,'[?&]trk=.*$','') AS url, trim(replace(replace(replace(replace(replace(replace(regexp_replace(txt,'<[^>]*>','','g'),'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',''''),'&nbsp;',' '),'&amp;','&')) AS title,
  sha1(regexp_replace(href,'[?&]trk=.*$','')) AS external_id FROM b
WHERE contains(href,'/jobs/view/') OR contains(href,'myworkdayjobs.com') OR contains(href,'/job/')""")
def _(t):
    return triage.job_links(t.pages).select("page_id", "url", "title", "external_id")


@query("mail_job_links", r"""
WITH p AS (SELECT page_id, replace(replace(html, 'href="/', 'href="https://x.myworkdayjobs.com/'), '">', '&amp;trk=' || page_id || '">') AS html FROM pages),
a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)[^>]*>(.*?)</a>', 1)) AS quoted,
  unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)[^>]*>(.*?)</a>', 2)) AS txt FROM p),
b AS (SELECT *, replace(replace(replace(replace(replace(replace(trim(quoted, '"'''),'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',''''),'&nbsp;',' '),'&amp;','&') AS href FROM a)
SELECT page_id, regexp_replace(href,'[?&]trk=.*$','') AS url, trim(replace(replace(replace(replace(replace(replace(regexp_replace(txt,'<[^>]*>','','g'),'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',''''),'&nbsp;',' '),'&amp;','&')) AS title,
  sha1(regexp_replace(href,'[?&]trk=.*$','')) AS external_id FROM b
WHERE contains(href,'/jobs/view/') OR contains(href,'myworkdayjobs.com') OR contains(href,'/job/')""")
def _(t):
    # The pages table has no job links, so its own links are turned into some.
    linked = F.replace(F.col("html"), F.lit('href="/'), F.lit('href="https://x.myworkdayjobs.com/'))
    tracked = F.replace(linked, F.lit('">'), F.concat(F.lit("&amp;trk="), F.col("page_id"), F.lit('">')))
    return (triage.job_links(t.pages.withColumn("html", tracked))
            .select("page_id", "url", "title", "external_id"))


_KEYWORDS = ("The", "tion", "python", "ungs", "être", "ment")


@query("keyword_coverage", f"""
WITH k AS (SELECT doc_id, lower(text) AS x, {list(_KEYWORDS)!r} AS ks FROM documents)
SELECT doc_id, CAST(len(list_filter(ks, lambda k: contains(x, lower(k)))) AS INT) AS hits,
  array_to_string(list_filter(ks, lambda k: NOT contains(x, lower(k))), ',') AS missing FROM k""")
def _(t):
    words = F.array(*[F.lit(k) for k in _KEYWORDS])
    return (triage.keyword_coverage(t.documents.select("doc_id", "text"), "text", words)
            .select("doc_id", "hits", F.array_join("missing", ",").alias("missing")))


@query("unsupported_tokens", r"""
WITH r AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS original FROM conversations)
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text,'\d+|[A-Z][a-zA-Z]+'),
  lambda w: NOT list_contains(regexp_extract_all(original,'\d+|[A-Z][a-zA-Z]+'), w)))), ' ') AS unsupported FROM r""")
def _(t):
    before = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("original"))
    both = t.conversations.join(before, ["conv_id", "turn"], "left")
    bad = triage.unsupported_tokens(F.coalesce("original", F.lit("")), F.col("text"))
    return both.select("conv_id", "turn", F.array_join(bad, " ").alias("unsupported"))


@query("mail_class", """
WITH m AS (SELECT event_id, CASE CAST(floor(value) AS INT)%5 WHEN 0 THEN 'Unfortunately we chose other candidates' WHEN 1 THEN 'Your Online Assessment' WHEN 2 THEN 'Schedule a call for the interview'
  WHEN 3 THEN 'We are pleased to offer you the role' ELSE props END AS subject FROM events)
SELECT event_id, CASE WHEN regexp_matches(subject,'unfortunately|not (be )?moving forward|other candidates|regret','i') THEN 'rejection'
  WHEN regexp_matches(subject,'online assessment|coding (challenge|assessment)|hackerrank|codesignal','i') THEN 'oa'
  WHEN regexp_matches(subject,'offer letter|pleased to offer|extend (you )?an offer','i') THEN 'offer'
  WHEN regexp_matches(subject,'interview|schedule (a )?(call|chat)|phone screen','i') THEN 'interview' ELSE 'other' END AS mail_class FROM m""")
def _(t):
    subject = F.expr("""CASE CAST(floor(value) AS INT)%5 WHEN 0 THEN 'Unfortunately we chose other candidates' WHEN 1 THEN 'Your Online Assessment'
        WHEN 2 THEN 'Schedule a call for the interview' WHEN 3 THEN 'We are pleased to offer you the role' ELSE props END""")
    return t.events.select("event_id", triage.mail_class(subject).alias("mail_class"))


# --- follow-ups -----------------------------------------------------------------------

_CONTACT_EVENTS = """e AS (
  SELECT c.c_custkey AS contact_id, CASE WHEN l.contact_id IS NULL THEN 'new_contact' WHEN l.channel IN ('phone','irl') THEN 'call'
      WHEN l.direction='outbound' AND sent>1 THEN 'bump_no_reply' WHEN l.direction='outbound' THEN 'outbound_no_reply' END AS event,
    coalesce(l.occurred_at, TIMESTAMP '2024-01-01') AS occurred_at
  FROM customer c LEFT JOIN (SELECT *, count(*) FILTER (WHERE direction='outbound') OVER (PARTITION BY contact_id) AS sent,
      row_number() OVER (PARTITION BY contact_id ORDER BY occurred_at DESC, direction DESC, channel DESC) AS rn FROM interactions_v) l
    ON l.contact_id=c.c_custkey AND rn=1)"""


def _contacts(t: Tables) -> DataFrame:
    """Every customer is a contact of one of the companies; some have no address."""
    return t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 100).alias("company_id"),
                             F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("C"), "c_custkey", F.lit("@Example.com"))).alias("email"),
                             at("2024-01-01").alias("created_at"))


@query("contact_events", f"WITH {_CONTACT_EVENTS} SELECT contact_id, event, occurred_at FROM e WHERE event IS NOT NULL")
def _(t):
    return followups.contact_events(_contacts(t), t.interactions_v)


_RULES = """r(event, days, action) AS (VALUES ('new_contact',0,'send intro message (draft ready)'),('outbound_no_reply',6,'polite bump #1'),
  ('bump_no_reply',10,'final bump, then park'),('call',1,'thank-you note'),('application_with_contact',0,'ask contact about referral'),
  ('interview_completed',0,'thank-you to interviewer if email known'),('outcome',0,'update contact, thank for help'))"""


def _applications(t: Tables) -> DataFrame:
    return t.applications_v.select(F.col("job_id").alias("id"), "job_id", "status", "applied_at",
                                   F.col("applied_at").alias("status_updated_at"))


def _interviews(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("application_id"), F.col("l_shipdate").alias("scheduled_at"),
                             F.when(F.col("l_returnflag") == "R", "pending").otherwise("pass").alias("outcome"))


@query("follow_up_actions", f"""
WITH {_CONTACT_EVENTS}, {_RULES},
v AS (SELECT contact_id, event, occurred_at FROM e WHERE event IS NOT NULL
  UNION ALL SELECT c_custkey, CASE WHEN a.status='submitted' THEN 'application_with_contact' ELSE 'outcome' END, min(applied_at)
    FROM applications_v a JOIN jobs_v j ON j.id=a.job_id JOIN customer ON c_custkey%100=company_id WHERE a.status IN ('submitted','offer','rejected') GROUP BY ALL
  UNION ALL SELECT c_custkey, 'interview_completed', seen FROM customer JOIN (SELECT company_id, min(l_shipdate) AS seen
    FROM lineitem JOIN applications_v a ON a.job_id=l_orderkey JOIN jobs_v j ON j.id=a.job_id WHERE l_returnflag<>'R' GROUP BY 1) ON c_custkey%100=company_id WHERE c_custkey%3<>0),
w AS (SELECT contact_id, action, min(occurred_at + to_days(CAST(days AS INT))) AS due_at FROM v JOIN r USING (event) GROUP BY ALL)
SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM follow_ups_v f WHERE f.contact_id=w.contact_id AND f.action=w.action AND NOT f.done)""")
def _(t):
    events = (followups.contact_events(_contacts(t), t.interactions_v)
              .unionByName(followups.application_events(_applications(t), _interviews(t), t.jobs_v, _contacts(t))))
    return followups.next_actions(events, t.follow_ups_v)


@query("inbound_replies", """
WITH c AS (SELECT c_custkey, 'c'||c_custkey||'@example.com' AS email FROM customer),
m AS (SELECT 'c'||user_id||'@example.com' AS sender, props, ts FROM events),
r AS (SELECT c_custkey AS contact_id, max(ts - INTERVAL '8400' DAY) AS replied_at FROM m JOIN c ON c.email=m.sender GROUP BY 1)
SELECT f.id, f.done OR coalesce(f.created_at<=r.replied_at, false) AS done FROM follow_ups_v f LEFT JOIN r USING (contact_id)""")
def _(t):
    contacts = t.customer.select(F.col("c_custkey").alias("id"),
                                 F.concat(F.lit("C"), "c_custkey", F.lit("@Example.com")).alias("email"))
    mail = t.events.select(
        F.concat(F.lit("c"), "user_id", F.lit("@example.com")).alias("sender"), F.col("props").alias("summary"),
        (F.col("ts") - F.expr("INTERVAL '8400' DAY")).alias("occurred_at"))
    replies = followups.inbound_replies(mail, contacts)
    return followups.close_answered(t.follow_ups_v, replies).select("id", "done")


@query("spaced_review", """
WITH p AS (SELECT *, lag(done_at) OVER (PARTITION BY ref ORDER BY done_at, id) AS previous FROM prep_v)
SELECT id, ref, result, done_at, previous, done_at + to_microseconds(CASE result WHEN 'solved' THEN coalesce(epoch_us(done_at)-epoch_us(previous), 86400000000)*5//2
  WHEN 'solved_with_hints' THEN 3*86400000000 ELSE 86400000000 END) AS next_review_at FROM p""")
def _(t):
    return followups.next_reviews(t.prep_v).withColumn(
        "next_review_at", F.col("next_review_at").cast("timestamp_ntz"))


@query("application_log", f"""
WITH s AS (SELECT l_orderkey AS job_id, min(l_shipdate + INTERVAL '90061' SECOND) AS applied_at FROM lineitem GROUP BY 1)
SELECT s.job_id, 'ats_direct' AS channel, s.applied_at, CAST(trunc((epoch_us(s.applied_at)-epoch_us(o_orderdate))/60000000.0) AS INT) AS minutes_after_posting,
  'submitted' AS status, s.applied_at + INTERVAL '{fv.APPLIED_FOLLOW_UP_DAYS}' DAY AS follow_up_at, '{fv.APPLIED_FOLLOW_UP_ACTION}' AS follow_up_action
FROM s JOIN orders ON o_orderkey=s.job_id WHERE NOT EXISTS (SELECT 1 FROM applications_v a WHERE a.job_id=s.job_id)""")
def _(t):
    sent = t.lineitem.select(F.col("l_orderkey").alias("job_id"),
                             (F.col("l_shipdate") + F.expr("INTERVAL '90061' SECOND")).alias("applied_at"))
    posted = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("posted_at"))
    return followups.log_applications(sent, posted, t.applications_v)


@query("mark_applied", """
SELECT id, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=id) THEN 'applied' ELSE status END AS status FROM jobs_v""")
def _(t):
    sent = t.lineitem.select(F.col("l_orderkey").alias("job_id"))
    return followups.mark_applied(t.jobs_v, sent).select("id", "status")


@query("status_mix", f"""
SELECT {o.badge('c.sponsor_status')} AS badge, j.status, count(*) AS n FROM jobs_v j JOIN companies_v c ON c.id=j.company_id GROUP BY ALL""")
def _(t):
    return (with_company(t.jobs_v, companies(t)).groupBy(badge(F.col("sponsor_status")).alias("badge"), "status")
            .agg(F.count("*").alias("n")))
