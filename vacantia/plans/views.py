"""Views that shape the driver tables like the posting domain.

Each view is one SQL text that Spark and the SQL oracle both run. Views cover
their whole base tables but for ``applications_v`` (the orders that were applied
for) and ``resumes_v`` (returned lines); strings are derived from integer keys.
"""

from __future__ import annotations

WORDS = ("Blue,Red,Nova,Apex,Iron,Quartz,Delta,Lunar,Vector,Cedar",
         "Data,Systems,Robotics,Analytics,Capital,Networks,Health,Energy,Media,Cloud")
TITLES = ("Software Engineer|Senior Software Engineer|Software Engineer, New Grad|"
          "Software Engineer - New Grad|Staff Engineer|SWE Intern|New Grad Software Engineer|"
          "Platform Engineer (Remote)|Platform Engineer Remote|Data Engineer, Early Career|"
          "Machine Learning Engineer II|Machine Learning Engineer III")
PLACES = "New York, NY|new york, ny |Remote|Seattle, WA"


def _word(key: str, words: str, div: int = 1) -> str:
    at = f"CAST(floor({key}/{div}) AS BIGINT)%10+1"
    return f"split_part('{words}',',',CAST({at} AS INT))"


def _third(key: str) -> str:
    digits = f"CAST(CAST(floor({key}/100) AS BIGINT) AS STRING)"
    return f"translate({digits},'0123456789','bdfgklmnpr')"


def _name(key: str) -> str:
    return (f"concat({_word(key, WORDS[0])},' ',{_word(key, WORDS[1], 10)},' ',{_third(key)})")


def _swapped(key: str) -> str:
    return (f"concat({_word(key, WORDS[1], 10)},' ',{_third(key)},' ',{_word(key, WORDS[0])})")


VIEWS: dict[str, tuple[str, str]] = {}  # name -> (base table, text with {base})

VIEWS["companies_v"] = ("customer", f"""
SELECT c_custkey AS id,
  concat({_name('c_custkey')}, split_part(', Inc.| LLC|| Technologies| Group','|',CAST(c_custkey%5+1 AS INT))) AS name,
  split_part('greenhouse,lever,ashby,smartrecruiters,',',',CAST(c_custkey%5+1 AS INT)) AS ats_type,
  CASE WHEN c_custkey%5=4 THEN '' ELSE concat('board', CAST(c_custkey AS STRING)) END AS ats_token,
  split_part('unknown,unknown,verified,likely',',',CAST(c_custkey%4+1 AS INT)) AS sponsor_status,
  CAST(CASE WHEN c_custkey%4<2 THEN NULL ELSE c_custkey%1000 END AS DECIMAL(10,0)) AS score_milli
FROM {{base}}""")

VIEWS["filings_v"] = ("lineitem", f"""
SELECT 'uscis_hub' AS src,
  CAST(year(l_shipdate) - CASE WHEN l_suppkey%6=5 THEN 6 ELSE 0 END AS INT) AS fiscal_year,
  concat(CASE WHEN l_suppkey%3=0 THEN upper({_swapped('l_suppkey')}) ELSE {_name('l_suppkey')} END,
    CASE WHEN l_suppkey%7=0 THEN 's CORP' WHEN l_suppkey%7=1 THEN ' Ltd' ELSE ', Inc.' END) AS employer_raw,
  CAST(CASE WHEN l_linenumber=1 AND l_quantity<=l_suppkey%5 THEN 1 + floor(l_suppkey%5/4)*9 ELSE 0 END AS INT) AS initial_approvals,
  CAST(CASE WHEN l_linenumber=7 AND l_quantity<=3 THEN 1 ELSE 0 END AS INT) AS initial_denials
FROM {{base}}""")

VIEWS["jobs_v"] = ("orders", f"""
SELECT o_orderkey AS id, CAST(o_custkey%100 AS BIGINT) AS company_id,
  split_part('greenhouse,lever,ashby,smartrec,github_repo',',',CAST(o_orderkey%5+1 AS INT)) AS source,
  CAST(o_orderkey AS STRING) AS external_id,
  concat(split_part('{TITLES}','|',CAST(o_orderkey%12+1 AS INT)), CASE WHEN o_custkey%3=0 THEN ' 2026' ELSE '' END) AS title,
  CASE WHEN o_custkey%7=0 THEN NULL ELSE split_part('{PLACES}','|',CAST(o_custkey%4+1 AS INT)) END AS location,
  concat('https://jobs.example.com/', CAST(o_orderkey AS STRING)) AS url,
  CASE WHEN o_custkey%11=0 THEN 'We hire new grad engineers. Sponsorship is available.'
       WHEN o_custkey%11=1 THEN 'We are unable to sponsor visas.' WHEN o_custkey%11=2 THEN NULL
       ELSE concat('About the role, posting ', CAST(o_orderkey AS STRING)) END AS description,
  o_orderdate AS first_seen_at,
  CASE WHEN o_orderstatus='O' THEN 'new' WHEN o_orderstatus='P' THEN 'queued' ELSE 'applied' END AS status,
  CAST(CAST(floor(o_totalprice) AS BIGINT)%1000 AS DECIMAL(10,0)) AS fit_milli
FROM {{base}}""")

VIEWS["applications_v"] = ("orders", """
SELECT o_orderkey AS job_id,
  split_part('ats_direct,referral,recruiter,career_fair',',',CAST(o_custkey%4+1 AS INT)) AS channel,
  o_orderdate AS applied_at,
  split_part('submitted,oa,phone,onsite,offer,rejected,ghosted,withdrawn',',',CAST(o_orderkey%8+1 AS INT)) AS status,
  CAST(floor(o_totalprice) AS INT)%3000 AS minutes_after_posting,
  o_custkey AS contact_id
FROM {base} WHERE o_orderstatus='F'""")

VIEWS["resumes_v"] = ("lineitem", """
SELECT l_orderkey AS job_id FROM {base} WHERE l_returnflag='R'""")

VIEWS["run_log_v"] = ("events", """
SELECT event_type AS source, value>5 AS ok, ts AS ran_at, props AS detail FROM {base}""")

VIEWS["interactions_v"] = ("events", """
SELECT event_id AS id, user_id AS contact_id,
  CASE WHEN event_type IN ('click','view','signup') THEN 'outbound' ELSE 'inbound' END AS direction,
  CASE WHEN event_type='purchase' THEN 'phone' WHEN event_type='view' THEN 'linkedin' ELSE 'email' END AS channel,
  ts AS occurred_at
FROM {base}""")

VIEWS["prep_v"] = ("events", """
SELECT event_id AS id, concat('p', CAST(user_id AS STRING)) AS ref,
  CASE WHEN event_type IN ('click','view') THEN 'solved'
       WHEN event_type='error' THEN 'failed' ELSE 'solved_with_hints' END AS result,
  ts AS done_at
FROM {base}""")

VIEWS["follow_ups_v"] = ("orders", """
SELECT o_orderkey AS id, o_custkey AS contact_id, o_orderdate AS created_at,
  o_orderdate + INTERVAL '10' DAY AS due_at,
  split_part('polite bump #1|thank-you note|send intro message (draft ready)','|',CAST(o_orderkey%3+1 AS INT)) AS action,
  o_orderstatus='F' AS done
FROM {base}""")

VIEWS["arrivals_v"] = ("lineitem", """
SELECT split_part('greenhouse,lever,ashby',',',CAST(l_suppkey%3+1 AS INT)) AS source,
  CASE WHEN l_linenumber=6 AND l_quantity<=5 THEN NULL
       ELSE concat(CAST(l_orderkey AS STRING),'-',CAST(l_linenumber AS STRING)) END AS external_id,
  l_partkey AS company_id, l_shipdate AS posted_at, l_extendedprice AS payload_value,
  l_quantity AS quantity, l_suppkey AS suppkey, l_tax AS tax, l_discount AS discount
FROM {base}""")

VIEWS["watchlist_v"] = ("customer", """
SELECT split_part('greenhouse,lever,ashby,smartrecruiters',',',CAST(c_custkey%4+1 AS INT)) AS ats,
  concat('Board', CAST(c_custkey AS STRING)) AS token, c_custkey AS board
FROM {base}""")
