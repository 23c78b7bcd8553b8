"""Landed responses built from the orders table, one per order and provider.

The bodies are real JSON texts in the five provider shapes, so the payload
readers are exercised on the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from vacantia.plans.registry import Tables
from vacantia.plans.views import PLACES, TITLES, _name

STATUS = "CASE o_orderpriority WHEN '1-URGENT' THEN 404 WHEN '2-HIGH' THEN 500 ELSE 200 END"
# Some bodies are cut off, and some times are no times: these responses are lost.
CUT = "o_orderkey%43=0"
BAD_TIME = {"greenhouse": "o_orderkey%37=0", "lever": "o_orderkey%41=0", "ashby": "o_orderkey%29=0",
            "smartrecruiters": "o_orderkey%31=0 AND o_orderkey%9<>0", "github_repos": "o_orderkey%47=0"}
ANSWERED = "o_orderpriority NOT IN ('1-URGENT','2-HIGH')"


def ok(ats: str) -> str:
    return f"{ANSWERED} AND NOT ({CUT}) AND NOT ({BAD_TIME[ats]})"



NAME = _name("o_custkey")


def title(i: str) -> str:
    return f"split_part('{TITLES}','|',CAST((o_orderkey+{i})%12+1 AS INT))"


def place(i: str) -> str:
    return (f"CASE WHEN (o_custkey+{i})%7=0 THEN NULL "
            f"ELSE split_part('{PLACES}','|',CAST((o_custkey+{i})%4+1 AS INT)) END")


def _two(job: str) -> str:
    return f"array({job.replace('#', '0')}, {job.replace('#', '1')})"


_ISO = "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\")"
_EPOCH = "unix_seconds(CAST(o_orderdate AS TIMESTAMP))"

BODIES = {
    "greenhouse": (
        "concat('board', o_orderkey)",
        "to_json(named_struct('jobs', " + _two(f"""named_struct(
            'id', 2*o_orderkey+#, 'title', {title('#')},
            'location', CASE WHEN (o_custkey+#)%7=0 THEN NULL ELSE named_struct('name', {place('#')}) END,
            'absolute_url', concat('https://jobs.example.com/g/', 2*o_orderkey+#),
            'content', CASE WHEN o_custkey%5=0 THEN '' ELSE concat('&lt;p&gt;', o_orderpriority) END,
            'first_published', CASE WHEN o_orderkey%37=0 THEN 'not a date' WHEN o_orderkey%3=0 THEN '' WHEN o_orderkey%3=1 THEN NULL ELSE concat({_ISO}, '-05:00') END,
            'updated_at', CASE WHEN o_orderkey%9=0 THEN NULL ELSE concat({_ISO}, '+02:00') END,
            'company_name', CASE WHEN o_orderkey%4=0 THEN NULL WHEN o_orderkey%4=1 THEN '' ELSE {NAME} END)""") + "))"),
    "lever": (
        "concat('board', o_orderkey)",
        "to_json(" + _two(f"""named_struct(
            'id', concat('l', 2*o_orderkey+#), 'text', {title('#')},
            'categories', CASE WHEN (o_custkey+#)%7=0 THEN NULL ELSE named_struct('location', {place('#')}) END,
            'hostedUrl', concat('https://jobs.example.com/l/', 2*o_orderkey+#),
            'descriptionPlain', CASE WHEN o_orderkey%3=0 THEN '' WHEN o_orderkey%3=1 THEN NULL ELSE 'plain' END,
            'description', concat('<p>', o_orderstatus),
            'createdAt', CASE WHEN o_orderkey%41=0 THEN 9000000000000000000 WHEN o_orderkey%6=0 THEN 0 WHEN o_orderkey%6=1 THEN NULL ELSE {_EPOCH}*1000+250 END)""") + ")"),
    "ashby": (
        "concat('board', o_orderkey)",
        "to_json(named_struct('jobs', " + _two(f"""named_struct(
            'id', concat('a', 2*o_orderkey+#), 'title', concat(' ', {title('#')}), 'location', {place('#')},
            'jobUrl', concat('https://jobs.example.com/a/', 2*o_orderkey+#),
            'descriptionPlain', CASE WHEN o_orderkey%3=0 THEN '' WHEN o_orderkey%3=1 THEN NULL ELSE 'plain' END,
            'descriptionHtml', CASE WHEN o_orderkey%2=0 THEN concat('<p>', o_orderstatus) END,
            'publishedAt', CASE WHEN o_orderkey%29=0 THEN '2020-02-30T00:00:00Z' WHEN o_orderkey%5=0 THEN NULL ELSE concat({_ISO}, '.123+00:00') END,
            'isListed', CASE (o_orderkey+#)%3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END)""") + "))"),
    "smartrecruiters": (
        "concat('c', o_custkey)",
        "to_json(named_struct('offset', o_orderkey, 'limit', 100, 'totalFound', 2, 'content', CASE WHEN o_orderkey%9=0 THEN array() ELSE "
        + _two(f"""named_struct(
            'id', concat('s', 2*o_orderkey+#), 'name', {title('#')},
            'company', CASE WHEN o_custkey%3=0 THEN NULL ELSE named_struct('name', concat({NAME}, ' ', o_orderkey)) END,
            'releasedDate', CASE WHEN o_orderkey%31=0 THEN 'soon' WHEN o_orderkey%5=0 THEN NULL ELSE concat({_ISO}, '.000Z') END,
            'location', named_struct('fullLocation', CASE WHEN o_orderkey%2=0 THEN '' ELSE {place('#')} END, 'city', o_orderpriority))""")
        + " END))"),
    "github_repos": (
        "'listings'",
        "to_json(" + _two(f"""named_struct(
            'id', concat('r', 2*o_orderkey+#), 'company_name', {NAME}, 'title', {title('#')},
            'url', concat('https://jobs.example.com/r/', 2*o_orderkey+#),
            'locations', CASE WHEN (o_custkey+#)%7=0 THEN array() WHEN (o_custkey+#)%7=1 THEN array('Remote','Austin, TX') ELSE array({place('#')}) END,
            'active', CASE (o_orderkey+#)%3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END,
            'is_visible', CASE (o_orderkey+#)%5 WHEN 0 THEN false ELSE true END,
            'date_posted', CASE WHEN o_orderkey%47=0 THEN 9000000000000000 WHEN o_orderkey%6=0 THEN 0 WHEN o_orderkey%6=1 THEN NULL ELSE {_EPOCH} END)""") + ")"),
}


def landing(t: Tables, *providers: str) -> DataFrame:
    """Landing rows of the given providers, all five by default."""
    out = None
    for ats in providers or tuple(BODIES):
        token, body = BODIES[ats]
        part = t.spark.sql(f"""
            SELECT '{ats}' AS ats, {token} AS token, CAST(o_orderdate AS TIMESTAMP) AS fetched_at,
                   {STATUS} AS status, CASE WHEN {CUT} THEN left({body}, 9) ELSE {body} END AS body FROM {{orders}}""", orders=t.orders)
        out = part if out is None else out.unionByName(part)
    return out


# What the readers have to return, straight from the orders table.
_I = "(VALUES (0),(1)) v(i)"
EXPECTED = {
    "greenhouse": f"""
        SELECT 'greenhouse' AS source, CAST(2*o_orderkey+i AS STRING) AS external_id, {title('i')} AS title, {place('i')} AS location,
          'https://jobs.example.com/g/'||(2*o_orderkey+i) AS url,
          CASE WHEN o_custkey%5=0 THEN '' ELSE '&lt;p&gt;'||o_orderpriority END AS description,
          CASE WHEN o_orderkey%3=2 THEN o_orderdate + INTERVAL 5 HOUR WHEN o_orderkey%9=0 THEN NULL ELSE o_orderdate - INTERVAL 2 HOUR END AS posted_at,
          CASE WHEN o_orderkey%4<2 THEN 'board'||o_orderkey ELSE {NAME} END AS company,
          'board'||o_orderkey AS token, o_orderdate AS seen, o_orderkey AS ord, i AS pos
        FROM orders, {_I} WHERE {ok('greenhouse')}""",
    "lever": f"""
        SELECT 'lever' AS source, 'l'||(2*o_orderkey+i) AS external_id, {title('i')} AS title, {place('i')} AS location,
          'https://jobs.example.com/l/'||(2*o_orderkey+i) AS url,
          CASE WHEN o_orderkey%3=2 THEN 'plain' ELSE '<p>'||o_orderstatus END AS description,
          CASE WHEN o_orderkey%6<2 THEN NULL ELSE o_orderdate + INTERVAL 250 MILLISECOND END AS posted_at,
          'board'||o_orderkey AS company,
          'board'||o_orderkey AS token, o_orderdate AS seen, o_orderkey AS ord, i AS pos
        FROM orders, {_I} WHERE {ok('lever')}""",
    "ashby": f"""
        SELECT 'ashby' AS source, 'a'||(2*o_orderkey+i) AS external_id, ' '||{title('i')} AS title, {place('i')} AS location,
          'https://jobs.example.com/a/'||(2*o_orderkey+i) AS url,
          CASE WHEN o_orderkey%3=2 THEN 'plain' WHEN o_orderkey%2=0 THEN '<p>'||o_orderstatus END AS description,
          CASE WHEN o_orderkey%5=0 THEN NULL ELSE o_orderdate + INTERVAL 123 MILLISECOND END AS posted_at,
          'board'||o_orderkey AS company,
          'board'||o_orderkey AS token, o_orderdate AS seen, o_orderkey AS ord, i AS pos
        FROM orders, {_I} WHERE {ok('ashby')} AND (o_orderkey+i)%3<>2""",
    "smartrecruiters": f"""
        SELECT 'smartrec' AS source, 's'||(2*o_orderkey+i) AS external_id, {title('i')} AS title,
          coalesce(CASE WHEN o_orderkey%2=0 THEN NULL ELSE {place('i')} END, o_orderpriority) AS location,
          'https://jobs.smartrecruiters.com/c'||o_custkey||'/s'||(2*o_orderkey+i) AS url, NULL::VARCHAR AS description,
          CASE WHEN o_orderkey%5=0 THEN NULL ELSE o_orderdate END AS posted_at,
          CASE WHEN o_custkey%3=0 THEN 'c'||o_custkey ELSE {NAME}||' '||min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderdate) END AS company,
          'c'||o_custkey AS token, o_orderdate AS seen, o_orderkey AS ord, i AS pos
        FROM orders, {_I} WHERE {ok('smartrecruiters')} AND o_orderkey%9<>0""",
    "github_repos": f"""
        SELECT 'github_repo' AS source, 'r'||(2*o_orderkey+i) AS external_id, {title('i')} AS title,
          CASE WHEN (o_custkey+i)%7=0 THEN NULL WHEN (o_custkey+i)%7=1 THEN 'Remote, Austin, TX' ELSE {place('i')} END AS location,
          'https://jobs.example.com/r/'||(2*o_orderkey+i) AS url, NULL::VARCHAR AS description,
          CASE WHEN o_orderkey%6<2 THEN NULL ELSE o_orderdate END AS posted_at, {NAME} AS company,
          'listings' AS token, o_orderdate AS seen, o_orderkey AS ord, i AS pos
        FROM orders, {_I} WHERE {ok('github_repos')} AND (o_orderkey+i)%3<>2 AND (o_orderkey+i)%5<>0""",
}
EXPECTED_ALL = " UNION ALL ".join(EXPECTED.values())
