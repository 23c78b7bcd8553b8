"""Posting triage, phrase flags, link extraction, keyword and token checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as fv
from vacantia.functions.text import any_of

SAYS_NO = (r"unable to sponsor|(not|cannot|can't|won't) (offer |provide )?(visa )?sponsor"
           r"|without (visa )?sponsorship|no (visa )?sponsorship")
SAYS_YES = r"will sponsor|(visa )?sponsorship (is )?(available|offered|provided)|we sponsor"

MAIL_CLASSES = (
    ("rejection", r"unfortunately|not (be )?moving forward|other candidates|regret"),
    ("oa", r"online assessment|coding (challenge|assessment)|hackerrank|codesignal"),
    ("offer", r"offer letter|pleased to offer|extend (you )?an offer"),
    ("interview", r"interview|schedule (a )?(call|chat)|phone screen"),
)

# Tokens of a rewrite that have to be backed by the original.
CLAIM_TOKEN = r"\d+|[A-Z][a-zA-Z]+"


def visa_flag(description: Column, no: str = SAYS_NO, yes: str = SAYS_YES) -> Column:
    text = F.coalesce(description, F.lit(""))
    return (F.when(text.rlike("(?i)" + no), "jd_says_no_sponsor")
            .when(text.rlike("(?i)" + yes), "jd_says_yes").otherwise("jd_silent"))


def mail_class(text: Column, classes: tuple = MAIL_CLASSES) -> Column:
    """First class whose pattern matches; ``other`` if none does."""
    (name, pattern), *rest = classes
    out = F.when(text.rlike("(?i)" + pattern), name)
    for name, pattern in rest:
        out = out.when(text.rlike("(?i)" + pattern), name)
    return out.otherwise("other")


def freshness_decay(posted_at: Column, as_of: Column, half_life_days: float = 7.0) -> Column:
    """Default freshness: exponential decay by age, 1 for undated or future rows."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(posted_at.cast("timestamp")))
    days = F.greatest(F.coalesce(age, F.lit(0)), F.lit(0)) / F.lit(86_400_000_000.0)
    return F.pow(F.lit(0.5), days / F.lit(half_life_days))


def triage(jobs: DataFrame, companies: DataFrame, freshness: Column) -> DataFrame:
    """Route postings: skipped, queued with a priority, or triaged."""
    c = companies.select(F.col("id").alias("company_id"), "sponsor_status", "sponsor_score")
    joined = jobs.join(c, "company_id", "left")
    skip = F.col("visa_flag").eqNullSafe("jd_says_no_sponsor")
    queue = F.coalesce((F.col("fit_score") >= fv.QUEUE_FIT)
                       & (F.col("sponsor_status") == "verified"), F.lit(False))
    priority = (F.col("fit_score").cast("double") * F.col("sponsor_score").cast("double")
                * freshness)
    return (joined.withColumn("status", F.when(skip, "skipped").when(queue, "queued")
                              .otherwise("triaged"))
            .withColumn("priority", F.when(~skip & queue, priority)))


def decoded(text: Column) -> Column:
    """Text with the common character references replaced; the ampersand comes last."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def job_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Job links of a page: ``(…, url, title, external_id)``, the id from the URL.

    Quoted and unquoted addresses count, with their entities decoded.
    """
    anchor = r"""(?is)<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)[^>]*>(.*?)</a>"""
    hrefs = F.transform(F.regexp_extract_all(F.col(html), F.lit(anchor), F.lit(1)),
                        lambda h: decoded(F.regexp_replace(h, "^[\"']|[\"']$", "")))
    texts = F.regexp_extract_all(F.col(html), F.lit(anchor), F.lit(2))
    keep = [c for c in pages.columns if c not in (html, "url")]
    found = pages.select(*keep, F.explode(F.arrays_zip(hrefs.alias("href"), texts.alias("text")))
                         .alias("a"))
    job = any_of([F.contains(F.col("a.href"), F.lit(m)) for m in fv.LINK_MARKERS])
    url = F.regexp_replace(F.col("a.href"), r"[?&]trk=.*$", "")
    title = F.trim(decoded(F.regexp_replace(F.col("a.text"), r"<[^>]*>", "")))
    return (found.filter(job)
            .select(*keep, url.alias("url"), title.alias("title"))
            .withColumn("external_id", F.sha1("url")))


def keyword_coverage(texts: DataFrame, text: str, keywords: Column) -> DataFrame:
    """Case-insensitive substring hits and misses of a keyword list."""
    body = F.lower(F.col(text))
    hit = F.filter(keywords, lambda k: F.contains(body, F.lower(k)))
    miss = F.filter(keywords, lambda k: ~F.contains(body, F.lower(k)))
    return texts.withColumns({"hits": F.size(hit), "missing": miss})


def unsupported_tokens(original: Column, rewrite: Column) -> Column:
    """Numbers and capitalized words of the rewrite that the original lacks."""
    def tokens(c: Column) -> Column:
        return F.regexp_extract_all(c, F.lit(CLAIM_TOKEN), F.lit(0))
    return F.array_sort(F.array_except(tokens(rewrite), tokens(original)))
