"""Names, titles, keys, scores and similarity as column expressions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vacantia.functions import scoring, similarity, text

# One made-up name per suffix word, and names in which the word is part of another.
SUFFIXES = ("Inc", "LLC", "Ltd", "Corp", "Corporation", "Co", "Company", "Technologies", "Technology", "Labs",
            "Holdings", "Group", "USA", "US")
NAMES = [(f"Quillby {s}", "quillby") for s in SUFFIXES] + [
    ("  Quillby,  Inc. ", "quillby"), ("QUILLBY HOLDINGS, L.L.C.", "quillby"), ("Quillby Group North", "quillby north"),
    ("Incandela", "incandela"), ("Coppice Grouping", "coppice grouping"), ("Mara'Wen", "marawen"), ("Mara’Wen Co.", "marawen"),
    ("Ltd. Corp", ""), ("", ""), ("Nine\nTen\tEleven", "nine ten eleven"), ("Žižka Labs", "žižka"), ("žinc", "žinc"),
]

# One title per branch of the signal pattern, then one per veto word and near misses.
NEW_GRAD = [
    "Compiler Developer / newgrad", "Compiler Developer (new grad)", "New Graduate, Compilers", "University grad: robotics",
    "university graduate analyst", "Analyst, entry level", "entry-level analyst", "entrylevel analyst", "Early Career analyst",
    "Campus analyst", "software testing intern", "SWE internship, Oslo", "Software roles 2027", "swe 2029",
]
VETOES = ("senior", "staff", "principal", "lead", "manager", "director", "sr", "Sr.")
NOT_NEW_GRAD = [f"{v} new grad mentor" for v in VETOES] + [
    "", "Analyst", "renew graduation", "Software roles 2030", "intern, accounting", "software " + "x" * 40 + " intern", "swe\nintern",
]


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_normalize_company(spark):
    df = spark.createDataFrame(NAMES, "raw string, want string")
    bad = df.filter(text.normalize_company(F.col("raw")) != F.col("want"))
    assert bad.collect() == []


def test_new_grad_titles(spark):
    rows = [(t, True) for t in NEW_GRAD] + [(t, False) for t in NOT_NEW_GRAD]
    df = spark.createDataFrame(rows, "title string, want boolean")
    got = df.withColumn("got", text.is_new_grad(F.col("title"), F.lit(None).cast("string")))
    assert got.filter("got IS NULL OR got <> want").collect() == []


@pytest.mark.parametrize("title,jd,want", [
    ("Analyst", "Open to campus hires of any year.", True),
    ("Analyst", "-" * 2001 + " campus", False),
    ("Analyst", "-" * 1993 + " campus", True),
    ("Analyst", "-" * 1994 + " campus", False),
    ("Lead Analyst", "campus", False),
    ("", "", False),
])
def test_new_grad_description(spark, title, jd, want):
    assert one(spark, text.is_new_grad(F.lit(title), F.lit(jd)).alias("x")).x is want


def test_empty_counts_as_missing(spark):
    row = one(spark, text.first_non_empty(F.lit(""), F.lit("b")).alias("a"),
              text.first_non_empty(F.lit(None).cast("string"), F.lit("")).alias("b"))
    assert (row.a, row.b) == ("b", None)


def test_same_location(spark):
    def same(a, b):
        cols = [F.lit(x).cast("string") for x in (a, b)]
        return one(spark, text.same_location(*cols).alias("x")).x
    assert same("Remote", "remote ") and same(None, None) and same("\tNYC\n", "nyc")
    assert not same(None, "NYC") and not same(None, "") and not same("NYC", "Seattle")


def test_alert_text(spark):
    def alert(status, location):
        args = [F.lit(x).cast("string") for x in (status, "Acme", "SWE", location, "https://u")]
        return one(spark, text.alert_text(*args).alias("x")).x
    assert alert("verified", "NYC") == "\U0001f7e2 **Acme** — SWE (NYC)\nhttps://u"
    assert alert("likely", "") == "\U0001f7e1 **Acme** — SWE (location n/a)\nhttps://u"
    assert alert(None, None) == "⚪ **Acme** — SWE (location n/a)\nhttps://u"


def test_shards_are_disjoint_complete_and_stable(spark):
    import zlib
    tokens = ["stripe", "Figma", "ramp", "openai", "databricks", "duolingo", "Visa", "x", "y1"]
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    for n in (1, 2, 3):
        got = {r.token: r.s for r in df.select("token", text.shard_of(F.col("token"), n).alias("s")).collect()}
        assert got == {t: zlib.crc32(t.lower().encode()) % n for t in tokens}


def test_fiscal_year(spark):
    days = [(datetime(2026, 9, 30), 2026), (datetime(2026, 10, 1), 2027), (datetime(2026, 1, 1), 2026)]
    df = spark.createDataFrame(days, "d timestamp, want int")
    assert df.filter(scoring.fiscal_year(F.col("d")) != F.col("want")).collect() == []


def score(spark, a, d, year, now=2026):
    milli = scoring.score_milli(F.lit(a).cast("bigint"), F.lit(d).cast("bigint"),
                                F.lit(year).cast("int"), F.lit(now))
    row = one(spark, scoring.score_value(milli).alias("v"), scoring.score_status(milli).alias("s"))
    return float(row.v), row.s


def test_score_anchors(spark):
    value, status = score(spark, 200, 5, 2026)
    assert status == "verified" and value >= 0.9
    assert score(spark, 0, 0, 2026) == score(spark, 0, 10, 2026) == (0.05, "unlikely")
    assert score(spark, -1, 0, None)[1] == score(spark, -5, 0, None)[1] == "unlikely"
    for approvals in (5, 1):
        value, status = score(spark, approvals, 0, 2026)
        assert status == "likely" and 0.2 <= value < 0.5
    assert abs(score(spark, 50, 0, 2026)[0] - score(spark, 500, 0, 2026)[0]) < 0.03
    assert score(spark, 50, 50, 2026)[0] < score(spark, 50, 0, 2026)[0]
    assert score(spark, 50, 0, 2024)[0] > score(spark, 50, 0, 2023)[0]
    assert score(spark, 200, 0, 2026)[1] == "verified"
    assert score(spark, 4, 0, 2021)[1] == "likely"
    assert score(spark, 1, 30, 2021)[1] == "unlikely"


def test_token_sort_ratio(spark):
    def ratio(a, b):
        x, y = similarity.sorted_tokens(F.lit(a)), similarity.sorted_tokens(F.lit(b))
        df = spark.range(1).select(x.alias("x"), y.alias("y"))
        return df.select((similarity.lcs_length("x", "y") * 200.0
                          / (F.length("x") + F.length("y"))).alias("r")).first().r
    assert round(ratio("Software Engineer, New Grad", "Software Engineer - New Grad"), 1) == 94.5
    assert round(ratio("Software Engineer, Backend", "Software Engineer, Frontend"), 1) == 67.9
    assert ratio("labs figma", "figma labs") == 100.0


def test_trigrams(spark):
    def grams(s):
        return set(one(spark, similarity.trigrams(F.lit(s)).alias("g")).g)
    assert grams("Cat") == {"  c", " ca", "cat", "at "}
    assert grams("foo|bar") == {"  f", " fo", "foo", "oo ", "  b", " ba", "bar", "ar "}
    assert grams("--- ") == set()


def _lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
        prev = row
    return prev[-1]


@pytest.mark.parametrize("percent", [90, 92])
def test_segment_join_finds_every_pair(spark, percent):
    import random
    rng = random.Random(percent)
    words = set()
    for _ in range(60):
        base = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 45)))
        for _ in range(4):
            s = list(base)
            for _ in range(rng.randint(0, max(1, len(s) // 6))):
                at = rng.randrange(len(s) + 1)
                s[at:at + rng.choice([0, 1])] = rng.choice(["", "a", "b"])
            words.add(" ".join(sorted("".join(s).split())))
    words = sorted(words)
    want = {(a, b) for a in words for b in words
            if a != b and 200 * _lcs(a, b) >= percent * (len(a) + len(b))}
    df = spark.createDataFrame([(w,) for w in words], "s string")
    a, b = F.col("a"), F.col("b")
    index = df.select(F.col("s").alias("b"), F.explode(similarity.segment_keys("s", percent)).alias("k"))
    for not_longer in (False, True):
        probe = df.select(F.col("s").alias("a"),
                          F.explode(similarity.probe_keys("s", percent, not_longer)).alias("k"))
        pairs = (probe.join(index, "k").filter((a != b) & similarity.may_match(a, b, percent))
                 .select("a", "b").distinct().filter(similarity.ratio_reached(a, b, percent)))
        assert {tuple(r) for r in pairs.collect()} == {
            p for p in want if not not_longer or len(p[0]) >= len(p[1])}
    assert len(want) > 50
