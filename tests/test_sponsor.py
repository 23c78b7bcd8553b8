"""Employer match against brute force, and the scoring run."""

import random

import pytest
from pyspark.sql import functions as F

from vacantia.operators import load, sponsor

AS_OF = "2026-03-01"


def best(spark, names, employers):
    n = spark.createDataFrame([(x,) for x in names], "name_normalized string")
    e = spark.createDataFrame([(x,) for x in employers], "employer_norm string")
    return {r.name_normalized: r.employer_norm for r in sponsor.best_employer(n, e).collect()}


@pytest.mark.parametrize("name,employers,want", [
    ("stripe", ["square", "stripe"], "stripe"),
    ("labs figma", ["figma labs"], "figma labs"),
    ("stripe", ["microsoft"], None),
    ("cognizant", ["cognigent solutions"], None),
    ("stripe", [], None),
    ("", ["", "x"], None),
    ("---", ["---"], None),
    ("acme robotics intl", ["acme robotic intl", "acme robotics int"], "acme robotic intl"),
])
def test_match_cases(spark, name, employers, want):
    assert best(spark, [name], employers).get(name) == want


def lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
        prev = row
    return prev[-1]


def trigrams(s):
    import re
    return {f"  {w} "[i:i + 3] for w in re.findall(r"[a-z0-9]+", s) for i in range(len(w) + 1)}


def brute(name, employers):
    def ratio(e):
        a, b = (" ".join(sorted(x.split())) for x in (name, e))
        return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 0
    x = trigrams(name)
    hits = [(-ratio(e), e) for e in employers
            if x and 10 * len(x & trigrams(e)) >= 3 * len(x | trigrams(e)) and ratio(e) >= 90]
    return min(hits)[1] if hits else None


def test_equals_brute_force(spark):
    rng = random.Random(11)
    words = ["blue", "data", "systems", "nova", "health", "energy", "capital", "of", "ab", "x"]

    def noisy(s):
        s = list(s)
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            at = rng.randrange(len(s) + 1)
            s[at:at + rng.choice([0, 1])] = rng.choice(["", "a", "s", " "])
        return " ".join("".join(s).split())

    stems = [" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(40)]
    names = sorted({noisy(rng.choice(stems)) for _ in range(120)} - {""})
    employers = sorted({noisy(rng.choice(stems)) for _ in range(150)} - {""})
    want = {n: brute(n, employers) for n in names}
    assert best(spark, names, employers) == {n: e for n, e in want.items() if e}
    assert sum(e is not None and e != n for n, e in want.items()) > 10


COMPANIES = "id string, name_normalized string, sponsor_score decimal(4,3), sponsor_status string"
FILINGS = "employer_norm string, initial_approvals bigint, initial_denials bigint, fiscal_year int"


def test_scoring_run(spark):
    companies = spark.createDataFrame([
        ("1", "stripe", None, "unknown"), ("2", "nobody", None, "unknown"), ("3", "figma", None, "verified"),
        ("4", "small shop", None, "unknown")], COMPANIES)
    filings = spark.createDataFrame([
        ("stripe", 100, 2, 2025), ("stripe", 100, 3, 2026), ("small shop", None, None, None)], FILINGS)
    as_of = F.lit(AS_OF).cast("timestamp")
    scores, log = sponsor.scoring_run(companies, filings, as_of)
    got = {r.id: (float(r.sponsor_score), r.sponsor_status) for r in scores.collect()}
    assert got == {"1": (0.986, "verified"), "2": (0.0, "unknown"), "4": (0.05, "unlikely")}
    row = log.first()
    assert (row.source, row.ok, row.detail) == ("sponsor_match", True, "unknown=1, unlikely=1, verified=1")
    state = {r.id: r.sponsor_status for r in sponsor.apply_scores(companies, scores).collect()}
    assert state == {"1": "verified", "2": "unknown", "3": "verified", "4": "unlikely"}


def test_no_filings_and_no_companies(spark):
    as_of = F.lit(AS_OF).cast("timestamp")
    companies = spark.createDataFrame([("1", "stripe", None, "unknown")], COMPANIES)
    scores, log = sponsor.scoring_run(companies, spark.createDataFrame([], FILINGS), as_of)
    assert scores is None
    assert tuple(log.select("ok", "detail").first()) == (False, "no sponsor data")
    filings = spark.createDataFrame([("stripe", 1, 1, 2025)], FILINGS)
    _, log = sponsor.scoring_run(companies.filter("false"), filings, as_of)
    assert tuple(log.select("ok", "detail").first()) == (True, "0 companies")


def test_totals_of_slices_follow_a_reload(spark, tmp_path):
    table = "src string, employer_norm string, initial_approvals bigint, initial_denials bigint, fiscal_year int"
    old = spark.createDataFrame([("a", "x", 1, None, 2020), ("a", "y", 2, 1, None), ("b", "x", 4, 0, 2019), ("b", "z", None, None, None)], table)
    new = spark.createDataFrame([("a", "x", 10, 1, 2021)], table)
    path = str(tmp_path / "totals")

    def files(src):
        return {p.name: p.read_bytes() for p in (tmp_path / "totals" / f"src={src}").iterdir()}

    load.write_slice(sponsor.slice_totals(old), path)
    kept = files("b")
    load.write_slice(sponsor.slice_totals(new), path)
    assert files("b") == kept  # the other slice was not touched
    got = sorted(map(tuple, sponsor.totals_of_slices(spark.read.parquet(path)).collect()))
    want = sorted(map(tuple, sponsor.employer_totals(load.replace_slice(old, new, "a")).collect()))
    assert got == want == [("x", 14, 1, 2021), ("z", 0, 0, None)]


def test_settled_names_are_not_searched_again(spark, monkeypatch):
    """Only names without a match at a higher ratio meet the shorter keys of a lower one."""
    asked, search = {}, sponsor.similar_employers

    def spy(names, employers, percent):
        asked[percent] = sorted(r[0] for r in names.collect())
        return search(names, employers, percent)

    monkeypatch.setattr(sponsor, "similar_employers", spy)
    names = spark.createDataFrame([("blue data systems bkd",), ("red iron",)], "name_normalized string")
    employers = spark.createDataFrame([("blue data systems bk",), ("blue data systems d",)], "employer_norm string")
    got = [tuple(r) for r in sponsor.best_employer(names, employers).select("name_normalized", "employer_norm").collect()]
    assert got == [("blue data systems bkd", "blue data systems bk")]
    assert asked[max(asked)] == ["blue data systems bkd", "red iron"] and asked[min(asked)] == ["red iron"]


def test_parity_loses_no_pair(spark):
    from vacantia.functions import similarity as sim

    rng = random.Random(5)

    def word(n):
        return "".join(rng.choice("abc dé日😀") for _ in range(n))

    def changed(s):
        s = list(s)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(s) + 1)
            s[at:at + rng.choice([0, 1])] = rng.choice(["", "a", "é", "😀"])
        return "".join(s)

    pairs = [(a, changed(a)) for a in (word(rng.randint(0, 24)) for _ in range(600))]
    pairs += [("quartz dfgk", "quartz bmnp"), ("", ""), ("a", "b")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", *[sim.parity_ok(sim.letter_parity(F.col("a")), sim.letter_parity(F.col("b")), F.length("a"), F.length("b"), p).alias(f"p{p}")
                    for p in (96, 90, 60)]).collect()
    passed = 0
    for r in rows:
        for p in (96, 90, 60):
            reached = lcs(r.a, r.b) * 200 >= (len(r.a) + len(r.b)) * p
            assert r[f"p{p}"] or not reached, (r.a, r.b, p)
            passed += not r[f"p{p}"]
    assert passed > 200


def test_growing_tables_are_not_collected(spark, tmp_path):
    """Small files may hold many rows, more so when each is exploded into its segments."""
    for name, column in (("n", "name_normalized"), ("e", "employer_norm")):
        spark.range(50).select(F.concat(F.lit("acme robotics "), "id").alias(column)).write.parquet(str(tmp_path / name))
    names, employers = (spark.read.parquet(str(tmp_path / x)) for x in ("n", "e"))
    near = sponsor.similar_employers(names, employers.filter("employer_norm <> 'acme robotics 7'"))
    found = sponsor.best_employer(names, employers)
    for plan in (near, found):
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 50


def test_names_of_a_common_segment_are_dealt_to_several_tasks(spark):
    names = spark.range(200).select(F.concat(F.lit("blue data systems k"), "id").alias("name_normalized"))
    employers = spark.createDataFrame([("blue data systems",)], "employer_norm string")
    got = sponsor.similar_employers(names, employers, 90)
    assert got.count() == brute_near([f"blue data systems k{i}" for i in range(200)], "blue data systems")
    assert "share" in got._jdf.queryExecution().optimizedPlan().toString()


def brute_near(names, employer):
    return sum(brute(n, [employer]) is not None for n in names)


def test_each_spelling_is_normalized_once(spark):
    raw = spark.createDataFrame([("Acme, Inc.", 1, None, 2020), ("ACME", 2, 1, None), ("Acme, Inc.", 4, None, 2019), ("Nova", None, None, None)],
                                "employer_raw string, initial_approvals bigint, initial_denials bigint, fiscal_year int")
    from vacantia.functions.text import normalize_company
    by_norm = sponsor.employer_totals(raw.withColumn("employer_norm", normalize_company(F.col("employer_raw"))))
    totals = sponsor.employer_totals(raw)
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, by_norm.collect())) == [("acme", 7, 1, 2020), ("nova", 0, 0, None)]
    assert totals.schema == by_norm.schema
    # the first grouping is by the spelling as it is
    first = totals._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[-1]
    assert first.strip().startswith("[employer_raw#")
