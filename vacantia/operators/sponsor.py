"""Company-to-employer match and sponsor score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as fv
from vacantia.functions import similarity as sim
from vacantia.functions.scoring import fiscal_year, score_milli, score_status, score_value
from vacantia.functions.text import normalize_company
from vacantia.session import spread, stash

LEVELS = (96, 93)  # ratios searched before the lowest one
SHARES = 4  # tasks that the names of one common segment are dealt to


def employer_totals(filings: DataFrame) -> DataFrame:
    """Approvals, denials and latest year per employer; NULL sums count as 0.

    Filings without ``employer_norm`` are summed by ``employer_raw`` first, so that each spelling is normalized once.
    """
    if "employer_norm" not in filings.columns:
        by_spelling = filings.groupBy("employer_raw").agg(
            F.sum("initial_approvals").alias("initial_approvals"), F.sum("initial_denials").alias("initial_denials"),
            F.max("fiscal_year").alias("fiscal_year"))
        filings = by_spelling.withColumn("employer_norm", normalize_company(F.col("employer_raw")))
    return filings.groupBy("employer_norm").agg(
        F.coalesce(F.sum("initial_approvals"), F.lit(0)).cast("bigint").alias("approvals"),
        F.coalesce(F.sum("initial_denials"), F.lit(0)).cast("bigint").alias("denials"),
        F.max("fiscal_year").alias("latest_year"))


def slice_totals(filings: DataFrame) -> DataFrame:
    """Totals per employer and slice ``src``, to be kept beside the filings table.

    ``load.write_slice`` replaces the totals of the slices it is given and
    leaves the others as they are.
    """
    return filings.groupBy("src", "employer_norm").agg(
        F.sum("initial_approvals").cast("bigint").alias("approvals"),
        F.sum("initial_denials").cast("bigint").alias("denials"),
        F.max("fiscal_year").alias("latest_year"))


def totals_of_slices(totals: DataFrame) -> DataFrame:
    """``employer_totals`` of the whole table from the totals of its slices."""
    return totals.groupBy("employer_norm").agg(
        F.coalesce(F.sum("approvals"), F.lit(0)).cast("bigint").alias("approvals"),
        F.coalesce(F.sum("denials"), F.lit(0)).cast("bigint").alias("denials"),
        F.max("latest_year").alias("latest_year"))


def unknown_companies(companies: DataFrame) -> DataFrame:
    return companies.filter("sponsor_status = 'unknown'")


def similar_employers(names: DataFrame, employers: DataFrame,
                      percent: int = fv.MATCH_THRESHOLD) -> DataFrame:
    """Pairs ``(name_normalized, employer_norm, ratio)`` that pass both tests.

    Candidates come from an equality join on string segments, which misses no
    pair at the ratio; length, edit distance and trigram overlap cut them down
    in the JVM and the exact ratio decides.
    """
    left = spread(names.select("name_normalized"), "name_normalized").select(
        "name_normalized", sim.sorted_tokens(F.col("name_normalized")).alias("a"))
    right = spread(employers.select("employer_norm"), "employer_norm").select(
        "employer_norm", sim.sorted_tokens(F.col("employer_norm")).alias("b"))
    probe = left.select("*", *_measures("a"), F.explode(sim.probe_keys("a", percent)).alias("k")).select(
        "name_normalized", "a", "a_bits", "a_length", "k.*", F.pmod(F.xxhash64("a"), F.lit(SHARES)).cast("int").alias("share"))
    index = right.select("*", *_measures("b"), F.explode(sim.segment_keys("b", percent)).alias("k")).select(
        "employer_norm", "b", "b_bits", "b_length", "k.*", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    # Most pairs that share a segment share common words and no more; a few bits of each tell.
    # The planner knows the index by its size in files and before it is exploded, and would have the driver collect it.
    alike = sim.parity_ok(F.col("a_bits"), F.col("b_bits"), F.col("a_length"), F.col("b_length"), percent)
    key = ["len", "seg", "part", "share"]
    near = (spread(probe, *key).join(spread(index, *key).hint("merge"), key)
            .filter(alike & sim.may_match(F.col("a"), F.col("b"), percent))
            .select("name_normalized", "employer_norm", "a", "b"))
    near = spread(near, "name_normalized", "employer_norm").dropDuplicates(
        ["name_normalized", "employer_norm"])
    common, union = sim.trigram_counts(sim.trigrams(F.col("name_normalized")),
                                       sim.trigrams(F.col("employer_norm")))
    # The trigram test is the costliest per pair and comes last; above the ratio
    # column it stays there and is not pushed into the join.
    return (near.withColumn("lcs", sim.lcs_length("a", "b"))
            .withColumn("n", F.length("a") + F.length("b"))
            .filter(F.col("lcs") * 200 >= F.col("n") * percent)
            .filter(common * 10 >= union * fv.TRIGRAM_TENTHS)
            .select("name_normalized", "employer_norm",
                    (F.col("lcs") * 200.0 / F.col("n")).alias("ratio")))


def _measures(column: str) -> list[Column]:
    return [sim.letter_parity(F.col(column)).alias(f"{column}_bits"), F.length(column).alias(f"{column}_length")]


def best_employer(names: DataFrame, employers: DataFrame,
                  percent: int = fv.MATCH_THRESHOLD) -> DataFrame:
    """The best employer per name: highest ratio, then smallest employer name.

    Names whose tokens equal an employer's have ratio 100 and need no fuzzy
    search, so they are settled by a plain join first. The others are searched
    by falling ratio: a name with a match at one level has its best one there,
    and only names without any go on to the next level, where keys are shorter.
    Names and employers compress well in files, so no join may collect them on the driver by that size.
    """
    worded = r"[\p{L}\p{N}]"  # names without a word have no trigrams and match nothing
    names = names.select("name_normalized").filter(F.col("name_normalized").rlike(worded)).distinct()
    key = sim.sorted_tokens
    by_tokens = (employers.filter(F.col("employer_norm").rlike(worded))
                 .groupBy(key(F.col("employer_norm")).alias("tokens"))
                 .agg(F.min("employer_norm").alias("employer_norm")))
    looked_up = (names.withColumn("tokens", key(F.col("name_normalized")))
                 .join(by_tokens.hint("merge"), "tokens", "left"))
    equal = looked_up.filter("employer_norm IS NOT NULL").select(
        "name_normalized", "employer_norm", F.lit(100.0).alias("ratio"))
    open_names, found = looked_up.filter("employer_norm IS NULL").select("name_normalized"), equal
    for level in [p for p in LEVELS if p > percent] + [percent]:
        open_names = stash(open_names, "sponsor-open")
        fuzzy = stash(similar_employers(open_names, employers, level)
                      .groupBy("name_normalized")
                      .agg(F.min_by(F.struct("employer_norm", "ratio"),
                                    F.struct(-F.col("ratio"), F.col("employer_norm"))).alias("m"))
                      .select("name_normalized", "m.*"), "sponsor-found")
        found = found.unionByName(fuzzy)
        open_names = open_names.join(fuzzy.select("name_normalized").hint("merge"), "name_normalized", "left_anti")
    return found


def score_companies(companies: DataFrame, filings: DataFrame, as_of: Column) -> DataFrame:
    """Scores of the still unknown companies.

    ``(id, name_normalized, employer_norm, sponsor_score, sponsor_status)``;
    a company without a match stays unknown at 0. The filings are read once:
    their totals, one row per employer, are written and used three times.
    """
    todo = unknown_companies(companies).select("id", "name_normalized")
    totals = stash(employer_totals(filings), "sponsor-totals")
    best = best_employer(todo, totals.select("employer_norm"))
    milli = score_milli(F.col("approvals"), F.col("denials"), F.col("latest_year"),
                        fiscal_year(as_of))
    matched = F.col("employer_norm").isNotNull()
    # matches meet their totals first, so unmatched companies bring no NULL key to that join
    known = best.join(totals.hint("merge"), "employer_norm")
    return (todo.join(known.hint("merge"), "name_normalized", "left")
            .select("id", "name_normalized", "employer_norm",
                    F.when(matched, score_value(milli))
                    .otherwise(F.lit(0).cast("decimal(4,3)")).alias("sponsor_score"),
                    F.when(matched, score_status(milli)).otherwise("unknown")
                    .alias("sponsor_status")))


def apply_scores(companies: DataFrame, scores: DataFrame) -> DataFrame:
    """Write scores back; unknown results change nothing and are retried later."""
    new = (scores.filter("sponsor_status <> 'unknown'")
           .select("id", F.col("sponsor_score").alias("new_score"),
                   F.col("sponsor_status").alias("new_status")))
    return (companies.join(new.hint("merge"), "id", "left")
            .withColumns({"sponsor_score": F.coalesce("new_score", "sponsor_score"),
                          "sponsor_status": F.coalesce("new_status", "sponsor_status")})
            .select(*companies.columns))


def status_counts(scores: DataFrame) -> DataFrame:
    return scores.groupBy("sponsor_status").agg(F.count("*").alias("n"))


def run_detail(scores: DataFrame) -> DataFrame:
    """Run text ``status=n, ...`` sorted by status; at most five statuses exist."""
    parts = F.array_sort(F.collect_list(F.concat("sponsor_status", F.lit("="), "n")))
    text = F.array_join(parts, ", ")
    return status_counts(scores).agg(
        F.coalesce(F.nullif(text, F.lit("")), F.lit("0 companies")).alias("detail"))


def scoring_run(companies: DataFrame, filings: DataFrame,
                as_of: Column) -> tuple[DataFrame | None, DataFrame]:
    """Score unless there are no filings; returns scores and the run-log row."""
    spark = companies.sparkSession
    if filings.isEmpty():
        row = spark.range(1).select(F.lit("no sponsor data").alias("detail"))
        scores, ok = None, False
    else:
        scores = stash(score_companies(companies, filings, as_of), "sponsor-scores")  # written back and logged
        row, ok = run_detail(scores), True
    return scores, row.select(F.lit("sponsor_match").alias("source"), F.lit(ok).alias("ok"),
                              as_of.alias("ran_at"), "detail")
