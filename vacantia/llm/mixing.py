"""Mixing sources to target weights: balanced sampling by the cube method.

Every source gets a target number of words. With ``rate = target / size of the
source``, each of its documents is taken ``floor(rate)`` times, and once more
with the probability that is left. The cube method rounds these probabilities:
it moves them along vectors that keep both the document total and the word total
(the null space of the two constraints, found on three open documents at a time)
until one becomes 0 or 1. A block of documents ends with at most two open ones;
blocks are merged level by level. In the end a source has a dozen documents of all
sizes and at most two others left, landed on the choice nearest to the target.

Blocks depend on a hash of the document, not on the physical partitioning, so
reruns agree and a hot source is split into as many blocks as it needs.

Defined results: a null or wordless text has size 0 and counts 0 words; a null
source is a source of its own, last in order; repeated rows are sampled one by
one; an empty table gives no row; other columns are ignored by :func:`plan_mix`
and kept by :func:`mix`. A mix without any word has targets 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vacantia.llm.common import prepare, save

BLOCK = 2_000           # documents in a block of the first level
LAND = 12               # documents of a source, small to large, that are left to its landing
FAN_IN = 2_000          # blocks merged into one at a later level: at most two open rows each
WEIGHTS = (5.0, 2.0, 1.0)
ITEM = "doc_id long, source string, copy long, size long, block long, chance double, taken_more int"


def words(text) -> F.Column:
    """Number of maximal runs of characters other than ASCII white space."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(bare, " \t\n\x0b\x0c\r", "")).cast("long")


def targets(sizes: DataFrame, share: float, weights: tuple[float, ...], most: float) -> DataFrame:
    """``source, source_size, target``: ``share`` of all words by weight, none above ``most`` times its size.

    Resharing the excess by weight until no source is above its bound ends at
    ``min(bound, level * weight)`` for one level. Sorted by bound / weight, the
    bounded sources come first, so the level follows from prefix sums. There is
    one row per source; the windows hold totals, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # strings compare by code point
    by_ratio = Window.orderBy("ratio", "place")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    listed = F.array(*map(F.lit, weights))
    rows = (sizes.withColumn("place", F.row_number().over(by_name))
            .withColumn("weight", F.element_at(listed, ((F.col("place") - 1) % len(weights) + 1).cast("int")))
            .withColumn("bound", F.col("source_size") * F.lit(float(most)))
            .withColumn("ratio", F.col("bound") / F.col("weight"))
            .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(share)))
            .withColumn("used", F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
            .withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
            .withColumn("level", (F.col("wanted") - F.col("used")) / F.col("left"))
            .withColumn("open", F.col("ratio") > F.col("level")))
    level = F.coalesce(F.min(F.when(F.col("open"), F.struct("ratio", "place", "level"))).over(everything)["level"],
                       F.lit(float("inf")))
    return rows.withColumn("target", F.least("bound", level * F.col("weight"))).select("source", "source_size", "target")


def flight(size: np.ndarray, chance: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Move ``chance`` through the null space of (1, size) until at most two entries are open."""
    p, eps = chance.astype(float).copy(), 1e-9
    size, draw = size.astype(float).tolist(), draw.tolist()
    open_ = []
    for i in range(len(p)):
        if p[i] <= eps or p[i] >= 1 - eps:
            p[i] = round(p[i])
            continue
        open_.append(i)
        while len(open_) == 3:
            a, b, c = open_
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for j, v in zip(open_, u, strict=True):
                if v > 0:
                    up, down = min(up, (1 - p[j]) / v), min(down, p[j] / v)
                elif v < 0:
                    up, down = min(up, p[j] / -v), min(down, (1 - p[j]) / -v)
            step = up if draw[i] < down / (up + down) else -down
            for j, v in zip(open_, u, strict=True):
                p[j] += step * v
                if p[j] <= eps or p[j] >= 1 - eps:
                    p[j] = round(p[j])
            rest = [j for j in open_ if 0 < p[j] < 1]
            open_ = rest if len(rest) < 3 else open_[1:]  # never kept at three
    return p


def landing(size: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Decide the few open documents: the choice nearest to the expected words, then documents."""
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    pick = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    words_ = np.abs(pick @ size[open_] - (size[open_] * chance[open_]).sum())
    best = np.lexsort((np.abs(pick.sum(1) - chance[open_].sum()), np.round(words_, 6)))[0]
    out = chance.copy()
    out[open_] = pick[best]
    return out


def _fly(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # large documents first: what stays open is small
        pdf = pdf.sort_values(["size", "doc_id", "copy"], ascending=[False, True, True], na_position="last")
        draw = pdf["draw"].to_numpy()
        size, p = pdf["size"].to_numpy(), pdf["chance"].to_numpy(copy=True)
        fly = np.ones(len(p), bool)
        if last:
            fly[np.linspace(0, len(p) - 1, LAND).round().astype(int)] = False
        p[fly] = flight(size[fly], p[fly], draw[fly])
        if last:
            p = landing(size, p)
        done = (p == 0) | (p == 1)
        return pdf.assign(chance=p, taken_more=np.where(done, p, -1).astype(np.int32))[
            ["doc_id", "source", "copy", "size", "block", "chance", "taken_more"]]
    return run


def plan_mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = WEIGHTS, most: float = 2.0,
             seed: int = 7) -> DataFrame:
    """How often each document is taken.

    Returns ``doc_id, copy`` (0, 1, ... among rows of one id), ``source, size,
    source_size, target, times, taken``. No text passes a shuffle.
    """
    prepare(docs.sparkSession)
    rows = save(numbered(docs), "mixing-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    plan = save(targets(sizes.drop("source_docs"), share, weights, most)
                .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
                .join(sizes.select(F.col("source").alias("s"), "source_docs"), F.col("s").eqNullSafe(F.col("source"))).drop("s"),
                "mixing-targets")
    # one small row per source; the join is left to size-checked planning
    items = rows.join(plan.withColumnRenamed("source", "s"), F.col("s").eqNullSafe(F.col("source"))).drop("s")
    key = F.xxhash64(F.lit(seed), "doc_id", "copy", "size")
    items = save(items
                 .withColumn("more", F.col("rate") - F.floor("rate"))
                 .withColumn("block", F.pmod(key, F.ceil(F.col("source_docs") / F.lit(BLOCK)).cast("long"))), "mixing-items")

    draw = (F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "copy", "block"), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("draw")
    blocks = -(-int(items.agg(F.coalesce(F.max("source_docs"), F.lit(0))).first()[0]) // BLOCK)
    open_ = items.select("doc_id", "source", "copy", "size", "block", F.col("more").alias("chance"), draw)
    decided = []
    while True:
        last = blocks <= 1
        flown = save(open_.groupBy("source", "block").applyInPandas(_fly(last), ITEM), "mixing-flight")
        decided.append(flown.filter("taken_more >= 0"))
        if last:
            break
        blocks = -(-blocks // FAN_IN)
        open_ = (flown.filter("taken_more < 0").withColumn("block", F.floor(F.col("block") / FAN_IN))
                 .select("doc_id", "source", "copy", "size", "block", "chance", draw))
    result = decided[0]
    for d in decided[1:]:
        result = result.unionByName(d)
    result = result.select("doc_id", "source", "copy", "size", "taken_more").join(
        plan.select(F.col("source").alias("s"), "source_size", "target", "rate"), F.col("s").eqNullSafe(F.col("source")))
    times = (F.floor("rate") + F.col("taken_more")).cast("long")
    return result.select("doc_id", "copy", "source", "size", "source_size", "target", times.alias("times"),
                         (times * F.col("size")).alias("taken"))


def numbered(docs: DataFrame, *keep: str) -> DataFrame:
    """Rows with ``size`` and a number among the rows of the same id, the same on every run.

    Rows that tie in source, size and hash are alike but for ignored columns, so
    either may take either number.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), *keep)
    same = Window.partitionBy("doc_id").orderBy("source", "size", "text_hash")
    return rows.withColumn("copy", F.row_number().over(same).cast("long") - 1)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents themselves: each row as often as the plan takes it, all columns kept."""
    plan = plan_mix(docs, **how).filter("times > 0").select(
        F.col("doc_id").alias("p_id"), F.col("copy").alias("p_copy"), "times")
    whole = numbered(docs, F.struct(*docs.columns).alias("row"))
    joined = whole.join(plan, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("copy") == F.col("p_copy")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def mixed_digest(docs: DataFrame) -> DataFrame:
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "times")
