"""Connected components by alternating large-star and small-star steps.

Every step is a minimum by key and a join on the same key; its result is saved
in the shared folder. No edge or label passes through the driver, which only
compares a checksum of the edges to see whether they still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import save


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges(u, v)`` hold u > v. One step towards stars around the smallest id."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.withColumn("m", F.least("u", "m"))
        moved = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, component_id`` (smallest reachable id) for every id on an edge ``a, b``."""
    now = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
               .filter("u > v").distinct(), "components")
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        now = save(_star(save(_star(now, True), "components"), False), "components")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)


def local_roots(n: int, pairs) -> list[int]:
    """Union-find over ``0..n-1``: the smallest member of each item's set."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(int(a)), find(int(b))
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
