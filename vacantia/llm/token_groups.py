"""N-gram Jaccard join by a token-group matrix.

1. Each document becomes its set of word shingles (64-bit hashes). Documents with
   equal sets form a class and go on as one representative.
2. Similar representatives are partitioned into groups: those that agree on a band
   of min-hashes with the same leader. Large groups are dealt into blocks of
   bounded size. Every band of a document routes it to the groups that hold the
   band, so a pair at the threshold misses its meeting with probability below
   ``MISS`` (a constant per pair, at every size).
3. A block stores its token union. A query's overlap with the union bounds its
   similarity to every member; only blocks that can reach the threshold are
   opened, and there the exact set similarity decides.
4. Members already linked to the leader of their group need no comparison with
   each other, so tight groups of near copies cost a linear number of checks.

Nothing is capped: hot bands, passages and groups are split into more blocks.

Defined results: a null text and one without words have an empty set and link
with nothing; fewer words than a shingle make one shingle of all; rows that share an id are one
vertex; rows with a null id keep a null component and link nothing; repeated
rows are returned as often; an empty table gives no row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import prepare, save
from vacantia.llm.components import components, local_roots

MISS = 1e-12
ROWS = 3                 # min-hashes in a band
BLOCK_ROWS = 256         # representatives in a block
BLOCK_TOKENS = 400_000   # shingles in a block, about
DENSE = 4_000_000        # cells of an incidence matrix, at most
CHUNK = 100_000          # shingles hashed at once


def bands_for(similarity: float) -> int:
    """Bands after which a pair of this similarity is missed with probability ``MISS``."""
    return math.ceil(math.log(MISS) / math.log1p(-(similarity ** ROWS)))


_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C[3]
    return (x ^ (x >> np.uint64(29))) * _C[0] ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    Words are runs without ASCII white space, A-Z in lower case.
    """
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out * _C[1] + h[i:len(h) - n + 1 + i])
    return np.unique(out)


def _sketch(sets: list[np.ndarray], bands: int) -> np.ndarray:
    """Band values, one row per non-empty set."""
    seeds = _mix(np.arange(1, bands * ROWS + 1, dtype=np.uint64) * _C[2])
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    joined, out = np.concatenate(sets), np.zeros((len(sets), bands), np.uint64)
    for b in range(bands):
        value = np.full(len(sets), b + 1, np.uint64)
        for r in range(ROWS):
            seed = seeds[b * ROWS + r]
            value = _mix(value * _C[1] + np.minimum.reduceat((joined ^ seed) * (seed | np.uint64(1)), starts))
        out[:, b] = value
    return out


def sketches(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """``doc_id, n, d1, d2, bands``: set size, set digest and band values of every row."""
    from xxhash import xxh3_128_digest

    bands = bands_for(similarity)

    def run(batches):
        for batch in batches:
            sets = [shingles(t, size) for t in batch.column("text").to_pylist()]
            digest = np.frombuffer(b"".join(xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            some = [i for i, s in enumerate(sets) if len(s)]
            values: list[list[int] | None] = [None] * len(sets)
            at = 0
            while at < len(some):
                end, held = at, 0
                while end < len(some) and (end == at or held + len(sets[some[end]]) <= CHUNK):
                    held += len(sets[some[end]])
                    end += 1
                for i, v in zip(some[at:end], _sketch([sets[i] for i in some[at:end]], bands).view(np.int64), strict=True):
                    values[i] = v
                at = end
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]),
                 pa.array(digest[:, 1]), pa.array(values, pa.list_(pa.int64()))], names=["doc_id", "n", "d1", "d2", "bands"])

    return _rows(docs).mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bands array<long>")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _tokens(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            sets = [shingles(t, size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["rep", "n", "tokens"])
    return docs.mapInArrow(run, "rep long, n long, tokens array<long>")


def links_between(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs ``(i, j)`` with ``100 * overlap >= percent * union``, through the token union of ``b``."""
    union = np.unique(np.concatenate(b))
    sizes = np.array([len(s) for s in b])
    found, opened = [], []
    for i, q in enumerate(a):
        at = np.searchsorted(union, q)
        hit = at[(at < len(union)) & (union[np.minimum(at, len(union) - 1)] == q)]
        # overlap with any member <= len(hit), and union >= the larger set
        if 100 * len(hit) >= percent * max(len(q), int(sizes.min())):
            opened.append((i, hit))
    if not opened:
        return found
    step = max(1, DENSE // max(1, len(union)))
    if len(b) <= step:  # incidence matrix of the block: one product per slice of queries
        matrix = np.zeros((len(union), len(b)), np.float32)
        for j, s in enumerate(b):
            matrix[np.searchsorted(union, s), j] = 1
        for lo in range(0, len(opened), step):
            part = opened[lo:lo + step]
            rows = np.zeros((len(part), len(union)), np.float32)
            for k, (_, hit) in enumerate(part):
                rows[k, hit] = 1
            both = rows @ matrix
            total = np.array([len(a[i]) for i, _ in part])[:, None] + sizes[None] - both
            found += [(part[k][0], int(j)) for k, j in zip(*np.nonzero(100 * both >= percent * total), strict=True)]
        return found
    for i, _ in opened:
        n = len(a[i])
        for j in np.flatnonzero((100 * sizes >= percent * n) & (100 * n >= percent * sizes)):
            both = len(np.intersect1d(a[i], b[j], assume_unique=True))
            if 100 * both >= percent * (n + len(b[j]) - both):
                found.append((i, int(j)))
    return found


def _open_pair(percent: int):
    def run(group: pa.Table) -> pa.Table:
        rep, side = group.column("rep").to_numpy(), group.column("side").to_numpy()
        column = group.column("tokens").combine_chunks()
        flat, cuts = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
        sets = [flat[cuts[i]:cuts[i + 1]] for i in range(len(rep))]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(right):  # a block with itself
            right = left
        pairs = [(left[i], right[j]) for i, j in links_between([sets[i] for i in left], [sets[j] for j in right], percent)]
        order = np.argsort(rep, kind="stable")
        rank = np.empty(len(rep), int)
        rank[order] = np.arange(len(rep))
        roots = local_roots(len(rep), ((rank[i], rank[j]) for i, j in pairs))
        edges = [(int(rep[order[i]]), int(rep[order[r]])) for i, r in enumerate(roots) if i != r]
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})
    return run


def jaccard_classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    prepare(docs.sparkSession)
    sketch = save(sketches(docs, size, percent / 100), "jaccard-sketches")
    known = sketch.filter("n > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    member = save(known.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).select("doc_id", "rep"),
                  "jaccard-classes")

    # bands that two or more representatives share
    reps = known.join(member.filter("doc_id = rep").select(F.col("doc_id")), "doc_id", "left_semi")
    banded = reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("leader"), F.max("rep").alias("other")).filter("leader < other")
    routes = save(banded.join(shared.select("band", "leader"), "band"), "jaccard-routes")
    grouped = routes.groupBy("rep").agg(F.min("leader").alias("leader"))

    # sets of those representatives only
    wanted = grouped.select(F.col("rep").alias("doc_id"))
    tokens = save(_tokens(_rows(docs).join(wanted, "doc_id", "left_semi"), size).filter("n > 0"), "jaccard-tokens")

    # members against their leader
    lead = tokens.select(F.col("rep").alias("leader"), F.col("tokens").alias("lead_tokens"))
    both = F.size(F.array_intersect("tokens", "lead_tokens"))
    linked = (F.col("rep") == F.col("leader")) | (
        F.lit(100) * both >= F.lit(percent) * (F.size("tokens") + F.size("lead_tokens") - both))
    near = F.size("tokens").between(F.size("lead_tokens") * percent / 100, F.size("lead_tokens") * 100 / percent)
    labelled = save(tokens.join(grouped, "rep").join(lead, "leader").select(
        "rep", "leader", "n", (near & linked).alias("linked")), "jaccard-leaders")

    # blocks of bounded size inside each group
    weight = labelled.groupBy("leader", "linked").agg(F.count("*").alias("rows"), F.sum("n").alias("held"))
    dealt = F.ceil(F.greatest(F.col("rows") / BLOCK_ROWS, F.col("held") / BLOCK_TOKENS)).cast("long")
    slot = F.pmod(F.xxhash64(F.lit(5), "rep"), dealt)
    blocks = save(labelled.join(weight, ["leader", "linked"]).select(
        "rep", "leader", "linked", F.xxhash64("leader", "linked", slot).alias("block")), "jaccard-blocks")

    # pairs of blocks that share a band, unless one leader already links all of both
    held = (routes.select("rep", "band").join(blocks, "rep")
            .select("band", "block", F.when(F.col("linked"), F.col("leader")).alias("tied")).distinct())
    crowded = held.groupBy("band").agg(F.min("block").alias("x"), F.max("block").alias("y")).filter("x < y").select("band")
    held = held.join(crowded, "band", "left_semi")
    other = held.select("band", F.col("block").alias("right"), F.col("tied").alias("right_tied"))
    across = (held.join(other, "band").filter("block < right AND NOT (tied IS NOT NULL AND tied <=> right_tied)")
              .select(F.col("block").alias("left"), "right"))
    within = blocks.filter("NOT linked").groupBy("block").agg(F.count("*").alias("rows")).filter("rows > 1")
    pairs = save(across.distinct().unionByName(within.select(F.col("block").alias("left"), F.col("block").alias("right"))),
                 "jaccard-pairs")

    sets = tokens.join(blocks.select("rep", "block"), "rep")
    lefts = pairs.join(sets, F.col("left") == F.col("block")).select("left", "right", F.lit(0).alias("side"), "rep", "tokens")
    rights = (pairs.filter("left <> right").join(sets, F.col("right") == F.col("block"))
              .select("left", "right", F.lit(1).alias("side"), "rep", "tokens"))
    opened = lefts.unionByName(rights).groupBy("left", "right").applyInArrow(_open_pair(percent), "a long, b long")
    led = labelled.filter("linked AND rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b"))
    # an id whose rows differ in text is in several classes
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("a", "b")
    found = components(opened.unionByName(led).unionByName(several))

    named = (member.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(found, F.col("rep") == F.col("id"), "left")
             .select(F.col("doc_id").alias("d"), F.coalesce("component_id", "rep").alias("component_id")))
    return sketch.select("doc_id", F.col("n").alias("n_shingles")).join(named, F.col("doc_id") == F.col("d"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_per_class(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that another document of their class stands for.

    The smallest id of a class stays, as does every row that links with nothing
    (null and empty texts, null ids). Of repeated rows with one id the first by
    content stays.
    """
    classes = jaccard_classes(docs, size, percent)
    gone = classes.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    again = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("row")).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").unionByName(again.select(*docs.columns))
