"""Near-duplicate embeddings by lattice hashing.

Vectors are scaled to length one and projected at random to two groups of eight
dimensions per table; each group is decoded to its nearest point of the E8
lattice. A vector enters the cell of its two points and the two neighbouring cells
that it is nearest to. Vectors of one cell are compared as blocks of bounded
size by exact cosine in double precision. A pair that meets in several cells counts
in the smallest cell key the two share, so links are counted without listing pairs.

Recall against brute force is measured in the tests (0.9 is asked for; a pair at
the threshold itself meets in a table with probability of about 0.7, so in eight
with more than 0.999); no link below the threshold is ever returned.

Defined results: vectors that are null, zero or hold null or non-finite
components, and those with a null label or id, link with nothing and are
returned as their own component; vectors of different lengths never link; rows
that share an id are one vertex, and their links are summed; repeated rows with
other ids link at cosine 1; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import prepare, save
from vacantia.llm.components import components, local_roots

SCALE = 1.8       # of unit vectors in lattice units, for each group of eight dimensions
GROUPS = 2        # E8 points in a cell
TABLES = 8
TILE = 1024       # vectors in a block
SEED = 11


def _d8(x: np.ndarray) -> np.ndarray:
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    k = np.abs(off[odd]).argmax(1)
    near[odd, k] += np.where(off[odd, k] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 lattice point of each row of eight: D8, or D8 shifted by a half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(maxsize=1)
def minimal_vectors() -> np.ndarray:
    """The 240 shortest lattice vectors: steps to neighbouring cells."""
    pairs = [np.eye(8)[i] * s + np.eye(8)[j] * t for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)]
    signs = np.array(np.meshgrid(*[[0.5, -0.5]] * 8)).reshape(8, -1).T
    return np.vstack([np.array(pairs), signs[(signs < 0).sum(1) % 2 == 0]])


def second(x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The neighbouring cell nearest to each row, and how much farther it is (squared)."""
    steps = minimal_vectors()
    # |x - cell - step|^2 - |x - cell|^2 = |step|^2 - 2 (x - cell) step
    more = 2.0 - 2.0 * (x - cell) @ steps.T
    k = more.argmin(1)
    return cell + steps[k], more[np.arange(len(x)), k]


@lru_cache(maxsize=4)
def projections(dim: int, tables: int, scale: float, seed: int) -> np.ndarray:
    """``tables x GROUPS`` matrices ``dim x 8``; lengths are kept on average."""
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((tables, GROUPS, dim, 8)) * (scale / np.sqrt(8.0))


def cells(unit: np.ndarray, labels: np.ndarray, tables: int = TABLES, scale: float = SCALE, seed: int = SEED) -> np.ndarray:
    """Cell keys of unit vectors: for each table the own cell and its two nearest neighbours."""
    out = np.empty((len(unit), tables * 3), np.uint64)
    base = np.full(len(unit), unit.shape[1], np.uint64) * _M[2] + labels.astype(np.int64).view(np.uint64) * _M[0]
    for t, mats in enumerate(projections(unit.shape[1], tables, scale, seed)):
        own, near, far = [], [], []
        for m in mats:
            x = unit @ m
            c = decode(x)
            s, more = second(x, c)
            own.append(_key(c))
            near.append(_key(s))
            far.append(more)
        # cells that differ in one group: the two cheapest with two groups
        both = [own, [near[0], own[1]], [own[0], near[1]]]
        for k, points in enumerate(both):
            key = base + np.uint64((t + 1) * int(_M[1]) % (1 << 64))
            for g, p in enumerate(points):
                key = (key ^ p) * _M[g % 3] ^ (key >> np.uint64(31))
            out[:, 3 * t + k] = key
    return out


_M = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def _key(points: np.ndarray) -> np.ndarray:
    twice = (2 * points).astype(np.int64).view(np.uint64)
    key = np.zeros(len(points), np.uint64)
    for j in range(8):
        key = (key + twice[:, j] + np.uint64(1)) * _M[0]
        key ^= key >> np.uint64(29)
    return key


def usable(vector) -> F.Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _keys_of(tables: int):
    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            flat, cuts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            sizes, labels = np.diff(cuts), batch.column("label").to_numpy()
            keys = np.empty((batch.num_rows, tables * 3), np.uint64)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = np.stack([flat[cuts[i]:cuts[i + 1]] for i in at]).astype(float)
                x /= np.abs(x).max(1, keepdims=True)
                keys[at] = cells(x / np.linalg.norm(x, axis=1, keepdims=True), labels[at], tables)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))],
                                             names=["rep", "keys"])
    return run


def _compare(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        key = np.int64(group.column("cell")[0].as_py())
        rep, side, count = (group.column(c).to_numpy() for c in ("rep", "side", "copies"))
        take = group.column("embedding").combine_chunks()
        x = take.values.to_numpy(zero_copy_only=False).reshape(len(rep), -1).astype(float)
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        keys = group.column("keys").combine_chunks().values.to_numpy().reshape(len(rep), -1)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(right)
        right = left if same else right
        i, j = np.nonzero(x[left] @ x[right].T >= threshold)
        i, j = left[i], right[j]
        ok = i < j if same else rep[i] != rep[j]
        i, j = i[ok], j[ok]
        first = np.empty(len(i), bool)
        order = np.sort(keys, 1)
        for lo in range(0, len(i), 4096):  # the smallest key that both hold decides where a pair counts
            a, b = order[i[lo:lo + 4096]], order[j[lo:lo + 4096]]
            shared = (a[:, :, None] == b[:, None, :]).any(2)
            smallest = a[np.arange(len(a)), shared.argmax(1)]
            first[lo:lo + 4096] = smallest == key
        i, j = i[first], j[first]
        links = np.zeros(len(rep), np.int64)
        np.add.at(links, i, count[j])
        np.add.at(links, j, count[i])
        by = np.argsort(rep, kind="stable")
        rank = np.empty(len(rep), int)
        rank[by] = np.arange(len(rep))
        roots = local_roots(len(rep), zip(rank[i], rank[j], strict=True))
        root = rep[by[np.array(roots, int)[rank]]]
        some = links > 0
        return pa.table({"rep": rep[some], "links": links[some], "root": root[some]})
    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tables: int = TABLES, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``."""
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                          F.col("label").cast("long").alias("label"))
    good = rows.filter(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    # equal vectors of one label go on as one, with their number
    classes = save(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "lattice-classes")
    keys = save(classes.select("rep", "label", "embedding").mapInArrow(_keys_of(tables), "rep long, keys array<long>"), "lattice-keys")
    entered = keys.select("rep", F.explode(F.array_distinct("keys")).alias("cell"))
    shared = entered.groupBy("cell").agg(F.count("*").alias("held")).filter("held > 1")
    n = F.ceil(F.col("held") / tile).cast("int")
    placed = (entered.join(shared, "cell").withColumn("blocks", n)
              .withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "rep"), F.col("blocks")).cast("int")))
    # a block meets itself and every other block of its cell
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least(o, F.col("block")).alias("p"), F.greatest(o, F.col("block")).alias("q"),
        (F.col("block") > o).cast("int").alias("side")))
    tasks = placed.select("rep", "cell", F.explode(meets).alias("m")).select("rep", "cell", "m.*")
    wide = tasks.join(classes.select("rep", "embedding", "copies", "label"), "rep").join(keys, "rep")
    found = save(wide.groupBy("cell", "p", "q").applyInArrow(_compare(threshold), "rep long, links long, root long"), "lattice-links")
    edges = found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    copies = good.join(classes, ["label", "embedding"]).select("vec_id", "rep", "copies")
    copies = save(copies, "lattice-members")
    several = copies.filter("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    roots = components(edges.unionByName(several))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per_id = (copies.join(links, "rep", "left").groupBy("vec_id")
              .agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
              .withColumnRenamed("vec_id", "v"))
    return (rows.select("vec_id").join(per_id, F.col("vec_id") == F.col("v"), "left")
            .join(roots, F.col("vec_id") == F.col("id"), "left")
            .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
