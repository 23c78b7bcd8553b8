"""Nearest neighbours by a block matrix join with int8 tiles.

Rows are dealt into tiles of bounded size, queries into blocks; each pair of
query block and tile is one unit of work. Within it, vectors are rounded to eight
bits with one scale per vector. A product of the rounded values gives every distance
between the rounded vectors, and the length of what rounding removed bounds its
error on both sides. Whatever cannot be ruled out against the k-th upper bound is
recomputed in double precision on the original vectors. The k best of each unit
are kept by a heap per query within a task, and then merged over tasks. The
result is exact: bounds only save work.

Defined results: vectors that are null, zero or hold null or non-finite
components, and rows with a null id, take no part; a candidate of another length
than the query is none; rows with the query's own id are not its candidates;
other repeated rows are candidates one by one; with fewer candidates all are
returned; an empty table or query set gives no row; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vacantia.llm.common import prepare, save
from vacantia.llm.lattice import usable

TILE = 4096        # candidates in a tile
QUERY_BLOCK = 512  # queries in a block
FOUND = "query_id long, vec_id long, score double"
PACKED = "block long, dim int, n int, ids binary, vectors binary"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the length of the rounding error of each row."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def tile_best(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int):
    """For each query its ``k`` nearest in the tile: lists of ``(score, id)`` in order."""
    q8, qs, qe = quantise(q)
    c8, cs, ce = quantise(c)
    # products of int8 values, exact in float64 up to 2^53
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    dots = (q8.astype(kind) @ c8.astype(kind).T) * (qs[:, None] * cs[None])
    lengths = [((v8.astype(float) ** 2).sum(1) * s * s) for v8, s in ((q8, qs), (c8, cs))]
    square = np.maximum(lengths[0][:, None] + lengths[1][None] - 2 * dots, 0)
    near, slack = np.sqrt(square), qe[:, None] + ce[None]
    # room for floating-point rounding of the products themselves
    slack = slack + 1e-5 * (np.sqrt(lengths[0])[:, None] + np.sqrt(lengths[1])[None])
    own = qid[:, None] == cid[None]
    upper = np.where(own, np.inf, near + slack)
    bound = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] >= k else np.full(len(q), np.inf)
    open_ = ~own & (near - slack <= bound[:, None])
    for i in range(len(q)):
        at = np.flatnonzero(open_[i])
        # summed component by component, so that the score does not depend on the shape of the tile
        exact = np.sqrt(np.cumsum((c[at] - q[i]) ** 2, axis=1)[:, -1])
        order = np.lexsort((cid[at], exact))[:k]
        yield int(qid[i]), [(float(exact[o]), int(cid[at[o]])) for o in order]


def _packed(rows: DataFrame, per_block: int, label: str) -> DataFrame:
    """Rows as blocks of at most ``per_block`` vectors of one length; each partition fills its own."""
    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                mine = held.setdefault(len(v), [])
                mine.append((i, v))
                if len(mine) == per_block:
                    yield block(len(v), mine)
                    held[len(v)] = []
        for dim, mine in held.items():
            if mine:
                yield block(dim, mine)

    def block(dim, mine):
        ids = np.array([m[0] for m in mine], np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array([0], pa.int64()), pa.array([dim], pa.int32()), pa.array([len(mine)], pa.int32()),
            pa.array([ids.tobytes()], pa.binary()), pa.array([np.array([m[1] for m in mine]).tobytes()], pa.binary())],
            names=["block", "dim", "n", "ids", "vectors"])

    blocks = rows.mapInArrow(run, PACKED).withColumn("block", F.monotonically_increasing_id())
    return save(blocks, label)


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest by Euclidean distance, ties to the smaller id."""
    prepare(candidates.sparkSession)

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector")).filter(
            F.col("id").isNotNull() & usable(F.col("vector")))

    spark = candidates.sparkSession
    q = _packed(clean(queries), QUERY_BLOCK, "neighbours-queries")
    c = _packed(clean(candidates), TILE, "neighbours-tiles")
    # the contract's work: every query block with every tile of the same length
    left = q.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    right = c.select("dim", F.col("block").alias("c_block"), "ids", "vectors")
    pairs = left.select("dim", "q_block").join(right.select("dim", "c_block"), "dim")
    work = (pairs.join(right, ["dim", "c_block"]).join(left, ["dim", "q_block"])
            .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_block", "q_block")
            .select("dim", "q_ids", "q_vectors", "ids", "vectors"))

    def run(batches):
        heaps: dict[int, list] = {}
        for batch in batches:
            for dim, qi, qv, ci, cv in zip(*(batch.column(n) for n in ("dim", "q_ids", "q_vectors", "ids", "vectors")), strict=True):
                dim = dim.as_py()
                arrays = [np.frombuffer(a.as_py(), t) for a, t in ((qi, np.int64), (qv, float), (ci, np.int64), (cv, float))]
                for qid, best in tile_best(arrays[0], arrays[1].reshape(-1, dim), arrays[2], arrays[3].reshape(-1, dim), k):
                    heaps[qid] = heapq.nsmallest(k, heapq.merge(heaps.get(qid, ()), best))
            if len(heaps) > 20_000:
                yield found(heaps)
                heaps = {}
        if heaps:
            yield found(heaps)

    def found(heaps):
        rows = [(i, v, s) for i, best in heaps.items() for s, v in best]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                           pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")  # a row is a pair of blocks
    best = save(work.mapInArrow(run, FOUND), "neighbours-found")
    prepare(spark)
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours_digest(vectors: DataFrame) -> DataFrame:
    return nearest(vectors.filter("vec_id % 100 = 0"), vectors)
