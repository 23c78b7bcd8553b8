"""Jaccard join, lattice near-duplicates, nearest neighbours, components: against brute force."""

import random

import brute
import numpy as np
import pytest

from tests.conftest import SMALL
from vacantia.llm import components, lattice, neighbours, queries, token_groups

VECTORS = "vec_id long, embedding array<float>, label int, rank string, cell int"


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def test_jaccard_query_equals_brute_force(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_ngram_jaccard(spark, SMALL).collect()}
    assert got == brute.jaccard(documents(spark), 3, 90)


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_jaccard_of_crowded_groups(spark, monkeypatch, size, percent):
    """A group of near copies larger than a block, with chains that only some members link."""
    monkeypatch.setattr(token_groups, "BLOCK_ROWS", 8)
    random.seed(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(random.choice((0, 1, 1, 2, 3, 8))):
            words[random.randrange(len(words))] = f"x{random.random()}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(base[:30]) + " " + " ".join(f"p{i}_{k}" for k in range(60))) for i in range(40)]
    rows += [(300 + i, f"short text {i % 3}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in token_groups.jaccard_classes(df, size, percent).collect()}
    assert got == brute.jaccard(rows, size, percent)


def test_jaccard_edge_rows(hard_docs, no_docs):
    rows = token_groups.jaccard_classes(hard_docs, 3, 90).collect()
    assert len(rows) == hard_docs.count()
    comp = {(r.doc_id, r.component_id) for r in rows}
    assert {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 6), (8, 8), (9, 8), (None, None)} <= comp
    kept = token_groups.one_per_class(hard_docs, 5, 80)
    assert kept.columns == hard_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 8, 11, 12, 13] and ids.count(None) == 1
    assert token_groups.jaccard_classes(no_docs).count() == 0
    assert token_groups.one_per_class(no_docs).count() == 0


def test_dense_and_sparse_blocks_agree(monkeypatch):
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(30)]
    dense = sorted(token_groups.links_between(sets, sets, 70))
    monkeypatch.setattr(token_groups, "DENSE", 1)
    assert sorted(token_groups.links_between(sets, sets, 70)) == dense
    assert dense == [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets)
                     if 100 * len(np.intersect1d(a, b)) >= 70 * len(np.union1d(a, b))]


def test_components_of_a_long_chain(spark):
    ids = list(range(200))
    random.seed(1)
    random.shuffle(ids)
    edges = [(a, b) for a, b in zip(ids, ids[1:], strict=False) if a % 17 and b % 17] + [(5, 5)]
    got = {r.id: r.component_id for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute.union_find(ids, edges)
    assert all(got.get(i, i) == want[i] for i in ids)


def vectors(n=400, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(n // 2, n):  # near copies at every distance around the threshold
        x[i] = x[rng.integers(0, 20)] + rng.standard_normal(dim) * rng.choice([0, 0.02, 0.1, 0.2, 0.3])
    return [(i, [float(np.float32(v)) for v in x[i]], int(i % 2)) for i in range(n)]


def test_lattice_recall_and_precision(spark, monkeypatch):
    rows = vectors(600)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicates(df, tile=16).collect()}
    want = brute.cosine(rows, 0.98)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values()) > 100
    assert np.mean([got[i] == want[i] for i in want]) > 0.97


def test_lattice_points():
    x = np.random.default_rng(0).standard_normal((200, 8)) * 3
    p = lattice.decode(x)
    steps = lattice.minimal_vectors()
    assert np.allclose((2 * p) % 1, 0) and np.allclose(p.sum(1) % 2, 0)
    far = ((x[:, None] - p[:, None] - steps[None]) ** 2).sum(2)
    assert (far >= ((x - p) ** 2).sum(1)[:, None] - 1e-9).all()


BAD = [(None, [1.0, 0.0], 1), (1000, None, 1), (1001, [0.0, 0.0], 1), (1002, [float("nan"), 1.0], 1), (1003, [None, 1.0], 1),
       (1004, [float("inf"), 1.0], 1), (1005, [1.0, 0.0], None), (1006, [], 1), (1007, [1.0, 0.0], 1), (1008, [2.0, 0.0], 1),
       (1009, [1.0, 0.0], 1), (1010, [1.0, 0.0, 0.0], 1), (1100, [1.0, 0.0], 2), (1100, [1.0, 0.0], 2)]


def test_lattice_edge_rows(spark):
    df = spark.createDataFrame([(*r, None, None) for r in BAD], VECTORS)
    rows = lattice.near_duplicates(df).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}
    assert len(rows) == len(BAD)
    assert got[1007] == (2, 1007, True) and got[1008] == (2, 1007, False) and got[1009][:2] == (2, 1007)
    assert all(got[i] == (0, i, True) for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006, 1010))
    assert got[None][:2] == (0, None)
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_lattice_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op2_embedding_near_dedup(spark, SMALL).collect()}
    assert got == brute.cosine(rows, 0.98)


def test_neighbours_are_exact(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 37)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 3)
    rows = vectors(500)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.neighbours_digest(df).collect())
    want = sorted(brute.nearest(rows, 100, 10))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=0)


def test_neighbours_edge_rows(spark):
    df = spark.createDataFrame([(*r, None, None) for r in BAD], VECTORS)
    rows = sorted((r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(df.filter("vec_id = 1007"), df, 3).collect())
    assert rows == [(1007, 1, 1005), (1007, 2, 1009), (1007, 3, 1100)]
    assert neighbours.nearest(df.limit(0), df).count() == 0
    assert neighbours.nearest(df.filter("vec_id = 1010"), df).count() == 0  # no other vector of its length
    query = queries.op8_nearest_neighbours(spark, SMALL).collect()
    real = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in query) == sorted(w[:3] for w in brute.nearest(real, 100, 10))
