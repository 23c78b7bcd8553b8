"""Token records, packing, WARC, mixing and the pipeline."""

import itertools
import random

import brute
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from tests.conftest import SMALL
from vacantia.llm import mixing, packing, queries, records, tokens, warc
from vacantia.session import scratch_path


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def test_cached_pieces_equal_the_tokenizer():
    enc = tokens.Encoder(tokens.default_path())
    random.seed(1)
    parts = ["a", "the", " ", "  ", "\n", "\t", " ", "é", "1", ".", "!", "'s", "<|endoftext|>", "　", "日本", "\r\n", "\x1c", "\x85", "x" * 300]
    texts = ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(4000)]
    got = [np.frombuffer(b, enc.dtype).tolist() for lo in range(0, 4000, 500) for b in enc.encode(texts[lo:lo + 500])]
    assert got == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_records_query(spark):
    ids, at, want = brute.encoded(documents(spark)), 0, {}
    for i in sorted(ids):
        want[i] = (at, len(ids[i]), brute.crc(ids[i]))
        at += len(ids[i])
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op5_token_records(spark, SMALL).collect()} == want


def test_records_edges_index_and_damage(spark, hard_docs, no_docs):
    folder = scratch_path(spark, "records-test")
    manifest = records.write_records(hard_docs, folder)
    rows = records.read_records(manifest, folder).orderBy("start").collect()
    assert len(rows) == hard_docs.count() and rows[0].doc_id is None
    assert [r.start for r in rows] == [0, *itertools.accumulate(r.n_tokens for r in rows)][:-1]
    assert next(r.n_tokens for r in rows if r.doc_id == 3) == 1
    shard = manifest.filter("records > 1").orderBy("shard").first()
    doc, ids = records.read_at(folder, shard["shard"], 1)
    assert ids[-1] == 0 and brute.crc(ids) in {r.ids_crc32 for r in rows}
    with open(f"{folder}/{shard['file']}", "r+b") as f:
        f.seek(20)
        byte = f.read(1)
        f.seek(20)
        f.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="broken record"):
        records.read_records(manifest, folder).collect()
    assert records.record_digest(no_docs).count() == 0


def check_packing(rows, ids, window=1024):
    rows = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id, r.start))
    seen = {}
    for r in rows:
        piece = ids[r.doc_id][r.start:r.start + r.length]
        assert seen.get(r.doc_id, 0) == r.start and len(piece) == r.length > 0
        assert brute.crc(piece) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] = r.start + r.length
    assert seen == {i: len(v) for i, v in ids.items()}
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert sorted(fill) == list(range(len(fill)))
    assert all(v == window for k, v in fill.items() if k != len(fill) - 1)


def test_packing_query(spark):
    check_packing(queries.op9_packing(spark, SMALL).collect(), brute.encoded(documents(spark)))


def test_packing_edges(hard_docs, no_docs):
    docs = hard_docs.dropDuplicates(["doc_id", "text"])
    check_packing(packing.packed_digest(docs.repartition(3)).collect(), brute.encoded([(r.doc_id, r.text) for r in docs.collect()]))
    assert packing.packed_digest(no_docs).count() == 0
    pieces = packing.pack(hard_docs, window=64)
    filled = packing.sequences(pieces, 64).collect()
    assert all(len(r.ids) == 64 or len(r.ids) == r.length for r in filled)
    assert sum(r.length for r in filled) == pieces.groupBy().sum("length").first()[0]


def test_warc_query(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html").collect()]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op6_warc(spark, SMALL).collect()}
    assert got == brute.warc(pages)


def test_warc_edges_rolling_and_reruns(spark):
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "u\r\nX: y", None), (4, "u", ""), (5, "u", "ünï" * 500),
            (None, "u", "same"), (7, "u", "twice"), (7, "u", "twice"), (8, "u", "x" * 200_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    folders = [scratch_path(spark, "warc-test") for _ in range(2)]
    manifests = [warc.write_warc(df, f, roll_bytes=300) for f in folders]
    got = [sorted(warc.read_warc(m, f).collect(), key=str) for m, f in zip(manifests, folders, strict=True)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    bytes_ = [{r.file: open(f"{f}/{r.file}", "rb").read() for r in m.collect()} for m, f in zip(manifests, folders, strict=True)]
    assert bytes_[0] == bytes_[1] and len(bytes_[0]) > 3
    kind = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got[0])
    assert kind[:5] == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None)]
    assert [k[1:] for k in kind if k[0] == 7] == [("response", None), ("revisit", 7)]
    assert warc.warc_digest(df.limit(0)).count() == 0


def plain_targets(sizes, share=1.5, weights=mixing.WEIGHTS, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        t = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = {s for s in free if t[s] > most * sizes[s]}
        if not over:
            return {**{s: most * sizes[s] for s in capped}, **t}
        capped |= over


def test_mix_query(spark):
    rows = queries.op7_source_mix(spark, SMALL).toPandas()
    again = queries.op7_source_mix(spark, SMALL).toPandas()
    key = ["doc_id", "taken"]
    assert rows[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    size = {i: len(brute.WORD.findall(t or "")) for i, t in documents(spark)}
    assert dict(zip(rows.doc_id, rows["size"], strict=True)) == size
    assert (rows.taken <= 2 * rows["size"]).all()
    per = rows.groupby("source").agg(size=("size", "sum"), given=("source_size", "max"), target=("target", "max"), taken=("taken", "sum"))
    assert (per["size"] == per.given).all()
    want = pd.Series(plain_targets(per["size"].to_dict()))
    assert np.allclose(per.target, want[per.index])
    assert ((per.taken - per.target).abs() <= 0.05 * per.target + 30).all()


def test_mix_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 40)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = [(i, " ".join(["w"] * (1 + i * 7919 % 97)), "ab"[i % 10 == 0]) for i in range(3000)]
    got = mixing.mixed_digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert len(got) == 3000 and got.doc_id.is_unique
    per = got.groupby("source").agg(target=("target", "max"), taken=("taken", "sum"))
    assert ((per.taken - per.target).abs() < 48).all()  # half of the largest document


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(2)
    size, p = rng.integers(1, 1000, 500), rng.random(500)
    out = mixing.flight(size, p, rng.random(500))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * size).sum() - (p * size).sum()) < 1e-3


def test_mix_edges(spark, hard_docs, no_docs):
    rows = mixing.mixed_digest(hard_docs).toPandas()
    assert len(rows) == hard_docs.count() and rows.times.ge(0).all()
    mixed = mixing.mix(hard_docs)
    assert mixed.columns == hard_docs.columns and mixed.count() == rows.times.sum()
    assert mixing.mixed_digest(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert mixing.mixed_digest(blank).toPandas().taken.tolist() == [0, 0]


def test_pipeline(spark):
    """Each stage on its own input, then the packed result against the mixed documents."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(corpus_pipeline.save(stage(spark, kept[-1], SMALL), "pipeline-test"))
        assert kept[-1].columns == docs.columns
    clean, single, private, mixed = ([tuple(r)[:2] for r in k.collect()] for k in kept[1:])
    assert 0.7 * docs.count() <= len(clean) <= docs.count()
    comp = brute.jaccard(clean, 5, 80)
    assert sorted(i for i, _ in single) == sorted(i for i, v in comp.items() if v[1] == i)
    assert sorted(i for i, _ in private) == sorted(i for i, _ in single)
    assert {i for i, _ in mixed} <= {i for i, _ in private}
    out = corpus_pipeline.run(spark, SMALL)
    ids = brute.encoded(dict(mixed).items())
    total = sum(len(ids[i]) for i, _ in mixed)
    rows = out.collect()
    assert sum(r.length for r in rows) == total
    assert all(brute.crc(ids[r.doc_id][r.start:r.start + r.length]) == r.ids_crc32 for r in rows)


def test_pipeline_edges(spark, hard_docs, no_docs):
    for start in (hard_docs, no_docs):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.save(stage(spark, docs, SMALL), f"pipeline-edge-{name}")
        assert (docs.count() > 0) == (start is hard_docs)
