"""Spelling variants, the conversation trie and suffix dedup against brute force, and on hard inputs."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.llm import passages, prefix_trie, sketch, spelling, suffix_groups


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


# -- spelling variants --

def test_scan_of_a_sorted_list_finds_every_near_word():
    draw = random.Random(1)
    for letters in ("ab", "abc", "aé"):
        for _ in range(60):
            words = sorted({"".join(draw.choice(letters) for _ in range(draw.randint(1, 8))) for _ in range(50)})
            shared = spelling.adjacent_shared(words)
            for word in words:
                for known in range(min(len(word), 4)):
                    found = [words[i] for i in spelling.one_edit(word, words, shared, known)]
                    assert found == [v for v in words if one_apart(word, v) and v[:known] == word[:known]]


def test_no_block_with_a_near_word_is_skipped():
    draw = random.Random(2)
    for _ in range(4000):
        a, b = ("".join(draw.choice("ab") for _ in range(draw.randint(1, 7))) for _ in range(2))
        if one_apart(a, b):
            assert all(spelling.may_lead(a[:k], b) for k in range(len(a) + 1))
    assert not spelling.may_lead("abcd", "axyd") and not spelling.may_lead("abcdef", "abcd")


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_variants_equal_brute_force_for_any_block_size(spark, block):
    draw = random.Random(block)
    words = {"".join(draw.choice("abé") for _ in range(draw.randint(6, 9))) for _ in range(150)} | {"prefix" + "".join(draw.choice("ab") for _ in range(4)) for _ in range(30)}
    counts = {w: draw.choice([5, 6, 30, 200, 2000]) for w in words}
    vocab = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    near = {w: sorted((v for v in words if one_apart(w, v)), key=lambda v: (-counts[v], v)) for w in words}
    got = {r["word"]: (r["n_near"], r["best"]["form"], -r["best"]["minus_n"]) for r in spelling.near_words(vocab, block).collect()}
    assert got == {w: (len(v), v[0], counts[v[0]]) for w, v in near.items() if v}
    form = {w: v[0] for w, v in near.items() if v and counts[v[0]] >= 5 * counts[w]}

    def root(w):
        return root(form[w]) if w in form else w

    rows = {r["word"]: (r["form"], r["root"], r["n_near"], r["form_n"]) for r in spelling.variants(vocab).collect()}
    assert rows == {w: (form.get(w), root(w), len(near[w]), counts[form[w]] if w in form else None) for w in words}


def test_vocabulary_of_hard_documents(spark, hard_docs, no_docs):
    rows = {r["word"]: r["n"] for r in spelling.vocabulary(hard_docs, every=2, least=1).collect()}
    want = Counter()
    import re
    for doc in hard_docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", doc["text"] or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc['doc_id'] is None else doc['doc_id']}:{run}".encode())
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 2 == 0 else run] += 1
    assert rows == {w: n for w, n in want.items() if len(w) >= 6}
    assert spelling.variants_digest(no_docs).count() == 0
    assert spelling.variants_digest(hard_docs).columns == ["word", "form", "root", "n", "n_near", "form_n"]


# -- conversation trie --

CONVERSATIONS = "conv_id long, turn int, role string, text string, depth int, lane1 string, digest string"


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            said = f"{len(role)}:{role}{text}"
            own[conv].append(((turn is not None, turn or 0, hashlib.sha256(said.encode()).hexdigest()), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        paths[c] = own.get(base, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    out = []
    for node, members in nodes.items():
        under = [n for n in nodes if n[:len(node)] == node]
        parents = {n[:-1] for n in nodes if n}
        ends = sorted(c for c in members if len(paths[c]) == len(node))
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members),
                    sum(n[:-1] == node for n in nodes if n), sum(n not in parents for n in under),
                    sum((len(nodes[n]) - 1) * len(n[-1][1]) for n in under if n),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def random_conversations(seed, n):
    draw = random.Random(seed)
    rows = [(None, 1, "user", "nobody", 1, "x", "y"), (100, None, None, None, 1, "x", "y"), (100, 3, "user", "é" * 50, None, None, None),
            (100, 3, "user", "é" * 50, None, None, None), (-205, 1, "user", "below", None, None, None)]
    for conv in draw.sample(range(0, 420), n):
        for turn in range(draw.randint(1, 9)):
            rows.append((conv, turn if draw.random() > .1 else None, draw.choice(["user", "bot", None]), draw.choice(["a", "bb", "", "ccc"]), 0, "l", "d"))
    long = [(700, t, "user", f"turn {t % 5}", None, None, None) for t in range(300)]
    return rows + long + [(701, *row[1:]) for row in long]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rows = random_conversations(seed, 60)
    got = prefix_trie.trie(spark.createDataFrame(rows, CONVERSATIONS))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows)
    assert prefix_trie.trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_trie_stays_right_when_the_sketch_is_too_small(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie.sketch, "surely_once", lambda bits, keys, cells: keys % np.uint64(2) > 5)
    rows = random_conversations(3, 40)
    got = prefix_trie.trie(spark.createDataFrame(rows, CONVERSATIONS))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows)


def test_running_sums_cross_partitions(spark):
    draw = random.Random(5)
    rows = [(draw.choice([1, 1, 1, 2, 9]), i, draw.randint(-2**62, 2**62)) for i in range(4000)]
    got = prefix_trie.running(spark.createDataFrame(rows, "k long, o long, v long").repartition(7), "k", ["o"], ["v"], "test").collect()
    want, total = {}, Counter()
    for k, o, v in sorted(rows):
        total[k] = (total[k] + v + 2**63) % 2**64 - 2**63
        want[o] = total[k]
    assert {r["o"]: r["v"] for r in got} == want


def test_sketch_never_proves_a_repeated_key(spark):
    keys = np.concatenate([np.arange(5000, dtype=np.uint64), np.arange(100, dtype=np.uint64) * np.uint64(7)])
    cells = sketch.size_for(len(keys))
    rows = spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(5)
    touched = rows.mapInArrow(lambda batches: sketch.touch((b.column(0).to_numpy().astype(np.uint64) for b in batches), cells), sketch.TOUCHED)
    once = sketch.surely_once(sketch.met_twice(touched, cells), np.arange(5000, dtype=np.uint64), cells)
    assert not once[np.arange(100) * 7].any() and once.sum() > 4000


# -- suffix dedup --

def test_suffix_order_by_grouping():
    draw = random.Random(3)
    for k in range(1500):
        s = [draw.randint(1, draw.choice([1, 2, 3, 6])) for _ in range(draw.randint(0, 30))]
        if k % 3 == 0 and len(s) > 3:
            s = (s[:draw.randint(1, 4)] * 10)[:len(s)]
        s.append(0)
        assert suffix_groups.suffix_order(np.array(s)) == sorted(range(len(s)), key=lambda i: s[i:])


def test_repeated_windows_of_texts(monkeypatch):
    draw = random.Random(4)
    for _ in range(200):
        monkeypatch.setattr(suffix_groups, "SHARE_BITS", draw.choice([1, 2, 3, 5]))
        base, texts = bytes(draw.choice(b"abcde ") for _ in range(300)), []
        for _ in range(draw.randint(1, 8)):
            a = draw.randint(0, 250)
            text = bytearray(base[a:a + draw.randint(0, 120)])
            for _ in range(draw.randint(0, 2) if text else 0):
                text[draw.randrange(len(text))] = 97
            texts.append(bytes(text) if draw.random() > .2 else b"aab" * draw.randint(0, 30))
        copies, w = [draw.choice([1, 1, 1, 2]) for _ in texts], draw.choice([5, 8, 20, 40])
        count = Counter()
        for text, n in zip(texts, copies, strict=True):
            for i in range(len(text) - w + 1):
                count[text[i:i + w]] += n
        want = [[count[t[i:i + w]] > 1 for i in range(len(t) - w + 1)] for t in texts]
        assert [m.tolist() for m in suffix_groups.repeated_windows(texts, copies, w)] == want


def brute_repeats(texts, width):
    """For each text the removed spans and what stays."""
    count = Counter(t[i:i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if count[t[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        n_spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [300, 16 << 20])
def test_spans_equal_brute_force_also_when_keys_are_crowded(spark, most):
    draw, width = random.Random(6), 40
    shared = ["".join(draw.choice("ab cdé") for _ in range(90)) for _ in range(4)]
    texts = []
    for _ in range(120):
        texts.append("".join(draw.choice([*shared, "".join(draw.choice("xyzü ") for _ in range(draw.randint(0, 60)))]) for _ in range(draw.randint(0, 4))))
    texts += ["", "aab" * 60, "q" * 300, texts[0], shared[0][:40], shared[0][:39], None]
    rows = [(i if i % 7 else None, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, body string, key int").repartition(3)
    got = passages.without_repeats(docs, width, most=most)
    want = [(r[0], *w) for r, w in zip(rows, brute_repeats([(t or "").encode() for t in texts], width), strict=True)]
    assert sorted(map(repr, map(tuple, got.drop("spans", "kept").collect()))) == sorted(map(repr, want))
    for r in got.collect():
        assert r["n_removed"] == sum(s["b"] - s["a"] for s in r["spans"]) and hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]


def test_hard_documents_keep_their_rows(spark, hard_docs, no_docs):
    got = passages.passages_digest(hard_docs)
    want = [(r["doc_id"], *w) for r, w in zip(hard_docs.collect(), brute_repeats([(r["text"] or "").encode() for r in hard_docs.collect()], 400), strict=True)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert passages.passages_digest(no_docs).count() == 0
    assert got.agg(F.sum("n_removed")).first()[0] > 50_000
