"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding undoes the usual disguises: case, accents on Latin letters, letters of
other scripts that look Latin, and digits or signs that stand for letters inside a word.
The lexicon is learned from labelled rows: whole words and word beginnings,
weighted by how much likelier they make a toxic label. One automaton finds all
entries; at each word start the weightiest one counts, unless an exception
phrase covers it. The sum of weights, as such and per word, goes through a logistic
curve fitted on the same rows.

Bounds: at most ``SAMPLE_ROWS`` labelled rows are used for learning (chosen by
hash), and at most ``LEXICON`` entries are kept; both are parameters. Scoring
covers every whole text.

Defined results: null, empty and wordless texts score like a text without
matches; repeated rows score alike; rows with null ids take no part in learning;
an empty or one-sided label table gives an empty lexicon and the score 0; columns other
than ``doc_id`` and ``text`` are kept and never used.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.common import prepare, save

SAMPLE_ROWS = 16_000
LEXICON = 4_000
SHORTEST, LONGEST = 4, 12     # length of a word beginning
SUPPORT = 3                   # toxic training rows that must hold an entry
LEAST_WEIGHT = 2.0            # log odds of a toxic label, against the base rate
THRESHOLD = 0.3

# fixed values: look-alikes of Latin letters, and signs that stand for letters
HOMOGLYPHS = dict(zip("авекмнорстухіјѕԁԛԝɡαβεηικνορτυχωᴀᴄᴇᴏѵ", "abekmhopctyxijsdqwgabenikvoptuxwaceov", strict=True))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
# phrases in which a lexicon word is harmless
EXCEPTIONS = ("clown fish", "trash can", "trash bag", "trash bin", "pond scum", "sore loser rule")

_INVISIBLE = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_LETTERS = {ord(k): v for k, v in HOMOGLYPHS.items()}
_SIGNED = re.compile(r"[0-9@$!|]+")
_SPACE = re.compile(r"[\W_]+")


def _ascii_letters() -> dict[int, str]:
    """Accented Latin letters and full-width forms to their plain letter, from the Unicode tables."""
    out = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        if plain.isascii() and plain:
            out[code] = plain
    return out


@lru_cache(maxsize=1)
def _table() -> dict:
    marks = dict.fromkeys(range(0x300, 0x370))
    return _ascii_letters() | _LETTERS | _INVISIBLE | marks


def _letters_for(m: re.Match) -> str:
    """Signs as letters, where they stand in a word of two letters or more.

    At a word's edge only digits and a single @ or $ do.
    """
    text, a, b = m.string, m.start(), m.end()
    lo, hi = a, b
    while lo > 0 and a - lo < 40 and (text[lo - 1].isalnum() or text[lo - 1] in SIGNS):
        lo -= 1
    while hi < len(text) and hi - b < 40 and (text[hi].isalnum() or text[hi] in SIGNS):
        hi += 1
    inside = text[lo:a].strip("@$!|") and text[b:hi].strip("@$!|")
    letters = sum(c.isalpha() for c in text[lo:hi])
    if letters < 2 or not inside and not (m[0].isdigit() or m[0] in ("@", "$")):
        return m[0]
    return "".join(SIGNS.get(c, c) for c in m[0])


def fold(text: str) -> str:
    """Lower-case words of plain letters, single spaces around each."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_table())
    text = _SIGNED.sub(_letters_for, text)
    return f" {_SPACE.sub(' ', text).strip()} "


@dataclass
class Model:
    """Entries begin with a space; those that end with one match whole words only."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] | None = None  # bias, of the sum, of the sum per word

    def automaton(self):
        found = ahocorasick.Automaton()
        for term, w in self.weights.items():
            found.add_word(term, (w, len(term), False))
        for phrase in self.exceptions:
            found.add_word(fold(phrase), (0.0, len(fold(phrase)), True))
        if len(found):
            found.make_automaton()
        return found

    def features(self, text: str, automaton) -> tuple[float, float]:
        folded = fold(text)
        at: dict[int, float] = {}
        spared = []
        if len(automaton):
            for end, (w, n, exempt) in automaton.iter(folded):
                start = end - n + 1
                if exempt:
                    spared.append((start, end))
                elif w > at.get(start, 0.0):
                    at[start] = w
        total = sum(w for s, w in at.items() if not any(a <= s < b for a, b in spared))
        words = max(1, folded.count(" ") - 1)
        return min(total, 60.0), min(total / words, 1.0) * 10

    def score(self, total: float, dense: float) -> float:
        if self.curve is None:
            return 0.0
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * total + c * dense, -50, 50))))


def candidates(text: str) -> set[str]:
    """Whole words and their beginnings, as lexicon entries."""
    out = set()
    for w in set(fold(text).split()):
        if len(w) >= 3:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(SHORTEST, min(len(w), LONGEST) + 1))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, learn_from, rows: int) -> DataFrame:
    """``text, toxic`` of at most about ``rows`` labelled ids, chosen by hash; one row per id."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(learn_from(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = min(1.0, rows / max(1, n))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # bounded by ``rows``: two numbers each
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # an id that repeats gives one row, whatever the order of its rows
    return found.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("toxic").alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame, learn_from=lambda doc_id: F.lit(True),
          rows: int = SAMPLE_ROWS, size: int = LEXICON, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Fit lexicon and curve on the labelled rows that ``learn_from(doc_id)`` admits."""
    prepare(docs.sparkSession)
    sample = save(training_rows(docs, labels, learn_from, rows), "toxicity-sample")

    def count(batches):
        pos, neg = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                (pos if toxic else neg).update(candidates(text))
            if len(pos) + len(neg) > 400_000:
                yield counted(pos, neg)
                pos, neg = Counter(), Counter()
        yield counted(pos, neg)

    def counted(pos, neg):
        terms = list(pos.keys() | neg.keys())
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([pos[t] for t in terms], pa.int64()),
                                           pa.array([neg[t] for t in terms], pa.int64())], names=["term", "pos", "neg"])

    sides = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    model = Model(exceptions=exceptions)
    p, n = sides.get(1, 0), sides.get(0, 0)
    if not p or not n:
        return model
    weight = F.log((F.col("pos") + 0.5) / (p + 1.0)) - F.log((F.col("neg") + 0.5) / (n + 1.0))
    kept = (sample.mapInArrow(count, "term string, pos long, neg long").groupBy("term")
            .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            .filter(F.col("pos") >= SUPPORT).withColumn("weight", weight).filter(F.col("weight") >= LEAST_WEIGHT)
            .orderBy(F.desc(F.col("weight") * F.sqrt("pos")), "term").limit(size).collect())
    model.weights = {r["term"]: float(r["weight"]) for r in kept}
    features = sample.select("text", "toxic").mapInArrow(_features_of(model, "toxic"), "total double, dense double, toxic int")
    rows_ = np.array([tuple(r) for r in features.collect()], dtype=float)  # at most ``rows`` triples
    model.curve = logistic(rows_[:, :2], rows_[:, 2])
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> tuple[float, float, float]:
    """Weights of a ridge logistic regression, by Newton steps."""
    x1, w = np.c_[np.ones(len(x)), x], np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -50, 50)))
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + ridge * np.eye(3)
        step = np.linalg.solve(h, x1.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(w[2])


def _features_of(model: Model, *keep: str):
    def run(batches):
        automaton = model.automaton()
        for batch in batches:
            f = np.array([model.features(t or "", automaton) for t in batch.column("text").to_pylist()],
                         dtype=float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1]), *(batch.column(c) for c in keep)],
                                             names=["total", "dense", *keep])
    return run


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns of ``docs`` with ``toxic_score`` and ``toxic_predicted``; every whole text is scored."""
    prepare(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    inner = docs.select(F.struct(*keep).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([inner.schema["row"], T.StructField("toxic_score", T.DoubleType())])

    def run(batches):
        automaton = model.automaton()
        for batch in batches:
            got = [model.score(*model.features(t, automaton)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(got, pa.float64())], names=["row", "toxic_score"])

    scored = inner.mapInArrow(run, schema)
    return scored.select(F.col("row"), "toxic_score", (F.col("toxic_score") >= threshold).cast("int").alias("toxic_predicted"))


def held_out(doc_id) -> F.Column:
    """Rows kept from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def scored_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = learn(docs, labels, lambda doc_id: ~held_out(doc_id))
    return score(docs, model, ["doc_id"]).select(
        "row.doc_id", F.coalesce(held_out(F.col("row.doc_id")), F.lit(False)).alias("held_out"),
        F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))
