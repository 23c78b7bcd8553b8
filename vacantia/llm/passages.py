"""Suffix-array dedup: bytes covered by a long string that also starts anywhere else are removed.

1. The starts of every text fall into segments: runs of starts whose windows of ``width`` bytes have the same
   least hash over their grams (strings of a fixed shorter length). Equal windows have equal least
   hashes, so only segments with one key can share a window.
2. A count-min sketch of all keys tells which occur once; their segments are dropped unread. The others
   are saved with their bytes, and equal segments become one with a count.
3. The segments of a key meet in one task, many keys at a time, where ``suffix_groups`` builds the
   suffix order of their bytes and marks the starts of windows that occur again.
4. Marks go back to every segment's text by digest and are joined there into spans.

A key whose different segments hold more than ``most`` bytes is not given to one task: its segments go
through the same steps as texts, with longer grams and so smaller groups. With grams as long as the
window a key is a single window, so the last round cannot be crowded.

Texts are known by a digest, so equal texts and repeated rows share their marks; each still counts.
``docs`` is read three times and should be a table or a saved step.

Defined results: a null text is empty; a text shorter than ``width`` keeps all its bytes; null and repeated ids keep
their rows; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm import sketch
from vacantia.llm.common import parts, prepare, save
from vacantia.llm.suffix_groups import repeated_windows

WIDTH = 400
CHUNK = 1 << 17          # starts hashed at a time
BASE = 0x9E3779B97F4A7C15
BATCH = 1 << 20          # bytes of segments ordered at a time
MOST = 16 << 20          # bytes of different segments of one key in one task
SEGMENTS = "owner binary, at long, windows long, key long, digest binary, copies long, again boolean, body binary"
RUNS = "array<struct<a:long,b:long>>"


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random odd number for each byte, and the powers of the base and of its inverse."""
    values = np.random.default_rng(13).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    up, down = (np.full(n, b % (1 << 64), np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return values, np.multiply.accumulate(up), np.multiply.accumulate(down)


def least_hashes(data: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the least hash of its grams, and whether its first gram has it (and is that of the window's start)."""
    values, up, down = powers(CHUNK + WIDTH + 1)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * up[:n], out=sums[1:])
    g = (sums[gram:] - sums[:-gram]) * down[:n - gram + 1]
    g = (g ^ (g >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(29)
    w = width - gram + 1
    if w == 1:
        return g, np.ones(len(g), bool)
    # least of each stretch of w: the tail of one block and the head of the next
    blocks = np.full(-(-len(g) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:len(g)] = g
    blocks = blocks.reshape(-1, w)
    heads = np.minimum.accumulate(blocks, axis=1).ravel()
    tails = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(tails[:len(g) - w + 1], heads[w - 1:len(g)])
    return least, least == g[:len(least)]


def segments_of(text: bytes, width: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First starts, ends and keys of the segments of a text, and whether the key's gram occurs in it again; a chunk of starts at a time."""
    data, n = np.frombuffer(text, np.uint8), len(text) - width + 1
    for a in range(0, max(n, 0), CHUNK):
        least, leads = least_hashes(data[a:min(a + CHUNK, n) + width - 1], width, gram)
        goes_on = least[1:] == least[:-1]
        first = np.append(0, np.flatnonzero(~goes_on) + 1)
        # the key's gram has left the window and yet the key stays: there is another one
        again = np.logical_or.reduceat(np.append(leads[:-1] & goes_on, False), first)
        yield a + first, a + np.append(first[1:], len(least)), least[first], again


def may_repeat(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """The segments of ``texts(owner, copies, body)`` whose key is not proven to occur once."""
    spark = texts.sparkSession
    total = texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    cells = sketch.size_for(2 * total // (width - gram + 2))

    def keys(batches):
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for text, copies in zip(batch.column("body"), batch.column("copies").to_pylist(), strict=True):
                for _, _, key, again in segments_of(text.as_py(), width, gram):
                    found += [key, key if copies > 1 else key[again]]
            yield np.concatenate(found)

    touched = texts.select("body", "copies").mapInArrow(lambda batches: sketch.touch(keys(batches), cells), sketch.TOUCHED)
    bits = spark.sparkContext.broadcast(sketch.met_twice(touched, cells))

    def run(batches):
        for batch in batches:
            for owner, copies, text in zip(*(batch.column(c) for c in ("owner", "copies", "body")), strict=True):
                text = text.as_py()
                for first, end, key, again in segments_of(text, width, gram):
                    kept = np.flatnonzero(~sketch.surely_once(bits.value, key, cells))
                    if len(kept):
                        first, end = first[kept], end[kept]
                        bodies = [text[a:b + width - 1] for a, b in zip(first.tolist(), end.tolist(), strict=True)]
                        n = len(kept)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([owner.as_py()] * n, pa.binary()), pa.array(first), pa.array(end - first),
                             pa.array(key[kept].view(np.int64)), pa.array([hashlib.blake2b(b, digest_size=16).digest() for b in bodies], pa.binary()),
                             pa.array([copies.as_py()] * n, pa.int64()), pa.array(again[kept]), pa.array(bodies, pa.binary())],
                            names=["owner", "at", "windows", "key", "digest", "copies", "again", "body"])

    return texts.select("owner", "copies", "body").mapInArrow(run, SEGMENTS)


def runs_of(marks: np.ndarray) -> list[dict[str, int]]:
    """Ranges of starts that are marked."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8))).tolist()
    return [{"a": a, "b": b} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def marked(groups: DataFrame, width: int) -> DataFrame:
    """``digest, runs`` of the segments with a window that occurs again; ``groups`` holds all of a key."""
    def run(batches):
        digests, copies, bodies, held, last = [], [], [], 0, None

        def out():
            found = [(d, r) for d, m in zip(digests, repeated_windows(bodies, copies, width), strict=True) if (r := runs_of(m))]
            return pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in found], pa.binary()), pa.array([r for _, r in found], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))],
                names=["digest", "runs"])

        for batch in batches:
            for key, digest, n, body in zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "copies", "body")), strict=True):
                if held >= BATCH and key != last:
                    yield out()
                    digests, copies, bodies, held = [], [], [], 0
                digests.append(digest)
                copies.append(n)
                bodies.append(body)
                held, last = held + len(body), key
        if digests:
            yield out()

    dealt = groups.select("key", "digest", "copies", "body").repartition(parts(groups.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, f"digest binary, runs {RUNS}")


def repeated(texts: DataFrame, width: int = WIDTH, grams: tuple[int, ...] | None = None, most: int = MOST) -> DataFrame:
    """``owner, runs``: ranges of starts whose window occurs more than once; texts without one are left out."""
    gram, *longer = grams or (width // 2, width - width // 10, width)
    segments = save(may_repeat(texts, width, gram), "passages-segments")
    # equal segments are one, with a count; a key with one window in all is no repeat
    different = save(segments.groupBy("digest").agg(
        F.first("key").alias("key"), F.sum("copies").alias("copies"), F.max("again").alias("again"), F.first("body").alias("body")), "passages-different")
    sizes = different.groupBy("key").agg(F.sum(F.octet_length("body")).alias("bytes"), F.sum("copies").alias("n"), F.max("again").alias("again"))
    sizes = sizes.filter("n > 1 OR again")
    crowded = sizes.filter(F.col("bytes") > most) if longer else sizes.limit(0)
    usual = sizes.filter(F.col("bytes") <= most) if longer else sizes
    marks = marked(different.join(usual.select("key"), "key", "left_semi"), width)
    if longer and not crowded.isEmpty():
        again = different.join(crowded.select("key"), "key", "left_semi").select(F.col("digest").alias("owner"), "copies", "body")
        marks = marks.unionByName(repeated(again, width, tuple(longer), most).withColumnRenamed("owner", "digest"))
    marks = save(marks, "passages-marks")
    there = F.transform("runs", lambda r: F.struct((r["a"] + F.col("at")).alias("a"), (r["b"] + F.col("at")).alias("b")))
    # equal texts bring equal segments: each place of a text once
    places = segments.select("owner", "at", "digest").distinct()
    return places.join(marks, "digest").groupBy("owner").agg(F.flatten(F.collect_list(there)).alias("runs"))


def spans(runs: list[dict[str, int]] | None, width: int) -> list[tuple[int, int]]:
    """Byte spans that the windows of the runs cover, as few as possible, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["a"], r["b"] + width - 1) for r in runs or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, width: int = WIDTH, grams: tuple[int, ...] | None = None, most: int = MOST, keep_bytes: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` and, with ``keep_bytes``, the remaining bytes as ``kept``."""
    prepare(docs.sparkSession)
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    owner = F.unhex(F.substring(F.sha2(body, 256), 1, 32))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), owner.alias("owner"), body.alias("body"))
    long_enough = F.octet_length("body") >= width
    found = repeated(rows.filter(long_enough).select("owner", F.lit(1).cast("long").alias("copies"), "body"), width, grams, most)

    def cut(batches):
        for batch in batches:
            out = []
            for doc, text, runs in zip(*(batch.column(c) for c in ("doc_id", "body", "runs")), strict=True):
                text, gone, at, kept = text.as_py(), spans(runs.as_py(), width), 0, []
                for a, b in gone:
                    kept.append(text[at:a])
                    at = b
                left = b"".join([*kept, text[at:]])
                out.append((doc.as_py(), len(text), len(text) - len(left), len(gone), hashlib.sha256(left).hexdigest(),
                            [{"a": a, "b": b} for a, b in gone], left if keep_bytes else None))
            pair = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pair, pa.binary())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                                 names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return rows.join(found, "owner", "left").select("doc_id", "body", "runs").mapInArrow(
        cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {RUNS}, kept binary")


def passages_digest(docs: DataFrame) -> DataFrame:
    return without_repeats(docs, keep_bytes=False).drop("spans", "kept")
