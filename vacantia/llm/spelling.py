"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists.

The vocabulary is sorted twice, by the words and by the reversed words, and cut into
blocks of consecutive entries. Two words one edit apart agree in the first or in the
second half of the shorter one, so they share a prefix of that length in one of the two
lists, and a word visits only the blocks that can hold its half and whose own shared
prefix is not more than one edit away. Inside a block its banded
edit matrix has one row per code point of the entry; consecutive entries reuse the rows
of their common prefix, and once every cell of a row exceeds one edit all entries
with that prefix are skipped.

A pair whose first halves agree counts in the forward list, any other in the reversed one, so
no pair counts twice. Blocks are bounded, whatever prefix is frequent, and words
stream past them; a word with more entries in its range visits several blocks.

Defined results: null texts and texts without a run give no words; a null ``doc_id`` reads
as an empty string; repeated rows count again; an empty table gives no row;
other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import parts, prepare, save

RUN = "([A-Za-zÀ-ÿ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 512            # least entries of a block
MOST_BLOCKS = 1 << 16  # blocks of both lists together; larger vocabularies get larger blocks
BORDER = 48            # code points kept of a block's first and last entry
AFTER = "\U0010ffff"   # sorts after every continuation of a prefix
LISTS = "block long, reversed boolean, words array<string>, counts array<long>"
NEAR = "word string, n_near long, best struct<minus_n: long, form: string>"


def vocabulary(docs: DataFrame, every: int = 199, least: int = 5, letters: int = 6) -> DataFrame:
    """``word, n``: lower-cased letter runs, some of them with a letter lost, that are long and frequent enough.

    A run loses a code point where ``every`` divides the CRC-32 of ``<doc_id>:<run>``.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(1))).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    word = F.when(h % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).filter(F.char_length("word") >= letters)
            .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least))


def shared_length(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def least_shared(length: int, reverse: bool) -> int:
    """Code points that a word of this length shares with every near word its list has to find."""
    return length // 2 if reverse else (length - 1) // 2


def may_lead(shared: str, word: str) -> bool:
    """Whether a word that begins with ``shared`` can be one edit from ``word``."""
    c = shared_length(shared, word)
    rest = shared[c + 1:]
    return (c == len(shared) or word.startswith(rest, c + 1)   # another code point here
            or word.startswith(rest, c)                        # one more in the entry
            or word.startswith(shared[c:], c + 1))             # one more in the word


def adjacent_shared(entries: list[str]) -> list[int]:
    """Length of the prefix that each entry shares with the one before, and a closing zero."""
    return [0, *(shared_length(a, b) for a, b in zip(entries, entries[1:], strict=False)), 0]


def one_edit(word: str, entries: list[str], shared: list[int], known: int) -> Iterator[int]:
    """Positions in the sorted ``entries`` that are exactly one edit from ``word`` and share its first ``known`` code points.

    ``rows[d]`` holds the matrix cells of columns d-1, d and d+1 after d code points of an entry.
    """
    prefix = word[:known]
    i = bisect_left(entries, prefix)
    end = bisect_right(entries, prefix + AFTER, lo=i)
    length = len(word)
    text = word + "\0\0\0"
    rows = [(1, 0, 1)] * (known + 1)  # a shared prefix costs nothing on the diagonal
    d = known                         # rows up to ``d`` hold for the entry
    while i < end:
        entry = entries[i]
        left, mid, right = rows[d]
        del rows[d + 1:]
        size = min(len(entry), length + 1)
        while d < size:
            c = entry[d]
            left = min(mid + 1, left + (text[d - 1] != c)) if d else mid + 1
            mid = min(mid + (text[d] != c), right + 1, left + 1)
            right = min(right + (text[d + 1] != c), mid + 1)
            d += 1
            rows.append((left, mid, right))
            if left > 1 and mid > 1 and right > 1:
                break
        if d == len(entry) and -1 <= length - d <= 1 and (left, mid, right)[length - d + 1] == 1:
            yield i
        i += 1
        # every entry that begins with these points is too far, or too long
        if shared[i] >= d and (d > length or left > 1 and mid > 1 and right > 1):
            i = bisect_right(entries, entry[:d] + AFTER, lo=i, hi=end)
        # entries between share more with the last one, so this holds for a jump, too
        d = min(d, shared[i])


def sorted_blocks(vocab: DataFrame, block: int) -> DataFrame:
    """Both sorted lists, cut into rows of at most ``block`` consecutive entries."""
    both = (vocab.select(F.lit(False).alias("reversed"), F.col("word").alias("key"), "n")
            .unionByName(vocab.select(F.lit(True).alias("reversed"), F.reverse("word").alias("key"), "n")))

    def cut(batches):
        part, made, side, words, counts = TaskContext.get().partitionId() << 32, 0, None, [], []

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([part + made], pa.int64()), pa.array([side]), pa.array([words], pa.list_(pa.string())),
                 pa.array([counts], pa.list_(pa.int64()))], names=["block", "reversed", "words", "counts"])

        for batch in batches:
            for flag, key, n in zip(*(batch.column(c).to_pylist() for c in ("reversed", "key", "n")), strict=True):
                if words and (len(words) == block or flag != side):
                    yield row()
                    made, words, counts = made + 1, [], []
                side = flag
                words.append(key)
                counts.append(n)
        if words:
            yield row()

    spread = both.repartitionByRange(parts(vocab.sparkSession), "reversed", "key").sortWithinPartitions("reversed", "key")
    return spread.mapInArrow(cut, LISTS)


def near_words(vocab: DataFrame, block: int | None = None) -> DataFrame:
    """``word, n_near, best`` of every word with a near word; ``best`` is the near word of largest ``n``, ties to the smallest."""
    spark = prepare(vocab.sparkSession)
    block = block or max(BLOCK, -(-2 * vocab.count() // MOST_BLOCKS))
    lists = save(sorted_blocks(vocab, block), "spelling-lists")
    # at most MOST_BLOCKS rows (and one more per partition) of two short strings
    borders = sorted(tuple(r) for r in lists.select(
        "reversed", F.substring(F.element_at("words", 1), 1, BORDER), F.substring(F.element_at("words", -1), 1, BORDER), "block").collect())
    routes = {}
    for side in (False, True):
        firsts, lasts, ids = [list(c) for c in zip(*(b[1:] for b in borders if b[0] == side), strict=True)] or [[], [], []]
        routes[side] = firsts, lasts, ids, [a[:shared_length(a, b)] for a, b in zip(firsts, lasts, strict=True)]

    def route(batches):
        for batch in batches:
            blocks, sides, words = [], [], []
            for word in batch.column("word").to_pylist():
                for side in (False, True):
                    firsts, lasts, ids, shared = routes[side]
                    key = word[::-1] if side else word
                    prefix = key[:least_shared(len(word), side)][:BORDER]
                    a = bisect_left(lasts, prefix)
                    for b in range(a, max(a, bisect_right(firsts, prefix + AFTER))):
                        if may_lead(shared[b], key):
                            blocks.append(ids[b])
                            sides.append(side)
                            words.append(word)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(sides, pa.bool_()), pa.array(words, pa.string())],
                                             names=["block", "reversed", "word"])

    def scan(batches):
        entries = counts = shared = None
        for batch in batches:
            found, near, best = [], [], []
            for side, word, words, ns in zip(*(batch.column(c).to_pylist() for c in ("reversed", "word", "words", "counts")), strict=True):
                if words is not None:
                    entries, counts, shared = words, ns, adjacent_shared(words)
                    continue
                key = word[::-1] if side else word
                hits, top = 0, None
                for i in one_edit(key, entries, shared, least_shared(len(key), side)):
                    other = entries[i][::-1] if side else entries[i]
                    half = min(len(word), len(other)) // 2
                    if side and word[:half] == other[:half]:
                        continue  # the forward list has it
                    if not side and word[:half] != other[:half]:
                        continue
                    hits += 1
                    if top is None or (-counts[i], other) < top:
                        top = (-counts[i], other)
                if hits:
                    found.append(word)
                    near.append(hits)
                    best.append({"minus_n": top[0], "form": top[1]})
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.string()), pa.array(near, pa.int64()),
                 pa.array(best, pa.struct([("minus_n", pa.int64()), ("form", pa.string())]))], names=["word", "n_near", "best"])

    visits = vocab.select("word").mapInArrow(route, "block long, reversed boolean, word string")
    # a block's entries come right before the words that visit it
    dealt = (visits.selectExpr("block", "reversed", "word", "CAST(NULL AS array<string>) AS words", "CAST(NULL AS array<long>) AS counts")
             .unionByName(lists.selectExpr("block", "reversed", "CAST(NULL AS string) AS word", "words", "counts"))
             .repartition(parts(spark), "block").sortWithinPartitions("block", F.col("word").asc_nulls_first()))
    return dealt.mapInArrow(scan, NEAR).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(vocab: DataFrame, times: int = 5) -> DataFrame:
    """``word, n, n_near, form, form_n, root``: the form is the most frequent near word if it is ``times`` as frequent.

    Counts grow along forms by that factor, so chains are short; each round doubles the steps taken.
    """
    vocab = save(vocab, "spelling-vocabulary")
    near = near_words(vocab)
    good = F.col("best.minus_n") <= -times * F.col("n")
    words = save(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.form")).alias("form"),
        F.when(good, -F.col("best.minus_n")).alias("form_n")), "spelling-forms")
    now = save(words.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = save(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                          F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if now.filter("moved").isEmpty():
            break
        now = now.drop("moved")
    return words.join(now.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants_digest(docs: DataFrame) -> DataFrame:
    return variants(vocabulary(docs)).select("word", "form", "root", "n", "n_near", "form_n")
