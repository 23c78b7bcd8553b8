"""String similarity: token-sort ratio, trigram overlap and exact join keys.

The token-sort ratio of two strings is ``200 * LCS / (len a + len b)`` over
their tokens sorted and joined by a blank. All bounds below are lossless and
use integers only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType


def sorted_tokens(text: Column) -> Column:
    """Tokens split on whitespace, sorted, joined by one blank."""
    tokens = F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")
    return F.array_join(F.array_sort(tokens), " ")


def trigrams(text: Column) -> Column:
    """Set of word trigrams; each word is padded by two blanks and one blank."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    grams = F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w) + 1),
        lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_counts(a: Column, b: Column) -> tuple[Column, Column]:
    """Sizes of the intersection and the union of two trigram sets."""
    common = F.size(F.array_intersect(a, b))
    return common, F.size(a) + F.size(b) - common


@pandas_udf(IntegerType())
def _lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence, one machine word per string."""
    def one(x, y):
        if x is None or y is None:
            return None
        at: dict[str, int] = {}
        for i, ch in enumerate(x):
            at[ch] = at.get(ch, 0) | (1 << i)
        full = (1 << len(x)) - 1
        row = full
        for ch in y:
            hit = row & at.get(ch, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(x) - row.bit_count()
    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="Int32")


# Non-deterministic only for the optimizer: a filter on the result must not
# make Spark evaluate the function a second time.
lcs_length = _lcs_length.asNondeterministic()


def length_ok(a: Column, b: Column, percent: int) -> Column:
    """The shorter string is long enough for the ratio to be reachable."""
    la, lb = F.length(a), F.length(b)
    return F.least(la, lb) * 200 >= (la + lb) * percent


def max_indels(a: Column, b: Column, percent: int) -> Column:
    """Most insertions and deletions a pair at the ratio may need."""
    return F.call_function("div", (F.length(a) + F.length(b)) * (100 - percent), F.lit(100)).cast("int")


def letter_parity(text: Column) -> Column:
    """64 bits: which characters, by code, occur an odd number of times.

    An insertion or deletion flips one bit, so two strings differ in no more bits than their indel distance.
    """
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("bigint"),
                       lambda bits, c: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(c) % 64)))


def parity_ok(a_bits: Column, b_bits: Column, a_length: Column, b_length: Column, percent: int) -> Column:
    """Lossless test on ``letter_parity`` and lengths, far cheaper than an edit distance.

    The indel distance is odd where the lengths add up to an odd number, so its bound may be one less.
    """
    total = a_length + b_length
    most = F.call_function("div", total * (100 - percent), F.lit(100))
    return F.bit_count(a_bits.bitwiseXOR(b_bits)) <= most - (most + total) % 2


def may_match(a: Column, b: Column, percent: int) -> Column:
    """Lossless JVM-side prefilter: edit distance never exceeds indel distance."""
    return length_ok(a, b, percent) & (_edit_distance(a, b, percent) >= 0)


def _edit_distance(a: Column, b: Column, percent: int) -> Column:
    # The bound differs per pair, which only the SQL form of the function takes.
    return F.call_function("levenshtein", a, b, max_indels(a, b, percent))


def ratio_reached(a: Column, b: Column, percent: int) -> Column:
    """Exact test of ``token_sort_ratio >= percent`` on token-sorted strings.

    An edit path of length d over a length gap g has at most d - g
    substitutions, so the indel distance is at most 2d - g. Pairs within that
    bound are accepted in the JVM; only the rest go to the Python workers, the
    others reach them as NULL.
    """
    edits = _edit_distance(a, b, percent)
    gap = F.abs(F.length(a) - F.length(b))
    sure = edits * 2 - gap <= max_indels(a, b, percent)
    lcs = lcs_length(F.when(~sure, a), F.when(~sure, b))
    exact = lcs * 200 >= (F.length(a) + F.length(b)) * percent
    return F.coalesce(exact, sure)


# --- partition-based join keys -------------------------------------------------
#
# Pigeonhole over segments (the Pass-Join scheme for edit-distance joins): a
# string of length L is cut into k(L) even segments, one more than the most
# indels any partner may need. Some segment i survives untouched with exactly i
# indels to its left, so a partner has to carry it at an offset o with |o| <= i,
# o = i mod 2, and |gap - o| <= D - i. Both key sets are plain arrays to explode
# and join on equality.


_EMPTY = "struct(0 AS len, 0 AS seg, '' AS part)"  # an empty string only meets another


def _layout(lengths: str, p: int) -> str:
    """Cut of each partner length: ``(len, segs)`` to ``(len, wide, cut)``.

    Segments before ``cut`` have ``wide`` characters, the others one more.
    """
    segments = f"int((l + l * {200 - p} div {p}) * {100 - p} div 100) + 1"
    return (f"transform(transform({lengths}, l -> struct(l AS len, {segments} AS segs)), c -> "
            "struct(c.len AS len, c.segs AS segs, int(c.len div c.segs) AS wide, "
            "c.segs - c.len % c.segs AS cut))")


_START = "i * c.wide + greatest(0, i - c.cut)"
_WIDTH = "c.wide + int(i >= c.cut)"


def segment_keys(column: str, percent: int) -> Column:
    """Keys of the indexed side: ``(len, seg, part)`` for every segment."""
    own = _layout(f"array(length({column}))", percent)
    return F.expr(f"""
        CASE WHEN length({column}) = 0 THEN array({_EMPTY})
        WHEN length({column}) > 0 THEN flatten(transform({own}, c ->
            transform(sequence(0, c.segs - 1), i ->
                struct(c.len AS len, i AS seg,
                       substring({column}, {_START} + 1, {_WIDTH}) AS part)))) END""")


def probe_keys(column: str, percent: int, not_longer: bool = False) -> Column:
    """Keys of the probing side, for every partner length the ratio allows.

    ``not_longer`` limits partners to the own length, for self joins where
    each pair has to be met from its longer string only.
    """
    n = f"length({column})"
    shortest = f"int(ceil({n} * {percent} / {200 - percent}.0))"
    longest = n if not_longer else f"int({n} * {200 - percent} div {percent})"
    lengths = _layout(f"sequence({shortest}, {longest})", percent)
    most = f"int(({n} + c.len) * {100 - percent} div 100)"
    # Offsets: |o| <= i and |gap - o| <= most - i, in steps of two from -i or -i + 1.
    low = f"greatest(-i, {n} - c.len - ({most} - i))"
    low = f"({low} + abs(({low} - i) % 2))"
    high = f"least(i, {n} - c.len + ({most} - i))"
    return F.expr(f"""
        CASE WHEN {n} = 0 THEN array({_EMPTY})
        WHEN {n} > 0 THEN array_distinct(flatten(transform({lengths}, c ->
            flatten(transform(sequence(0, {most}), i -> transform(
                filter(CASE WHEN {low} <= {high} THEN sequence({low}, {high}, 2) ELSE array() END,
                       o -> {_START} + o >= 0 AND {_START} + o + {_WIDTH} <= {n}),
                o -> struct(c.len AS len, i AS seg,
                            substring({column}, {_START} + o + 1, {_WIDTH}) AS part))))))) END""")
