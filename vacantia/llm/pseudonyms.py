"""Personal data: format-preserving Feistel pseudonyms.

Numbers and dates that validate (card and account check digits, address octets,
phone and security number ranges, calendar days), mail addresses and quoted secrets are
replaced by a keyed permutation of all values of the same format: separators, lengths,
country codes and check digits stay valid, and equal values get equal pseudonyms in
every document. A Feistel network permutes the index of a value among the values of its
format; it walks on while the result lies outside of the format.

A card or account may stand beside other short numbers or words: shorter runs of its groups
are tried, so a row of plain numbers that holds a valid card number is replaced as one.

Defined results: null and empty texts stay as they are; text outside of the matches
is untouched; rows come out one for one with every column of the input; the key is a
parameter, and the default serves tests only.
"""

from __future__ import annotations

import datetime
import math
import re
from bisect import bisect_left, insort
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.common import prepare

KEY = b"change this key"
ROUNDS = 8
KINDS = ("mail", "secret", "iban", "date", "address", "ssn", "card", "phone")


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """Keyed permutation of ``0..size-1``: alternating modular Feistel rounds with cycle walking."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for r in range(ROUNDS):
            if r % 2 == 0:
                left = (left + _round(key, tweak, r, right)) % a
            else:
                right = (right + _round(key, tweak, r, left)) % b
        value = left * b + right
        if value < size:
            return value


def _round(key: bytes, tweak: str, r: int, half: int) -> int:
    data = f"{tweak}|{r}|{half}".encode()
    return int.from_bytes(blake2b(data, key=key[:64], digest_size=64).digest(), "little")


# -- characters of one format -------------------------------------------------------------------

_SETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _set_of(c: str) -> str | None:
    return next((s for s in _SETS if c in s), None)


def permute_text(text: str, key: bytes, tweak: str, sets=_set_of) -> str:
    """Characters of the known sets permuted together; all others stay."""
    at = [(i, s) for i, c in enumerate(text) if (s := sets(c))]
    size = value = 1
    value = 0
    for i, s in at:
        value = value * len(s) + s.index(text[i])
        size *= len(s)
    shape = "".join("9aA"[_SETS.index(s)] if s in _SETS else "x" for _, s in at)
    value, out = permute(value, size, key, f"{tweak}|{shape}"), list(text)
    for i, s in reversed(at):
        value, k = divmod(value, len(s))
        out[i] = s[k]
    return "".join(out)


def luhn_digit(digits: str) -> str:
    total = sum(int(d) if i % 2 else (2 * int(d) - 9 * (d > "4")) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _refill(text: str, digits: str) -> str:
    """``digits`` in the places of the digits of ``text``."""
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in text)


def card(text: str, key: bytes) -> str | None:
    d = re.sub(r"[^0-9]", "", text)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = d[0] + permute_text(d[1:-1], key, f"card|{d[0]}")
    return _refill(text, body + luhn_digit(body))


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban(text: str, key: bytes) -> str | None:
    d = text.replace(" ", "")
    if not 15 <= len(d) <= 34 or _mod97(d[4:] + d[:4]) != 1:
        return None
    body = permute_text(d[4:], key, f"iban|{d[:2]}")
    out = iter(f"{d[:2]}{98 - _mod97(body + d[:2] + '00'):02d}{body}")
    return "".join(c if c == " " else next(out) for c in text)


def address(text: str, key: bytes) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if any(o > 255 for o in octets) or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    n = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "address")
    return ".".join(map(str, n.to_bytes(4, "big")))


def ssn(text: str, key: bytes) -> str | None:
    a, g, s = map(int, text.split("-"))
    if not 1 <= a <= 899 or a == 666 or not g or not s:
        return None
    n = permute(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, key, "ssn")
    n, s = divmod(n, 9999)
    a, g = divmod(n, 99)
    a += 1
    return f"{a + (a >= 666):03d}-{g + 1:02d}-{s + 1:04d}"


def phone(text: str, key: bytes) -> str | None:
    d = re.sub(r"[^0-9]", "", text)
    plus = text.lstrip("(").startswith("+")
    if plus:
        if not 8 <= len(d) <= 15 or d[0] == "0":
            return None
        code = 1 if d[0] in "17" else 2
    else:
        code = len(d) - 10
        if code not in (0, 1) or code and d[0] != "1" or d[code] in "01" or d[code + 3] in "01":
            return None
    national = d[code:]
    if d[:code] in ("1", "") and len(national) == 10 and national[0] > "1" and national[3] > "1":
        # exchange and area codes begin with 2 to 9
        n = int(national[0]) - 2
        n = (n * 100 + int(national[1:3])) * 8 + int(national[3]) - 2
        n = permute(n * 10**6 + int(national[4:]), 800 * 800 * 10**4, key, "phone|1")
        n, low = divmod(n, 10**6)
        n, exchange = divmod(n, 8)
        area, rest = divmod(n, 100)
        new = f"{area + 2}{rest:02d}{exchange + 2}{low:06d}"
    else:
        new = permute_text(national, key, f"phone|{d[:code]}")
    return _refill(text, d[:code] + new)


_FIRST, _DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


def date(text: str, key: bytes) -> str | None:
    """A calendar day of 1900 to 2099; one day has one pseudonym in every spelling."""
    sep = re.search(r"[-./]", text)[0]
    x, y, z = text.split(sep)
    year_first = len(x) == 4
    if year_first:
        order, (year, month, day) = "ymd", map(int, (x, y, z))
    elif sep != "/" or int(x) > 12:
        order, (day, month, year) = "dmy", map(int, (x, y, z))
    else:
        order, (month, day, year) = "mdy", map(int, (x, y, z))
    try:
        index = (datetime.date(year, month, day) - _FIRST).days
    except ValueError:
        return None
    if not 0 <= index < _DAYS:
        return None
    new = _FIRST + datetime.timedelta(permute(index, _DAYS, key, "date"))
    values = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return sep.join(values[c] for c in order)


def mail(text: str, key: bytes) -> str | None:
    """Local part and all domain labels but the last; case does not tell addresses apart."""
    local, _, domain = text.lower().rpartition("@")
    host, _, top = domain.rpartition(".")
    new = permute_text(f"{local}@{host}", key, "mail", lambda c: _set_of(c) or (_LETTERS if c.isalpha() and c in _LETTERS else None))
    return f"{new}.{top}"


_LETTERS = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿ"


def secret(text: str, key: bytes) -> str | None:
    """Hexadecimal tokens stay hexadecimal, others keep their classes of characters."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        digits = "0123456789abcdef" if text == text.lower() else "0123456789ABCDEF"
        return permute_text(text, key, "hex", lambda c: digits)
    return permute_text(text, key, "secret")


_CLEAR = r"(?<![\w.])"
PATTERNS = {
    "secret": re.compile(r"(?i:\b(?:token|secret|api[_-]?key|passw(?:or)?d|pwd|bearer)\b\W{1,5})(?P<value>[A-Za-z0-9_+/=-]{16,})"),
    "mail": re.compile(r"(?<![\w.+%-])(?P<value>[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})"),
    "iban": re.compile(r"\b(?P<value>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b"),
    "date": re.compile(_CLEAR + r"(?P<value>[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|"
                       r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?![\w/-])"),
    "address": re.compile(_CLEAR + r"(?P<value>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?!\w|\.[0-9])"),
    "ssn": re.compile(r"(?<![\w-])(?P<value>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])"),
    "card": re.compile(r"(?<![\w-])(?P<value>[0-9](?:[ -]?[0-9]){12,18})(?![\w-])"),
    "phone": re.compile(r"(?<![\w.-])(?P<value>\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}|"
                        r"(?:1[ .-])?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|(?:1[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\w-])"),
}
MAKE = {"mail": mail, "secret": secret, "iban": iban, "date": date, "address": address, "card": card, "ssn": ssn, "phone": phone}
_DIGIT = re.compile("[0-9]")
# the forms of a phone number whose length is fixed, so that a number beside them is none of theirs
_FIXED_PHONE = re.compile(r"(?<![\w.-])(?P<value>\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|"
                          r"(?:1[ .-])?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|(?:1[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\w-])")


class Spans:
    """Taken spans of a text, ordered and apart."""

    def __init__(self):
        self.all: list[tuple[int, int, str, str]] = []

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.all, (b,))
        return not k or self.all[k - 1][1] <= a

    def add(self, a: int, b: int, kind: str, new: str) -> None:
        insort(self.all, (a, b, kind, new))


def _shorter(kind: str, text: str, spans: Spans, make) -> None:
    """Values of a pattern of open length: where the longest match fails or is taken in part,
    those that end at an earlier group border, and then those that start later."""
    pattern, at = PATTERNS[kind], 0
    while m := pattern.search(text, at):
        a, b = m.span("value")
        ends = [b, *(e for e in range(b - 1, a, -1) if not text[e].isalnum() and text[e - 1] not in " .-(")]
        if kind == "iban":  # the registered length of the country before all others
            ends.sort(key=lambda e: e - a - text.count(" ", a, e) != IBAN_LENGTHS.get(text[a:a + 2]))
        at = a + 1
        for e in ends:
            if spans.free(a, e) and (e == b or pattern.fullmatch(text, a, e)) and (new := make(kind, text[a:e])):
                spans.add(a, e, kind, new)
                at = e
                break


def _cards(kind: str, text: str, spans: Spans, make) -> None:
    """Cards among neighbouring groups of digits: all runs of 13 to 19 digits between group borders are tried.

    Usual layouts come first, then longer runs. Another layout needs an issuer's prefix and length,
    unless it is all of the neighbouring groups."""
    for m in _GROUPS.finditer(text):
        if m.end() - m.start() < 13:
            continue
        groups = [g.span() for g in _DIGITS.finditer(text, *m.span())]
        good = []
        for i, (a, _) in enumerate(groups):
            n = 0
            for j in range(i, len(groups)):
                b = groups[j][1]
                n += b - groups[j][0]
                if n > 19:
                    break
                if n < 13 or not spans.free(a, b):
                    continue
                usual = _USUAL.fullmatch(text, a, b) is not None
                whole = j - i + 1 == len(groups)
                if (usual or whole or _ISSUED.fullmatch(re.sub("[ -]", "", text[a:b]))) and (new := make(kind, text[a:b])):
                    good.append((not usual, -n, a, b, new))
        for _, _, a, b, new in sorted(good):
            if spans.free(a, b):
                spans.add(a, b, kind, new)


_DIGITS = re.compile("[0-9]+")
_GROUPS = re.compile(r"(?<![\w-])[0-9]+(?:[ -][0-9]+)*(?![\w-])")
_USUAL = re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?|[0-9]{6}\1[0-9]{4,5})")
_ISSUED = re.compile(r"1[0-9]{14}|4[0-9]{12}|3[068][0-9]{12}|3[47][0-9]{13}|(?:5[06-9]|6[0-9])[0-9]{11,17}|(?:2[0-7]|[3-6][0-9])[0-9]{14,17}")
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 "
    "GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 "
    "MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VA22 VG24 XK20").split()}


def _plain(kind: str, text: str, spans: Spans, make, pattern: re.Pattern | None = None) -> None:
    for m in (pattern or PATTERNS[kind]).finditer(text):
        a, b = m.span("value")
        if spans.free(a, b) and (new := make(kind, m["value"])):
            spans.add(a, b, kind, new)


def found(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """``start, end, kind, pseudonym`` of every validated value; earlier kinds win overlaps.

    Phone numbers of fixed length go before cards, those of open length come last.
    """
    spans, make = Spans(), _maker(key)
    digit = _DIGIT.search(text)
    for kind in KINDS:
        if kind == "mail":
            if "@" not in text:
                continue
        elif kind != "secret" and not digit:  # all other patterns need one
            continue
        if kind == "card":
            _plain("phone", text, spans, make, _FIXED_PHONE)
            _cards(kind, text, spans, make)
        elif kind in ("iban", "phone"):
            _shorter(kind, text, spans, make)
        else:
            _plain(kind, text, spans, make)
    return spans.all


@lru_cache(maxsize=4)
def _maker(key: bytes):
    @lru_cache(maxsize=50_000)
    def make(kind: str, value: str) -> str | None:
        return MAKE[kind](value, key)
    return make


def pseudonymise(text: str | None, key: bytes = KEY) -> tuple[str | None, int]:
    if not text:
        return text, 0
    spans, out, at = found(text, key), [], 0
    for a, b, _, new in spans:
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], len(spans)


def protect(docs: DataFrame, key: bytes = KEY, count: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with pseudonyms in ``text``; ``count`` names a column for their number."""
    prepare(docs.sparkSession)
    keep = [c for c in docs.columns if c != "text"]
    inner = docs.select(F.struct(F.lit(0).alias("_"), *keep).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([inner.schema["row"], T.StructField("text", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches):
        for batch in batches:
            done = [pseudonymise(t, key) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([d[0] for d in done], pa.string()),
                                              pa.array([d[1] for d in done], pa.int64())], names=["row", "text", "n"])

    out = inner.mapInArrow(run, schema)
    columns = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return out.select(*columns, *([F.col("n").alias(count)] if count else []))
