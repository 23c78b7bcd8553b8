"""Text expressions: company names, title flags, keys, alert texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia import fixed_values as fv


def non_empty(c: Column) -> Column:
    """NULL for an empty string, the value otherwise."""
    return F.nullif(c, F.lit(""))


def first_non_empty(*cols: Column) -> Column:
    """The first value that is neither NULL nor empty."""
    return F.coalesce(*[non_empty(c) for c in cols])


def normalize_company(name: Column) -> Column:
    """Identity key of a company: lower case, no punctuation, no legal suffix."""
    suffix = r"(?U)\b(" + "|".join(fv.CORPORATE_SUFFIXES) + r")\b"
    n = F.regexp_replace(F.trim(F.lower(name)), fv.COMPANY_PUNCTUATION, "")
    n = F.regexp_replace(n, suffix, "")
    return F.trim(F.regexp_replace(n, r"(?U)\s+", " "))


def is_new_grad(title: Column, description: Column) -> Column:
    """A seniority word in the title vetoes; else title or description may qualify.

    The description counts with its leading characters only, which is the
    classifier's rule and not a shortcut.
    """
    senior = "(?iuU)" + fv.SENIOR
    signal = "(?iuUd)" + fv.NEW_GRAD
    lead = F.substring(F.coalesce(description, F.lit("")), 1, fv.DESCRIPTION_WINDOW)
    return ~title.rlike(senior) & (title.rlike(signal) | lead.rlike(signal))


def location_key(location: Column) -> Column:
    """Equality key for locations: NULL equals NULL and nothing else.

    Values carry a prefix so that the key is never NULL and can be hashed.
    """
    folded = F.lower(F.regexp_replace(location, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(F.concat(F.lit("="), folded), F.lit(""))


def same_location(a: Column, b: Column) -> Column:
    return location_key(a) == location_key(b)


def badge(status: Column) -> Column:
    pairs = [F.lit(x) for pair in fv.BADGES.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[status], F.lit(fv.DEFAULT_BADGE))


def alert_text(status: Column, company: Column, title: Column, location: Column,
               url: Column) -> Column:
    place = F.coalesce(non_empty(location), F.lit(fv.NO_LOCATION))
    return F.concat(badge(status), F.lit(" **"), company, F.lit("** — "), title,
                    F.lit(" ("), place, F.lit(")\n"), url)


def duplicate_note(kept_id: Column, source: Column) -> Column:
    return F.concat(F.lit("duplicate of "), kept_id.cast("string"), F.lit(" via "), source)


def section_text(sections: Column) -> Column:
    """One text from a map of titled sections, in document order."""
    full = F.filter(F.map_entries(sections), lambda e: non_empty(e["value"]["text"]).isNotNull())
    parts = F.transform(full, lambda e: F.concat(
        F.coalesce(F.concat(non_empty(e["value"]["title"]), F.lit("\n")), F.lit("")),
        e["value"]["text"]))
    return F.coalesce(F.array_join(parts, "\n\n"), F.lit(""))


def shard_of(token: Column, shards: int) -> Column:
    """Stable shard number of a board token."""
    return F.crc32(F.lower(token).cast("binary")) % F.lit(shards)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
