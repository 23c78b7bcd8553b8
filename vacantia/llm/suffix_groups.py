"""Suffix order by grouping, without recursion or renaming, and repeated windows of texts found with it.

``suffix_order`` is the linear grouping construction. Suffixes start in groups by first symbol.
Groups are processed from the largest down: each suffix of a group finds the previous suffix that lies in
a smaller group (its previous-smaller pointer, found by following the pointers of larger groups),
and the suffixes pointed at leave their groups for new ones right behind them, those pointed at
more often further behind. In the end a group holds the suffixes of one Lyndon prefix.
Then the order is emitted from the smallest suffix up: the suffix before a placed one, and all that its
pointers lead to, take the next free places of their groups.

``repeated_windows`` applies it to a content-defined parse of texts: a phrase ends after every four
bytes whose hash says so, and begins with the four bytes that ended the one before, so no whole
phrase is a prefix of another and the order of parse suffixes is that of the texts.
Windows are sorted by the bytes up to the next phrase end and the place of the rest of the parse in the suffix
order; equal windows then stand side by side, and neighbours are compared byte by byte.
"""

from __future__ import annotations

import numpy as np

TRIGGER = 4        # bytes that decide on the end of a phrase
SHARE_BITS = 5     # one place of 32 ends a phrase


def suffix_order(symbols: np.ndarray) -> list[int]:
    """Start positions of all suffixes in ascending order; the last symbol must be the only smallest one."""
    n = len(symbols)
    place = np.argsort(symbols, kind="stable")
    first = np.searchsorted(symbols[place], symbols)  # the first place of each suffix's group names the group
    suffixes, group = place.tolist(), first.tolist()
    at = [0] * n                                      # where a suffix stands in ``suffixes``
    for p, i in enumerate(suffixes):
        at[i] = p
    size = np.bincount(first, minlength=n).tolist()
    previous = [-1] * n

    def leave(moved: list[int], old: int) -> None:
        """Move suffixes to the end of their group as a group of their own."""
        total = size[old]
        if len(moved) == total:
            return
        end = old + total
        for j in moved:
            end -= 1
            other, p = suffixes[end], at[j]
            suffixes[p], suffixes[end] = other, j
            at[other], at[j] = p, end
        for j in moved:
            group[j] = end
        size[old], size[end] = total - len(moved), len(moved)

    end = n
    while end > 0:
        start = group[suffixes[end - 1]]
        if end - start == 1:
            i = suffixes[start]
            j = i - 1
            while j >= 0 and group[j] > start:
                j = previous[j]
            previous[i] = j
            if j >= 0 and size[group[j]] > 1:
                leave([j], group[j])
        else:
            pointed: dict[int, int] = {}
            for i in sorted(suffixes[start:end]):
                j = i - 1
                while j >= 0 and group[j] > start:
                    j = previous[j]
                if j >= 0 and group[j] == start:
                    j = previous[j]
                previous[i] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            by_count: dict[int, dict[int, list[int]]] = {}
            for j, times in pointed.items():
                by_count.setdefault(times, {}).setdefault(group[j], []).append(j)
            for times in sorted(by_count, reverse=True):
                # groups may have been cut by a larger count; the suffixes left in them keep their name
                for old, moved in by_count[times].items():
                    leave(moved, old)
        end = start

    order, free, placed = [-1] * n, list(range(n)), [False] * n
    order[0], placed[n - 1] = n - 1, True
    for p in range(n):
        j = order[p] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = previous[j]
    return order


def phrase_ends(data: np.ndarray) -> np.ndarray:
    """Positions of last bytes of phrases, by the four bytes up to them."""
    if len(data) < TRIGGER:
        return np.zeros(0, np.int64)
    d = data.astype(np.uint32)
    four = d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24)
    mixed = (four ^ four >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    mixed = (mixed ^ mixed >> np.uint32(12)) * np.uint32(0x297A2D39)
    return np.flatnonzero(mixed >> np.uint32(32 - SHARE_BITS) == 0) + TRIGGER - 1


def repeated_windows(texts: list[bytes], copies: list[int], width: int) -> list[np.ndarray]:
    """For each text whether the window of ``width`` bytes at each start occurs more than once, ``copies`` counting each text."""
    starts = np.cumsum([0, *map(len, texts)])
    whole = b"".join(texts)
    data = np.frombuffer(whole, np.uint8)
    ends = phrase_ends(data)
    # an end must lie in one text with the four bytes that decide on it
    of = np.searchsorted(starts, ends, side="right") - 1
    good = ends - (TRIGGER - 1) >= starts[of]
    ends, of = ends[good], of[good]

    # parse: after each phrase end one phrase up to the next end, or to the end of the text
    last = np.append(of[1:] != of[:-1], True) if len(of) else np.zeros(0, bool)
    stop = np.where(last, starts[of + 1], np.append(ends[1:], 0) + 1)
    phrases = [whole[a:b] for a, b in zip((ends - (TRIGGER - 1)).tolist(), stop.tolist(), strict=True)]
    names = {p: k for k, p in enumerate(sorted(set(phrases)), 2)}
    # symbol 1 ends the phrases of a text, 0 ends all
    place = np.arange(len(ends)) + np.cumsum(np.append(0, last[:-1])) if len(ends) else np.zeros(0, np.int64)
    symbols = np.ones(len(ends) + int(last.sum()) + 1, np.int64)
    symbols[-1] = 0
    symbols[place.astype(np.int64)] = [names[p] for p in phrases]
    rank = np.empty(len(symbols), np.int64)
    rank[suffix_order(symbols)] = np.arange(len(symbols))

    counts = np.maximum(np.diff(starts) - width + 1, 0)
    first = np.cumsum(np.append(0, counts))
    text_of = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(first[-1]) - first[text_of] + starts[text_of]
    # bytes up to the next phrase end whose deciding bytes lie in the window
    k = np.searchsorted(ends, at + TRIGGER - 1)
    inside = (k < len(ends)) & (np.append(ends, 0)[np.minimum(k, len(ends))] < at + width)
    until = np.where(inside, np.append(ends, 0)[np.minimum(k, len(ends))] + 1, at + width)
    heads: dict[bytes, int] = {}
    name = heads.setdefault
    head = np.fromiter((name(whole[a:b], len(heads)) for a, b in zip(at.tolist(), until.tolist(), strict=True)), np.int64, len(at))
    rest = np.where(inside, rank[place[np.minimum(k, max(len(ends) - 1, 0))].astype(np.int64)], 0) if len(ends) else np.zeros(len(at), np.int64)
    order = np.lexsort((rest, head))
    head, sorted_at = head[order], at[order]
    pairs = np.flatnonzero(head[1:] == head[:-1])
    same = np.zeros(max(len(order) - 1, 0), bool)
    same[pairs] = [whole[a:a + width] == whole[b:b + width] for a, b in zip(sorted_at[pairs].tolist(), sorted_at[pairs + 1].tolist(), strict=True)]
    kind = np.cumsum(np.append(0, ~same)) if len(order) else np.zeros(0, np.int64)
    often = np.bincount(kind, np.asarray(copies, np.float64)[text_of[order]]) > 1 if len(order) else np.zeros(0, bool)
    repeated = np.zeros(len(at), bool)
    repeated[order] = often[kind] if len(order) else False
    return [repeated[a:b] for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)]
