"""Plain reference results for the contracts, over rows held in memory."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    words = WORD.findall((text or "").translate(A_Z))
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def union_find(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard(docs, size, percent):
    """``{doc_id: (n_shingles, component)}`` of ``(doc_id, text)`` rows with unique ids."""
    sets = {i: shingle_set(t, size) for i, t in docs}
    holders = defaultdict(list)
    pairs = []
    for i in sorted(sets):
        both = defaultdict(int)
        for s in sets[i]:
            for j in holders[s]:
                both[j] += 1
            holders[s].append(i)
        pairs += [(i, j) for j, n in both.items() if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n)]
    comp = union_find(sets, pairs)
    return {i: (len(sets[i]), comp[i]) for i in sets}


def usable(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def cosine(rows, threshold):
    """``{vec_id: (links, component)}`` of ``(vec_id, vector, label)`` rows with unique ids."""
    good = [r for r in rows if usable(r[1]) and r[2] is not None]
    pairs = []
    by = defaultdict(list)
    for r in good:
        by[r[2], len(r[1])].append(r)
    for group in by.values():
        x = np.array([r[1] for r in group], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        pairs += [(group[a][0], group[b][0]) for a, b in zip(i, j, strict=True)]
    ids = [r[0] for r in rows]
    comp, n = union_find(ids, pairs), dict.fromkeys(ids, 0)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], comp[i]) for i in ids}


def nearest(rows, every, k):
    good = [r for r in rows if usable(r[1])]
    ids = np.array([r[0] for r in good])
    x = np.array([r[1] for r in good], float)
    out = []
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        order = np.lexsort((ids, d))[:min(k, len(ids) - 1)]
        out += [(int(ids[i]), r + 1, int(ids[o]), float(d[o])) for r, o in enumerate(order)]
    return out


def warc(pages):
    """``{page_id: (bytes, digest, type, refers_to)}``"""
    body = {i: (h or "").encode() for i, h in pages}
    last = {}
    for i, b in body.items():
        last[b] = max(last.get(b, i), i)
    return {i: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                "response" if last[b] == i else "revisit", None if last[b] == i else last[b]) for i, b in body.items()}


def encoded(docs):
    """``{doc_id: ids}`` with the end id, by the tokenizer itself."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in docs}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
