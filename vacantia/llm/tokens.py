"""Token ids of whole texts with a public tokenizer, cached by space-delimited piece.

The byte-level pattern of the vocabulary starts a new word at every space that
follows a non-space or precedes one. So a text may be cut at its spaces and its
pieces encoded apart, unless a space stands between two white-space
characters (or between one and the end); such texts, and those that hold an added token, are encoded whole. Pieces
repeat far more than texts do: a batch is cut and its different pieces are found by Arrow, each worker encodes
a piece once, and Arrow lays out the ids of all texts by the pieces' numbers. A word and the
punctuation after it are words of their own, so they are encoded apart, too.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

INSIDE_SPACE = re.compile(r"\s (?=\s|\Z)")
CLOSED_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?)\"]+)")
CLOSING = frozenset('.,;:!?)"')
CACHED_BYTES = 130_000_000   # of pieces kept per worker and generation; only speed depends on it
LONG_PIECE = 200            # longer pieces are not kept


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def closed(piece: str) -> list[str]:
    """A piece, or its word and the punctuation after it; a leading space says that none stands before the piece."""
    first = piece[:1] == " "
    m = CLOSED_WORD.fullmatch(piece, first)
    return [" " * first + m[1], " " + m[2]] if m else [piece]


class Encoder:
    """Ids as little-endian bytes of ``dtype``: two bytes each if the vocabulary allows.

    Special tokens are never added. A text that holds the string of an added token gets its id there,
    unless ``special_as_text`` makes such strings ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.added = re.compile("|".join(added)) if added else None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids  # one id: a word of its own
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the generation before: pieces in use move on, others go
        self.held = 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in out]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without white space inside, in one call: a newline between two is a word of its own."""
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(pieces)], add_special_tokens=False)[0].ids, dtype=self.dtype)
        ends = np.flatnonzero(ids == self.newline[0]) if len(self.newline) == 1 else ()
        if len(ends) != len(pieces) - 1:  # the vocabulary has no such newline
            return self._whole(pieces)
        flat, width = ids.tobytes(), ids.itemsize
        cuts = (np.array([-1, *ends, len(ids)]) * width).tolist()
        return [flat[a + width:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of pieces that are not known, kept but for long ones; a key that begins with a space is a text's first piece."""
        known, older = self.known, self.older
        found: dict[str, bytes] = {}
        # words, their punctuation and lines are words of their own wherever they stand; None stands for a line break
        parts: dict[str, list[str | None]] = {}
        ask: list[str] = []
        for p in new:
            if older and (b := older.get(p)) is not None:
                found[p] = b
            elif p[-1:] in CLOSING and len(some := closed(p)) > 1:
                parts[p] = some
            elif "\n" in p and len(self.newline) == 1 and all(map(str.isprintable, lines := p.split("\n"))) and all(lines) and lines[0] != " ":
                parts[p] = [x for k, line in enumerate(lines) for x in ([None, *closed(" " + line)] if k else closed(line))]
            else:
                ask.append(p)
        inner = {x for some in parts.values() for x in some}.difference(ask, found, (None,))
        ask += [x for x in inner if x not in known]
        # printable: no white space inside but the mark of a first piece
        plain = [p for p in ask if p.isprintable() and 0 < len(p) <= LONG_PIECE and p != " "]
        if plain:
            found.update(zip(plain, self._pieces([" " + p if p[0] != " " else p[1:] for p in plain]), strict=True))
        if len(plain) < len(ask):
            other = list(set(ask).difference(plain))
            found.update(zip(other, self._whole([p[1:] if p[:1] == " " else " " + p for p in other]), strict=True))
        if parts:
            line = np.array(self.newline, self.dtype).tobytes()
            for p, some in parts.items():
                found[p] = b"".join([line if x is None else found.get(x) or known[x] for x in some])
        out = [found[p] for p in new]
        if max(map(len, found), default=0) > LONG_PIECE:
            found = {p: b for p, b in found.items() if len(p) <= LONG_PIECE}
        known.update(found)
        self.held += 2 * sum(map(len, found)) + sum(map(len, found.values())) + 200 * len(found)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.held > CACHED_BYTES:
            self.older, self.known, self.held = self.known, {}, 0
        if not texts:
            return []
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ends = cut.offsets.to_numpy()
        flat = cut.flatten().dictionary_encode()
        number = flat.indices.to_numpy(zero_copy_only=False)
        pieces = flat.dictionary.to_pylist()
        # the first piece of a text has no space before it and is numbered apart
        begins = ends[:-1]
        firsts, back = np.unique(number[begins], return_inverse=True)
        opening = [" " + pieces[k] for k in firsts.tolist()]
        number = number.astype(np.int32)
        number[begins] = len(pieces) + back
        pieces += opening
        ids = list(map(self.known.get, pieces))
        if new := [k for k, b in enumerate(ids) if b is None]:
            gc.disable()  # many new objects and no cycles: nothing to look for
            try:
                for k, b in zip(new, self._learn([pieces[k] for k in new]), strict=True):
                    ids[k] = b
            finally:
                gc.enable()
        laid = pa.array(ids, pa.large_binary()).take(pa.array(number))
        at = np.frombuffer(laid.buffers()[1], np.int64)[ends].tolist()
        data = laid.buffers()[2].to_pybytes() if laid.buffers()[2] is not None else b""
        out = [data[a:b] for a, b in zip(at, at[1:], strict=False)]
        # pieces that are empty or begin with white space: only texts with one need a closer look
        head = pc.utf8_slice_codeunits(flat.dictionary, 0, 1)
        spaced = pc.or_(pc.utf8_is_space(head), pc.equal(head, "")).to_numpy(zero_copy_only=False)
        look = np.logical_or.reduceat(np.append(spaced, spaced[firsts])[number], begins)
        for k, text in enumerate(texts):
            if look[k] and INSIDE_SPACE.search(text) or self.added and self.added.search(text):
                out[k] = self._whole([text])[0]
        return out


def gathered(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined to about ``size`` bytes of ``column``, in which pieces repeat more often."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column(column).nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from table.to_batches()


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The encoder of this worker process."""
    return Encoder(path, special_as_text)


def with_end(ids: bytes, dtype: np.dtype, end_id: int) -> bytes:
    return ids + np.array([end_id], dtype=dtype).tobytes()


def as_u32(ids: bytes, dtype: np.dtype) -> bytes:
    """The same ids as little-endian unsigned 32-bit integers."""
    return np.frombuffer(ids, dtype=dtype).astype("<u4").tobytes()
