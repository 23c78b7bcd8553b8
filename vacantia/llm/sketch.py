"""Count-min screening: which 64-bit keys surely occur once.

A cell of the sketch says "none, one, more", so it never counts too low: a key with a cell below two
occurs once. Tasks send the cells they met by slice, a group adds up one slice, and what
is kept is one bit per cell. The number of cells follows the number of keys up to a
fixed most; beyond it more keys pass the screen and results stay the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vacantia.llm.common import parts

ROWS = 2
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 27   # of one row: at most 16 MB as bits
SLICE = 1 << 16                              # cells merged by one group
FLUSH = 1 << 21                              # cells a task holds before it sends them
TOUCHED = "slice long, once binary, twice binary"
MIXERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def size_for(keys: int) -> int:
    cells = LEAST_CELLS
    while cells < min(4 * keys, MOST_CELLS):
        cells *= 2
    return cells


def cells_of(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each key in each row."""
    out = []
    for mixer in MIXERS:
        x = (keys ^ (keys >> np.uint64(31))) * mixer
        out.append((x ^ (x >> np.uint64(29))) * mixer >> np.uint64(24) & np.uint64(cells - 1))
    return out


def touch(keys: Iterable[np.ndarray], cells: int) -> Iterator[pa.RecordBatch]:
    """The cells that a task's keys meet, once or more than once, by slice."""
    held, n = [], 0

    def send():
        together = np.concatenate(held)
        for j, at in enumerate(cells_of(together, cells)):
            at, count = np.unique(at.astype(np.int64), return_counts=True)
            cut = np.searchsorted(at, np.arange(0, cells + SLICE, SLICE))
            slices = np.flatnonzero(np.diff(cut))
            low, twice = (at % SLICE).astype("<u2"), count > 1
            spans = [(slice(cut[s], cut[s + 1])) for s in slices]
            yield pa.RecordBatch.from_arrays(
                [pa.array(j * (cells // SLICE) + slices, pa.int64()),
                 pa.array([low[a][~twice[a]].tobytes() for a in spans], pa.binary()),
                 pa.array([low[a][twice[a]].tobytes() for a in spans], pa.binary())], names=["slice", "once", "twice"])

    for some in keys:
        if len(some):
            held.append(some)
            n += len(some)
        if n >= FLUSH:
            yield from send()
            held, n = [], 0
    if n:
        yield from send()


def met_twice(touched: DataFrame, cells: int) -> list[np.ndarray]:
    """For each row the packed bits of the cells met twice or more; at most ``ROWS * MOST_CELLS`` bits come to the driver."""
    def merge(batches):
        now, count = None, None

        def bits():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(count > 1).tobytes()], pa.binary())],
                                              names=["slice", "bits"])

        for batch in batches:
            for s, once, twice in zip(*(batch.column(c).to_pylist() for c in ("slice", "once", "twice")), strict=True):
                if s != now:
                    if now is not None:
                        yield bits()
                    now, count = s, np.zeros(SLICE, np.uint8)
                count[np.frombuffer(once, "<u2")] += 1
                count[np.frombuffer(twice, "<u2")] = 2
                np.minimum(count, 2, out=count)
        if now is not None:
            yield bits()

    merged = (touched.repartition(parts(touched.sparkSession), "slice").sortWithinPartitions("slice")
              .mapInArrow(merge, "slice long, bits binary"))
    found = {r["slice"]: bytes(r["bits"]) for r in merged.collect()}
    none, per_row = bytes(SLICE // 8), cells // SLICE
    return [np.frombuffer(b"".join(found.get(j * per_row + s, none) for s in range(per_row)), np.uint8) for j in range(ROWS)]


def surely_once(bits: list[np.ndarray], keys: np.ndarray, cells: int) -> np.ndarray:
    """Whether each key, one of those touched, is proven to occur once."""
    one = np.zeros(len(keys), bool)
    for row, at in zip(bits, cells_of(keys, cells), strict=True):
        one |= (row[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & np.uint8(1) == 0
    return one
