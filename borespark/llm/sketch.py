"""Count-min sketch of 64-bit keys, built by partitions, merged by slices, and shared as bit planes of a bounded size.

Every task counts its keys into cells (two rows of cells, by two hashes) and sends the cells it touched as gaps, about a byte
each; slices of cells are summed where they meet. The driver only gets, for each cell, one bit: whether its count is two or more. A key
whose cells both have the bit may be repeated; a key that is repeated always has it. The planes take 2 * 2**bits / 8 bytes, bits <= 30.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow, mix64

SLICE = 18  # a slice has 2**SLICE cells
FLUSH = 2_000_000


def width_bits(keys: int) -> int:
    """Cells for so many keys: two to four for each, within the bound on what is shared."""
    return min(30, max(20, int(max(keys, 1) * 2 - 1).bit_length() + 1))


def as_gaps(at: np.ndarray) -> bytes:
    """Sorted distinct places as steps of 255 at most; a byte of 255 is a step on the way, any other ends at a place."""
    steps = np.diff(at, prepend=-1) - 1
    many = steps // 255
    out = np.full(len(at) + int(many.sum()), 255, np.uint8)
    out[np.arange(len(at)) + np.cumsum(many)] = steps % 255
    return out.tobytes()


def from_gaps(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8)
    ends = steps != 255
    return (np.cumsum(steps, dtype=np.int64) + np.cumsum(ends) - 1)[ends]


def cells(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    shift = np.uint64(64 - bits)
    return [(keys >> shift).astype(np.int64), (mix64(keys + np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)]


def repeated_planes(table: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> list[np.ndarray]:
    """For each row of cells its packed bits. keys_of gives the keys of a batch of table in portions."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            for row, at in enumerate(cells(keys, bits)):
                at, n = np.unique(at, return_counts=True)
                if len(at):
                    part = at >> SLICE
                    cut = np.flatnonzero(np.diff(part, prepend=-1))
                    ends = np.append(cut[1:], len(at))
                    low, twice = at & ((1 << SLICE) - 1), n > 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((part[cut] * 2 + row).astype(np.int64)), pa.array([as_gaps(low[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary()), pa.array([np.packbits(twice[a:b]).tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())],
                        ["slice", "at", "twice"],
                    )

        held, size = [], 0
        for batch in batches:
            for keys in keys_of(batch):
                held.append(keys)
                size += len(keys)
                if size >= FLUSH:
                    yield from emit(np.concatenate(held))
                    held, size = [], 0
        if held:
            yield from emit(np.concatenate(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for which, at, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = sums.setdefault(which, np.zeros(1 << SLICE, np.uint8))
                at = from_gaps(at)
                n = 1 + np.unpackbits(np.frombuffer(twice, np.uint8), count=len(at))
                total[at] = np.minimum(total[at] + n, 2)  # a task's cells are distinct
        for which, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([which], pa.int64()), pa.array([np.packbits(total >= 2).tobytes()], pa.binary())], ["slice", "plane"])

    sent = in_arrow(table, count, "slice long, at binary, twice binary")
    planes = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(2)]
    for r in in_arrow(sent.repartition("slice"), merge, "slice long, plane binary").toLocalIterator():
        part, row = divmod(r.slice, 2)
        planes[row][part << (SLICE - 3) : (part + 1) << (SLICE - 3)] = np.frombuffer(r.plane, np.uint8)
    return planes


def maybe_repeated(keys: np.ndarray, planes: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for plane, at in zip(planes, cells(keys, bits), strict=True):
        out &= (plane[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out
