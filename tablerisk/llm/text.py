"""Vectorised word, hash and window helpers used inside tasks.

Every helper works on one slice of an Arrow batch at a time, so a task holds a few
megabytes of text however large its partition is. Hashes are 64-bit and depend on
nothing but the bytes, so retries and other machines compute the same values.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
HASH_BYTES = 64 << 10
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash base, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 4096), BASE, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    """View unsigned hashes as the 64-bit integers Spark knows."""
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about ``limit`` bytes; a longer text stands alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < len(lengths):
        before = run[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(run, before + limit, "right")))
        yield batch.slice(start, end - start)
        start = end
    give_back()


def give_back() -> None:
    """Return what a worker has freed to its machine, which the JVM and other workers need too."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the n+1 offsets of the texts; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


@dataclass
class Words:
    """Words of consecutive texts: byte range, owning text, and per text the first word's index."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    offsets: np.ndarray
    values: np.ndarray  # of each byte in a hash; 0 for separators

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word."""
        out = np.zeros(len(self.start), np.uint64)
        first = 0
        while first < len(out):  # blocks small enough for a processor's cache
            last = max(first + 1, int(np.searchsorted(self.end, self.start[first] + HASH_BYTES, "right")))
            start, length = self.start[first:last], self.end[first:last] - self.start[first:last]
            bytes_ = self.raw[start[0] : self.end[last - 1]]
            start = start - start[0]
            offset = np.arange(len(bytes_)) - np.repeat(start, np.diff(start, append=len(bytes_)))
            value = self.values[bytes_] * powers(int(offset.max()) + 1)[offset]
            sums = np.add.reduceat(value, start)
            out[first:last] = mix(sums + length.astype(np.uint64) * BASE)
            first = last
        return out


def words(column: pa.Array, lower: bool = False, separators: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are not separators; words never cross texts."""
    raw, offsets = text_bytes(column)
    if lower:
        raw = mapped(raw, LOWER)
    inside = mapped(raw, ~separators)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(raw, start, end, doc, first, offsets, np.where(separators, np.uint64(0), BYTE_VALUES))


def mapped(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table[raw]`` for a table of 256 single bytes."""
    return np.frombuffer(raw.tobytes().translate(table.tobytes()), table.dtype)


def windows(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word index of every run of ``size`` words of one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = hashes[:n].copy()
    for k in range(1, size):
        value = mix(value * BASE + hashes[k : n + k])
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return value[at], at


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every run of ``size`` words; a shorter text is one run of all its words."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    value, at = windows(hashes, doc, size)
    owner = doc[at]
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        own = np.array([short_hash(hashes[first[d] : first[d + 1]]) for d in short], np.uint64)
        value, owner = np.concatenate((value, own)), np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return value, owner


def short_hash(run: np.ndarray) -> np.uint64:
    """Hash of a whole short text, never equal to a full run's hash by construction of its seed."""
    value = np.array([len(run) + 1], np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for h in run:
        value = mix(value * BASE + h)
    return value[0]
