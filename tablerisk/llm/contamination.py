"""Benchmark decontamination by SimHash over windows as long as the items.

Every window of a document that is as long as an item and shares a shingle with it gets a 64-bit
SimHash. Fingerprints are looked up in a multi-index: they are cut into blocks, and each block is
stored under all keys within the share of the radius that the pigeonhole principle leaves to it,
so every item within the radius is found. Exact weighted-shingle similarity then decides. The radius
is a limit of its own: at similarity 0.8 about ten bits differ, and more than ``RADIUS`` rarely do.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tablerisk.llm.text import mix, shingles, slices, words

SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
BLOCKS, BLOCK_BITS = 4, 16
RADIUS = 19


def bits(value: np.ndarray) -> np.ndarray:
    """(n, 64) of -1 and 1 from 64-bit hashes."""
    raw = np.unpackbits(np.ascontiguousarray(value).view(np.uint8).reshape(-1, 8), axis=1)
    return raw.astype(np.int32) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """SimHash from summed signs, one row per window."""
    return np.packbits(sums > 0, axis=1).reshape(-1, 8).view(np.uint64).ravel()


def near_keys(radius: int) -> np.ndarray:
    """All block masks with at most ``radius`` bits set."""
    masks = [0]
    for k in range(1, radius + 1):
        masks += [sum(1 << b for b in c) for c in combinations(range(BLOCK_BITS), k)]
    return np.array(masks, np.uint16)


class Index:
    """Fingerprints, shingles and multi-index of a block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str | None], size: int, radius: int):
        found = words(pa.array(texts, pa.string()), lower=True, separators=SEPARATORS)
        value, owner = shingles(found.hashes(), found.first, size)
        count = np.bincount(owner, minlength=len(ids))
        self.items = np.flatnonzero(count)
        self.ids = [ids[i] for i in self.items]
        self.length = count[self.items]
        bound = np.concatenate(([0], np.cumsum(count)))
        self.shingles = [value[bound[i] : bound[i + 1]] for i in self.items]
        self.radius = radius
        self.prints = np.concatenate(
            [fingerprint(bits(s).sum(axis=0, keepdims=True)) for s in self.shingles] or [np.zeros(0, np.uint64)]
        )
        flat = np.concatenate(self.shingles or [np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(self.items)), self.length)
        order = np.argsort(flat, kind="stable")
        self.key, self.owner = flat[order], item[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.key >> np.uint64(44)] = True
        masks = near_keys(radius // BLOCKS)
        self.blocks = []
        for b in range(BLOCKS):
            keys = (self.block(self.prints, b)[:, None] ^ masks[None, :]).ravel()
            holder = np.repeat(np.arange(len(self.items), dtype=np.int32), len(masks))
            order = np.argsort(keys, kind="stable")
            self.blocks.append((keys[order], holder[order]))

    @staticmethod
    def block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.uint16)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs whose fingerprints differ in at most ``radius`` bits."""
        pairs = []
        for b, (keys, holder) in enumerate(self.blocks):
            probe = self.block(prints, b)
            lo, hi = np.searchsorted(keys, probe, "left"), np.searchsorted(keys, probe, "right")
            pairs.append(spread(lo, hi, holder, len(self.items)))
        pair = np.unique(np.concatenate(pairs))
        window, item = pair // len(self.items), pair % len(self.items)
        near = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
        return window[near], item[near]

    def hits(self, value: np.ndarray) -> np.ndarray:
        """Places whose shingle an item has."""
        at = np.flatnonzero(self.filter[value >> np.uint64(44)])
        return at[np.isin(value[at], self.key)]


def spread(lo: np.ndarray, hi: np.ndarray, holder: np.ndarray, n: int) -> np.ndarray:
    """place * n + holder for all holders in each place's range."""
    size = hi - lo
    place = np.repeat(np.arange(len(lo)), size)
    inside = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size)
    return place * n + holder[lo[place] + inside]


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two multisets of shingles."""
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(n[i], m[j]).sum())
    return shared / (len(a) + len(b) - shared)


def matches(index: Index, value: np.ndarray, threshold: float) -> dict[int, tuple[float, int, int]]:
    """item -> (best similarity, its window, windows matched) for one text's shingles."""
    places = index.hits(value)
    if not len(places):
        return {}
    out: dict[int, tuple[float, int, int]] = {}
    lo, hi = np.searchsorted(index.key, value[places], "left"), np.searchsorted(index.key, value[places], "right")
    pair = spread(lo, hi, index.owner, len(index.items))
    place, item = places[pair // len(index.items)], pair % len(index.items)
    for size in np.unique(index.length[item]):
        # Windows of this item size that hold a shared shingle, as one run of starts per cluster of hits.
        mark = np.zeros(len(value) + 1, np.int64)
        at = np.unique(place[index.length[item] == size])
        np.add.at(mark, np.maximum(at - size + 1, 0), 1)
        np.add.at(mark, at + 1, -1)
        size = min(int(size), len(value))
        starts = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
        starts = np.unique(np.minimum(starts, len(value) - size))
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1):
            for piece in np.array_split(run, len(run) // 4096 + 1):
                part = value[piece[0] : piece[-1] + size]
                sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits(part), axis=0, dtype=np.int32)))
                prints = fingerprint(sums[piece - piece[0] + size] - sums[piece - piece[0]])
                for w, i in zip(*index.within(prints)):
                    window = value[piece[w] : piece[w] + size]
                    similar = weighted_similarity(window, index.shingles[i])
                    if similar >= threshold:
                        best, where, n = out.get(int(i), (0.0, 0, 0))
                        better = similar > best
                        out[int(i)] = (similar if better else best, int(piece[w]) if better else where, n + 1)
    return out


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.8,
    size: int = 5,
    radius: int = RADIUS,
    items_at_once: int = 2_000,
) -> DataFrame:
    """(doc_id, item_id, similarity, window, n_windows): documents that hold a benchmark item.

    Words are runs of letters and digits in lower case, shingles are ``size`` words, shorter texts
    one shingle of all their words. Distinct items are handled in blocks of ``items_at_once`` by item_id and
    text, so a task's index has a fixed bound whatever the benchmark's size. Null or empty texts and items
    match nothing; rows that repeat a doc_id or an item_id give one row per document and item with the best
    of them, also those with a null id; items with equal texts all match; other columns are ignored. Empty
    tables give no rows.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    # Rows alike in both columns match alike, so (item_id, text) is a position that no two items share.
    items = items.where(F.col("text").isNotNull()).distinct()
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, similarity double, window long, n_windows long"
    found, after = None, None
    while block := (items if after is None else items.where(behind(after))).orderBy(
        F.asc_nulls_first("item_id"), "text"
    ).limit(items_at_once).collect():
        after = block[-1]
        part = source.mapInArrow(block_search(block, threshold, size, radius), schema)
        found = part if found is None else found.unionByName(part)
        if len(block) < items_at_once:
            break
    if found is None:
        return documents.sparkSession.createDataFrame([], schema)
    best = F.max_by(F.col("window"), F.struct("similarity", -F.col("window")))
    return found.groupBy("doc_id", "item_id").agg(
        F.max("similarity").alias("similarity"), best.alias("window"), F.max("n_windows").alias("n_windows")
    )


def behind(last: Row) -> Column:
    """Items after one in the order by item_id, nulls first, and text."""
    later = F.col("text") > F.lit(last["text"])
    if last["item_id"] is None:
        return F.col("item_id").isNotNull() | later
    return (F.col("item_id") > last["item_id"]) | ((F.col("item_id") == last["item_id"]) & later)


def block_search(block: list, threshold: float, size: int, radius: int):
    """A task function that searches documents for one block of items."""
    ids, texts = [r["item_id"] for r in block], [r["text"] for r in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(ids, texts, size, radius)
        for batch in batches:
            for part in slices(batch, "text"):
                text = words(part.column("text"), lower=True, separators=SEPARATORS)
                value, owner = shingles(text.hashes(), text.first, size)
                bound = np.searchsorted(owner, np.arange(len(part) + 1))
                docs = part.column("doc_id")
                rows = []
                for d in np.unique(owner[index.hits(value)]):
                    for i, (similar, where, n) in matches(index, value[bound[d] : bound[d + 1]], threshold).items():
                        rows.append((docs[int(d)].as_py(), index.ids[i], similar, where, n))
                columns = list(zip(*rows)) or [[]] * 5
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)],
                    ["doc_id", "item_id", "similarity", "window", "n_windows"],
                )

    return run
