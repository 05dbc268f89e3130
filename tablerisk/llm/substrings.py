"""Exact substring deduplication with sorted suffixes.

Two equal windows of ``length`` bytes agree in every byte, so they also agree in where their smallest
``GRAM``-byte run lies. That run is the windows' anchor. Suffixes are therefore taken at anchors only, about two
in ``length - GRAM`` bytes, and each anchor stands for the windows it is smallest in (its strip).

1. Spark counts anchors by their run. What occurs once can be in no repeated window.
2. Strips whose run occurs with one context only are whole repeats and need no comparison.
3. The other strips are range-partitioned, by Spark's sampled splitters, on the leading bytes of their
   suffix. A bucket sorts the suffixes after and the reversed ones before the anchors by multikey
   quicksort and takes the common lengths of neighbours; windows are equal where both sides are long enough.
   The range key is the whole run that equal windows share, so no group of equal windows
   lies across a boundary between buckets.
4. A run with very many contexts is not sorted in one bucket: its windows are counted one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerisk.llm.hashindex import HashIndex, write_index
from tablerisk.llm.spans import INVERSE
from tablerisk.llm.store import growing, new_folder, stored
from tablerisk.llm.text import BASE, BYTE_VALUES, mix, powers, signed, slices, text_bytes

GRAM = 72
PIECE = 2 << 20
ALONE, MIXED, CROWDED = 1, 2, 3
PLACE = np.uint64((1 << 22) - 1)
_inverse = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        grown = np.full(max(n, 4096), INVERSE, np.uint64)
        grown[0] = 1
        _inverse = np.multiply.accumulate(grown)
    return _inverse[:n]


class Hasher:
    """Hashes of any byte range of a piece of text, from one running sum."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[raw] * powers(len(raw)))))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * inverse_powers(len(self.sums))[start]
        return mix(value + (end - start).astype(np.uint64) * BASE)

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        value = (self.sums[size:] - self.sums[:-size]) * inverse_powers(len(self.sums))[:n]
        return mix(value + np.uint64(size * int(BASE) % 2**64))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values, from running minima of blocks of that width."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Anchors:
    """Anchors of one piece: text, first window, number of windows, place, and hashes of run and strip."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int):
        self.raw, empty = raw, np.zeros(0, np.int64)
        self.text = self.first = self.count = self.place = empty
        self.run = self.strip = np.zeros(0, np.uint64)
        if len(raw) < length:
            return
        self.hasher = Hasher(raw)
        grams = self.hasher.grams(GRAM)
        least = sliding_least((grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1)
        owner = np.repeat(np.arange(len(ends)), ends - starts)
        at = np.flatnonzero(np.arange(len(least)) + length <= ends[owner[: len(least)]])
        if not len(at):
            return
        place = (least[at] & PLACE).astype(np.int64)
        new = np.concatenate(([True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)))
        head = np.flatnonzero(new)
        self.first, self.place = at[head], place[head]
        self.count = np.diff(np.append(head, len(at)))
        self.text = owner[self.first]
        self.run = grams[self.place]
        self.strip = self.hasher.of(self.first, self.first + self.count - 1 + length)


def pieces(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, text starts, text ends, offset in text): whole texts, or overlapping parts of a longer one."""
    raw, offsets = text_bytes(column)
    if len(raw) <= 2 * PIECE:
        yield raw, offsets[:-1], offsets[1:], np.zeros(len(column), np.int64)
        return
    for d in range(len(column)):
        for a in range(offsets[d], offsets[d + 1], PIECE):
            part = raw[a : min(a + PIECE + length - 1, offsets[d + 1])]
            starts, ends = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
            ends[d:] = len(part)
            starts[d + 1 :] = len(part)
            yield part, starts, ends, np.full(len(column), a - offsets[d])


def repeated_runs(docs: DataFrame, length: int, crowd: int) -> DataFrame:
    """(run, kind) of runs that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                for raw, starts, ends, _ in pieces(part.column("text"), length):
                    found = Anchors(raw, ends, starts, length)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(found.run)), pa.array(signed(found.strip))], ["run", "strip"]
                    )

    rows = docs.select("text").mapInArrow(run, "run long, strip long")
    summed = rows.groupBy("run").agg(
        F.count("*").alias("n"), F.min("strip").alias("low"), F.max("strip").alias("high")
    )
    kind = F.when(F.col("low") == F.col("high"), ALONE).when(F.col("n") > crowd, CROWDED).otherwise(MIXED)
    return summed.where("n > 1").select("run", kind.cast("byte").alias("kind"))


def write_runs(runs: DataFrame, shards: int, folder: str) -> None:
    """Sorted runs and their kinds, for tasks to map into memory."""

    def entries(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        key = pdf["run"].to_numpy().view(np.uint64)
        order = np.argsort(key)
        return key[order], pdf["kind"].to_numpy()[order]

    top = F.shiftrightunsigned("run", 32)
    placed = runs.withColumn("shard", F.shiftrightunsigned(top * F.lit(shards).cast("long"), 32).cast("int"))
    write_index(placed, entries, shards, folder)


FOUND = "kind byte, key long, first long, count int, left int, run long, strip long, bytes binary, ranges binary"


def strips(docs: DataFrame, length: int, shards: int, folder: str) -> DataFrame:
    """What each text has of repeated runs: whole ranges of windows (kind 1), strips to compare (kind 2),
    single windows of crowded runs (kind 3). A batch sends the bytes of a strip once."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    types = [pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = HashIndex(folder, shards)
        for batch in batches:
            sent: set[tuple[int, int]] = set()
            for part in slices(batch, "text", PIECE):
                keys = part.column("key").to_numpy()
                for raw, starts, ends, ahead in pieces(part.column("text"), length):
                    found = Anchors(raw, ends, starts, length)
                    rows = list(rows_of(found, runs.numbers(found.run), keys, ahead - starts, length, sent))
                    columns = list(zip(*rows)) or [[]] * len(types)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select("key", "text").mapInArrow(run, FOUND)


def rows_of(found: Anchors, kind: np.ndarray, keys: np.ndarray, shift: np.ndarray, length: int, sent: set) -> Iterator:
    first = found.first + shift[found.text]
    key = keys[found.text]
    alone = np.flatnonzero(kind == ALONE)
    if len(alone):
        # Adjacent strips of one text join to one range of windows.
        begin, end, own = first[alone], first[alone] + found.count[alone], found.text[alone]
        head = np.flatnonzero(np.concatenate(([True], (begin[1:] != end[:-1]) | (own[1:] != own[:-1]))))
        stop = np.append(head[1:], len(alone)) - 1
        ranges = np.stack((begin[head], end[stop]), axis=1).astype("<i8")
        bounds = np.flatnonzero(np.concatenate(([True], own[head][1:] != own[head][:-1], [True])))
        for a, b in zip(bounds, bounds[1:]):
            yield ALONE, int(key[alone[head[a]]]), None, None, None, None, None, None, ranges[a:b].tobytes()
    run, strip = signed(found.run), signed(found.strip)
    for i in np.flatnonzero(kind == MIXED).tolist():
        a, n = int(found.first[i]), int(found.count[i])
        same = (int(run[i]), int(strip[i]))
        data = None if same in sent else found.raw[a : a + n - 1 + length].tobytes()
        sent.add(same)
        yield MIXED, int(key[i]), int(first[i]), n, int(found.place[i]) - a, *same, data, None
    for i in np.flatnonzero(kind == CROWDED).tolist():
        at = np.arange(found.first[i], found.first[i] + found.count[i])
        window = signed(found.hasher.of(at, at + length))
        for k, h in enumerate(window.tolist()):
            yield CROWDED, int(key[i]), int(first[i]) + k, 1, None, None, h, None, None


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equal-length byte rows, and the common length of each row with the one before it.

    Multikey quicksort with eight bytes as a character: rows tied so far are split by their next
    character, rows that stand alone take no further part.
    """
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows
    characters = wide.view(">u8").astype(np.uint64)
    order, common = np.arange(n), np.zeros(n, np.int64)
    new = np.zeros(n, bool)  # a row that begins a group of ties
    new[:1] = True
    active = np.arange(n) if n > 1 else np.zeros(0, np.int64)
    for depth in range(characters.shape[1]):
        if not len(active):
            break
        group = np.cumsum(new)[active]
        inside = np.lexsort((characters[order[active], depth], group))
        order[active] = order[active][inside]
        value = characters[order[active], depth]
        later = active[1:][(active[1:] == active[:-1] + 1) & ~new[active[1:]]]
        at = np.searchsorted(active, later)
        apart = value[at] ^ value[at - 1]
        differs = apart != 0
        same = sum((apart[differs] < np.uint64(1 << b)).astype(np.int64) for b in range(8, 64, 8))
        common[later[differs]] = depth * 8 + same
        common[later[~differs]] = depth * 8 + 8
        new[later[differs]] = True
        tied = ~new
        keep = tied.copy()
        keep[:-1] |= tied[1:]
        active = np.flatnonzero(keep)
    return order, common


def equal_windows(data: list[bytes], left: np.ndarray, count: np.ndarray, times: np.ndarray, length: int) -> np.ndarray:
    """(strips, most windows) of bool: windows that another strip, or a copy of the strip, has too."""
    n = len(data)
    after, before = np.zeros((n, length), np.uint8), np.zeros((n, length), np.uint8)
    for k, (s, p) in enumerate(zip(data, left.tolist())):
        raw = np.frombuffer(s, np.uint8)
        tail, head = raw[p : p + length], raw[:p][::-1]
        after[k, : len(tail)] = tail
        before[k, : len(head)] = head
    right_order, right = multikey_sort(after)
    left_order, reach = multikey_sort(before)
    out = np.zeros((n, int(count.max())), bool)
    for j in range(int(left.max()) + 1):  # windows that begin j bytes before the anchor
        place = left - j
        own = np.flatnonzero((place >= 0) & (place < count))
        if not len(own):
            continue
        one, two = np.empty(n, np.int64), np.empty(n, np.int64)
        one[right_order] = np.cumsum(right < length - j)
        two[left_order] = np.cumsum(reach < j)
        _, at = np.unique(one[own] * (n + 1) + two[own], return_inverse=True)
        repeated = np.bincount(at, times[own])[at] > 1
        out[own[repeated], place[own[repeated]]] = True
    return out


def compared(mixed: DataFrame, length: int) -> DataFrame:
    """(run, strip, windows): a bit per window of each strip, for strips with a repeated window."""
    lead = F.substring("bytes", F.col("left") + 1, F.lit(GRAM))
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    times = mixed.groupBy("run", "strip").agg(F.count("*").alias("times"))
    once = mixed.where(F.col("bytes").isNotNull()).join(growing(times), ["run", "strip"])
    rows = once.withColumn("lead", lead).repartitionByRange(parts, "lead").sortWithinPartitions("lead", "run", "strip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple] = {}
        last = None
        for batch in batches:
            for run_, strip, data, left, count, n in zip(*(batch.column(i).to_pylist() for i in range(6))):
                # Runs come whole; several small ones are sorted together.
                if run_ != last and len(held) > 20_000:
                    yield masks(held, length)
                    held = {}
                last = run_
                held[run_, strip] = (data, left, count, n)
        if held:
            yield masks(held, length)

    return rows.select("run", "strip", "bytes", "left", "count", "times").mapInArrow(
        run, "run long, strip long, windows binary"
    )


def masks(held: dict[tuple[int, int], tuple], length: int) -> pa.RecordBatch:
    data, left, count, times = (list(c) for c in zip(*held.values()))
    found = equal_windows(data, np.array(left), np.array(count), np.array(times), length)
    some = np.flatnonzero(found.any(axis=1))
    keys = list(held)
    bits = np.packbits(found[some], axis=1, bitorder="little")
    return pa.RecordBatch.from_arrays(
        [
            pa.array([keys[i][0] for i in some], pa.int64()),
            pa.array([keys[i][1] for i in some], pa.int64()),
            pa.array([b.tobytes() for b in bits], pa.binary()),
        ],
        ["run", "strip", "windows"],
    )


def window_ranges(docs: DataFrame, length: int, crowd: int, runs_per_shard: int, folder: str) -> DataFrame:
    """(key, ranges, firsts, windows): the repeated windows of every text that has some."""
    runs = stored(repeated_runs(docs, length, crowd), f"{folder}/runs")
    shards = 1 + runs.count() // runs_per_shard
    write_runs(runs, shards, f"{folder}/index")
    found = stored(strips(docs, length, shards, f"{folder}/index"), f"{folder}/strips")
    mixed = found.where(F.col("kind") == MIXED)
    bits = stored(compared(mixed, length), f"{folder}/windows")
    some = mixed.select("key", "first", "run", "strip").join(growing(bits), ["run", "strip"])
    single = found.where(F.col("kind") == CROWDED).select("key", "first", "strip")
    often = single.groupBy("strip").agg(F.count("*").alias("n")).where("n > 1").select("strip")
    crowded = single.join(growing(often), "strip").select("key", "first", F.lit(b"\x01").alias("windows"))
    bit_rows = some.select("key", "first", "windows").union(crowded)
    alone = found.where(F.col("kind") == ALONE).select("key", "ranges")
    empty = F.lit(None).cast("binary")
    both = alone.select("key", "ranges", F.lit(None).cast("long").alias("first"), empty.alias("windows")).union(
        bit_rows.select("key", empty.alias("ranges"), "first", "windows")
    )
    return both.groupBy("key").agg(
        F.collect_list("ranges").alias("ranges"),
        F.collect_list(F.struct("first", "windows")).alias("bits"),
    )


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeated_bytes(size: int, ranges: list[bytes], bits: list[dict], length: int) -> np.ndarray:
    """Which bytes of a text a repeated window covers."""
    change = np.zeros(size + 1, np.int64)
    for data in ranges:
        for a, b in np.frombuffer(data, "<i8").reshape(-1, 2):
            change[a] += 1
            change[b - 1 + length] -= 1
    for item in bits:
        if item["windows"] is not None:
            at = item["first"] + np.flatnonzero(
                np.unpackbits(np.frombuffer(item["windows"], np.uint8), bitorder="little")
            )
            np.add.at(change, at, 1)
            np.add.at(change, at + length, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(
    documents: DataFrame, length: int = 200, crowd: int = 50_000, runs_per_shard: int = 8_000_000, texts: bool = False
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row of ``documents``.

    Every byte covered by a ``length``-byte string that also starts elsewhere, in the same or another
    document, is removed; strings are judged on the input. Null text is empty, texts shorter than
    ``length`` stay; rows that repeat a doc_id are documents of their own; a null doc_id is passed on; other columns
    are ignored; an empty table gives no row. ``texts`` adds the remaining bytes as ``kept``. Runs with more
    than ``crowd`` occurrences take the way of step 4, with the same result.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    folder = new_folder(documents.sparkSession, "substrings")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    found = window_ranges(docs, length, crowd, runs_per_shard, folder).withColumnRenamed("key", "own")
    rows = docs.join(growing(found), docs["key"] == F.col("own"), "left").select("doc_id", "text", "ranges", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out, rest = [], []
                for doc, text, ranges, bits in zip(*(part.column(i).to_pylist() for i in range(4))):
                    raw = text.encode()
                    gone, spans = 0, 0
                    if ranges or bits:
                        covered = repeated_bytes(len(raw), ranges, bits, length)
                        gone = int(covered.sum())
                        spans = int((covered & ~np.concatenate(([False], covered[:-1]))).sum())
                        size = len(raw)
                        raw = np.frombuffer(raw, np.uint8)[~covered].tobytes()
                        out.append((doc, size, gone, spans, hashlib.sha256(raw).hexdigest()))
                    else:
                        out.append((doc, len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                    rest.append(raw)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                names = [x.split()[0] for x in KEPT.split(", ")]
                if texts:
                    columns.append(pa.array(rest, pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, KEPT + (", kept binary" if texts else ""))
