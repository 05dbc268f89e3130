"""Packing of documents into sequences by linear grouping and best fit.

Only the histogram of piece lengths reaches the driver, at most one row per length. Large pieces are
ranked by length and put in groups of equal cardinality, each rounded up to its largest length;
configurations of these few sizes are optimised with their multiplicities; the actual pieces then take
the places of their group by rank; small pieces fill what is left by best fit. The plan is a list of
rank ranges, so it is as long as there are lengths and configurations, not pieces, and Spark
assigns pieces to places by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablerisk.llm.pieces import TokenTable, kept, spread, woven
from tablerisk.llm.store import growing, new_folder, stored
from tablerisk.llm.text import slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RANKED_TOGETHER = 200_000
#: Bytes of text that a task cuts and looks up at once. Its arrays take up to 35 times as much, next to a JVM whose heap
#: the stages before have filled.
PACKED_SLICE = 2 << 20


def pieces(documents: DataFrame, tokenizer: str, keeps_space: bool, end_id: int, capacity: int) -> DataFrame:
    """Cut every document's ids into pieces of ``capacity``; the first piece may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            for rows in slices(batch, "text", PACKED_SLICE):
                table = table or kept(("tokens", tokenizer, keeps_space), lambda: TokenTable(tokenizer, keeps_space))
                flat, sizes = table.encode(rows.column("text"))
                ends = np.full(len(rows), end_id, np.uint32), np.ones(len(rows), np.int64)
                flat, sizes = woven((flat, sizes), ends)
                many = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(rows)), many)
                number = spread(np.zeros(len(rows), np.int64), many)
                first = (sizes - 1) % capacity + 1
                begin = np.where(number, first[owner] + (number - 1) * capacity, 0)
                length = np.where(number, capacity, first[owner])
                view = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
                bounds = zip((4 * (begin + (np.cumsum(sizes) - sizes)[owner])).tolist(), (4 * length).tolist())
                sums = [zlib.crc32(view[a : a + n]) for a, n in bounds]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id").take(pa.array(owner)),
                        *(pa.array(x) for x in (number.astype(np.int32), begin, length)),
                        pa.array(sums, pa.int64()),
                    ],
                    [x.split()[0] for x in PIECES.split(", ")],
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


@dataclass
class Plan:
    """Rank ranges of each length and where they go: sequence ``sequence + i`` takes rank ``rank + i``."""

    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0

    def put(self, length: int, rank: int, count: int, sequence: int, offset: int) -> None:
        for column, value in zip(
            (self.length, self.rank, self.count, self.sequence, self.offset), (length, rank, count, sequence, offset)
        ):
            column.append(int(value))


def configuration(sizes: list[int], left: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest multiset of sizes still in demand that holds the largest of them."""
    first = sizes[0]
    reached, best = {0: None}, 0
    room = capacity - first
    for s in sizes:
        if s > room:
            continue
        most = min(left[s] - (s == first), room // s)
        if most <= 0:
            continue
        # Places a size at most ``most`` times on top of what smaller sums reached before it.
        for base in list(reached):
            total = base
            for k in range(1, most + 1):
                total += s
                if total > room or total in reached:
                    break
                reached[total] = (s, k, base)
        best = max(reached)
        if best == room:
            break
    best = max(reached)
    chosen = {first: 1}
    while step := reached[best]:
        s, k, best = step
        chosen[s] = chosen.get(s, 0) + k
    return chosen


def grouped(lengths: np.ndarray, counts: np.ndarray, groups: int) -> dict[int, int]:
    """Demand by rounded size: ranks in descending length, equal cardinality, rounded to the first."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    cuts = np.unique(np.arange(groups) * total // groups)
    sizes = lengths[np.searchsorted(ends, cuts, "right")]
    demand: dict[int, int] = {}
    for s, n in zip(sizes.tolist(), np.diff(np.append(cuts, total)).tolist()):
        demand[s] = demand.get(s, 0) + n
    return demand


def pack(histogram: dict[int, int], capacity: int, groups: int = 8192, small: int | None = None) -> Plan:
    """A plan for a histogram of lengths from 1 to ``capacity``."""
    plan = Plan()
    small = capacity // 16 if small is None else small
    rest: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, count)
    if full := histogram.get(capacity, 0):
        plan.put(capacity, 0, full, 0, 0)
        plan.sequences = full
    large = sorted((s for s in histogram if small < s < capacity and histogram[s]), reverse=True)
    if large:
        lengths, counts = np.array(large), np.array([histogram[s] for s in large])
        ends = np.cumsum(counts)
        left = grouped(lengths, counts, groups)
        cursor, at = {}, 0
        for s in sorted(left, reverse=True):
            cursor[s], at = at, at + left[s]
        while left:
            sizes = sorted(left, reverse=True)
            chosen = configuration(sizes, left, capacity)
            times = min(left[s] // n for s, n in chosen.items())
            ranks = []
            for s in sorted(chosen, reverse=True):
                for _ in range(chosen[s]):
                    ranks.append(cursor[s])
                    cursor[s] += times
                left[s] -= chosen[s] * times
                if not left[s]:
                    del left[s]
            substitute(plan, rest, ranks, times, lengths, ends, capacity)
    for s in sorted((s for s in histogram if s <= small and histogram[s]), reverse=True):
        best_fit(plan, rest, s, histogram[s], capacity)
    return plan


def best_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """The plan with the fewest sequences over a few group counts and limits for small pieces."""
    tries = [(g, capacity // s) for g in (512, 8192) for s in (8, 16, 32)]
    return min((pack(histogram, capacity, g, s) for g, s in tries), key=lambda plan: plan.sequences)


def substitute(
    plan: Plan, rest: dict, ranks: list[int], times: int, lengths: np.ndarray, ends: np.ndarray, capacity: int
) -> None:
    """Give ``times`` sequences their actual pieces: the k-th place of sequence i takes rank ranks[k] + i."""
    cuts = {0, times}
    for r in ranks:
        inside = ends[np.searchsorted(ends, r, "right") : np.searchsorted(ends, r + times, "left")] - r
        cuts.update(int(x) for x in inside if x < times)
    bounds = sorted(cuts)
    begins = ends - np.diff(ends, prepend=0)
    for a, b in zip(bounds, bounds[1:]):
        used = 0
        for r in ranks:
            k = int(np.searchsorted(ends, r + a, "right"))
            plan.put(lengths[k], r + a - begins[k], b - a, plan.sequences + a, used)
            used += int(lengths[k])
        if used < capacity:
            rest.setdefault(capacity - used, []).append((plan.sequences + a, b - a))
    plan.sequences += times


def best_fit(plan: Plan, rest: dict, size: int, count: int, capacity: int) -> None:
    """Put all pieces of one small size where they leave the least room; open sequences when none has room."""
    rank = 0
    while rank < count:
        room = min((r for r in rest if r >= size), default=None)
        if room is None:
            opened = -(-(count - rank) // (capacity // size))
            rest.setdefault(capacity, []).append((plan.sequences, opened))
            plan.sequences += opened
            continue
        first, run = rest[room].pop()
        placed = min(run, count - rank)
        if placed < run:
            rest[room].append((first + placed, run - placed))
        if not rest[room]:
            del rest[room]
        plan.put(size, rank, placed, first, capacity - room)
        if room > size:
            rest.setdefault(room - size, []).append((first, placed))
        rank += placed


def ranked(cut: DataFrame, largest: int) -> DataFrame:
    """Number the pieces of each length from 0; a frequent length is numbered in stretches with offsets."""
    stretches = 1 + largest // RANKED_TOGETHER
    cut = cut.withColumn("stretch", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(stretches)))
    within = Window.partitionBy("length", "stretch")
    sizes = cut.groupBy("length", "stretch").count()
    earlier = Window.partitionBy("length").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "stretch", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    numbered = cut.withColumn("rank", F.row_number().over(within.orderBy("doc_id", "piece", "ids_crc32")) - 1)
    joined = numbered.join(growing(offsets), ["length", "stretch"])
    return joined.withColumn("rank", F.col("rank") + F.col("before")).drop("stretch", "before")


def place(numbered: DataFrame, plan: Plan) -> DataFrame:
    """Look up each piece's place; the plan's size is bounded by the number of lengths."""
    order = np.lexsort((plan.rank, plan.length))
    length, rank, sequence, offset = (
        np.array(x, np.int64)[order] for x in (plan.length, plan.rank, plan.sequence, plan.offset)
    )
    keys = (length << 40) + rank
    schema = PIECES + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (batch.column("length").to_numpy() << 40) + own, "right") - 1
            columns = [batch.column(i) for i in range(5)]
            columns += [pa.array(sequence[at] + own - rank[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, schema)


def packed(
    documents: DataFrame, tokenizer: str, keeps_space: bool = True, end_id: int = 2, capacity: int = 1024
) -> DataFrame:
    """One row per piece of every document with its sequence and place in it.

    Null text is empty and gives the end id alone. Rows that repeat a doc_id are packed each on its own;
    other columns are ignored; an empty table gives no row.
    """
    folder = new_folder(documents.sparkSession, "packing")
    cut = stored(pieces(documents, tokenizer, keeps_space, end_id, capacity), f"{folder}/pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # <= capacity rows
    plan = best_plan(histogram, capacity)
    return place(ranked(cut, max(histogram.values(), default=0)), plan)
