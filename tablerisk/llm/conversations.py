"""Repair of conversation structure: the cheapest edits that make roles alternate.

Rows of a conversation are kept, given another role, or deleted, and empty rows may be inserted, so that the roles read
system?, then user and assistant in turn. All edits of n rows form a lattice of n + 1 layers with four nodes: nothing
said yet, system said, user said, assistant said. A Dijkstra search runs from the first node forward and another from
the last nodes in reverse; when their heaps meet, all crossings of the least cost are finished, and of the paths through
them the least audit (the edits' initials) is taken.

Spark numbers and judges the rows of a conversation in windows that spill; blocks of at most ``BLOCK`` rows are searched
apart from every node to every node, and the blocks of a conversation are chained by the same search with blocks as
edges. So a conversation of any length is searched by many tasks; only its audit, a byte a row, meets in one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablerisk.llm.store import new_folder, stored

BLOCK = 256
SPACES = " \t\n\x0b\f\r"
ENDS = ".!?"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LARGEST = (1 << 63) - 1
RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
# A row's code letter: its role's initial (s, u, a or other) times three, plus 0 sound, 1 must go, 2 truncated.
CODES = "abcdefghijkl"

Edge = tuple[int, int, str]


def shortest(start: int, ends: list[int], follow: Callable[[int], list[Edge]], precede: Callable[[int], list[Edge]]) -> tuple[int, str] | None:
    """Least cost from ``start`` to one of ``ends`` and the least audit of that cost; None if there is no path.

    Edges are (node, cost, letters). Edges without cost lead to higher nodes, and no audit of a node is the beginning of
    another of equal cost, so the least audit of a path consists of the least ones of its two parts.
    """
    edges = (follow, precede)
    best: tuple[dict, dict] = ({start: (0, "")}, {e: (0, "") for e in ends})
    heaps: tuple[list, list] = ([(0, start)], [(0, -e) for e in sorted(ends, reverse=True)])
    settled: tuple[set, set] = (set(), set())
    least = None

    def settle(side: int, node: int) -> None:
        nonlocal least
        settled[side].add(node)
        cost, audit = best[side][node]
        if node in settled[1 - side]:
            total = cost + best[1 - side][node][0]
            least = total if least is None else min(least, total)
        for other, price, letters in edges[side](node):
            found = (cost + price, audit + letters if side == 0 else letters + audit)
            if other in settled[1 - side]:
                total = found[0] + best[1 - side][other][0]
                least = total if least is None else min(least, total)
            if other not in settled[side] and (other not in best[side] or found < best[side][other]):
                if other not in best[side] or found[0] < best[side][other][0]:
                    heappush(heaps[side], (found[0], other if side == 0 else -other))
                best[side][other] = found

    settle(0, start)
    for end in ends:
        settle(1, end)
    while True:
        for side in (0, 1):  # nodes that were settled or have become cheaper since
            while heaps[side] and (n := abs(heaps[side][0][1])) in settled[side]:
                heappop(heaps[side])
        if not heaps[0] or not heaps[1]:
            break
        if least is not None and heaps[0][0][0] + heaps[1][0][0] > least:
            break
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        settle(side, abs(heappop(heaps[side])[1]))
    if not heaps[0] or not heaps[1]:  # one search has seen all it can reach, so its own audits are the least
        side = 0 if not heaps[0] else 1
        found = [best[side][n] for n in (ends if side == 0 else [start]) if n in settled[side]]
        return min(found, default=None)
    crossings = []
    for node in settled[0]:
        cost, audit = best[0][node]
        if node in settled[1] and cost + best[1][node][0] == least:
            crossings.append(audit + best[1][node][1])
        for other, price, letters in follow(node):
            if other in settled[1] and cost + price + best[1][other][0] == least:
                crossings.append(audit + letters + best[1][other][1])
    return least, min(crossings)


def says(state: int) -> int:
    """The node after the one role that may come next besides a first system row."""
    return ASSISTANT if state == USER else USER


def row_edges(codes: str) -> tuple[Callable[[int], list[Edge]], Callable[[int], list[Edge]]]:
    """Edges out of and into the nodes layer * 4 + state of the lattice of these rows."""
    kinds = [divmod(CODES.index(c), 3) for c in codes]

    def across(row: int, state: int) -> list[Edge]:
        initial, fault = kinds[row]
        layer = 4 * (row + 1)
        out = [(layer + state, DELETE, "D")]
        if fault != 1:
            extra = TRUNCATED if fault == 2 else 0
            out.append((layer + says(state), REROLE + extra, "R"))
            kept = SYSTEM if initial == 0 and state == NOTHING else says(state)
            if initial < 3 and kept == initial + 1:
                out.append((layer + kept, KEEP + extra, "K"))
        return out

    def follow(node: int) -> list[Edge]:
        row, state = divmod(node, 4)
        inserted = [(4 * row + says(state), INSERT, "I")]
        return inserted + across(row, state) if row < len(kinds) else inserted

    def precede(node: int) -> list[Edge]:
        row, state = divmod(node, 4)
        out = [(4 * row + s, INSERT, "I") for s in range(4) if says(s) == state]
        if row:
            out += [(4 * (row - 1) + s, c, e) for s in range(4) for n, c, e in across(row - 1, s) if n == node]
        return out

    return follow, precede


@lru_cache(maxsize=50_000)
def whole_path(codes: str) -> tuple[int, str]:
    """Least cost and audit of a whole conversation."""
    end = 4 * len(codes)
    return shortest(NOTHING, [end + NOTHING, end + ASSISTANT], *row_edges(codes))


@lru_cache(maxsize=1_000)
def block_paths(codes: str, first: bool) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of a block of rows, from every state or from the first one."""
    edges, end = row_edges(codes), 4 * len(codes)
    found = [(a, b, shortest(a, [end + b], *edges)) for a in (range(1) if first else range(4)) for b in range(4)]
    return [(a, b, *path) for a, b, path in found if path]


def chained(blocks: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """Least cost and audit of a conversation from the paths of its blocks."""
    if len(blocks) == 1:
        return min((cost, audit) for _, b, cost, audit in blocks[0] if b in (NOTHING, ASSISTANT))
    out: dict[int, list[Edge]] = {}
    into: dict[int, list[Edge]] = {}
    for k, paths in enumerate(blocks):
        for a, b, cost, audit in paths:
            out.setdefault(4 * k + a, []).append((4 * k + 4 + b, cost, audit))
            into.setdefault(4 * k + 4 + b, []).append((4 * k + a, cost, audit))
    end = 4 * len(blocks)
    return shortest(NOTHING, [end + NOTHING, end + ASSISTANT], lambda n: out.get(n, []), lambda n: into.get(n, []))


def edits_of_rows(audit: str) -> list[str]:
    """The audit cut at the rows: inserted rows go with the row after them, those at the end with the last row."""
    rows, waiting = [], ""
    for letter in audit:
        waiting += letter
        if letter != "I":
            rows.append(waiting)
            waiting = ""
    rows[-1] += waiting
    return rows


def readable(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; a null role or text is one space."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *texts)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults for tests, by crc32 of conv_id:turn modulo 20: dropped (live is false), emptied, without sentence
    ends, repeated beside themselves, or given to the user. Nulls are one space in that text, too."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    rows = readable(conversations).withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.col("kind") != 0, F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("live"))


def judged(rows: DataFrame) -> DataFrame:
    """Live rows numbered within their conversation, with their fault, code letter, and whether their role may follow the last.

    Rows that are not live only keep their conversation from vanishing; they come last.
    """
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    order = [~F.col("live"), F.col("turn").asc_nulls_first(), "role", "text"]
    within = Window.partitionBy("conv_id").orderBy(*order)
    equal = Window.partitionBy("conv_id", "live", "role", "text").orderBy("pos")
    rows = rows.repartition("conv_id").withColumn("initial", initial).withColumn("body", body)
    rows = rows.withColumn("pos", F.row_number().over(within) - 1).withColumn("before", F.lag("initial").over(within))
    rows = rows.withColumn("again", F.row_number().over(equal) > 1)
    blank = F.col("body") == ""
    open_ended = ~F.substring("body", -1, 1).isin(*ENDS)
    fault = F.when(blank, "blank").when(F.col("again"), "duplicate").when(open_ended, "truncated").otherwise("")
    rows = rows.withColumn("fault", fault)
    place = F.expr("instr('sua', initial)")
    group = F.when((F.col("initial") == "") | (place == 0), 3).otherwise(place - 1)
    state = F.when(F.col("fault") == "", 0).when(F.col("fault") == "truncated", 2).otherwise(1)
    illegal = F.col("live") & (F.col("pos") > 0) & ~F.concat("before", "initial").isin("su", "ua", "au")
    return rows.select(
        "conv_id", "live", "pos", "turn", "role", "text", "fault", illegal.alias("illegal"),
        F.substring(F.lit(CODES), (3 * group + state + 1).cast("int"), F.lit(1)).alias("code"),
    )


def repair_edits(turns: DataFrame) -> DataFrame:
    """conv_id, pos, cost, edits: the cheapest repair of every conversation, row by row; the first row has its cost."""
    rows = turns.where("live").select("conv_id", "pos", "code", F.floor(F.col("pos") / BLOCK).alias("block"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda r: r["code"])
    blocks = rows.groupBy("conv_id", "block").agg(F.array_join(listed, "").alias("codes"))
    path = "array<struct<a: int, b: int, cost: long, audit: string>>"
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for block, codes in zip(batch.column("block").to_pylist(), batch.column("codes").to_pylist()):
                if block == 0 and len(codes) < BLOCK:  # the only block
                    paths = [(NOTHING, NOTHING, *whole_path(codes))]
                else:
                    paths = block_paths(codes, block == 0)
                found.append([dict(zip(("a", "b", "cost", "audit"), p)) for p in paths])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("block"), pa.array(found, kind)], ["conv_id", "block", "paths"]
            )

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, blocks in zip(batch.column("conv_id").to_pylist(), batch.column("blocks").to_pylist()):
                own = [[(p["a"], p["b"], p["cost"], p["audit"]) for p in b["paths"]] for b in blocks]
                cost, audit = chained(own)
                edits = edits_of_rows(audit)
                columns = [[conv] * len(edits), list(range(len(edits))), [cost] + [0] * (len(edits) - 1), edits]
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "pos", "cost", "edits"])

    found = blocks.mapInArrow(search, f"conv_id long, block long, paths {path}")
    listed = F.array_sort(F.collect_list(F.struct("block", "paths"))).alias("blocks")
    return found.groupBy("conv_id").agg(listed).mapInArrow(chain, "conv_id long, pos long, cost long, edits string")


class Conversation:
    """What is known of a conversation after its rows so far; texts pass by and are not kept."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.illegal = self.cost = self.turns = 0
        self.low: int | None = None
        self.high: int | None = None
        self.audit: list[str] = []
        self.state, self.lines, self.hash = NOTHING, 0, hashlib.sha256()

    def say(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def row(self, turn: int | None, role: str, text: str, fault: str, illegal: bool, cost: int, edits: str) -> None:
        self.faults[fault] += 1
        self.illegal += illegal
        self.cost += cost
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.audit.append(edits)
        for letter in edits:
            if letter == "D":
                continue
            after = SYSTEM if letter == "K" and role[0] == "s" else says(self.state)
            said = role if letter == "K" else "assistant" if after == ASSISTANT else "user"
            self.say(said, "" if letter == "I" else text)
            self.state = after

    def result(self) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, LARGEST)
        f = self.faults
        counts = (gaps, f["blank"], f["duplicate"], f["truncated"], self.illegal, self.cost)
        return (self.conv_id, *counts, "".join(self.audit), self.hash.hexdigest())


def summaries(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """One row a conversation, from its rows in order with their edits; they meet by one sort, and rows are streamed."""
    kept = turns.select("conv_id", "live", "pos", F.lit(1).alias("part"), "turn", "role", "text", "fault", "illegal", F.lit(0).cast("long").alias("cost"), F.lit("").alias("edits"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("fault", "string"), ("illegal", "boolean"))]
    letters = edits.select("conv_id", F.lit(True).alias("live"), F.col("pos"), F.lit(0).alias("part"), *nothing, "cost", "edits")
    rows = kept.unionByName(letters).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("live"), "pos", "part")
    names = ("live", "part", "turn", "role", "text", "fault", "illegal", "cost", "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cost, edit = None, 0, ""
        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in names]
            for conv, live, part, turn, role, text, fault, illegal, price, letters in zip(batch.column("conv_id").to_pylist(), *columns):
                if held is None or conv != held.conv_id:
                    if held is not None:
                        done.append(held.result())
                    held = Conversation(conv)
                if part == 0:
                    cost, edit = price, letters
                elif live:
                    held.row(turn, role, text, fault, illegal, cost, edit)
            yield result_batch(done)
        if held is not None:
            yield result_batch([held.result()])

    return rows.mapInArrow(run, RESULT)


def result_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 7 + [pa.string()] * 2
    columns = list(zip(*rows)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [f.split()[0] for f in RESULT.split(", ")])


def repaired(conversations: DataFrame, damage: bool = False) -> DataFrame:
    """Faults of every conversation, the cheapest repair and its hash.

    Rows are taken by turn, nulls first, and equal turns by role and text. A row is blank, else a duplicate of an earlier
    role and text, else truncated. Keeping costs 0, another role 1, deleting 2 (which blank and duplicate rows must be),
    inserting an empty row 5, and a truncated row that stays 5 more. ``damage`` first inserts known faults.

    A null role or text is one space; a role that begins with none of s, u, a (an empty one too) can't be kept.
    Rows with a null conv_id are one conversation. Repeated rows are duplicates, very long texts are hashed as they stream by, other
    columns are ignored. A conversation without live rows has zeros, an empty audit and the hash of the empty string;
    an empty table gives no row. A span of turns beyond 64 bits counts as the largest number.
    """
    folder = new_folder(conversations.sparkSession, "conversations")
    rows = damaged(conversations) if damage else readable(conversations).withColumn("live", F.lit(True))
    turns = stored(judged(rows), f"{folder}/turns")
    edits = stored(repair_edits(turns), f"{folder}/edits")
    return summaries(turns, edits)
