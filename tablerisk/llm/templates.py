"""Line deduplication with a log-template tree.

Lines are parsed at fixed depth: by token count, then by their leading tokens, with tokens that
hold digits taken as variable. In a leaf, lines that agree in enough positions share a template
whose other positions are variable. Lines whose template occurs in many documents are dropped.

A template cannot recur in many documents unless its leaf does. So leaves are counted first, by hash, and only lines of
leaves that recur leave the scan that reads them; the hashes of these leaves lie in mapped files.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerisk.llm.hashindex import HashIndex, write_index
from tablerisk.llm.store import growing, new_folder, stored
from tablerisk.llm.text import slices

VARIABLE = "<*>"
DIGITS = set("0123456789")
SHARD_LEAVES = 2_000_000


def masked(tokens: list[str]) -> list[str]:
    """Tokens, variable where they hold a digit."""
    return [VARIABLE if not DIGITS.isdisjoint(t) else t for t in tokens]


def leaf_of(tokens: list[str], depth: int) -> str:
    return f"{len(tokens)} {' '.join(masked(tokens[:depth]))}"


def lines_of(text: str | None, depth: int) -> Iterator[tuple[str, str]]:
    """Leaf and text of every line that has a token, whatever its length."""
    for line in (text or "").split("\n"):
        if tokens := line.split():
            yield leaf_of(tokens, depth), line


def leaf_hash(leaves: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x) for x in leaves], np.uint64)


def write_busy_leaves(documents: DataFrame, depth: int, min_docs: int, folder: str) -> int:
    """Index of the leaves that at least ``min_docs`` rows have; returns the number of its files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                own = [leaf for text in texts for leaf in {leaf for leaf, _ in lines_of(text, depth)}]
                yield pa.RecordBatch.from_arrays([pa.array(leaf_hash(own).view(np.int64))], ["leaf"])

    def entries(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        hashes = np.sort(pdf["leaf"].to_numpy().view(np.uint64))
        return hashes, np.ones(len(hashes), np.uint8)

    counted = documents.select("text").mapInArrow(run, "leaf long").groupBy("leaf").count()
    busy = stored(counted.where(F.col("count") >= min_docs).select("leaf"), f"{folder}/busy")
    shards = 1 + busy.count() // SHARD_LEAVES
    shard = F.shiftright(F.shiftrightunsigned("leaf", 32) * shards, 32).cast("int")
    write_index(busy.withColumn("shard", shard), entries, shards, f"{folder}/busy-index")
    return shards


def template_lines(documents: DataFrame, depth: int, folder: str, shards: int) -> DataFrame:
    """(doc, leaf, line): every distinct masked line of every document in a leaf that recurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = HashIndex(f"{folder}/busy-index", shards)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = zip(part.column("doc").to_pylist(), part.column("text").to_pylist())
                found = [(doc, leaf, line) for doc, text in texts for leaf, line in lines_of(text, depth)]
                met = index.numbers(leaf_hash([leaf for _, leaf, _ in found]))
                rows = {(found[k][0], found[k][1], " ".join(masked(found[k][2].split()))): None for k in np.flatnonzero(met)}
                columns = list(zip(*rows)) or [[], [], []]
                types = (pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc", "leaf", "line"])

    return documents.select(F.col("doc_id").cast("long").alias("doc"), "text").mapInArrow(
        run, "doc long, leaf string, line string"
    )


class Leaf:
    """Templates of one leaf; only positions that are not variable can agree with a line."""

    def __init__(self, depth: int, similarity: float):
        self.depth, self.similarity = depth, similarity
        self.tokens: list[list[str]] = []
        self.roots: list[str] = []
        self.holders: dict[tuple[int, str], set[int]] = defaultdict(set)

    def place(self, line: str) -> str:
        """The root line of the template that takes ``line``; positions that differ become variable."""
        tokens = line.split(" ")
        fixed = min(self.depth, len(tokens))
        agreed = Counter()
        for k in range(fixed, len(tokens)):
            if tokens[k] != VARIABLE:
                agreed.update(self.holders.get((k, tokens[k]), ()))
        head = sum(t != VARIABLE for t in tokens[:fixed])
        best = max(agreed, key=lambda i: (agreed[i], -i), default=0 if self.tokens else None)
        if best is None or head + agreed[best] < self.similarity * len(tokens):
            best = len(self.tokens)
            self.tokens.append(tokens)
            self.roots.append(line)
            for k in range(fixed, len(tokens)):
                if tokens[k] != VARIABLE:
                    self.holders[k, tokens[k]].add(best)
            return line
        own = self.tokens[best]
        for k in range(fixed, len(tokens)):
            if own[k] != tokens[k] and own[k] != VARIABLE:
                self.holders[k, own[k]].discard(best)
                own[k] = VARIABLE
        return self.roots[best]


def parse_leaves(lines: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(leaf, line, template) from (leaf, line, n): each leaf streams past in order of support, then text.

    The order decides which line founds a template, so the result does not depend on partitions. A task
    holds the templates of one leaf, not its lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, leaf = None, Leaf(depth, similarity)
        for batch in batches:
            templates = []
            for name, line in zip(batch.column("leaf").to_pylist(), batch.column("line").to_pylist()):
                if name != current:
                    current, leaf = name, Leaf(depth, similarity)
                templates.append(leaf.place(line))
            yield pa.RecordBatch.from_arrays(
                [batch.column("leaf"), batch.column("line"), pa.array(templates, pa.string())],
                ["leaf", "line", "template"],
            )

    ordered = lines.repartition("leaf").sortWithinPartitions("leaf", F.desc("n"), "line")
    return ordered.select("leaf", "line", "n").mapInArrow(run, "leaf string, line string, template string")


def recurring_lines(
    documents: DataFrame, min_docs: int, depth: int, similarity: float, folder: str
) -> DataFrame:
    """(doc, line): the masked lines of each document whose template occurs in ``min_docs`` documents."""
    shards = write_busy_leaves(documents, depth, min_docs, folder)
    lines = stored(template_lines(documents, depth, folder, shards), f"{folder}/lines")
    distinct = lines.groupBy("leaf", "line").agg(F.count("*").alias("n"))
    # A leaf with less support cannot hold a recurring template.
    busy = distinct.groupBy("leaf").agg(F.sum("n").alias("total")).where(F.col("total") >= min_docs)
    parsed = stored(
        parse_leaves(distinct.join(growing(busy), "leaf", "left_semi"), depth, similarity), f"{folder}/templates"
    )
    held = lines.join(growing(parsed), ["leaf", "line"])
    support = held.select("leaf", "template", "doc").distinct().groupBy("leaf", "template").count()
    often = parsed.join(growing(support.where(F.col("count") >= min_docs)), ["leaf", "template"], "left_semi")
    return lines.join(growing(often), ["leaf", "line"], "left_semi").select("doc", "line")


def drop_recurring_lines(
    documents: DataFrame,
    min_docs: int = 10,
    depth: int = 3,
    similarity: float = 0.7,
) -> DataFrame:
    """Documents without their recurring template lines; adds n_lines and n_dropped_lines.

    Lines of any length are parsed. All lines of a recurring template go, from every document, so copies of a
    document stay copies of each other. A document that consists of recurring lines only is a copy and
    not a frame around content; it keeps its text. Null text stays null with 0 lines; lines without a token stay;
    rows that repeat a doc_id are one document to the count and are cut alike; other columns
    are passed on, those named like the added ones are replaced. An empty table gives an empty one.
    """
    folder = new_folder(documents.sparkSession, "templates")
    added = ["n_lines", "n_dropped_lines"]
    documents = documents.drop(*added)
    found = recurring_lines(documents, min_docs, depth, similarity, folder)
    cut = found.groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("line").alias("__lines"))
    cut = stored(cut, f"{folder}/cut")
    met = documents["doc_id"].cast("long").eqNullSafe(cut["__doc"])
    rows = documents.join(growing(cut), met, "left").drop("__doc")
    schema = T.StructType([*documents.schema.fields, *(T.StructField(n, T.LongType()) for n in added)])
    text_at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, dropped = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("__lines").to_pylist()):
                lines = text.split("\n") if text is not None else []
                kept = lines
                if gone:
                    gone = set(gone)
                    kept = [x for x in lines if " ".join(masked(x.split())) not in gone]
                    if not any(x.strip() for x in kept):
                        kept = lines
                texts.append("\n".join(kept) if text is not None else None)
                total.append(len(lines))
                dropped.append(len(lines) - len(kept))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[text_at] = pa.array(texts, pa.string())
            columns += [pa.array(total, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)
