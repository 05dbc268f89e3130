"""A factorisation machine over hashed words, statistics of a text's structure, and its recorded length.

score(x) = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The last sum is computed in time linear in
the features of a document, as half of sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2).

Spark turns texts into sparse features; one task fits the model on at most ``max_labelled`` labelled
documents, whose features are bounded by the feature space, and writes the weights to the shared folder,
a few megabytes whatever the corpus; all documents are then scored where they lie, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerisk.llm.store import Folder, growing, new_folder, stored
from tablerisk.llm.text import slices, text_bytes, words

WORD_BITS = 15
BUCKETS = 16
STATISTICS = 14
SIZE = (1 << WORD_BITS) + BUCKETS * STATISTICS
STATISTIC_VALUE = 0.3
FEATURES = "doc_id long, label int, place array<int>, value array<float>"

# Byte classes of the structure statistics.
OTHER, UPPER, LETTER, DIGIT, SYMBOL, STOP, PAUSE, LEAD = range(8)
CLASSES = {UPPER: b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", LETTER: b"abcdefghijklmnopqrstuvwxyz", DIGIT: b"0123456789",
           SYMBOL: b"#*$%&|<>@{}[]\\^_=~+/", STOP: b".!?", PAUSE: b",;:-()'\"", LEAD: bytes(range(0xC0, 0x100))}
CLASS_OF = np.zeros(256, np.uint8)
for number, members in CLASSES.items():
    CLASS_OF[list(members)] = number
LINE_ENDS = np.zeros(256, bool)
LINE_ENDS[0x0A] = True


def log_bucket(x: np.ndarray, unit: float) -> np.ndarray:
    """Bucket of a value at or above 0: the number of doublings from ``unit`` on."""
    return np.clip(np.log2(1 + np.maximum(x, 0) / unit), 0, BUCKETS - 1).astype(np.int64)


def distinct_share(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Share of a document's items that equal an earlier one."""
    order = np.lexsort((hashes, doc))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    total = np.maximum(np.bincount(doc, minlength=n), 1)
    return np.bincount(doc[order], again, n) / total


def statistics(texts: pa.Array, n_chars: np.ndarray) -> np.ndarray:
    """One bucket number per document and statistic; ``n_chars`` below 0 is a missing length."""
    raw, offsets = text_bytes(texts)
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kind = np.bincount(owner * 8 + CLASS_OF[raw], minlength=8 * n).reshape(n, 8).astype(float)
    found = words(texts)
    hashes = found.hashes()
    n_words = np.bincount(found.doc, minlength=n).astype(float)
    each = np.maximum(n_words, 1)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (found.doc[1:] == found.doc[:-1])
    lines = words(texts, separators=LINE_ENDS)
    n_lines = np.maximum(np.bincount(lines.doc, minlength=n), 1)
    letters = kind[:, UPPER] + kind[:, LETTER] + kind[:, LEAD]
    size = np.maximum(np.diff(offsets), 1)
    symbols = np.bincount(found.doc, CLASS_OF[found.raw[found.end - 1]] == SYMBOL, n)
    shares = [
        kind[:, UPPER] / np.maximum(letters, 1),
        kind[:, DIGIT] / size,
        kind[:, SYMBOL] / size,
        symbols / each,
        kind[:, LEAD] / size,
        np.bincount(found.doc, same, n) / each,
        distinct_share(hashes, found.doc, n),
        distinct_share(lines.hashes(), lines.doc, n),
    ]
    columns = [log_bucket(x, 1 / 512) for x in shares]
    columns += [log_bucket(x, 1 / 32) for x in (kind[:, STOP] / each, kind[:, PAUSE] / each)]
    columns += [
        log_bucket(n_words, 1.0),
        np.clip(2 * (letters / each), 0, BUCKETS - 1).astype(np.int64),
        log_bucket(n_words / n_lines, 1.0),
        np.where(n_chars < 0, BUCKETS - 1, np.minimum(log_bucket(n_chars, 1.0), BUCKETS - 2)),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Sparse:
    """Features of documents in a row: places and values, and where each document's begin."""

    place: np.ndarray
    value: np.ndarray
    first: np.ndarray


def features(texts: pa.Array, n_chars: np.ndarray) -> Sparse:
    """Words and statistics of each text. Words are weighted 1 + ln(count) and scaled to length 1."""
    n = len(texts)
    found = words(texts, lower=True)
    key = (found.doc << WORD_BITS) | (found.hashes() >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    doc, place = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    weight = 1 + np.log(count)
    weight /= np.sqrt(np.bincount(doc, weight**2, n))[doc]
    extra = (1 << WORD_BITS) + BUCKETS * np.arange(STATISTICS) + statistics(texts, n_chars)
    doc = np.concatenate((doc, np.repeat(np.arange(n), STATISTICS)))
    order = np.argsort(doc, kind="stable")
    value = np.concatenate((weight, np.full(n * STATISTICS, STATISTIC_VALUE)))[order]
    first = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n))))
    return Sparse(np.concatenate((place, extra.ravel()))[order].astype(np.int32), value.astype(np.float32), first)


class FactorisationMachine:
    """Weights of a model; ``factors`` has one row per feature."""

    def __init__(self, base: np.ndarray, linear: np.ndarray, factors: np.ndarray):
        self.base, self.linear, self.factors = base, linear, factors

    @classmethod
    def new(cls, rank: int, seed: int) -> "FactorisationMachine":
        rng = np.random.Generator(np.random.PCG64(seed))
        factors = rng.normal(0, 0.05, (SIZE, rank)).astype(np.float32)
        return cls(np.zeros(1, np.float32), np.zeros(SIZE, np.float32), factors)

    def parts(self, x: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margin, v_i x_i of every feature, and their sum in every document (each has features)."""
        scaled = self.factors[x.place] * x.value[:, None]
        begin = x.first[:-1]
        total = np.add.reduceat(scaled, begin, axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", scaled, scaled), begin)
        linear = np.add.reduceat(self.linear[x.place] * x.value, begin)
        return self.base[0] + linear + 0.5 * (np.einsum("ij,ij->i", total, total) - squares), scaled, total

    def score(self, x: Sparse) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(x)[0].astype(np.float64), -30, 30)))

    def fit(self, x: Sparse, label: np.ndarray, epochs: int, rate: float, decay: float, seed: int, batch: int = 128) -> None:
        """Minimise the logistic loss in small batches with step sizes per weight."""
        rng = np.random.Generator(np.random.PCG64(seed))
        state = [np.full_like(w, 1e-2) for w in (self.base, self.linear, self.factors)]
        count = np.diff(x.first)
        for _ in range(epochs):
            order = rng.permutation(len(label))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                ends = np.cumsum(count[rows])
                at_features = np.repeat(x.first[rows] - (ends - count[rows]), count[rows]) + np.arange(ends[-1])
                own = Sparse(x.place[at_features], x.value[at_features], np.concatenate(([0], ends)))
                margin, scaled, total = self.parts(own)
                slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[rows]).astype(np.float32) / len(rows)
                each = np.repeat(slope, count[rows]) * own.value
                deep = each[:, None] * (np.repeat(total, count[rows], axis=0) - scaled)
                place, inverse = np.unique(own.place, return_inverse=True)
                sums = np.stack([np.bincount(inverse, c, len(place)) for c in (each, *deep.T)], axis=1).astype(np.float32)
                step(self.base, state[0], np.array([0]), np.array([slope.sum()]), rate)
                step(self.linear, state[1], place, sums[:, 0] + decay * self.linear[place], rate)
                step(self.factors, state[2], place, sums[:, 1:] + decay * self.factors[place], rate)

    def write(self, target: Folder) -> None:
        for name in ("base", "linear", "factors"):
            target.write(name, getattr(self, name))

    @classmethod
    def read(cls, source: Folder) -> "FactorisationMachine":
        factors = source.array("factors", np.float32).reshape(SIZE, -1)
        return cls(source.array("base", np.float32), source.array("linear", np.float32), factors)


def step(weights: np.ndarray, state: np.ndarray, place: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    state[place] += gradient**2
    weights[place] -= rate * gradient / np.sqrt(state[place])


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def lengths(column: pa.Array) -> np.ndarray:
    return np.array([-1 if x is None else x for x in column.to_pylist()], np.int64)


def labelled_features(documents: DataFrame, labels: DataFrame, fold: int, folds: int, max_labelled: int) -> DataFrame:
    """Features of labelled documents outside the fold, those of the ``max_labelled`` smallest hashed doc_ids.

    Labels of one doc_id are averaged and rounded, a half up; null labels and null doc_ids teach nothing.
    """
    known = labels.where("doc_id is not null and quality is not null").where(fold_of(F.col("doc_id"), folds) != fold)
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    known = known.join(growing(documents.select("doc_id").distinct()), "doc_id", "left_semi")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # a repeated doc_id teaches with its first row alone, so the bound is one of rows
    rows = documents.select("doc_id", "text", "n_chars").join(growing(known), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct("text", "n_chars")).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices(batch, "text"):
                x = features(own.column("text"), lengths(own.column("n_chars")))
                columns = [own.column("doc_id"), own.column("label")]
                columns += [pa.ListArray.from_arrays(x.first.astype(np.int32), pa.array(v)) for v in (x.place, x.value)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FEATURES.split(", ")])

    return rows.select("doc_id", "label", "row.text", "row.n_chars").mapInArrow(run, FEATURES)


def fitted(rows: DataFrame, folder: str, rank: int, epochs: int, rate: float, decay: float, seed: int) -> None:
    """Fit in one task on the bounded rows and write the weights to the folder; without rows all weights stay new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        model = FactorisationMachine.new(rank, seed)
        n = 0
        if held:
            table = pa.Table.from_batches(held).sort_by("doc_id").combine_chunks()
            place, value = (table.column(c).chunk(0) for c in ("place", "value"))
            first = np.concatenate(([0], np.cumsum(place.value_lengths().to_numpy())))
            x = Sparse(place.flatten().to_numpy(), value.flatten().to_numpy(), first)
            n = len(table)
            model.fit(x, table.column("label").to_numpy().astype(np.float32), epochs, rate, decay, seed)
        model.write(Folder(folder))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows.coalesce(1).mapInArrow(run, "n long").collect()  # one number


def classified(
    documents: DataFrame,
    labels: DataFrame,
    fold: int = 0,
    folds: int = 5,
    threshold: float = 0.3,
    max_labelled: int = 20_000,
    rank: int = 8,
    epochs: int = 12,
    rate: float = 0.1,
    decay: float = 1e-6,
    seed: int = 13,
) -> DataFrame:
    """Each document's quality: doc_id, held_out, score from 0 to 1, predicted (1 if the score reaches the threshold).

    Learns ``labels.quality`` from labelled documents outside the ``fold`` of ``folds``, at most ``max_labelled`` of
    them by hash of doc_id; a score depends on text and n_chars alone. Null text is empty; an empty text is scored by
    its statistics; a null n_chars is a value of its own. A null doc_id is in fold 0. Every row is scored, repeated rows
    alike. Other columns are ignored, whatever their names. A text is scored whole in one piece, with some
    hundred bytes of memory for each of its bytes in a task that holds one such text at a time. Without a usable
    label scores come from the untrained model and lie near 0.5; an empty table gives no row.
    """
    folder = new_folder(documents.sparkSession, "factorisation")
    if "n_chars" not in documents.columns:
        documents = documents.withColumn("n_chars", F.lit(None).cast("long"))
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("n_chars").cast("long").alias("n_chars"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    learned = stored(labelled_features(documents, labels, fold, folds, max_labelled), f"{folder}/features")
    fitted(learned, f"{folder}/model", rank, epochs, rate, decay, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = FactorisationMachine.read(Folder(f"{folder}/model"))
        for batch in batches:
            for own in slices(batch, "text"):
                score = model.score(features(own.column("text"), lengths(own.column("n_chars"))))
                columns = [own.column("doc_id"), own.column("held_out"), pa.array(score)]
                columns.append(pa.array((score >= threshold).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    rows = documents.withColumn("held_out", fold_of(F.col("doc_id"), folds) == fold)
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
