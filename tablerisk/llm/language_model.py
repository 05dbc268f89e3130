"""Trigram language model in an Elias-Fano trie, counted by Spark and queried from mapped files.

Level 1 maps word hashes to ids and keeps counts; level 2 holds the words after each word, level 3
the words after each pair. Every
level is counted over all training documents once the level above it is written, because its contexts
are positions there. Levels lie in shards of contexts in the shared folder; tasks map them into
memory, so a task's own memory does not grow with the model. A task looks up the distinct n-grams of
a slice in order, and sends a trigram together with the score of its last two words, so that a
shard is built without further look-ups.

Probabilities are interpolated with absolute discounting; logarithms are stored in steps of 1/4096.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerisk.llm.eliasfano import EliasFano, Level
from tablerisk.llm.hashindex import added, hash_shard, squeezed, unsqueezed
from tablerisk.llm.store import Folder, new_folder, stored
from tablerisk.llm.text import signed, slices, words

END = np.uint64(0xE7D0F7E11A5C0DE5)
STEPS = 4096.0
FLUSH = 2_000_000
SLICE = 4 << 20
CHILD_BITS = np.uint64(40)  # of a word in a key; a shard's contexts have the 24 bits above


def coded(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEPS), 0, 65535).astype(np.uint16)


def decoded(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) / -STEPS


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text, and the bounds of the texts."""
    found = words(column, lower=True)
    hashes = np.insert(found.hashes(), found.first[1:], END)
    return hashes, found.first + np.arange(len(found.first))


def held_out(doc_ids: list, fold: int, folds: int) -> np.ndarray:
    """Whether crc32 of the doc_id as text falls in the fold; a null doc_id counts as empty text."""
    return np.array([zlib.crc32(b"" if d is None else str(d).encode()) % folds == fold for d in doc_ids], bool)


@dataclass
class Sizes:
    """What of the model every task must know; a few numbers per shard."""

    folder: str
    total: int
    words: int
    discount: float
    shards: int
    first: list[list[int]]  # by level: the number of the first entry of each shard, then the total
    contexts: int = 0
    train_total: int = 0
    train_words: int = 0

    def of(self, level: int, number: np.ndarray) -> np.ndarray:
        """Shard of an entry of a level."""
        return np.searchsorted(np.array(self.first[level][1:]), number, "right")


class Trie:
    """The levels written so far; shards are opened on first use."""

    def __init__(self, sizes: Sizes):
        self.sizes = sizes
        self.source = Folder(sizes.folder)
        self.opened: dict[tuple[int, int], object] = {}
        self.first = [np.array(x, np.int64) for x in sizes.first]

    def shard(self, level: int, s: int):
        key = (level, s)
        if key not in self.opened:
            load = self.source.arrays(f"level{level}-{s:05d}")
            kind = Level if level > 1 else EliasFano
            self.opened[key] = kind(load, "entries")
            if level == 1:
                self.opened[key].counts = load("counts", np.int64)
        return self.opened[key]

    def by_shard(self, shard: np.ndarray, query: Callable[[int, np.ndarray | slice], np.ndarray], out: np.ndarray) -> np.ndarray:
        """Answer queries shard by shard; ``query`` gets a shard and the places that ask it."""
        if not len(shard):
            return out
        order = None if (shard[1:] >= shard[:-1]).all() else np.argsort(shard, kind="stable")
        ranked = shard if order is None else shard[order]
        heads = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        for s, a, b in zip(ranked[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(shard)]):
            places = slice(a, b) if order is None else order[a:b]
            out[places] = query(s, places)
        return out

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids, -1 for words that training did not meet."""

        def query(s: int, places: np.ndarray) -> np.ndarray:
            found = self.shard(1, s).find(hashes[places])
            return np.where(found >= 0, found + self.first[0][s], -1)

        shard = hash_shard(hashes, self.sizes.shards)
        return self.by_shard(shard, query, np.full(len(hashes), -1, np.int64))

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of known words."""
        query = lambda s, places: self.shard(1, s).counts[ids[places] - self.first[0][s]]
        return self.by_shard(self.sizes.of(0, ids), query, np.zeros(len(ids), np.int64))

    def context_shard(self, level: int, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard of each context of a level and the context's number there."""
        bounds = context_bounds(self.sizes.words if level == 2 else self.sizes.contexts, self.sizes.shards)
        shard = np.searchsorted(bounds[1:], context, "right")
        return shard, context - bounds[shard]

    def find(self, level: int, context: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each (context, child), -1 where there is none or either is -1, and its coded log10 probability."""
        asked = np.flatnonzero((context >= 0) & (child >= 0))
        shard, local = self.context_shard(level, context[asked])
        child = child[asked]

        def query(s: int, places: np.ndarray | slice) -> np.ndarray:
            held = self.shard(level, s)
            found = held.find(local[places], child[places])
            met = np.flatnonzero(found >= 0)
            at = found[met]
            answer = np.full((len(found), 2), -1, np.int64)
            answer[met, 0], answer[met, 1] = at + self.first[level - 1][s], held.score[at]
            return answer

        answers = self.by_shard(shard, query, np.full((len(asked), 2), -1, np.int64))
        out, code = np.full(len(context), -1, np.int64), np.zeros(len(context), np.uint16)
        out[asked], code[asked] = answers[:, 0], answers[:, 1].astype(np.uint16)
        return out, code

    def backs(self, level: int, context: np.ndarray) -> np.ndarray:
        """Log10 weight with which a context of a level hands on to the shorter one; 0 for unknown ones."""
        out = np.zeros(len(context))
        asked = np.flatnonzero(context >= 0)
        shard, local = self.context_shard(level, context[asked])
        query = lambda s, places: decoded(self.shard(level, s).back[local[places]])
        out[asked] = self.by_shard(shard, query, np.zeros(len(asked)))
        return out

    def base(self, ids: np.ndarray) -> np.ndarray:
        """Log10 unigram probability; -1 is an unknown word."""
        size = self.sizes
        lost = size.discount * size.words / size.total / (size.words + 1)
        p = np.full(len(ids), lost)
        known = np.flatnonzero(ids >= 0)
        distinct, at = np.unique(ids[known], return_inverse=True)
        p[known] += (self.counts(distinct)[at] - size.discount) / size.total
        return np.log10(p)


@dataclass
class Distinct:
    """The distinct ones of an array of keys, ascending; ``order`` sorts the array, where key k begins at ``head[k]``."""

    key: np.ndarray
    order: np.ndarray
    head: np.ndarray

    @staticmethod
    def of(key: np.ndarray, bits: int) -> Distinct:
        """Keys have at most ``bits`` bits. Places ride behind them if there is room: values sort faster than places."""
        n = len(key)
        room = n.bit_length()
        if bits + room < 64:
            ridden = np.sort((key << room) | np.arange(n))
            key, order = ridden >> room, ridden & ((1 << room) - 1)
        else:
            order = np.argsort(key)
            key = key[order]
        head = np.flatnonzero(np.concatenate((np.ones(min(n, 1), bool), key[1:] != key[:-1])))
        return Distinct(key[head], order, head)

    def inverse(self) -> np.ndarray:
        """The index of each element's key among the distinct ones."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.repeat(np.arange(len(self.head)), np.diff(self.head, append=len(out)))
        return out


@dataclass
class Grams:
    """The distinct words, pairs and triples of a slice of texts and where they occur.

    Words are numbered in the order of their hashes, pairs and triples in the order of their words, so
    that look-ups walk through the levels from front to back.
    """

    word: np.ndarray  # hashes
    token: np.ndarray  # word of each token
    bits: int  # of a word's number
    pair: np.ndarray  # first word << bits | second word
    pair_place: np.ndarray  # tokens that have a next one in their text
    pair_at: np.ndarray  # pair that begins there

    @staticmethod
    def of(hashes: np.ndarray, bounds: np.ndarray) -> Grams:
        met, word = pd.factorize(hashes)
        order = np.argsort(word)
        rank = np.empty(len(word), np.int64)
        rank[order] = np.arange(len(word))
        token, bits = rank[met], len(word).bit_length()
        inside = np.ones(len(token), bool)
        inside[bounds[1:] - 1] = False
        place = np.flatnonzero(inside)
        pairs = Distinct.of((token[place] << bits) | token[place + 1], 2 * bits)
        return Grams(word[order], token, bits, pairs.key, place, pairs.inverse())

    def first(self) -> np.ndarray:
        return self.pair >> self.bits

    def second(self) -> np.ndarray:
        return self.pair & ((1 << self.bits) - 1)

    def triples(self) -> tuple[np.ndarray, Distinct, np.ndarray]:
        """The index of each run of three tokens among the pair places, the distinct ones, and the pair of each run's last two."""
        follows = np.flatnonzero(self.pair_place[1:] == self.pair_place[:-1] + 1)
        key = (self.pair_at[follows] << self.bits) | self.token[self.pair_place[follows] + 2]
        return follows, Distinct.of(key, len(self.pair).bit_length() + self.bits), self.pair_at[follows + 1]

    def pair_of(self, triples: Distinct) -> np.ndarray:
        return triples.key >> self.bits

    def third(self, triples: Distinct) -> np.ndarray:
        return triples.key & ((1 << self.bits) - 1)


def context_bounds(contexts: int, shards: int) -> np.ndarray:
    return np.arange(shards + 1, dtype=np.int64) * contexts // shards


def training(batches: Iterator[pa.RecordBatch], fold: int, folds: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            yield part.filter(pa.array(~held_out(part.column("doc").to_pylist(), fold, folds)))


def word_counts(docs: DataFrame, fold: int, folds: int) -> DataFrame:
    """(word, n) over all training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for part in training(batches, fold, folds):
            k, n = np.unique(tokens(part.column("text"))[0], return_counts=True)
            keys.append(k)
            counts.append(n)
            if sum(map(len, keys)) > FLUSH:
                k, n = added(keys, counts)
                yield pa.RecordBatch.from_arrays([pa.array(signed(k)), pa.array(n)], ["word", "n"])
                keys, counts = [], []
        k, n = added(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array(signed(k)), pa.array(n)], ["word", "n"])

    return docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def write_words(counts: DataFrame, sizes: Sizes) -> list[int]:
    """Write level 1; returns the number of words of each shard."""
    shards, folder = sizes.shards, sizes.folder

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        word, n = pdf["word"].to_numpy().view(np.uint64), pdf["n"].to_numpy()
        order = np.argsort(word)
        s, arrays = int(pdf["shard"].iloc[0]), {}
        EliasFano.write(word[order], arrays.__setitem__, "entries")
        arrays["counts"] = n[order].astype(np.int64)
        Folder(folder).write_arrays(f"level1-{s:05d}", arrays)
        return pd.DataFrame({"shard": [s], "entries": [len(word)]})

    top = F.shiftrightunsigned("word", 32)
    placed = counts.withColumn("shard", F.shiftrightunsigned(top * F.lit(shards).cast("long"), 32).cast("int"))
    return entries(placed.groupBy("shard").applyInPandas(run, "shard int, entries long"), sizes, empty_words)


def entries(written: DataFrame, sizes: Sizes, write_empty: Callable[[Sizes, int], None]) -> list[int]:
    """Running number of entries over the shards, one row each; shards that got nothing are written empty."""
    found = {r["shard"]: r["entries"] for r in written.collect()}
    for s in set(range(sizes.shards)) - found.keys():
        write_empty(sizes, s)
    return np.cumsum([0] + [found.get(s, 0) for s in range(sizes.shards)]).tolist()


def empty_words(sizes: Sizes, s: int) -> None:
    arrays = {"counts": np.zeros(0, np.int64)}
    EliasFano.write(np.zeros(0, np.uint64), arrays.__setitem__, "entries")
    Folder(sizes.folder).write_arrays(f"level1-{s:05d}", arrays)


def empty_level(level: int) -> Callable[[Sizes, int], None]:
    def write(sizes: Sizes, s: int) -> None:
        bounds = context_bounds(sizes.words if level == 2 else sizes.contexts, sizes.shards)
        contexts = int(bounds[s + 1] - bounds[s])
        arrays = {"entries.score": np.zeros(0, np.uint16), "entries.back": np.zeros(contexts, np.uint16)}
        Level.write(np.zeros(0, np.int64), np.zeros(0, np.int64), contexts, arrays.__setitem__, "entries")
        Folder(sizes.folder).write_arrays(f"level{level}-{s:05d}", arrays)

    return write


def gram_blobs(docs: DataFrame, sizes: Sizes, level: int, fold: int, folds: int) -> DataFrame:
    """(shard, keys, counts, lower): distinct n-grams of a level of all training texts, added up per task.

    ``lower`` is the coded score of each trigram's last two words, empty for level 2.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(sizes)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for part in training(batches, fold, folds):
            grams = Grams.of(*tokens(part.column("text")))
            ids = trie.ids(grams.word)
            first, second = ids[grams.first()], ids[grams.second()]
            if level == 2:
                held.append((first, second, np.bincount(grams.pair_at, minlength=len(first)), np.zeros(len(first), np.uint16)))
            else:
                entry, lower = trie.find(2, first, second)
                _, triples, last = grams.triples()
                n = np.diff(triples.head, append=len(last))
                held.append((entry[grams.pair_of(triples)], ids[grams.third(triples)], n, lower[last[triples.order[triples.head]]]))
            size += len(held[-1][0])
            if size > FLUSH:
                yield blobs(trie, level, held)
                held, size = [], 0
        if size:
            yield blobs(trie, level, held)

    return docs.mapInArrow(run, "shard int, keys binary, counts binary, lower binary")


def merged(key: np.ndarray, n: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their summed counts, and the lower code, which equal keys share."""
    order = np.argsort(key)
    key = key[order]
    heads = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    return key[heads], np.add.reduceat(n[order].astype(np.int64), heads) if len(key) else n, lower[order[heads]]


def blobs(trie: Trie, level: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    context, child, n, lower = (np.concatenate(x) for x in zip(*held))
    shard, local = trie.context_shard(level, context)
    key = (local.astype(np.uint64) << CHILD_BITS) | child.astype(np.uint64)
    order = np.argsort(shard, kind="stable")
    found, at = np.unique(shard[order], return_index=True)
    rows = []
    for s, places in zip(found.tolist(), np.split(order, at[1:])):
        own, count, code = merged(key[places], n[places], lower[places])
        rows.append((s, squeezed(own), zstandard.compress(count, 1), zstandard.compress(code, 1)))
    columns = list(zip(*rows)) or [[]] * 4
    types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["shard", "keys", "counts", "lower"])


def write_level(docs: DataFrame, sizes: Sizes, level: int, fold: int, folds: int) -> list[int]:
    """Count and write level 2 or 3; returns the running number of entries."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        trie, s = Trie(sizes), int(pdf["shard"].iloc[0])
        plain = lambda column, kind: np.concatenate([np.frombuffer(zstandard.decompress(c), kind) for c in pdf[column]])
        keys = np.concatenate([unsqueezed(k) for k in pdf["keys"]])
        key, n, code = merged(keys, plain("counts", np.int64), plain("lower", np.uint16))
        context = (key >> CHILD_BITS).astype(np.int64)
        child = (key & np.uint64((1 << int(CHILD_BITS)) - 1)).astype(np.int64)
        bounds = context_bounds(sizes.words if level == 2 else sizes.contexts, sizes.shards)
        contexts = int(bounds[s + 1] - bounds[s])
        arrays: dict[str, np.ndarray] = {}
        degree = Level.write(context, child, contexts, arrays.__setitem__, "entries")
        total = np.maximum(np.bincount(context, n, contexts), 1)
        back = sizes.discount * degree / total
        lower = trie.base(child) if level == 2 else decoded(code)
        p = (n - sizes.discount) / total[context] + back[context] * 10.0**lower
        arrays["entries.score"] = coded(np.log10(p))
        arrays["entries.back"] = np.where(degree > 0, coded(np.log10(np.where(degree > 0, back, 1))), 0).astype(np.uint16)
        Folder(sizes.folder).write_arrays(f"level{level}-{s:05d}", arrays)
        return pd.DataFrame({"shard": [s], "entries": [len(key)]})

    written = gram_blobs(docs, sizes, level, fold, folds).groupBy("shard").applyInPandas(run, "shard int, entries long")
    return entries(written, sizes, empty_level(level))


SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def score_documents(docs: DataFrame, sizes: Sizes, fold: int, folds: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(sizes)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                hashes, bounds = tokens(part.column("text"))
                grams = Grams.of(hashes, bounds)
                ids = trie.ids(grams.word)
                met = ids >= 0
                count = np.zeros(len(ids), np.int64)
                count[met] = trie.counts(ids[met])
                base = np.log10((count + 1) / (sizes.train_total + sizes.train_words + 1))[grams.token]
                known = met[grams.token]
                logs = model_logs(trie, grams, ids)
                add = lambda x: np.add.reduceat(x, bounds[:-1]) if len(x) else x  # noqa: B023, E731
                docs_ = part.column("doc")
                columns = [docs_, pa.array(held_out(docs_.to_pylist(), fold, folds)), pa.array(np.diff(bounds))]
                columns += [pa.array(add(known.astype(np.int64))), pa.array(np.full(len(part), sizes.train_total, np.int64))]
                columns += [pa.array(add(base)), pa.array(add(logs))]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORES.split(", ")])

    return docs.mapInArrow(run, SCORES)


def model_logs(trie: Trie, grams: Grams, ids: np.ndarray) -> np.ndarray:
    """Log10 probability of each token given up to two tokens before it."""
    single = trie.base(ids)
    first, second = grams.first(), grams.second()
    entry, code = trie.find(2, ids[first], ids[second])
    pair = scored(trie, 2, entry, code, ids[first], single[second])
    follows, triples, last = grams.triples()
    context = entry[grams.pair_of(triples)]
    lower = pair[last[triples.order[triples.head]]]
    triple = scored(trie, 3, *trie.find(3, context, ids[grams.third(triples)]), context, lower)
    logs = single[grams.token]
    logs[grams.pair_place + 1] = pair[grams.pair_at]
    logs[grams.pair_place[follows[triples.order]] + 2] = np.repeat(triple, np.diff(triples.head, append=len(follows)))
    return logs


def scored(trie: Trie, level: int, entry: np.ndarray, code: np.ndarray, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Log10 probability of n-grams: their own, or the shorter one's with the context's weight."""
    out, lost = decoded(code), np.flatnonzero(entry < 0)
    out[lost] = trie.backs(level, context[lost]) + lower[lost]
    return out


def language_model_scores(
    documents: DataFrame, fold: int = 2, folds: int = 7, discount: float = 0.75, tokens_per_shard: int = 3_000_000
) -> DataFrame:
    """Score every document with a model learned from those outside the fold.

    Null text is empty and has the end token alone. Rows that repeat a doc_id count and score each on
    its own, a null doc_id as empty text; other columns are ignored. A very long text is scored in one piece, in memory
    proportional to its length. Equal n-grams are looked up once a slice. Without any training document nothing is known and
    scores are those of an empty model. An empty table gives no row. ``tokens_per_shard`` sets the
    size of a build task, not what is counted.
    """
    if not 0 < tokens_per_shard < 1 << 24:
        raise ValueError("tokens_per_shard must be positive and below 2^24")
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc"), "text")
    folder = new_folder(spark, "language-model")
    counts = stored(word_counts(docs, fold, folds), f"{folder}-words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shards = 1 + total // tokens_per_shard
    sizes = Sizes(folder, max(total, 1), max(distinct, 1), discount, shards, [])
    sizes.first.append(write_words(counts, sizes))
    sizes.first.append(write_level(docs, sizes, 2, fold, folds))
    sizes.contexts = sizes.first[1][-1]
    sizes.first.append(write_level(docs, sizes, 3, fold, folds))
    sizes.train_total, sizes.train_words = total, distinct
    return score_documents(docs, sizes, fold, folds)
