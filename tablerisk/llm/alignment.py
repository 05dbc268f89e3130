"""Alignment of two tokenizers' tokens of the same text by divide and conquer at shared cuts.

Both token sequences spell the same bytes, so each is a list of end offsets. An interval is divided at an offset
near its middle where tokens of both end; the end is located by bisect, and both halves are divided in turn. An interval
without such an offset inside is a group: its tokens of one side belong to its tokens of the other.

Words between spaces are divided once: both tokenizers end a token before a space that follows anything but white
space, so spaces are shared cuts and a worker keeps the groups of words it has met (``pieces.py``). Texts with other
white space than single spaces and line feeds are divided whole. Counts of linked id pairs are summed by Spark;
their sorted table lies in the shared folder and is mapped into memory.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerisk.llm.pieces import PieceTable, Ragged, cut, grown, kept, row_sums, spread
from tablerisk.llm.store import Folder, new_folder, stored
from tablerisk.llm.text import slices
from tablerisk.llm.tokens import PieceTokenizer

TABLE_WORDS = 700_000
#: A text with a longer word is divided whole.
LONG_WORD = 1000
SHARDS = 64
MERGED_PAIRS = 4_000_000
ROWS_OUT = 200_000
GROUPS = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def leaf_groups(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int, int, int]]:
    """Groups of both sequences as (first a, past a, first b, past b), in order. Both end at the same offset."""
    out, open_ = [], [(0, len(ends_a), 0, len(ends_b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        shared = common_end(ends_a, a0, a1, ends_b, b0, b1)
        if shared is None:
            out.append((a0, a1, b0, b1))
        else:
            i, j = shared
            open_.append((i, a1, j, b1))
            open_.append((a0, i, b0, j))
    return out


def common_end(ends_a: list[int], a0: int, a1: int, ends_b: list[int], b0: int, b1: int) -> tuple[int, int] | None:
    """Numbers of the tokens that begin after the shared end nearest to the middle of the interval, if it has one inside."""
    if a1 - a0 == 1 or b1 - b0 == 1:
        return None
    middle = (a0 + a1 - 2) // 2
    for away in range(a1 - a0):
        for i in (middle - away, middle + away + 1):
            if a0 <= i < a1 - 1:
                j = bisect_left(ends_b, ends_a[i], b0, b1 - 1)
                if ends_b[j] == ends_a[i]:
                    return i + 1, j + 1
    return None


def linked_pairs(groups: list[tuple[int, int, int, int]], a: list[int], b: list[int]) -> dict[int, int]:
    """How often each pair a << 16 | b of ids shares a group; equal ids of a group are counted before they are paired."""
    pairs: dict[int, int] = {}
    for a0, a1, b0, b1 in groups:
        if a1 - a0 == 1 and b1 - b0 == 1:
            key = a[a0] << 16 | b[b0]
            pairs[key] = pairs.get(key, 0) + 1
            continue
        right = Counter(b[b0:b1]).items()
        for x, m in Counter(a[a0:a1]).items():
            for y, n in right:
                key = x << 16 | y
                pairs[key] = pairs.get(key, 0) + m * n
    return pairs


def spelled(groups: list[tuple[int, int, int, int]], a: list[str], b: list[str]) -> str:
    return ";".join([f"{','.join(a[a0:a1])}|{','.join(b[b0:b1])}" for a0, a1, b0, b1 in groups])


def leaves_of_words(ends_a: np.ndarray, first_a: np.ndarray, ends_b: np.ndarray, first_b: np.ndarray) -> np.ndarray:
    """Groups (first a, past a, first b, past b), in order, of many words in a row, all divided at the same time.

    As in ``leaf_groups``: each round divides every open interval at the shared end nearest to its middle.
    """
    open_ = np.stack((first_a[:-1], first_a[1:], first_b[:-1], first_b[1:]), axis=1)
    leaves = []
    while len(open_):
        a0, a1, b0, b1 = open_.T
        shared = np.full((len(open_), 2), -1)
        searched = np.flatnonzero((a1 - a0 > 1) & (b1 - b0 > 1))
        away = 0
        while len(searched):
            middle = (a0[searched] + a1[searched] - 2) // 2
            inside = np.zeros(len(searched), bool)
            for i in (middle - away, middle + away + 1):
                usable = (i >= a0[searched]) & (i < a1[searched] - 1)
                inside |= usable
                usable &= shared[searched, 0] < 0
                own, place = searched[usable], i[usable]
                j = np.searchsorted(ends_b, ends_a[place])
                hit = ends_b[j] == ends_a[place]
                shared[own[hit]] = np.stack((place[hit] + 1, j[hit] + 1), axis=1)
            searched = searched[inside & (shared[searched, 0] < 0)]
            away += 1
        divided = shared[:, 0] >= 0
        leaves.append(open_[~divided])
        i, j = shared[divided].T
        left, right = open_[divided].copy(), open_[divided].copy()
        left[:, 1], left[:, 3] = i, j
        right[:, 0], right[:, 2] = i, j
        open_ = np.concatenate((left, right))
    found = np.concatenate(leaves) if leaves else np.zeros((0, 4), np.int64)
    return found[np.argsort(found[:, 0], kind="stable")]


class Tokenizers:
    """Ids and byte lengths of both tokenizers' tokens."""

    def __init__(self, byte_level: str, piece_model: str):
        import sentencepiece

        self.first = PieceTokenizer(byte_level, keeps_space=True)
        self.first.tokenizer.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        to_byte = byte_of_character()
        n_a, n_b = self.first.tokenizer.get_vocab_size(), self.pieces.get_piece_size()
        if max(n_a, n_b) > 1 << 16:
            raise ValueError("ids of both tokenizers must be below 65536")
        tokens = [self.first.tokenizer.id_to_token(i) or "" for i in range(n_a)]
        self.bytes_a = [bytes([to_byte[c] for c in t]) if all(c in to_byte for c in t) else t.encode() for t in tokens]
        names = [self.pieces.id_to_piece(i) for i in range(n_b)]
        self.bytes_b = [
            bytes([int(t[3:5], 16)]) if self.pieces.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)
        ]
        self.starts_word = np.array([t.startswith("▁") for t in names])
        self.length_a, self.length_b = ([len(x) for x in side] for side in (self.bytes_a, self.bytes_b))
        self.lengths = np.array(self.length_a), np.array(self.length_b)
        self.name = [str(i) for i in range(max(n_a, n_b))]
        self.spelling = [mark + i.encode() for mark in (b"", b";", b",", b"|") for i in self.name]

    def words_b(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with a space in front, and their numbers. They are encoded many at once: each begins with its only space."""
        flat, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 5000):
            own = words[at : at + 5000]
            ids = np.array(self.pieces.encode(" ".join(own), num_threads=1), np.int64)
            begins = np.flatnonzero(self.starts_word[ids])
            if len(begins) != len(own):
                each = self.pieces.encode(own, num_threads=1)
                ids = np.array([i for x in each for i in x], np.int64)
                begins = np.cumsum([0, *map(len, each[:-1])])
            size = np.diff(np.append(begins, len(ids)))
            # a word that begins with a line feed has no space in front: its lone space is dropped
            line = np.fromiter((w[0] == "\n" for w in own), bool, len(own))
            counts.append(size - line)
            flat.append(np.delete(ids, begins[line]))
        return np.concatenate(flat), np.concatenate(counts)

    def whole(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a whole text by both; empty where either does not spell a space and the text."""
        expected = b" " + text.encode()
        a = self.first.tokenizer.encode(" " + text, add_special_tokens=False).ids
        b = self.pieces.encode(text, num_threads=1)
        same = b"".join(map(self.bytes_a.__getitem__, a)) == expected == b"".join(map(self.bytes_b.__getitem__, b))
        return (a, b) if text and same else ([], [])

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
        if len(a) == 1 or len(b) == 1:
            return [(0, len(a), 0, len(b))]
        ends_a = list(accumulate(map(self.length_a.__getitem__, a)))
        return leaf_groups(ends_a, list(accumulate(map(self.length_b.__getitem__, b))))

    def spell(self, groups: list[tuple[int, int, int, int]], a: list[int], b: list[int]) -> bytes:
        name = self.name.__getitem__
        return spelled(groups, list(map(name, a)), list(map(name, b))).encode()


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


class WordTable(PieceTable):
    """Groups of words: numbers of tokens, groups and links, distinct pairs with their multiplicity, and the groups' text."""

    def __init__(self, tokenizers: Tokenizers, limit: int = TABLE_WORDS):
        self.tokenizers = tokenizers
        super().__init__(limit)

    def clear(self) -> None:
        super().clear()
        self.numbers = np.zeros((1 << 10, 4), np.int64)
        self.pairs, self.times = Ragged(np.uint32), Ragged(np.int32)
        self.text: list[bytes | None] = []
        self.valued: tuple = ()

    def learn(self, pieces: list[str]) -> list[str]:
        t, begin, end = self.tokenizers, len(self.rows), len(self.rows) + len(pieces)
        self.numbers = grown(self.numbers, end)
        self.numbers[begin:end] = 0
        short = [p for p in pieces if len(p) <= LONG_WORD]
        places, a, count_a, unsafe = t.first.pieces(short)
        usable = len(short) - unsafe
        order = [*(short[k] for k in places.tolist()), *(p for p in pieces if len(p) > LONG_WORD)]
        b, count_b = t.words_b(order[:usable])
        sizes = np.zeros(len(pieces), np.int64)
        spelled_out: list[bytes | None] = [None] * len(pieces)
        same = self.same_bytes(order[:usable], b, count_b)
        a, b = a[np.repeat(same, count_a[:usable])].astype(np.int64), b[np.repeat(same, count_b)]
        count_a, count_b, word = count_a[:usable][same], count_b[same], np.flatnonzero(same)
        first_a, first_b = (np.concatenate(([0], np.cumsum(c))) for c in (count_a, count_b))
        groups = leaves_of_words(np.cumsum(t.lengths[0][a]), first_a, np.cumsum(t.lengths[1][b]), first_b)
        a0, a1, b0, b1 = groups.T
        owner = np.searchsorted(first_a, a0, "right") - 1
        links = (a1 - a0) * (b1 - b0)
        n_links = np.bincount(owner, links, len(word)).astype(np.int64)
        self.numbers[begin + word] = np.stack((count_a, count_b, np.bincount(owner, minlength=len(word)), n_links), axis=1)
        # every pair of a group: its numbers run over the group's b ids first
        group = np.repeat(np.arange(len(groups)), links)
        inside = spread(np.zeros(len(groups), np.int64), links)
        x, y = a[a0[group] + inside // (b1 - b0)[group]], b[b0[group] + inside % (b1 - b0)[group]]
        key = np.sort(owner[group] << 32 | x << 16 | y)
        at = np.flatnonzero(np.diff(key, prepend=-1))
        sizes[word] = np.bincount(key[at] >> 32, minlength=len(word))
        self.pairs.append((key[at] & 0xFFFFFFFF).astype(np.uint32), sizes)
        self.times.append(np.diff(np.append(at, len(key))).astype(np.int32), sizes)
        # the groups' text: each a id stands after the b ids of earlier groups, each b id after the a ids of its own
        step, mark = len(t.name), np.zeros(len(a) + len(b), np.int64)
        of_a, of_b = np.repeat(np.arange(len(groups)), a1 - a0), np.repeat(np.arange(len(groups)), b1 - b0)
        mark[np.arange(len(a)) + b0[of_a]] = a + step * np.where(np.arange(len(a)) == a0[of_a], 1, 2)
        mark[np.arange(len(b)) + a1[of_b]] = b + step * np.where(np.arange(len(b)) == b0[of_b], 3, 2)
        first = first_a + first_b
        mark[first[:-1]] -= step
        parts = list(map(t.spelling.__getitem__, mark.tolist()))
        for w, s, e in zip(word.tolist(), first[:-1].tolist(), first[1:].tolist()):
            spelled_out[w] = b"".join(parts[s:e])
        self.text += spelled_out
        return order

    def same_bytes(self, words: list[str], b: np.ndarray, count_b: np.ndarray) -> np.ndarray:
        """Which words the b ids spell; all of them are compared at once, and one by one only where that fails."""
        t = self.tokenizers
        expected = [(w if w[0] == "\n" else " " + w).encode() for w in words]
        tokens = list(map(t.bytes_b.__getitem__, b.tolist()))
        ends = np.cumsum(count_b)
        length = row_sums(t.lengths[1][b], np.concatenate(([0], ends)))
        same = length == np.fromiter(map(len, expected), np.int64, len(expected))
        if not same.all() or b"".join(tokens) != b"".join(expected):
            bounds = zip((ends - count_b).tolist(), ends.tolist())
            same = np.array([b"".join(tokens[s:e]) == x for (s, e), x in zip(bounds, expected)], bool)
        return same

    def values(self, index: "PairIndex") -> np.ndarray:
        """Links of the best count and sum of counts, per word, by a table of counts."""
        folder, done, held = self.valued if self.valued and self.valued[0] == index.folder else ("", 0, np.zeros((1 << 10, 2), np.int64))
        if done < self.pairs.rows:
            rows = np.arange(done, self.pairs.rows)
            keys, sizes = self.pairs.gather(rows)
            first = np.concatenate(([0], np.cumsum(sizes)))
            count, best = index.look_up(keys)
            times = self.times.gather(rows)[0].astype(np.int64)
            held = grown(held, self.pairs.rows)
            held[done : self.pairs.rows] = np.stack((row_sums(times * best, first), row_sums(times * count, first)), axis=1)
        self.valued = index.folder, self.pairs.rows, held
        return held


class Aligned:
    """Words of the texts of a slice as rows of the table, and what the texts hold that go whole."""

    def __init__(self, table: WordTable, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        names, place, self.first = cut(texts, before_lines=True)
        row = table.find(names)
        whole = table.numbers[row, 2] == 0
        special = np.logical_or.reduceat(whole[place], self.first[:-1])
        self.row = row[place]
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.plain = ~special[self.doc]
        t = table.tokenizers
        self.whole = {}
        for k, text in zip(np.flatnonzero(special).tolist(), texts.filter(pa.array(special)).to_pylist()):
            a, b = t.whole(text)
            groups = t.groups(a, b) if a else []
            self.whole[k] = (len(a), len(b), len(groups), linked_pairs(groups, a, b), t.spell(groups, a, b))

    def pair_counts(self, table: WordTable) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of the slice and the number of documents that hold each."""
        width = np.int64(table.pairs.rows + 1)
        own = distinct(self.doc[self.plain] * width + self.row[self.plain])
        flat, sizes = table.pairs.gather(own % width)
        keys = [(flat.astype(np.uint64) << np.uint64(32)) | np.repeat(own // width, sizes).astype(np.uint64)]
        keys += [(np.array(list(x[3]), np.uint64) << np.uint64(32)) | np.uint64(k) for k, x in self.whole.items()]
        pairs = distinct(np.concatenate(keys)) >> np.uint64(32)
        at = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.zeros(0, np.int64)
        return pairs[at], np.diff(np.append(at, len(pairs)))


def distinct(values: np.ndarray) -> np.ndarray:
    """The values in order, each once."""
    values = np.sort(values)
    return values[np.concatenate((np.ones(1, bool), values[1:] != values[:-1]))[: len(values)]]


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and summed counts."""
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def word_table(byte_level: str, piece_model: str) -> WordTable:
    key = ("alignment", byte_level, piece_model)
    return kept(key, lambda: WordTable(Tokenizers(byte_level, piece_model)))


def pair_counts(documents: DataFrame, byte_level: str, piece_model: str) -> DataFrame:
    """pair, n: how many documents hold each linked pair of ids; a task adds its own up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, parts, size = None, [], 0
        for batch in batches:
            for own in slices(batch, "text"):
                table = table or word_table(byte_level, piece_model)
                parts.append(Aligned(table, own.column("text")).pair_counts(table))
                size += len(parts[-1][0])
                if size > MERGED_PAIRS:
                    parts = [added(parts)]
                    size = len(parts[0][0])
                    if 2 * size > MERGED_PAIRS:
                        yield from rows_out(*parts[0])
                        parts, size = [], 0
        if parts:
            yield from rows_out(*added(parts))

    return documents.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def rows_out(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), ROWS_OUT):
        columns = [pa.array(x[at : at + ROWS_OUT].astype(np.int64)) for x in (keys, counts)]
        yield pa.RecordBatch.from_arrays(columns, ["pair", "n"])


def shard_of(pairs: np.ndarray) -> np.ndarray:
    """Shards are equal ranges of the first id, so all pairs of an id lie in one."""
    return pairs.astype(np.int64) >> 16 >> 10


def write_pairs(counts: DataFrame, folder: str) -> None:
    """Sorted pairs, counts and marks of an id's highest count, a file each and shard."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pair")
        pairs, n = pdf["pair"].to_numpy(), pdf["n"].to_numpy()
        begin = np.flatnonzero(np.diff(pairs >> 16, prepend=-1))
        highest = np.repeat(np.maximum.reduceat(n, begin), np.diff(np.append(begin, len(pairs))))
        s, target = int(shard_of(pairs[:1])[0]), Folder(folder)
        for name, data in (("pairs", pairs.astype(np.uint32)), ("counts", n), ("best", (n == highest).astype(np.uint8))):
            target.write(f"{name}-{s:02d}", data)
        return pd.DataFrame({"shard": [s]})

    shard = F.shiftright("pair", 26).cast("int")
    made = counts.withColumn("shard", shard).groupBy("shard").applyInPandas(run, "shard int").collect()  # <= SHARDS rows
    for s in set(range(SHARDS)) - {r["shard"] for r in made}:
        for name in ("pairs", "counts", "best"):
            Folder(folder).write(f"{name}-{s:02d}", b"")


class PairIndex:
    """Counts of pairs, mapped into memory shard by shard as they are needed."""

    def __init__(self, folder: str):
        self.folder, self.source, self.held = folder, Folder(folder), {}

    def shard(self, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if s not in self.held:
            kinds = (("pairs", np.uint32), ("counts", np.int64), ("best", np.uint8))
            self.held[s] = tuple(self.source.array(f"{name}-{s:02d}", dtype) for name, dtype in kinds)
        return self.held[s]

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each pair, and whether it is the highest of its first id; 0 for one that no document holds.

        A worker's words may come from other tables, or from texts that go whole.
        """
        distinct, inverse = np.unique(keys, return_inverse=True)
        count, best = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        shard = shard_of(distinct)
        bounds = np.searchsorted(shard, np.arange(SHARDS + 1))
        for s in np.unique(shard).tolist():
            a, b = bounds[s], bounds[s + 1]
            pairs, n, top = self.shard(s)
            at = np.searchsorted(pairs, distinct[a:b])
            met = np.flatnonzero(pairs[np.minimum(at, len(pairs) - 1)] == distinct[a:b]) if len(pairs) else []
            count[a:b][met], best[a:b][met] = n[at[met]], top[at[met]]
        return count[inverse], best[inverse]


def aligned_documents(documents: DataFrame, byte_level: str, piece_model: str, with_groups: bool = False) -> DataFrame:
    """Per document: numbers of tokens, groups and links, how well the links agree with the corpus, and its groups' hash.

    Tokens of ``byte_level`` (a, of a space and the text) and of ``piece_model`` (b, which adds the space itself) share a
    group if no offset between them ends tokens of both; each a-b pair of occurrences in a group is a link. ``n_best`` links
    are pairs of ids that as many documents hold as any pair of their a id. ``groups_sha256`` hashes the groups as
    ``a1,a2|b1;a3|b2,b3``; ``with_groups`` adds that text as ``groups``.

    Null and empty texts, and texts that a tokenizer doesn't spell byte for byte, have zeros and an empty hash. Rows that
    repeat a doc_id or a text, and rows with a null doc_id, are documents of their own. Other columns are ignored. A text
    is held whole by one task. An empty table gives no row.
    """
    folder = new_folder(documents.sparkSession, "alignment")
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = stored(pair_counts(documents, byte_level, piece_model), f"{folder}/counts")
    write_pairs(counts, f"{folder}/pairs")
    schema = GROUPS + (", groups string" if with_groups else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, index = None, PairIndex(f"{folder}/pairs")
        for batch in batches:
            for own in slices(batch, "text"):
                table = table or word_table(byte_level, piece_model)
                found = Aligned(table, own.column("text"))
                both = np.concatenate((table.numbers[found.row], table.values(index)[found.row]), axis=1)
                both[~found.plain] = 0
                sums = np.stack([row_sums(c, found.first) for c in both.T], axis=1)
                texts, row, text = [], found.row.tolist(), table.text
                for k, (a, b) in enumerate(zip(found.first.tolist(), found.first[1:].tolist())):
                    texts.append(found.whole[k][4] if k in found.whole else b";".join([text[r] for r in row[a:b]]))
                for k, (n_a, n_b, n_groups, pairs, _) in found.whole.items():
                    count, best = index.look_up(np.array(list(pairs), np.uint32))
                    times = np.array(list(pairs.values()), np.int64)
                    sums[k] = n_a, n_b, n_groups, times.sum(), (times * best).sum(), (times * count).sum()
                hashes = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
                columns = [own.column("doc_id"), *(pa.array(c) for c in sums.T), pa.array(hashes, pa.string())]
                columns += [pa.array([t.decode() for t in texts], pa.string())] if with_groups else []
                yield pa.RecordBatch.from_arrays(columns, names)

    return documents.mapInArrow(run, schema)
