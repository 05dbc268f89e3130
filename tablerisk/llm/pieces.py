"""Pieces of text that are cut and numbered by Arrow and looked up in bulk.

Arrow's kernels cut the texts of a slice at spaces and number the distinct pieces; a worker keeps a table of
pieces it has met, and numpy gathers what the table holds of every piece of every text. Python touches
each piece once a slice and tokenizes it once.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tablerisk.llm.text import text_bytes
from tablerisk.llm.tokens import PieceTokenizer

#: Pieces that a worker keeps, with its JVM and other workers on one machine. Most later ones occur once.
TABLE_PIECES = 300_000
#: Bytes of text that a task cuts and looks up at once.
TOKEN_SLICE = 8 << 20
NO_IDS = np.zeros(0, np.uint32)
ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
#: Multiplication and division signs and the dotted capital I, in UTF-8.
NO_LETTERS = [0xC397, 0xC3B7, 0xC4B0]


def kept(key: tuple, make: Callable):
    """What a worker process keeps from one of its tasks to the next, one object a kind (``key[0]``).

    Functions of this package travel to workers by value, so it lives in a module made there.
    """
    module = sys.modules.setdefault("tablerisk_kept", types.ModuleType("tablerisk_kept"))
    held = module.__dict__.setdefault("tables", {})
    if held.get(key[0], (None,))[0] != key:
        held[key[0]] = (key, make())
    return held[key[0]][1]


def release() -> None:
    """Give up all tables this worker keeps, before work that needs its memory for something else."""
    getattr(sys.modules.get("tablerisk_kept"), "tables", {}).clear()


def cut(texts: pa.Array, before_lines: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces, the number of every piece of the texts in a row, and where each text begins.

    A text is cut at each space; a line feed begins a piece of its own (``before_lines``) or counts as a space.
    """
    names, place, first = numbered(texts, before_lines)
    return names.to_numpy(zero_copy_only=False).tolist(), place, first


def numbered(texts: pa.Array, before_lines: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The same as ``cut``, with the distinct pieces still in Arrow."""
    spaced = pc.replace_substring(texts, "\n", " \n" if before_lines else " ")
    lists = pc.split_pattern(spaced, " ").cast(pa.large_list(pa.large_string()))
    flat = lists.flatten().dictionary_encode()
    first = lists.offsets.to_numpy()
    return flat.dictionary, flat.indices.to_numpy().astype(np.int64), (first - first[0]).astype(np.int64)


def without_signs(pieces: pa.Array, signs: str) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Pieces without the signs they end in, which of them had any, and the signs of these.

    Signs are ASCII and come off only after a letter or digit that is ASCII or in U+00C0 to U+023F, but not after a
    dotted capital I, which ends in a mark in lower case.
    """
    raw, bounds = text_bytes(pieces)
    stems = pc.utf8_rtrim(pieces, signs)
    length = pc.binary_length(stems).to_numpy().astype(np.int64)
    ended = np.flatnonzero((length > 0) & (length < np.diff(bounds)))
    last = bounds[ended] + length[ended] - 1
    pair = raw[np.maximum(last - 1, 0)].astype(np.int64) * 256 + raw[last]  # two bytes of one character, if not ASCII
    letter = (pair >= 0xC380) & (pair < 0xC900) & (raw[last] >= 128) & ~np.isin(pair, NO_LETTERS)
    letter |= ALNUM[raw[last]]
    ended, last = ended[letter], last[letter]
    had = np.zeros(len(pieces), bool)
    had[ended] = True
    sizes = bounds[ended + 1] - last - 1
    taken = raw[spread(last + 1, sizes)]
    ends = pa.LargeStringArray.from_buffers(len(ended), pa.py_buffer(np.append(0, np.cumsum(sizes))), pa.py_buffer(taken))
    return pc.if_else(pa.array(had), stems, pieces), had, ends


def grown(data: np.ndarray, size: int) -> np.ndarray:
    """The array itself, or a copy with room for ``size`` rows."""
    if size <= len(data):
        return data
    out = np.zeros((max(size, 2 * len(data)), *data.shape[1:]), data.dtype)
    out[: len(data)] = data
    return out


class Ragged:
    """Rows of different lengths in one growing array."""

    def __init__(self, dtype):
        self.data, self.bounds, self.rows = np.zeros(1 << 12, dtype), np.zeros(1 << 10, np.int64), 0

    def append(self, flat: np.ndarray, counts: np.ndarray) -> None:
        end = int(self.bounds[self.rows])
        self.data = grown(self.data, end + len(flat))
        self.data[end : end + len(flat)] = flat
        self.bounds = grown(self.bounds, self.rows + len(counts) + 1)
        self.bounds[self.rows + 1 : self.rows + len(counts) + 1] = end + np.cumsum(counts)
        self.rows += len(counts)

    def counts(self, rows: np.ndarray) -> np.ndarray:
        return self.bounds[rows + 1] - self.bounds[rows]

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The given rows one after the other, and their lengths."""
        counts = self.counts(rows)
        return self.data[spread(self.bounds[rows], counts)], counts


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All positions of ranges given by start and length."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def woven(*columns: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ragged columns side by side: row by row, first column first; returns the flat rows and their lengths."""
    counts = sum(c for _, c in columns)
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), columns[0][0].dtype)
    for flat, own in columns:
        out[spread(starts, own)] = flat
        starts = starts + own
    return out, counts


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds."""
    run = np.concatenate((np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)))
    return run[first[1:]] - run[first[:-1]]


class PieceTable:
    """Pieces met so far and their rows; a full table is emptied before the next new pieces."""

    def __init__(self, limit: int = TABLE_PIECES):
        self.limit, self.rows = limit, {}
        self.clear()

    def clear(self) -> None:
        self.rows.clear()

    def learn(self, pieces: list[str]) -> list[str]:
        """Add rows for new pieces; returns the pieces in the order of their rows."""
        raise NotImplementedError

    def find(self, pieces: list[str]) -> np.ndarray:
        """The row of each of these distinct pieces."""
        found = list(map(self.rows.get, pieces))
        new = [p for p, r in zip(pieces, found) if r is None]
        if new:
            if self.rows and len(self.rows) + len(new) > self.limit:
                self.clear()
                new = pieces
            begin = len(self.rows)
            self.rows.update(zip(self.learn(new), range(begin, begin + len(new))))
            found = map(self.rows.__getitem__, pieces)
        return np.fromiter(found, np.int64, len(pieces))


class TokenTable(PieceTable):
    """Ids of whole texts, equal to what the tokenizer gives for them.

    A full table is not emptied: what it does not hold is tokenized for its slice and given up with the next one.
    """

    def __init__(self, path: str, keeps_space: bool, limit: int = TABLE_PIECES):
        self.tokenizer = PieceTokenizer(path, keeps_space)
        super().__init__(limit)

    def clear(self) -> None:
        super().clear()
        self.ids, self.whole = Ragged(np.uint32), np.zeros(1 << 10, bool)

    def learn(self, pieces: list[str]) -> list[str]:
        return [pieces[k] for k in self.added(pieces).tolist()]

    def added(self, pieces: list[str]) -> np.ndarray:
        """Add rows for new pieces; returns the places of the pieces in the order of their rows."""
        order, flat, counts, unsafe = self.tokenizer.pieces(pieces)
        begin = self.ids.rows
        self.ids.append(flat, counts)
        self.whole = grown(self.whole, self.ids.rows)
        self.whole[begin : self.ids.rows - unsafe] = False
        self.whole[self.ids.rows - unsafe : self.ids.rows] = True
        return order

    def find_of_slice(self, pieces: list[str], often: np.ndarray) -> np.ndarray:
        """The row of each of these distinct pieces of a slice, in which they occur ``often``; good until the next slice.

        The most frequent new pieces stay while there is room.
        """
        self.ids.rows = len(self.rows)
        found = np.fromiter(map(self.rows.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(found < 0)
        if room := self.limit - len(self.rows):
            new = new[np.argsort(-often[new], kind="stable")]
        for own in (new[:room], new[room:]):
            names = [pieces[k] for k in own.tolist()]
            begin = self.ids.rows
            found[own[self.added(names)]] = np.arange(begin, begin + len(own))
            if len(self.rows) < self.limit:
                self.rows.update(zip(names, found[own].tolist()))
        return found

    def of_slice(self, names: pa.Array, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of these distinct pieces in a row, the number of each, and whether its text must go whole."""
        stems, had, ends = without_signs(names, self.tokenizer.signs)
        stems, ends = stems.dictionary_encode(), ends.dictionary_encode()
        stem, end = (x.indices.to_numpy().astype(np.int64) for x in (stems, ends))
        words = stems.dictionary.to_numpy(zero_copy_only=False).tolist()
        row = self.find_of_slice(words, np.bincount(stem, often, len(words)))[stem]
        signs = Ragged(np.uint32)
        signs.append(NO_IDS, np.zeros(1, np.int64))
        signs.append(*ragged(self.tokenizer.whole(ends.dictionary.to_pylist())))
        sign = np.zeros(len(names), np.int64)
        sign[had] = end + 1
        return *woven(self.ids.gather(row), signs.gather(sign)), self.whole[row]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and their numbers; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n, keeps_space = len(texts), self.tokenizer.keeps_space
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        tail = np.zeros(n, bool)
        body = texts
        if keeps_space:  # a line feed at the end stands alone unless white space precedes it
            tail = pc.and_not(pc.ends_with(texts, "\n"), pc.match_substring_regex(texts, r"(^|[\s\p{Z}\x1c-\x1f\x{85}])\n\z"))
            body = pc.if_else(tail, pc.utf8_slice_codeunits(texts, 0, -1), texts)
            tail = tail.to_numpy(zero_copy_only=False)
        names, place, first = numbered(body, keeps_space)
        own, sizes, special = self.of_slice(names, np.bincount(place, minlength=len(names)))
        special = special[place]
        lead: list[np.ndarray | None] = [NO_IDS] * n
        if keeps_space:  # the first piece of a text has no space in front
            lead = self.heads(names.take(pa.array(place[first[:-1]])).to_pylist())
            special[first[:-1]] = [x is None for x in lead]
        whole = np.logical_or.reduceat(special, first[:-1])
        keep = ~np.repeat(whole, np.diff(first))
        if keeps_space:
            keep[first[:-1]] = False
        for k, ids in zip(np.flatnonzero(whole), self.tokenizer.whole(texts.filter(pa.array(whole)).to_pylist())):
            lead[k] = ids
        place = place[keep]
        counts = sizes[place]
        flat = own[spread((np.cumsum(sizes) - sizes)[place], counts)]
        held = np.concatenate(([0], np.cumsum(keep)))
        middle = row_sums(counts, held[first])
        ends = self.tokenizer.whole(["\n"])[0] if tail.any() else NO_IDS
        return woven(ragged(lead), (flat, middle), ragged([ends if t and not w else NO_IDS for t, w in zip(tail, whole)]))

    def heads(self, pieces: list[str]) -> list[np.ndarray | None]:
        """Ids of pieces without a space in front; None for one with white space in it."""
        usable = sorted({p for p in pieces if p and not any(c.isspace() for c in p)})
        found = dict(zip(usable, self.tokenizer.whole(usable)))
        return [found.get(p) if p else NO_IDS for p in pieces]


def ragged(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ids as one array and their lengths."""
    return np.concatenate([NO_IDS, *rows]), np.fromiter(map(len, rows), np.int64, len(rows))
