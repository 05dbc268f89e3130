"""Elias-Fano sequences over numpy arrays, and trie levels made of them.

A monotone sequence is kept as packed low bits and a unary vector of high bits, a little over two bits
more per element than its low bits. All operations take arrays of queries, so that tasks that look
up millions of n-grams do it without a Python loop per query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

ONE, FULL = np.uint64(1), np.uint64(64)
SAMPLE = 16
Store = Callable[[str, np.ndarray], None]
Load = Callable[[str, object], np.ndarray]


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of ``bits`` bits back to back in 64-bit words."""
    n = len(values)
    out = np.zeros((n * bits + 63) // 64 + 2, np.uint64)
    if n == 0 or bits == 0:
        return out
    at = np.arange(n, dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out[word[heads]] = np.bitwise_or.reduceat(values << shift, heads)
    over = np.flatnonzero(shift.astype(np.int64) + bits > 64)
    out[word[over] + 1] |= values[over] >> (FULL - shift[over])
    return out


def unpack(words: np.ndarray, index: np.ndarray, bits: int) -> np.ndarray:
    """The packed values at ``index``."""
    if bits == 0:
        return np.zeros(len(index), np.uint64)
    at = index * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    low = words[word] >> shift
    high = (words[word + 1] << ONE) << (np.uint64(63) - shift)
    return (low | high) & np.uint64((1 << bits) - 1)


OCTETS, TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def bit_places() -> np.ndarray:
    """Place of the n-th set bit of every byte, at n * 256 + byte."""
    table = np.zeros((8, 256), np.uint8)
    for byte in range(256):
        for n, place in enumerate(k for k in range(8) if byte >> k & 1):
            table[n, byte] = place
    return table.ravel()


BIT_PLACES = bit_places()


def nth_one(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Place of the n-th set bit of each word, from 0."""
    n = n.astype(np.uint64)
    pairs = word - ((word >> ONE) & np.uint64(0x5555555555555555))
    fours = (pairs & np.uint64(0x3333333333333333)) + ((pairs >> np.uint64(2)) & np.uint64(0x3333333333333333))
    upto = ((fours + (fours >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * OCTETS  # set bits up to each octet
    octet = np.bitwise_count(((n * OCTETS) | TOPS) - upto & TOPS).astype(np.uint64)
    shift = octet << np.uint64(3)
    rest = n - (((upto << np.uint64(8)) >> shift) & np.uint64(255))
    byte = (word >> shift) & np.uint64(255)
    return (shift + BIT_PLACES[(rest << np.uint64(8)) | byte]).astype(np.int64)


class EliasFano:
    """A strictly or weakly ascending sequence of non-negative integers.

    The place of every 16th one and of every 16th zero of the high bits is stored; a search goes on from there, through
    256 bits at most. Where 16 of them take more, all their places are stored, which costs no more than two bits a bit.
    """

    def __init__(self, load: Load, name: str):
        self.n, self.bits, self.buckets, self.top = (int(x) for x in load(f"{name}.head", np.int64))
        kind = np.uint64 if self.top > 31 else np.uint32
        self.low, self.high = load(f"{name}.low", np.uint64), load(f"{name}.high", np.uint64)
        self.jump = (load(f"{name}.jump0", kind), load(f"{name}.jump1", kind))
        self.spread = (load(f"{name}.spread0", kind), load(f"{name}.spread1", kind))

    @staticmethod
    def write(values: np.ndarray, store: Store, name: str) -> None:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        upper = (values >> np.uint64(bits)).astype(np.int64)
        buckets = (int(upper[-1]) if n else 0) + 1
        flags = np.zeros((n + buckets + 63) // 64 * 64 + 128, bool)
        flags[upper + np.arange(n)] = True
        mark = 31 if len(flags) < 1 << 31 else 63
        store(f"{name}.head", np.array([n, bits, buckets, mark], np.int64))
        store(f"{name}.low", pack(values & np.uint64((1 << bits) - 1), bits))
        store(f"{name}.high", np.packbits(flags, bitorder="little").view(np.uint64))
        for one, places in enumerate((np.flatnonzero(~flags), np.flatnonzero(flags))):
            jump, spread = samples(places, len(flags), mark)
            store(f"{name}.jump{one}", jump)
            store(f"{name}.spread{one}", spread)

    def window(self, place: np.ndarray) -> np.ndarray:
        """The 64 high bits from each place on."""
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        return (self.high[word] >> shift) | ((self.high[word + 1] << ONE) << (np.uint64(63) - shift))

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Bit position of the k-th one (or zero) of the high bits."""
        start, rest = self.jump[one][k // SAMPLE].astype(np.int64), k % SAMPLE
        spread = np.flatnonzero(start >> self.top)
        if not len(spread):
            return self.onward(start, rest, one)
        row = (start[spread] & ((1 << self.top) - 1)) * SAMPLE
        out = np.empty(len(k), np.int64)
        out[spread] = self.spread[one][row + rest[spread]]
        near = np.flatnonzero(start >> self.top == 0)
        out[near] = self.onward(start[near], rest[near], one)
        return out

    def onward(self, start: np.ndarray, rest: np.ndarray, one: bool) -> np.ndarray:
        """Position of the one (or zero) with number ``rest`` of those from ``start`` on, which is not far."""
        bits = self.window(start) if one else ~self.window(start)
        held = np.bitwise_count(bits)
        far = np.flatnonzero(held <= rest)
        if not len(far):
            return start + nth_one(bits, rest)
        near = rest.copy()
        near[far] = 0
        out = start + nth_one(bits, near)
        out[far] = self.onward(start[far] + 64, rest[far] - held[far], one)
        return out

    def value(self, index: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The values at ``index``, whose ones stand at ``place``."""
        return ((place - index).astype(np.uint64) << np.uint64(self.bits)) | unpack(self.low, index, self.bits)

    def access(self, index: np.ndarray) -> np.ndarray:
        """The values at ``index``."""
        return self.value(index, self.select(index, True))

    def with_next(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at ``index`` and behind it; the next one mostly lies in the bits behind the first."""
        place = self.select(index, True)
        bits = self.window(place + 1)
        after = place + 1 + np.bitwise_count(~bits & (bits - ONE))
        far = np.flatnonzero(bits == 0)
        after[far] = self.select(index[far] + 1, True)
        return self.value(index, place), self.value(index + 1, after)

    def find(self, value: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where the sequence does not hold it: a successor search in its bucket."""
        out = np.full(len(value), -1, np.int64)
        bucket = value >> np.uint64(self.bits)
        own = np.flatnonzero(bucket < np.uint64(self.buckets))
        if self.n == 0 or not len(own):
            return out
        bucket = bucket[own].astype(np.int64)
        # The bucket begins behind the zero before it.
        at = np.where(bucket > 0, self.select(np.maximum(bucket - 1, 0), False) + 1, 0)
        out[own] = self.search(value[own], bucket, at, False)
        return out

    def find_behind(self, value: np.ndarray, index: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Like ``find`` in a strict sequence, for values above the one at ``index``, which stands at ``place`` (both -1: above none)."""
        out = np.full(len(value), -1, np.int64)
        bucket = value >> np.uint64(self.bits)
        own = np.flatnonzero(bucket < np.uint64(self.buckets))
        if self.n == 0 or not len(own):
            return out
        bucket, at = bucket[own].astype(np.int64), place[own] + 1
        # As many zeros behind the place lead to the bucket; without any it has begun before.
        zeros = bucket - (at - 1 - index[own])
        ahead = np.flatnonzero(zeros > 0)
        bits, rest = ~self.window(at[ahead]), zeros[ahead] - 1
        near = np.bitwise_count(bits) > rest
        close, far = ahead[near], ahead[~near]
        at[close] += nth_one(bits[near], rest[near]) + 1
        at[far] = self.select(bucket[far] - 1, False) + 1
        out[own] = self.search(value[own], bucket, at, True)
        return out

    def search(self, value: np.ndarray, bucket: np.ndarray, at: np.ndarray, strict: bool) -> np.ndarray:
        """First index of each value in the run of ones from ``at`` on, which belongs to its bucket, or -1."""
        out = np.full(len(value), -1, np.int64)
        window = self.window(at)
        size = np.bitwise_count(window & ~(window + ONE))
        open_ = np.flatnonzero(size)
        size, left, low = size[open_].astype(np.int64), (at - bucket)[open_], value[open_] & np.uint64((1 << self.bits) - 1)
        long = np.flatnonzero(size == 64)
        if len(long):
            size[long] = self.select(bucket[open_[long]], False) - at[open_[long]]
        right = left + size
        large = np.flatnonzero(size > SAMPLE)
        if len(large):
            left[large], right[large] = self.narrowed(left[large], right[large], low[large])
            on = np.flatnonzero(left < right)
            open_, left, right, low = open_[on], left[on], right[on], low[on]
        while len(open_):
            middle = (left + right - 1) >> 1
            met = unpack(self.low, middle, self.bits)
            same = np.flatnonzero(met == low)
            out[open_[same]] = middle[same]
            less = met < low
            left, right = np.where(less, middle + 1, left), np.where(less, right, middle)
            if strict:
                right[same] = left[same]
            on = np.flatnonzero(left < right)
            open_, left, right, low = open_[on], left[on], right[on], low[on]
        return out

    def narrowed(self, left: np.ndarray, right: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smaller ranges of full buckets that hold the same first places of the low bits, which mostly lie evenly."""
        below, above = np.zeros(len(low)), np.full(len(low), float(1 << self.bits))
        for _ in range(2):
            size = right - left
            guess = left + (size * ((low - below) / np.maximum(above - below, 1))).astype(np.int64)
            reach = np.sqrt(size).astype(np.int64) + 1
            for middle in (guess - reach, guess + reach):
                probe = np.flatnonzero((middle >= left) & (middle < right))
                at = middle[probe]
                met = unpack(self.low, at, self.bits)
                less = met < low[probe]
                up, down = probe[less], probe[~less]
                left[up], below[up] = at[less] + 1, met[less]
                right[down], above[down] = at[~less] + 1, met[~less]
        return left, right


def samples(places: np.ndarray, end: int, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """Every 16th place, or with bit ``mark`` set the row of those 16 that take over 256 bits, and these rows."""
    kind = np.uint32 if mark == 31 else np.uint64
    jump = places[::SAMPLE].astype(kind)
    spread = np.flatnonzero(np.diff(places[::SAMPLE], append=end) > 4 * 64)
    jump[spread] = np.arange(len(spread)).astype(kind) | kind(1 << mark)
    rows = np.minimum(spread[:, None] * SAMPLE + np.arange(SAMPLE), len(places) - 1)
    return jump, places[rows.ravel()].astype(kind)


class Level:
    """The children of a range of contexts: pointers, context-relative children, quantised scores.

    Pointers tell where a context's children begin and end. Children ascend within their context and are
    stored on top of the last child before it, which makes the level one strictly monotone sequence; a
    child is found by a successor search from the place of that last child, between its context's pointers.
    """

    def __init__(self, load: Load, name: str):
        self.pointers, self.children = EliasFano(load, f"{name}.ptr"), EliasFano(load, f"{name}.child")
        self.score, self.back = load(f"{name}.score", np.uint16), load(f"{name}.back", np.uint16)

    @staticmethod
    def write(context: np.ndarray, child: np.ndarray, contexts: int, store: Store, name: str) -> np.ndarray:
        """Store sorted (context, child) pairs; returns the number of children of each context."""
        degree = np.bincount(context, minlength=contexts)
        stop = np.cumsum(degree)
        span = np.zeros(contexts, np.int64)
        span[degree > 0] = child[stop[degree > 0] - 1] + 1
        base = np.cumsum(span) - span
        EliasFano.write(np.concatenate(([0], stop)), store, f"{name}.ptr")
        EliasFano.write(base[context] + child, store, f"{name}.child")
        return degree

    def find(self, context: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Index of each (context, child), -1 where the level does not hold it; fastest for ascending contexts."""
        out = np.full(len(context), -1, np.int64)
        heads = np.flatnonzero(np.concatenate((np.ones(min(len(context), 1), bool), context[1:] != context[:-1])))
        if not len(heads):
            return out
        start, stop = (x.astype(np.int64) for x in self.pointers.with_next(context[heads]))
        filled = np.flatnonzero(start < stop)
        start, stop = start[filled], stop[filled]
        before, place, base = start - 1, np.full(len(filled), -1, np.int64), np.zeros(len(filled), np.int64)
        after = np.flatnonzero(start > 0)
        place[after] = self.children.select(before[after], True)
        base[after] = self.children.value(before[after], place[after]).astype(np.int64) + 1
        length = np.diff(heads, append=len(context))[filled]
        run = np.repeat(np.arange(len(filled)), length)
        own = np.arange(len(run)) + np.repeat(heads[filled] - (np.cumsum(length) - length), length)
        at = self.children.find_behind((base[run] + child[own]).astype(np.uint64), before[run], place[run])
        out[own] = np.where(at < stop[run], at, -1)
        return out
