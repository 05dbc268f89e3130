import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tablerisk.llm import language_model
from tablerisk.llm.eliasfano import EliasFano, Level, nth_one
from tablerisk.llm.store import Folder
from tablerisk.llm.text import BASE, BYTE_VALUES, mix, powers, words

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute(rows, d=0.75):
    texts = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOW)) + [b" END"] for _, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows]
    one, two, three = Counter(), Counter(), Counter()
    for t, h in zip(texts, held):
        if not h:
            one.update(t)
            two.update(zip(t, t[1:]))
            three.update(zip(t, t[1:], t[2:]))
    n, v = sum(one.values()), len(one)
    sums, kinds = Counter(), Counter()
    for grams in (two, three):
        for g, c in grams.items():
            sums[g[:-1]] += c
            kinds[g[:-1]] += 1

    def p(context, w):
        if not context:
            return max(one[w] - d, 0) / n + d * v / n / (v + 1)
        lower = p(context[1:], w)
        if not sums[context]:
            return lower
        grams = two if len(context) == 1 else three
        return max(grams[(*context, w)] - d, 0) / sums[context] + d * kinds[context] / sums[context] * lower

    out = []
    for t, h in zip(texts, held):
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        score = sum(math.log10(p(tuple(t[max(0, k - 2) : k]), w)) for k, w in enumerate(t))
        out.append((h, len(t), sum(one[w] > 0 for w in t), n, base, score))
    return out


@pytest.mark.parametrize("per_shard", [4_000_000, 700])
def test_scores_equal_brute_force(odd_documents, odd_rows, per_shard):
    got = language_model.language_model_scores(odd_documents, tokens_per_shard=per_shard).collect()
    expected = brute([r[:2] for r in odd_rows])
    key = lambda r: (r[0] is None, r[0] or 0)
    assert len(got) == len(expected)
    for g, e in zip(sorted(map(tuple, got), key=key), sorted(((r[0], *x) for r, x in zip(odd_rows, expected)), key=key)):
        assert g[:5] == e[:5]
        assert math.isclose(g[5], e[5], rel_tol=1e-9)
        assert abs(g[6] - e[6]) <= 3e-4 * g[2]


def test_a_shard_of_a_level_is_one_file(spark, odd_documents, monkeypatch):
    """Tasks map every shard, and a process has about 65,000 maps: a file for each array ends above 1,800 shards."""
    found = []
    score = language_model.score_documents
    monkeypatch.setattr(language_model, "score_documents", lambda docs, sizes, *fold: found.append(sizes) or score(docs, sizes, *fold))
    assert language_model.language_model_scores(odd_documents, tokens_per_shard=700).count() == 20
    (sizes,) = found
    names = sorted(p.name for p in Path(sizes.folder.removeprefix("file:")).iterdir())
    names = [n for n in names if not n.startswith(".")]
    assert sizes.shards > 1 and names == [f"level{k}-{s:05d}" for k in (1, 2, 3) for s in range(sizes.shards)]


def test_arrays_of_one_file_come_back_with_their_types(tmp_path):
    folder = Folder(str(tmp_path))
    arrays = {"a": np.arange(5, dtype=np.uint16), "b": np.zeros(0, np.uint64), "c": np.array([2**63], np.uint64), "d": np.arange(3)}
    folder.write_arrays("f", arrays)
    load = folder.arrays("f")
    for key, a in arrays.items():
        assert load(key, a.dtype).dtype == a.dtype and load(key, a.dtype).tolist() == a.tolist()
    folder.write_arrays("e", {})
    folder.arrays("e")


def test_empty_table_and_no_training(spark, no_documents):
    assert language_model.language_model_scores(no_documents).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = spark.createDataFrame([(held, "never seen words")], "doc_id long, text string")
    row = language_model.language_model_scores(only).first()
    assert row["held_out"] and row["n_known"] == 0 and row["train_tokens"] == 0 and math.isfinite(row["score"])


def kept():
    held = {}
    return held, lambda name, array: held.__setitem__(name, np.array(array)), lambda name, _: held[name]


@pytest.mark.parametrize("n,top", [(0, 1), (1, 5), (1000, 10**6), (5000, 2**62), (2000, 2001)])
def test_elias_fano_access_and_find(n, top):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, top, n, dtype=np.uint64))
    _, put, get = kept()
    EliasFano.write(values, put, "a")
    sequence = EliasFano(get, "a")
    assert (sequence.access(np.arange(len(values))) == values).all()
    asked = np.concatenate((values, rng.integers(0, top, 500, dtype=np.uint64), np.array([0, 2**63], np.uint64)))
    places = {v: i for i, v in enumerate(values.tolist())}
    assert sequence.find(asked).tolist() == [places.get(v, -1) for v in asked.tolist()]


def test_nth_one():
    rng = np.random.default_rng(5)
    word = np.concatenate((rng.integers(1, 2**63, 400, dtype=np.uint64), rng.integers(1, 2**63, 400, dtype=np.uint64) & rng.integers(1, 2**63, 400, dtype=np.uint64), [np.uint64(2**64 - 1), np.uint64(1), np.uint64(2**63)]))
    places = [[k for k in range(64) if int(w) >> k & 1] for w in word]
    asked = [(w, n, p) for w, ps in zip(word, places) for n, p in enumerate(ps)]
    got = nth_one(np.array([a[0] for a in asked], np.uint64), np.array([a[1] for a in asked]))
    assert got.tolist() == [a[2] for a in asked]


def test_elias_fano_with_dense_runs_and_wide_gaps():
    rng = np.random.default_rng(9)
    values = np.unique(np.concatenate([np.arange(b, b + n) for b, n in ((0, 9000), (10**9, 1), (10**9 + 7 * 10**6, 20000), (2**40, 300))])).astype(np.uint64)
    _, put, get = kept()
    EliasFano.write(values, put, "a")
    sequence = EliasFano(get, "a")
    assert (sequence.access(np.arange(len(values))) == values).all()
    asked = np.concatenate((values, values + np.uint64(1), rng.integers(0, 2**40, 3000, dtype=np.uint64)))
    places = {v: i for i, v in enumerate(values.tolist())}
    assert sequence.find(asked).tolist() == [places.get(v, -1) for v in asked.tolist()]


@pytest.mark.parametrize("seed", range(6))
def test_elias_fano_finds_the_first_of_equal_values_in_uneven_buckets(seed):
    rng = np.random.default_rng(seed)
    parts = [rng.integers(0, 2**36, 300), 2**33 + rng.integers(0, 5000, 4000), 2**35 + (rng.random(3000) ** 9 * 2**20).astype(np.int64), np.full(700, 2**34)]
    values = np.sort(np.concatenate(parts)).astype(np.uint64)
    if seed % 2:
        values = np.unique(values)
    held, put, get = kept()
    EliasFano.write(values, put, "a")
    sequence = EliasFano(get, "a")
    assert (sequence.access(np.arange(len(values))) == values).all()
    first, second = sequence.with_next(np.arange(len(values) - 1))
    assert (first == values[:-1]).all() and (second == values[1:]).all()
    asked = np.concatenate((values, values + np.uint64(1), values - np.uint64(1), rng.integers(0, 2**36, 3000).astype(np.uint64)))
    expected = np.searchsorted(values, asked)
    hit = values[np.minimum(expected, len(values) - 1)] == asked
    assert (sequence.find(asked) == np.where(hit, expected, -1)).all()
    if seed % 2:
        index = rng.integers(-1, np.maximum(expected, 0))  # any element below the asked value
        place = np.where(index >= 0, sequence.select(np.maximum(index, 0), True), -1)
        assert (sequence.find_behind(asked, index, place) == np.where(hit, expected, -1)).all()


def test_elias_fano_reaches_zeros_behind_long_runs_without_a_search():
    """A context with very many children is a long run of ones: its buckets are found by stored places."""
    rng = np.random.default_rng(1)
    hub = np.unique(rng.integers(2**40, 2**40 + 2**22, 200_000))
    values = np.concatenate((np.arange(0, 2**40, 2**27), hub)).astype(np.uint64)
    _, put, get = kept()
    EliasFano.write(values, put, "a")
    sequence = EliasFano(get, "a")
    windows, look = [], sequence.window
    sequence.window = lambda place: windows.append(len(place)) or look(place)
    zeros = np.arange(sequence.buckets)
    flags = np.unpackbits(np.ascontiguousarray(sequence.high).view(np.uint8), bitorder="little")
    assert (sequence.select(zeros, False) == np.flatnonzero(flags == 0)[zeros]).all()
    assert (sequence.select(np.arange(sequence.n), True) == np.flatnonzero(flags)).all()
    assert len(windows) <= 10  # five of 64 bits from a stored place reach each one and each zero


@pytest.mark.parametrize("bits", [9, 62])
def test_distinct_keys_equal_unique(bits):
    key = np.random.default_rng(bits).integers(0, 1 << bits, 3000)
    key = np.concatenate((key, key[::3], np.array([0, (1 << bits) - 1])))
    distinct = language_model.Distinct.of(key, bits)
    unique, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    assert (distinct.key == unique).all() and (distinct.inverse() == inverse).all()
    assert (np.diff(distinct.head, append=len(key)) == count).all() and (key[distinct.order[distinct.head]] == unique).all()
    assert not len(language_model.Distinct.of(key[:0], bits).key)


def test_hashes_of_words_do_not_depend_on_blocks_or_neighbours():
    texts = ["", "  a ab\tabc", "x" * 200_000 + " y", "ab", None, " ".join(f"w{k % 977}" for k in range(60_000)), "ABC\n"]
    found = words(pa.array(texts), lower=True)
    single = {}
    for word in {w for t in texts for w in (t or "").lower().split()}:
        value = sum(int(BYTE_VALUES[b]) * int(p) for b, p in zip(word.encode(), powers(len(word))))
        single[word] = mix(np.array([(value + len(word) * int(BASE)) % 2**64], np.uint64))[0]
    assert found.hashes().tolist() == [single[w] for t in texts for w in (t or "").lower().split()]


def test_level_finds_children_of_their_context_only():
    rng = np.random.default_rng(3)
    pairs = sorted(set(zip((rng.integers(0, 300, 4000) // 3 * 2).tolist(), rng.integers(0, 900, 4000).tolist())))
    held, put, get = kept()
    context, child = (np.array(x) for x in zip(*pairs))
    Level.write(context, child, 300, put, "l")
    held["l.score"] = held["l.back"] = np.zeros(0, np.uint16)
    level = Level(get, "l")
    places = {p: i for i, p in enumerate(pairs)}
    a, b = rng.integers(0, 300, 5000), rng.integers(0, 900, 5000)
    assert level.find(a, b).tolist() == [places.get(p, -1) for p in zip(a.tolist(), b.tolist())]
