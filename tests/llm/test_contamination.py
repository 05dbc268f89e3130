import inspect
import re
from collections import Counter

import pytest
from corpora import prose

from tablerisk.llm import contamination


def tokens(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def shingle_list(words, size=5):
    return [tuple(words[k : k + size]) for k in range(len(words) - size + 1)] or ([tuple(words)] if words else [])


def similarity(a, b):
    x, y = Counter(a), Counter(b)
    return sum((x & y).values()) / sum((x | y).values())


def brute(rows, items, threshold=0.8):
    out = {}
    for d, text in rows:
        own = shingle_list(tokens(text))
        for i, item in items:
            other = shingle_list(tokens(item))
            if own and other and i is not None:
                size = min(len(other), len(own))
                best = max(similarity(own[k : k + size], other) for k in range(len(own) - size + 1))
                if best >= threshold:
                    out[d, i] = max(best, out.get((d, i), 0))
    return out


ITEMS = [(1, prose(500, 30)), (2, prose(501, 45)), (3, prose(502, 14)), (4, "two words"), (5, None), (6, ""), (None, prose(503, 20)),
         (7, prose(500, 30)), (8, "word " * 25)]


@pytest.mark.parametrize("at_once", [2_000, 2])
def test_equals_brute_force(spark, odd_rows, at_once):
    rows = [r[:2] for r in odd_rows]
    for k, (_, item) in enumerate(ITEMS):
        if item and k != 6:
            words = item.split()
            rows.append((600 + k, prose(700 + k, 90) + " " + item.upper() + "\n" + prose(800 + k, 90)))
            rows.append((650 + k, " ".join([prose(750 + k, 40), *words[: len(words) // 2], "edit", *words[len(words) // 2 + 1 :]])))
            rows.append((670 + k, item))
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, item_id int, window string")
    items = spark.createDataFrame([(*r, 5) for r in ITEMS], "item_id long, text string, doc_id int")
    got = contamination.contaminated(docs, items, items_at_once=at_once).collect()
    expected = brute(rows, ITEMS)
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(expected)
    for r in got:
        assert r["similarity"] == pytest.approx(expected[r["doc_id"], r["item_id"]])


def test_repeated_and_null_item_ids_across_blocks(spark):
    items = [(1, prose(520 + k, 30)) for k in range(5)] + [(None, prose(530 + k, 30)) for k in range(3)] + [(2, prose(540, 30))] * 3
    rows = [(k, prose(560 + k, 40) + " " + t + " " + prose(580 + k, 40)) for k, (_, t) in enumerate(items)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = contamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), items_at_once=2)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(k, i) for k, (i, _) in enumerate(items)}


def test_index_finds_all_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(0)
    index = contamination.Index([1, 2, 3], [prose(k, 40) for k in (1, 2, 3)], 5, 15)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in list(range(16)) * 20], np.uint64)
    window, item = index.within(index.prints[1] ^ flips)
    assert set(window[item == 1].tolist()) == set(range(len(flips)))


def test_windows_near_the_threshold_are_found():
    import numpy as np

    rng = np.random.default_rng(1)
    radius = inspect.signature(contamination.contaminated).parameters["radius"].default
    total = missed = 0
    for n, shared in ((9, 8), (27, 24), (45, 40), (50, 45)):
        for _ in range(500):
            value = rng.integers(0, 2**64, n + 40, dtype=np.uint64)
            index = contamination.Index([1], ["a b"], 5, radius)
            item = value[20 : 20 + n].copy()
            item[rng.choice(n, n - shared, replace=False)] = rng.integers(0, 2**64, n - shared, dtype=np.uint64)
            index.shingles, index.length = [item], np.array([n])
            index.prints = contamination.fingerprint(contamination.bits(item).sum(axis=0, keepdims=True))
            index.key, index.owner = np.sort(item), np.zeros(n, np.int64)
            index.filter[:] = True
            masks = contamination.near_keys(radius // contamination.BLOCKS) if not total else masks  # noqa: F821
            keys = [np.sort((index.block(index.prints, b)[:, None] ^ masks[None, :]).ravel()) for b in range(contamination.BLOCKS)]
            index.blocks = [(k, np.zeros(len(k), np.int64)) for k in keys]
            windows = [contamination.weighted_similarity(value[k : k + n], item) for k in range(41)]
            assert max(windows) >= 0.8
            total += 1
            missed += 0 not in contamination.matches(index, value, 0.8)
    print(f"radius {radius}: {missed} of {total} missed")
    assert missed <= total * 0.003


def test_empty_tables(spark, no_documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contamination.contaminated(no_documents, items).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert contamination.contaminated(docs, items.limit(0)).count() == 0
