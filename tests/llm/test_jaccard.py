import itertools
import random
import re

import pytest
from corpora import prose

from tablerisk.llm import jaccard
from tablerisk.llm.components import components
from tablerisk.llm.store import new_folder

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_set(text, size):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOW))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute(rows, size, percent):
    sets = [shingle_set(t, size) for _, t in rows]
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        linked = x and y and 100 * len(x & y) >= percent * len(x | y)
        if (linked or (rows[a][0] is not None and rows[a][0] == rows[b][0])) and group[a] != group[b]:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(ids) if i is not None else None))
    return out


def check(documents, rows, size, percent):
    got = [tuple(r[:3]) for r in jaccard.similar_documents(documents, size, percent).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(brute(rows, size, percent), key=key)


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_equals_brute_force(odd_documents, odd_rows, size, percent):
    check(odd_documents, [r[:2] for r in odd_rows], size, percent)


def test_chains_groups_and_common_passages(spark):
    rng = random.Random(5)
    rows = []
    for g in range(6):  # chains whose ends are not linked, each with a shared first line
        words = ["shared", "first", "line", "of", "all", *prose(100 + g, 60).split()]
        for _ in range(8):
            rows.append((len(rows) * 7 % 1000, " ".join(words)))
            words = words.copy()
            words[rng.randrange(5, len(words))] = f"new{rng.random()}"
    rows += [(2000 + k, "only common words here") for k in range(5)] + [(3000 + k, f"only common words {k}") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, rows, 3, 90)
    check(docs, rows, 3, 80)


def test_second_pass_finds_links_between_components(spark, monkeypatch):
    # Without the first pass's pairs all links have to come from the second.
    monkeypatch.setattr(jaccard, "filtered", lambda pairs, percent: pairs.where("false").select("a", "b"))
    rows = [(k, prose(7, 80) + (f" tail{k // 2}" if k % 2 else "")) for k in range(8)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 3, 90)


def test_a_class_of_null_ids_links_others(spark):
    words = prose(11, 100).split()
    rows = [(None if k == 1 else k, " ".join([*(f"new{j}" for j in range(3 * k)), *words[3 * k :]])) for k in range(3)]
    got = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {0: 0, None: None, 2: 0}


def test_empty_table(no_documents):
    assert jaccard.similar_documents(no_documents).count() == 0


def test_components_of_a_long_path(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 102), (102, 101), (101, 100), (200, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), new_folder(spark, "path")).collect()))
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100}
