import hashlib
from collections import Counter

import numpy as np
import pytest
from corpora import prose

from tablerisk.llm import substrings


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(r) else 0
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def result(df):
    return sorted((r[0] is not None, r[0], *r[1:5]) for r in df.collect())


def expected(rows, length):
    return sorted((r[0] is not None, r[0], *x) for r, x in zip(rows, brute([r[1] for r in rows], length)))


@pytest.mark.parametrize("length,crowd", [(200, 50_000), (90, 50_000), (90, 2)])
def test_equals_brute_force(odd_documents, odd_rows, length, crowd):
    assert result(substrings.remove_repeats(odd_documents, length, crowd)) == expected(odd_rows, length)


def test_long_text_is_cut_into_overlapping_pieces(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 4000)
    passage = prose(50, 60)
    rows = [(1, prose(51, 3000) + passage + prose(52, 500)), (2, passage + prose(53, 1500) + passage), (3, prose(54, 30))]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert result(got) == expected(rows, 200)


def test_empty_table(no_documents):
    assert substrings.remove_repeats(no_documents).count() == 0


def test_kept_bytes(spark):
    passage = prose(60, 80)
    rows = [(1, "left " + passage), (2, passage + " right")]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), texts=True)
    for r in got.collect():
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]
        assert len(r["kept"]) == r["n_bytes"] - r["n_removed"] < 20


def test_multikey_sort_orders_and_measures():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 2, (500, 30), dtype=np.uint8) * 255
    rows[100:140] = rows[0]
    order, common = substrings.multikey_sort(rows)
    ordered = [bytes(rows[i]) for i in order]
    assert ordered == sorted(ordered)
    for k in range(1, 500):
        a, b = ordered[k - 1], ordered[k]
        same = next((i for i in range(30) if a[i] != b[i]), None)
        assert common[k] == same if same is not None else common[k] >= 30
