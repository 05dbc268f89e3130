import hashlib
import random
from collections import defaultdict

import pytest
from corpora import prose

from tablerisk.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, PIECE = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    "a", " a", "a ", "a  b", "\na", "a\n", "a\n\nb", "a \n b", "x\t y\rz", "<|endoftext|> <s> </s> <unk> <0x0A>", "▁ x▁y", "don't İ ß",
    "日本 語 😀", "a\x00b", "\x85a\xa0b", "'''''''' ,,,, ''''", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ééééé\nÉé", "  ", "\n",
]


def plain(texts):
    """The contract, text by text, with sets of ends."""
    t = alignment.Tokenizers(BYTE, PIECE)
    rows, held = [], defaultdict(set)
    for k, text in enumerate(texts):
        a = t.first.tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids
        b = t.pieces.encode(text or "")
        spelled = [b"".join(side[i] for i in ids) for side, ids in ((t.bytes_a, a), (t.bytes_b, b))]
        if not text or spelled[0] != spelled[1] or spelled[0] != (" " + text).encode():
            rows.append(None)
            continue

        def ends(lengths, ids):
            out, at = [], 0
            for i in ids:
                at += lengths[i]
                out.append(at)
            return out

        ea, eb = ends(t.length_a, a), ends(t.length_b, b)
        groups, ca, cb = [], 0, 0
        for cut in sorted(set(ea) & set(eb)):
            na, nb = ea.index(cut, ca) + 1, eb.index(cut, cb) + 1
            groups.append((a[ca:na], b[cb:nb]))
            ca, cb = na, nb
        links = [(x, y) for g, h in groups for x in g for y in h]
        rows.append((len(a), len(b), groups, links))
        for link in links:
            held[link].add(k)
    top = defaultdict(int)
    for (x, _), docs in held.items():
        top[x] = max(top[x], len(docs))
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = row
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        count = [len(held[x]) for x in links]
        best = sum(c == top[x] for c, (x, _) in zip(count, links))
        out.append((n_a, n_b, len(groups), len(links), best, sum(count), hashlib.sha256(text.encode()).hexdigest()))
    return out


def random_texts(n):
    rng = random.Random(3)
    letters = "abeé'.,\n \tİ▁<s>0 \x00語"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_equals_brute_force(spark):
    texts = [*ODD, None, "", *random_texts(150), *(prose(k, 120) for k in range(10)), prose(3, 120), "x" * 5000, "ab" * 3000 + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in alignment.aligned_documents(docs, BYTE, PIECE).collect())
    assert got == [(k, *row) for k, row in enumerate(plain(texts))]


def test_odd_rows_and_groups(odd_documents, odd_rows, no_documents):
    got = alignment.aligned_documents(odd_documents, BYTE, PIECE, with_groups=True).collect()
    expected = sorted((str(r[0]), *row) for r, row in zip(odd_rows, plain([r[1] for r in odd_rows])))
    assert sorted((str(r[0]), *r[1:8]) for r in got) == expected
    for r in got:
        assert r["n_groups"] == (r["groups"].count(";") + 1 if r["groups"] else 0)
    assert alignment.aligned_documents(no_documents, BYTE, PIECE).count() == 0


def test_full_table_is_emptied():
    import numpy as np
    import pyarrow as pa

    t = alignment.Tokenizers(BYTE, PIECE)
    small, large = alignment.WordTable(t, 40), alignment.WordTable(t)
    texts = [prose(k, 60) for k in range(20)]
    for k in range(0, 20, 2):
        own = pa.array(texts[k : k + 2])
        pairs = [alignment.Aligned(x, own).pair_counts(x) for x in (small, large)]
        assert all(np.array_equal(x, y) for x, y in zip(*pairs))
    assert len(small.rows) < len(large.rows)


@pytest.mark.parametrize("seed", range(30))
def test_leaves_are_cut_at_every_shared_end(seed):
    rng = random.Random(seed)
    size = rng.randint(1, 200)
    a, b = (sorted({*rng.sample(range(1, size + 1), rng.randint(0, size)), size}) for _ in range(2))
    groups = alignment.leaf_groups(a, b)
    assert [a[g[1] - 1] for g in groups] == [b[g[3] - 1] for g in groups] == sorted(set(a) & set(b))
    assert [g[0] for g in groups] == [0, *(g[1] for g in groups[:-1])] and [g[2] for g in groups] == [0, *(g[3] for g in groups[:-1])]


def test_words_divided_together_are_divided_alike():
    import numpy as np

    rng = random.Random(9)
    words = []
    for _ in range(300):
        size = rng.randint(1, 40)
        words.append([sorted({*rng.sample(range(1, size + 1), rng.randint(0, size)), size}) for _ in range(2)])
    base = np.cumsum([0, *(a[-1] for a, _ in words)])
    ends = [np.concatenate([np.array(w[k]) + n for w, n in zip(words, base)]) for k in (0, 1)]
    first = [np.cumsum([0, *(len(w[k]) for w in words)]) for k in (0, 1)]
    expected = [
        (x + i, y + i, z + j, t + j)
        for (a, b), i, j in zip(words, *(f.tolist() for f in first))
        for x, y, z, t in alignment.leaf_groups(a, b)
    ]
    got = alignment.leaves_of_words(ends[0], first[0], ends[1], first[1])
    assert [tuple(g) for g in got.tolist()] == expected
