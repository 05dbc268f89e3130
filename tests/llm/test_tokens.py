import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from corpora import prose

from tablerisk.llm import packing, sequences
from tablerisk.llm.pieces import TokenTable, release
from tablerisk.llm.store import new_folder, stored

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))

ODD = [
    "", " ", "a", " a", "a ", "a  b", "a\n\nb", "a \nb", "a\n b", "\na", "\n", "x\t y", "don't stop", "it's  Ünï 12,5", "a\xa0 b",
    "İstanbul ΣΑΣ Σ", "é áb ́x", "<|endoftext|> a", "a_b __ 1st 22nd", "日本 語", "😀 a😀b", "a\x1cb \x1c c", "x​y z", "\x85a",
    "Hello,World!\nNext line.\n", "ſt ﬁ Ǆ", "'S 'RE don'T x'll", "word\n", "word \n", "word\n\n",
]


def odd_texts():
    rng = random.Random(1)
    letters = "ab é'.,\n \t12İΣ́|* "
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(1500)]


@pytest.mark.parametrize("path,keeps_space", [(WORD, False), (BYTE, True)])
@pytest.mark.parametrize("limit", [1_000_000, 700])
def test_table_equals_tokenizer(path, keeps_space, limit):
    table = TokenTable(path, keeps_space, limit)
    texts = [*odd_texts(), None]
    for own in (texts, texts[::-1], texts[:1], []):
        flat, counts = table.encode(pa.array(own, pa.string()))
        expected = table.tokenizer.whole([t or "" for t in own])
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])][: len(own)] == [x.tolist() for x in expected]


def direct(path, rows, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [end], "<u4") for _, t in rows]


def test_sequences_round_trip(spark, odd_documents, odd_rows):
    rows = sorted(((r[0], r[1]) for r in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected, start = [], 0
    for (i, _), ids in zip(rows, direct(WORD, rows, 1)):
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sequences.token_sequences(odd_documents, WORD, length=64).collect()
    key = lambda r: r[1]
    assert sorted((tuple(r[:4]) for r in got), key=key) == expected


def test_random_access_is_a_view(spark):
    rows = [(k, "some words in a row " * (k + 3)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = new_folder(spark, "sequences-test")
    manifest = stored(sequences.write_sequences(docs, WORD, False, 1, 32, pa.uint16(), folder), f"{folder}-manifest")
    for row in manifest.collect():
        held = sequences.SequenceFile(folder, f"{row['file']}.arrow")
        flat = held.tokens(0, row["tokens"])
        assert len(held) == -(-row["tokens"] // 32)
        for k in range(len(held)):
            ids, mask = held.sequence(k)
            real = min(32, row["tokens"] - 32 * k)
            assert not ids.flags.owndata and len(ids) == 32
            assert mask.to_pylist() == [True] * real + [False] * (32 - real)
            assert (ids[:real] == flat[32 * k : 32 * k + real]).all()


def test_empty_tables(no_documents):
    assert sequences.token_sequences(no_documents, WORD).count() == 0
    assert packing.packed(no_documents, BYTE).count() == 0


@pytest.mark.parametrize("capacity", [1024, 50])
def test_packing_places_every_piece_once(odd_documents, odd_rows, capacity):
    rows = [(r[0], r[1]) for r in odd_rows]
    expected = []
    for (i, _), ids in zip(rows, direct(BYTE, rows, 2)):
        first = (len(ids) - 1) % capacity + 1
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            expected.append((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    got = packing.packed(odd_documents, BYTE, capacity=capacity).collect()
    key = lambda r: (r[0] is None, *(x or 0 for x in r))
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(expected, key=key)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for sequence in places.values():
        end = 0
        for offset, length in sorted(sequence):
            assert offset == end
            end += length
        assert end <= capacity
    least = -(-sum(r["length"] for r in got) // capacity)
    assert len(places) <= least * 1.15 + 1


def test_frequent_lengths_are_ranked_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 5)
    rows = spark.createDataFrame([(k, 0, 0, 10 + k % 2, 0) for k in range(100)], packing.PIECES)
    got = packing.ranked(rows, 50).collect()
    for length in (10, 11):
        assert sorted(r["rank"] for r in got if r["length"] == length) == list(range(50))


@pytest.mark.parametrize("seed,low,high,slack", [(0, 1, 1024, 1.003), (1, 20, 90, 1.005), (2, 100, 1000, 1.01), (3, 1, 3, 1.01)])
def test_plan_is_close_to_the_bound(seed, low, high, slack):
    sizes = np.random.default_rng(seed).integers(low, high + 1, 40_000)
    histogram = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))))
    plan = packing.best_plan(histogram, 1024)
    fill, taken = np.zeros(plan.sequences, np.int64), {}
    for length, rank, count, sequence, offset in zip(plan.length, plan.rank, plan.count, plan.sequence, plan.offset):
        assert (fill[sequence : sequence + count] == offset).all()
        fill[sequence : sequence + count] += length
        taken.setdefault(length, []).append((rank, count))
    assert fill.max() <= 1024 and fill.min() > 0
    for length, ranges in taken.items():
        end = 0
        for rank, count in sorted(ranges):
            assert rank == end
            end += count
        assert end == histogram[length]
    assert plan.sequences <= max(sizes.sum() / 1024, (sizes > 512).sum()) * slack + 2


def test_full_table_keeps_its_frequent_pieces():
    table = TokenTable(public_tokenizers.path("byte_bpe_50k.json"), True, 3)
    plain = TokenTable(public_tokenizers.path("byte_bpe_50k.json"), True)
    for text in ("x a b b c c d d d", "x e f d c", "x \ng a d  h", "x"):
        column = pa.array([text, text + " tail"])
        got, want = table.encode(column), plain.encode(column)
        assert all(np.array_equal(a, b) for a, b in zip(got, want))
        assert len(table.rows) == 3 and "d" in table.rows and table.find_of_slice(["d"], np.ones(1))[0] < 3


@pytest.mark.parametrize("path,keeps_space", [(WORD, False), (BYTE, True)])
def test_words_that_differ_in_signs_are_tokenized_once(path, keeps_space):
    table = TokenTable(path, keeps_space)
    sent = []
    whole = table.tokenizer.whole
    table.tokenizer.whole = lambda texts: sent.extend(texts) or whole(texts)
    table.encode(pa.array(["x alphabet alphabet, alphabet. alphabet,%%% alphabet! été été; 7 7:"] * 3))
    assert set(table.rows) == {"x", "alphabet", "été", "7"}
    assert sum(text.count("alphabet") for text in sent) == 1


@pytest.mark.parametrize("path,keeps_space", [(WORD, False), (BYTE, True)])
@pytest.mark.parametrize("limit", [1_000_000, 300])
def test_signs_at_the_end_of_pieces(path, keeps_space, limit):
    rng = random.Random(5)
    letters = ["a", "B", "7", "é", "İ", "×", "÷", "²", "ª", "ɏ", "Ȁ", "日", "\u0301", "\u0338", "'s", "'", "<|endoftext|>", "Ġ", "\n", "\u200b", *".,;:!?&$%#*|<>=", *"      "]
    texts = ["a, 'll. b.'s ,. .a., é.\u0301 =\u0338 a=\u0338. <|endoftext|>, x<|endoftext|>.y. Ġ. Ġa", *("".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(3000))]
    table = TokenTable(path, keeps_space, limit)
    for own in (texts, texts[::-1]):
        flat, counts = table.encode(pa.array(own))
        expected = table.tokenizer.whole(own)
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [x.tolist() for x in expected]


def test_packing_a_large_batch_takes_little_memory(spark):
    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    run = packing.pieces(Rows(), BYTE, True, 2, 1024)
    text = "".join(prose(k, 500) + "\n" for k in range(5))
    batch = pa.RecordBatch.from_pydict({"doc_id": range(12_000_000 // len(text)), "text": [text] * (12_000_000 // len(text))})
    before = pa.default_memory_pool()
    list(run(iter([batch.slice(0, 1)])))  # opens the tokenizer
    pool = pa.proxy_memory_pool(before)
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        n = sum(len(cut) for cut in run(iter([batch])))
        most = tracemalloc.get_traced_memory()[1] + pool.max_memory()
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(before)
        release()
    assert n >= len(batch) and most < 80 << 20
