import re

from corpora import prose

from tablerisk.llm import queries, spans


def split(text):
    """Sentences as (start, end) of bytes and their lower-case words."""
    raw = (text or "").encode()
    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    groups = []
    for k, (a, b) in enumerate(words):
        if not k or raw[words[k - 1][1] - 1] in b".!?" or b"\n" in raw[words[k - 1][1] : a]:
            groups.append([])
        groups[-1].append((a, b))
    starts = [g[0][0] for g in groups] + [len(raw)]
    lower = [[re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw[a:b]) for a, b in g] for g in groups]
    return raw, [(starts[k], starts[k + 1], w) for k, w in enumerate(lower)]


def spans_of(sentences, least, min_words):
    """All runs of every length that count, in the order of their first sentence."""
    for i in range(len(sentences)):
        words = []
        for j in range(i + 1, len(sentences) + 1):
            words += sentences[j - 1][2]
            if j - i >= least and len(words) >= min_words:
                yield i, j, hash(tuple(words))


def brute(rows, least=2, min_words=20):
    first = {}
    for i, t in rows:
        if i is not None:
            for _, _, w in spans_of(split(t)[1], least, min_words):
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        raw, sentences = split(t)
        seen, gone = set(), set()
        for a, b, w in spans_of(sentences, least, min_words):
            if w in seen or (i is not None and first[w] < i):
                gone |= set(range(a, b))
            seen.add(w)
        cut = raw[: sentences[0][0]] if sentences else raw
        cut += b"".join(raw[s[0] : s[1]] for k, s in enumerate(sentences) if k not in gone)
        out.append((i, len(sentences), len(gone), cut.decode() if t is not None else None))
    return out


def test_equals_brute_force(odd_documents, odd_rows):
    got = spans.remove_repeated_spans(odd_documents)
    assert got.columns == [*odd_documents.columns, "n_sentences", "n_removed"]
    key = lambda r: (r[0] is None, r[0] or 0, r[3] or "")
    found = [(r["doc_id"], r["n_sentences"], r["n_removed"], r["text"]) for r in got.collect()]
    assert sorted(found, key=key) == sorted(brute([r[:2] for r in odd_rows]), key=key)


def test_passage_goes_from_later_documents_only(spark):
    passage = "This passage repeats across many of the documents here today. It has two long sentences of enough words to count."
    rows = [(k, prose(70 + k, 60) + "\n" + passage + "\n" + prose(90 + k, 60)) for k in (5, 2, 9)]
    got = {r["doc_id"]: r["text"] for r in spans.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert passage in got[2] and passage not in got[5] and passage not in got[9]
    assert len(got[5]) == len(rows[0][1]) - len(passage) - 1


def test_query_sees_tails_and_leaves_short_runs(spark, tmp_path):
    sized = lambda n, w: " ".join(f"{w}{k}" for k in range(n)) + "."
    passage, short = " ".join(sized(n, w) for n, w in ((15, "a"), (10, "b"), (5, "c"), (4, "d"))), "Not long. Nor this."
    rows = [(k, f"own{k} start.\n{passage} own{k} middle.\n{short}\nown{k} end.") for k in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in queries.op4_sentence_spans(spark, str(tmp_path)).collect()}
    assert got[0] == rows[0][1]
    assert all(got[k].split() == f"own{k} start. own{k} middle. {short} own{k} end.".split() for k in (1, 2))


def test_empty_table(no_documents):
    assert spans.remove_repeated_spans(no_documents).count() == 0
