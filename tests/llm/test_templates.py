import random
from collections import defaultdict

from corpora import prose

from tablerisk.llm import templates


def result(df):
    return {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped_lines"]) for r in df.collect()}


def test_variable_fields_and_positions(spark):
    rows = []
    for k in range(12):
        body = prose(900 + k, 60).replace("\n", " ")
        rows.append((k, f"Page {k} of 12\n{body}\nLast edited by user{k} on Monday evening\nwritten by the {chr(97 + k)}{chr(99 + k)} team today"))
    rows += [(100, "a line of its own\n" + prose(950, 60).replace("\n", " ")), (101, "Page 3 of 12\nPage 4 of 12")]
    got = result(templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10))
    for k in range(12):
        assert got[k] == (rows[k][1].split("\n")[1], 4, 3)
    assert got[100] == (rows[12][1], 2, 0)
    assert got[101] == (rows[13][1], 2, 0)  # nothing but recurring lines: kept whole


def test_support_counts_documents_not_lines(spark):
    rows = [(1, "\n".join(["same short line"] * 50) + "\nend of this text"), (2, "other text")]
    got = result(templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=2))
    assert got[1][2] == 0


def test_nulls_ties_and_clashing_names(odd_documents, odd_rows):
    got = templates.drop_recurring_lines(odd_documents, min_docs=3)
    assert got.columns == [*odd_documents.columns, "n_lines", "n_dropped_lines"]
    held = defaultdict(set)
    for r in odd_rows:
        for line in (r[1] or "").split("\n"):
            if t := templates.masked(line.split()):
                held[" ".join(t)].add(r[0])
    rows = got.collect()
    assert len(rows) == len(odd_rows)
    assert sorted((r["doc_id"] or 0, r["n_lines"]) for r in rows) == sorted(
        (r[0] or 0, len(r[1].split("\n")) if r[1] is not None else 0) for r in odd_rows
    )
    assert all(r["text"] is None for r in rows if r["doc_id"] == 5)
    alone = {i for i in {r[0] for r in odd_rows} if all(i not in ids or len(ids) < 3 for ids in held.values())}
    originals = {r[0]: r[1] for r in odd_rows}
    assert all(r["text"] == originals[r["doc_id"]] for r in rows if r["doc_id"] in alone and r["n_dropped_lines"] == 0)


def test_leaf_order_does_not_depend_on_partitions(spark):
    lines = [("5 a b c", f"a b c {x} {y}", n) for n, (x, y) in enumerate([("p", "q"), ("p", "r"), ("s", "q"), ("t", "u")])]
    frame = spark.createDataFrame(lines, "leaf string, line string, n long")
    one = {tuple(r) for r in templates.parse_leaves(frame.coalesce(1), 3, 0.7).collect()}
    many = {tuple(r) for r in templates.parse_leaves(frame.repartition(4), 3, 0.7).collect()}
    assert one == many and len({r[2] for r in one}) == 3


def test_empty_table(no_documents):
    assert templates.drop_recurring_lines(no_documents).count() == 0


def plain(rows, min_docs, depth=3, similarity=0.7):
    """The method line by line: leaves, templates in order of support, documents per template."""
    held = defaultdict(lambda: defaultdict(set))
    for doc, text in rows:
        for line in text.split("\n"):
            tokens = ["<*>" if any(c.isdigit() for c in t) else t for t in line.split()]
            if tokens:
                held[(len(tokens), *tokens[:depth])][tuple(tokens)].add(doc)
    gone = set()
    for lines in held.values():
        made = []  # (template, lines)
        for tokens in sorted(lines, key=lambda t: (-len(lines[t]), " ".join(t))):
            score = lambda own: sum(a == b and a != "<*>" for a, b in zip(own[0], tokens))  # noqa: B023, E731
            best = max(made, key=score, default=None)
            if best is None or score(best) < similarity * len(tokens):
                made.append((list(tokens), [tokens]))
                continue
            best[1].append(tokens)
            best[0][:] = [a if a == b else "<*>" for a, b in zip(best[0], tokens)]
        for _, own in made:
            if len(set().union(*(lines[t] for t in own))) >= min_docs:
                gone.update(own)
    out = {}
    for doc, text in rows:
        lines = text.split("\n")
        kept = [x for x in lines if tuple("<*>" if any(c.isdigit() for c in t) else t for t in x.split()) not in gone]
        out[doc] = "\n".join(kept if any(x.strip() for x in kept) else lines)
    return out


def test_equals_plain_version_with_long_lines(spark):
    rng = random.Random(4)
    words = "alpha beta gamma delta omega sigma kappa".split()
    notice = " ".join(rng.choice(words) for _ in range(90))
    rows = []
    for k in range(80):
        lines = [prose(k, 30).replace("\n", " ")]
        for _ in range(6):
            lines.append(" ".join(rng.choice(words[:3]) for _ in range(3)) + " " + " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 9]))))
        if k % 2:
            lines.append(notice if k % 4 == 1 else notice.replace("sigma", f"s{k}", 1) + "")
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = result(templates.drop_recurring_lines(frame, min_docs=6))
    expected = plain(rows, 6)
    assert {k: v[0] for k, v in got.items()} == expected
    assert not any(notice in text for text in expected.values())
    assert sum(v[2] for v in got.values()) > 80
