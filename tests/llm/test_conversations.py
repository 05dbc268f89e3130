import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from tablerisk.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, live boolean, pos int, code string, extra string"
SHAPE = re.compile(r"(s?(ua)+)?")
PRICE = {"K": 0, "R": 1, "D": 2, "I": 5}


def outcome(rows, edits):
    """Cost of these edits (a string a row, one more at the end) and the repaired rows; None if they are not allowed."""
    cost, said, state = 0, [], ""
    for (initial, must_go, cut), own in zip([*rows, (None, False, False)], edits):
        for letter in own:
            cost += PRICE[letter] + 5 * (cut and letter in "KR")
            if must_go and letter in "KR":
                return None
            role = "" if letter == "D" else initial if letter == "K" else "a" if state.endswith("u") else "u"
            state += role
    return (cost, "".join(edits)) if SHAPE.fullmatch(state) else None


def exhaustive(rows):
    gaps = ["", "I", "II"]
    choices = [[g + e for g in gaps for e in "KRD"] for _ in rows] + [gaps]
    return min(filter(None, (outcome(rows, edits) for edits in itertools.product(*choices))))


def random_rows(rng, n):
    return [(rng.choice("suuaax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]


def codes(rows):
    return "".join(cv.CODES[3 * "suax".index(i) + (1 if gone else 2 if cut else 0)] for i, gone, cut in rows)


def forward(rows):
    """Plain dynamic programme over the rows: least (cost, audit) of each state."""
    best = {"": (0, "")}

    def inserted(best):
        for _ in range(2):
            for s, (c, e) in list(best.items()):
                t = "a" if s == "u" else "u"
                best[t] = min(best.get(t, (10**9, "")), (c + 5, e + "I"))
        return best

    for initial, gone, cut in rows:
        new = {}
        for s, (c, e) in inserted(best).items():
            nexts = [(s, 2, "D")]
            if not gone:
                t = "a" if s == "u" else "u"
                nexts.append((t, 1 + 5 * cut, "R"))
                if initial == t or (initial == "s" and s == ""):
                    nexts.append((initial, 5 * cut, "K"))
            for t, price, letter in nexts:
                new[t] = min(new.get(t, (10**9, "")), (c + price, e + letter))
        best = new
    best = inserted(best)
    return min(best[s] for s in ("", "a") if s in best)


@pytest.mark.parametrize("seed", range(40))
def test_search_equals_all_edit_strings(seed):
    rng = random.Random(seed)
    rows = random_rows(rng, rng.randint(1, 4))
    assert cv.whole_path(codes(rows)) == exhaustive(rows) == forward(rows)


@pytest.mark.parametrize("seed", range(20))
def test_long_conversations_and_blocks(seed):
    rng = random.Random(seed)
    rows = random_rows(rng, rng.randint(5, 120))
    assert cv.whole_path(codes(rows)) == forward(rows)
    text, size = codes(rows), rng.randint(1, 30)
    blocks = [text[i : i + size] for i in range(0, len(text), size)]
    assert cv.chained([cv.block_paths(b, k == 0) for k, b in enumerate(blocks)]) == forward(rows)


def plain(rows, damage):
    """The contract, conversation by conversation."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        own = held[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, own in held.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen, kinds = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in own:
            body = text.rstrip(" \t\n\x0b\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            kinds.append((role[:1] if role[:1] in ("s", "u", "a") else "x", fault in ("blank", "duplicate"), fault == "truncated"))
        initials = [role[:1] for _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = forward(kinds) if own else (0, "")
        said, state, row = [], "", 0
        for letter in audit:
            if letter == "D":
                row += 1
                continue
            new = "s" if letter == "K" and kinds[row][0] == "s" else "a" if state == "u" else "u"
            role = own[row][1] if letter == "K" else {"u": "user", "a": "assistant"}[new]
            said.append(f"{role}:{'' if letter == 'I' else own[row][2]}")
            state, row = new, row + (letter != "I")
        sha = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, sha)
    return out


def random_table(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "User", "agent"]
    texts = ["Yes.", "No!", "Why?", "well", "and　", " \t\n", "", None, "ok. \n", "Ünï.", "a. ", "b" * 3000 + "."]
    rows = []
    for conv in [None, *range(n)]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            turn = rng.choice([t, t, t, t + 3, None, -t])
            rows.append((conv, turn, rng.choice(roles[: rng.choice([3, 5, 10])]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("damage", [False, True])
def test_equals_plain_version(spark, damage):
    rows = random_table(5, 150) + [(777, k, "assistant" if k % 3 else "user", f"line {k % 200}.") for k in range(2 * cv.BLOCK + 9)]
    rows += [(778, k, "user", f"line {k}.") for k in range(cv.BLOCK)]
    table = spark.createDataFrame([(*r, True, 3, "x", None) for r in rows], SCHEMA).repartition(4)
    got = {r["conv_id"]: tuple(r)[1:] for r in cv.repaired(table, damage).collect()}
    assert got == plain(rows, damage)


def test_empty_and_dropped_conversations(spark):
    assert cv.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
    conv = next(k for k in range(1000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    table = spark.createDataFrame([(conv, 1, "user", "Hi.", True, 0, "", "")], SCHEMA)
    got = cv.repaired(table, damage=True).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    far = spark.createDataFrame([(1, -(2**63), "user", "Hi.", True, 0, "", ""), (1, 2**63 - 1, "assistant", "Ho.", True, 0, "", "")], SCHEMA)
    assert cv.repaired(far).first()["gaps"] == 2**63 - 1
