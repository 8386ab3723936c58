"""Conversation repair against a search over all edit strings and a plain reading of the rules."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import repair_trie

SF = "/root/testdata/sf0.001"
GOOD = re.compile(r"(s?(ua)+)?")
FULL = re.compile(r"[^\x20\x09-\x0D]")


def all_edits(rows, inserts):
    """(cost, audit, roles) of every edit string with so many inserts: rows are (initial, must go, truncated)."""
    n = len(rows)
    for slots in product(range(inserts + 1), repeat=n + 1):
        if sum(slots) > inserts:
            continue
        for edits in product(*(("D",) if r[1] else "DKR" for r in rows)):
            word = "".join("I" * slots[i] + (edits[i] if i < n else "") for i in range(n + 1))
            at, cost, choices = 0, 0, []
            for e in word:
                if e == "I":
                    cost += 5
                    choices.append("ua")
                    continue
                initial, _, cut = rows[at]
                at += 1
                cost += 2 if e == "D" else (e == "R") + 5 * cut
                if e != "D":
                    choices.append("ua" if e == "R" else [initial])
            for roles in product(*choices):
                if GOOD.fullmatch("".join(roles)):
                    yield cost, word


def plain(signature, i=0, last="", inserted=0):
    """Least (cost, audit) by plain recursion, with three inserts in a row at most (two are enough for any need)."""
    options = [(0, "")] if i == len(signature) and last in ("", "a") else []
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
    new = follow.replace("s", "")
    ways = [(5, "I", i, new, inserted + 1)] * (inserted < 3)
    if i < len(signature):
        x, more = signature[i], 5 * signature[i].isupper()
        ways.append((2, "D", i + 1, last, 0))
        if x != "x":
            ways += [(more, "K", i + 1, x.lower(), 0)] * (x.lower() in follow) + [(1 + more, "R", i + 1, new, 0)]
    for cost, edit, *to in ways:
        c, w = plain(signature, *to)
        options.append((cost + c, edit + w))
    return min(options, default=(1 << 40, ""))


def solved(signature):
    layers = [repair_trie.FIRST]
    for x in signature:
        layers.append(repair_trie.advance(layers[-1], x))
    return repair_trie.answer(signature, layers)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_answers_equal_all_edit_strings(n):
    for signature in product("xsuaoSUA", repeat=n):
        rows = [(x.lower(), x == "x", x.isupper()) for x in signature]
        assert solved("".join(signature)) == min(all_edits(rows, 2 if n > 2 else 3)), signature


def test_answers_equal_a_plain_recursion():
    draw = random.Random(3)
    for _ in range(150):
        signature = "".join(draw.choice("xsuaoSUAO") for _ in range(draw.randint(3, 5)))
        assert solved(signature) == plain(signature), signature


def expected(rows):
    """The report and the repaired rows of one conversation, from its original rows in order."""
    after = []
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        after += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    seen, signature, counts = set(), "", [0, 0, 0]
    for _, role, text in after:
        letters = FULL.findall(text)
        fault = 0 if not letters else 1 if (role, text) in seen else 2 if letters[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        symbol = role[:1] if role[:1] in ("s", "u", "a") else "o"
        signature += "x" if fault in (0, 1) else symbol.upper() if fault == 2 else symbol
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:], strict=False))
    turns = [t for t, _, _ in after if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = solved(signature)
    out, i, last = [], 0, ""
    for e in audit:
        new = "a" if last == "u" else "u"
        if e == "I":
            out.append(("user:" if new == "u" else "assistant:"))
            last = new
            continue
        _, role, text = after[i]
        i += 1
        if e == "K":
            out.append(f"{role}:{text}")
            last = role[:1]
        elif e == "R":
            out.append(("user:" if new == "u" else "assistant:") + text)
            last = new
    assert GOOD.fullmatch("".join(x[:1] for x in out))
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(r))
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_conversations_of_every_kind(spark):
    draw, rows = random.Random(9), []
    for conv in [*range(150), None]:
        for turn in draw.sample(range(12), draw.randint(1, 8)):
            rows.append((conv, turn, draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), draw.choice(["Hi.", "Hi.", "yes", "no?  \n", " \t", "", None, "é!", "a\n.", f"t{turn}."])))
    rows += [(200, None, "user", "null turn."), (200, 3, "assistant", "x." * 200_000), (201, 0, "user", "dropped?")]
    rows = [r for r in rows if r[0] != 201]
    gone = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "dropped."))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("same", "gone", "audit", "rows", "signature", "copy")})
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair_trie.repair(table.repartition(5), digest=True).collect()}
    assert got == {k: expected(v) for k, v in grouped(rows).items()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    listed = grouped(repair_trie.repair(table).collect())
    assert set(listed) == {k for k, v in got.items() if v[6]}
    for key, edits in listed.items():
        edits.sort(key=lambda e: e[1])
        assert "".join(e[2] for e in edits) == got[key][6] and [e[1] for e in edits] == list(range(len(edits)))
        assert hashlib.sha256("\n".join(f"{e[4]}:{e[5]}" for e in edits if e[2] != "D").encode()).hexdigest() == got[key][7]


def test_repeated_rows_one_long_conversation_and_empty_tables(spark):
    rows = [(1, 1, "user", "same.")] * 3 + [(2, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(3000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair_trie.repair(table, digest=True).collect()}
    assert got == {k: expected(v) for k, v in grouped(rows).items()}
    assert got[1][2] >= 2 and len(got[2][6]) >= 2800
    for digest in (False, True):
        assert repair_trie.repair(table.limit(0), digest=digest).count() == 0


def test_query_over_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair_trie.query(spark, SF).collect()}
    assert got == {k: expected(v) for k, v in grouped(rows).items()}
