"""The Jaccard join and the repeated spans against brute force, with nulls, ties, repeats and hot groups."""

import random
import re

import pytest

from loomgraph.llm import jaccard_join, sparse_suffix
from loomgraph.tables import components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = SPACE.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, n=160):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5))) for _ in range(300)]
    bases = [[r.choice(words) for _ in range(r.randint(5, 90))] for _ in range(12)]
    shared = [r.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        base = list(bases[0] if i % 3 == 0 else r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 3, 9])):
            base[r.randrange(len(base))] = r.choice(words)
        if i % 7 == 0:
            base = base[: r.randint(0, 8)]
        if i % 11 == 0:
            base = base[:5] + shared + base[5:9]
        sep = r.choice([" ", "\n", "\t ", "\x0b"])
        text = sep.join(base)
        rows.append((i, text.upper() if i % 13 == 0 else text))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "One\ttwo"), (n + 5, "É a"), (n + 6, "é a")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "OFTEN", 2)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, node int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect()}
    assert got == brute(rows)


def test_join_without_frequent_shingles_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "OFTEN", 10**9)
    rows = corpus(3, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_join_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (9, None), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect()), key=str)
    assert got == sorted([(None, 2, 3), (5, 2, 3), (5, 2, 3), (3, 2, 3), (9, 0, 9), (None, 0, None)], key=str)
    assert jaccard_join.join(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_join_with_null_and_large_ids_equals_brute_force(spark, seed):
    rows = corpus(seed)
    r = random.Random(seed)
    known = {i: None if r.random() < 0.4 else 2**53 + i for i, _ in rows}
    first = [x for x in rows if known[x[0]] is None] + [x for x in rows if known[x[0]] is not None]
    # Some known ids repeat the text of a row without one, which comes first in the partition.
    first += [(1000 + i, t) for i, t in rows[:60]]
    known |= {1000 + i: 2**53 + 1000 + i for i, _ in rows[:60]}
    want, least = brute(first), {}
    for i, (_, root) in want.items():
        if known[i] is not None:
            least[root] = min(least.get(root, known[i]), known[i])
    docs = spark.createDataFrame([(known[i], t) for i, t in first], "doc_id long, text string").coalesce(1)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect()), key=str)
    assert got == sorted(((known[i], n, least.get(root)) for i, (n, root) in want.items()), key=str)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_spans(rows, least=sparse_suffix.LEAST):
    seen, texts = {}, {}
    for i, t in rows:
        w = SPACE.findall(t or "")
        texts.setdefault(tuple(w), set()).add(i)
        for p in range(len(w) - least + 1):
            seen.setdefault(tuple(w[p : p + least]), set()).add(i)
    out = set()
    for i, t in rows:
        w = SPACE.findall(t or "")
        hit = [p for p in range(len(w) - least + 1) if len(seen[tuple(w[p : p + least])]) > 1]
        spans = []
        for p in hit:
            if spans and p <= spans[-1][1]:
                spans[-1][1] = p + least
            else:
                spans.append([p, p + least])
        copies = texts[tuple(w)]
        out |= {(i, a, b, b - a, min(copies) if len(copies) > 1 else None) for a, b in spans}
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_spans_equal_brute_force(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 75, 140, 300)]
    rows = []
    for i in range(60):
        parts = [word() for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 2)):
            cut = r.choice(passages)
            a = r.randint(0, len(cut) // 3)
            at = r.randint(0, len(parts))
            parts[at:at] = cut[a:]
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, "x " * 200), (104, " ".join(passages[4])), (105, "x " * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {tuple(x) for x in sparse_suffix.repeated_spans(docs).collect()}
    assert got == brute_spans(rows)


def test_spans_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")
    assert sparse_suffix.repeated_spans(docs).count() == 0
    assert sparse_suffix.repeated_spans(docs.limit(0)).count() == 0


def test_long_texts_and_clashing_columns(spark):
    """Two very long near copies, and columns named like the operators' own."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(120_000)]
    near = list(words)
    near[60_000] = "changed"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, "short text"), (2, " ".join(near))], "doc_id long, text string")
    for c in ("node", "token", "key", "gram", "class", "window", "place", "fragment", "salt", "n", "doc"):
        docs = docs.withColumn(c, docs.doc_id.cast("string"))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect())
    assert got == [(1, 119_996, 1), (2, 119_996, 1), (2, 119_996, 1), (3, 1, 3)]
    spans = sorted((r.doc_id, r.start_word, r.end_word, r.copy_of) for r in sparse_suffix.repeated_spans(docs).collect())
    assert spans == [(i, a, b, None) for i in (1, 2) for a, b in ((0, 60_000), (60_001, 120_000))]
