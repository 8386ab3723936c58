"""Quality rules and secret scans against plain Python on planted texts."""

import hashlib
import re

from pyspark.sql import functions as F

from loomgraph.llm import quality_rules, secret_ledger

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", "  \n", "a b c d e f g h a b c d e f g h", "x " * 40, "the " + " ".join(f"w{i}" for i in range(60)), "l1\nl1\n\n \nl1\nl2", "# * $ % & | < > é ß 漢字", "a\x0bb\x0cc\rd", "w " * 7 + "w", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 2 3 4 5 6 7 8 9",
]


def measures(text):
    words = WORD.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_measures(spark):
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(TEXTS)], "doc_id long, text string, kept boolean")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.apply_rules(docs).collect()}
    assert got == {i: measures(t) for i, t in enumerate(TEXTS)}
    verdicts = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.apply_rules(docs).collect()}
    assert verdicts[4] == (True, False) and verdicts[1] == (True, False)
    assert quality_rules.apply_rules(docs.limit(0)).count() == 0


def test_rules_on_repeated_rows_and_long_texts(spark):
    long = "alpha beta gamma delta " * 60_000 + "\n" + "end " * 3
    docs = spark.createDataFrame([(1, long), (1, long), (None, "a b"), (2, None)], "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = quality_rules.apply_rules(docs).collect()
    assert len(got) == 4 and sorted((r.n_words, r.n_repeat_words) for r in got if r.doc_id == 1) == [(240_003, 240_000)] * 2


SECRETS = [
    None, "", 'password = "abcdefgh1"', "passwd: short, token=AAAAAAAAAA", "secret: token: abcdefghijk", "API_KEY='x.y-z/0=+_' apikey:12345678", "AKIAABCDEFGHIJKL AKIA AKIAABCDEFGHIJ AKIAAKIAAKIAAKIA1", "é" * 5 + "0123456789abcdef" * 2 + "🙂" + "f" * 31, "Token = \"" + "a1" * 20 + "\"",
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "A" * 36, "toKen:=abcdefgh", "ſecret=abcdefghij", "token=" + "0123456789abcdef" * 2, "password=\npassword=longenough", "tokentoken=abcdefgh token=1234567 token=12345678",
]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KINDS = {"assign": (ASSIGN, 2, 8), "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16), "hex": (re.compile("[0-9a-f]+"), 0, 32)}


def base(text):
    out = []
    for rank, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        for m in pattern.finditer(text or ""):
            # the dotted and long forms of letters aren't ASCII letters of either case
            if len(m[group]) >= least and m[0].isascii():
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_spans(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(SECRETS)] + [(99, SECRETS[2], "clash")], "doc_id long, text string, blob string")
    found = secret_ledger.summarise(secret_ledger.report(docs, secret_ledger.update_ledger(docs)))
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(SECRETS) + 1
    for i, t in enumerate(SECRETS):
        want = base(t)
        listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(w[2] == k for w in want) for k in KINDS), t
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), t
    assert got[9].spans.startswith("private_key:0:") and got[10].spans == "github:0:40"
    assert got[99].spans == got[2].spans


def test_ledger_scans_unseen_pairs_only(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh"), (2, "plain"), (3, "plain")], "doc_id long, text string")
    first = secret_ledger.update_ledger(docs)
    assert first.count() == 2
    marked = first.withColumn("spans", F.array().cast(secret_ledger._SPAN))
    more = docs.unionByName(spark.createDataFrame([(4, "secret=12345678")], "doc_id long, text string"))
    second = secret_ledger.update_ledger(more, marked)
    assert {len(r.spans) for r in second.collect()} == {0, 1} and second.count() == 3
    third = secret_ledger.update_ledger(more, second, rules=secret_ledger.RULES[:1], version="2")
    assert third.count() == 6 and sum(len(r.spans) for r in third.where("rule_version = '2'").collect()) == 2
    # Back at the first rules nothing is scanned again: the marked blob keeps its empty finding.
    fourth = secret_ledger.update_ledger(more, third)
    assert fourth.count() == 6 and {r.doc_id: len(r.spans) for r in secret_ledger.report(more, fourth).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
    assert {r.doc_id: len(r.spans) for r in secret_ledger.report(more, fourth, "2").collect()} == {1: 1, 2: 0, 3: 0, 4: 1}


def test_ledger_of_empty_tables_long_texts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x " * 200_000 + "token=abcdefgh", "s", "b"), (1, None, "s", "b"), (None, "token=abcdefgh", "s", "b")], "doc_id long, text string, spans string, blob string")
    ledger = secret_ledger.update_ledger(docs)
    got = sorted((r.doc_id or 0, r.n_assign, r.spans) for r in secret_ledger.summarise(secret_ledger.report(docs, ledger)).collect())
    assert got == [(0, 1, "assign:0:14"), (1, 0, ""), (1, 1, "assign:400000:400014")]
    assert secret_ledger.update_ledger(docs.limit(0)).count() == 0
    assert secret_ledger.update_ledger(docs.limit(0), ledger).count() == ledger.count() == 3
    assert secret_ledger.summarise(secret_ledger.report(docs.limit(0), ledger)).count() == 0


def test_redaction_merges_overlaps(spark):
    docs = spark.createDataFrame([(1, "é token=" + "0123456789abcdef" * 2 + " end"), (2, "clean"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secret_ledger.redact(secret_ledger.report(docs, secret_ledger.update_ledger(docs))).collect()}
    assert got == {1: "é [assign] end", 2: "clean", 3: None}


def marked(text, spans):
    """The text with its spans replaced, one by one."""
    out, at = "", 0
    for start, kind, end in spans:
        if start >= at:
            out += text[at:start] + f"[{kind}]"
        at = max(at, end)
    return out + text[at:]


def test_texts_of_very_many_secrets(spark):
    many = "é ".join(f"password=abcd{i:06d} token=x " + ("0123456789abcdef" * 2 if i % 3 == 0 else "AKIA" + "B" * 14 if i % 3 == 1 else "secret=" + "ab12" * 9) for i in range(3000))
    texts = [many, "x" * 300 + many[:40_000], "no secrets " * 50_000, "token=" + "a1" * 30, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ledger = secret_ledger.update_ledger(docs)
    found = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in secret_ledger.report(docs, ledger).collect()}
    assert [(s, k, e) for s, k, e in found[0] if k in KINDS] == [(s, k, e) for s, _, k, e in base(many)] and len(found[0]) > 6000
    cut = {r.doc_id: r.text for r in secret_ledger.redact(secret_ledger.report(docs, ledger)).collect()}
    for i, text in enumerate(texts):
        assert cut[i] == (text if not found[i] else marked(text, found[i]))


def test_running_values(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        row = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(max(n, 1))), lambda x: x.cast("bigint")).alias("v")).select(F.slice("v", 1, n).alias("v"))
        got = row.select(secret_ledger._running(F.col("v"), lambda a, b: a + b)).first()[0]
        assert got == [i * (i + 1) // 2 for i in range(n + 1)]
