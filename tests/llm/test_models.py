"""The trained operators: held-out accuracy, defined results for odd rows, and their parts against plain forms."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import html_blocks, language_mixture, quality_kernel, soft_mixing
from loomgraph.llm.common import held_out

SF = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_fold(spark):
    got = spark.range(300).withColumnRenamed("id", "doc_id").select("doc_id", held_out().alias("h")).collect()
    assert all(r.h == held(r.doc_id) for r in got)
    assert spark.sql("select cast(null as bigint) as doc_id").select(held_out().alias("h")).first().h is False


def test_language_accuracy(spark, documents):
    got = {r.doc_id: r for r in language_mixture.query(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect() if held(r.doc_id)}
    assert np.mean([got[i].lang_pred == lang for i, lang in truth.items()]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_odd_texts(spark, documents):
    model = language_mixture.train(documents)
    texts = [None, "", "123 ... 45", "ë", "the and of " * 20 + "der die und " * 20, "the of and " * 30_000]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1, "", "y")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in language_mixture.predict(rows, model).collect()}
    assert [(got[i].lang_pred, got[i].score) for i in range(3)] == [("und", 0.0)] * 3
    assert got[3].lang_pred != "und" and set(got[4].languages) == {"en", "de"} and got[5].lang_pred == "en"
    assert language_mixture.predict(rows.limit(0), model).count() == 0
    empty = language_mixture.train(documents.limit(0))
    assert language_mixture.predict(rows, empty).where("lang_pred <> 'und'").count() == 0


def spoken(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(n))


def test_sets_of_many_languages_and_of_rare_ones(spark):
    import random

    r = random.Random(5)
    # 70 languages, each of an alphabet of its own; the last ones have the fewest documents.
    alphabets = ["".join(chr(0x4E00 + 40 * i + j) for j in range(6)) for i in range(70)]
    rows = [(spoken(r, a, 900), f"l{i:02}") for i, a in enumerate(alphabets) for _ in range(2 if i < 66 else 1)]
    model = language_mixture.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == [f"l{i:02}" for i in range(70)]
    mixed = " ".join(spoken(r, alphabets[i], 60) for i in (1, 2, 3, 4, 68))
    rare, five = model.infer([f" {spoken(r, alphabets[69], 40)} ", f" {mixed} "])
    assert rare[0] == "l69" and set(rare[2]) == {"l69"}
    assert set(five[2]) == {"l01", "l02", "l03", "l04", "l68"} and all(abs(x - 0.2) < 0.03 for x in five[2].values())
    assert five[1] < 0.25 < five[3]


def test_trigram_counts_equal_a_plain_count():
    texts = [" ab,, c1 é ", " ", " aaaa a ", " ß! "]
    owner, bucket, count = language_mixture.trigrams(texts)
    for i, t in enumerate(texts):
        folded = "".join(c.lower() if c.isalpha() else " " for c in t)
        folded = " ".join(x for x in folded.split(" ") if x)
        n = sum(folded_[1] != " " for folded_ in zip(f" {folded} ", f" {folded} "[1:], f" {folded} "[2:])) if folded else 0
        assert count[owner == i].sum() == n


def test_isotonic_pooling_equals_the_least_squares_search():
    r = np.random.default_rng(0)
    for _ in range(20):
        v, w = r.integers(0, 4, 5) / 3, r.integers(1, 4, 5).astype(float)
        got = quality_kernel.pool(v, w)
        assert (np.diff(got) >= -1e-12).all()
        grid = sorted({round(float(np.average(v[a:b], weights=w[a:b])), 12) for a, b in itertools.combinations(range(6), 2)})
        best = min(((v - np.array(c)) ** 2 @ w for c in itertools.combinations_with_replacement(grid, 5)))
        assert (v - got) ** 2 @ w == pytest.approx(best, abs=1e-9)


def test_quality_accuracy(spark, labels):
    got = {r.doc_id: r for r in quality_kernel.query(spark, SF).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect() if held(r.doc_id)}
    assert np.mean([got[i].predicted == q for i, q in truth.items()]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == held(r.doc_id) for r in got.values())


def test_normal_equations_dont_depend_on_partitions(spark, documents, labels):
    rows = quality_kernel.measured(documents.limit(200)).join(labels, "doc_id").select("x", F.col("quality").alias("y"), (F.col("doc_id") % 4).cast("int").alias("fold"))
    a, b = quality_kernel.train(rows.coalesce(1)), quality_kernel.train(rows.repartition(5))
    assert np.allclose(a.weights, b.weights, atol=1e-6)


def test_classifier_equals_one_dense_fit(spark, documents, labels):
    """Weights by one least-squares solve, and the calibration by pooling the raw scores that the other folds taught."""
    rows = quality_kernel.measured(documents.limit(300)).join(labels, "doc_id").select("x", F.col("quality").alias("y"), (F.col("doc_id") % 4).cast("int").alias("fold"))
    model = quality_kernel.train(rows)
    data = rows.toPandas()
    z, y, fold = model.features(np.stack(data.x)), data.y.values.astype(float), data.fold.values

    def ridge(use):
        root = np.sqrt(quality_kernel.RIDGE * use.sum()) * np.eye(z.shape[1])[1:]
        return np.linalg.lstsq(np.vstack((z[use], root)), np.concatenate((y[use], np.zeros(len(root)))), rcond=None)[0]

    assert np.allclose(z @ ridge(np.ones(len(y), bool)), z @ model.weights, atol=1e-4)
    raw = np.array([z[i] @ ridge(fold != fold[i]) for i in range(len(y))])
    cell = np.clip(np.floor((raw + 0.5) * 256), 0, 511)
    at = np.unique(cell)
    mean = [y[cell == c].mean() for c in at]
    values = quality_kernel.pool(np.array(mean), np.array([(cell == c).sum() for c in at], float))
    want = np.clip(np.interp(z @ model.weights, (at + 0.5) / 256 - 0.5, values), 0, 1)
    assert np.mean(np.abs(want - model.score(np.stack(data.x))) < 0.02) > 0.98


def test_quality_of_odd_rows(spark, labels):
    docs = spark.createDataFrame([(1, None, 3.0), (1, None, 3.0), (2, "", 3.0), (None, "some words here", 3.0)], "doc_id long, text string, score double")
    got = quality_kernel.classify(docs, labels.limit(0)).collect()
    assert len(got) == 4 and all(r.score == 0.5 for r in got)
    assert quality_kernel.classify(docs.limit(0), labels).count() == 0


def test_mixing_meets_its_targets(spark, documents, labels):
    got = soft_mixing.mix(documents, labels).toPandas()
    p = got[["p_clean", "p_low", "p_toxic"]].values
    assert np.allclose(p.sum(axis=1), 1) and (got.rate >= 0).all()
    t = got.n_tokens.values[:, None] * p
    have, mixed = t.sum(axis=0), (t * got.rate.values[:, None]).sum(axis=0)
    goal = np.array([soft_mixing.WEIGHTS[d] for d in soft_mixing.DOMAINS])
    goal = goal * have[0] / goal[0] * soft_mixing.HEADROOM
    assert np.abs(mixed - goal).max() < 0.01 * goal.sum()
    assert ((got.copies == np.floor(got.rate)) | (got.copies == np.floor(got.rate) + 1)).all()


def test_mixing_solution_equals_a_dense_solver(spark):
    r = np.random.default_rng(3)
    p = r.dirichlet([1, 1, 1], 60)
    n = r.integers(1, 50, 60)
    rows = spark.createDataFrame([(int(k), *map(float, x)) for k, x in zip(n, p, strict=True)], "n_tokens long, p_clean double, p_low double, p_toxic double")
    targets = {"clean": 500.0, "low": 100.0, "toxic": 200.0}
    steps, met = soft_mixing.solve(rows, targets=targets)
    assert met
    rate = np.ones(60)
    for s in steps:
        rate = np.maximum(0, rate - p @ s)
    assert np.allclose((n[:, None] * p * rate[:, None]).sum(axis=0), list(targets.values()), rtol=1e-3)


def test_targets_that_no_rate_can_meet_are_reported(spark):
    rows = spark.createDataFrame([(10, 1.0, 0.0, 0.0), (30, 0.5, 0.5, 0.0)], "n_tokens long, p_clean double, p_low double, p_toxic double")
    steps, met = soft_mixing.solve(rows, targets={"clean": 5.0, "low": 40.0, "toxic": 0.0})
    assert not met
    assert soft_mixing.solve(rows, targets={"clean": 25.0, "low": 15.0, "toxic": 0.0})[1]
    assert soft_mixing.solve(rows.limit(0))[0] == []


def test_posteriors_and_rates_equal_a_plain_computation(spark):
    """The whole operator against loops over a small fixture: chi-squared features, softmax optimum, rates at the targets."""
    r = np.random.default_rng(8)
    words = {0: ["calm", "clear", "river"], 1: ["spam", "click", "win"], 2: ["vile", "hate", "foul"]}
    rows, marks = [], []
    for i in range(240):
        d = i % 3
        picked = [words[d][k] if r.random() < 0.7 else r.choice(["the", "of", "and", "to"]) for k in r.integers(0, 3, 12)]
        rows.append((i, " ".join(picked)))
        marks.append((i, int(d != 1), int(d == 2)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = soft_mixing.train(docs, labels)
    hasher = soft_mixing.WordHasher()
    taught = [(set(soft_mixing.features(t, hasher)[1]), 2 if marks[i][2] else 1 if not marks[i][1] else 0) for i, t in rows if not held(i)]
    n = len(taught)
    chosen = []
    for f in sorted(set().union(*(x for x, _ in taught))):
        chi = 0.0
        for d in range(3):
            for has in (True, False):
                seen = sum(1 for x, y in taught if (f in x) == has and y == d)
                want = sum(1 for x, _ in taught if (f in x) == has) * sum(1 for _, y in taught if y == d) / n
                chi += (seen - want) ** 2 / max(want, 1e-9)
        if chi > soft_mixing.SIGNIFICANT:
            chosen.append(f)
    assert list(model.kept) == chosen
    # At the optimum of the penalised likelihood the gradient is zero; and the posteriors are its plain softmax.
    x = np.array([[f in s for f in chosen] for s, _ in taught], float)
    y = np.eye(3)[[d for _, d in taught]]
    z = model.prior + x @ model.weight
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    spread = np.maximum(np.sqrt(x.mean(axis=0) * (1 - x.mean(axis=0))), 0.01)
    slope = ((x - x.mean(axis=0)) / spread).T @ (p - y) / n + soft_mixing.RIDGE * model.weight * spread[:, None]
    assert np.abs(slope).max() < 5e-3 and np.abs((p - y).mean(axis=0)).max() < 5e-3
    got = {r.doc_id: r for r in soft_mixing.mix(docs, labels).collect()}
    for i, t in rows:
        own = np.array([f in set(soft_mixing.features(t, hasher)[1]) for f in chosen], float)
        q = np.exp(model.prior + own @ model.weight)
        assert np.allclose([got[i].p_clean, got[i].p_low, got[i].p_toxic], q / q.sum(), atol=1e-9)
        assert got[i].n_tokens == len(t.split()) and got[i].met
    tokens = np.array([got[i].n_tokens * got[i].rate * np.array([got[i].p_clean, got[i].p_low, got[i].p_toxic]) for i, _ in rows]).sum(axis=0)
    assert np.allclose(tokens / tokens.sum(), [soft_mixing.WEIGHTS[d] for d in soft_mixing.DOMAINS], atol=2e-3)


def test_mixing_of_odd_rows(spark, labels):
    docs = spark.createDataFrame([(1, None, "n"), (2, "", "n"), (2, "", "n"), (None, "a b", "n")], "doc_id long, text string, rate string")
    long = spark.createDataFrame([(7, "word " * 300_000)], "doc_id long, text string")
    assert soft_mixing.mix(long, labels.limit(0)).first().n_tokens == 300_000
    got = soft_mixing.mix(docs, labels.limit(0)).collect()
    assert len(got) == 4 and all(abs(r.p_clean - 1 / 3) < 1e-9 for r in got)
    assert soft_mixing.mix(docs.limit(0), labels).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>no</title><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Logo</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies here.</p></div>
<article><h1>Caf&eacute; &amp; tea</h1><p>First   para<br>graph with <b>bold</b> words, and some more of them to read.</p>
<div class="ad"><p>Buy this now.</p></div><p>Second paragraph follows, with a few more words in it.<p>Third&nbsp;one is short.</article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">Other story</a></li></ul></aside>
<div class="comments"><h3>Comments</h3><div class="comment"><p>I liked it a lot, thank you.</p></div></div>
<form><label>Email</label><input name="e"><button>Subscribe</button></form><footer>&copy; 2024 Site</footer></body></html>"""


def test_page_by_hand():
    text = html_blocks.main_texts([PAGE], html_blocks.trained())[0]
    assert text == "Café & tea\n\nFirst para graph with bold words, and some more of them to read.\n\nSecond paragraph follows, with a few more words in it.\n\nThird one is short."


def test_labeller_on_made_up_pages():
    import random

    r = random.Random(12345)
    model, right, total = html_blocks.trained(), 0, 0
    for _ in range(150):
        f, y = html_blocks.labelled(*html_blocks.made_up_page(r))
        if f:
            right += int(((model.chance([f])[0] >= 0.5) == (y > 0.5)).sum())
            total += len(y)
    assert right / total > 0.97


def test_gradients_equal_differences():
    model = html_blocks.Labeller(3)
    r = np.random.default_rng(1)
    model.w = {k: (r.standard_normal(v.shape) * 0.3).astype(np.float64) for k, v in model.w.items()}
    pages = [[[(1, 1.0), (5, 0.5)], [(2, 1.0)], [(3, 0.25), (3, 1.0)]], [[(4, 1.0)]]]
    labels = np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        p = np.concatenate(model.chance(pages))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    got = model.gradients(pages, labels)
    for key, at in (("uf", (2, 7)), ("ub", (1, 40)), ("ef", (5, 9)), ("eb", (3, 50)), ("o", (4,)), ("cf", (20,))):
        step = 1e-3
        model.w[key][at] += step
        up = loss()
        model.w[key][at] -= 2 * step
        down = loss()
        model.w[key][at] += step
        assert got[key][at] == pytest.approx((up - down) / (2 * step), rel=0.02, abs=1e-4)


@pytest.mark.parametrize(("html", "want"), [
    ("<html><head><title>t</title><p>text one two</p>", ["text one two"]),
    ("<head><meta charset=x><title>t</title>bare text<p>more", ["bare text", "more"]),
    *((f"<body><div><{tag}><p>inside</p><div>also</div></div><p>after</p>", ["after"]) for tag in ("video", "object", "canvas", "audio", "svg", "iframe")),
    ("<body><p>before<video></video><p>after</video></p>", ["before", "after"]),
    ("<head><style>x{}</style></head><body><template><p>no</p></template><p>yes</p>", ["yes"]),
])
def test_unclosed_elements_end_where_they_must(html, want):
    assert [b.text for b in html_blocks.blocks(html)] == want


def test_every_word_name_and_ancestor_counts():
    lead = " ".join(f"lead{chr(97 + i)}" for i in range(20)) + "x " * 300
    a, b = (html_blocks.features(html_blocks.blocks(f"<p>{lead} {w}</p>"))[0] for w in ("cookies", "mountain"))
    assert a != b and sum(w for x, w in a) == pytest.approx(sum(w for x, w in b))
    deep = html_blocks.blocks("<aside class='a b c d e f g h i outer'>" + "<ol><li><article><div>" * 40 + "reply")
    assert {"aside", "outer"} <= set(deep[0].path)
    assert html_blocks.blocks("<div class=x>" * 3000 + "deep")[0].path == ("div", "x")


def plain_chance(model, page):
    """The labeller's formulas in loops over one page, block by block and unit by unit."""
    import math

    sig = lambda v: 1 / (1 + math.exp(-v))
    h, sides = html_blocks.HIDDEN, {}
    for d in "fb":
        state, cell, states = [0.0] * h, [0.0] * h, []
        for bag in page if d == "f" else page[::-1]:
            z = [sum(model.w[f"e{d}"][model.place[x], k] * w for x, w in bag) + model.w[f"c{d}"][k] + sum(state[m] * model.w[f"u{d}"][m, k] for m in range(h)) for k in range(4 * h)]
            cell = [sig(z[h + k]) * cell[k] + sig(z[k]) * math.tanh(z[3 * h + k]) for k in range(h)]
            state = [sig(z[2 * h + k]) * math.tanh(cell[k]) for k in range(h)]
            states.append(state)
        sides[d] = states if d == "f" else states[::-1]
    return [sig(sum(model.w["o"][k] * sides["f"][t][k] + model.w["o"][h + k] * sides["b"][t][k] for k in range(h)) + model.w["ob"][0]) for t in range(len(page))]


def test_query_equals_a_plain_labeller(spark):
    """op1's rows against blocks labelled by loops, on the first pages of the table."""
    model = html_blocks.trained()
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(6)
    html = {r.page_id: r.html for r in pages.collect()}
    for r in html_blocks.extract(pages).collect():
        page = html_blocks.blocks(html[r.page_id])
        chance = plain_chance(model, html_blocks.features(page)) if page else []
        assert r.text == "\n\n".join(b.text for b, c in zip(page, chance, strict=True) if c >= 0.5)


def test_pages_of_odd_html(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "just text"), (4, "u", "<p>a<p>b</div></article>"), (5, "u", "<div" * 500), (6, "u", "<script>x</script>"), (None, "u", "<article><p>" + "word " * 50_000), (1, "u", None)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = html_blocks.extract(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (1, 2, 6)] == ["", "", "", ""]
    assert html_blocks.extract(pages.limit(0)).count() == 0


def test_articles_of_the_table(spark):
    import duckdb

    rows = dict(duckdb.sql(f"select page_id, html from '{SF}/pages.parquet'").fetchall())
    hit = total = 0
    for r in html_blocks.query(spark, SF).collect():
        want = "\n\n".join(b.text for b in html_blocks.blocks(rows[r.page_id]) if "article" in b.path)
        hit += r.text == want
        total += 1
    assert hit / total > 0.93


def test_articles_of_pages_written_by_hand():
    from tests.llm.article_pages import PAGES, article

    assert html_blocks.main_texts([p for p, _ in PAGES], html_blocks.trained()) == [article(a) for _, a in PAGES]


def test_long_pages_are_read_in_windows(monkeypatch):
    r, model = random.Random(8), html_blocks.Labeller(4)
    for k in model.w:
        model.w[k] = np.random.default_rng(1).standard_normal(model.w[k].shape) * 0.3
    page = html_blocks.blocks("".join(html_blocks.made_up_page(r)[0].split("<body>")[1] for _ in range(12)))
    assert len(page) > 100
    whole = model.chance([html_blocks.features(page, model.taught())])[0]
    for window in (7, 64, 10_000):
        assert np.allclose(model.chance_of_long(page, model.taught(), window), whole, atol=1e-9)
    html = "<article>" + "<p>One more line of the story.</p>" * 300 + "</article><footer>Imprint</footer>"
    short = html_blocks.main_texts([html], model)
    monkeypatch.setattr(html_blocks, "WINDOW", 50)
    assert html_blocks.main_texts([html], model) == short


def test_letters_of_all_planes_have_trigrams():
    far = "".join(chr(c) for c in range(0x10000, 0x110000, 7) if chr(c).isalpha() and c >= 0x32000)
    assert len(far) > 50
    doc, _, count = language_mixture.trigrams([f" {far} "])
    assert len(doc) and count.sum() >= len(far) - 2
    upper, lower = (language_mixture.trigrams([f" {x} "]) for x in ("\U00010400\U00010401\U00010402", "\U00010428\U00010429\U0001042a"))
    assert all(np.array_equal(a, b) for a, b in zip(upper, lower, strict=True))
