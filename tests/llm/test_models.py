"""Held-out accuracy of what is learned, and its corners."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import page_crf as C
from codeloom.llm import pair_ranking as R
from codeloom.llm import toxicity as T

def test_quality_held_out(sf):
    rows = R.quality_scores(sf("documents", "sf0.1"), sf("labels", "sf0.1")).select("row.doc_id", "held_out", "score")
    assert rows.count() == 10000 and rows.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    right = rows.where("held_out").join(sf("labels", "sf0.1"), "doc_id").select(((F.col("score") >= 0.7) == (F.col("quality") == 1)).cast("int").alias("r"))
    assert right.agg(F.avg("r")).first()[0] > 0.97


def fitted_by_hand(x, better, size):
    """Weights of the ranking and the gradient they leave, over the given blocks of rows."""
    w = np.zeros(size)
    for _ in range(40):
        sums = [R.newton_sums(rows, n, w) for rows, n in zip(x, better)]
        w = w - np.linalg.solve(sum(h for _, h in sums) + np.eye(size), sum(g for g, _ in sums) + w)
    return w


def test_quality_learns_from_every_labelled_document(spark):
    """Blocks hold all rows, either label in each, equal rows as often as they occur, and the ranking is that of all of them."""
    rng = np.random.default_rng(3)
    rows = [(int(k % 40 == 0), int(k), (float(rng.normal() + (k % 40 == 0)), float(rng.normal()))) for k in range(3000)]
    rows += [(0, 5000, (0.5, 0.25))] * 130
    known = spark.createDataFrame(rows, "label int, h bigint, f struct<a: double, b: double>").repartition(7)
    blocks = R.learning_blocks(known, 300, 20)
    got = [(r.better, np.frombuffer(r.x, "f8").reshape(-1, 2)) for r in blocks.collect()]
    assert len(got) == 11 and all(len(x) < 700 for _, x in got)
    ordinary = sorted(tuple(v) for n, x in got for v in x[n:])
    assert ordinary == sorted(f for label, _, f in rows if not label)
    assert {tuple(v) for n, x in got for v in x[:n]} == {f for label, _, f in rows if label} and min(n for n, _ in got) >= 10
    mean, spread = np.arange(6) / 10, np.arange(1, 7) / 2.0
    want = fitted_by_hand([(R.expanded(x) - mean) / spread for _, x in got], [n for n, _ in got], 6)
    assert np.abs(R.fit_ranking(blocks, mean, spread) - want).max() < 1e-6


def test_quality_threshold_is_that_of_all_rows(spark):
    rng = np.random.default_rng(4)
    for values, bins in ((rng.normal(size=2000), 10), (np.round(rng.normal(size=2000), 1), 7), (np.zeros(5), 10)):
        labels = (rng.random(len(values)) < 0.3).astype(int)
        share = float((labels == 0).mean())
        rows = spark.createDataFrame([(float(v), int(y)) for v, y in zip(values, labels)], "merit double, label int")
        order = sorted(values)
        k = min(round(share * len(values)), len(values) - 1)
        assert R.quantile_of(rows, share, bins) == pytest.approx((order[k] + order[max(k - 1, 0)]) / 2, abs=1e-12)
    assert R.quantile_of(rows.limit(0), 0.0) == 0.0


def held_out_hits(docs, labels):
    """(lang, toxic, share of rows predicted toxic, rows) of the held-out fold."""
    rows = T.toxicity_scores(docs, labels).select("row.doc_id", "row.lang", "held_out", (F.col("score") >= 0.5).cast("int").alias("hit"))
    assert rows.count() == docs.count()
    marked = rows.where("held_out").join(labels, "doc_id")
    return {(r.lang, r.toxic): r for r in marked.groupBy("lang", "toxic").agg(F.avg("hit").alias("hit"), F.count("*").alias("n")).collect()}


def test_toxic_held_out(sf):
    found = held_out_hits(sf("documents", "sf0.1"), sf("labels", "sf0.1"))
    for (lang, toxic), r in found.items():
        assert r.hit >= 0.8 if toxic else r.hit <= 0.05, (lang, toxic, r)
    assert {lang for lang, toxic in found if toxic} == {"en", "de", "es", "fr"}


def test_toxic_held_out_of_few(sf):
    """Some 240 labelled documents fill the models, of them some 30 toxic ones."""
    found = held_out_hits(sf("documents", "sf0.01"), sf("labels", "sf0.01"))
    share = {t: sum(r.hit * r.n for k, r in found.items() if k[1] == t) / sum(r.n for k, r in found.items() if k[1] == t) for t in (0, 1)}
    assert share[1] >= 0.8 and share[0] <= 0.05


@pytest.mark.parametrize("score, label", [(R.quality_scores, "quality"), (T.toxicity_scores, "toxic")])
def test_labels_of_the_held_out_fold_are_not_read(sf, score, label):
    docs, labels = sf("documents"), sf("labels")
    parts, out = (R.FOLDS, 2) if label == "quality" else (T.FOLDS, 0)
    turned = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == out, 1 - F.col(label)).otherwise(F.col(label)))
    pick = lambda l: sorted((r.doc_id, round(r.score, 12)) for r in score(docs, l).select("row.doc_id", "score").collect())
    assert pick(labels) == pick(turned)


@pytest.mark.parametrize("score", [R.quality_scores, T.toxicity_scores])
def test_odd(odd, none, spark, score):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 8)] + [(5, 0, 0), (None, 1, 1), (6, None, None)], "doc_id bigint, quality int, toxic int")
    for given in (labels, labels.limit(0), labels.where("toxic = 1")):
        rows = score(odd, given).select("row.doc_id", "row.lang", "score").collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert score(none, labels).count() == 0


def test_stem_counts_by_hand(spark):
    rows = spark.createDataFrame([("a bad bad b", 1), ("a good b good", 0), ("a bad", 0)], "text string, label int")
    pairs = {(r.key & 0xFFFFFFFF): (r.toxic, r.ordinary) for r in T.pair_counts(rows).where("key & 4294967295 = %d" % T.word_id("a")).collect()}
    assert pairs == {T.word_id("a"): (1, 2)}
    model = {r.id: r.value for r in T.language_models(rows, 0.5, 0.0).collect()}
    assert model[T.word_id("bad")] > 0 > model[T.word_id("good")]


def brute_model(rows, discount, floor):
    """stem -> log ratio, from (text, label), as the docstring of the models says."""
    counts, before = ({0: Counter(), 1: Counter()}, {})
    for text, label in rows:
        last = None
        for word in re.findall(r"\w+", text.lower()):
            counts[label][word[:4]] += 1
            before.setdefault(word[:4], set()).add(last)
            last = word
    n = {c: sum(counts[c].values()) for c in counts}
    left = lambda c, w: max(counts[c][w] - discount * counts[c][w] ** 0.5, 0.0)
    free = {c: n[c] - sum(left(c, w) for w in counts[c]) for c in counts}
    shared = sum(map(len, before.values()))
    p = lambda c, w: (left(c, w) + free[c] * len(before[w]) / shared) / n[c]
    ratios = {w: math.log(p(1, w) / p(0, w)) for w in before if left(0, w) + left(1, w) > 0}
    return {w: r for w, r in ratios.items() if abs(r) >= floor}


@pytest.mark.parametrize("discount, floor", [(T.DISCOUNT, T.FLOOR), (1.0, 0.0)])
def test_ratios_against_brute_force(sf, discount, floor):
    docs, labels = sf("documents"), sf("labels").withColumnRenamed("toxic", "label")
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "label")
    want = brute_model([(r.text, r.label) for r in rows.collect()], discount, floor)
    model = T.language_models(rows, discount, floor)
    got = {r.id: r.value for r in model.collect()}
    assert len(got) == len(want) > 5 and all(abs(got[T.word_id(w)] - r) < 1e-9 for w, r in want.items())
    for r in T.log_ratios(docs.select("doc_id", "text"), model).collect():
        words = [w[:4] for w in re.findall(r"\w+", r.text.lower())]
        assert abs(r.ratio - sum(want.get(w, 0.0) for w in words) / max(len(words), 1)) < 1e-6


def brute_histories(rows, discount, floor):
    """(word before or None, stem) -> log ratio, where it is evidence, as the docstring of ``history_models`` says."""
    n, before = {0: Counter(), 1: Counter()}, {}
    for text, label in rows:
        last = None
        for word in re.findall(r"\w+", text.lower()):
            n[label][last, word[:4]] += 1
            before.setdefault(word[:4], set()).add(last)
            last = word
    n[2] = n[0] + n[1]
    types = sum(map(len, before.values()))
    left = lambda k: max(k - discount * k**0.5, 0.0)
    sums, free = {c: Counter() for c in n}, {c: Counter() for c in n}
    for c in n:
        for (v, _), k in n[c].items():
            sums[c][v] += k
            free[c][v] += k - left(k)
    p = lambda c, v, w, low: (left(n[c][v, w]) + free[c][v] * low) / sums[c][v] if sums[c][v] else low
    out = {}
    for v, w in n[2]:
        if left(n[0][v, w]) + left(n[1][v, w]) > 0:
            shared = p(2, v, w, len(before[w]) / types)
            out[v, w] = math.log(p(1, v, w, shared) / p(0, v, w, shared))
    return {k: x for k, x in out.items() if abs(x) >= floor}


@pytest.mark.parametrize("discount, floor, blocks", [(T.DISCOUNT, T.FLOOR, 1), (1.0, 0.5, 3)])
def test_histories_against_brute_force(sf, spark, discount, floor, blocks):
    docs, labels = sf("documents", "sf0.01"), sf("labels", "sf0.01").withColumnRenamed("toxic", "label")
    said = [("you rat", 1), ("hey all", 1)] * 60 + [("you may", 0)] * 600  # the first words of texts count, too
    rows = docs.join(labels, "doc_id").select("text", "label").union(spark.createDataFrame(said, "text string, label int"))
    given = [(r.text, r.label) for r in rows.collect()]
    stems, pairs = brute_model(given, discount, floor), brute_histories(given, discount, floor)
    model = T.history_models(rows, discount, floor)
    assert (("you", "rat") in pairs and (None, "hey") in pairs) and model.count() == len(stems) + len(pairs)
    texts = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, "hey you rat you rat"), (-2, ""), (-3, None)], "doc_id bigint, text string"))
    for r in T.log_ratios(texts, model, -(-model.count() // blocks)).collect():
        words = re.findall(r"\w+", (r.text or "").lower())
        want = sum(pairs.get((v, w[:4]), stems.get(w[:4], 0.0)) for v, w in zip([None, *words], words))
        assert abs(r.ratio - want / max(len(words), 1)) < 1e-6


def test_the_ratio_is_that_of_all_stems(spark):
    """What the floor keeps out of the evidence counts in the ratio, and so do stems that the shared counts alone tell."""
    docs = [(k, f"{'vile gang' if k % 9 == 0 else 'kind folk'} {'some' if k % 9 == 0 or k % 3 else 'many'} here odd{k % 50}") for k in range(900)]
    docs += [(1000, "some here"), (1001, "many"), (1002, "vile new1 vile"), (1003, ""), (1004, None)]
    labels = [(k, int(k % 9 == 0)) for k in range(900)]
    learned = [(docs[k][1], y) for k, y in labels if zlib.crc32(str(k).encode()) % T.FOLDS in (1, 2, 3)]
    stems, pairs = brute_model(learned, T.DISCOUNT, 0.0), brute_histories(learned, T.DISCOUNT, 0.0)
    totals = {c: Counter(w[:4] for text, y in learned if y == c for w in text.split()) for c in (0, 1)}
    free = {c: sum(min(k, T.DISCOUNT * k**0.5) for k in totals[c].values()) / sum(totals[c].values()) for c in (0, 1)}
    alone = math.log(free[1] / free[0])
    assert any(abs(r) < T.FLOOR for r in stems.values()) and any(abs(r) < T.FLOOR for r in pairs.values()) and abs(alone) > 0.01
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = T.toxicity_scores(table, spark.createDataFrame(labels, "doc_id bigint, toxic int")).select("row.*", "ratio", "score").collect()
    for r in rows:
        words = (r.text or "").split()
        want = sum(pairs.get((v, w[:4]), stems.get(w[:4], alone)) for v, w in zip([None, *words], words))
        assert abs(r.ratio - want / max(len(words), 1)) < 1e-5, r
    assert {r.doc_id for r in rows if r.score >= 0.5 and r.text} == {*range(0, 900, 9), 1002}


def test_the_word_before_counts(spark):
    """A stem that both classes use alike is told by the word before it."""
    rows = [("you rat ran home", 1), ("the cat ran home", 1)] * 50 + [("the rat ran home", 0), ("you may run home", 0)] * 500
    rows += [("one more word of many that say nothing", k % 2) for k in range(100)]
    model = T.history_models(spark.createDataFrame(rows, "text string, label int"))
    ratio = {r.text: r.ratio for r in T.log_ratios(spark.createDataFrame([("you rat",), ("the rat",)], "text string"), model).collect()}
    assert ratio["you rat"] > 0.5 > ratio["the rat"]


def test_nothing_is_rejected_without_evidence(odd, none, spark, sf):
    labels = sf("labels")
    assert T.without_toxic(odd, labels.limit(0)).count() == odd.count() and T.without_toxic(none, labels).count() == 0
    docs = sf("documents").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (None, " . ")], "doc_id bigint, text string"))
    assert T.without_toxic(docs, labels).where("doc_id < 0 OR doc_id IS NULL").count() == 3


def test_threshold_by_hand():
    x, toxic, ordinary = np.array([0.0, 0.1, 0.4, 0.9]), np.array([0.0, 1.0, 1.0, 5.0]), np.array([50.0, 4.0, 1.0, 0.0])
    at, slope = T.fit_score(x, toxic, ordinary)
    assert abs(at - 0.65) < 1e-12 and slope > 5


def test_blocks_of_the_model_add_up(sf):
    docs, labels = sf("documents"), sf("labels").withColumnRenamed("toxic", "label")
    model = T.language_models(docs.join(labels, "doc_id"), 1.0, 0.0)
    rows = docs.select("doc_id", "text")
    assert model.count() > 300
    one, many = ({r.doc_id: round(r.ratio, 9) for r in T.log_ratios(rows, model, n).collect()} for n in (10**6, 100))
    assert one == many


def test_pairs_rank_by_feature():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 1] + 0.1 * rng.normal(size=400) > 0).astype(int)
    w = R.fit_ranking(x, y)
    assert w[1] > 3 * max(abs(w[0]), abs(w[2]))
    assert R.fit_ranking(x, np.ones(400, int)).tolist() == [0.0] * 3


def test_pages_that_mark_their_article(sf):
    pages = sf("pages", "sf0.01")
    got = {r.page_id: r for r in C.main_texts(pages).collect()}
    right = 0
    for r in pages.collect():
        blocks = C.leaf_blocks(r.html)
        text = " ".join(b.text for b, y in zip(blocks, C.plain_labels(blocks)) if y)
        right += got[r.page_id].text == text
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    assert right / pages.count() > 0.97


LAID = """<!DOCTYPE html><html><head><title>Some title &amp; site</title><script>var a = "<p>no</p>";</script></head><body>
<div class="top-menu"><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></div><div class="cookie-notice">We use cookies on this site. <button>OK</button></div>
<div class="post-content"><h1>A heading of it</h1><p>The first   paragraph, of <b>many</b> words &amp; more, stands here in full.<p>A second one follows it, with<br>a break and a <a href="#">link</a>.
<div class="advert">Buy this thing now for less money than ever.</div><p>The third one ends the article with &eacute;l&#233;gance.</p></div>
<div class="comments"><div class="comment"><p>I do not agree with what the writer says here at all.</p></div></div>
<form><label>Your name</label><p>Sign up for our letter.</p></form><footer>&copy; 2024 Some site. All rights reserved.</footer></body></html>"""


def test_another_layout(sf, spark):
    model = C.trained_field(sf("pages"))
    pages = spark.createDataFrame([(1, "u", LAID), (2, None, None), (3, "u", ""), (None, "u", "<p"), (1, "u", LAID), (4, "u", "<!-- never closed <p>x")], "page_id bigint, url string, html string")
    rows = sorted(C.main_texts(pages, model).collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert rows[0].text == (
        "A heading of it The first paragraph, of many words & more, stands here in full. A second one follows it, with a break and a link. "
        "The third one ends the article with élégance."
    ) and rows[0] == rows[1]
    assert [r.text for r in rows[2:4]] == ["", ""] and rows[4].text == ""


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert C.main_texts(none).count() == 0


def test_chain_against_all_labellings():
    rng = np.random.default_rng(4)
    f = C.Field(rng.normal(size=C.N_FEATURES), rng.normal(size=(2, 2)))
    pages = [rng.normal(size=(n, C.N_FEATURES)) for n in (1, 2, 5, 8, 0)]
    for x, y in zip(pages, f.decode(pages)):
        u = x @ f.unary
        score = lambda l: sum(u[k] for k in range(len(l)) if l[k]) + sum(f.pair[a, b] for a, b in zip(l, l[1:]))
        every = [[k >> b & 1 for b in range(len(x))] for k in range(1 << len(x))]
        assert abs(score(list(y)) - max(map(score, every))) < 1e-9
