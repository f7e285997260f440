import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from codeloom.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    """``docs`` (doc_id, text) and ``items`` (item_id, text) as the contract says."""
    held = [(d, terms(t)) for d, t in docs]
    sizes = [len(t) for _, t in held if t]
    n_docs, n_terms = len(sizes), sum(sizes)
    counts = [(d, len(t), Counter(t)) for d, t in held]
    df = Counter(t for _, _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        scored = []
        for d, n, c in counts:
            m = 10 + (90 * n * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("block_terms", [10**6, 40])
def test_against_brute_force(spark, block_terms, monkeypatch):
    monkeypatch.setattr(L, "CELLS", 4000)
    rng = random.Random(1)
    words = [f"W{k}é"[: 2 + k % 3] + str(k) for k in range(60)]
    text = lambda n: " ".join(words[min(int(rng.expovariate(0.08)), 59)] for _ in range(n))
    docs = [(k, text(rng.randrange(0, 120))) for k in range(400)]
    docs += [(1000 + k, docs[5][1]) for k in range(50)]  # copies tie
    items = [(k, text(rng.randrange(0, 30))) for k in range(25)] + [(30, items_text := text(20)), (31, items_text), (32, "nothing of it")]
    assert rows_of(L.search(*tables(spark, docs, items), block_terms=block_terms)) == brute(docs, items)


def test_odd(spark, odd, none):
    items = [(1, "text same_words"), (None, "without an ID"), (2, None), (3, ""), (4, "..."), (1, "中文 HERE"), (5, "Kſ é \x7f \x00")]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    assert rows_of(L.search(odd, asked)) == brute([(r.doc_id, r.text) for r in odd.collect()], items)
    assert L.search(none, asked).count() == 0 and L.search(odd, asked.limit(0)).count() == 0
    assert L.search(odd, asked.where("item_id IN (2, 3, 4)")).columns == ["item_id", "rank", "doc_id", "score"]


def test_given_tables(sf):
    docs, items = sf("documents"), sf("benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows_of(L.search(docs, items)) == want


def leaves(parts, sets):
    out = []
    for p in parts:
        out += [p] if p >= 0 else leaves(sets[-1 - p], sets)
    return out


@pytest.mark.parametrize("mined", [64, 3])
def test_parts_add_up_to_the_terms(mined):
    rng = random.Random(mined)
    items = [{min(int(rng.expovariate(0.1)), 80) for _ in range(rng.randrange(0, 40))} for _ in range(80)]
    items += [items[3], items[3] | {99}, set(range(200, 260)), set(range(200, 250))]
    sets, parts = L.mine(items, mined)
    for held, wanted in zip(parts, items, strict=True):
        got = leaves(held, sets)
        assert sorted(got) == sorted(wanted)  # each once
    additions = sum(len(p) - 1 for p in [*sets, *parts] if p)
    assert additions < (0.8 if mined > 3 else 0.9) * sum(len(i) - 1 for i in items if i)
    # A set is used twice at least, and only sets before it are its parts.
    uses = Counter(p for held in [*sets, *parts] for p in held if p < 0)
    assert all(uses[-1 - k] > 1 and all(p >= 0 or -1 - p < k for p in held) for k, held in enumerate(sets))


def test_accumulators_hold_each_set_once():
    plan = L.Accumulators(np.array([3, 5, 7]), [[0, 1]], [[-1], [-1, 2], [2]], 10, 100)
    n, owners, ids, tfs = np.array([10, 20]), np.array([0, 0, 1, 1]), np.array([0, 2, 1, 2]), np.array([1, 2, 1, 4])
    part = lambda w, tf, n: w * (10**9 * tf // (1000 * tf + 8 * (10 + 90 * n * 10 // 100)))
    assert plan.scores(n, owners, ids, tfs).tolist() == [
        [part(3, 1, 10), part(5, 1, 20)], [part(3, 1, 10) + part(7, 2, 10), part(5, 1, 20) + part(7, 4, 20)], [part(7, 2, 10), part(7, 4, 20)],
    ]


def test_terms():
    for text in ("A_b-c é9Z", "", "ÀÉ K\x7fk 中 文x", "\x85\xa0 a b"):
        assert [t.decode() for t in L.terms(text.encode())] == terms(text)
