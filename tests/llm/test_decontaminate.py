import random

from codeloom.llm import decontaminate as D


def brute(docs, items):
    found = set()
    for d, t in docs:
        w = D.WORD.findall((t or "").lower())
        for i, u in items:
            v = D.WORD.findall((u or "").lower())
            if len(v) < D.FEWEST:
                if v and (w == v if len(v) < D.ALONE else any(w[k : k + len(v)] == v for k in range(len(w)))):
                    found.add((d, i))
                continue
            for line in range(-len(v) + 1, len(w)):
                best = run = equal = kept = 0
                for k in range(max(0, -line), min(len(v), len(w) - line)):
                    same = w[k + line] == v[k]
                    run += 1 if same else -D.COST
                    equal += same
                    if run < 0:
                        run = equal = 0
                    if run > best:
                        best, kept = run, equal
                if kept >= max(D.FEWEST, min(D.ENOUGH, -(-4 * len(v) // 5))):
                    found.add((d, i))
    return found


def test_given_tables(sf):
    docs, items = sf("documents"), sf("benchmark")
    got = {(r.doc_id, r.item_id) for r in D.overlaps(docs, items).collect()}
    assert got and got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_substitutions(spark, texts):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(5000)]
    item = [rng.choice(words) for _ in range(40)]
    around = lambda: " ".join(rng.choice(words) for _ in range(50))
    swapped = lambda n, at: [f"new{k}" if k % n == at else w for k, w in enumerate(item)]
    docs = texts(
        f"{around()} {' '.join(item)} {around()}", f"{around()} {' '.join(swapped(5, 2))}.", f"{' '.join(swapped(6, 1)).upper()} {around()}",
        f"{around()} {' '.join(item[:7])} {around()}", around(), f"{around()}, {' '.join(item[10:30])}! {around()}", " ".join(swapped(2, 0)),
    )
    items = spark.createDataFrame([(1, " ".join(item)), (2, "too short to tell"), (3, None), (None, " ".join(item))], "item_id bigint, text string")
    got = D.overlaps(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in (0, 1, 2, 5) for i in (1, None)}
    assert {(r.first, r.n_words, r.n_equal) for r in got if r.doc_id == 0} == {(50, 40, 40)}


def test_every_third_and_fourth_word_replaced(spark, texts):
    item = [f"w{k}" for k in range(40)]
    swapped = lambda n, at: " ".join(f"new{k}" if k % n == at else w for k, w in enumerate(item))
    docs = texts(*(f"before {swapped(n, at)} after" for n in (3, 4) for at in range(n)), swapped(2, 1))
    items = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    got = {r.doc_id: r.n_equal for r in D.overlaps(docs, items).collect()}
    assert set(got) == set(range(7)) and min(got.values()) >= 26


def test_odd(odd, none, sf):
    items = odd.selectExpr("doc_id AS item_id", "text")
    got = {(r.doc_id, r.item_id) for r in D.overlaps(odd, items).collect()}
    assert got == {(None, None), (4, 4), (5, 5), (5, 6), (6, 5), (6, 6), (7, 7)}
    left = odd.where("doc_id < 4")  # no words
    assert D.without_leaks(odd, items).collect() == left.collect()
    assert D.without_leaks(odd, items).columns == odd.columns
    assert D.overlaps(none, items).count() == 0 and D.without_leaks(odd, items.limit(0)).count() == odd.count()


def test_short_items(spark, texts):
    docs = texts("one two three four five six", "before One, two three four five six after", "one two three four five, seven six", "two words", "these two words", "two words more", "")
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "two words"), (3, "four five six after"), (4, ".")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.first, r.n_words, r.n_equal) for r in D.overlaps(docs, items).collect()}
    assert got == {(0, 1): (0, 6, 6), (1, 1): (1, 6, 6), (3, 2): (0, 2, 2), (1, 3): (4, 4, 4)}


def test_rows_not_ids_leak(spark):
    item = " ".join(f"k{k}" for k in range(20))
    rows = [(None, item, "a"), (None, "clean text without an id", "b"), (7, f"x {item}", "c"), (7, "another text of that id", "d"), (8, None, "e"), (8, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    items = spark.createDataFrame([(0, item)], "item_id bigint, text string")
    assert sorted(r.source for r in D.without_leaks(docs, items).collect()) == ["b", "d", "e", "e"]


def test_hot_item(spark):
    item = " ".join(f"k{k}" for k in range(30))
    docs = spark.range(3000).selectExpr("id AS doc_id", f"concat('d', id, ' {item} ', id) AS text")
    items = spark.createDataFrame([(0, item)], "item_id bigint, text string")
    assert D.overlaps(docs, items).count() == 3000
