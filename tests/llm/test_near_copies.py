import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import near_copies as N
from codeloom.llm import simhash as S


def brute(texts):
    """Smallest number that links of a similarity of 0.8 or more reach, for each text."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    return up


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.getrandbits(40)}"
    return " ".join(words)


def test_edited_copies(spark, texts):
    rng = random.Random(4)
    items = []
    for edits in (0, 1, 2, 3, 4, 5, 6, 8, 12) * 3:
        base = [f"w{rng.randrange(3000)}" for _ in range(200)]
        items += [" ".join(base), edited(rng, base, edits)]
    docs, want = texts(*items), brute(items)
    assert 10 < sum(k != w for k, w in enumerate(want)) < 25
    for piece in (4096, 3):
        assert {r.doc_id: r.component_id for r in N.near_copies(docs, piece).collect()} == dict(enumerate(want))
    stage = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert {r.doc_id for r in stage.collect()} == set(want)


def test_dense_group_in_pieces(texts):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(150)]
    docs = texts(*(edited(rng, base, 1) for _ in range(120)))
    for piece in (4096, 20):
        assert {r.component_id for r in N.near_copies(docs, piece).collect()} == {0}


def test_a_link_that_fails_hides_no_other(texts):
    """Many texts of one group around the least similarity: whatever member of a set is asked first, each pair of 0.8 or more is
    linked, and no candidate between two components is left unchecked."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(150)]
    docs = [edited(rng, base, rng.choice((1, 2, 3, 4))) for _ in range(150)]
    want = brute(docs)
    assert len(set(want)) > 10
    for piece in (4096, 40):
        got = {r.doc_id: r.component_id for r in N.near_copies(texts(*docs), piece).collect()}
        assert got == dict(enumerate(want))


def test_odd(odd, none):
    kept = N.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == [1, 4, 5, 7, None]
    assert N.near_copies(none).count() == 0 and N.one_of_each(none).count() == 0


def test_rows_not_ids_are_copies(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text, "a"), (None, text, "b"), (3, "one text of this id", "c"), (3, "another text of this id, and no copy", "d"), (4, f"{text} more", "e"), (9, text, "f"), (None, "alone", "g"), (None, "alone", "g")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for kept in (N.one_of_each(docs), S.one_of_each(docs)):
        got = sorted(r.source for r in kept.collect())
        assert {"c", "d"} <= set(got) and got.count("g") == 1
    assert sorted(r.source for r in N.one_of_each(docs).collect()) == ["c", "d", "e", "g"]


def pairs_above(sets, share=0.8):
    """All pairs of a similarity of at least 0.8: the rarest shingles, one more than a fifth of a set, hold one in common."""
    times = Counter(x for s in sets for x in s)
    held, found = defaultdict(list), set()
    for k, s in enumerate(sets):
        for x in sorted(s, key=lambda x: (times[x], x))[: len(s) - -(-len(s) * 4 // 5) + 1]:
            for j in held[x]:
                if (j, k) not in found and 5 * (both := len(s & sets[j])) >= 4 * (len(s) + len(sets[j]) - both):
                    found.add((j, k))
            held[x].append(k)
    return found


def test_recall_on_the_given_tables(sf):
    docs = sf("documents", "sf0.1").select("doc_id", "text")
    first = {}
    for r in docs.orderBy("doc_id").collect():
        words = r.text.encode().lower().split()
        first.setdefault(frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset(), r.doc_id)
    sets, ids = list(first), list(first.values())
    wanted = {(ids[a], ids[b]) for a, b in pairs_above(sets)}
    component = {r.doc_id: r.component_id for r in N.near_copies(docs).collect()}
    hit = sum(component[a] == component[b] for a, b in wanted)
    assert len(wanted) > 40 and hit >= 0.99 * len(wanted), (hit, len(wanted))


def test_candidates_come_through_the_trees(spark, texts, monkeypatch):
    """Near copies lie within the radius of each other's fingerprints; what lies beyond is no candidate, whatever its bands."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    docs = texts(" ".join(base), edited(rng, base, 3))
    prints = [r.simhash & 0xFFFFFFFFFFFFFFFF for r in N.marks(docs).orderBy("doc_id").collect()]
    assert prints == [S.majority(N.shingles(r.text.encode())) for r in docs.orderBy("doc_id").collect()]
    assert 0 < (prints[0] ^ prints[1]).bit_count() <= N.RADIUS
    assert {r.component_id for r in N.near_copies(docs).collect()} == {0}
    classes = N.marks(docs).select("fp", "keys", "simhash", "sketch")
    assert N.candidates(classes).count() == 1
    assert N.candidates(classes.withColumn("simhash", F.when(F.col("simhash") == min(r.simhash for r in classes.collect()), F.lit(-1)).otherwise(F.lit(0)).cast("bigint"))).count() == 0


def test_radius_covers_the_similarity():
    """Pairs at the least similarity, of long and of the shortest texts: their fingerprints stay within the radius."""
    rng = np.random.default_rng(5)
    for common, own in ((4, (1, 0)), (8, (1, 1)), (8, (2, 0)), (80, (10, 10)), (400, (50, 50))):
        far = 0
        for _ in range(500):
            x = rng.integers(0, 2**64, common + sum(own), "u8")
            a, b = x[: common + own[0]], np.concatenate([x[:common], x[common + own[0] :]])
            far += (S.majority(a) ^ S.majority(b)).bit_count() > N.RADIUS
        assert far <= 1
