import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codeloom.llm import mixing as M


def targets(sizes, weights=(5, 2, 1), budget=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = budget * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(docs, slack=1.0):
    rows = M.entropy_mix(docs).select("row.*", F.col("size").alias("n_size"), "source_size", "target", "rate", "copies").collect() if "size" not in docs.columns else M.entropy_mix(docs).select(
        "row.doc_id", "row.text", "row.source", F.col("size").alias("n_size"), "source_size", "target", "rate", "copies").collect()
    assert len(rows) == docs.count()
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.n_size == n and 0 <= r.copies <= 2
        sizes[r.source] += n
        taken[r.source] += n * r.copies
        longest[r.source] = max(longest[r.source], n)
    want = targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= slack * longest[s] + 1, (s, taken[s], want[s])
    return {(r.doc_id, r.text): r.copies for r in rows}


def test_given_tables(sf):
    docs = sf("documents", "sf0.01")
    assert check(docs) == check(docs.repartition(7))


def test_rates_solve_the_dual(sf):
    rows = M.entropy_mix(sf("documents", "sf0.01"))
    sums = rows.groupBy("row.source").agg(F.sum(F.col("rate") * F.col("size")).alias("got"), F.first("target").alias("want"))
    assert all(r.got == pytest.approx(r.want, rel=1e-5) for r in sums.collect())


def test_odd(odd, none):
    check(odd)
    assert M.entropy_mix(none).count() == 0
    mixed = M.mixed_copies(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0 and M.mixed_copies(none).count() == 0


def test_hot_cells(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "'one two three' AS text", "if(id % 3 = 0, 'b', concat('c', id % 7)) AS source")
    check(docs)
