import zlib
from collections import Counter
from itertools import permutations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import sharding as S


def check(rows, n, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == n and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sorted((len(by.get(k, [])) for k in range(shards)), reverse=True) == [n // shards + (k < n % shards) for k in range(shards)]


def test_odd(odd, none):
    got = S.shuffled_shards(odd, 4).collect()
    check(got, odd.count(), 4)
    assert Counter(map(str, (r.row for r in got))) == Counter(map(str, odd.collect()))
    assert S.shuffled_shards(none).count() == 0
    check(S.shuffled_shards(odd, 40).collect(), odd.count(), 40)


@pytest.mark.parametrize("cell", [1, 7, 1000])
def test_cells_of_a_shard(sf, cell):
    docs = sf("documents").select("doc_id", "text").repartition(5)
    got = S.shuffled_shards(docs, 3, cell=cell).select("row.doc_id", "row.text", "shard", "slot").collect()
    check(got, 200, 3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in got} == texts
    # Neighbours do not stay neighbours.
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert sum(abs(a - b) == 1 for a, b in zip(order, order[1:])) < 12


def test_reruns_agree(sf):
    docs = sf("documents")
    pick = lambda seed: {r.doc_id: (r.shard, r.slot) for r in S.shuffled_shards(docs, seed=seed).select("row.doc_id", "shard", "slot").collect()}
    assert pick(1) == pick(1) != pick(2)


def test_query_columns(spark):
    from codeloom.llm.queries import QUERIES

    rows = QUERIES["op12_sharding"](spark, "/root/testdata/sf0.001").collect()
    check(rows, 200, 40)
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]), "rows", None) for r in rows)


def test_matrix_has_exact_margins():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 90, 37)
    sizes, per = S.cell_sizes(int(counts.sum()), 6, 50)
    matrix = np.array([S.matrix_row(np.cumsum(counts), sizes, k, 5) for k in range(37)])
    assert (matrix >= 0).all() and (matrix.sum(1) == counts).all() and (matrix.sum(0) == sizes).all() and len(sizes) == 6 * per


def test_matrix_is_that_of_a_uniform_permutation():
    """Two partitions of 2 and 3 rows and shards of 3 and 2: of the 120 orders, those with k rows of the first in the first."""
    n, seen = 4000, Counter()
    for seed in range(n):
        seen[int(S.matrix_row(np.array([2, 5]), np.array([3, 2]), 0, seed)[0])] += 1
    want = Counter(sum(x < 2 for x in order[:3]) for order in permutations(range(5)))
    chi = sum((seen[k] - n * w / 120) ** 2 / (n * w / 120) for k, w in want.items())
    assert chi < 13.8 and set(seen) == set(want)  # 0.001 at two degrees of freedom


def test_every_order_is_as_likely(spark):
    """Four rows from two partitions to two shards: all 24 orders, within five standard deviations."""
    docs = spark.range(4, numPartitions=2)
    seen = Counter()
    for seed in range(60):
        got = S.shuffled_shards(docs, 2, seed=seed).select("row.id", "shard", "slot").collect()
        seen[tuple(r.id for r in sorted(got, key=lambda r: (r.shard, r.slot)))] += 1
    firsts = Counter(o[0] for o in seen.elements())
    assert len(seen) > 14 and all(abs(firsts[k] - 15) < 5 * (60 * 3 / 16) ** 0.5 for k in range(4))


def test_large_populations(monkeypatch):
    """Inversion against numpy's draws and the exact distribution, and beyond numpy's bound."""
    monkeypatch.setattr(S, "_DRAWN", 0)
    rng = np.random.default_rng(9)
    n, seen = 20000, Counter()
    for _ in range(n):
        seen[S.hypergeometric(7, 9, 6, rng)] += 1
    want = {k: n * comb(7, k) * comb(9, 6 - k) / comb(16, 6) for k in range(7)}
    assert sum((seen[k] - w) ** 2 / w for k, w in want.items()) < 22.5
    big = [S.hypergeometric(4 * 10**9, 6 * 10**9, 10**6, rng) for _ in range(300)]
    assert abs(np.mean(big) - 400_000) < 5 * 490 / 300**0.5 and 400 < np.std(big) < 590
    cells = np.full(5, 3 * 10**9)
    got = S.drawn(cells, 10**10, rng)
    assert got.sum() == 10**10 and (np.abs(got - 2 * 10**9) < 10**6).all()


def test_shards_as_files(sf, tmp_path):
    path = S.write_shards(sf("documents"), str(tmp_path / "out"), shards=3)
    back = sf("documents").sparkSession.read.parquet(path)
    assert back.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m")).where("n <> m + 1").count() == 0 and back.count() == 200
