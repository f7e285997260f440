import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from codeloom.llm import merkle as M


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in M.COLUMNS))


def up(nodes):
    return [H(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]


def proof(nodes, k):
    """Siblings before and after, level by level, and what they lead to."""
    out = []
    while len(nodes) > 1:
        run = nodes[k // 16 * 16 :][:16]
        out.append((run[: k % 16], run[k % 16 + 1 :]))
        nodes, k = up(nodes), k // 16
    return out, nodes[0]


def brute(rows, received):
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), leaf({**r, "text": received(r)})))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [sorted(sources[s]) for s in names]
    subroots = [proof([x[2] for x in t], 0)[1] for t in trees]
    out = []
    for at, tree in enumerate(trees):
        for k, (known, doc_id, node, got) in enumerate(tree):
            own, subroot = proof([x[2] for x in tree], k)
            top, root = proof(subroots, at)
            for before, after in own + top:
                got = H(*before, got, *after)
            told = H(*(d for before, after in own + top for d in before + after))
            out.append((doc_id if known else None, names[at], node, subroot, root, told, got, got == root))
    return sorted(out, key=str)


def rows_of(df):
    names = ("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def capitals(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("depth", [1, 2])
def test_against_a_loop(spark, depth):
    rng = random.Random(depth)
    sizes = {None: 3, "": 1, "a": 16, "b": 17, "B": 700, "é": 257, "z": 1, **{f"s{k}": 2 for k in range(30)}}
    rows = [(k, f"Text {rng.random()} É", None if k % 5 else "de", s, rng.choice([None, 4])) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    hit = lambda r: r["doc_id"] % 3 == 0
    got = M.merkle_manifest(docs, {"text": F.when(F.col("doc_id") % 3 == 0, M.lower_ascii(F.col("text"))).otherwise(F.col("text"))}, depth=depth)
    want = brute([r.asDict() for r in docs.collect()], lambda r: capitals(r["text"]) if hit(r) else r["text"])
    assert rows_of(got) == want
    assert {w[0] for w in want if not w[-1]} == {k for k, *_ in rows if k % 3 == 0}


def test_odd(odd, none):
    got = M.merkle_manifest(odd, M.lowered_fifth(odd))
    rows = [r.asDict() for r in odd.collect()]
    assert rows_of(got) == brute(rows, lambda r: r["text"])  # nothing that is turned to lower case holds capitals
    assert M.merkle_manifest(none).count() == 0
    alone = M.merkle_manifest(odd.where("doc_id = 7")).first()
    assert alone.leaf == alone.subroot == alone.root == alone.folded_root and alone.proof_sha256 == H() and alone.verified


def test_rows_of_one_id_only(spark):
    docs = spark.range(3000).selectExpr("cast(null AS bigint) AS doc_id", "concat('t', id % 7) AS text", "'l' AS lang", "'s' AS source", "1L AS n_chars")
    got = M.merkle_manifest(docs)
    assert rows_of(got) == brute([r.asDict() for r in docs.collect()], lambda r: r["text"])


def test_proofs_lead_to_the_root(sf):
    docs = sf("documents")
    row = M.merkle_manifest(docs, proofs=True).where("doc_id = 41").first()
    assert H(*row.proof) == row.proof_sha256 and row.verified and row.n_rows > row.pos


def test_tampered_rows_only_fail(sf):
    docs = sf("documents")
    rows = M.merkle_manifest(docs, M.lowered_fifth(docs)).select("doc_id", "verified")
    lowered = docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("hit"), (F.col("text") != M.lower_ascii(F.col("text"))).alias("more"))
    assert rows.join(lowered, "doc_id").where("verified = (hit AND more)").count() == 0


def test_no_superblock_is_larger(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'t' AS text", "'l' AS lang", "'s' AS source", "1L AS n_chars")
    rows = M.merkle_manifest(docs)
    assert rows.selectExpr("max(pos)", "max(n_rows)").first() == (4999, 5000)
    assert rows.groupBy(F.floor(F.col("pos") / 256)).count().agg(F.max("count")).first()[0] == 256
