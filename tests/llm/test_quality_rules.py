import math
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from codeloom.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    at = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if at[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def buckets(text):
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in WORD.findall(text or "")]
    # Spark hashes several columns in turn, each with the hash before as its seed.
    step = lambda x, seed: xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), seed % (1 << 64))
    pairs = [signed(step(b, step(a, 42))) for a, b in zip(h, h[1:])]
    return [x % Q.BUCKETS for x in h + pairs]


def brute(docs, trusted):
    raw, good = Counter(), Counter()
    for d, t in docs:
        raw.update(buckets(t))
        if d in trusted:
            good.update(buckets(t))
    n, m = sum(raw.values()), sum(good.values())
    weight = lambda b: math.log((good[b] + 1) / (m + Q.BUCKETS)) - math.log((raw[b] + 1) / (n + Q.BUCKETS))
    return {(d, t): (sum(map(weight, buckets(t))) / len(buckets(t)) if buckets(t) else 0.0) for d, t in docs}


def check(docs, trusted):
    got = Q.quality_rules(docs, trusted).select("row.doc_id", "row.text", *"n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed ratio kept".split()).collect()
    ids = {r[0] for r in trusted.collect()}
    want = brute([(r.doc_id, r.text) for r in got], ids)
    for r in got:
        assert tuple(r[2:8]) == base(r.text), r.doc_id
        assert abs(r.ratio - want[r.doc_id, r.text]) < 1e-9
        assert r.kept == (not r.base_failed and r.ratio >= Q.LEAST_RATIO)
    return got


def test_given_tables(sf):
    docs = sf("documents")
    assert len(check(docs, Q.trusted_ids(sf("labels")))) == docs.count()


def test_repeats(spark, texts):
    ring = " ".join(f"w{k}" for k in range(20))
    docs = texts(ring, f"{ring} {ring}", " ".join(["x"] * 30), f"{ring} a b c {ring} d e {ring}", "a b\nc\n\na b\n \nc", "x " * 7)
    check(docs, spark.createDataFrame([(0,)], "doc_id bigint"))


def test_odd(odd, none, spark):
    trusted = spark.createDataFrame([(5,), (4,)], "doc_id bigint")
    assert len(check(odd, trusted)) == odd.count()
    assert Q.quality_rules(none, trusted).count() == 0
    assert Q.quality_rules(odd, trusted.limit(0)).where("row.score = 0.0").count() == 5


def test_clean_kept_and_junk_not(sf):
    rows = Q.quality_rules(sf("documents", "sf0.01"), Q.trusted_ids(sf("labels", "sf0.01"))).select("row.doc_id", "kept", "base_failed")
    marked = rows.join(sf("labels", "sf0.01"), "doc_id").where("NOT base_failed AND toxic = 0")
    share = {r.quality: r.share for r in marked.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.97 and share[0] < 0.1
