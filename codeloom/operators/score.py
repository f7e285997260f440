"""Pairs of generated and original docs, and scores of such pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.similarity import cosine, jaccard, levenshtein_ratio
from codeloom.functions.text import strip_ws
from codeloom.operators.skew import salted_join

PairModel = Callable[[list[str], list[str]], list[float]]


def match_pairs(generated: DataFrame, original: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Docs of equal functions that differ: (…on, code, original_comment, agent_comment).

    Both sides hold ``on`` (the file, by default ``path``, and ``rev`` where both sides have it), ``key`` and ``doc``. Keys and docs are compared
    without surrounding white space. Names repeated in a file match many to many, as in
    (original, generated); ``on`` keeps that within one file.
    """
    both = {*generated.columns} & {*original.columns}
    file = on or ["path", *(["rev"] if "rev" in both else [])]
    new = generated.select(*file, strip_ws(F.col("key")).alias("_key"), F.col("doc").alias("agent_comment"))
    old = original.select(
        *file, strip_ws(F.col("key")).alias("_key"), F.col("key").alias("code"), F.col("doc").alias("original_comment")
    )
    return (
        new.join(old, [*file, "_key"])
        .where(strip_ws(F.col("original_comment")) != strip_ws(F.col("agent_comment")))
        .select(*file, "code", "original_comment", "agent_comment")
    )


def score_model(
    pairs: DataFrame, factory: Callable[[], PairModel], a: str = "original_comment", b: str = "agent_comment"
) -> DataFrame:
    """Add ``score`` from the user's batch scorer. ``factory`` builds it once per task."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for left, right in batches:
            yield pd.Series(model(left.tolist(), right.tolist()), dtype="float64")

    return pairs.withColumn("score", scored(a, b))


def score_jaccard(pairs: DataFrame, a: str = "original_comment", b: str = "agent_comment") -> DataFrame:
    return pairs.withColumn("score", jaccard(F.col(a), F.col(b)))


def score_levenshtein(pairs: DataFrame, a: str = "original_comment", b: str = "agent_comment") -> DataFrame:
    return pairs.withColumn("score", levenshtein_ratio(F.col(a), F.col(b)))


def score_embedding(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.withColumn("score", cosine(F.col(a), F.col(b)))


def score_tfidf(
    pairs: DataFrame, keys: list[str], a: str = "original_comment", b: str = "agent_comment"
) -> DataFrame:
    """(…keys, score): cosine of tf-idf vectors, each side of each pair being a document.

    Weight = count * (ln((1 + N) / (1 + df)) + 1); 0 when a side has no words. ``keys`` identify a pair.

    Words are counted per pair first. A word of every document would make one join task hold it all, so the
    vocabulary join is salted by pair.
    """
    words = "filter(split(lower({0}), '\\\\s+'), w -> w <> '')"
    tagged = f"""inline(concat(transform({words.format(a)}, w -> struct(0 AS side, w AS word)),
                               transform({words.format(b)}, w -> struct(1 AS side, w AS word))))"""
    terms = (
        pairs.repartition(*keys)
        .selectExpr(*keys, tagged)
        .groupBy(*keys, "word")
        .agg(F.count_if(F.col("side") == 0).alias("in_a"), F.count_if(F.col("side") == 1).alias("in_b"))
    )
    n_docs = pairs.agg((F.count(F.lit(1)) * 2).alias("n")).scalar()
    holds = F.expr("if(in_a > 0, 1, 0) + if(in_b > 0, 1, 0)")
    vocabulary = (
        terms.groupBy("word").agg(F.sum(holds).alias("df")).select("word", (F.log((n_docs + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    )
    sums = (
        salted_join(terms, vocabulary, ["word"], keys)
        .selectExpr(*keys, "in_a * idf AS wa", "in_b * idf AS wb")
        .groupBy(*keys)
        .agg(F.expr("sum(wa * wb) AS ab"), F.expr("sqrt(sum(wa * wa)) * sqrt(sum(wb * wb)) AS norms"))
    )
    return pairs.select(*keys).join(sums, keys, "left").selectExpr(*keys, "if(norms > 0, ab / norms, 0) AS score")
