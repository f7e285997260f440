"""Similarity scores between two text or vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case words split at white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda word: word != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared distinct words over all distinct words; 0 when both sides are empty."""
    left, right = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    shared = F.transform(
        F.array(F.struct(left.alias("l"), right.alias("r"))),
        lambda s: F.struct(
            F.size(F.array_intersect(s["l"], s["r"])).alias("both"),
            (F.size(s["l"]) + F.size(s["r"])).alias("sum"),
        ),
    )[0]
    union = shared["sum"] - shared["both"]
    return F.when(union == 0, F.lit(0.0)).otherwise(shared["both"] / union)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 when both are empty."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equally long vectors; null when one of them is zero."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)
