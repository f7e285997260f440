"""Changed and removed lines between two contents of a file.

Input everywhere: pairs (path, rev, old_content, new_content). Rows that share (path, rev) come from one pair
of contents, which bounds each group; no key here collects several files or revisions.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import ArrayType, IntegerType

from codeloom.functions.text import line_array
from codeloom.operators.lines import FILE_KEY

OLD, NEW = 0, 1

_REGION = "path, rev, old_start, new_start"

#: Length of the common prefix of arrays ``{a}`` and ``{b}``.
_COMMON = "ifnull(nullif(array_position(zip_with({a}, {b}, (x, y) -> x <=> y), false), 0) - 1, size({a}))"


def _trim(regions: DataFrame) -> DataFrame:
    """Drop lines both sides share at the start and at the end of a region, inside the row."""
    head = _COMMON.format(a="old_lines", b="new_lines")
    tail = _COMMON.format(a="reverse(old_lines)", b="reverse(new_lines)")
    return (
        regions.selectExpr("*", f"cast({head} AS int) AS same")
        .selectExpr(
            "path",
            "rev",
            "old_start + same AS old_start",
            "new_start + same AS new_start",
            "slice(old_lines, same + 1, size(old_lines)) AS old_lines",
            "slice(new_lines, same + 1, size(new_lines)) AS new_lines",
        )
        .selectExpr("*", f"cast({tail} AS int) AS same")
        .selectExpr(
            *_REGION.split(", "),
            "slice(old_lines, 1, size(old_lines) - same) AS old_lines",
            "slice(new_lines, 1, size(new_lines) - same) AS new_lines",
        )
    )


def _line_rows(regions: DataFrame) -> DataFrame:
    """One row per line of a region."""

    def tagged(side: int, lines: str, start: str) -> str:
        return f"transform({lines}, (t, i) -> struct({side} AS side, {start} + i AS ln, t AS text))"

    old, new = tagged(OLD, "old_lines", "old_start"), tagged(NEW, "new_lines", "new_start")
    return regions.selectExpr(*_REGION.split(", "), f"inline(concat({old}, {new}))")


def _chain(values: Sequence[int]) -> list[int]:
    """Positions of a longest increasing subsequence, by patience piles: the top of a pile is the least value that ends
    a chain of the pile's number."""
    tops: list[int] = []
    top_at: list[int] = []
    before: list[int] = []
    for at, value in enumerate(values):
        pile = bisect_left(tops, value)
        before.append(top_at[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [value]
        top_at[pile : pile + 1] = [at]
    chain = []
    at = top_at[-1] if top_at else -1
    while at >= 0:
        chain.append(at)
        at = before[at]
    return chain[::-1]


@F.pandas_udf(ArrayType(IntegerType()))
def _longest_chain(partners: pd.Series) -> pd.Series:
    return partners.map(_chain)


def _context_key(lines: str) -> str:
    return f"xxhash64(ifnull(get({lines}, i - 1), '\\0'), t, ifnull(get({lines}, i + 1), '\\0'))"


def _split_at_anchors(regions: DataFrame, context: bool) -> DataFrame:
    """Split regions at lines that occur once on each side, alone or (``context``) with their neighbours too. Where such
    anchors cross, as around a moved block, a longest chain of them that does not is kept. A line without a letter or digit says
    too little to be an anchor by itself.

    All of it happens inside the row, before any shuffle, in n log n of its lines: equal keys are neighbours in sorted
    order. Only the anchors of rows in which some cross go to a Python worker.
    """

    def tagged(side: int, lines: str) -> str:
        rows = "transform({0}, (t, i) -> struct({1} AS key, {2} AS side, i AS at))"
        alone = f"filter({rows.format(lines, 'xxhash64(t)', side)}, x -> {lines}[x.at] RLIKE '(?U)\\\\w')"
        return f"{alone}, {rows.format(lines, _context_key(lines), side)}" if context else alone

    keyed = regions.selectExpr("*", f"array_sort(concat({tagged(OLD, 'old_lines')}, {tagged(NEW, 'new_lines')})) AS keyed")
    once = f"""x.side = {OLD} AND get(keyed, i + 1).side = {NEW} AND get(keyed, i + 1).key = x.key
               AND NOT get(keyed, i - 1).key <=> x.key AND NOT get(keyed, i + 2).key <=> x.key
               AND old_lines[x.at] = get(new_lines, get(keyed, i + 1).at)"""
    anchored = keyed.selectExpr(
        *_REGION.split(", "),
        "old_lines",
        "new_lines",
        f"""array_sort(filter(transform(keyed, (x, i) -> if({once}, struct(x.at AS a, get(keyed, i + 1).at AS b), NULL)),
                              x -> x IS NOT NULL)) AS found""",
    )
    if context:  # a line may be an anchor by itself and by its neighbours, with one partner
        anchored = anchored.withColumn("anchors", F.expr("filter(found, (x, i) -> NOT x <=> get(found, i - 1))"))
    else:
        anchored = anchored.withColumnRenamed("found", "anchors")
    anchored = anchored.selectExpr("*", "anchors.b <> array_sort(anchors.b) AS crossed")
    chained = anchored.withColumn("chain", _longest_chain(F.expr("if(crossed, anchors.b, cast(array() AS array<int>))")))
    ends = chained.selectExpr(
        *_REGION.split(", "),
        "old_lines",
        "new_lines",
        """concat(array(struct(-1 AS a, -1 AS b)), if(crossed, transform(chain, i -> anchors[i]), anchors),
                  array(struct(size(old_lines) AS a, size(new_lines) AS b))) AS ends""",
    )

    def between(lines: str, at: str) -> str:
        return f"slice({lines}, ends[i].{at} + 2, ends[i + 1].{at} - ends[i].{at} - 1)"

    gaps = ends.selectExpr(
        "path",
        "rev",
        f"""inline(transform(sequence(0, size(ends) - 2), i -> struct(
              old_start + ends[i].a + 1 AS old_start, new_start + ends[i].b + 1 AS new_start,
              {between("old_lines", "a")} AS old_lines, {between("new_lines", "b")} AS new_lines)))""",
    )
    return _trim(gaps.where("size(old_lines) + size(new_lines) > 0"))


def line_changes(pairs: DataFrame, mode: str = "aligned") -> DataFrame:
    """(path, rev, side, ln): lines of the old side (0) that are gone and of the new side (1) that are new.

    ``aligned``: files are cut at unique lines first, so repeated lines are matched near their neighbours. Of unique lines
    that crossed, as many as can keep their order stay.
    ``multiset``: the k-th copy of a line matches the k-th copy on the other side, wherever it stands.

    Unchanged files, common heads and tails and kept unique lines are dropped inside the content row, before the shuffle.
    """
    if mode not in ("aligned", "multiset"):
        raise ValueError(f"unknown mode {mode!r}")
    regions = (
        pairs.selectExpr("path", "rev", "ifnull(old_content, '') AS old", "ifnull(new_content, '') AS new")
        .where("old <> new")
        .select(
            *FILE_KEY,
            F.lit(1).alias("old_start"),
            F.lit(1).alias("new_start"),
            line_array(F.col("old")).alias("old_lines"),
            line_array(F.col("new")).alias("new_lines"),
        )
    )
    if mode == "aligned":
        regions = _split_at_anchors(_split_at_anchors(_trim(regions), context=True), context=False)
    regions = regions.repartition(*FILE_KEY)
    copy = f"row_number() OVER (PARTITION BY {_REGION}, side, text ORDER BY ln) AS copy"
    return (
        _line_rows(regions)
        .selectExpr("*", copy)
        .selectExpr("*", f"count(1) OVER (PARTITION BY {_REGION}, text, copy) AS sides")
        .where("sides = 1")
        .select(*FILE_KEY, "side", "ln")
    )


def changed_lines(pairs: DataFrame, mode: str = "aligned") -> DataFrame:
    """(path, rev, ln): new-side lines that were added or modified; every line of a new file."""
    return line_changes(pairs, mode).where(F.col("side") == NEW).drop("side")


def removed_lines(pairs: DataFrame, mode: str = "aligned") -> DataFrame:
    """(path, rev, ln): old-side lines that were deleted or modified."""
    return line_changes(pairs, mode).where(F.col("side") == OLD).drop("side")


def change_hunks(changed: DataFrame) -> DataFrame:
    """(path, rev, start_ln, end_ln, n_lines): maximal runs of consecutive changed lines."""
    in_order = Window.partitionBy(*FILE_KEY).orderBy("ln")
    island = changed.withColumn("_island", F.col("ln") - F.row_number().over(in_order))
    return (
        island.groupBy(*FILE_KEY, "_island")
        .agg(F.min("ln").alias("start_ln"), F.max("ln").alias("end_ln"), F.count(F.lit(1)).alias("n_lines"))
        .drop("_island")
    )
