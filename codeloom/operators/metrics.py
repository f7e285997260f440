"""Quartiles, success ratios, failure samples and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import strip_ws
from codeloom.operators.skew import salted_join
from codeloom.session import materialize

#: Accuracy of the sketch that answers inexact quartiles.
_ACCURACY = 10_000

#: Groups of more different values are cut into ranges, so many at most, for exact quartiles.
_WHOLE = 100_000
_RANGES = 512

#: Size of a stored quantile sketch: some 50 KB.
SKETCH_K = 2000

#: Evenly spaced ranks at which a sketch is asked for the values within the fences.
_GRID = 2000


def sketch_error(k: int = SKETCH_K) -> float:
    """Share of all values by which the rank of a sketched quantile is off at most, 99 times in a hundred, merged or not."""
    return 2.296 / k**0.9723


def box_stats(df: DataFrame, value: str, group: list[str], exact: bool = True) -> DataFrame:
    """(…group, n, min, q1, median, q3, max, whisker_low, whisker_high, n_outliers).

    Quartiles are interpolated linearly. Whiskers end at the last values within 1.5 interquartile ranges of the
    box. Null and NaN values do not count; a null group is a group.

    All figures follow from one table of (group, value, count), written once. Exact quartiles come from a group's counts. A group of more than
    ``_WHOLE`` different values is not gathered: its values are dealt by ranges over all tasks, ranges are summed first, and
    the value that holds a rank is found within its range. Which groups these are is counted first. ``exact=False`` takes a
    sketch's answer.
    """
    key = F.struct(*(F.col(g) for g in group)) if group else F.struct(F.lit(1))
    values = df.select(key.alias("g"), F.expr(f"cast({value} AS double)").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    counts = materialize(values.groupBy("g", "v").agg(F.expr("count(1) AS c")), "counts")
    basics = counts.groupBy("g").agg(F.expr("sum(c) AS n"), F.expr("min(v) AS min"), F.expr("max(v) AS max"))
    if exact:
        quartiles = _exact_quartiles(counts)
    else:
        sketch = f"percentile_approx(v, array(0.25D, 0.5D, 0.75D), {_ACCURACY})"
        found = values.groupBy("g").agg(F.expr(f"{sketch} AS p"))
        quartiles = found.selectExpr("g", "p[0] AS q1", "p[1] AS median", "p[2] AS q3")
    stats = basics.join(quartiles, "g")
    fences = quartiles.selectExpr("g", "q1 - 1.5 * (q3 - q1) AS low", "q3 + 1.5 * (q3 - q1) AS high")
    whiskers = (
        salted_join(counts, fences, ["g"], ["v"])
        .groupBy("g")
        .agg(
            F.expr("min(v) FILTER (WHERE v >= low) AS whisker_low"),
            F.expr("max(v) FILTER (WHERE v <= high) AS whisker_high"),
            F.expr("ifnull(sum(c) FILTER (WHERE v < low OR v > high), 0) AS n_outliers"),
        )
    )
    names = ["n", "min", "max", "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers"]
    return stats.join(whiskers, "g").select(*(F.col("g")[g].alias(g) for g in group), *names)


def _exact_quartiles(counts: DataFrame) -> DataFrame:
    large = counts.groupBy("g").agg(F.expr("count(1) AS m"), F.expr("sum(c) AS n")).where(F.col("m") > _WHOLE)
    whole = F.expr("percentile(v, array(0.25D, 0.5D, 0.75D), c) AS p")
    if large.isEmpty():
        return counts.groupBy("g").agg(whole).selectExpr("g", "p[0] AS q1", "p[1] AS median", "p[2] AS q3")
    small = counts.join(large.select("g"), "g", "left_anti").groupBy("g").agg(whole)
    split = salted_join(counts, large.select("g"), ["g"], ["v"], "left_semi")
    return small.selectExpr("g", "p[0] AS q1", "p[1] AS median", "p[2] AS q3").unionByName(_quartiles_by_ranges(split, large.select("g", "n")))


def _quartiles_by_ranges(counts: DataFrame, basics: DataFrame) -> DataFrame:
    """Values of a group fall into ranges of like size, by sketched bounds, which decide the work and not the result; a range's
    first rank is the sum of those before."""
    cuts = F.percentile_approx("v", [k / _RANGES for k in range(1, _RANGES)], _ACCURACY).alias("cuts")
    bounds = counts.groupBy("g").agg(cuts)
    ranged = _with_range(salted_join(counts, bounds, ["g"], ["v"])).select("g", "v", "c", "part")
    sums = ranged.groupBy("g", "part").agg(F.expr("sum(c) AS c"))
    before = "sum(c) OVER (PARTITION BY g ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    first = sums.selectExpr("g", "part", "c AS in_part", f"ifnull({before}, 0) AS first")
    ranks = first.join(basics.select("g", "n"), "g").selectExpr(
        "*", "inline(transform(sequence(1, 3), q -> struct(q, (n - 1) * q div 4 AS k, pmod((n - 1) * q, 4) / 4 AS share)))"
    ).toDF("g", "part", "in_part", "first", "n", "quarter", "k", "share")
    # The two neighbours of a quartile: the second one only counts where the quartile lies between them.
    wanted = ranks.selectExpr(
        "g", "part", "first", "quarter",
        "inline(array(struct(k AS rank, 1 - share AS weight), struct(least(k + 1, n - 1) AS rank, share AS weight)))",
    ).where("weight > 0")
    here = wanted.join(first.select("g", "part", "in_part"), ["g", "part"]).where("rank >= first AND rank < first + in_part")
    inside = ranged.join(here.select("g", "part").distinct(), ["g", "part"], "left_semi")
    placed = inside.selectExpr("*", "sum(c) OVER (PARTITION BY g, part ORDER BY v ROWS UNBOUNDED PRECEDING) AS upto")
    hits = placed.join(here, ["g", "part"]).where("rank - first < upto AND rank - first >= upto - c")
    # Equal neighbours are added as one value, so that a quartile on a value is that value.
    near = hits.groupBy("g", "quarter").agg(F.expr("min(v) AS low"), F.expr("max(v) AS high"), F.expr("max_by(weight, rank) AS upper"), F.expr("count(1) AS m"))
    quartile = near.selectExpr("g", "quarter", "if(m = 1 OR low = high, low, low + (high - low) * upper) AS q")
    return quartile.groupBy("g").agg(
        *[F.expr(f"max(q) FILTER (WHERE quarter = {i}) AS {name}") for i, name in enumerate(("q1", "median", "q3"), 1)]
    )


def _with_range(rows: DataFrame) -> DataFrame:
    """Add ``part``, how many of the ascending ``cuts`` are below ``v``, by a binary search: there are fewer than ``_RANGES``."""
    rows, step = rows.withColumn("part", F.lit(0)), (1 << (_RANGES - 1).bit_length()) >> 1
    while step:
        rows = rows.withColumn("part", F.expr(f"part + if(get(cuts, part + {step - 1}) < v, {step}, 0)"))
        step //= 2
    return rows


def score_sketches(df: DataFrame, value: str, group: list[str], k: int = SKETCH_K) -> DataFrame:
    """(…group, n, min, max, sketch): what is stored of a run's scores, a row per group. Null and NaN values do not count,
    a null group is a group. Sketches are made before the shuffle, so a hot group sends one per task."""
    values = df.select(*group, F.expr(f"cast({value} AS double)").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    return values.groupBy(*group).agg(
        F.expr("count(1) AS n"), F.expr("min(_v) AS min"), F.expr("max(_v) AS max"), F.kll_sketch_agg_double("_v", k).alias("sketch")
    )


def box_stats_merged(sketches: DataFrame, group: list[str]) -> DataFrame:
    """The columns of ``box_stats`` from stored sketches, merged to ``group``, which may be coarser than theirs.

    ``n``, ``min`` and ``max`` are exact. Quartiles are values of the data, whose ranks are off by ``sketch_error`` at most;
    whiskers and the number of outliers are told from values at evenly spaced ranks, and are off by one more such space.
    """
    ranks = F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)], *[F.lit((i + 0.5) / _GRID) for i in range(_GRID)])
    return (
        sketches.groupBy(*group)
        .agg(F.expr("sum(n) AS n"), F.expr("min(min) AS min"), F.expr("max(max) AS max"), F.kll_merge_agg_double("sketch").alias("sketch"))
        .withColumn("p", F.kll_sketch_get_quantile_double("sketch", ranks))
        .selectExpr(*group, "n", "min", "max", "p[0] AS q1", "p[1] AS median", "p[2] AS q3", f"slice(p, 4, {_GRID}) AS grid")
        .selectExpr("*", "q1 - 1.5 * (q3 - q1) AS low", "q3 + 1.5 * (q3 - q1) AS high")
        .selectExpr("*", "filter(grid, v -> v >= low AND v <= high) AS inner")
        .selectExpr(
            *group, "n", "min", "max", "q1", "median", "q3",
            "if(min >= low, min, least(q1, inner[0])) AS whisker_low",
            "if(max <= high, max, greatest(q3, get(inner, size(inner) - 1))) AS whisker_high",
            f"cast(round((1 - size(inner) / {_GRID}) * n) AS bigint) AS n_outliers",
        )
    )


def success_ratio(attempts: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(…group, total, successes, ratio); the ratio of no attempts is 0."""
    return attempts.groupBy(*(group or [])).agg(
        F.expr("count(1) AS total"), F.expr("count_if(success) AS successes"),
        F.expr("if(count(1) > 0, count_if(success) / count(1), 0D) AS ratio"),
    )


def failure_sample(attempts: DataFrame, n: int = 10, seed: int = 42, key: str = "comment") -> DataFrame:
    """Up to ``n`` failed answers in an order fixed by ``seed``, as a top-k: (pick, …attempts)."""
    picked = (
        attempts.where("NOT success")
        .withColumn("pick", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
        .orderBy("pick", key)
        .limit(n)
    )
    return picked.selectExpr("cast(row_number() OVER (ORDER BY pick, {0}) AS int) AS pick".format(key), *attempts.columns)


# The lines of the report.
_TITLE = "# Success Report"
_RATIO = "**Success ratio:** %s%% (%d/%d successful)"
_SAMPLE = "## Sample of {n} Failures:"
_FAILURE = "### Failure %d:"
_QUOTE = "> %s"


def success_report(attempts: DataFrame, n: int = 10, seed: int = 42, key: str = "comment") -> DataFrame:
    """(ord, line): ratio with counts, then the numbered sample."""
    percent = F.expr("cast(cast(bround(ratio * 100, 2) AS decimal(5, 2)) AS string)")
    quoted = F.format_string(_QUOTE, strip_ws(F.col("comment")))

    def lines(df: DataFrame, *rows: tuple[Column, Column]) -> DataFrame:
        return df.select(F.inline(F.array(*[F.struct(o.alias("ord"), t.alias("line")) for o, t in rows])))

    head = lines(
        success_ratio(attempts),
        (F.lit(0), F.lit(_TITLE)),
        (F.lit(1), F.format_string(_RATIO, percent, "successes", "total")),
        (F.lit(2), F.lit(_SAMPLE.format(n=n))),
    )
    sample = lines(
        failure_sample(attempts, n, seed, key),
        (F.col("pick") * 2 + 1, F.format_string(_FAILURE, "pick")),
        (F.col("pick") * 2 + 2, quoted),
    )
    return head.unionByName(sample).orderBy("ord")


def compare_runs(scores: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row per run: score statistics beside the success ratio, and the change of the median and of the
    ratio since the run before, in the order of ``run_id``; null is a run, the first.

    Runs are a small table, one row each, whatever the number of their scores; it is ordered as a whole.
    """
    return _beside_ratios(box_stats(scores, "score", ["run_id"]), attempts)


def compare_stored_runs(sketches: DataFrame, attempts: DataFrame) -> DataFrame:
    """``compare_runs`` from ``score_sketches`` with a ``run_id``: a run's scores are read once, when it is written."""
    return _beside_ratios(box_stats_merged(sketches, ["run_id"]), attempts)


def _beside_ratios(stats: DataFrame, attempts: DataFrame) -> DataFrame:
    ratios = success_ratio(attempts, ["run_id"])
    both = stats.alias("s").join(ratios.alias("r"), F.col("s.run_id").eqNullSafe(F.col("r.run_id")), "full_outer")
    run = F.coalesce(F.col("s.run_id"), F.col("r.run_id")).alias("run_id")
    runs = both.select(run, *(c for c in (*stats.columns, *ratios.columns) if c != "run_id"))
    before = "lag({0}) OVER (ORDER BY run_id NULLS FIRST)"
    return runs.withColumns(
        {f"{c}_change": F.expr(f"{c} - {before.format(c)}") for c in ("median", "ratio")}
    )
