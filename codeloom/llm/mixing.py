"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import stored, text_of, words_of

#: Rows of equal source and size are numbered per so many slices of a hash, so no task orders a large cell.
SLICES = 4096


def source_targets(sources: DataFrame, weights: list[float], budget: float, cap: float) -> DataFrame:
    """Add ``target`` to one row (source, source_size) per source.

    Sources in code point order, null last, take the weights in turn and share ``budget`` times all sizes. No target
    exceeds ``cap`` times its source's size; the excess goes to the others by weight. Sorted by the size of a share at
    which they fill, the level that remains per unit of weight rises while sources fill and falls afterwards, so the
    final level is its largest value. The windows run over one row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (rank % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("_w", weight).withColumn("_full", F.col("source_size") * float(cap))
    order = Window.orderBy(F.col("_full") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * float(budget)
    level = (total - F.coalesce(F.sum("_full").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    return (
        ranked.withColumn("_level", level)
        .withColumn("target", F.least("_full", F.col("_w") * F.max("_level").over(everything)))
        .drop("_w", "_full", "_level")
    )


def _rate(cap: float) -> Column:
    """Tilted rate of a document: exp(lambda * size / mean size), at most ``cap``; a source to be filled takes ``cap``."""
    tilted = F.exp(F.least(F.col("lam") * F.col("z"), F.lit(700.0)))
    return F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), tilted))


def balance(cells: DataFrame, targets: DataFrame, cap: float, tolerance: float, most: int) -> DataFrame:
    """(source, mean, lam, full): the dual variable of each source.

    ``cells`` has (source, size, n), which is all that the dual needs to know of the documents. Each source's dual is
    convex in its own variable; a step is Newton's, or a bisection where that would leave the bracket. Every iteration
    is one aggregate over the cells; only the largest error comes to the driver.
    """
    stats = cells.where("size > 0").groupBy("source").agg(
        (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"), F.min("size").alias("least")
    )
    key = F.col("t.source").eqNullSafe(F.col("s.source"))
    state = stored(
        targets.alias("t").join(stats.alias("s"), key, "left").select(
            "t.source", "target", "source_size", "mean",
            F.lit(0.0).alias("lam"), F.lit(-1e9).alias("lo"),
            (F.log(F.lit(float(cap))) * F.col("mean") / F.col("least")).alias("hi"),
            (F.col("target") >= F.col("source_size") * float(cap) * (1 - 1e-12)).alias("full"),
        ),
        "balance",
    )
    for _ in range(most):
        rows = cells.alias("c").join(state.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
        rows = rows.select("t.*", "size", "n", (F.col("size") / F.col("mean")).alias("z")).where("size > 0 AND NOT full")
        rate, mass = _rate(cap), F.col("n") * F.col("size")
        sums = rows.groupBy("source").agg(
            F.sum(mass * rate).alias("got"),
            F.sum(F.when(rate < float(cap), mass * F.col("z") * rate).otherwise(0.0)).alias("slope"),
        )
        joined = state.alias("t").join(sums.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")), "left")
        over = F.col("got") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - (F.col("got") - F.col("target")) / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi"))
        moved = joined.where("s.got IS NOT NULL OR full OR mean IS NULL").select(
            "t.source", "target", "source_size", "mean", "full", "got", "lam", lo.alias("lo"), hi.alias("hi"), "slope"
        ).withColumn("step", F.when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2))
        state = stored(
            moved.withColumn("error", F.abs(F.col("got") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0)))
            .withColumn("lam", F.when(F.col("error") > tolerance, F.coalesce("step", "lam")).otherwise(F.col("lam")))
            .drop("step", "slope", "got"),
            "balance",
        )
        worst = state.agg(F.max("error")).first()[0]
        state = state.drop("error")
        if worst is None or worst <= tolerance:
            break
    return state.select("source", "mean", "lam", "full", "source_size", "target")


def entropy_mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    budget: float = 1.5,
    cap: float = 2.0,
    tolerance: float = 1e-7,
    iterations: int = 60,
) -> DataFrame:
    """(row, size, source_size, target, rate, copies): every row of ``docs`` (text, source, any others) with the copies
    that the mix takes of it.

    Rates minimise the relative entropy to equal rates under one token constraint per source and 0 <= rate <= cap. They
    depend on a document only by source and size. Copies follow by systematic rounding along the sizes of a source:
    a size's documents get the whole copies that fall into its stretch of the running sum of rates, spread evenly over
    a hash order, so a source misses its target by less than about its longest document.

    Null texts count no words, are of rate ``exp(0)`` or full and take nothing by size; null sources are one source,
    the last. Repeated rows are separate documents. An empty table gives no rows. Further columns ride along in ``row``
    whatever their names. The same rows give the same copies in every run, up to the order of wholly equal rows.
    """
    sized = docs.select(
        F.struct("*").alias("row"),
        F.col("source").alias("source"),
        F.size(words_of(text_of())).cast("bigint").alias("size"),
        F.xxhash64(*(c for c in ("doc_id", "text") if c in docs.columns)).alias("h"),
    ).withColumn("slice", F.pmod("h", F.lit(SLICES)))
    slices = stored(sized.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("n")), "slices")
    cells = stored(slices.groupBy("source", "size").agg(F.sum("n").alias("n")), "cells")
    sources = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    solved = balance(cells, source_targets(sources, list(weights), budget, cap), cap, tolerance, iterations)

    by_source = F.col("c.source").eqNullSafe(F.col("t.source"))
    rated = cells.alias("c").join(solved.alias("t"), by_source).select(
        "c.*", "source_size", "target", "lam", "full", (F.col("size") / F.col("mean")).alias("z")
    ).withColumn("rate", F.coalesce(_rate(cap), F.lit(1.0)))
    along = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Rounded to a billionth, so that whole rates stay whole however the sums were formed.
    end = F.floor(F.round(F.sum(F.col("n") * F.col("rate")).over(along), 9) + 0.5)
    before = Window.partitionBy("source").orderBy("size")
    planned = rated.withColumn("_end", end).withColumn(
        "k", F.least(F.col("_end") - F.coalesce(F.lag("_end").over(before), F.lit(0)), F.floor(F.col("n") * float(cap)))
    )
    same = F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.size") == F.col("p.size"))
    earlier = Window.partitionBy("s.source", "s.size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    plan = slices.alias("s").join(planned.alias("p"), same).select(
        "s.source", "s.size", "slice", "source_size", "target", "rate", F.col("p.n").alias("cell"), "k",
        F.coalesce(F.sum("s.n").over(earlier), F.lit(0)).alias("first"),
    )
    key = F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.size") == F.col("q.size")) & (F.col("d.slice") == F.col("q.slice"))
    at = F.col("first") + F.row_number().over(Window.partitionBy("d.source", "d.size", "d.slice").orderBy("h")) - 1
    share = lambda p: F.floor(p * F.col("k") / F.col("cell"))
    return (
        sized.alias("d").join(plan.alias("q"), key)
        .withColumn("_at", at)
        .select(
            "row", "d.size", "source_size", "target", "rate",
            (share(F.col("_at") + 1) - share(F.col("_at"))).cast("int").alias("copies"),
        )
    )


def mixed_copies(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with each row as often as the mix takes it: not at all, once, or up to the cap."""
    return entropy_mix(docs, **settings).where("copies > 0").select(
        "row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_copy")
    ).select("row.*")
