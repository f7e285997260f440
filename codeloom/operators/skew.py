"""Helpers that keep hot keys from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from codeloom.session import materialize

#: Rows of one key that share a window task when ordered by a dense counter.
BLOCK_SPAN = 1024

#: A key is hot when it holds more than this share of all rows, so at most 1 / share keys are hot.
HOT_SHARE = 0.001

#: The same for keys whose rows are ordered in one task unless split: at most 100,000 short keys are broadcast.
ORDERED_SHARE = 0.00001

#: Below this many rows a key is not worth splitting.
HOT_MIN_ROWS = 100_000
ORDERED_MIN_ROWS = 10_000

#: Stretches that one hot key is cut into at most.
CUTS = 1000

SALTS = 16


def block_of(order: str, span: int = BLOCK_SPAN) -> Column:
    """Block number of a dense counter such as a revision; one key has at most ``span`` rows in a block."""
    return F.floor(F.col(order) / F.lit(span)).cast("bigint")


def _in_blocks(df: DataFrame, keys: list[str], order: str, block: Column, share: float, hot: DataFrame) -> DataFrame:
    """Add ``_hot`` and ``_block``: rows of hot keys get the number of their stretch of ``order``, those of other keys share one.

    A hot key is cut at sketched quantiles of its own order, so stretches have rows alike whether that counts densely or
    holds time stamps. A key gets a cut for every ``share`` of all rows that it has, ``CUTS`` at most, so all cuts together
    are no more than ``1 / share`` numbers, and are broadcast. Equal values of the order stay together.
    """
    if not keys:
        return df.withColumn("_hot", F.lit(True)).withColumn("_block", block)
    total = df.agg(F.count(F.lit(1)).alias("n"))
    cuts = F.percentile_approx(order, [k / CUTS for k in range(1, CUTS)], 10 * CUTS)
    counts = df.join(F.broadcast(hot), keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), cuts.alias("_cuts"))
    wanted = F.least(F.lit(CUTS), F.ceil(F.col("_n") / (F.lit(share) * total.scalar()))).cast("int")
    step = F.greatest(F.lit(1), F.floor(F.lit(CUTS) / wanted)).cast("int")
    kept = counts.withColumn("_step", step).selectExpr(*keys, "true AS _hot", "filter(_cuts, (c, i) -> (i + 1) % _step = 0) AS _cuts")
    number = F.expr(f"cast(size(filter(_cuts, c -> c < {order})) AS bigint)")
    one = F.lit(0).cast("bigint")
    return df.join(F.broadcast(kept), keys, "left").withColumn("_block", F.when(F.col("_hot"), number).otherwise(one)).drop("_cuts")


def listed_keys(df: DataFrame, keys: list[str], share: float = ORDERED_SHARE, min_rows: int = ORDERED_MIN_ROWS) -> DataFrame:
    """The hot keys, found once and written: at most ``1 / share`` rows, mostly none, and then a plain window will do."""
    return materialize(hot_keys(df.select(*keys), keys, share, min_rows), "hot")


def with_previous(
    df: DataFrame,
    keys: list[str],
    order: str,
    values: list[str],
    block: Column,
    name: str,
    share: float = ORDERED_SHARE,
    min_rows: int = ORDERED_MIN_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Add struct ``name``: ``values`` of the row before this one in its key, null for the first row.

    ``hot`` are the keys that need splitting, if ``listed_keys`` has told them before; they are counted when this is called.
    A plain ``lag`` sends all rows of a key to one task. Here the lag of a hot key runs per (key, block); only
    the last row of each of its blocks travels on, is lagged over the key's blocks, and fills the first row of the
    next block. Without ``keys`` blocks are ``block``, which must grow with ``order``. Other keys need the one shuffle of a lag and
    nothing else.
    """
    picked = F.struct(*values)
    hot = listed_keys(df, keys, share, min_rows) if keys and hot is None else hot
    if keys and hot.isEmpty():
        return df.withColumn(name, F.lag(picked).over(Window.partitionBy(*keys).orderBy(order)))
    rows = _in_blocks(df, keys, order, block, share, hot)
    in_block = Window.partitionBy(*keys, "_block").orderBy(order)
    lagged = rows.withColumn(name, F.lag(picked).over(in_block))
    tails = rows.where("_hot").groupBy(*keys, "_block").agg(F.max_by(picked, F.col(order)).alias("_tail"))
    over_blocks = Window.partitionBy(*keys).orderBy("_block")
    carried = tails.select(*keys, "_block", F.lag("_tail").over(over_blocks).alias("_carry"))
    return (
        lagged.join(carried, [*keys, "_block"], "left")
        .withColumn(name, F.coalesce(name, "_carry"))
        .drop("_hot", "_block", "_carry")
    )


def with_latest(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: str,
    block: Column,
    name: str,
    share: float = ORDERED_SHARE,
    min_rows: int = ORDERED_MIN_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Add ``name``: the last non-null ``value`` at or before this row in its key, split like above."""
    hot = listed_keys(df, keys, share, min_rows) if keys and hot is None else hot
    if keys and hot.isEmpty():
        return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order)))
    rows = _in_blocks(df, keys, order, block, share, hot)
    in_block = Window.partitionBy(*keys, "_block").orderBy(order)
    filled = rows.withColumn(name, F.last(value, ignorenulls=True).over(in_block))
    tails = rows.where("_hot").groupBy(*keys, "_block").agg(
        F.expr(f"max_by({value}, {order}) FILTER (WHERE {value} IS NOT NULL) AS _tail")
    )
    over_blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*keys, "_block", F.last("_tail", ignorenulls=True).over(over_blocks).alias("_carry"))
    return (
        filled.join(carried, [*keys, "_block"], "left")
        .withColumn(name, F.coalesce(name, "_carry"))
        .drop("_hot", "_block", "_carry")
    )


#: Joins whose rows stay right when the right side is repeated per salt.
_SALTED = ("inner", "left", "left_semi", "left_anti")


def _check_how(how: str) -> None:
    if how not in _SALTED:
        raise ValueError(f"a salted join is one of {', '.join(_SALTED)}, not {how}: others repeat unmatched right rows per salt")


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], spread: list[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join a skewed table to one row per key. Every key of ``big`` is spread over ``salts`` tasks by the
    hash of its ``spread`` columns and ``small`` is repeated that often. Meant for small right sides
    (group statistics, a vocabulary); Spark still broadcasts them when their size allows."""
    _check_how(how)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def hot_keys(
    df: DataFrame, on: list[str], share: float = HOT_SHARE, min_rows: int = HOT_MIN_ROWS
) -> DataFrame:
    """Keys with more than ``share`` of all rows: never more than ``1 / share`` of them."""
    total = df.agg(F.count(F.lit(1)).alias("n"))
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.where((F.col("_rows") >= min_rows) & (F.col("_rows") > F.lit(share) * total.scalar())).select(*on)


def hot_split_join(
    big: DataFrame,
    right: DataFrame,
    on: list[str],
    spread: list[str],
    how: str = "inner",
    salts: int = 64,
    share: float = HOT_SHARE,
    min_rows: int = HOT_MIN_ROWS,
) -> DataFrame:
    """Join where only hot keys are salted, for right sides too large to repeat as a whole.

    The list of hot keys is broadcast: it has at most ``1 / share`` rows whatever the data size.
    """
    _check_how(how)
    zero = F.lit(0).cast("bigint")
    hot = hot_keys(big, on, share, min_rows).withColumn("_hot", F.lit(True))
    left = (
        big.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(zero))
        .drop("_hot")
    )
    spread_right = (
        right.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.explode(F.sequence(zero, F.when(F.col("_hot"), F.lit(salts - 1).cast("bigint")).otherwise(zero))))
        .drop("_hot")
    )
    return left.join(spread_right, [*on, "_salt"], how).drop("_salt")
