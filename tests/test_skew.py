from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.operators.skew import (
    CUTS,
    ORDERED_SHARE,
    _in_blocks,
    block_of,
    hot_keys,
    hot_split_join,
    listed_keys,
    salted_join,
    with_latest,
    with_previous,
)


def sample(spark):
    """Two thirds of the rows belong to key 0, with gaps in their order."""
    return spark.range(900).selectExpr(
        "if(id % 3 < 2, 0, id % 7) AS k", "id * 3 AS rev", "if(id % 5 = 0, concat('v', id), null) AS v"
    )


def test_previous_in_blocks_is_lag(spark):
    df = sample(spark)
    got = with_previous(df, ["k"], "rev", ["rev", "v"], block_of("rev", 50), "prev", share=0.2, min_rows=100).select("k", "rev", "prev.*")
    lag = F.lag(F.struct("rev", "v")).over(Window.partitionBy("k").orderBy("rev"))
    expected = df.withColumn("prev", lag).select("k", "rev", "prev.*")
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_latest_in_blocks_is_running_last(spark):
    df = sample(spark)
    got = with_latest(df, ["k"], "rev", "v", block_of("rev", 50), "now", share=0.2, min_rows=100)
    last = F.last("v", ignorenulls=True).over(Window.partitionBy("k").orderBy("rev"))
    assert sorted(map(str, got.collect())) == sorted(map(str, df.withColumn("now", last).collect()))


def test_no_key_and_no_hot_key(spark):
    df = sample(spark).where("k = 0")
    whole = with_previous(df.drop("k"), [], "rev", ["rev"], block_of("rev", 50), "prev")
    keyed = with_previous(df, ["k"], "rev", ["rev"], block_of("rev", 50), "prev").drop("k")
    revs = sorted(r.rev for r in df.collect())
    expected = dict(zip(revs, [None, *revs[:-1]]))
    for got in (whole, keyed):
        assert {r.rev: r.prev and r.prev.rev for r in got.collect()} == expected


def test_split_joins_are_joins(spark):
    df = sample(spark)
    right = spark.range(6).selectExpr("id AS k", "concat('r', id) AS r")
    for how in ("inner", "left"):
        expected = sorted(map(str, df.join(right, ["k"], how).collect()))
        assert sorted(map(str, salted_join(df, right, ["k"], ["rev"], how).collect())) == expected
        split = hot_split_join(df, right, ["k"], ["rev"], how, share=0.2, min_rows=100)
        assert sorted(map(str, split.collect())) == expected
    assert [r.k for r in hot_keys(df, ["k"], share=0.2, min_rows=100).collect()] == [0]


def test_sparse_orders_are_cut_evenly(spark):
    """A key of a million revisions that are time stamps: no block is large, and there are not many of them."""
    df = spark.range(1_000_000).selectExpr("'p' AS path", "1700000000000 + id * id AS rev").union(spark.sql("SELECT 'q', 5L"))
    got = with_previous(df, ["path"], "rev", ["rev"], block_of("rev"), "prev")
    assert got.where("prev IS NULL").count() == 2 and got.where("prev.rev >= rev").count() == 0
    blocks = _in_blocks(df, ["path"], "rev", block_of("rev"), ORDERED_SHARE, listed_keys(df, ["path"])).where("_hot").groupBy("_block").count()
    assert blocks.count() <= CUTS and blocks.agg(F.max("count")).first()[0] < 3 * 1_000_000 / CUTS


def test_cuts_are_bounded_by_the_share(spark):
    df = spark.range(30_000).selectExpr("id % 3 AS k", "id AS rev")
    blocks = _in_blocks(df, ["k"], "rev", block_of("rev"), 0.05, listed_keys(df, ["k"], 0.05, 100)).groupBy("k").agg(F.countDistinct("_block").alias("n"))
    assert all(6 <= r.n <= 9 for r in blocks.collect())
