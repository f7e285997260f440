import bisect
import random

from pyspark.sql import functions as F

from codeloom.operators import metrics
from codeloom.operators.metrics import box_stats, compare_runs, failure_sample, success_ratio, success_report

ATTEMPTS = "success boolean, comment string"


def test_quartiles_of_small_groups(spark):
    rng = random.Random(3)
    rows = [
        (f"{n}/{i}", float(rng.choice([rng.random(), rng.randint(0, 3)])))
        for n in range(1, 40) for i in range(3) for _ in range(n)
    ]
    df = spark.createDataFrame(rows + [("1/0", float("nan")), ("1/0", None)], "g string, v double")
    plain = df.where("NOT isnan(v)").groupBy("g").agg(F.expr("percentile(v, array(0.25, 0.5, 0.75)) AS p"), F.count("v").alias("m"))
    both = box_stats(df, "v", ["g"]).join(plain, "g")
    wrong = both.where("abs(q1 - p[0]) > 1e-12 OR abs(median - p[1]) > 1e-12 OR abs(q3 - p[2]) > 1e-12 OR n <> m")
    assert (both.count(), wrong.count()) == (117, 0)


def test_quartiles_by_ranges(spark, monkeypatch):
    """Groups above the size that is gathered, beside smaller ones, have the same quartiles."""
    df = spark.range(20_000).selectExpr("if(id % 10 = 0, null, id % 3) AS g", "CASE id % 3 WHEN 0 THEN 5D ELSE round(pow(rand(1), 4), 3) END AS v")
    names = ("g", "n", "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers")
    rows = lambda: sorted(([getattr(r, c) if c == "g" else round(getattr(r, c), 9) for c in names] for r in box_stats(df, "v", ["g"]).collect()), key=str)
    whole = rows()
    monkeypatch.setattr(metrics, "_WHOLE", 400)
    monkeypatch.setattr(metrics, "_RANGES", 7)
    assert rows() == whole and len(whole) == 4


def test_ranges_are_found_by_a_few_comparisons(spark, monkeypatch):
    """A value's range is the number of cuts below it, found without looking at each cut."""
    rng = random.Random(5)
    cuts = [sorted(rng.choice([rng.random(), 0.5]) for _ in range(n)) for n in (1, 2, 6, 499, 511)]
    rows = [(c, v) for c in cuts for v in [c[0], c[-1], c[len(c) // 2], -1.0, 2.0, rng.random(), 0.5]]
    found = metrics._with_range(spark.createDataFrame(rows, "cuts array<double>, v double"))
    assert [r.part for r in found.collect()] == [bisect.bisect_left(c, v) for c, v in rows]
    assert "lambdafunction" not in found._jdf.queryExecution().toString()


def test_quartiles_of_a_hot_group(spark):
    df = spark.range(300_000).selectExpr("id % 3 AS g", "CASE id % 3 WHEN 0 THEN 5D ELSE pow(rand(1), 8) END AS v")
    plain = df.groupBy("g").agg(F.expr("percentile(v, array(0.25, 0.5, 0.75)) AS p"))
    for row in box_stats(df, "v", ["g"]).join(plain, "g").collect():
        assert max(abs(a - b) for a, b in zip((row.q1, row.median, row.q3), row.p)) < 1e-12


def test_merged_sketches_are_within_their_error(spark):
    df = spark.range(400_000).selectExpr("if(id % 4 = 3, null, id % 4) AS g", "id % 37 AS part", "CASE id % 4 WHEN 0 THEN 5D ELSE pow(rand(1), 8) END AS v").cache()
    merged = metrics.box_stats_merged(metrics.score_sketches(df, "v", ["g", "part"]), ["g"])
    exact, found = ({r.g: r for r in rows.collect()} for rows in (box_stats(df, "v", ["g"]), merged))
    error = 3 * metrics.sketch_error()
    assert set(exact) == set(found) == {0, 1, 2, None}
    assert merged.columns == ["g", "n", "min", "max", "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers"]
    for g, row in found.items():
        assert (row.n, row.min, row.max) == (exact[g].n, exact[g].min, exact[g].max)
        values = sorted(r.v for r in df.where(F.col("g").eqNullSafe(g)).select("v").collect())
        for quantile, rank in ((row.q1, 0.25), (row.median, 0.5), (row.q3, 0.75)):
            assert bisect.bisect_left(values, quantile) / row.n - error <= rank <= bisect.bisect_right(values, quantile) / row.n + error
        assert abs(row.n_outliers - exact[g].n_outliers) / row.n < 2 * error
        assert row.whisker_low <= row.q1 and row.whisker_high >= row.q3
    constant = found[0]
    assert (constant.q1, constant.whisker_low, constant.whisker_high, constant.n_outliers) == (5, 5, 5, 0)


def test_small_and_empty_sketches(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 4.0, 5.0, 100.0, None, float("nan"))] + [("b", None)], "g string, v double")
    row = metrics.box_stats_merged(metrics.score_sketches(df, "v", ["g"]), ["g"]).collect()
    assert [(r.g, r.n, r.median, r.whisker_low, r.whisker_high, r.n_outliers) for r in row] == [("a", 6, 3.0, 1.0, 5.0, 1)]
    assert metrics.box_stats_merged(metrics.score_sketches(df.limit(0), "v", ["g"]), ["g"]).count() == 0


def test_null_group_and_one_scan(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", None)], "g string, v double")
    rows = {r.g: (r.n, r.min, r.median, r.max, r.whisker_high) for r in box_stats(df, "v", ["g"]).collect()}
    assert rows == {None: (2, 1.0, 2.0, 3.0, 3.0), "a": (1, 5.0, 5.0, 5.0, 5.0)}


def test_runs_in_order(spark):
    scores = spark.createDataFrame([("run_b", 2.0), ("run_a", 1.0), (None, 4.0)], "run_id string, score double")
    attempts = spark.createDataFrame([("run_b", True), ("run_a", False), (None, True), ("run_c", True)], "run_id string, success boolean")
    rows = [(r.run_id, r.n, r.median_change, r.ratio_change) for r in compare_runs(scores, attempts).collect()]
    assert sorted(rows, key=lambda r: r[0] or "") == [(None, 1, None, None), ("run_a", 1, -3.0, -1.0), ("run_b", 1, 1.0, 1.0), ("run_c", None, None, 0.0)]


def test_whiskers(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100]], "v double")
    row = box_stats(df, "v", []).first()
    assert (row.q1, row.median, row.q3) == (2.25, 3.5, 4.75)
    assert (row.whisker_low, row.whisker_high, row.n_outliers) == (1, 5, 1)


def test_no_attempts(spark):
    row = success_ratio(spark.createDataFrame([], ATTEMPTS)).first()
    assert (row.total, row.successes, row.ratio) == (0, 0, 0)


def test_few_failures(spark):
    df = spark.createDataFrame([(False, f"c{i}") for i in range(3)] + [(True, "ok")], ATTEMPTS)
    assert sorted(r.comment for r in failure_sample(df).collect()) == ["c0", "c1", "c2"]
    first = [r.comment for r in failure_sample(df, n=2).orderBy("pick").collect()]
    assert first == [r.comment for r in failure_sample(df.repartition(5), n=2).orderBy("pick").collect()]


def test_report(spark):
    df = spark.createDataFrame([(False, " bad\n")] + [(True, "ok")] * 31, ATTEMPTS)
    lines = [r.line for r in success_report(df).collect()]
    assert lines == [
        "# Success Report",
        f"**Success ratio:** {31 / 32:.2%} (31/32 successful)",
        "## Sample of 10 Failures:",
        "### Failure 1:",
        "> bad",
    ]
