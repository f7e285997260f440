import random
import time

from codeloom.operators.diff import changed_lines
from codeloom.operators.revisions import previous_revision
from codeloom.plans.queries import QUERIES
from codeloom.streaming import changes
from codeloom.streaming.changes import stream_changed_functions, stream_changed_lines

SCHEMA = "path string, rev bigint, content string"


def run_batch(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "feed"))
    feed = spark.readStream.schema(SCHEMA).parquet(str(folder / "feed"))
    stream_changed_functions(feed, str(folder / "out"), str(folder / "check")).awaitTermination()
    out = spark.read.option("recursiveFileLookup", "true").schema("path string, rev bigint, name string").parquet(str(folder / "out"))
    return sorted((r.path, r.rev, r.name) for r in out.collect())


def source(a, b):
    return f"def a():\n    return {a}\n\ndef b():\n    return {b}\n"


def test_state_spans_batches_and_stale_revisions_are_dropped(spark, tmp_path):
    first = run_batch(spark, [("p", 1, source(1, 1)), ("p", 2, source(1, 2)), ("q", 1, source(5, 5))], tmp_path)
    assert first == [("p", 1, "a"), ("p", 1, "b"), ("p", 2, "b"), ("q", 1, "a"), ("q", 1, "b")]
    second = run_batch(spark, [("p", 3, source(3, 2)), ("p", 1, source(9, 9)), ("q", 2, source(5, 5))], tmp_path)
    assert second == sorted(first + [("p", 3, "a")])


def lines_of(spark, folder):
    out = spark.read.option("recursiveFileLookup", "true").schema("path string, rev bigint, ln int").parquet(str(folder / "out"))
    return sorted(tuple(r) for r in out.collect())


def run_lines(spark, rows, folder, ttl_ms=None):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "feed"))
    feed = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "feed"))
    stream_changed_lines(feed, str(folder / "out"), str(folder / "check"), ttl_ms=ttl_ms).awaitTermination()
    return lines_of(spark, folder)


def history(rng, path, revs):
    text, rows = [], []
    for rev in revs:
        for _ in range(rng.randint(0, 3)):
            text.insert(rng.randint(0, len(text)), f"line {rng.randint(0, 99)}")
        rows.append((path, rev, None if rng.random() < 0.1 else "".join(t + "\n" for t in text)))
    return rows


def batch_lines(spark, rows):
    pairs = previous_revision(spark.createDataFrame(rows, SCHEMA))
    return sorted(tuple(r) for r in changed_lines(pairs).collect())


def test_several_batches_equal_one_batch_job(spark, tmp_path, monkeypatch):
    """Rows out of order within a file of the feed, contents that do not fit in the worker, one file a batch."""
    monkeypatch.setattr(changes, "HELD_CHARS", 500)
    monkeypatch.setattr(changes, "HANDED_CHARS", 300)
    rng, rows = random.Random(2), []
    for part in range(3):
        chunk = [r for p in "abc" for r in history(rng, p, range(part * 15 + 1, part * 15 + 16))]
        rng.shuffle(chunk)
        rows += chunk
        found = run_lines(spark, chunk + chunk[:3], tmp_path)
    assert found == batch_lines(spark, rows)


def test_equal_revisions_keep_one_content_in_any_order(spark, tmp_path):
    one, other = [("p", 1, "a\nb\n"), ("p", 1, "c\n"), ("p", 2, "a\nb\nc\n")], tmp_path / "other"
    other.mkdir()
    assert run_lines(spark, one, tmp_path) == run_lines(spark, one[::-1], other)


def test_forgotten_paths_return_as_if_remembered(spark, tmp_path):
    rng = random.Random(4)
    first, second = (history(rng, p, range(1, 5)) for p in "xy")
    late = [("x", 9, "line 1\nnew\n"), ("x", 10, "line 1\nnew\nnewer\n")]
    run_lines(spark, first + second, tmp_path, ttl_ms=1)
    time.sleep(0.1)
    run_lines(spark, [("z", 1, "z\n")], tmp_path, ttl_ms=1)  # its batch moves the others' states to the table
    parked = spark.read.parquet(str(tmp_path / "check" / "parked")).select("path", "parked_rev").collect()
    assert {("x", 4), ("y", 4)} <= {tuple(r) for r in parked}
    stale = [("y", 2, "stale\n")]
    run_lines(spark, late + stale, tmp_path, ttl_ms=1)
    found = run_lines(spark, [("y", 7, "line 5\n")], tmp_path, ttl_ms=1)
    assert found == batch_lines(spark, first + second + late + [("z", 1, "z\n"), ("y", 7, "line 5\n")])


def test_empty_feed(spark, tmp_path):
    assert run_lines(spark, [("p", None, "a\n")], tmp_path) == []


def test_feeds_read_tables_that_are_folders(spark, tmp_path):
    """Tables as Spark writes them, a folder of part files, and as one file, give the streams the same rows."""
    for name in ("conversations", "events"):
        whole = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        whole.repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for query in ("stream_changed", "stream_ratio"):
        found, wanted = (sorted(map(tuple, QUERIES[query](spark, d).collect())) for d in (str(tmp_path), "/root/testdata/sf0.001"))
        assert found and found == wanted
