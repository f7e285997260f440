import pytest

from codeloom.sources.results import append_run, load_attempts, load_scores
from codeloom.sources.snapshots import load_snapshot, read_snapshot, write_files, write_snapshot


def test_snapshot_of_a_tree(spark, tmp_path):
    (tmp_path / "pkg" / "a b+c").mkdir(parents=True)
    (tmp_path / "pkg" / "a b+c" / "m.py").write_text("x = 'é'\n")
    (tmp_path / "top.py").write_bytes(b"a\xff\n")
    (tmp_path / "empty.py").write_text("")
    (tmp_path / "notes.txt").write_text("no")
    (tmp_path / "pkg" / "__init__.py").write_text("")
    (tmp_path / "none" / "in here").mkdir(parents=True)
    (tmp_path / "bom.py").write_text("\ufeffdef f(): pass\n")
    inner = tmp_path / str(tmp_path).strip("/") / "deep%20é"
    inner.mkdir(parents=True)
    (inner / "m.py").write_text("y\n")
    want = {
        "pkg/a b+c/m.py": "x = 'é'\n", "top.py": "a\ufffd\n", "empty.py": "", "pkg/__init__.py": "", "bom.py": "def f(): pass\n",
        f"{str(tmp_path).strip('/')}/deep%20é/m.py": "y\n",
    }
    for root in (str(tmp_path), f"{tmp_path}/", f"file://{tmp_path}"):
        assert {r.path: (r.rev, r.content) for r in load_snapshot(spark, root, 7).collect()} == {p: (7, c) for p, c in want.items()}


def test_listing_is_done_by_tasks(spark, tmp_path, monkeypatch):
    """Deep and wide trees, batches cut by bytes, other globs; nothing but counts is collected."""
    from codeloom.sources import snapshots

    want = {}
    for k in range(60):
        name = "/".join(["d"] * (k % 7) + [f"x{k % 5}", f"f{k}.{'py' if k % 2 else 'txt'}"])
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"line {k}\n" * (k * 10))
        want[name] = f"line {k}\n" * (k * 10)
    monkeypatch.setattr(snapshots, "BATCH_BYTES", 1000)
    for glob, fits in (("*", lambda n: True), ("*.{py,txt}", lambda n: True), ("f[12]*.txt", lambda n: n.split("/")[-1][1] in "12" and n.endswith("txt"))):
        got = {r.path: r.content for r in load_snapshot(spark, str(tmp_path), 1, glob).collect()}
        assert got == {n: c for n, c in want.items() if fits(n)}
    assert load_snapshot(spark, str(tmp_path), 1, "*.java").count() == 0
    only = f"{tmp_path}/x1/f1.py" if (tmp_path / "x1/f1.py").exists() else str(next(tmp_path.rglob("f1.py")))
    assert [r.content for r in load_snapshot(spark, only, 1).collect()] == ["line 1\n" * 10]


def test_a_tree_that_is_not_there(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)not exist|no such|cannot get"):
        load_snapshot(spark, str(tmp_path / "gone"), 1).count()


def test_files_are_written_by_tasks(spark, tmp_path):
    """As many files as rows and nothing beside them, whatever their names; written again, they are the same."""
    want = {f"rev=0/path=a%2Fb {k}/é{k % 3}.txt": f"line é {k}\n" * (k % 5) for k in range(200)}
    files = spark.createDataFrame(list(want.items()), "file string, content string").repartition(7)
    for _ in range(2):
        write_files(files, str(tmp_path / "tree"))
        found = {str(p.relative_to(tmp_path / "tree")): p.read_bytes().decode() for p in (tmp_path / "tree").rglob("*") if p.is_file()}
        assert found == want
    assert {r.path: r.content for r in load_snapshot(spark, str(tmp_path / "tree"), 1, "*.txt").collect()} == want


def test_the_tree_of_the_query_has_a_file_per_source(spark, tmp_path):
    """Paths that need escapes and a null one come back as they went in, and no checksum file is written beside a source."""
    from pathlib import Path

    from codeloom.plans.queries import load_snapshot_files, sources

    rows = [(k, f"name {k}", ["Brand#1 +é", "a/b%2F", None][k % 3], "PROMO", k) for k in range(1, 60)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    old = set(root.glob("tree-*"))
    got = {(r.rev, r.path) for r in load_snapshot_files(spark, str(tmp_path)).collect()}
    want = {(r.rev, r.path or "__HIVE_DEFAULT_PARTITION__") for r in sources(spark, str(tmp_path)).collect()}
    (tree,) = set(root.glob("tree-*")) - old
    assert got == want and len(want) == 12 and sum(p.is_file() for p in tree.rglob("*")) == 12


def test_snapshot_writes_few_files(spark, tmp_path):
    rows = spark.range(400, numPartitions=16).selectExpr("id % 4 AS rev", "concat('p', id) AS path", "repeat('x', 50) AS content")
    write_snapshot(rows, str(tmp_path / "t"))
    assert len(list((tmp_path / "t").rglob("part-*.parquet"))) <= 8
    assert read_snapshot(spark, str(tmp_path / "t")).count() == 400


def test_scores(spark, tmp_path):
    (tmp_path / "run_a").mkdir()
    (tmp_path / "run_a" / "semantic_score.csv").write_text(
        "Semantic-Score,Code,Original-Comment,Agent-Comment,Filename,Agent-Commit\n"
        '0.5,def f,"""""""Old, with\n    ""quotes"".""""""","# new",m.py,abc\n'
    )
    row = load_scores(spark, str(tmp_path)).first()
    assert (row.run_id, row.score, row.code, row.filename, row.agent_commit) == ("run_a", 0.5, "def f", "m.py", "abc")
    assert row.original_comment == '"""Old, with\n    "quotes"."""' and row.agent_comment == "# new"


def test_attempts(spark, tmp_path):
    for run, text in {
        "1": "Success,Comment\nTrue, '\"\"\"\"\"\"\\nDoc, it\\'s\\n\"\"\"\"\"\"'\nFalse, \"\"it's \\\\n\"\"",
        "2": "Successful runs,Total runs\n",
    }.items():
        (tmp_path / run).mkdir()
        (tmp_path / run / "success_rate.csv").write_text(text)
    (tmp_path / "3").mkdir()
    (tmp_path / "3" / "success_rate.csv").write_text("True, '\"\"\"Doc.\"\"\"'\nTrue, 'x = \"\" and \"'\n")
    rows = sorted((r.run_id, r.success, r.comment) for r in load_attempts(spark, str(tmp_path)).collect())
    assert rows[2:] == [("3", True, '"""Doc."""'), ("3", True, 'x = "" and "')]
    rows = rows[:2]
    assert rows == [("1", False, "it's \\n"), ("1", True, '"""\nDoc, it\'s\n"""')]


def test_runs_are_appended(spark, tmp_path):
    target = str(tmp_path / "runs")
    for run in ("a", "b", "a"):
        append_run(spark.range(2).withColumnRenamed("id", "n"), target, run)
    assert {r.run_id: r["count"] for r in spark.read.parquet(target).groupBy("run_id").count().collect()} == {"a": 4, "b": 2}
