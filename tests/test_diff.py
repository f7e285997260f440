import difflib
import random
import time

import pytest

from codeloom.operators.diff import change_hunks, changed_lines, line_changes, removed_lines
from codeloom.operators.revisions import previous_revision


def numbers(rows, path):
    return sorted(r.ln for r in rows.collect() if r.path == path)


@pytest.mark.parametrize("mode", ["aligned", "multiset"])
def test_fixed_pairs(pairs, mode):
    df = pairs(
        new_file=(None, "a\nb\n"),
        empty_old=("", "a\n"),
        delete_only=("a\nb\nc\n", "a\nc\n"),
        no_change=("a\n", "a\n"),
        plus_plus=("a\n", "a\n++b\n--c\n"),
        line_end=("a\r\nb\r\n", "a\nb\n"),
    )
    changed, removed = changed_lines(df, mode), removed_lines(df, mode)
    assert numbers(changed, "new_file") == [1, 2]
    assert numbers(changed, "empty_old") == [1]
    assert numbers(changed, "delete_only") == []
    assert numbers(removed, "delete_only") == [2]
    assert numbers(changed, "no_change") == numbers(removed, "no_change") == []
    assert numbers(changed, "plus_plus") == [2, 3]
    assert numbers(changed, "line_end") == numbers(removed, "new_file") == []


def test_repeated_lines_stay_near_their_neighbours(pairs):
    old = 'def a():\n    """\n    A\n    """\n\ndef b():\n    """\n    B\n    """\n'
    new = 'def b():\n    """\n    B\n    """\n'
    df = pairs(f=(old, new))
    assert numbers(removed_lines(df), "f") == [1, 2, 3, 4, 5]
    assert numbers(changed_lines(df), "f") == []


def test_kept_lines_agree_on_both_sides(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        old = [rng.choice(["a", "b", "", '"""', f"x{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 40))]
        new = list(old)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(new))
            if rng.random() < 0.5:
                new.insert(at, f"n{rng.randint(0, 9999)}")
            elif new:
                new.pop(min(at, len(new) - 1))
        rows.append((str(i), 1, "".join(t + "\n" for t in old), "".join(t + "\n" for t in new)))
    df = spark.createDataFrame(rows, "path string, rev bigint, old_content string, new_content string")
    found = {}
    for r in line_changes(df).collect():
        found.setdefault((r.path, r.side), set()).add(r.ln)
    longer = 0
    for path, _, old, new in rows:
        a, b = old.splitlines(), new.splitlines()
        gone, come = found.get((path, 0), set()), found.get((path, 1), set())
        kept_old = sorted(t for i, t in enumerate(a, 1) if i not in gone)
        assert kept_old == sorted(t for i, t in enumerate(b, 1) if i not in come)
        edits = [o for o in difflib.SequenceMatcher(None, a, b, False).get_opcodes() if o[0] != "equal"]
        longer += len(gone) + len(come) > sum(o[2] - o[1] + o[4] - o[3] for o in edits)
    assert longer <= 6


def test_crossing_anchors_keep_a_longest_chain(pairs):
    """Lines that are unique on both sides: what stays is a longest common subsequence."""
    rng, texts, most = random.Random(11), {}, {}
    for i in range(60):
        n = rng.randint(2, 60)
        new = list(range(n))
        for _ in range(rng.randint(1, 4)):
            at, to = sorted(rng.sample(range(n + 1), 2))
            block = new[at:to]
            del new[at:to]
            at = rng.randint(0, len(new))
            new[at:at] = block
        if i % 6 == 0:
            rng.shuffle(new)
        best = []
        for at, value in enumerate(new):
            best.append(1 + max((best[b] for b in range(at) if new[b] < value), default=0))
        texts[f"f{i}"] = tuple("".join(f"line {v}\n" for v in side) for side in (range(n), new))
        most[f"f{i}"] = n - max(best)
    df = pairs(**texts)
    for rows in (removed_lines(df).collect(), changed_lines(df).collect()):
        assert {p: sum(r.path == p for r in rows) for p in texts} == most


def test_long_file_of_crossing_lines(pairs):
    """Every second line moved to the end: as many chains as lines, and still no more than n log n steps."""
    n = 60_000
    new = [*range(0, n, 2), *range(1, n, 2)]
    start = time.monotonic()
    assert len(numbers(changed_lines(pairs(f=tuple("".join(f"line {v}\n" for v in side) for side in (range(n), new)))), "f")) == n // 2 - 1
    assert time.monotonic() - start < 60


def test_hunks(spark):
    lines = spark.createDataFrame([("f", 1, n) for n in (1, 2, 5, 7, 8, 9)], "path string, rev bigint, ln int")
    rows = change_hunks(lines).orderBy("start_ln").collect()
    assert [(r.start_ln, r.end_ln, r.n_lines) for r in rows] == [(1, 2, 2), (5, 5, 1), (7, 9, 3)]


def test_one_shuffle(pairs):
    plan = changed_lines(pairs(f=("a\n", "b\n")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_unknown_mode(pairs):
    with pytest.raises(ValueError):
        changed_lines(pairs(f=("a", "b")), "other")


def test_contents_are_not_broadcast(spark):
    """Contents of all revisions compress well, yet they meet by a shuffle and not through the driver."""
    rows = spark.range(600).selectExpr("cast(id div 3 AS string) AS path", "id % 3 AS rev", "repeat(cast(id AS string), 50) AS content")
    paired = previous_revision(rows.groupBy("path", "rev").agg({"content": "max"}).toDF("path", "rev", "content"))
    found = paired.collect()
    assert len(found) == 600 and all((r.old_content is None) == (r.rev == 0) for r in found)
    assert "BroadcastExchange" not in paired._jdf.queryExecution().executedPlan().toString()
