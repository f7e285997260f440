import random

from codeloom.operators.lines import apply_edits, assemble_files, explode_lines


def test_round_trip(files):
    texts = {"a": "x\n\ny\n", "b": "one", "c": "\n", "d": " é\n\tz\n"}
    got = {r.path: r.content for r in assemble_files(explode_lines(files(**texts))).collect()}
    assert got == {p: t.removesuffix("\n") for p, t in texts.items()}


def test_round_trip_with_ends(files):
    rng = random.Random(6)
    texts = {f"t{k}": "".join(rng.choice(["a", "\n", "\r\n", "\r", " ", "é"]) for _ in range(rng.randint(0, 12))) for k in range(200)}
    texts |= {"empty": "", "break": "\n", "none": "x", "dos": "x\r\ny\r\n"}
    lines = explode_lines(files(**texts), ends=True)
    assert {r.path: r.content for r in assemble_files(lines).collect()} == texts


def test_line_numbers(files):
    rows = explode_lines(files(a="x\r\ny\n", empty="")).orderBy("path", "ln").collect()
    assert [(r.path, r.ln, r.text) for r in rows] == [("a", 1, "x"), ("a", 2, "y")]


def test_edits_replace_insert_and_delete(spark, files):
    sources = files(a="1\n2\r\n3\n4\n5\n", untouched="u\n")
    edits = spark.createDataFrame(
        [(1, "a", 5, 5, []), (1, "a", 1, 1, ["one", "uno"]), (1, "a", 3, 2, ["new"])],
        "rev bigint, path string, from_ln int, to_ln int, new_lines array<string>",
    )
    got = {r.path: r.content for r in apply_edits(sources, edits).collect()}
    assert got == {"a": "one\nuno\n2\r\nnew\n3\n4\n", "untouched": "u\n"}
