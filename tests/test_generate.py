import uuid

import pytest

from codeloom.operators.generate import fill_answers, map_generate, render_prompt, stored_answers, with_answers
from codeloom.operators.score import match_pairs, score_model


def test_equal_prompts_are_asked_once(spark, tmp_path):
    log = str(tmp_path / "asked")

    def factory():
        def model(prompts):
            with open(log, "a") as f:
                f.writelines(p + "\n" for p in prompts)
            return [p.upper() for p in prompts]

        return model

    rows = [("p", 1, i, "same" if i < 40 else f"own{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "path string, rev bigint, fn_id bigint, prompt string")
    got = {r.fn_id: r.answer for r in map_generate(df, factory).collect()}
    assert got == {r[2]: r[3].upper() for r in rows}
    assert sorted(open(log).read().split()) == sorted({r[3] for r in rows})
    plain = {r.fn_id: r.answer for r in map_generate(df, factory, dedupe=False).collect()}
    assert plain == got


def test_answers_are_kept(spark, tmp_path):
    """Only what the store lacks is asked, in batches of so many characters; null prompts are not."""
    log, store = tmp_path / "asked", str(tmp_path / "store")
    log.mkdir()

    def factory():
        def model(prompts):
            with open(log / uuid.uuid4().hex, "w") as f:
                f.write("\n".join(prompts))
            return [p.upper() for p in prompts]

        return model

    def asked():
        calls = [p.read_text().split("\n") for p in log.iterdir()]
        for p in log.iterdir():
            p.unlink()
        return calls

    schema = "path string, rev bigint, fn_id bigint, prompt string"
    rows = [("p", 1, i, "same" if i < 40 else f"own{i}") for i in range(50)] + [("p", 1, 50, None), ("p", 1, 51, "x" * 100)]
    df = spark.createDataFrame(rows, schema)
    plan = with_answers(df, store)
    assert {r.answer for r in plan.collect()} == {None} and asked() == []
    assert fill_answers(df.where("fn_id < 45"), factory, store, rounds=3) == 6
    assert sorted(p for c in asked() for p in c) == sorted({r[3] for r in rows[:45]})
    assert fill_answers(df, factory, store, tasks=1, batch_chars=12) == 6
    calls = asked()
    assert sorted(p for c in calls for p in c) == sorted({r[3] for r in rows[45:] if r[3]})
    assert all(len("".join(c)) <= 12 or len(c) == 1 for c in calls) and ["x" * 100] in calls
    assert fill_answers(df, factory, store) == 0 and asked() == []
    got = {r.fn_id: r.answer for r in with_answers(df, store).collect()}
    assert got == {r[2]: r[3] and r[3].upper() for r in rows}
    assert fill_answers(df.limit(0), factory, str(tmp_path / "new")) == 0


def test_failed_round_keeps_the_ones_before(spark, tmp_path):
    store = str(tmp_path / "store")
    df = spark.createDataFrame([(f"p{k}",) for k in range(40)], "prompt string")

    def failing():
        def model(prompts):
            if "p7" in prompts:
                raise RuntimeError("down")
            return prompts

        return model

    with pytest.raises(Exception, match="down"):
        fill_answers(df, failing, store, tasks=1, rounds=8)
    left = df.count() - stored_answers(spark, store).count()
    assert fill_answers(df, lambda: lambda prompts: prompts, store) == left
    assert {r.answer for r in stored_answers(spark, store).collect()} == {f"p{k}" for k in range(40)}


def test_custom_template(spark):
    df = spark.createDataFrame([("def f(): pass", "python")], "code string, language string")
    assert render_prompt(df, "{program_language}|{code}").first().prompt == "python|def f(): pass"


def test_repeated_keys_match_many_to_many(spark):
    schema = "path string, key string, doc string"
    old = spark.createDataFrame([("f", "def __init__", "a"), ("f", "def __init__", "b"), ("g", "def x", "same")], schema)
    new = spark.createDataFrame([("f", "def __init__ ", "c"), ("f", "def __init__", " b\n"), ("g", "def x", "same ")], schema)
    found = {(r.original_comment, r.agent_comment) for r in match_pairs(new, old).collect()}
    assert found == {("a", "c"), ("b", "c"), ("a", " b\n")}


def test_model_scores(spark):
    def factory():
        return lambda a, b: [float(len(x) - len(y)) for x, y in zip(a, b)]

    df = spark.createDataFrame([("abc", "a"), ("", "xy")], "original_comment string, agent_comment string")
    assert sorted(r.score for r in score_model(df, factory).collect()) == [-2.0, 2.0]
