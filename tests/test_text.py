import os.path

from pyspark.sql import functions as F

from codeloom.functions.text import LANGUAGES, fill_prompt, is_comment_only, language_of, strip_ws


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def answers(spark, values, expression):
    return [r.x for r in column(spark, values).select("i", expression.alias("x")).orderBy("i").collect()]


def test_language(spark):
    paths = ["a.b.py", ".py", "d.x/file", "a.PY", "x/.a.py", "..py", "a/b.rs", "n", "x.", "a.tar.go", "d.py/x.java"]
    expected = [LANGUAGES.get(os.path.splitext(p)[1]) for p in paths]
    assert answers(spark, paths, language_of(F.col("v"))) == expected


def test_valid_answers(spark):
    valid = ['"""Doc."""', "'''a\n\"\"\" b'''", "# a\n\n  # b\n", "", " \n", '\n"""a "quoted" b"""\n', '"""a\\"""b"""', '""""""']
    assert answers(spark, valid, is_comment_only(F.col("v"))) == [True] * len(valid)


def test_invalid_answers(spark):
    invalid = [
        "x = 1", '"""a"""\n# b', '"""a"""\n"""b"""', 'r"""a"""', '"""a""", f()', "'doc'", "# a\ncode()",
        '"""a', '"""a""""', "Here is the doc:\n" + '"""a"""', "def f():\n    pass",
    ]
    assert answers(spark, invalid, is_comment_only(F.col("v"))) == [False] * len(invalid)


def test_long_answers(spark):
    texts = ['"""' + 'a "b" \\" ' * 60_000 + '"""', "# c\n" * 60_000]
    assert answers(spark, texts, is_comment_only(F.col("v"))) == [True, True]


def test_prompt_keeps_braces_in_code(spark):
    prompt = fill_prompt("{program_language}: {code}", F.lit("python"), F.col("v"))
    assert answers(spark, ["{x} {program_language} {code}"], prompt) == ["python: {x} {program_language} {code}"]


def test_strip_ws(spark):
    assert answers(spark, ["\n\t a b \n", "", "x"], strip_ws(F.col("v"))) == ["a b", "", "x"]
