"""Batch generation of docs by a user's model, and what becomes of the answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import fill_prompt, is_comment_only
from codeloom.operators.lines import FILE_KEY
from codeloom.operators.skew import hot_split_join
from codeloom.session import materialize

TextModel = Callable[[list[str]], list[str]]

DEFAULT_TEMPLATE = (
    "Write the documentation comment of the {program_language} function below, following the best practice of "
    "that language. Answer with the comment only.\n\n{code}\n"
)


def render_prompt(slots: DataFrame, template: str = DEFAULT_TEMPLATE, language: str = "language") -> DataFrame:
    """Add ``prompt`` to rows with ``code`` and a language column."""
    return slots.withColumn("prompt", fill_prompt(template, F.col(language), F.col("code")))


def _asking(factory: Callable[[], TextModel], batch_chars: int | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A task's work: a model, asked for the prompts of its batches, at most so many characters at once."""

    def answers_to(model: TextModel, prompts: list[str]) -> list[str]:
        answers = model(prompts)
        if len(answers) != len(prompts):
            raise ValueError(f"{len(answers)} answers for {len(prompts)} prompts")
        return answers

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            prompts, answers, lo, held = batch["prompt"].tolist(), [], 0, 0
            for k, prompt in enumerate(prompts):
                size = len(prompt or "")
                if batch_chars is not None and k > lo and held + size > batch_chars:
                    answers += answers_to(model, prompts[lo:k])
                    lo, held = k, 0
                held += size
            if prompts:
                answers += answers_to(model, prompts[lo:])
            yield batch.drop(columns="prompt").assign(answer=answers)

    return ask


def map_generate(
    prompts: DataFrame, factory: Callable[[], TextModel], dedupe: bool = True, tasks: int | None = None, batch_chars: int | None = None
) -> DataFrame:
    """Add ``answer`` to rows with a ``prompt``. ``factory`` builds the model, once per task; the model takes a
    list of prompts, one Arrow batch or as much of it as has ``batch_chars`` characters (one longer prompt is asked by
    itself), and returns as many answers. ``tasks`` says how many tasks ask.

    Equal prompts are asked once. Prompts and answers are written to the shared scratch folder when this is called, so
    that a lost executor or a second use of the answers never asks the model again for finished work. ``fill_answers`` and
    ``with_answers`` keep answers between runs.
    """
    ask = _asking(factory, batch_chars)
    if not dedupe:
        schema = prompts.drop("prompt").schema.add("answer", "string")
        dealt = prompts.repartition(tasks) if tasks else prompts
        return materialize(dealt.mapInPandas(ask, schema), "answers")
    asked = materialize(prompts.withColumn("prompt_id", F.sha2("prompt", 256)), "prompts")
    unique = asked.select("prompt_id", "prompt").dropDuplicates(["prompt_id"])
    unique = unique.repartition(tasks, "prompt_id") if tasks else unique
    answers = materialize(unique.mapInPandas(ask, "prompt_id string, answer string"), "answers")
    spread = [c for c in asked.columns if c not in ("prompt", "prompt_id", "code")]
    return hot_split_join(asked.drop("prompt"), answers, ["prompt_id"], spread).drop("prompt_id")


def fill_answers(
    prompts: DataFrame, factory: Callable[[], TextModel], store: str, tasks: int | None = None, batch_chars: int | None = None, rounds: int = 1
) -> int:
    """Ask the model for those prompts that the table ``store`` has no answer to, append the answers, and return how many.

    The store holds (prompt_id, answer), the id being the prompt's SHA-256; the first call makes it. This is an action: what is
    missing is written to the shared scratch folder, then asked in ``rounds`` parts of about equal size. The answers of a
    part are in the store for good once it is done, so a run that fails, or is made again with more prompts, asks
    for the rest only. ``tasks`` and ``batch_chars`` are those of ``map_generate``. Null prompts are not asked.
    """
    spark = prompts.sparkSession
    ids = prompts.where("prompt IS NOT NULL").select(F.sha2("prompt", 256).alias("prompt_id"), "prompt").dropDuplicates(["prompt_id"])
    missing = materialize(ids.join(stored_answers(spark, store).select("prompt_id"), "prompt_id", "left_anti"), "missing")
    total = missing.count()
    for k in range(rounds if total else 0):
        part = missing.where(F.pmod(F.xxhash64("prompt_id"), F.lit(rounds)) == k)
        part = part.repartition(tasks, "prompt_id") if tasks else part
        part.mapInPandas(_asking(factory, batch_chars), ANSWERS).write.mode("append").parquet(store)
    return total


def with_answers(prompts: DataFrame, store: str) -> DataFrame:
    """Add ``answer`` to rows with a ``prompt`` from the table ``store``; null where it has none. Nothing is asked and nothing
    runs before an action. Answers that two runs gave to one prompt at the same time count as the lesser of them."""
    answers = stored_answers(prompts.sparkSession, store).groupBy("prompt_id").agg(F.min("answer").alias("answer"))
    rows = prompts.withColumn("prompt_id", F.sha2("prompt", 256))
    spread = [c for c in prompts.columns if c not in ("prompt", "code")]
    return hot_split_join(rows.drop("prompt"), answers, ["prompt_id"], spread, how="left").drop("prompt_id")


ANSWERS = "prompt_id string, answer string"


def stored_answers(spark: SparkSession, store: str) -> DataFrame:
    """(prompt_id, answer) of an answer store, empty where there is none yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ANSWERS)
    return spark.read.schema(ANSWERS).parquet(store)


def validate_comment(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Add ``success``: the answer holds comments only."""
    return answers.withColumn("success", is_comment_only(F.col(answer)))


def attempt_log(answers: DataFrame) -> DataFrame:
    """(path, rev, fn_id, success, comment): every answer with its validity."""
    return validate_comment(answers).select(*FILE_KEY, "fn_id", "success", F.col("answer").alias("comment"))


def accepted_insertions(attempts: DataFrame, slots: DataFrame) -> DataFrame:
    """Slots whose attempt was valid, with its comment."""
    valid = attempts.where("success").select(*FILE_KEY, "fn_id", "comment")
    return slots.join(valid, [*FILE_KEY, "fn_id"])
