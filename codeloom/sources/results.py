"""Result files of runs: score tables and attempt logs, a folder per run."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of a score file, in order.
SCORE_COLUMNS = {
    "Semantic-Score": "score",
    "Code": "code",
    "Original-Comment": "original_comment",
    "Agent-Comment": "agent_comment",
    "Filename": "filename",
    "Agent-Commit": "agent_commit",
}


def _run_id(name: str) -> Column:
    """Name of the folder above ``name``, which is a file or a folder of part files."""
    return F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/{re.escape(name)}(?:/|$)", 1)


def load_scores(spark: SparkSession, root: str, name: str = "semantic_score.csv") -> DataFrame:
    """(run_id, score, code, original_comment, agent_comment, filename, agent_commit) of ``root/<run>/<name>``."""
    schema = ", ".join(f"`{c}` {'double' if c == 'Semantic-Score' else 'string'}" for c in SCORE_COLUMNS)
    rows = spark.read.csv(
        f"{root}/*/{name}", schema=schema, header=True, multiLine=True, escape='"', quote='"'
    )
    return rows.select(_run_id(name).alias("run_id"), *[F.col(f"`{c}`").alias(n) for c, n in SCORE_COLUMNS.items()])


def load_attempts(spark: SparkSession, root: str, name: str = "success_rate.csv") -> DataFrame:
    """(run_id, success, comment) of ``root/<run>/<name>``: one attempt per line, ``True, '…'``.

    Header lines of either kind do not fit the pattern and drop out. Answers are Python literals in a CSV cell:
    outer quotes are taken off, doubled quotes undone and backslash escapes resolved. Quotes count as doubled where
    every run of them in the cell is even; a cell with an odd run was written as it is.
    """
    fields = r"^\s*\(?(True|False),\s*(.*?)\s*$"
    body = F.regexp_extract("value", fields, 2)
    bare = F.regexp_replace(body, r"""^(?:'(.*)'|""(.*)""|"(.*)")\)?$""", "$1$2$3")
    odd = F.regexp_like(bare, F.lit('(?<!")"(?:"")*(?!")'))
    single = F.when(odd, bare).otherwise(F.replace(bare, F.lit('""'), F.lit('"')))
    mark = F.lit("\u0001")
    text = F.replace(single, F.lit("\\\\"), mark)
    for escape, plain in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\'", "'"), ('\\"', '"')):
        text = F.replace(text, F.lit(escape), F.lit(plain))
    return (
        spark.read.text(f"{root}/*/{name}")
        .where(F.col("value").rlike(fields))
        .select(
            _run_id(name).alias("run_id"),
            (F.regexp_extract("value", fields, 1) == "True").alias("success"),
            F.replace(text, mark, F.lit("\\")).alias("comment"),
        )
    )


def append_run(df: DataFrame, target: str, run_id: str) -> None:
    """Append the rows of one run to a parquet table with a folder per run."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(target)


def replace_run(df: DataFrame, target: str, run_id: str) -> None:
    """Put the rows of one run into such a table in place of what the run has there. Other runs stay, and a job that is
    started again leaves the rows once."""
    rows = df.withColumn("run_id", F.lit(run_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(target)
