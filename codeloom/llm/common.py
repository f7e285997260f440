"""Small helpers that the operators share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that end a word: space, and tab to carriage return.
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; sessions that set none use the warehouse, which every cluster has."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return os.path.join(root, f"llm-{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared scratch and read it back: its rows are made once and survive lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str | Column = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text that is not null."""
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """One row (doc_id, label) per labelled document: the smallest of several labels; null labels and ids count as none."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    return known.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label"))


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is in fold 0 of its own making."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts, F.lit(0))


def with_label(docs: DataFrame, labels: DataFrame, broadcast_rows: int, how: str = "inner") -> DataFrame:
    """Join one label per document. The labels are counted first: up to ``broadcast_rows`` of them (24 bytes each)
    are broadcast, more are joined by a shuffle."""
    if labels.limit(broadcast_rows + 1).count() <= broadcast_rows:
        labels = F.broadcast(labels)
    return docs.join(labels, "doc_id", how)
