"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "codeloom", **conf: str) -> SparkSession:
    """A session with the settings this library is tuned for.

    ``spark.sql.shuffle.partitions`` stays at the cluster's value unless given: AQE coalesces small
    partitions, so on a cluster it should be set high (a few per core). Files are shuffled as compact rows
    that grow into many line rows afterwards, hence the small partition size below which AQE coalesces.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's checkpoint folder, for tables that cut lineage.

    The folder is ``spark.checkpoint.dir``, or the warehouse where that is unset: both are shared by all executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


def materialize(df, name: str):
    """Write ``df`` to the shared scratch folder and read it back, so that costly rows are made once."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
