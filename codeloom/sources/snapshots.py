"""File trees as tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import materialize

#: Bytes of files that one task reads, and that one batch of it holds at most (a larger file is a batch of its own).
TASK_BYTES = 64 << 20
BATCH_BYTES = 16 << 20

_ENTRIES = "file string, folder boolean, size bigint"


def load_snapshot(spark: SparkSession, root: str, rev: int, glob: str = "*.py") -> DataFrame:
    """(rev, path, content): every file below the folder ``root`` whose name fits ``glob``, one row each, empty files and names
    that begin with ``_`` or ``.`` included. Bytes that are not UTF-8 become replacement characters, and a byte order
    mark is dropped.

    Tasks list the tree, a level at a time, and read the files; only counts come to the driver. The listing is written to
    the shared scratch folder when this is called, contents are read with the rows. Folders are reached through Arrow's
    file systems (local, HDFS, object stores). A folder that does not exist is an error, one without files an empty table.
    """
    store, path = _located(spark, root)
    files = list_files(spark, root, glob)
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(n, max(-(-size // TASK_BYTES), spark.sparkContext.defaultParallelism)))
    base = path.rstrip("/") + "/"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, prefix = _opened(store)
        for batch in batches:
            names, contents, held = [], [], 0
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if names and held + size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["file", "bytes"])
                    names, contents, held = [], [], 0
                with system.open_input_stream(prefix + name) as f:
                    contents.append(f.read())
                names.append(name)
                held += len(contents[-1])
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["file", "bytes"])

    rows = files.select("file", "size").repartition(tasks, "file").mapInArrow(read, "file string, bytes binary")
    return rows.select(
        F.lit(rev).cast("bigint").alias("rev"),
        F.when(F.startswith("file", F.lit(base)), F.substr("file", F.lit(len(base) + 1))).otherwise(F.col("file")).alias("path"),
        F.regexp_replace(F.make_valid_utf8(F.col("bytes").cast("string")), "^\ufeff", "").alias("content"),
    )


def write_files(files: DataFrame, root: str) -> None:
    """Write each row (file, content) as the file ``root``/``file``, in UTF-8; folders are made where they lack. A name may come once
    only. Tasks write through Arrow's file systems, where Spark's own writer takes many calls and on local disks new processes per
    file. A file gets its name when it is whole, so a task that is run again does no harm.
    """
    store, path = _located(files.sparkSession, root)
    base = path.rstrip("/") + "/"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, prefix = _opened(store)
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                target = prefix + base + name.as_py()
                system.create_dir(target.rpartition("/")[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(content.as_buffer() or b"")
                system.move(part, target)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    rows = files.select("file", F.col("content").cast("binary").alias("content"))
    rows.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(file, size) of every file below ``root`` whose name fits ``glob``, a glob as Spark's file sources take it. Each level of
    folders is listed by tasks and written, so neither names nor folders pass through the driver."""
    store, path = _located(spark, root)
    fits = re.compile(spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern(), re.DOTALL)

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, prefix = _opened(store)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                here = system.get_file_info(prefix + folder)
                found = [here] if here.is_file else system.get_file_info(fs.FileSelector(prefix + folder))
                kept = [f for f in found if f.type == fs.FileType.Directory or (f.is_file and fits.fullmatch(f.base_name))]
                for lo in range(0, len(kept), 10_000):
                    part = kept[lo : lo + 10_000]
                    columns = [
                        pa.array([f.path[len(prefix) :] for f in part], pa.string()),
                        pa.array([not f.is_file for f in part], pa.bool_()),
                        pa.array([f.size or 0 for f in part], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "folder", "size"])

    level = spark.createDataFrame([(path, True, 0)], _ENTRIES)
    n, files = 1, None
    while n:
        tasks = min(n, 4 * spark.sparkContext.defaultParallelism)
        level = materialize(level.where("folder").select("file").repartition(tasks).mapInArrow(children, _ENTRIES), "listing")
        found = level.where("NOT folder").select("file", "size")
        files = found if files is None else files.union(found)
        n = level.where("folder").count()
    return files


def _located(spark: SparkSession, root: str) -> tuple[str, str]:
    """Store and path of a folder, as Spark reads its name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    scheme = {"s3a": "s3", "s3n": "s3"}.get(uri.getScheme(), uri.getScheme())
    return ("" if scheme == "file" else f"{scheme}://{uri.getAuthority() or ''}"), uri.getPath()


def _opened(store: str) -> tuple[fs.FileSystem, str]:
    """The store's file system, and what precedes a path in it."""
    if not store:
        return fs.LocalFileSystem(), ""
    system, base = fs.FileSystem.from_uri(store + "/")
    return system, base.rstrip("/")


def write_snapshot(sources: DataFrame, target: str, mode: str = "append") -> None:
    """Write files as parquet, a folder per revision. Rows are dealt by revision first, so a small revision is one file
    and not one per task; Spark splits those of a large revision over several tasks."""
    sources.hint("rebalance", "rev").write.mode(mode).partitionBy("rev").parquet(target)


def read_snapshot(spark: SparkSession, target: str) -> DataFrame:
    schema = "path string, content string, rev bigint"
    return spark.read.schema(schema).parquet(target).select("rev", "path", "content")
