"""Snapshots and revisions of a file tree."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from codeloom.functions.text import language_of
from codeloom.operators.skew import BLOCK_SPAN, block_of, with_previous


def with_language(sources: DataFrame) -> DataFrame:
    return sources.withColumn("language", language_of(F.col("path")))


def filter_supported(sources: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """Rows of a known language whose path is not excluded."""
    known = sources if "language" in sources.columns else with_language(sources)
    kept = known.where(F.col("language").isNotNull())
    paths = list(exclude)
    return kept.where(~F.col("path").isin(paths)) if paths else kept


def commit_range(commits: DataFrame, end: int, start: int) -> DataFrame:
    """Commits with newest-first index in [end, start), processed oldest first; the oldest is the base.

    Only the newest ``start`` commits reach the single-task numbering: Spark takes them as a top-k.
    """
    newest = commits.orderBy(F.desc("rev")).limit(start)
    numbered = newest.withColumn("idx", (F.row_number().over(Window.orderBy(F.desc("rev"))) - 1).cast("bigint"))
    picked = numbered.where(F.col("idx") >= end)
    oldest = F.max("idx").over(Window.partitionBy())
    return picked.withColumn("is_base", F.col("idx") == oldest).orderBy("rev")


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Compare two snapshots: (path, status, old_content, new_content), unchanged files dropped.

    Deletions are a status of their own with null ``new_content``. Digests of all files are compared first; contents
    are fetched only for the paths that differ, so unchanged contents are never shuffled with each other.
    """
    sides = [(old, "old"), (new, "new")]
    marks = [s.select("path", F.sha2("content", 256).alias(f"{n}_mark")) for s, n in sides]
    status = (
        F.when(F.col("old_mark").isNull(), "added").when(F.col("new_mark").isNull(), "deleted").otherwise("modified")
    )
    changed = (
        marks[0].join(marks[1], "path", "full_outer")
        .where(~F.col("old_mark").eqNullSafe(F.col("new_mark")))
        .select("path", status.alias("status"))
    )
    for side, name in sides:
        changed = changed.join(side.select("path", F.col("content").alias(f"{name}_content")), "path", "left")
    return changed


def change_pairs(changes: DataFrame, rev: int) -> DataFrame:
    """File changes of one step as (path, rev, old_content, new_content), deletions left out."""
    return changes.where(F.col("status") != "deleted").select(
        "path", F.lit(rev).cast("bigint").alias("rev"), "old_content", "new_content"
    )


def previous_revision(sources: DataFrame, span: int = BLOCK_SPAN, keep: Sequence[str] = ()) -> DataFrame:
    """(path, rev, prev_rev, old_content, new_content, …keep): every revision with the one before it. A null content
    is a deletion: the revision after it has no old content.

    Only paths and revision numbers are ordered; contents meet by an equality join on both, spread by revision. They are
    never broadcast: their compressed size, by which Spark would decide, is small beside what the driver would get."""
    narrow = with_previous(sources.select("path", "rev"), ["path"], "rev", ["rev"], block_of("rev", span), "_prev")
    steps = narrow.select("path", "rev", F.col("_prev.rev").alias("prev_rev"))
    before = sources.select("path", F.col("rev").alias("prev_rev"), F.col("content").alias("old_content"))
    paired = sources.select("path", "rev", F.col("content").alias("new_content"), *keep).hint("merge").join(steps, ["path", "rev"])
    return paired.join(before.hint("merge"), ["path", "prev_rev"], "left").select("path", "rev", "prev_rev", "old_content", "new_content", *keep)


def as_of_snapshot(sources: DataFrame, rev: int | Column) -> DataFrame:
    """The tree at ``rev``: per path the content of its last revision not after it. Paths whose last revision there has a
    null content were deleted and are not in the tree. Contents are joined to the last revisions, never grouped."""
    last = sources.where(F.col("rev") <= rev).groupBy("path").agg(F.max("rev").alias("rev"))
    return sources.where("content IS NOT NULL").join(last, ["path", "rev"], "left_semi").select("path", "rev", "content")


def overlay_snapshot(base: DataFrame, patch: DataFrame) -> DataFrame:
    """The base tree with the paths of ``patch`` replaced or added."""
    return base.join(patch, "path", "left_anti").unionByName(patch)


def modified_paths(changes: DataFrame) -> DataFrame:
    """Distinct supported paths touched in a range."""
    return filter_supported(changes.select("path")).select("path").distinct()


def path_lives(sources: DataFrame, keep_deleted: bool = False, span: int = BLOCK_SPAN) -> DataFrame:
    """(path, from_rev, to_rev): the half-open ranges of revisions in which a path is there, ``to_rev`` null while it still is.

    ``sources`` (rev, path, content) is sparse: a path has rows where it changes, one with a null content where it is deleted.
    With ``keep_deleted`` deletions are passed over, so a path stays from its first revision on. Only paths and numbers are
    ordered, those of a path with very many revisions in blocks.
    """
    rows = sources.select("path", "rev", F.col("content").isNotNull().alias("alive"))
    if keep_deleted:
        rows = rows.where("alive")
    seen = with_previous(rows, ["path"], "rev", ["alive"], block_of("rev", span), "_prev")
    turns = seen.where(F.col("alive") != F.coalesce("_prev.alive", F.lit(False))).select("path", "rev", "alive")
    ends = with_previous(turns, ["path"], "rev", ["rev"], block_of("rev", span), "_born").where("NOT alive")
    ended = ends.select("path", F.col("_born.rev").alias("from_rev"), F.col("rev").alias("to_rev"))
    last = turns.groupBy("path").agg(F.max_by("alive", "rev").alias("alive"), F.max("rev").alias("from_rev")).where("alive")
    return ended.unionByName(last.select("path", "from_rev", F.lit(None).cast("bigint").alias("to_rev")))
