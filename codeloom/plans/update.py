"""One documentation run: from two snapshots to a tree with new docs."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.diff import changed_lines
from codeloom.operators.generate import DEFAULT_TEMPLATE, TextModel, attempt_log, map_generate, render_prompt, validate_comment
from codeloom.operators.lines import cluster_files
from codeloom.operators.revisions import change_pairs, file_changes, filter_supported, overlay_snapshot
from codeloom.operators.rewrite import apply_insertions, new_side
from codeloom.operators.score import match_pairs
from codeloom.operators.structure import changed_functions, doc_slots, function_doc_pairs, functions
from codeloom.session import materialize


class Update(NamedTuple):
    attempts: DataFrame
    snapshot: DataFrame


def step_pairs(old: DataFrame, new: DataFrame, rev: int, exclude: Iterable[str] = ()) -> DataFrame:
    """Changed and added Python files of one step. Paths are filtered before contents are compared."""
    python = [
        filter_supported(side, exclude).where(F.col("language") == "python").drop("language") for side in (old, new)
    ]
    return change_pairs(file_changes(*python), rev)


def changed_slots(pairs: DataFrame, step: int = 4) -> DataFrame:
    """Doc slots of the functions a pair changed."""
    sources = cluster_files(new_side(pairs))
    return doc_slots(changed_functions(functions(sources), changed_lines(pairs)), sources, step)


def function_docs_changed(pairs: DataFrame) -> DataFrame:
    """(path, rev, fn_id, doc, key) of changed functions that have a doc."""
    return function_doc_pairs(changed_functions(functions(cluster_files(new_side(pairs))), changed_lines(pairs)))


def update_docs(
    old: DataFrame,
    new: DataFrame,
    factory: Callable[[], TextModel],
    rev: int = 1,
    template: str = DEFAULT_TEMPLATE,
    exclude: Iterable[str] = (),
) -> Update:
    """Ask for a doc of every function changed between two snapshots, and put valid answers into the tree."""
    pairs = materialize(step_pairs(old, new, rev, exclude), "pairs")
    slots = changed_slots(pairs).withColumn("language", F.lit("python"))
    answers = map_generate(render_prompt(slots, template), factory)
    valid = validate_comment(answers).where("success").withColumnRenamed("answer", "comment")
    documented = apply_insertions(new_side(pairs), valid).select("path", "content")
    return Update(attempt_log(answers), overlay_snapshot(new.select("path", "content"), documented))


def comment_pairs(original: DataFrame, before: DataFrame, after: DataFrame, rev: int = 1) -> DataFrame:
    """(path, code, original_comment, agent_comment): docs a run changed, beside those of the original files."""
    generated = function_docs_changed(materialize(step_pairs(before, after, rev), "pairs"))
    files = original.withColumn("rev", F.lit(rev).cast("bigint"))
    return match_pairs(generated, function_doc_pairs(functions(cluster_files(files))), ["path"])
