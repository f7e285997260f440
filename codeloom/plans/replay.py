"""A whole range of commits documented in one batch job."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.copies import copied_functions, identities, matched_copies
from codeloom.operators.diff import changed_lines
from codeloom.operators.generate import DEFAULT_TEMPLATE, TextModel, map_generate, render_prompt, validate_comment
from codeloom.operators.lines import FILE_KEY, cluster_files
from codeloom.operators.revisions import as_of_snapshot, commit_range, filter_supported, previous_revision
from codeloom.operators.rewrite import apply_insertions, strip_comments
from codeloom.operators.score import match_pairs
from codeloom.operators.skew import BLOCK_SPAN, block_of, listed_keys, with_latest, with_previous
from codeloom.operators.structure import changed_functions, function_doc_pairs, functions, with_code
from codeloom.session import materialize
from codeloom.sources.results import replace_run


class Replay(NamedTuple):
    events: DataFrame
    """(path, rev, qualname, key, success, comment): every function asked for, with its answer."""
    docs: DataFrame
    """(path, rev, qualname, key, doc): every function of every revision with its current doc, if any."""
    tree: DataFrame
    """(path, rev, content): every revision with the docs that are current there, and no others."""


def range_sources(sources: DataFrame, commits: DataFrame, end: int, start: int, keep_deleted: bool = False) -> DataFrame:
    """(rev, path, content, is_base): the tree at the base of a commit range, and all later revisions in it. With
    ``keep_deleted`` a path stays as it was where a later revision deletes it."""
    picked = commit_range(commits, end, start)
    base, last = (picked.agg(f("rev").alias("rev")).scalar() for f in (F.min, F.max))
    tree = as_of_snapshot(sources, base).select(base.alias("rev"), "path", "content", F.lit(True).alias("is_base"))
    later = sources.where((F.col("rev") > base) & (F.col("rev") <= last)).join(picked.select("rev"), "rev", "left_semi")
    if keep_deleted:
        later = later.where("content IS NOT NULL")
    return tree.unionByName(later.select("rev", "path", "content", F.lit(False).alias("is_base")))


def replay_history(
    sources: DataFrame,
    commits: DataFrame,
    end: int,
    start: int,
    factory: Callable[[], TextModel],
    template: str = DEFAULT_TEMPLATE,
    span: int = BLOCK_SPAN,
    keep_deleted: bool = False,
    exclude: Iterable[str] = (),
    step: int = 4,
) -> Replay:
    """Document the functions each commit of a range changes, as if the commits came one by one.

    Going through commits one at a time, only code decides what is asked again, and a function keeps its last
    accepted doc. So all revisions are stripped of docs and compared with the one before at once, and current
    docs are carried forward afterwards. No commit waits for another.

    A function goes on under its name. Where a file holds a name several times, as getters and setters or overloads do, its
    copies go on from each other by the lines that the diff keeps. ``keep_deleted`` keeps deleted files, with their docs;
    paths in ``exclude`` are left out.
    """
    history = filter_supported(range_sources(sources, commits, end, start, keep_deleted), exclude).where("language = 'python'")
    bare = materialize(strip_comments(cluster_files(history)).drop("language", "leaves_empty"), "bare")
    fns = materialize(functions(cluster_files(bare), qualified=True).drop("doc", "doc_tail"), "functions")
    steps = previous_revision(bare, span, keep=["is_base"])
    changed = changed_functions(fns, changed_lines(steps.where("NOT is_base")))
    asked = with_code(changed, cluster_files(bare)).select(*FILE_KEY, "fn_id", "qualname", "key", "code")
    answers = map_generate(render_prompt(asked.withColumn("language", F.lit("python")), template), factory)
    # Written once: the docs, the tree and each scoring read them, and would compare and ask again.
    events = materialize(
        validate_comment(answers).select(*FILE_KEY, "qualname", "key", "success", F.col("answer").alias("comment")), "events"
    )
    accepted = events.where("success").select(*FILE_KEY, "qualname", "comment")
    known = materialize(with_identity(fns, steps).join(accepted, [*FILE_KEY, "qualname"], "left"), "known")
    docs = materialize(current_docs(known, bare.select(*FILE_KEY), span), "docs")
    tree = documented_tree(bare.where("content IS NOT NULL").select(*FILE_KEY, "content"), docs, step)
    return Replay(events, docs.select(*FILE_KEY, "qualname", "key", "doc"), tree)


def with_identity(fns: DataFrame, steps: DataFrame) -> DataFrame:
    """Add ``identity``: the name of a function whose name its file never repeats, else that of its chain of copies. Without
    copies anywhere nothing is compared."""
    copied = materialize(copied_functions(fns), "copied")
    named = fns.withColumn("identity", F.col("qualname"))
    if copied.isEmpty():
        return named
    chains = identities(copied, matched_copies(copied, steps)).withColumnRenamed("identity", "_chain")
    return named.join(chains, [*FILE_KEY, "fn_id"], "left").withColumn("identity", F.coalesce("_chain", "identity")).drop("_chain")


def documented_tree(bare: DataFrame, docs: DataFrame, step: int = 4) -> DataFrame:
    """(path, rev, content): files without docs get those of ``docs`` (path, rev, fn_id, header_end_ln, end_ln, indent, doc) behind
    the headers. All docs of a file are placed in one pass over its lines; one-line functions have no place for one."""
    slots = docs.where("doc IS NOT NULL AND end_ln > header_end_ln").selectExpr(
        *FILE_KEY,
        "fn_id",
        "header_end_ln + 1 AS slot_ln",
        "header_end_ln AS replace_to_ln",
        f"indent + {step} AS slot_col",
        "'' AS doc_tail",
        "doc AS comment",
    )
    return apply_insertions(cluster_files(bare), slots).select(*FILE_KEY, "content")


def generated_pairs(replay: Replay, sources: DataFrame) -> DataFrame:
    """(path, rev, code, original_comment, agent_comment): accepted docs of each revision beside those that the same revision's
    own sources have for functions of that name, where they differ. All revisions are paired at once."""
    accepted = replay.events.where("success").select(*FILE_KEY, "key", F.col("comment").alias("doc"))
    files = sources.where("content IS NOT NULL").join(accepted.select(*FILE_KEY).distinct(), FILE_KEY, "left_semi")
    return match_pairs(accepted, function_doc_pairs(functions(cluster_files(files))), FILE_KEY)


def score_replay(
    replay: Replay, sources: DataFrame, scorer: Callable[[DataFrame], DataFrame], target: str, run_id: str
) -> DataFrame:
    """Score the pairs of a replay by ``scorer``, which adds ``score`` to rows with both comments, and put them into the table
    ``target`` as the run ``run_id``. The same run written again replaces its rows. Returns the table."""
    replace_run(scorer(generated_pairs(replay, sources)), target, run_id)
    return replay.events.sparkSession.read.parquet(target)


def current_docs(known: DataFrame, files: DataFrame, span: int = BLOCK_SPAN) -> DataFrame:
    """Add ``doc``, the last accepted comment of a function at or before each revision of its file, to rows (path, rev,
    identity, comment, …). A function that the revision before lacks is a new one and starts without a doc."""
    block, keys = block_of("rev", span), ["path", "identity"]
    hot = listed_keys(known, keys)
    steps = with_previous(files, ["path"], "rev", ["rev"], block, "_step").select(*FILE_KEY, F.col("_step.rev").alias("_before"))
    seen = with_previous(known, keys, "rev", ["rev"], block, "_own", hot=hot).join(steps, FILE_KEY)
    stays = F.col("_own.rev").eqNullSafe(F.col("_before")) & F.col("_before").isNotNull()
    told = F.when(F.col("comment").isNotNull() | ~stays, F.struct("comment"))
    latest = with_latest(seen.withColumn("_told", told), keys, "rev", "_told", block, "_doc", hot=hot)
    return latest.withColumn("doc", F.col("_doc.comment")).drop("_own", "_before", "_told", "_doc")
