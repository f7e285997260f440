"""Rewrites of file contents: strip, restore and insert docs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import line_array
from codeloom.operators.diff import NEW, OLD, changed_lines, line_changes
from codeloom.operators.lines import FILE_KEY, apply_edits, cluster_files
from codeloom.operators.structure import changed_functions, functions, running_counts


def old_side(pairs: DataFrame) -> DataFrame:
    return pairs.where("old_content IS NOT NULL").selectExpr("path", "rev", "old_content AS content")


def new_side(pairs: DataFrame) -> DataFrame:
    return pairs.where("new_content IS NOT NULL").selectExpr("path", "rev", "new_content AS content")


def _without_docs(sources: DataFrame, fns: DataFrame) -> DataFrame:
    edits = fns.where("doc_start_ln IS NOT NULL").selectExpr(
        *FILE_KEY,
        "doc_start_ln AS from_ln",
        "doc_end_ln AS to_ln",
        "cast(array() AS array<string>) AS new_lines",
        "doc_end_ln >= end_ln AS flag",
    )
    return apply_edits(sources, edits, flag="leaves_empty").withColumn("content", F.concat("content", F.lit("\n")))


def strip_comments(sources: DataFrame) -> DataFrame:
    """Drop the docs of all functions; one line break is appended. ``leaves_empty`` marks files where a doc was
    the whole body of a function, which then has none."""
    return _without_docs(sources, functions(sources))


def strip_changed_comments(pairs: DataFrame, mode: str = "aligned") -> DataFrame:
    """The new contents without the docs of functions that changed."""
    sources = cluster_files(new_side(pairs))
    return _without_docs(sources, changed_functions(functions(sources), changed_lines(pairs, mode)))


def restore_comments(pairs: DataFrame) -> DataFrame:
    """The cleaned (new) contents with those doc lines of the old side put back that are missing from them, for
    functions of the old side that are still present, told by their names behind those of the classes and functions
    around them. No line break at the end.

    A missing line goes behind the line that the last kept line before it became: a line with k kept lines
    before it on the old side follows the k-th kept line of the new side.
    """
    lines = line_changes(pairs).groupBy(*FILE_KEY).agg(
        F.expr(f"array_sort(collect_list(ln) FILTER (WHERE side = {OLD})) AS gone"),
        F.expr(f"array_sort(collect_list(ln) FILTER (WHERE side = {NEW})) AS come"),
    )
    def named(side: DataFrame) -> DataFrame:
        fns = functions(cluster_files(side), qualified=True)
        return fns.withColumn("base", F.regexp_replace("qualname", "#[0-9]+$", ""))

    old_fns = named(old_side(pairs)).groupBy(*FILE_KEY).agg(
        F.expr("collect_list(struct(base, doc_start_ln, doc_end_ln, false AS present)) AS old_fns")
    )
    new_fns = named(new_side(pairs)).groupBy(*FILE_KEY).agg(
        F.expr("collect_list(struct(base, int(null) AS doc_start_ln, int(null) AS doc_end_ln, true AS present)) AS new_fns")
    )
    docs = (
        old_fns.join(new_fns, FILE_KEY)
        .selectExpr(*FILE_KEY, "inline(concat(old_fns, new_fns))")
        .groupBy(*FILE_KEY, "base")
        .agg(
            F.expr("bool_or(present) AS present"),
            F.expr("collect_list(struct(doc_start_ln, doc_end_ln)) FILTER (WHERE doc_start_ln IS NOT NULL) AS docs"),
        )
        .where("present")
        .groupBy(*FILE_KEY)
        .agg(F.expr("flatten(collect_list(docs)) AS docs"))
    )
    # A line's rank among the changed lines of its side tells how many kept lines stand before it.
    kept = "transform({0}, (l, i) -> l - i - 1)"
    missing = (
        docs.join(lines, FILE_KEY)
        .selectExpr(*FILE_KEY, "docs", "gone", f"{kept.format('gone')} AS old_kept", f"{kept.format('come')} AS new_kept")
        .selectExpr("*", f"{running_counts('gone')} AS gone_upto", f"{running_counts('new_kept')} AS come_upto")
        .selectExpr(
            *FILE_KEY,
            """inline(flatten(transform(docs, d -> transform(
                 slice(arrays_zip(gone, old_kept), ifnull(get(gone_upto, d.doc_start_ln - 1), size(gone)) + 1,
                       ifnull(get(gone_upto, d.doc_end_ln), size(gone)) - ifnull(get(gone_upto, d.doc_start_ln - 1), size(gone))),
                 g -> struct(g.gone AS ln, g.old_kept + if(g.old_kept = 0, 0,
                       ifnull(get(come_upto, g.old_kept - 1), size(new_kept))) AS after_ln)))))""",
        )
    )
    spots = (
        missing.groupBy(*FILE_KEY, "after_ln")
        .agg(F.expr("array_sort(collect_set(ln)) AS lns"))
        .groupBy(*FILE_KEY)
        .agg(F.expr("collect_list(struct(after_ln, lns)) AS spots"))
    )
    old_lines = cluster_files(pairs).select(*FILE_KEY, line_array(F.col("old_content")).alias("old_lines"))
    edits = spots.join(old_lines, FILE_KEY).selectExpr(
        *FILE_KEY,
        """inline(transform(spots, s -> struct(s.after_ln + 1 AS from_ln, s.after_ln AS to_ln,
             transform(s.lns, n -> get(old_lines, n - 1)) AS new_lines)))""",
    )
    cleaned = cluster_files(new_side(pairs)).withColumn("content", F.array_join(line_array(F.col("content")), "\n"))
    return apply_edits(cleaned, edits)


def apply_insertions(
    sources: DataFrame, insertions: DataFrame, indent_all: bool = False, gap_line: bool = True
) -> DataFrame:
    """Put each ``comment`` of ``insertions`` (rows of ``doc_slots`` with a comment) into its slot.

    The first line of a comment is indented to the slot; ``indent_all`` indents the others too. Where a doc is
    replaced, what stood behind it in its last line stays on an indented line of its own, even if empty;
    ``gap_line=False`` drops the empty ones.
    """
    rest = "transform(slice(split(comment, '\\n'), 2, size(split(comment, '\\n'))), l -> if(l = '', l, concat(pad, l)))"
    body = f"concat(array(concat(pad, split(comment, '\\n')[0])), {rest})" if indent_all else "split(concat(pad, comment), '\\n')"
    keep_tail = "replace_to_ln >= slot_ln" + ("" if gap_line else " AND trim(doc_tail) <> ''")
    edits = insertions.selectExpr("*", "repeat(' ', slot_col) AS pad").selectExpr(
        *FILE_KEY,
        "slot_ln AS from_ln",
        "replace_to_ln AS to_ln",
        f"""concat({body}, CASE WHEN {keep_tail} THEN array(concat(pad, ifnull(doc_tail, '')))
            ELSE cast(array() AS array<string>) END) AS new_lines""",
    )
    return apply_edits(sources, edits)
