"""Text to line rows and back, and edits by line number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import line_array

FILE_KEY = ["path", "rev"]


def cluster_files(sources: DataFrame) -> DataFrame:
    """Shuffle whole files once by (path, rev). Every window and grouping on lines of a file reuses this
    partitioning; call it before the lines are exploded, when a row still is a compact file.

    A group is one revision of one file, so it is never larger than a content value; a path with many
    revisions is spread over many tasks.
    """
    return sources.repartition(*FILE_KEY)


def explode_lines(sources: DataFrame, content: str = "content", ends: bool = False) -> DataFrame:
    """(path, rev, ln, text): one row per line, counted from 1. With ``ends`` also ``eol``, what ends the line: a break of
    either kind or nothing. An empty file then has one row without an end, so that ``assemble_files`` gives back every
    file as it was."""
    if ends:
        pieces = F.regexp_extract_all(F.col(content), F.lit("[^\n]*\n|[^\n]+"), F.lit(0))
        whole = F.when(F.col(content) == "", F.array(F.lit(""))).otherwise(pieces)
        rows = sources.select(*FILE_KEY, F.posexplode(whole).alias("_pos", "_line"))
        text = F.regexp_replace("_line", "\r?\n\\z", "")
        return rows.select(
            *FILE_KEY, (F.col("_pos") + 1).alias("ln"), text.alias("text"),
            F.substr("_line", F.char_length(text) + 1).alias("eol"),
        )
    return sources.select(*FILE_KEY, F.posexplode(line_array(F.col(content))).alias("_pos", "text")).select(
        *FILE_KEY, (F.col("_pos") + 1).alias("ln"), "text"
    )


def assemble_files(lines: DataFrame, order: str = "ln", final_newline: bool = False) -> DataFrame:
    """(path, rev, content) from line rows; the inverse of ``explode_lines`` if they have their ends. Lines without ``eol``
    are joined by line breaks, and ``final_newline`` adds one to every file."""
    if "eol" in lines.columns:
        pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat("text", "eol").alias("t"))))
        whole = F.array_join(F.transform(pieces, lambda row: row["t"]), "")
        return lines.groupBy(*FILE_KEY).agg(whole.alias("content"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    content = F.array_join(F.transform(rows, lambda row: row["t"]), "\n")
    if final_newline:
        content = F.concat(content, F.lit("\n"))
    return lines.groupBy(*FILE_KEY).agg(content.alias("content"))


def apply_edits(sources: DataFrame, edits: DataFrame, flag: str | None = None) -> DataFrame:
    """Replace lines ``from_ln``..``to_ln`` by the array ``new_lines`` in every file that has edits.

    ``to_ln = from_ln - 1`` inserts before ``from_ln``; edits of one file must not overlap. Content is cut
    and joined inside its own row, so lines are never shuffled; line ends other than those of replaced
    lines are kept as they are. With ``flag``, that column tells whether any edit of the file had ``flag`` set.
    """
    aggs = [F.expr("array_sort(collect_list(struct(from_ln, to_ln, new_lines))) AS todo")]
    if flag:
        aggs.append(F.expr("bool_or(flag) AS flagged"))
    plan = edits.groupBy(*FILE_KEY).agg(*aggs)
    before = "ifnull(get(s.todo, i - 1).to_ln, 0)"
    rewritten = f"""transform(array(struct(todo, split(content, '\\n') AS lines)), s -> concat(
        flatten(transform(s.todo, (e, i) -> concat(
            slice(s.lines, {before} + 1, e.from_ln - {before} - 1), e.new_lines))),
        slice(s.lines, element_at(s.todo, -1).to_ln + 1, size(s.lines))))[0]"""
    joined = sources.join(plan, FILE_KEY, "left")
    content = f"if(todo IS NULL, content, array_join({rewritten}, '\\n')) AS content"
    kept = [c for c in sources.columns if c not in ("content", flag)]
    extra = [f"ifnull(flagged, false) AS {flag}"] if flag else []
    return joined.selectExpr(*kept, content, *extra)
