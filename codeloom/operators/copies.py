"""Which of several functions of one name in a file goes on as which in the next revision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.diff import NEW, OLD, line_changes
from codeloom.operators.lines import FILE_KEY
from codeloom.operators.structure import running_counts
from codeloom.session import materialize

#: What numbers the copies of a name, behind the name itself.
_COPY = r"#\d+$"

_SIDE = "PARTITION BY path, rev, base"


def copied_functions(fns: DataFrame) -> DataFrame:
    """(path, rev, fn_id, base, start_ln, end_ln) of the functions whose name some revision of their file holds several times. ``fns``
    has ``qualname``, in which copies are numbered; ``base`` is the name without the number."""
    rows = fns.select(*FILE_KEY, "fn_id", "start_ln", "end_ln", "qualname", F.regexp_replace("qualname", _COPY, "").alias("base"))
    several = rows.where("qualname <> base").select("path", "base").distinct()
    return rows.join(several, ["path", "base"], "left_semi").drop("qualname")


def _kept_lines(rows: DataFrame, changes: DataFrame, side: int, name: str) -> DataFrame:
    """(path, rev, base, rank, ``name``): the lines of each function that its side of the step keeps, by their number among all
    that it keeps. Kept lines of both sides follow each other in the same order. Functions and changed lines of a file
    meet as two arrays; running counts give a span's numbers."""
    changed = changes.where(F.col("side") == side).groupBy(*FILE_KEY).agg(F.sort_array(F.collect_list("ln")).alias("lns"))
    listed = rows.groupBy(*FILE_KEY).agg(F.collect_list(F.struct("base", "fn_id", "start_ln", "end_ln")).alias("fns"))
    upto = "ifnull(get(s.counts, {0}), size(s.lns))"
    spans = f"""inline(transform(array(struct(fns, lns, {running_counts('lns')} AS counts)), s -> transform(s.fns, f -> struct(
                  f.base, f.fn_id, f.start_ln - {upto.format('f.start_ln - 1')} AS lo, f.end_ln - {upto.format('f.end_ln')} AS hi)))[0])"""
    none = F.expr("cast(array() AS array<int>)")
    met = listed.join(changed, FILE_KEY, "left").withColumn("lns", F.coalesce("lns", none)).selectExpr(*FILE_KEY, spans)
    return met.where("lo <= hi").select(*FILE_KEY, "base", F.explode(F.sequence("lo", "hi")).alias("rank"), F.col("fn_id").alias(name))


def matched_copies(copied: DataFrame, steps: DataFrame) -> DataFrame:
    """(path, rev, fn_id, prev_rev, prev_fn_id): the function of the revision before that a copied function goes on from.

    ``steps`` are pairs (path, rev, prev_rev, old_content, new_content). Functions of one name go on from each other where
    each has more lines that the aligned diff keeps in common with the other than with any third. Others are taken in order
    between those: the first that is left in a stretch goes on from the first left on the other side. What then has no
    partner is new, or is gone. Functions meet by the lines that they share, never each with each.
    """
    steps = steps.where("prev_rev IS NOT NULL").join(copied.select("path").distinct(), "path", "left_semi")
    changes = materialize(line_changes(steps), "copies")
    ends = materialize(steps.select(*FILE_KEY, "prev_rev"), "steps")
    now = copied.join(ends, FILE_KEY)
    old = copied.withColumnRenamed("rev", "prev_rev").join(ends, ["path", "prev_rev"]).select(now.columns)
    shared = _kept_lines(now, changes, NEW, "fn_id").join(_kept_lines(old, changes, OLD, "prev_fn_id"), [*FILE_KEY, "base", "rank"])
    shared = shared.groupBy(*FILE_KEY, "fn_id", "prev_fn_id").agg(F.count(F.lit(1)).alias("n"))
    best = "row_number() OVER (PARTITION BY path, rev, {} ORDER BY n DESC, {})"
    shared = shared.selectExpr("*", f"{best.format('fn_id', 'prev_fn_id')} AS one", f"{best.format('prev_fn_id', 'fn_id')} AS other")
    kept = materialize(shared.where("one = 1 AND other = 1").select(*FILE_KEY, "fn_id", "prev_fn_id"), "kept")

    def left_over(side: DataFrame, own: str) -> DataFrame:
        """Functions without a partner, numbered within the stretch between those that have one."""
        known = kept.select(*FILE_KEY, F.col(own).alias("fn_id"), F.lit(True).alias("met"))
        rows = side.join(known, [*FILE_KEY, "fn_id"], "left")
        rows = rows.selectExpr("*", f"count_if(met) OVER ({_SIDE} ORDER BY start_ln ROWS UNBOUNDED PRECEDING) AS stretch")
        rows = rows.where("met IS NULL")
        return rows.selectExpr(*FILE_KEY, "base", "stretch", f"row_number() OVER ({_SIDE}, stretch ORDER BY start_ln) AS nth", f"fn_id AS {own}")

    rest = left_over(now, "fn_id").join(left_over(old, "prev_fn_id"), [*FILE_KEY, "base", "stretch", "nth"])
    pairs = kept.select(*FILE_KEY, "fn_id", "prev_fn_id").union(rest.select(*FILE_KEY, "fn_id", "prev_fn_id"))
    return pairs.join(ends, FILE_KEY).select(*FILE_KEY, "fn_id", "prev_rev", "prev_fn_id")


def identities(copied: DataFrame, matched: DataFrame) -> DataFrame:
    """(path, rev, fn_id, identity) of copied functions: one identity for all that go on from each other.

    Each function points to the one it goes on from; pointers are doubled until all lead to a first one, so rounds grow with
    the logarithm of a file's revisions. A round's pointers are written.
    """
    at = F.struct(F.col("rev"), F.col("fn_id"))
    to = F.when(F.col("prev_rev").isNotNull(), F.struct(F.col("prev_rev").alias("rev"), F.col("prev_fn_id").alias("fn_id")))
    links = copied.join(matched, [*FILE_KEY, "fn_id"], "left")
    links = materialize(links.select("path", at.alias("at"), F.coalesce(to, at).alias("to")), "identities")
    while True:
        far = links.select("path", F.col("at").alias("to"), F.col("to").alias("further"))
        links = materialize(links.join(far, ["path", "to"]).select("path", "at", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")), "identities")
        if links.where("moved").isEmpty():
            break
        links = links.drop("moved")
    return links.select("path", "at.rev", "at.fn_id", F.format_string("@%d:%d", "to.rev", "to.fn_id").alias("identity"))
