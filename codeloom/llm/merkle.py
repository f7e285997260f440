"""Merkle manifests: a tree of digests over each source's rows, one over the sources, and a proof for every row."""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import stored

#: What a leaf covers, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

#: Nodes that become one node, and levels that a superblock spans: 256 leaves, whatever the size of a source.
FANOUT = 16
DEPTH = 2

#: Characters of a digest as hex text.
HEX = 64

#: Rows of a task that are numbered by ``monotonically_increasing_id``.
_ROW_BITS = 33

_PATH = "path array<struct<before: string, after: string>>"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_of(columns: dict[str, Column]) -> Column:
    """Digest of the values: each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    parts = []
    for value in columns.values():
        text = value.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def levels_above(nodes: list[str], fanout: int, levels: int | None) -> list[list[str]]:
    """For each level the runs of its nodes, joined: ``levels`` of them, or as many as leave one node. The last entry is the
    only node left."""
    out = []
    while len(nodes) > 1 if levels is None else len(out) < levels:
        runs = ["".join(nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
        out.append(runs)
        nodes = [digest(r) for r in runs]
    return [*out, nodes]


def _local(n: int, fanout: int, depth: int) -> int | None:
    """Levels that a superblock of a tree of ``n`` nodes is reduced by: all there are in a tree of one superblock."""
    return None if n <= fanout**depth else depth


def _siblings(levels: list[list[str]], at: int, fanout: int):
    """The digests before and after the node's own in its run, level by level."""
    for runs in levels[:-1]:
        run, own = divmod(at, fanout)
        joined = runs[run]
        yield joined[: HEX * own], joined[HEX * (own + 1) :]
        at = run


def reduced(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """(tree, pos, n, digest) one superblock up: a row per superblock of ``nodes``; n is what its tree has of them."""
    width = fanout**depth

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        top = levels_above(rows.sort_values("pos")["digest"].tolist(), fanout, _local(n, fanout, depth))[-1]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [-(-n // width)], "digest": top})

    keyed = nodes.select("tree", F.floor(F.col("pos") / width).alias("block"), "pos", "n", "digest")
    return keyed.groupBy("tree", "block").applyInPandas(reduce, "tree bigint, pos bigint, n bigint, digest string")


def stages_of(nodes: DataFrame, fanout: int, depth: int) -> list[DataFrame]:
    """``nodes`` and the superblocks above them, stage by stage until every tree is one node. Each stage has the
    ``fanout ** depth``-th part of the rows of the one before, and is written."""
    stages = [nodes]
    while len(stages) == 1 or (most := stages[-1].agg(F.max("n")).first()[0]) and most > 1:
        below = stages[-1] if len(stages) == 1 else stages[-1].where("n > 1")
        stages.append(stored(reduced(below, fanout, depth), "subtrees"))
    return stages


def _cogrouped(nodes: DataFrame, outer: DataFrame, width: int, finish, schema: str) -> DataFrame:
    """Superblocks of ``nodes``, each with the row of ``outer`` (tree, pos, path, ...) that tells the nodes outside it."""
    keyed = nodes.withColumn("block", F.floor(F.col("pos") / width))
    around = outer.withColumnRenamed("pos", "block")
    return keyed.groupBy("tree", "block").cogroup(around.groupBy("tree", "block")).applyInPandas(finish, schema)


def paths_of(nodes: DataFrame, outer: DataFrame, fanout: int, depth: int) -> DataFrame:
    """(tree, pos, path) of each node: siblings within its superblock, then those of the superblock's own path."""

    def finish(rows: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        levels = levels_above(rows["digest"].tolist(), fanout, _local(int(rows["n"].iloc[0]), fanout, depth))
        above = [(p["before"], p["after"]) for p in around["path"].iloc[0]]
        paths = [[*_siblings(levels, k, fanout), *above] for k in range(len(rows))]
        as_rows = [[{"before": b, "after": a} for b, a in path] for path in paths]
        return pd.DataFrame({"tree": rows["tree"], "pos": rows["pos"], "path": pd.Series(as_rows, rows.index)})

    return _cogrouped(nodes, outer, fanout**depth, finish, f"tree bigint, pos bigint, {_PATH}")


def outer_paths(stages: list[DataFrame], tops: DataFrame, fanout: int, depth: int) -> DataFrame:
    """(tree, pos, path) of each superblock of the lowest stage. ``tops`` has the path (tree, path) of each tree's own root."""
    outer = None
    for stage in reversed(stages[1:]):
        own = stage.where("n = 1").join(tops, "tree").select("tree", "pos", "path")
        if outer is not None:
            own = own.unionByName(paths_of(stage.where("n > 1"), outer, fanout, depth))
        outer = stored(own, "outer")
    return outer


def ordered_leaves(leaves: DataFrame) -> DataFrame:
    """(mono, leaves...) in the order of source, id and digest: ``mono`` is the task's number above the row's number in it."""
    keys = [F.col(c).asc_nulls_first() for c in ("source", "doc_id", "leaf", "uid")]
    ordered = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("uid")
    return stored(ordered.withColumn("mono", F.monotonically_increasing_id()), "ordered")


def places(ordered: DataFrame) -> DataFrame:
    """(source, part, tree, shift, n): per source and task the source's rank, its rows, and what a row's number in its task
    lacks to its number in its source. There are as many rows as tasks and sources together; sources that begin in one
    task are ranked there, so no task sees them all."""
    part, row = F.shiftright("mono", _ROW_BITS), F.col("mono").bitwiseAND((1 << _ROW_BITS) - 1)
    runs = ordered.select("source", "mono", part.alias("part"), row.alias("row")).groupBy("source", "part").agg(
        F.count(F.lit(1)).alias("rows"), F.min("row").alias("first"), F.min("mono").alias("mono")
    )
    runs = stored(runs, "runs")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("source")
    runs = runs.select(
        "source", "part",
        (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(everything).alias("n"),
        F.min("mono").over(everything).alias("begin"),
        F.col("mono"),
    )
    begins = runs.where("mono = begin").select(F.col("part").alias("at"), "begin")
    per_part = begins.groupBy("at").agg(F.count(F.lit(1)).alias("sources"))
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.select("at", F.coalesce(F.sum("sources").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("at").orderBy("begin")) - 1
    ranked = begins.withColumn("rank", rank).join(per_part, "at").select("begin", (F.col("before") + F.col("rank")).alias("tree"))
    return stored(runs.join(ranked, "begin").select("source", "part", "tree", "shift", "n"), "places")


def merkle_manifest(
    docs: DataFrame,
    received: dict[str, Column] | None = None,
    columns: tuple[str, ...] = COLUMNS,
    fanout: int = FANOUT,
    depth: int = DEPTH,
    proofs: bool = False,
) -> DataFrame:
    """(source, doc_id, pos, n_rows, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``docs``.

    A leaf is the digest of a row's ``columns``. Per source, leaves ascend by doc_id, and every ``fanout`` of them become
    a node until one, the subroot, remains; subroots in order of source give the root likewise. A row's proof holds the
    siblings of its nodes up to the root, ``proof_sha256`` is their digest, and ``proofs`` adds them as ``proof``.
    ``folded_root`` is what the proof makes of the row as ``received``: columns replaced by the given ones, for instance
    by what a copy of the data holds. ``verified`` tells whether that is the root.

    Texts are read once, for their digests. These are ordered by ranges, so a source that holds most rows is dealt over
    many tasks, and numbered by sums over tasks. Superblocks of ``fanout ** depth`` leaves are the unit of all further
    work: one pass reduces each to a node, the small trees above tell each superblock the nodes outside that its proofs
    need, and the leaves meet these in a cogroup that ends reduction, proofs and folding. No group is larger.

    Null columns count as ``-``; null and equal sources are sources like others, null first. Null ids come first in
    their source. Rows of one id are ordered by their digest; wholly equal rows are leaves side by side. A source with
    one row has its leaf as subroot, a single source its subroot as root. An empty table gives no rows. Other columns
    are not read.
    """
    width = fanout**depth
    values = {c: F.col(c) for c in columns}
    leaves = docs.select(
        F.col("source"), F.col("doc_id"),
        leaf_of(values).alias("leaf"), leaf_of({**values, **(received or {})}).alias("received"),
        F.monotonically_increasing_id().alias("uid"),
    )
    ordered = ordered_leaves(stored(leaves, "leaves"))
    spots = places(ordered)
    part = F.shiftright("mono", _ROW_BITS)
    here = (F.col("o.source").eqNullSafe(F.col("p.source"))) & (F.col("o.part") == F.col("p.part"))
    placed = ordered.withColumn("part", part).alias("o").join(spots.alias("p"), here).select(
        "p.tree", (F.col("shift") + F.col("mono").bitwiseAND((1 << _ROW_BITS) - 1)).alias("pos"), "p.n",
        F.col("leaf").alias("digest"), "received", "o.doc_id", "o.source",
    )
    stages = stages_of(placed, fanout, depth)
    subroots = stages[1].where("n = 1")
    for stage in stages[2:]:
        subroots = subroots.unionByName(stage.where("n = 1"))
    subroots = stored(subroots.select("tree", "digest"), "subroots")
    sources = subroots.count()
    forest = subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.lit(sources).cast("bigint").alias("n"), "digest")
    above = stages_of(forest, fanout, depth)
    root = above[-1].where("n = 1").select(F.col("digest").alias("root"))
    nothing = F.expr("cast(array() AS array<struct<before: string, after: string>>)")
    over_root = above[-1].select("tree", nothing.alias("path"))
    tops = paths_of(forest, outer_paths(above, over_root, fanout, depth), fanout, depth)
    tops = stored(tops.select(F.col("pos").alias("tree"), "path"), "tops")
    known = subroots.select("tree", F.col("digest").alias("subroot")).withColumn("root", root.scalar())
    outer = outer_paths(stages, tops, fanout, depth).join(known, "tree")

    def finish(rows: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        leaves, n = rows["digest"].tolist(), int(rows["n"].iloc[0])
        levels = levels_above(leaves, fanout, _local(n, fanout, depth))
        outside = [(p["before"], p["after"]) for p in around["path"].iloc[0]]
        tail = "".join(b + a for b, a in outside)
        subroot, top = around["subroot"].iloc[0], around["root"].iloc[0]
        told, folded, lists = [], [], []
        for k, node in enumerate(rows["received"].tolist()):
            own = list(_siblings(levels, k, fanout))
            joined = "".join(b + a for b, a in own) + tail
            for before, after in own:
                node = digest(before + node + after)
            for before, after in outside:
                node = digest(before + node + after)
            told.append(digest(joined))
            folded.append(node)
            if proofs:
                lists.append([joined[i : i + HEX] for i in range(0, len(joined), HEX)])
        out = {
            "source": rows["source"], "doc_id": rows["doc_id"], "pos": rows["pos"], "n_rows": n, "leaf": leaves, "subroot": subroot, "root": top,
            "proof_sha256": told, "folded_root": folded, "verified": [f == top for f in folded],
        }
        return pd.DataFrame(out | ({"proof": pd.Series(lists, rows.index)} if proofs else {}))

    kinds = dict(docs.select("source", "doc_id").dtypes)
    schema = f"source {kinds['source']}, doc_id {kinds['doc_id']}, pos bigint, n_rows bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _cogrouped(placed, outer, width, finish, schema + ", proof array<string>" * proofs)


def lower_ascii(text: Column) -> Column:
    """Letters A-Z as a-z, all others as they are."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def lowered_fifth(docs: DataFrame) -> dict[str, Column]:
    """A copy of the data in which the texts of every fifth id, by crc32 of its digits, lost their capitals."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return {"text": F.when(tampered, lower_ascii(F.col("text"))).otherwise(F.col("text"))}
