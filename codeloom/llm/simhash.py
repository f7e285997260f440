"""Near duplicates by SimHash fingerprints, linked through BK-trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import stored, text_of
from codeloom.llm.components import components
from codeloom.operators.skew import hot_split_join

SHINGLE = 4
RADIUS = 4
SEED = 42

#: Fingerprints that one tree holds at most; larger shards are cut up further.
SHARD = 4096


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes."""
    counts = np.zeros(64, "i8")
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Bits that are set in over half the hashes of the shingles; zero without words."""
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    k = min(shingle, len(words))
    return majority(np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :], strict=False)], "<u8"))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's text, as a signed number with the same bits. Letters A-Z count as a-z,
    words are what bytes other than space and tab to carriage return make up."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py().lower().split(), shingle) for t in batch.column(1)], "u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view("i8"))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), text_of().cast("binary").alias("text")).mapInArrow(mark, "doc_id bigint, fp bigint")


class BkTree:
    """Fingerprints in a tree whose children hang on their distance to the parent; no two children of one share it."""

    def __init__(self):
        self.nodes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, fp: int) -> int:
        self.nodes.append(fp)
        self.children.append({})
        new = len(self.nodes) - 1
        at = 0
        while at != new:
            at = self.children[at].setdefault((self.nodes[at] ^ fp).bit_count(), new)
        return new

    def within(self, fp: int, radius: int) -> Iterator[int]:
        """Nodes at most ``radius`` away. A subtree below distance e holds only what lies e from its parent, so edges that
        differ by more than the radius from the parent's own distance lead nowhere."""
        nodes, children = self.nodes, self.children
        stack = [0] if nodes else []
        while stack:
            at = stack.pop()
            d = (nodes[at] ^ fp).bit_count()
            if d <= radius:
                yield at
            below = children[at]
            if len(below) <= 2 * radius + 1:
                stack.extend([n for e, n in below.items() if -radius <= e - d <= radius])
            else:
                stack.extend([below[e] for e in range(d - radius, d + radius + 1) if e in below])


class Union:
    def __init__(self):
        self.up: list[int] = []

    def add(self) -> int:
        self.up.append(len(self.up))
        return len(self.up) - 1

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def bands(radius: int, low: int = 0, high: int = 64) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 stretches of the bits: fingerprints within the radius agree on one of them."""
    edges = [low + (high - low) * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _band(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND((1 << width) - 1)


def _keys(fp: Column, radius: int) -> Column:
    return F.array(*(F.xxhash64(F.lit(k), _band(fp, *b)) for k, b in enumerate(bands(radius))))


def shard_links(fps: DataFrame, radius: int, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that connect whatever fingerprints of the rows (fp) lie within the radius of each other.

    Fingerprints within the radius agree on one of radius + 1 bands of bits, so each shard holds those that share a
    band's value. A shard's task puts its fingerprints into a BK-tree one by one, asks the tree for those within the
    radius, and returns one link for each set that they join: as many links as there are fingerprints at most, however
    dense a group is. Shards of more than ``shard`` fingerprints are cut in pieces: each piece is a tree that the whole
    shard is streamed through, so memory stays bounded and no pair is left out.
    """
    keyed = fps.select("fp", F.explode(_keys(F.col("fp"), radius)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = keyed.join(sizes, "key").withColumn("pieces", F.ceil(F.col("n") / shard))
    own = F.pmod(F.xxhash64("fp"), F.col("pieces"))
    rows = sized.withColumn("own", own).select(
        "fp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece"), "key", "own"
    )
    rows = rows.select(F.xxhash64("key", "piece").alias("tree"), "fp", (F.col("piece") != F.col("own")).alias("asks"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree_key, tree, union, out = None, BkTree(), Union(), []

        def sets() -> None:
            out.extend((tree.nodes[i], tree.nodes[union.root(i)]) for i in range(len(tree.nodes)) if union.root(i) != i)

        for batch in batches:
            for key, fp, asks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != tree_key:
                    sets()
                    tree_key, tree, union = key, BkTree(), Union()
                bits = fp & 0xFFFFFFFFFFFFFFFF
                near = list(tree.within(bits, radius))
                if asks:
                    out.extend((bits, tree.nodes[r]) for r in {union.root(i) for i in near})
                else:
                    tree.add(bits)
                    new = union.add()
                    for i in near:
                        union.join(i, new)
            if out:
                yield _links(out)
                out = []
        sets()
        if out:
            yield _links(out)

    return rows.repartition("tree").sortWithinPartitions("tree", "asks", "fp").mapInArrow(link, "a bigint, b bigint")


def _links(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(c, "u8").view("i8")) for c in zip(*out, strict=True)], names=["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs`` (doc_id, text): documents whose fingerprints differ in at most
    ``radius`` bits are linked, and ``component_id`` is the smallest doc_id that links reach, the own one included.

    Copies share a fingerprint and are one class from the start; only classes are linked. Null, empty and blank texts
    have the fingerprint zero and are linked like others. Repeated rows are in one class. Null ids are never the
    smallest unless nothing else is there, where the component is null. Columns but these two are not read. An empty
    table gives no rows.
    """
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(shard_links(classes.select("fp"), radius, shard))
    linked = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = linked.join(least, "root").select("fp", "component_id")
    of_class = classes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # One print may hold a third of all rows: such rows are spread over many tasks.
    return hot_split_join(marked, of_class, ["fp"], ["doc_id"]).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one document of each group, as ``least_of_each`` takes it."""
    return least_of_each(docs, lambda rows: near_duplicates(rows, **settings))


def least_of_each(docs: DataFrame, group) -> DataFrame:
    """``docs`` with one row of each component that ``group`` finds, (doc_id, component_id) from rows (doc_id, text).

    Rows are known by a hash of id and text, so different texts under one doc_id, and rows without one, are documents of
    their own, and copies are found among them as among others. Of a component the smallest doc_id stays, those without an id last,
    then the smallest hash; of rows equal in id and text, one. An empty table gives no rows; other columns are kept.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("doc_id", text_of()).alias("_key"))
    marked = group(rows.select(F.col("_key").alias("doc_id"), F.col("row.text").alias("text")))
    marked = marked.select(F.col("doc_id").alias("_key"), "component_id").distinct()
    known = rows.groupBy("_key").agg(F.first("_id").alias("_id"), F.count(F.lit(1)).alias("_rows")).join(marked, "_key")
    least = F.min(F.struct(F.col("_id").isNull(), "_id", "_key", "_rows")).alias("least")
    kept = stored(known.groupBy("component_id").agg(least).select("least._key", "least._rows"), "kept")
    rows = rows.join(kept, "_key")
    several = rows.where("_rows > 1").groupBy("_key").agg(F.first("row").alias("row"))
    return rows.where("_rows = 1").select("row.*").unionByName(several.select("row.*"))
