"""Near copies by SimHash fingerprints, linked through BK-trees, and the exact Jaccard similarity of word shingles.

Texts a fifth of whose shingles differ have fingerprints too far apart to share a stretch of bits, so MinHash bands, not bits, deal
them to the trees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import stored, text_of
from codeloom.llm.components import components
from codeloom.llm.simhash import BkTree, Union, least_of_each, majority
from codeloom.operators.skew import hot_split_join

SHINGLE = 5

#: Texts are near copies from this share of common shingles on: NEAR[0] / NEAR[1].
NEAR = (4, 5)

#: Texts with a similarity of 0.8 share no band with a chance of (1 - 0.8 ** 6) ** 32, one in 16,000.
BANDS = 32
ROWS = 6

#: Fingerprints of candidates differ in so many bits at most. At a similarity of 0.8 some 10 bits differ, of the shortest texts 12,
#: with a deviation of 3.
RADIUS = 24

#: Sketches of candidates agree in this share of their bytes. At a similarity of 0.8 that is over three deviations below.
LIKELY = 0.7

#: Sketches that a piece of a group holds at most; larger groups are cut up further.
PIECE = 4096

#: Links that a task holds before it passes them on.
LINKS = 100_000

#: Candidates up to this number are broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000

FACTORS = np.random.default_rng(42).integers(0, 2**64, BANDS * ROWS, "u8") | np.uint64(1)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text of fewer words is one shingle, one without words has none. Words
    are those of ``simhash.fingerprints``."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "u8")
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    digest = xxhash.xxh64_intdigest
    k = min(shingle, len(words))
    return np.unique(np.array([digest(joined[a : b - 1]) for a, b in zip([0, *ends], ends[k - 1 :], strict=False)], "u8"))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least product with each factor."""
    least = np.full(len(FACTORS), 2**64 - 1, "u8")
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[at : at + 512, None] * FACTORS).min(0), out=least)
    return least


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp, keys, simhash, sketch) per row: ``fp`` names the set of shingles, ``keys`` are the bands of its
    signature, ``simhash`` is its fingerprint, ``sketch`` has a byte of each least product. Texts without words have no keys."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys, prints, sketches = [], [], [], []
            for text in batch.column(2):
                hashes = shingles(text.as_py())
                least = signature(hashes)
                fps.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                rows = least.reshape(BANDS, ROWS)
                keys.append([xxhash.xxh64_intdigest(rows[k].tobytes(), k) >> 1 for k in range(BANDS)] if len(hashes) else [])
                prints.append(majority(hashes))
                sketches.append((least >> np.uint64(24)).astype("u1").tobytes())
            fps, prints = (pa.array(np.array(x, "u8").view("i8")) for x in (fps, prints))
            columns = [batch.column(0), batch.column(1), fps, pa.array(keys, pa.list_(pa.int64())), prints, pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "fp", "keys", "simhash", "sketch"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text_of()).alias("text_key"), text_of().cast("binary").alias("text"))
    return rows.mapInArrow(mark, "doc_id bigint, text_key bigint, fp bigint, keys array<bigint>, simhash bigint, sketch binary")


def candidates(classes: DataFrame, piece: int = PIECE, roots: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between classes (fp, keys, simhash, sketch) that share a band, whose fingerprints lie within ``RADIUS``
    and whose sketches agree in ``LIKELY`` of their bytes: of the classes that links have joined within a group, the most alike one only.
    With ``roots`` (node, root), components that confirmed links have made, all such links between different components.

    A group's fingerprints are put into a BK-tree one by one, which is asked for those within the radius. Groups of more than ``piece``
    classes are cut in pieces, a tree each, that the whole group is streamed through, so memory stays bounded and no pair is left out. Bands are counted without the sketches, which only those that share one get.
    """
    whole = roots is not None
    own = F.col("fp").alias("component")
    if whole:
        classes = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        own = F.coalesce("root", "fp").alias("component")
    keyed = classes.select("fp", own, F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min("component") < F.max("component")).alias("differ"))
    sizes = sizes.where("n > 1 AND differ").drop("differ")
    shared = keyed.join(sizes, "key").join(classes.select("fp", "simhash", "sketch"), "fp")
    sized = shared.withColumn("pieces", F.ceil(F.col("n") / piece))
    rows = sized.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("pieces"))).select(
        "fp", "component", "simhash", "sketch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece"), "key", "own"
    )
    rows = rows.select(F.xxhash64("key", "piece").alias("tree"), "fp", (F.col("piece") != F.col("own")).alias("asks"), "component", "simhash", "sketch")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree_key, tree, union = None, BkTree(), Union()
        held, known = np.zeros((16, len(FACTORS)), "u1"), np.zeros((16, 2), "i8")
        for batch in batches:
            out, n_out = [], 0
            for key, fp, asks, component, simhash, sketch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != tree_key:
                    tree_key, tree, union = key, BkTree(), Union()
                own, n, bits = np.frombuffer(sketch, "u1"), len(tree.nodes), simhash & 0xFFFFFFFFFFFFFFFF
                within = np.array(sorted(tree.within(bits, RADIUS)), "i8")
                if whole:
                    within = within[known[within, 1] != component]
                agree = np.count_nonzero(held[within] == own, axis=1)
                near = np.flatnonzero(agree >= LIKELY * len(FACTORS))
                if whole:
                    linked = within[near]
                else:
                    best: dict[int, int] = {}
                    for i in within[near[np.argsort(-agree[near], kind="stable")]].tolist():
                        best.setdefault(union.root(i), i)
                    linked = np.array(list(best.values()), "i8")
                if len(linked):
                    out.append(np.stack([np.full(len(linked), fp, "i8"), known[linked, 0]]))
                    n_out += len(linked)
                    if n_out > LINKS:
                        yield _links(out)
                        out, n_out = [], 0
                if not asks:
                    if n == len(held):
                        held, known = (np.concatenate([x, np.zeros_like(x)]) for x in (held, known))
                    held[n], known[n] = own, (fp, component)
                    tree.add(bits)
                    new = union.add()
                    if not whole:
                        for i in linked.tolist():
                            union.join(i, new)
            if out:
                yield _links(out)

    found = rows.repartition("tree").sortWithinPartitions("tree", "asks", "fp").mapInArrow(link, "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _links(out: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in np.concatenate(out, axis=1)], names=["a", "b"])


def confirmed(docs: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """The links (a, b) whose texts have an exact similarity of at least ``NEAR``."""
    wanted = links.select(F.col("a").alias("fp")).union(links.select("b")).distinct().join(classes.select("fp", "text_key"), "fp")
    wanted = stored(wanted, "wanted")
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.xxhash64(text_of()).alias("text_key"), text_of().alias("text")).join(wanted, "text_key")
    texts = texts.groupBy("fp").agg(F.min("text").cast("binary").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["fp", "set"])

    sets = stored(texts.mapInArrow(cut, "fp bigint, set binary"), "sets")
    pairs = links.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b").select("a", "b", "left", "right")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(left.as_buffer(), "u8"), np.frombuffer(right.as_buffer(), "u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * NEAR[1] >= NEAR[0] * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(verify, "a bigint, b bigint")


def near_copies(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """(doc_id, component_id) per row of ``docs`` (doc_id, text): documents whose five-word shingles have a Jaccard
    similarity of 0.8 or more are linked, and ``component_id`` is the smallest doc_id that links reach.

    Texts of equal shingles are one class from the start, and those without words are another. The candidates first taken join
    most texts; where one fails the exact check, others of its set may still pass, so all candidates between the components that are left
    are checked then. Nulls and repeated rows
    are treated as in ``simhash.near_duplicates``.
    """
    marked = stored(marks(docs), "marks")
    first = F.min(F.struct("text_key", "keys", "simhash", "sketch")).alias("c")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), first).select("fp", "least", "c.*"), "classes")
    links = stored(candidates(classes, piece), "candidates")
    sure = stored(confirmed(docs, classes, links), "confirmed")
    roots = components(sure)
    rest = stored(candidates(classes, piece, roots).join(links, ["a", "b"], "left_anti"), "rest")
    if rest.limit(1).count():
        roots = components(sure.union(confirmed(docs, classes, rest)))
    linked = classes.select("fp", "least").join(roots.select(F.col("node").alias("fp"), "root"), "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = linked.join(least, "root").select("fp", "component_id")
    of_class = classes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return hot_split_join(marked.select("doc_id", "fp"), of_class, ["fp"], ["doc_id"]).select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies, as ``simhash.least_of_each`` takes it."""
    return least_of_each(docs, near_copies)
