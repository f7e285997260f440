"""Ranked lexical search: many queries at once, along a DAG of the term sets that they share."""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import stored, text_of

#: Hits per item, and the share of a document's length in its score, in hundredths.
TOP = 10
LENGTH_SHARE = 90

#: Terms of all items of a block, repeats between items counted; a block is one pass over the documents.
BLOCK_TERMS = 65_536

#: Shared terms of an item that pairs are mined from, the most shared first; the others still share as whole sets.
MINED = 64

#: Numbers that a block of documents' accumulators hold, 8 bytes each.
CELLS = 1 << 21

#: Parts in which an item's candidates are cut down before they meet.
SALTS = 64

#: Bytes that separate terms become spaces, A-Z become a-z; digits, a-z and bytes of other characters stay.
_FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of UTF-8 text: runs of digits, letters A-Z in lower case, and characters beyond ASCII."""
    return text.translate(_FOLDED).split()


def mine(items: list[set[int]], mined: int = MINED) -> tuple[list[tuple[int, ...]], list[list[int]]]:
    """(sets, rest): shared sets, each a tuple of terms and earlier sets, and per item the terms and sets it consists of.

    Set k is known as -1 - k. Terms that occur in the same items, two at least, are a set from the start. Then the pair of
    parts that most items hold becomes a set, in all of them, until no pair is left in two. Whatever is mined, an item's
    parts are disjoint and add up to its terms; mining decides the work, not the result.
    """
    of_term: dict[int, list[int]] = defaultdict(list)
    for k, held in enumerate(items):
        for t in held:
            of_term[t].append(k)
    sets: list[tuple[int, ...]] = []
    holders: dict[int, set[int]] = {}
    alike: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for t, held in sorted(of_term.items()):
        if len(held) > 1:
            alike[tuple(held)].append(t)
    rest: list[list[int]] = [[t for t in sorted(held) if len(of_term[t]) == 1] for held in items]
    for held, together in alike.items():
        part = together[0]
        if len(together) > 1:
            sets.append(tuple(together))
            part = -len(sets)
        holders[part] = set(held)
    parts: list[set[int]] = [set() for _ in items]
    for part, held in sorted(holders.items(), key=lambda x: (-len(x[1]), x[0])):
        for k in held:
            (parts[k].add if len(parts[k]) < mined else rest[k].append)(part)
    counts: Counter = Counter()
    for held in parts:
        counts.update(combinations(sorted(held), 2))
    holders = {p: {k for k in held if p in parts[k]} for p, held in holders.items()}
    heap = [(-n, pair) for pair, n in counts.items() if n > 1]
    heapq.heapify(heap)
    while heap:
        n, (a, b) = heapq.heappop(heap)
        now = counts.get((a, b), 0)
        if now != -n:
            if now > 1:
                heapq.heappush(heap, (-now, (a, b)))
            continue
        both = holders[a] & holders[b]
        sets.append((a, b))
        new = -len(sets)
        grown: Counter = Counter()
        for k in sorted(both):
            held = parts[k]
            held -= {a, b}
            for x in held:
                for y in (a, b):
                    counts[min(x, y), max(x, y)] -= 1
                grown[x] += 1
            held.add(new)
        counts.pop((a, b))
        holders[a] -= both
        holders[b] -= both
        holders[new] = both
        for x, times in grown.items():
            pair = (min(x, new), max(x, new))
            counts[pair] = times
            if times > 1:
                heapq.heappush(heap, (-times, pair))
    return _flat(sets, [[*r, *sorted(p)] for r, p in zip(rest, parts, strict=True)])


def _flat(sets: list[tuple[int, ...]], items: list[list[int]]) -> tuple[list[tuple[int, ...]], list[list[int]]]:
    """Sets that only one other set uses become part of that one."""
    uses = Counter(p for held in [*sets, *items] for p in held if p < 0)
    by_item = {p for held in items for p in held if p < 0}
    body: list[tuple[int, ...]] = []
    for held in sets:
        once = lambda p: p < 0 and uses[p] == 1 and p not in by_item
        body.append(tuple(q for p in held for q in (body[-1 - p] if once(p) else (p,))))
    kept = [k for k in range(len(sets)) if uses[-1 - k] > 1 or -1 - k in by_item]
    new = {-1 - k: -1 - i for i, k in enumerate(kept)}
    return [tuple(new.get(p, p) for p in body[k]) for k in kept], [[new.get(p, p) for p in held] for held in items]


def item_terms(items: DataFrame, key: str, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, terms, block): the distinct terms of each item, rows of one id taken together, dealt to blocks by a hash."""
    upper = "".join(map(chr, range(65, 91)))
    found = F.regexp_extract_all(F.translate(text_of(), upper, upper.lower()), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    rows = items.select(F.col(key).alias("item_id"), F.explode(found).alias("term")).distinct()
    rows = rows.groupBy("item_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    rows = stored(rows, "items")
    total = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    return rows.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-total // block_terms)))))


def mined_blocks(items: DataFrame) -> DataFrame:
    """(block, kind, number, item, parts, term): the DAG of each block, mined in the task that holds its items. Kinds are
    ``term`` with its text, ``set`` and ``item`` with their parts; a part from 0 on is a term, -1 - k is set k."""
    kind = dict(items.dtypes)["item_id"]
    schema = f"block bigint, kind string, number int, item {kind}, parts array<int>, term string"

    def plan(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item_id", na_position="last")
        shares = Counter(t for held in rows["terms"] for t in held)
        words = sorted(shares, key=lambda t: (-shares[t], t))
        number = {t: k for k, t in enumerate(words)}
        sets, parts = mine([{number[t] for t in held} for held in rows["terms"]])
        out = [("term", k, None, None, t) for k, t in enumerate(words)]
        out += [("set", k, None, list(p), None) for k, p in enumerate(sets)]
        out += [("item", k, i, p, None) for k, (i, p) in enumerate(zip(rows["item_id"].tolist(), parts, strict=True))]
        frame = pd.DataFrame(out, columns=["kind", "number", "item", "parts", "term"], dtype=object)
        frame.insert(0, "block", int(key[0]))
        return frame

    return items.groupBy("block").applyInPandas(plan, schema)


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, ids, tfs) per row of ``docs`` (doc_id, text): its number of terms, and which of the vocabulary's terms
    it holds how often."""
    known = docs.sparkSession.sparkContext.broadcast({t.encode(): k for k, t in enumerate(vocabulary)})
    width = max(1, len(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                cut = batch.slice(lo, 200)
                sizes, found, owners = [], [], []
                for k, text in enumerate(cut.column(1)):
                    words = terms(text.as_py())
                    sizes.append(len(words))
                    own = np.fromiter(map(get, words, repeat(-1)), "i8", len(words))
                    own = own[own >= 0]
                    found.append(own + k * width)
                keys, tfs = np.unique(np.concatenate(found), return_counts=True)
                owners, ids = np.divmod(keys, width)
                ends = np.searchsorted(owners, np.arange(cut.num_rows + 1)).astype("i4")
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(c.astype("i4"))) for c in (ids, tfs)]
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "ids", "tfs"])

    rows = docs.select("doc_id", text_of().cast("binary").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(count, f"doc_id {kind}, n bigint, ids array<int>, tfs array<int>")


class Accumulators:
    """Scores of a block of documents: term contributions, then each shared set once, then the items."""

    def __init__(self, weights: np.ndarray, sets: list[list[int]], items: list[list[int]], n_docs: int, n_terms: int):
        self.weights, self.n_docs, self.n_terms = weights, n_docs, n_terms
        row = lambda p: p if p >= 0 else len(weights) - 1 - p
        self.sets = [np.array([row(p) for p in held], "i8") for held in sets]
        self.items = [np.array([row(p) for p in held], "i8") for held in items]
        self.rows = len(weights) + len(sets)

    def scores(self, n: np.ndarray, owners: np.ndarray, ids: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """A row per item and a column per document of lengths ``n``; document ``owners[j]`` holds term ``ids[j]`` ``tfs[j]`` times."""
        m = 100 - LENGTH_SHARE + LENGTH_SHARE * n * self.n_docs // max(self.n_terms, 1)
        parts = np.zeros((self.rows, len(n)), "i8")
        parts[ids, owners] = self.weights[ids] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[owners]))
        for k, held in enumerate(self.sets, len(self.weights)):
            np.add.reduce(parts[held], 0, out=parts[k])
        return np.stack([np.add.reduce(parts[held], 0) for held in self.items])


def _best(scores: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:top]
    return scores[order], ids[order]


def candidates(held: DataFrame, plan: Accumulators, top: int) -> DataFrame:
    """(item, doc_id, score): of the documents that a task reads, the ``top`` best of each item."""
    shared = held.sparkSession.sparkContext.broadcast(plan)
    last = np.iinfo("i8").max

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        size = max(8, CELLS // max(1, plan.rows))
        best = [(np.zeros(0, "i8"), np.zeros(0, "i8"))] * len(plan.items)
        least = np.ones(len(plan.items), "i8")  # a score counts from here on
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                cut = batch.slice(lo, size)
                # A null id ranks behind all others; it is told apart again by its place, the largest number.
                doc = np.array([last if d is None else d for d in cut.column(0).to_pylist()], "i8")
                lists = cut.column(2)
                owners = np.repeat(np.arange(cut.num_rows), np.diff(np.asarray(lists.offsets)))
                ids, tfs = np.asarray(lists.flatten()), np.asarray(cut.column(3).flatten()).astype("i8")
                scores = plan.scores(np.asarray(cut.column(1)), owners, ids, tfs)
                for k in np.flatnonzero(scores.max(1) >= least).tolist():
                    hit = np.flatnonzero(scores[k] >= least[k])
                    best[k] = _best(np.concatenate([best[k][0], scores[k][hit]]), np.concatenate([best[k][1], doc[hit]]), top)
                    if len(best[k][0]) == top:
                        least[k] = best[k][0][-1]
        items = np.repeat(np.arange(len(best), dtype="i4"), [len(s) for s, _ in best])
        if len(items):
            doc = np.concatenate([d for _, d in best])
            doc = pa.array(doc, pa.int64(), mask=doc == last)
            yield pa.RecordBatch.from_arrays([pa.array(items), doc, pa.array(np.concatenate([s for s, _ in best]))], names=["item", "doc_id", "score"])

    return held.select(F.col("doc_id").cast("bigint"), "n", "ids", "tfs").mapInArrow(rank, "item int, doc_id bigint, score bigint")


def _ranked(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    over = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "item_id", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``top`` documents of highest score above 0, ties by doc_id.

    Documents are tokenised once per block of items into postings of the block's vocabulary, which are written; their
    counts give the weights. Then each task adds up, for a few documents at a time, every term set that items share, once,
    and the items from these along the DAG. It keeps the best of each item, whatever number of documents it reads, and
    the tasks' bests are cut down in two steps.

    A block holds about ``block_terms`` terms (one item at least): that bounds what a task mines, what is broadcast and
    what the driver sees. More items take more blocks. All documents are scored against all items, none is skipped.

    Null and empty texts have no terms and match nothing. Texts of any length are counted whole. Rows of one doc_id are
    documents of their own; a null id ranks last. Rows of one item id, null included, are one item with the terms of
    all; an item without terms has no rows. Repeated terms of an item count once. Without documents or items there are no
    rows. Other columns are not read. Ids of documents are integers below the largest 64-bit one.
    """
    spark = docs.sparkSession
    listed = item_terms(items, key, block_terms)
    plans = stored(mined_blocks(listed), "plans")
    out, totals = None, None
    for block in sorted(r["block"] for r in plans.select("block").distinct().collect()):
        rows = sorted(plans.where(F.col("block") == block).collect(), key=lambda r: r["number"])
        words, sets, parts = ([r for r in rows if r["kind"] == k] for k in ("term", "set", "item"))
        held = stored(postings(docs, [r["term"] for r in words]), "postings")
        if totals is None:
            totals = held.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        n_docs, n_terms = totals
        df = {r["id"]: r["df"] for r in held.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df")).collect()}
        weight = lambda k: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(k, 0) + 1)))
        weights = np.array([weight(k) for k in range(len(words))], "i8")
        plan = Accumulators(weights, [r["parts"] for r in sets], [r["parts"] for r in parts], n_docs, n_terms)
        found = candidates(held.where("size(ids) > 0"), plan, top)
        found = _ranked(found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), ["item", "salt"], top).drop("salt", "rank")
        kind = next(f for f in plans.schema.fields if f.name == "item").dataType.simpleString()
        names = spark.createDataFrame([(r["number"], r["item"]) for r in parts], f"item int, item_id {kind}")
        found = _ranked(found, ["item"], top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = stored(found, "ranked")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return listed.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score")).limit(0)
    return out
