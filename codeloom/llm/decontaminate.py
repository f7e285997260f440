"""Benchmark decontamination by spaced-seed hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import stored, text_of
from codeloom.llm.toxicity import Memo

WORD = re.compile(r"\w+")

#: Positions that a seed compares; the others may differ. The three find passages in which every third, fourth or fifth
#: word has been replaced.
MASKS = ("11011011", "1110111", "110101101")

#: An overlap counts if it has so many equal words, or four fifths of a shorter item, and not under ``FEWEST``. Items of fewer
#: words are found as a whole, word for word; those of fewer than ``ALONE`` words only where they are the whole text.
ENOUGH = 13
FEWEST = 8
ALONE = 4

#: A replaced word costs an overlap one and a half equal ones, so an overlap goes on where every third word has been replaced.
COST = 1.5

#: Words kept on either side of a hit, so that overlaps can be told whole or long enough.
CONTEXT = 64

#: Bits of the filter of benchmark hashes: 2 MB in every executor, however large the benchmark.
FILTER_BITS = 24

STEPS = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 | 1 for k in range(16)], "u8")


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1


def word_hashes(texts: list[str], memo: Memo) -> list[np.ndarray]:
    get = memo.__getitem__
    return [np.array(list(map(get, WORD.findall(t.lower()))), "i8") for t in texts]


def seeds(words: np.ndarray, whole: tuple[int, ...] = ()) -> Iterator[tuple[int, np.ndarray]]:
    """(span, hash at every position) of each mask, and of runs of ``whole`` words without a gap; of fewer than ``ALONE`` only
    the run that is all there is."""
    wide = words.view("u8")
    for mask in (*MASKS, *("1" * n for n in whole if n >= ALONE or n == len(words))):
        n = len(words) - len(mask) + 1
        if n > 0:
            total = np.full(n, MASKS.index(mask) + 1 if mask in MASKS else len(MASKS) + len(mask), "u8")
            for p, used in enumerate(mask):
                if used == "1":
                    total += (wide[p : p + n] ^ (wide[p : p + n] >> np.uint64(29))) * STEPS[p]
            total ^= total >> np.uint64(31)
            total *= np.uint64(0xD6E8FEB86659FD93)
            yield len(mask), (total ^ (total >> np.uint64(32))).view("i8")


def least_equal(words: int) -> int:
    """Equal words that an overlap with an item of so many words has at least."""
    return words if words < FEWEST else max(FEWEST, min(ENOUGH, -(-4 * words // 5)))


def slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that a hash sets."""
    wide = hashes.view("u8")
    return (wide >> np.uint64(64 - FILTER_BITS)).astype("i8"), (wide & np.uint64((1 << FILTER_BITS) - 1)).astype("i8")


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """(item_id, words, seeds): items of fewer than ``FEWEST`` words have one seed, of all their words. Items without words have no row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(word_hash)
        for batch in batches:
            rows = []
            for item, words in zip(batch.column(0).to_pylist(), word_hashes(batch.column(1).to_pylist(), memo), strict=True):
                if len(words):
                    kinds = seeds(words) if len(words) >= FEWEST else (s for s in seeds(words, (len(words),)) if s[0] == len(words))
                    found = [{"hash": int(h), "at": at} for _, hs in kinds for at, h in enumerate(hs)]
                    rows.append({"item_id": item, "words": words.tolist(), "seeds": found})
            kind = pa.struct([("hash", pa.int64()), ("at", pa.int32())])
            schema = pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.int64())), ("seeds", pa.list_(kind))])
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = "item_id bigint, words array<bigint>, seeds array<struct<hash: bigint, at: int>>"
    return items.select(F.col("item_id").cast("bigint"), text_of().alias("text")).mapInArrow(hashed, schema)


def seed_filter(seed_rows: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size: at most 2^18 words of 64 bits come to the driver."""
    high = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    low = F.col("hash").bitwiseAND((1 << FILTER_BITS) - 1)
    bits = seed_rows.select(F.explode(F.array(high, low)).alias("slot"))
    words = bits.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits"))
    filled = np.zeros(1 << (FILTER_BITS - 6), "i8")
    for word, value in words.collect():
        filled[word] = value
    return np.unpackbits(filled.view("u1"), bitorder="little").astype(bool)


def candidate_segments(docs: DataFrame, bits: np.ndarray, whole: tuple[int, ...] = ()) -> DataFrame:
    """(segment, doc_id, first, words, seeds): stretches of a text around seeds that pass the filter, stored.

    Every position of every text is hashed, by the masks and by the lengths ``whole`` of short items; only stretches with a
    possible hit leave the task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo, number = Memo(word_hash), TaskContext.get().partitionId() << 33
        passes = np.unpackbits(shared.value, bitorder="little").astype(bool)
        kind = pa.struct([("hash", pa.int64()), ("at", pa.int32())])
        schema = pa.schema([("segment", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int32()), ("words", pa.list_(pa.int64())), ("seeds", pa.list_(kind))])
        for batch in batches:
            rows = []
            ids = batch.column(0)
            for k, words in enumerate(word_hashes(batch.column(1).to_pylist(), memo)):
                hits: list[tuple[int, int, int]] = []
                for span, hashes in seeds(words, whole):
                    one, two = slots(hashes)
                    at = np.flatnonzero(passes[one])
                    at = at[passes[two[at]]]
                    hits += zip(at.tolist(), hashes[at].tolist(), [span] * len(at), strict=True)
                hits.sort()
                lo = hi = None
                held: list[dict] = []
                for at, h, span in [*hits, (None, 0, 0)]:
                    if held and (at is None or at - CONTEXT > hi):
                        rows.append({"segment": number, "doc_id": ids[k].as_py(), "first": lo, "words": words[lo:hi].tolist(), "seeds": held})
                        number, held = number + 1, []
                    if at is not None:
                        if not held:
                            lo = max(0, at - CONTEXT)
                        hi = min(len(words), at + span + CONTEXT)
                        held.append({"hash": h, "at": at})
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = "segment bigint, doc_id bigint, first int, words array<bigint>, seeds array<struct<hash: bigint, at: int>>"
    return stored(docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(scan, schema), "segments")


def best_overlap(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """(start, words, equal words) of the best stretch of two aligned arrays of one length."""
    if not len(text):
        return 0, 0, 0
    same = text == item
    run = np.concatenate([[0], np.cumsum(np.where(same, 1, -COST))])
    low = np.minimum.accumulate(run)
    end = int(np.argmax(run - low))
    start = int(np.flatnonzero(run[: end + 1] == low[end])[-1])
    return start, end - start, int(same[start:end].sum())


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, first, n_words, n_equal): the best overlap of each document with each benchmark item it holds.

    Texts are lower-cased words of letters, digits and underscores. Seeds of the texts and the items are joined by hash
    (texts first pass a filter of fixed size); each alignment that a hit proposes is compared word by word around it,
    and stands if its best stretch, in which at most two words in five differ, has ``ENOUGH`` equal words, or four
    fifths of an item that is shorter. Items of fewer than ``FEWEST`` words are found where all their words stand in turn, those
    of fewer than ``ALONE`` where the text has no other words. First word and length are in words of the text.

    Null texts are empty and hold nothing. Repeated rows, and rows of one doc_id, are one document; null ids are one
    document too. Equal items are each reported; null item ids are one item. Long texts are scanned whole. Empty tables
    give no rows. Other columns are not read.
    """
    bench = stored(benchmark_seeds(items), "benchmark")
    targets = bench.select("item_id", "words", F.xxhash64("item_id", "words").alias("item"), "seeds").dropDuplicates(["item"])
    seed_rows = targets.select("item", F.explode("seeds").alias("s")).select("item", "s.hash", F.col("s.at").alias("item_at"))
    n = F.size("words")
    whole = tuple(sorted(r["n"] for r in targets.where(n < FEWEST).select(n.alias("n")).distinct().collect()))  # FEWEST - 1 at most
    segments = candidate_segments(docs, seed_filter(seed_rows), whole)
    hits = segments.select("segment", F.explode("seeds").alias("s")).select("segment", "s.hash", "s.at").join(seed_rows, "hash")
    lines = hits.select("segment", "item", (F.col("at") - F.col("item_at")).alias("line")).distinct()
    aligned = lines.join(segments.select("segment", "doc_id", "first", F.col("words").alias("text")), "segment").join(
        targets.select("item", "item_id", F.col("words").alias("target")), "item"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, item_id, first, line, text, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, target = np.array(text, "i8"), np.array(target, "i8")
                a, b = max(0, first - line), min(len(target), first + len(text) - line)
                start, n, equal = best_overlap(text[a + line - first : b + line - first], target[a:b])
                if equal >= least_equal(len(target)):
                    rows.append((doc_id, item_id, a + line + start, n, equal))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            names = ["doc_id", "item_id", "first", "n_words", "n_equal"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    found = aligned.select("doc_id", "item_id", "first", "line", "text", "target").mapInArrow(
        verify, "doc_id bigint, item_id bigint, first int, n_words int, n_equal int"
    )
    best = F.max(F.struct("n_equal", -F.col("first"), "n_words")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.col2")).alias("first"), "b.n_words", "b.n_equal"
    )


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item. Rows are told by a hash of their text, so ids may be null or
    shared by different texts; repeated rows go or stay together. Null texts stay. Without items all rows stay; an
    empty table gives no rows. Other columns are kept."""
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(text_of()).alias("_key"))
    leaks = overlaps(rows.select(F.col("_key").alias("doc_id"), F.col("row.text").alias("text")), items)
    return rows.join(leaks.select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_anti").select("row.*")
