"""Quality scores by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import BLANKS, fold, let, one_label, stored, text_of, with_label, words_of

FOLDS = 4

#: How often each labelled document is paired with another of the other label.
ROUNDS = 8

#: Labelled documents that meet in a block, and how many of them at least have the rarer label, if there are so many.
BLOCK = 2_000
RARER = 200

#: Equal rows that go to a block together at most.
TOGETHER = 50

#: Ranges that merits are counted in to find a quantile.
BINS = 2_000

#: Score that separates the two labels, at the quantile of the labelled documents that the share of label 0 names.
LEAST = 0.7

SYMBOLS = "#*$%&<>{}[]\\^~=+_@|"


def features(text: Column) -> Column:
    """Struct of numbers about a text that is not null; shares are of its characters, words or lines, and lie from 0 to 1."""
    words = words_of(text)
    chars = F.greatest(F.length(F.translate(text, BLANKS, "")), F.lit(1))

    def without(marks: str) -> Column:
        return F.length(text) - F.length(F.translate(text, marks, ""))

    def shares(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
        return F.struct(
            F.log1p(F.size(w)).alias("log_words"),
            (F.size(F.array_distinct(w)) / n).alias("different_words"),
            F.least(chars / n / 10, F.lit(3.0)).alias("word_length"),
            (F.size(F.filter(w, lambda x: x.rlike(r"^[^\p{L}\p{N}]+$"))) / n).alias("bare_marks"),
            (F.size(F.filter(w, lambda x: x.rlike(r"[#*$%&<>|]$"))) / n).alias("marked_words"),
            (F.size(F.filter(w, lambda x: x.rlike(r"[.!?]$"))) / n).alias("sentence_ends"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))) / F.greatest(F.size(x), F.lit(1))).alias("repeated_lines"),
        )

    found = let(words, shares)
    names = ["log_words", "different_words", "word_length", "bare_marks", "marked_words", "sentence_ends", "repeated_lines"]
    marks = {"symbols": SYMBOLS, "digits": "0123456789", "commas": ",;:"}
    return F.struct(
        *(found[n].cast("double").alias(n) for n in names), *((without(m) / chars).cast("double").alias(n) for n, m in marks.items())
    )


def preference_pairs(better: int, worse: int, rounds: int = ROUNDS) -> np.ndarray:
    """Index pairs (better, worse): in each round every document of the larger side meets another one of the smaller."""
    if not better or not worse:
        return np.zeros((0, 2), int)
    n = max(better, worse)
    steps = np.arange(n)
    return np.concatenate([np.stack([(steps + r) % better, (steps * (1 + r % 2) + r * 7) % worse], 1) for r in range(rounds)])


def expanded(x: np.ndarray) -> np.ndarray:
    """Features, square roots of the shares, and squares of all: a ranking that is linear in these may bend in each."""
    return np.concatenate([x, np.sqrt(np.maximum(x, 0)), x * x], 1)


def learning_blocks(known: DataFrame, size: int = BLOCK, rarer: int = RARER) -> DataFrame:
    """(better, x): labelled documents (label, h, f) in blocks of about ``size``, each a matrix of features with the ``better``
    documents first, either label in order of ``h``. Every row is in a block. Those of a rare label are in several, so that the
    others find ``rarer`` of them; a block of one label has no pairs. Equal rows are counted before they are dealt.
    """
    sizes = {r["good"]: r["n"] for r in known.groupBy((F.col("label") > 0).alias("good")).agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = max(1, -(-sum(sizes.values()) // size))
    times = {good: min(blocks, max(1, -(-rarer * blocks // n))) for good, n in sizes.items()}
    rows = known.groupBy("h", (F.col("label") > 0).alias("good"), "f").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {TOGETHER}"))).alias("part"))
    again = F.when(F.col("good"), times.get(True, 1)).otherwise(times.get(False, 1))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), again - 1)).alias("copy"))
    place = ((F.pmod(F.xxhash64("h", "part"), F.lit(blocks)) + F.col("copy")) % blocks).alias("block")
    many = F.least(F.lit(TOGETHER), F.col("n") - F.col("part") * TOGETHER).cast("int").alias("many")
    values = F.array(*(F.col("f")[n] for n in known.schema["f"].dataType.names)).alias("x")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, better, held = None, 0, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([better], pa.int32()), pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["better", "x"])

        for batch in batches:
            x = np.asarray(batch.column(3).flatten()).reshape(batch.num_rows, -1)
            for at, (own, good, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if own != block:
                    if held:
                        yield out()
                    block, better, held = own, 0, []
                better += n * good
                held.append(np.repeat(x[at : at + 1], n, 0))
        if held:
            yield out()

    dealt = rows.select(place, "good", many, values, "h", "part").repartition("block").sortWithinPartitions("block", F.desc("good"), "h", "x", "part")
    return dealt.select("block", "good", "many", "x").mapInArrow(gather, "better int, x binary")


def newton_sums(x: np.ndarray, better: int, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the logistic loss over a block's pairs, whose first ``better`` rows are the better ones."""
    pairs = preference_pairs(better, len(x) - better)
    d = x[:better][pairs[:, 0]] - x[better:][pairs[:, 1]]
    p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
    return d.T @ (p - 1), (d.T * (p * (1 - p))) @ d


def fit_ranking(blocks: DataFrame | np.ndarray, mean: np.ndarray, spread: np.ndarray | None = None, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights w for which the better of each pair has the higher w.x with probability 1 / (1 + exp(-w.(x1 - x0))): Newton's
    method on the logistic loss of the differences of scaled features, with a ridge. Tasks add up their blocks' gradients and
    hessians; the driver gets one of each per task and solves for the step. A few rows may also be given as an array of their features
    and their labels in place of the mean."""
    local = isinstance(blocks, np.ndarray)
    size = blocks.shape[1] if local else len(mean)

    def task(w: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gradient, hessian = np.zeros(size), np.zeros((size, size))
            for batch in batches:
                for better, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    wide = expanded(np.frombuffer(x.as_buffer(), "f8").reshape(-1, size // 3))
                    g, h = newton_sums((wide - mean) / spread, better, w)
                    gradient += g
                    hessian += h
            sums = np.concatenate([gradient, hessian.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

        return add

    w, rows = np.zeros(size), np.concatenate([blocks[mean > 0], blocks[mean <= 0]]) if local else None
    for _ in range(steps):
        if local:
            got = [np.concatenate([np.ravel(s) for s in newton_sums(rows, int((mean > 0).sum()), w)])]
        else:
            got = [np.frombuffer(r["sums"], "f8") for r in blocks.mapInArrow(task(w), "sums binary").collect()]
        sums = np.sum(got, 0) if got else np.zeros(size + size * size)
        step = np.linalg.solve(sums[size:].reshape(size, size) + ridge * np.eye(size), sums[:size] + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def quantile_of(merits: DataFrame, share: float, bins: int = BINS) -> float:
    """The merit below which ``share`` of all rows (merit, label) lie, halfway to the one before it. Either label weighs its share,
    1 - ``share`` for label 1, whatever the number of its rows. Rows are counted per range, and the range that holds it is cut again
    until its values are few; no row comes to the driver but as a count."""
    good = F.col("label") > 0
    known = merits.agg(F.count_if(~good).alias("n0"), F.count_if(good).alias("n1"), F.min("merit").alias("lo"), F.max("merit").alias("hi")).first()
    if known["lo"] is None:
        return 0.0
    weigh = np.array([share / max(known["n0"], 1), (1 - share) / max(known["n1"], 1)])
    # A millionth of a row's weight keeps the sums' rounding from deciding.
    least = share * float(weigh @ (known["n0"], known["n1"])) + float(weigh.max()) / 1e6
    lo, hi, below, before = known["lo"], known["hi"], 0.0, None
    while True:
        inside = merits.where(F.col("merit").between(lo, hi))
        width = (hi - lo) / bins
        part = F.least(F.floor((F.col("merit") - lo) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        found = inside.groupBy(part.alias("part")).agg(
            F.min("merit").alias("lo"), F.max("merit").alias("hi"), F.count_if(~good).alias("n0"), F.count_if(good).alias("n1")
        )
        ranges = sorted(found.collect(), key=lambda r: r["lo"])
        for at, r in enumerate(ranges):
            upto = below + float(weigh @ (r["n0"], r["n1"]))
            if upto >= least or at == len(ranges) - 1:
                break
            below, before = upto, r["hi"]
        lo, hi = r["lo"], r["hi"]
        if lo == hi or width <= 0 or lo + (hi - lo) / bins <= lo:
            first = weigh[1] if r["n1"] else weigh[0]
            return float((lo + (lo if before is None or below + first < least else before)) / 2)


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: int = 2, broadcast_rows: int = 2_000_000, block: int = BLOCK) -> DataFrame:
    """(row, held_out, score) for each row of ``docs`` (doc_id, text, any others).

    Each labelled document outside fold ``held_out`` of crc32(doc_id) modulo 4 counts as better or worse. All of them are
    paired, in blocks of about ``block``, and a Bradley-Terry model of their features gives every document a merit. The
    score is a logistic function of the merit that passes 0.7 at the quantile of the labelled documents' merits which the
    share of label 0 names.

    Features are column expressions over the whole text, so scoring is one pass without a shuffle; those of labelled documents
    are stored and dealt to blocks, and the driver gets sums of them. Null texts are empty, and empty texts have features like
    any other. Without labels, or with labels of one kind, all scores are alike. Repeated documents are each scored, and of
    several labels the smallest counts. An empty table gives no rows. Other columns ride along in ``row`` whatever their names.
    """
    known = one_label(labels, "quality").where(fold("doc_id", FOLDS) != held_out)
    rows = docs.select(F.struct("*").alias("row"), features(text_of()).alias("f"))
    learned = stored(
        with_label(docs.select("doc_id", text_of().alias("text")), known, broadcast_rows).select(
            "label", F.xxhash64("doc_id").alias("h"), features(F.col("text")).alias("f")
        ),
        "features",
    )
    share = known.agg(F.avg((F.col("label") == 0).cast("double"))).first()[0] or 0.0
    names = rows.schema["f"].dataType.names
    f = [F.col("f")[n] for n in names]
    terms = [*f, *(F.sqrt(F.greatest(c, F.lit(0.0))) for c in f), *(c * c for c in f)]
    # Spark's deviation of equal values is 0, which a difference of sums would miss.
    told = learned.agg(*(F.avg(c) for c in terms), *(F.stddev_pop(c) for c in terms)).first()
    mean, spread = np.array([v or 0.0 for v in told], "f8").reshape(2, -1)
    spread[spread < 1e-9] = 1.0
    w = fit_ranking(stored(learning_blocks(learned, block), "blocks"), mean, spread)
    line = F.lit(float(-(mean / spread) @ w))
    for c, a in zip(terms, w / spread, strict=True):
        line = line + c * float(a)
    merits = stored(learned.select(line.alias("merit"), "label"), "merits")
    at = quantile_of(merits, share)
    scale = max(merits.agg(F.stddev_pop("merit")).first()[0] or 0.0, 1e-9)
    score = 1 / (1 + F.exp(-((line - at) * (4.0 / scale) + float(np.log(LEAST / (1 - LEAST))))))
    return rows.select("row", (fold("row.doc_id", FOLDS) == held_out).alias("held_out"), score.alias("score"))
