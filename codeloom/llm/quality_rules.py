"""Quality rules: base counts of a text, and a hashed n-gram likelihood ratio against the raw corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import BLANKS, let, one_label, stored, text_of, with_label, words_of

SYMBOLS = "#*$%&|<>"

#: Words in a window whose repeats count, and limits of the base rules.
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30

#: Buckets of the hashed n-grams, the pseudo-count of each, and the least ratio per n-gram that is kept.
BUCKETS = 16384
PRIOR = 1.0
LEAST_RATIO = -0.06


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in a window found twice or more in the array, first ones included.

    Windows are compared by 64-bit hashes within one text. Only texts that hold a repeat sort their windows, so
    that equal ones are neighbours; the words of the repeated windows are then counted along their positions.
    """
    def hashes(w: Column) -> Column:
        parts = lambda i: F.xxhash64(*(w[i + k] for k in range(window)))
        starts = F.when(F.size(w) >= window, F.sequence(F.lit(0), F.size(w) - window)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, parts)

    def covered(at: Column) -> Column:
        gap = lambda p, i: F.when(i == 0, F.lit(window)).otherwise(F.least(F.lit(window), p - at[i - 1]))
        return F.aggregate(F.transform(at, gap), F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        tagged = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i + 1 < F.size(s)) & (s[F.least(i + 1, F.size(s) - 1)]["h"] == x["h"])))
        places = let(tagged, lambda s: F.array_sort(F.transform(twice(s), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(places, covered))

    return let(let(words, hashes), count).cast("bigint")


def base_counts(text: Column, words: Column) -> dict[str, Column]:
    """Counts of a text that is not null, in code points and words."""
    with_word = F.filter(F.split(text, "\n", -1), lambda line: F.translate(line, BLANKS, "") != "")
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
        "n_dup_lines": let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": repeated_words(words),
    }


def buckets(words: Column) -> Column:
    """Bucket of each word, then of each pair of neighbours."""
    def both(h: Column) -> Column:
        after = F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0)))
        pairs = F.zip_with(F.slice(h, F.lit(1), F.size(after)), after, lambda x, y: F.xxhash64(x, y))
        return F.transform(F.concat(h, pairs), lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), both)


def ngram_weights(docs: DataFrame, trusted: DataFrame, broadcast_rows: int = 2_000_000) -> Column:
    """A constant array: per bucket, the log of the target's share over the corpus's share.

    ``trusted`` has the doc_ids of the target. All documents are counted, n-grams of one and two words. A task adds up
    its own rows first, so what is shuffled is at most ``BUCKETS`` rows a task, and the result has ``BUCKETS`` numbers.
    """
    marked = with_label(
        docs.select("doc_id", buckets(words_of(text_of())).alias("buckets")), trusted.select("doc_id", F.lit(1).alias("target")),
        broadcast_rows, "left",
    )
    ngrams = marked.select(F.coalesce("target", F.lit(0)).alias("target"), F.explode("buckets").alias("bucket"))
    counts = ngrams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("target").alias("good"))
    spark = docs.sparkSession
    counts = stored(counts, "ngrams")
    dense = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    totals = counts.agg(F.sum("raw").alias("all_raw"), F.sum("good").alias("all_good")).first()
    share = lambda c, total: F.log((F.coalesce(F.col(c), F.lit(0)) + PRIOR) / ((total or 0) + PRIOR * BUCKETS))
    weight = share("good", totals["all_good"]) - share("raw", totals["all_raw"])
    rows = dense.select("bucket", weight.alias("weight")).collect()  # BUCKETS rows, whatever the corpus
    text = ",".join(repr(w) for _, w in sorted(map(tuple, rows)))
    return F.split(F.lit(text), ",").cast("array<double>")


def ratio(words: Column, weights: Column) -> Column:
    """Sum of the weights of a text's n-grams over their number; 0 for a text without words."""
    def mean(b: Column) -> Column:
        return F.when(F.size(b) == 0, 0.0).otherwise(F.aggregate(b, F.lit(0.0), lambda total, x: total + weights[x]) / F.size(b))

    return let(buckets(words), mean)


def quality_rules(
    docs: DataFrame, trusted: DataFrame, least_ratio: float = LEAST_RATIO, broadcast_rows: int = 2_000_000
) -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept) per row of ``docs``.

    Base rules fail a text of under 20 words, or with more than 30 % of its words in repeated windows. The ratio is
    the log-likelihood of the text's hashed one- and two-word n-grams under the trusted target less that
    under the whole corpus, per n-gram; ``kept`` are texts that pass the base and reach ``least_ratio``. The verdict
    depends on the tables alone. Scoring happens within each row, with the weights as one value of fixed size.

    Null texts are empty: no words, ratio 0, base failed. Very long texts are whole. A table without trusted rows
    gives every n-gram a weight by its share alone; an empty one gives no rows. Repeated rows are each counted and
    returned; repeated labels count once. Other columns ride along in ``row`` whatever their names.
    """
    weights = ngram_weights(docs, trusted, broadcast_rows)
    text = text_of()
    rows = docs.select(F.struct("*").alias("row"), text.alias("_text"), words_of(text).alias("_words"))
    rows = rows.select("*", *(c.alias(n) for n, c in base_counts(F.col("_text"), F.col("_words")).items()))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    scored = ratio(F.col("_words"), weights)
    return (
        rows.withColumn("base_failed", failed)
        .withColumn("ratio", scored)
        .withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= least_ratio))
        .drop("_text", "_words")
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents that are labelled as of good quality."""
    return one_label(labels, "quality").where("label = 1").select("doc_id")
