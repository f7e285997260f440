"""Shuffling rows into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import scratch, stored

SHARDS = 40
SEED = 12

#: Rows of a shard that are permuted by one task; larger shards are cut into cells of that size at most.
CELL = 1 << 18

#: Populations from which numpy draws; larger ones are drawn here.
_DRAWN = 10**9

_ROW_BITS = 33


def hypergeometric(good: int, bad: int, draws: int, rng: np.random.Generator) -> int:
    """How many of ``draws`` from ``good`` and ``bad`` ones are good.

    Populations beyond numpy's bound are drawn by inversion: log ratios of neighbouring probabilities are summed outwards
    from the mode, as far as forty standard deviations, where less than a double's last digit is left.
    """
    total = good + bad
    if total < _DRAWN:
        return int(rng.hypergeometric(good, bad, draws)) if draws and total else 0
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    spread = int(40 * (draws * (good / total) * (bad / total) * (total - draws) / max(total - 1, 1)) ** 0.5) + 60
    a, b = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(a, b, dtype="f8")  # log of p(k + 1) / p(k)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs[mode - a]))
    return a + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def drawn(cells: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each cell's places ``draws`` places hold, drawn without replacement from all of them."""
    total = int(cells.sum())
    if total < _DRAWN:
        return rng.multivariate_hypergeometric(cells, draws, method="marginals") if len(cells) else cells
    if len(cells) == 1:
        return np.array([draws], "i8")
    half = len(cells) // 2
    first = hypergeometric(int(cells[:half].sum()), int(cells[half:].sum()), draws, rng)
    return np.concatenate([drawn(cells[:half], first, rng), drawn(cells[half:], draws - first, rng)])


def matrix_row(ends: np.ndarray, cells: np.ndarray, block: int, seed: int) -> np.ndarray:
    """One row of the communication matrix: the rows that ``block`` sends to each cell.

    ``ends`` are running counts of the blocks' rows. The blocks are halved again and again; at each halving the first half's
    share of every cell is drawn from a generator of its own seed, so every task that walks by draws the same. A row takes
    as many draws of a vector as the number of blocks has bits; nobody holds the matrix.
    """
    low, high, left = 0, len(ends), cells
    before = lambda k: int(ends[k - 1]) if k else 0
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, low, high])))
        first = drawn(left, before(middle) - before(low), rng)
        left, low, high = (first, low, middle) if block < middle else (left - first, middle, high)
    return left


def cell_sizes(rows: int, shards: int, cell: int) -> tuple[np.ndarray, int]:
    """Sizes of all cells, those of a shard side by side, and cells per shard. Shards differ by one row at most, and so do
    the cells of a shard."""
    per = max(1, -(-(-(-rows // shards)) // cell))
    sizes = np.full(shards, rows // shards, "i8") + (np.arange(shards) < rows % shards)
    return (sizes[:, None] // per + (np.arange(per) < sizes[:, None] % per)).reshape(-1).astype("i8"), per


def shuffled_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, cell: int = CELL) -> DataFrame:
    """(row, shard, slot): every row of ``docs`` at its place in a uniformly random order dealt to ``shards`` shards.

    Each input partition is permuted by itself and written with its rows' numbers. From the partitions' sizes, and nothing
    else, the communication matrix follows: how many rows each of them sends to each cell of a shard, distributed as in a
    uniform permutation, with exact sums of rows and columns. A partition's rows go to the cells in turn; cells permute
    what they got. The shards' sizes differ by one at most, whatever the partitions hold, and ``slot`` counts a shard's
    rows from 0 without gaps.

    Rows travel once. Only the partitions' sizes come to the driver. Shards of any size are cut into cells of ``cell`` rows,
    so that no task permutes more. Lost tasks are made again from the written permutation and from seeds, with the same
    result; a later run agrees when it finds the same partitions.

    No column is looked at: nulls, empty and very long texts, ties and repeated rows are rows like others, and other columns
    ride along in ``row`` whatever their names. With fewer rows than shards the last shards stay empty. An empty table
    gives no rows.
    """
    permuted = docs.select(F.struct("*").alias("row"), F.rand(seed).alias("key"), F.rand(seed + 1).alias("again"))
    permuted = permuted.sortWithinPartitions("key").select("row", "again", F.monotonically_increasing_id().alias("mono"))
    kept = stored(permuted, "permuted").select(
        "row", "again", "mono", F.shiftright("mono", _ROW_BITS).alias("block"), F.col("mono").bitwiseAND((1 << _ROW_BITS) - 1).alias("at")
    )
    counts = {r["block"]: r["n"] for r in kept.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends = np.cumsum([counts.get(k, 0) for k in range(max(counts, default=0) + 1)]).astype("i8")
    rows = int(ends[-1])
    per = cell_sizes(rows, shards, cell)[1]

    @F.pandas_udf("bigint")
    def cell_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        sizes, of, reach = cell_sizes(rows, shards, cell)[0], None, None
        for blocks, at in batches:
            blocks, at = blocks.to_numpy(), at.to_numpy()
            out = np.empty(len(blocks), "i8")
            for block in np.unique(blocks).tolist():
                if block != of:
                    of, reach = block, np.cumsum(matrix_row(ends, sizes, block, seed))
                mine = blocks == block
                out[mine] = np.searchsorted(reach, at[mine], side="right")
            yield pd.Series(out)

    sent = kept.withColumn("cell", cell_of("block", "at"))
    place = F.row_number().over(Window.partitionBy("cell").orderBy("again", "mono")) - 1
    shard, number = F.floor(F.col("cell") / per), F.col("cell") % per
    size = F.lit(rows // shards) + (shard < rows % shards).cast("bigint")
    begin = number * F.floor(size / per) + F.least(number, size % per)
    return sent.withColumn("place", place).select("row", shard.cast("int").alias("shard"), (begin + F.col("place")).cast("bigint").alias("slot"))


def write_shards(docs: DataFrame, path: str | None = None, **settings) -> str:
    """Write the rows of ``docs``, with ``shard`` and ``slot`` beside their columns, as Parquet in a folder per shard."""
    path = path or scratch(docs.sparkSession, "shards")
    placed = shuffled_shards(docs, **settings)
    placed.select("row", "slot", "shard").write.partitionBy("shard").parquet(path)
    return path
