"""Change detection on an unbounded feed of file revisions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from codeloom.operators.diff import changed_lines
from codeloom.operators.lines import cluster_files
from codeloom.operators.rewrite import new_side
from codeloom.operators.structure import changed_functions, functions

_PAIRS = "path string, rev bigint, prev_rev bigint, old_content string, new_content string"
_TRACKED = f"{_PAIRS}, forgotten boolean"
_PARKED = "path string, parked_rev bigint, parked_content string"

#: Characters of one path's micro-batch that a worker holds; more go to the state store until they are paired.
HELD_CHARS = 32_000_000

#: Characters of the pairs that a worker hands on at once.
HANDED_CHARS = 8_000_000

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _LastRevision(StatefulProcessor):
    """State per path: its last revision and content, and, only while a large micro-batch of the path is paired, the contents
    that do not fit in the worker. Numbers of revisions are held, contents in bounded amounts."""

    def __init__(self, ttl_ms: int | None, held_chars: int, handed_chars: int) -> None:
        self.ttl_ms, self.held_chars, self.handed_chars = ttl_ms, held_chars, handed_chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "rev bigint, content string")
        self.spilled = handle.getMapState("spilled", "rev bigint", "digest string, content string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get()) if self.last.exists() else None
        held: dict[int, tuple[str, str | None]] = {}
        away: set[int] = set()
        chars = 0
        for batch in rows:
            for rev, digest, content in zip(batch["rev"], batch["digest"], batch["content"]):
                rev = int(rev)
                if last is not None and rev <= last[0]:
                    continue
                known = held.get(rev) or (tuple(self.spilled.getValue((rev,))) if rev in away else None)
                # Of several contents under one revision the one with the least digest counts, in any order of arrival.
                if known is not None and known[0] <= digest:
                    continue
                content = content if isinstance(content, str) else None
                held[rev] = (digest, content)
                chars += len(content or "")
                if chars > self.held_chars:
                    self._spill(held, away)
                    chars = 0
        if away:
            self._spill(held, away)
        revs, first = sorted(away or held), last
        out, chars = [], 0
        for rev in revs:
            content = (self.spilled.getValue((rev,)) if away else held[rev])[1]
            out.append((key[0], rev, last[0] if last else None, last[1] if last else None, content, False))
            chars += len(content or "") + len(last[1] or "" if last else "")
            last = (rev, content)
            if chars > self.handed_chars:
                yield _frame(out)
                out, chars = [], 0
        if out:
            yield _frame(out)
        if away:
            self.spilled.clear()
        if last is not first:
            self.last.update(last)
        if self.ttl_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)

    def _spill(self, held: dict, away: set) -> None:
        for rev, value in held.items():
            self.spilled.updateValue((rev,), value)
        away.update(held)
        held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            rev, content = self.last.get()
            self.last.clear()
            yield _frame([(key[0], rev, None, None, content, True)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["path", "rev", "prev_rev", "old_content", "new_content", "forgotten"], dtype=object)
    return frame.astype({"rev": "int64", "prev_rev": "Int64", "forgotten": "bool"})


def _tracked(feed: DataFrame, ttl_ms: int | None) -> DataFrame:
    rows = feed.where("rev IS NOT NULL").selectExpr("path", "cast(rev AS bigint) AS rev", "content", "ifnull(md5(content), '') AS digest")
    processor = _LastRevision(ttl_ms, HELD_CHARS, HANDED_CHARS)
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return rows.groupBy("path").transformWithStateInPandas(processor, _TRACKED, "Append", mode)


def stream_pairs(feed: DataFrame) -> DataFrame:
    """Streaming twin of ``previous_revision`` on (path, rev, content); the state store must be RocksDB.

    State per path is its last revision and content. Revisions at or before it are stale and dropped, as are rows without a
    revision. A path's rows of one micro-batch may come in any order and number; of equal revisions one content counts.
    """
    return _tracked(feed, None).drop("forgotten")


def _with_parked(pairs: DataFrame, parked: DataFrame) -> DataFrame:
    """Pairs of paths that state had forgotten, with the revision they were forgotten at: what is not newer is stale, and the
    first newer revision follows it. Only (path, rev) is compared to find these; contents are fetched for the first ones."""
    latest = parked.groupBy("path").agg(F.expr("max(parked_rev) AS parked_rev"))
    met = pairs.join(latest, "path", "left").where("parked_rev IS NULL OR rev > parked_rev")
    first = "parked_rev IS NOT NULL AND ifnull(prev_rev < parked_rev, true)"
    returned = (
        met.where(first).drop("prev_rev", "old_content")
        .join(parked.dropDuplicates(["path", "parked_rev"]), ["path", "parked_rev"])
        .selectExpr("path", "rev", "parked_rev AS prev_rev", "parked_content AS old_content", "new_content")
    )
    return met.where(f"NOT ({first})").drop("parked_rev").unionByName(returned)


def _stream_batches(
    feed: DataFrame, batch: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, ttl_ms: int | None, **trigger
) -> StreamingQuery:
    """Run a batch operator on the pairs of every micro-batch and write its rows below ``target/batch=N``.

    With ``ttl_ms`` the state of a path without news for that long moves to a table below ``checkpoint/parked``; when the path
    returns its pairs are made from there, so forgetting changes no result.

    The pairs are written to ``checkpoint/pairs`` first, in place of those of the batch before, as the operator reads them more
    than once and state must advance once. Rewriting a batch's folders makes a repeated batch harmless.
    """

    def run(rows: DataFrame, number: int) -> None:
        spark, staged = rows.sparkSession, f"{checkpoint}/pairs"
        rows.write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(_TRACKED).parquet(staged)
        pairs = rows.where("NOT forgotten").drop("forgotten")
        if ttl_ms is not None:
            forgotten = rows.where("forgotten").selectExpr("path", "rev AS parked_rev", "new_content AS parked_content")
            forgotten.write.mode("overwrite").parquet(f"{checkpoint}/parked/batch={number}")
            parked = spark.read.schema(f"{_PARKED}, batch bigint").parquet(f"{checkpoint}/parked")
            pairs = _with_parked(pairs, parked.where(F.col("batch") < number).drop("batch"))
        batch(pairs).write.mode("overwrite").parquet(f"{target}/batch={number}")

    spark, trigger = feed.sparkSession, trigger or {"availableNow": True}
    wanted = {_PROVIDER: _ROCKSDB}
    if "availableNow" in trigger:
        # Timers ask for batches without rows as long as they run, and such a query would never end.
        wanted["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:  # a query keeps the settings it was started with
        return (
            _tracked(feed, ttl_ms)
            .writeStream.outputMode("append")
            .option("checkpointLocation", f"{checkpoint}/query")
            .foreachBatch(run)
            .trigger(**trigger)
            .start()
        )
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def stream_changed_lines(
    feed: DataFrame, target: str, checkpoint: str, mode: str = "aligned", ttl_ms: int | None = None, **trigger
) -> StreamingQuery:
    """Write (path, rev, ln) of changed lines as revisions arrive."""
    return _stream_batches(feed, lambda pairs: changed_lines(pairs, mode), target, checkpoint, ttl_ms, **trigger)


def stream_changed_functions(
    feed: DataFrame, target: str, checkpoint: str, ttl_ms: int | None = None, **trigger
) -> StreamingQuery:
    """Write the changed functions of every revision as it arrives."""

    def batch(pairs: DataFrame) -> DataFrame:
        fns = functions(cluster_files(new_side(pairs.where("NOT (old_content <=> new_content)"))))
        return changed_functions(fns, changed_lines(pairs))

    return _stream_batches(feed, batch, target, checkpoint, ttl_ms, **trigger)
