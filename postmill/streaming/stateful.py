"""Stateful operators of a message feed, as Structured Streaming.

Each keeps a bounded state for a key: a watermark bounds remembered ids, a bucket or a window is two
numbers, which a timer deletes once the key has been idle. The same folds run in a batch, so tests and replays agree with the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from .. import _ship  # noqa: F401

BURST, PER_MINUTE = 40.0, 240.0  #: Fixed values: a bucket's size and refill.


def first_deliveries(feed: DataFrame, keys: list[str], at: str = "ts", horizon: str = "7 days") -> tuple[DataFrame, DataFrame]:
    """(rows with a key, once each; rows without one, all of them). Null keys can't be told apart, so they bypass the state."""
    known = feed
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    missing = feed.where(" OR ".join(f"`{k}` IS NULL" for k in keys))
    if feed.isStreaming:
        return known.withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys), missing
    first = Window.partitionBy(*keys).orderBy(at)
    return known.withColumn("__no", F.row_number().over(first)).where("__no = 1").drop("__no"), missing


def unseen(batch: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """What a micro-batch adds to a stored table: rows whose key is new, once each, and rows without a key."""
    known, missing = first_deliveries(batch, keys)
    return known.join(stored.select(*keys), keys, "left_anti").unionByName(missing)


def daily_rollup(feed: DataFrame, keys: list[str], at: str = "ts", late: str = "2 days") -> DataFrame:
    """Counts for each UTC day and key; late rows are counted until the watermark passes their day."""
    source = feed.withWatermark(at, late) if feed.isStreaming else feed
    return source.groupBy(F.window(at, "1 day").alias("w"), *keys).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), *keys, "n")


def merged_rollup(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rollup with a finished batch added."""
    return stored.unionByName(fresh).groupBy("day", *keys).agg(F.sum("n").alias("n"))


def token_bucket(state: tuple[float, float] | None, times: list[float], burst: float = BURST, per_minute: float = PER_MINUTE) -> tuple[tuple[float, float], list[bool]]:
    """The bucket after requests at ``times`` (seconds, ascending), and which of them it lets pass."""
    tokens, last = state or (burst, times[0] if times else 0.0)
    passed = []
    for t in times:
        tokens, last = min(burst, tokens + max(0.0, t - last) * per_minute / 60), max(t, last)
        passed.append(tokens >= 1)
        tokens -= passed[-1]
    return (tokens, last), passed


def fixed_window(state: tuple[float, int] | None, times: list[float], most: int, hours: float) -> tuple[tuple[float, int], list[bool]]:
    """A counter whose window starts at a request and is left ``hours`` later."""
    begun, n = state or (float("-inf"), 0)
    passed = []
    for t in times:
        begun, n = (t, 1) if t - begun > hours * 3600 else (begun, n + 1)
        passed.append(n <= most)
    return (begun, n), passed


Fold = Callable[[tuple | None, list[float]], tuple[tuple, list[bool]]]
IDLE = 3600.0  #: Fixed value: seconds without a request after which a key is forgotten.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Limits(StatefulProcessor):
    """Folds each key's requests over a value state, and forgets a key by a timer, ``idle`` seconds of event time after its last request."""

    def __init__(self, key: str, fold: Fold, idle: float):
        self.key, self.fold, self.idle = key, fold, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("kept", "a double, b double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, last = (tuple(self.kept.get()) if self.kept.exists() else None), 0.0
        for frame in rows:  # of bounded size, each in its own order of time
            times = frame["at"].sort_values()
            state, passed = self.fold(state, [t.timestamp() for t in times])
            last = max(last, times.iloc[-1].timestamp())
            yield pd.DataFrame({self.key: key[0], "at": times.to_numpy(), "passed": passed})
        self.kept.update(tuple(map(float, state)))
        ends = max(int((last + self.idle) * 1000), timerValues.getCurrentWatermarkInMs() + 1)
        for old in list(self.handle.listTimers()):
            ends = max(ends, old)
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ends)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.kept.clear()
        return iter(())


def limited(feed: DataFrame, key: str, fold: Fold, at: str = "ts", idle: float = IDLE, late: str = "0 seconds") -> DataFrame:
    """Rows (key, at, passed) of a feed or a table, by a fold over each key's requests in the order of time.

    ``idle``: seconds without a request after which a key's state is as good as new, as a full bucket or a window that is over, so it is
    forgotten. A table is cut at such pauses, so a task holds a key's requests between two of them and not all. In a stream, which needs the
    RocksDB state store and sets it, requests that come more than ``late`` after others are dropped."""
    spark, kind = feed.sparkSession, feed.schema[key].dataType.simpleString()
    rows = feed.select(key, F.col(at).cast("timestamp").alias("at"))
    shape = f"`{key}` {kind}, at timestamp, passed boolean"
    if feed.isStreaming:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        return rows.withWatermark("at", late).groupBy(key).transformWithStateInPandas(Limits(key, fold, idle), shape, "append", "EventTime")
    by_key = Window.partitionBy(key).orderBy("at")
    paused = F.coalesce(F.col("at").cast("double") - F.lag("at").over(by_key).cast("double") > idle, F.lit(False))
    cut = rows.withColumn("__paused", paused).withColumn("__run", F.sum(F.col("__paused").cast("int")).over(by_key.rowsBetween(Window.unboundedPreceding, 0)))

    def whole(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("at")
        return b.assign(passed=fold(None, [t.timestamp() for t in b["at"]])[1])[[key, "at", "passed"]]

    return cut.groupBy(key, "__run").applyInPandas(whole, shape)


def item_action(attempts: int, size: int, seen: bool, duplicate: bool, error: str | None, most: int = 25 << 20) -> str:
    """What becomes of one fetched item."""
    if seen or duplicate:
        return "skip"
    if size > most:
        return "too_large"
    if error is None:
        return "deliver"
    return "poison" if error == "permanent" or attempts >= 3 else "retry"


