"""Signals over a stream of bars that arrive out of order, with state variables and event-time timers.

A bar waits in list state until the watermark has passed it; then the waiting bars of its symbol are applied in the order of
time. A bar that comes late but within the watermark's delay is therefore applied where it belongs and the results equal
the batch operators; Spark drops bars behind the watermark. State is kept by the RocksDB provider, on disk
and in changelogs, and holds one row of numbers per symbol and the bars of one delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.operators.signals import Trend
from tickloom.streaming.stateful import OUTPUT, STATE, _advance, fresh

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = "us long, close double, high double, low double"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which state variables need."""
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if was is None else spark.conf.set(PROVIDER, was)


class Ordered(StatefulProcessor):
    """Applies a symbol's bars in time order once the watermark has passed them."""

    def __init__(self, p: Trend, rsi_len: int, limit: float):
        self.settings = p, rsi_len, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getValueState("numbers", STATE)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            us = pdf["ts"].astype("datetime64[us]").astype("int64")
            arrived = [(int(t), float(c), float(h), float(low)) for t, c, h, low in zip(us, pdf["close"], pdf["high"], pdf["low"])]
            self.waiting.appendList(arrived)
            first = min([first or arrived[0][0], *(t for t, *_ in arrived)])
        if first is not None:
            self.handle.registerTimer(first // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        bars = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, later = [b for b in bars if b[0] <= watermark], [b for b in bars if b[0] > watermark]
        if not ready:
            return
        names = [f.split()[0] for f in STATE.split(", ")]
        s = dict(zip(names, self.numbers.get())) if self.numbers.exists() else fresh()
        out = []
        for us, close, high, low in ready:
            late = us <= s["last_us"]  # a second bar of the same time
            values = (None, None, None, None, s["held"], s["peak"], None, False, True)
            if not late:
                s["last_us"] = us
                values = _advance(s, pd.Series({"close": close, "high": high, "low": low}), *self.settings)
            out.append((key[0], pd.Timestamp(us, unit="us"), close, *values))
        self.numbers.update(tuple(s[n] for n in names))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0] // 1000)
        else:
            self.waiting.clear()
        res = pd.DataFrame(out, columns=[f.split()[0] for f in OUTPUT.split(", ")])
        res["raw_dir"] = res["raw_dir"].astype("Int32")
        yield res

    def close(self) -> None:
        pass


def ordered_signals(bars: DataFrame, delay: str, p: Trend = Trend(), rsi_len: int = 14, limit: float = 0.3) -> DataFrame:
    """``stateful_signals`` for bars in any order within ``delay``; start the stream inside ``rocksdb_state``.

    A bar comes out once a later bar of any symbol has moved the watermark past it.
    """
    return bars.withWatermark("ts", delay).groupBy("symbol").transformWithStateInPandas(
        Ordered(p, rsi_len, limit), OUTPUT, "append", "eventTime")
