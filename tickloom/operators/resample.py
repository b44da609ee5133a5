"""Ticks and bars to OHLCV bars of other intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Interval names accepted by bar builders, in seconds.
INTERVAL_SECONDS = {
    "1min": 60,
    "5min": 300,
    "10min": 600,
    "15min": 900,
    "30min": 1800,
    "1h": 3600,
    "4h": 14400,
    "1d": 86400,
}


def interval_seconds(name: str | int) -> int:
    if isinstance(name, int):
        return name
    key = name.strip().lower()
    key = {"1hour": "1h", "60min": "1h", "4hour": "4h", "1day": "1d"}.get(key, key)
    if key not in INTERVAL_SECONDS:
        raise ValueError(f"unknown interval {name!r}; use one of {', '.join(INTERVAL_SECONDS)} or seconds")
    return INTERVAL_SECONDS[key]


def slot(ts: Column, seconds: Column | int, closed: str = "left") -> Column:
    """Label of the interval that holds ``ts``: its start, or its end when right-closed."""
    n = F.lit(seconds) if isinstance(seconds, int) else seconds
    us = F.unix_micros(ts)
    width = n.cast("long") * F.lit(1_000_000).cast("long")
    if closed == "left":
        start = us - F.pmod(us, width)
        return F.timestamp_micros(start)
    end = us + F.pmod(-us, width)
    return F.timestamp_micros(end)


def _ohlcv(order: Column, price: Column | None) -> list[Column]:
    o, h, l, c = (price,) * 4 if price is not None else (F.col("open"), F.col("high"), F.col("low"), F.col("close"))
    return [
        F.min_by(o, order).alias("open"),
        F.max(h).alias("high"),
        F.min(l).alias("low"),
        F.max_by(c, order).alias("close"),
        F.sum("volume").alias("volume"),
    ]


def _order(df: DataFrame, cols: Sequence[str]) -> Column:
    """One comparable value for an ordering by several columns.

    A plain column or a decimal keeps the hash aggregate; a struct would need a sort
    of the raw rows before they are combined.  (time, integer) therefore becomes
    ``micros * 10^20 + integer + 2^63``, which orders the same way and is exact.
    """
    if len(cols) == 1:
        return F.col(cols[0])
    kinds = [df.schema[c].dataType for c in cols]
    if len(cols) == 2 and isinstance(kinds[0], T.TimestampType) and isinstance(kinds[1], (T.LongType, T.IntegerType)):
        scale, shift = F.expr("cast('100000000000000000000' as decimal(21,0))"), F.expr("cast('9223372036854775808' as decimal(20,0))")
        return F.unix_micros(cols[0]).cast("decimal(18,0)") * scale + (F.col(cols[1]).cast("decimal(20,0)") + shift)
    return F.struct(*cols)


def resample(df: DataFrame, interval: str | int, order: Sequence[str] = ("ts",), price: str | None = None,
             keys: Sequence[str] = ("symbol",), closed: str = "left") -> DataFrame:
    """Bars per key and interval; empty intervals do not appear.

    ``price`` set: ticks (one price); else open/high/low/close bars are combined.
    ``order`` must identify the first and last row of an interval without ties.
    The aggregate is partial on the map side, so a hot symbol shrinks before the
    shuffle to one row per interval and input partition.
    """
    label = slot(F.col("ts"), interval_seconds(interval), closed)
    aggs = _ohlcv(_order(df, order), F.col(price) if price else None)
    return df.groupBy(*keys, label.alias("_slot")).agg(*aggs).withColumnRenamed("_slot", "ts").select(
        *keys, "ts", "open", "high", "low", "close", "volume"
    )


def resample_cascade(ticks: DataFrame, intervals: Sequence[str], order: Sequence[str] = ("ts",),
                     price: str | None = None) -> DataFrame:
    """Several intervals in one pass over the ticks, with an ``interval`` column.

    The finest interval is built once; every bar is then sent to its coarser
    slots.  All intervals must be multiples of the finest one.
    """
    secs = sorted((interval_seconds(i), i) for i in intervals)
    base = secs[0][0]
    if any(s % base for s, _ in secs):
        raise ValueError("intervals must be multiples of the finest one")
    fine = resample(ticks, base, order, price)
    targets = F.array(*[F.struct(F.lit(n).alias("interval"), F.lit(s).alias("secs")) for s, n in secs])
    spread = fine.withColumn("_t", F.explode(targets))
    return (
        spread.groupBy("symbol", F.col("_t.interval").alias("interval"),
                       slot(F.col("ts"), F.col("_t.secs")).alias("_slot"))
        .agg(*_ohlcv(F.col("ts"), None))
        .withColumnRenamed("_slot", "ts")
    )


def resample_right(bars: DataFrame, interval: str, zone: str | None = None, source: str = "10min") -> DataFrame:
    """Right-labelled, right-closed bars without incomplete rows; times shown in ``zone``."""
    if interval_seconds(interval) == interval_seconds(source):
        out = bars
    else:
        out = resample(bars, interval, closed="right")
    out = out.na.drop(subset=["open", "high", "low", "close"])
    if zone:
        out = out.withColumn("ts", F.from_utc_timestamp("ts", zone))
    return out


def dense_grid(bars: DataFrame, interval: str | int, slice_days: int = 30) -> DataFrame:
    """Every slot between a symbol's first and last bar; empty ones have volume 0 and no prices.

    Slots are generated per calendar slice, so one row never expands to a whole history.
    """
    n = interval_seconds(interval)
    width = 86400 * slice_days
    span = bars.groupBy("symbol").agg(
        F.unix_seconds(F.min("ts")).alias("lo"), F.unix_seconds(F.max("ts")).alias("hi")
    )
    slices = span.select(
        "symbol", "lo", "hi",
        F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("sl"),
    )
    start = F.greatest(F.col("lo"), F.ceil(F.col("sl") * width / n) * n)
    stop = F.least(F.col("hi"), (F.ceil((F.col("sl") + 1) * width / n) - 1) * n)
    slots = slices.withColumn("start", start).withColumn("stop", stop).filter("start <= stop").select(
        "symbol", F.explode(F.sequence("start", "stop", F.lit(n).cast("long"))).alias("_s")
    )
    slots = slots.select("symbol", F.timestamp_seconds("_s").alias("ts"))
    return slots.join(bars, ["symbol", "ts"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))
