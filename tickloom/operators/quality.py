"""Data checks: coverage, bar consistency, value ranges, density, feature distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import correlation
from tickloom.operators.blocks import KEYS, block_window, blocked, core, join_safe


def summary(bars: DataFrame) -> DataFrame:
    """Rows, first and last bar with their prices per symbol."""
    first, last = F.min_by(F.struct("close", "volume"), "ts"), F.max_by(F.struct("close", "volume"), "ts")
    return (
        bars.groupBy("symbol")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
             first.alias("_f"), last.alias("_l"))
        .select("symbol", "n_rows", "first_ts", "last_ts", F.col("_f.close").alias("first_close"),
                F.col("_f.volume").alias("first_volume"), F.col("_l.close").alias("last_close"),
                F.col("_l.volume").alias("last_volume"))
    )


def _count(pred):
    return F.sum(pred.cast("long"))


def bar_report(bars: DataFrame, rows_in: DataFrame | None = None, seq: str | None = None) -> DataFrame:
    """Consistency counts per symbol.

    Duplicates are found by first collapsing equal (symbol, ts), which splits a
    hot symbol over tasks.  ``seq`` names the arrival order and adds ``unsorted``:
    rows that arrived with a time before that of their predecessor.
    ``rows_in`` has (symbol, rows_in) of the source for the size ratio.
    """
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    checks = {
        "low_above_high": l > h,
        "open_outside": (o < l) | (o > h),
        "close_outside": (c < l) | (c > h),
        "negative_volume": v < 0,
    }
    per_ts = bars.groupBy("symbol", "ts").agg(
        F.count(F.lit(1)).alias("n"), *[_count(F.coalesce(p, F.lit(False))).alias(k) for k, p in checks.items()]
    )
    out = per_ts.groupBy("symbol").agg(
        F.sum("n").alias("rows_out"), (F.sum("n") - F.count(F.lit(1))).alias("duplicate_ts"),
        *[F.sum(k).alias(k) for k in checks],
    )
    if seq:
        out = join_safe(out, arrival_disorder(bars, seq), ["symbol"])
    if rows_in is not None:
        out = join_safe(out, rows_in, ["symbol"]).withColumn(
            "ratio_suspicious", F.coalesce(F.col("rows_out") / F.col("rows_in") > 10, F.lit(False))
        )
    return out


def arrival_disorder(df: DataFrame, seq: str, width: int = 32768) -> DataFrame:
    """Rows per symbol that are older than the row before them in arrival order.

    Runs on ranges of ``seq``; the last time of the range before enters each range.
    """
    d = df.select("symbol", "ts", F.col(seq).alias("_q"), F.floor(F.col(seq) / width).alias("_b"))
    w = Window.partitionBy("symbol", "_b").orderBy("_q")
    inner = d.withColumn("_bad", (F.col("ts") < F.lag("ts").over(w)).cast("long"))
    blocks = inner.groupBy("symbol", "_b").agg(
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"), F.min_by("ts", "_q").alias("f"), F.max_by("ts", "_q").alias("l")
    )
    seam = F.col("f") < F.lag("l").over(Window.partitionBy("symbol").orderBy("_b"))
    blocks = blocks.withColumn("bad", F.col("bad") + F.coalesce(seam.cast("long"), F.lit(0)))
    return blocks.groupBy("symbol").agg(F.sum("bad").alias("unsorted"))


def value_report(bars: DataFrame, jump: float = 0.10) -> DataFrame:
    """Null/infinite counts, close and volume ranges, one-bar return statistics (needs ``bar``)."""
    d = blocked(bars, back=1)
    d = d.withColumn("r", F.try_divide(F.col("close"), F.lag("close").over(block_window())) - 1)
    d = core(d)
    inf = float("inf")
    return d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("close").isNull()).alias("null_close"),
        F.count_if(F.col("volume").isNull()).alias("null_volume"),
        F.count_if(F.abs("close") == inf).alias("inf_close"),
        F.count_if(F.col("close") <= 0).alias("nonpositive_close"),
        F.min("close").alias("min_close"), F.max("close").alias("max_close"), F.avg("close").alias("mean_close"),
        F.min("volume").alias("min_volume"), F.max("volume").alias("max_volume"), F.avg("volume").alias("mean_volume"),
        F.avg("r").alias("mean_ret"), F.stddev_samp("r").alias("std_ret"), F.min("r").alias("min_ret"),
        F.max("r").alias("max_ret"), F.count_if(F.abs("r") > jump).alias("jumps"),
    )


def density(bars: DataFrame, low: float = 20.0) -> DataFrame:
    """Calendar days covered, bars per day and a low-density flag."""
    days = F.datediff(F.max("ts"), F.min("ts"))
    out = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), days.alias("days"))
    return out.withColumn("bars_per_day", F.col("n_rows") / F.greatest("days", F.lit(1))).withColumn(
        "low_density", F.col("bars_per_day") < low
    )


def trend_report(bars: DataFrame) -> DataFrame:
    """Lag-1 autocorrelation of close and of returns, total trend, volatility (needs ``bar``)."""
    w = block_window()
    d = blocked(bars, back=2).withColumn("_prev", F.lag("close").over(w))
    d = d.withColumn("r", F.try_divide("close", "_prev") - 1).withColumn("p", F.col("_prev"))
    d = core(d.withColumn("rp", F.lag("r").over(w)))
    return d.groupBy("symbol").agg(
        correlation("close", "p").alias("autocorr_close"), correlation("r", "rp").alias("autocorr_ret"),
        (F.try_divide(F.max_by("close", "bar"), F.min_by("close", "bar")) - 1).alias("total_trend"),
        F.stddev_samp("r").alias("volatility"),
    )


def feature_distribution(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Per column: rows, null and infinite counts, min, max, mean of the finite values (long form)."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(keys), list(cols), "feature", "x"
    )
    inf = F.abs(F.col("x")) == float("inf")
    ok = F.when(~inf & ~F.isnan("x"), F.col("x"))
    return long.groupBy(*keys, "feature").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("x").isNull() | F.isnan("x")).alias("n_null"),
        F.count_if(inf).alias("n_inf"), F.min(ok).alias("min_x"), F.max(ok).alias("max_x"), F.avg(ok).alias("mean_x"),
    )


def high_confidence_share(df: DataFrame, p: str = "p", levels: Sequence[float] = (0.6, 0.7),
                          keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of predictions above fixed levels."""
    return df.groupBy(*keys).agg(
        F.count(p).alias("n"),
        *[F.avg((F.col(p) > t).cast("double")).alias(f"above_{int(round(t * 100))}") for t in levels],
    )


def prediction_histogram(df: DataFrame, p: str = "p", bins: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts in equal right-closed bins of [0, 1], the lowest edge included."""
    b = F.when(F.col(p) <= 0, 0).otherwise(F.least(F.ceil(F.col(p) * bins) - 1, F.lit(bins - 1)))
    return df.filter(F.col(p).between(0, 1)).groupBy(*keys, b.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def prediction_stats(df: DataFrame, p: str = "p", thresholds: Sequence[float] = (0.5, 0.55, 0.6, 0.65, 0.7),
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """Range, mean, deviation of predictions and how many reach each threshold."""
    return df.groupBy(*keys).agg(
        F.count(p).alias("n"), F.min(p).alias("min_p"), F.max(p).alias("max_p"), F.avg(p).alias("mean_p"),
        F.stddev_samp(p).alias("std_p"),
        *[F.count_if(F.col(p) >= t).alias(f"ge_{int(round(t * 100))}") for t in thresholds],
    )
