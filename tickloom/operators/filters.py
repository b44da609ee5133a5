"""Signal filters, quality gates and top-k selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import clip_side, side_of
from tickloom.functions.timeparse import clock_text
from tickloom.operators import indicators as I
from tickloom.operators.blocks import KEYS, blocked, core, join_safe
from tickloom.operators.quantiles import exact_quantiles, quantile_columns


def date_range(df: DataFrame, start: str | None = None, end: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows from start to end, both included; reaches the Parquet scan as a pushed filter."""
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end).cast("timestamp"))
    return df


def session_window(df: DataFrame, start: str, end: str, zone: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows whose time of day lies in [start, end], in ``zone`` when given."""
    pad = lambda s: s if len(s) == 8 else s + ":00"
    return df.filter(clock_text(F.col(ts), zone).between(pad(start), pad(end)))


def top_k_per_day(df: DataFrame, k: int, ts: str = "ts", keys: Sequence[str] = KEYS, tie: Sequence[str] = ()) -> DataFrame:
    """The k best rows per day by conf and score (else the latest); ties go to the earlier time."""
    ranks = [c for c in ("conf", "score") if c in df.columns]
    order = [F.col(c).desc() for c in ranks] or [F.col(ts).desc()]
    w = Window.partitionBy(*keys, F.to_date(ts)).orderBy(*order, F.col(ts), *tie)
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k).drop("_rk")


def filter_signals(df: DataFrame, min_conf: float | None = None, per_day: int | None = None, start: str | None = None,
                   end: str | None = None, min_atr: float | None = None, max_spread: float | None = None,
                   use_regime: bool = False, zone: str | None = None, keys: Sequence[str] = KEYS,
                   tie: Sequence[str] = ()) -> DataFrame:
    """The filter chain in its fixed order; a filter without its column does nothing.

    The daily selection comes before the session window, so fewer than ``per_day``
    signals may remain.
    """
    have = set(df.columns)
    if min_conf is not None and "conf" in have:
        df = df.filter(F.col("conf") >= min_conf)
    if per_day:
        df = top_k_per_day(df, per_day, keys=keys, tie=tie)
    if start and end:
        df = session_window(df, start, end, zone)
    if min_atr is not None and "atr" in have:
        df = df.filter(F.col("atr") >= min_atr)
    if max_spread is not None and "spread_bps" in have:
        df = df.filter(F.col("spread_bps") <= max_spread)
    if use_regime and "regime_ok" in have:
        df = df.filter("regime_ok")
    return df.withColumn("side", clip_side("side") if "side" in have else F.lit(0))


def normalise_side(df: DataFrame) -> DataFrame:
    """Fill ``side`` from score or signal when absent; limit to -1/0/1."""
    if "side" in df.columns:
        return df.withColumn("side", clip_side("side"))
    for c in ("score", "signal"):
        if c in df.columns:
            return df.withColumn("side", side_of(c))
    return df.withColumn("side", F.lit(0))


def quality_filter(df: DataFrame, min_signal: float = 0.3, min_volume: float = 1.2, max_vol: float = 0.04,
                   min_trend: float = 0.5, min_momentum: float = 0.001, min_efficiency: float = -0.8,
                   min_liquidity: float | None = None, signal: str = "signal") -> DataFrame:
    """Keep strong signals with enough volume, trend and momentum and bounded volatility.

    A missing column or value counts as its neutral default.
    """
    have = set(df.columns)
    val = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d)
    ok = (
        (F.abs(F.col(signal)) >= min_signal)
        & (val("volume_ratio", 1.0) > min_volume)
        & (val("realized_vol", 0.0) < max_vol)
        & (F.abs(val("trend_strength", 0.0)) > min_trend)
        & (F.abs(val("momentum_5", 0.0)) > min_momentum)
        & (val("price_efficiency", 0.0) > min_efficiency)
    )
    if min_liquidity is not None:
        ok = ok & (val("liquidity_score", 0.0) > min_liquidity)
    return df.filter(ok)


def mid_volatility(bars: DataFrame, lo: float = 0.3, hi: float = 0.7, volume_factor: float = 1.3) -> DataFrame:
    """Flags for volatility between two quantiles of the symbol and for raised volume."""
    df = blocked(bars, back=21).withColumn("_r", I.pct_change("close"))
    df = df.withColumns({"vol20": I.rolling("_r", 20, "std"), "_vm": I.rolling("volume", 20, "mean")})
    df = core(df.withColumn("volume_ok", F.coalesce(F.col("volume") > F.col("_vm") * volume_factor, F.lit(False))))
    q = quantile_columns(exact_quantiles(df, ["vol20"], [lo, hi]), {("vol20", lo): "_lo", ("vol20", hi): "_hi"})
    df = join_safe(df, q, ["symbol"])
    return df.withColumn("volatility_ok", F.coalesce(F.col("vol20").between(F.col("_lo"), F.col("_hi")), F.lit(False))).drop("_lo", "_hi")


def probability_gate(df: DataFrame, p: str = "p", threshold: float = 0.55) -> DataFrame:
    """Keep trades whose success probability is above the threshold; unknown passes."""
    return df.filter(F.coalesce(F.col(p), F.lit(1.0)) > threshold)


def top_k(df: DataFrame, k: int, group: Sequence[str], score: str = "score", tie: Sequence[str] = ()) -> DataFrame:
    """The k best rows per group; prunes with a per-partition limit before the shuffle."""
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), *tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_per_key(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str] = ()) -> DataFrame:
    """The row with the highest score per key, ties by the smallest ``tie`` columns."""
    rest = [c for c in df.columns if c not in keys]
    neg = [(-F.col(t)).alias(f"_{i}") for i, t in enumerate(tie)]
    order = F.struct(F.col(score), *neg) if tie else F.col(score)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_b")).select(*keys, "_b.*")


def last_rows(df: DataFrame, k: int = 1, keys: Sequence[str] = KEYS, order: str = "ts") -> DataFrame:
    """The k latest rows per key."""
    if k == 1:
        rest = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_b")).select(*keys, "_b.*")
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k).drop("_rk")


def report_order(df: DataFrame, by: str = "sharpe_ann") -> DataFrame:
    """Reports ordered by a metric, best first, missing values last."""
    return df.orderBy(F.col(by).desc_nulls_last(), *[c for c in ("symbol",) if c in df.columns])
