"""Market regime labels and their shares."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import clip, cut_bins
from tickloom.operators import indicators as I
from tickloom.operators.blocks import KEYS, blocked, core, join_safe
from tickloom.operators.ema import Ema, add_emas, ema_back, span
from tickloom.operators.order_stats import Rolling, add_order_stats
from tickloom.operators.quantiles import exact_quantiles, quantile_columns
from tickloom.schema import require_columns


@dataclass(frozen=True)
class RegimeParams:
    high_vol_quantile: float = 0.98
    trend_threshold: float = 2.5
    atr_len: int = 14
    fast: int = 12
    slow: int = 48
    look_back: int = 100


# Threshold and position multiplier of the four dynamic regimes.
REGIME_PARAMS = {"TRENDING": (0.52, 1.2), "VOLATILE": (0.55, 0.5), "RANGING": (0.53, 0.8), "BREAKOUT": (0.51, 1.0)}
REGIME_NAMES = ["trend", "range", "high_vol"]


def regime_raw(df: DataFrame, p: RegimeParams = RegimeParams(), out: str = "regime", keys: Sequence[str] = KEYS) -> DataFrame:
    """high_vol / trend / range on a blocked frame; warm-up rows are range."""
    rng = I.rolling("high", p.atr_len, "max", keys=keys) - I.rolling("low", p.atr_len, "min", keys=keys)
    df = df.withColumn("_rng", rng).withColumn("_pct", F.col("_rng") / (F.col("close") + 1e-8))
    df = df.withColumn("_thr0", I.rolling("_pct", p.look_back, "quantile", q=p.high_vol_quantile, keys=keys))
    df = df.withColumn("_thr", I.lag("_thr0", 1, keys))
    df = add_emas(df, [Ema("_f", "close", span(p.fast)), Ema("_s", "close", span(p.slow))], keys)
    strength = F.abs(F.col("_f") - F.col("_s")) / (F.col("_rng") + 1e-8)
    label = F.when(F.col("_pct") > F.col("_thr"), "high_vol").when(strength > p.trend_threshold, "trend").otherwise("range")
    return df.withColumn(out, label)


def regime_back(p: RegimeParams = RegimeParams()) -> int:
    return max(p.atr_len + p.look_back + 1, ema_back([span(p.fast), span(p.slow)]))


def detect_regime(bars: DataFrame, p: RegimeParams = RegimeParams()) -> DataFrame:
    require_columns(bars, ["symbol", "bar", "high", "low", "close"], "regimes")
    return core(regime_raw(blocked(bars, back=regime_back(p)), p))


def regime_shares(df: DataFrame, regime: str = "regime", keys: Sequence[str] = KEYS) -> DataFrame:
    """Percent of bars per regime, two decimals; every name appears."""
    return df.groupBy(*keys).agg(
        *[F.round(F.avg((F.col(regime) == n).cast("double")) * 100, 2).alias(n) for n in REGIME_NAMES]
    )


def dynamic_regime(bars: DataFrame, mode: str = "full", window: int = 500, smooth: int = 5) -> DataFrame:
    """RANGING / TRENDING / VOLATILE / BREAKOUT with majority smoothing.

    ``full`` compares with quantiles of the whole series (they look ahead),
    ``trailing`` with quantiles of the last ``window`` bars.
    """
    df = blocked(bars, back=30 + smooth + (window if mode == "trailing" else 0))
    c = F.col("close")
    df = df.withColumns(
        {
            "_ts": F.try_divide(F.abs(I.rolling("close", 10, "mean") - I.rolling("close", 30, "mean")), c),
            "_vl": F.try_divide(I.rolling(F.col("high") - F.col("low"), 14, "mean"), c),
            "_vz": I.zscore("volume", 20, eps=None),
            "_rg": F.try_divide(F.col("high") - F.col("low"), c),
        }
    )
    if mode == "trailing":
        lim = {n: Rolling(x, window, q, 30) for n, x, q in (("_qt", "_ts", 0.7), ("_qv", "_vl", 0.8), ("_qr", "_rg", 0.7))}
        df = add_order_stats(df, lim)
    else:
        stats = df.filter("_core")
        q = exact_quantiles(stats, ["_ts", "_vl", "_rg"], [0.7, 0.8])
        names = {("_ts", 0.7): "_qt", ("_vl", 0.8): "_qv", ("_rg", 0.7): "_qr"}
        df = join_safe(df, quantile_columns(q, names), ["symbol"])
    strong = F.coalesce(F.col("_ts") > F.col("_qt"), F.lit(False))
    volatile = F.coalesce(F.col("_vl") > F.col("_qv"), F.lit(False))
    busy = F.coalesce(F.col("_vz") > 1.0, F.lit(False))
    wide = F.coalesce(F.col("_rg") > F.col("_qr"), F.lit(False))
    raw = F.when(strong & busy & wide, "BREAKOUT").when(volatile, "VOLATILE").when(strong, "TRENDING").otherwise("RANGING")
    df = df.withColumn("regime_raw", raw)
    return core(df.withColumn("regime", I.majority("regime_raw", smooth)))


def regime_setting(regime: Column, index: int) -> Column:
    out = None
    for name, values in REGIME_PARAMS.items():
        cond = regime == name
        out = F.when(cond, values[index]) if out is None else out.when(cond, values[index])
    return out.otherwise(REGIME_PARAMS["RANGING"][index])


def dynamic_strategy(df: DataFrame, p: str = "p", regime: str = "regime", notional: float = 10_000.0) -> DataFrame:
    """Side and size from a probability with the threshold and multiplier of the regime."""
    df = df.withColumns({"th": regime_setting(F.col(regime), 0), "mult": regime_setting(F.col(regime), 1)})
    side = F.when(F.col(p) > F.col("th"), 1).when(F.col(p) < 1 - F.col("th"), -1).otherwise(0)
    return df.withColumn("side", side).withColumn("size", F.abs("side") * F.lit(notional) * F.col("mult"))


def atr_regime(bars: DataFrame, n: int = 14, edges: Sequence[float] = (0.005, 0.015)) -> DataFrame:
    """Volatility class 0/1/2 from ATR over close, and a confidence around the symbol's mean."""
    df = core(I.add_atr(blocked(bars, back=n + 1), n, "half", "atr").withColumn("atr_pct", F.try_divide("atr", "close")))
    stats = df.groupBy("symbol").agg(F.avg("atr_pct").alias("_m"), F.stddev_pop("atr_pct").alias("_sd"))
    df = join_safe(df, stats, ["symbol"])
    conf = 1.0 - clip(F.try_divide(F.abs(F.col("atr_pct") - F.col("_m")), F.col("_sd")), 0.0, 1.0)
    return df.withColumns({"regime": cut_bins("atr_pct", [0.0, *edges, 1.0], [0, 1, 2], 1), "conf": conf}).drop("_m", "_sd")


def volatility_regime(bars: DataFrame, n: int = 20, min_rows: int = 10, edges: Sequence[float] = (0.004, 0.012),
                      include_lowest: bool = True, out: str = "regime") -> DataFrame:
    """Volatility class 0/1/2 from the deviation of returns (0.01 while too few rows)."""
    df = blocked(bars, back=n + 1).withColumn("_r", I.pct_change("close"))
    df = df.withColumn("_v", F.coalesce(I.rolling("_r", n, "std", min_rows), F.lit(0.01)))
    return core(df.withColumn(out, cut_bins("_v", [0.0, *edges, 1.0], [0, 1, 2], 1, include_lowest)))
