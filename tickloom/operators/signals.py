"""Trading directions from indicators and from model probabilities."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import clip, col, risk_notional, side_of
from tickloom.operators import indicators as I
from tickloom.operators.blocks import KEYS, blocked, core
from tickloom.operators.debounce import debounce
from tickloom.operators.ema import Ema, add_emas, ema_back, span
from tickloom.operators.order_stats import Rolling, add_order_stats
from tickloom.schema import require_columns
from tickloom.session import cut


# Default parameters of the rule signals.
@dataclass(frozen=True)
class Trend:
    fast: int = 12
    slow: int = 48
    atr_len: int = 14
    threshold: float = 2.5
    gap: int = 25


@dataclass(frozen=True)
class MeanReversion:
    rsi_len: int = 14
    rsi_low: float = 15.0
    rsi_high: float = 85.0
    bb_len: int = 20
    bb_k: float = 2.0
    gap: int = 15


@dataclass(frozen=True)
class Breakout:
    channel: int = 30
    confirm_bars: int = 1
    gap: int = 15


def _direction(up: Column, down: Column) -> Column:
    """1 / -1 / 0; comparisons with null count as false."""
    return F.when(up, 1).when(down, -1).otherwise(0)


def trend_raw(df: DataFrame, p: Trend = Trend(), out: str = "raw_dir", keys: Sequence[str] = KEYS) -> DataFrame:
    """Average spread in units of true range beyond the threshold, close on its side of the slow average."""
    df = df.withColumn("_tr", I.true_range(keys, "fill"))
    df = add_emas(df, [Ema("_f", "close", span(p.fast)), Ema("_s", "close", span(p.slow)), Ema("_a", "_tr", span(p.atr_len))], keys)
    strength = (F.col("_f") - F.col("_s")) / (F.col("_a") + 1e-9)
    c, s = F.col("close"), F.col("_s")
    return df.withColumn(
        out, _direction((strength > p.threshold) & (c > s), (strength < -p.threshold) & (c < s))
    )


def meanrev_raw(df: DataFrame, p: MeanReversion = MeanReversion(), out: str = "raw_dir", keys: Sequence[str] = KEYS) -> DataFrame:
    """Extreme relative strength together with a close outside the band."""
    df = I.add_rsi(df, p.rsi_len, "_rsi", keys)
    df = df.withColumns({"_m": I.rolling("close", p.bb_len, "mean", keys=keys), "_sd": I.rolling("close", p.bb_len, "std_pop", keys=keys)})
    c, r = F.col("close"), F.col("_rsi")
    long = (r < p.rsi_low) & (c <= F.col("_m") - p.bb_k * F.col("_sd"))
    short = (r > p.rsi_high) & (c >= F.col("_m") + p.bb_k * F.col("_sd"))
    return df.withColumn(out, _direction(long, short))


def breakout_raw(df: DataFrame, p: Breakout = Breakout(), out: str = "raw_dir", keys: Sequence[str] = KEYS) -> DataFrame:
    """Close beyond the prior channel, for ``confirm_bars`` bars in a row."""
    hi, lo = I.prior_channel(p.channel, keys)
    df = df.withColumn("_raw", _direction(F.col("close") > hi, F.col("close") < lo))
    value = F.col("_raw")
    for k in range(1, p.confirm_bars):
        value = F.when(I.lag("_raw", k, keys) == F.col("_raw"), value).otherwise(0)
    return df.withColumn(out, value)


TREND_BACK = lambda p: ema_back([span(p.fast), span(p.slow), span(p.atr_len)], 1)
MEANREV_BACK = lambda p: max(ema_back([1.0 / p.rsi_len], 1), p.bb_len)
BREAKOUT_BACK = lambda p: p.channel + p.confirm_bars


def trend_signal(bars: DataFrame, p: Trend = Trend(), out: str = "signal") -> DataFrame:
    require_columns(bars, ["symbol", "bar", "close", "high", "low"], "trend signal")
    raw = cut(core(trend_raw(blocked(bars, back=TREND_BACK(p)), p)))
    return debounce(raw, p.gap, out=out)


def meanrev_signal(bars: DataFrame, p: MeanReversion = MeanReversion(), out: str = "signal") -> DataFrame:
    require_columns(bars, ["symbol", "bar", "close"], "mean-reversion signal")
    raw = cut(core(meanrev_raw(blocked(bars, back=MEANREV_BACK(p)), p)))
    return debounce(raw, p.gap, out=out)


def breakout_signal(bars: DataFrame, p: Breakout = Breakout(), out: str = "signal") -> DataFrame:
    require_columns(bars, ["symbol", "bar", "close", "high", "low"], "breakout signal")
    raw = cut(core(breakout_raw(blocked(bars, back=BREAKOUT_BACK(p)), p)))
    return debounce(raw, p.gap, out=out)


def custom_signal(bars: DataFrame, direction: Column, gap: int = 0, out: str = "signal") -> DataFrame:
    """A user rule: any column expression over the bars, held for at least ``gap`` bars."""
    return debounce(bars.withColumn("raw_dir", side_of(direction)), gap, out=out)


def technical_vote(bars: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Weighted vote of RSI, MACD histogram, band position and volume-backed moves."""
    df = blocked(bars, back=max(ema_back([1 / 14]), ema_back([span(12), span(26)], ema_back([span(9)]))))
    df = I.add_macd_histogram(I.bollinger(I.add_rsi(df, 14, "_rsi"), 20, 2.0), out="_mh")
    df = df.withColumns({"_vr": F.try_divide(F.col("volume"), I.rolling("volume", 20, "mean")), "_chg": I.pct_change("close", 5)})
    # the relative strength of TA libraries needs a full window of bars first
    rsi = F.when(F.col("bar") >= 13, F.col("_rsi"))
    votes = {
        "v_rsi": F.when(rsi < 30, 1.0).when(rsi > 70, -1.0).otherwise(0.0),
        "v_macd": F.when(F.col("_mh") > 0, 1.0).otherwise(-1.0),
        "v_band": F.when(F.col("bb_pos") < 0.2, 1.0).when(F.col("bb_pos") > 0.8, -1.0).otherwise(0.0),
        "v_volume": F.when((F.col("_vr") > 1.5) & (F.col("_chg") > 0.01), 1.0)
        .when((F.col("_vr") > 1.5) & (F.col("_chg") < -0.01), -1.0).otherwise(0.0),
    }
    df = df.withColumns(votes)
    score = 0.3 * F.col("v_rsi") + 0.3 * F.col("v_macd") + 0.2 * F.col("v_band") + 0.2 * F.col("v_volume")
    # tenths add up inexactly; compare on a rounded value so that 0.3 is not above 0.3
    df = df.withColumn("score", F.round(score, 10))
    df = df.withColumn("signal", F.when(F.abs("score") > threshold, F.signum("score")).otherwise(0.0).cast("int"))
    return core(df).drop("bb_mid", "bb_up", "bb_dn")


def default_signals(bars: DataFrame, fast: int = 5, slow: int = 25, conf: float = 0.75) -> DataFrame:
    """Change events of the sign of a fast/slow average spread, with fixed confidence."""
    df = blocked(bars, back=ema_back([span(fast), span(slow)], 1))
    df = add_emas(df, [Ema("_f", "close", span(fast)), Ema("_s", "close", span(slow))])
    df = df.withColumn("side", F.signum(F.col("_f") - F.col("_s")).cast("int"))
    df = df.withColumn("_chg", F.col("side") != F.coalesce(I.lag("side"), F.lit(0)))
    return core(df.filter("_chg")).select("symbol", "ts", "bar", "side").withColumn("conf", F.lit(conf))


@dataclass(frozen=True)
class Risk:
    per_trade_risk: float = 0.001
    vol_lb: int = 48
    floor_stable: float = 0.55
    floor_volatile: float = 0.60
    max_gross: float = 1.0


def add_realized_vol(df: DataFrame, n: int = 48, out: str = "vol", keys: Sequence[str] = KEYS) -> DataFrame:
    """Deviation of one-bar returns over n bars; zero counts as missing. Warm-up rows are null."""
    df = df.withColumn("_rr", I.pct_change("close", 1, keys))
    return df.withColumn(out, F.nullif(I.rolling("_rr", n, "std", keys=keys), F.lit(0.0)))


def thresholds(th_long: float | None, th_short: float | None, default_long: float = 0.55) -> tuple[float, float]:
    """Asymmetric limits: long at least 0.55, short at most 0.40, at least 0.05 apart."""
    if th_long is None or th_short is None:
        lo, sh = default_long if th_long is None else th_long, 0.0
    else:
        lo, sh = th_long, th_short
    lo, sh = max(lo, 0.55), min(sh, 0.40)
    return (sh + 0.05 if lo <= sh + 0.05 else lo), sh


def probability_signal(bars: DataFrame, p: str = "p", th_long: float | None = None, th_short: float | None = None,
                       risk: Risk = Risk(), equity: float = 1_000_000.0, use_filters: bool = True,
                       short_confidence: bool = True) -> DataFrame:
    """Side and money size from probabilities.

    Adds ``vol``, ``floor`` (confidence limit by volatility state), ``side`` and
    ``size``.  ``short_confidence`` measures the confidence of a short as 1-p;
    without it a short can never pass the floor.
    """
    lo, sh = thresholds(th_long, th_short)
    back = max(200 + risk.vol_lb + 1, ema_back([span(20), span(60)]))
    df = add_realized_vol(blocked(bars, back=back), risk.vol_lb, "vol")
    if use_filters:
        df = add_emas(df, [Ema("_f", "close", span(20)), Ema("_s", "close", span(60))])
    # last of the steps over a block, so that all of them read one exchange
    df = add_order_stats(df, {"_med": Rolling("vol", 200, 0.5, 20), "_q20": Rolling("vol", 200, 0.2, 20)})
    floor = clip(F.when(F.col("vol") >= F.col("_med"), risk.floor_volatile).otherwise(risk.floor_stable), 0.5, 0.99)
    conf = F.when(F.col(p) <= sh, 1 - F.col(p)).otherwise(F.col(p)) if short_confidence else F.col(p)
    df = df.withColumn("floor", floor)
    ok = conf >= F.col("floor")
    side = F.when(ok & (F.col(p) >= lo), 1).when(ok & (F.col(p) <= sh), -1).otherwise(0)
    df = df.withColumn("side", side)
    keep = F.col("side") != 0
    if use_filters:
        trend = ((F.col("side") > 0) & (F.col("_f") > F.col("_s"))) | ((F.col("side") < 0) & (F.col("_f") < F.col("_s")))
        keep = keep & (F.col("vol") >= F.col("_q20")) & trend
    df = df.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    size = risk_notional("vol", p, equity, risk.per_trade_risk, risk.max_gross)
    df = df.withColumn("side", F.when(F.col("_keep"), F.col("side")).otherwise(0))
    df = df.withColumn("size", F.when(F.col("_keep"), F.coalesce(size, F.lit(0.0))).otherwise(0.0))
    return core(df)


def symmetric_side(p: Column | str, threshold: float = 0.55) -> Column:
    """+1 above the threshold, -1 below its mirror image."""
    return F.when(col(p) > threshold, 1).when(col(p) < 1 - threshold, -1).otherwise(0)


def momentum_entries(bars: DataFrame, vol_lb: int = 48, z_thr: float = 1.0, use_filters: bool = True) -> DataFrame:
    """Entry flags: return z-score, average trend with a rising fast average, enough volume."""
    df = blocked(bars, back=max(ema_back([span(20), span(60)], 1), 100, vol_lb + 1))
    df = df.withColumn("_r", F.coalesce(I.pct_change("close"), F.lit(0.0)))
    df = df.withColumns({"z": F.coalesce(I.zscore("_r", vol_lb, eps=None), F.lit(0.0)), "_v0": F.coalesce("volume", F.lit(0.0))})
    long, short = F.col("z") >= z_thr, F.col("z") <= -z_thr
    if use_filters:
        df = add_emas(df, [Ema("_f", "close", span(20)), Ema("_s", "close", span(60))])
        df = df.withColumn("_slope", F.col("_f") - I.lag("_f"))
        df = add_order_stats(df, {"_vq": Rolling("_v0", 100, 0.2)})
        vol_ok = F.coalesce(F.col("volume") >= F.col("_vq"), F.lit(False))
        long = long & (F.col("_f") > F.col("_s")) & (F.col("_slope") > 0) & vol_ok
        short = short & (F.col("_f") < F.col("_s")) & (F.col("_slope") < 0) & vol_ok
    df = df.withColumns({"enter_long": F.coalesce(long, F.lit(False)), "enter_short": F.coalesce(short, F.lit(False))})
    return core(df)


def route_by_regime(df: DataFrame, use_breakout: bool = False, out: str = "signal") -> DataFrame:
    """Trend signal in trends, mean reversion in ranges, breakout or nothing in high volatility."""
    hv = F.col("signal_breakout") if use_breakout else F.lit(0)
    pick = (F.when(F.col("regime") == "trend", F.col("signal_trend"))
            .when(F.col("regime") == "range", F.col("signal_meanrev"))
            .when(F.col("regime") == "high_vol", hv).otherwise(0))
    return df.withColumn(out, pick)
