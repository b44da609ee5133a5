"""Feature packs: many indicators in one pass over blocked bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import correlation, finite
from tickloom.operators import indicators as I
from tickloom.operators.blocks import block_window, blocked, core, join_safe, prefix
from tickloom.operators.ema import Ema, add_emas, ema_back, span
from tickloom.operators.quantiles import exact_quantiles, quantile_columns
from tickloom.session import cut

# Horizons of the basic pack and the column lists of the named sets.
WINDOWS = [3, 6, 12, 24, 48, 96]
CORE = ["ret_3", "ret_12", "ema_12", "ema_48", "atr_14", "vol_ema_24", "rsi_14"]
MOMENTUM_SHORT = ["ret_3", "ret_6", "ret_12"]
MOMENTUM_LONG = ["ret_24", "ret_48", "ret_96"]
TREND_FAST = ["ema_3", "ema_6", "ema_12"]
TREND_SLOW = ["ema_24", "ema_48", "ema_96"]
VOLATILITY = ["atr_3", "atr_6", "atr_12", "atr_24", "atr_48", "atr_96", "zscore_24"]
VOLUME = ["vol_ema_3", "vol_ema_6", "vol_ema_12", "vol_ema_24", "vol_ema_48", "vol_ema_96", "obv"]
OSCILLATORS = ["rsi_14", "macd", "stoch_k", "cci_20", "williams_r"]
PRICE_LEVELS = ["vwap"]

FEATURE_SETS = {
    "fs_core_momo_short_osc": CORE + MOMENTUM_SHORT + OSCILLATORS,
    "fs_core_momo_long_osc": CORE + MOMENTUM_LONG + OSCILLATORS,
    "fs_core_trend_fast_vol": CORE + TREND_FAST + VOLATILITY,
    "fs_core_trend_slow_vol": CORE + TREND_SLOW + VOLATILITY,
    "fs_core_vol_volume": CORE + VOLATILITY + VOLUME,
    "fs_core_momo_trend_mix": CORE + MOMENTUM_SHORT + TREND_SLOW,
    "fs_core_price_osc": CORE + OSCILLATORS + PRICE_LEVELS + ["zscore_24"],
    "fs_core_all_light": CORE + MOMENTUM_SHORT + TREND_SLOW[:2] + VOLATILITY[:3] + VOLUME[:3] + OSCILLATORS[:2]
    + PRICE_LEVELS,
}
FEATURE_SETS = {k: list(dict.fromkeys(v)) for k, v in FEATURE_SETS.items()}

BASIC = [f"{p}_{w}" for p in ("ret", "ema", "atr", "vol_ema") for w in WINDOWS] + ["rsi_14", "zscore_24"]
MOMENTUM = ["adx_14", "macd", "stoch_k", "cci_20", "williams_r", "obv", "vwap"]
MICRO = ["price_efficiency", "volume_anomaly", "volatility_regime", "liquidity_score", "momentum_5", "momentum_10",
         "trend_strength", "high_low_vol", "dev", "dev_mom", "atr", "realized_vol"]
LIGHT = ["price_efficiency", "volume_anomaly", "volatility_regime", "liquidity_score"]


def feature_set(name: str, available: Sequence[str]) -> tuple[list[str], list[str]]:
    """Columns of a named set that exist, and the names that do not."""
    if name not in FEATURE_SETS:
        raise ValueError(f"unknown feature set {name!r}; use one of {', '.join(FEATURE_SETS)}")
    have = set(available)
    cols = FEATURE_SETS[name]
    return [c for c in cols if c in have], [c for c in cols if c not in have]


def _zero_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.expr(f"CASE WHEN abs(`{c}`) < double('infinity') THEN `{c}` ELSE 0D END") for c in cols})


MACD = [Ema("_mf", "close", span(12), adjust=True), Ema("_ms", "close", span(26), adjust=True)]


def _basic(df: DataFrame, more: Sequence[Ema] = ()) -> DataFrame:
    """The 26 return/average/range/volume features on a blocked frame; ``more`` averages join the same pass."""
    c = F.col("close")
    df = I.rsi_inputs(df).withColumns(
        {
            "_gain": F.coalesce("_gain", F.lit(0.0)),
            "_loss": F.coalesce("_loss", F.lit(0.0)),
            "_hl": F.col("high") - F.col("low"),
            "_v": F.coalesce("volume", F.lit(0.0)),
            **{f"ret_{w}": I.pct_change("close", w) for w in WINDOWS},
            "zscore_24": I.zscore("close", 24),
        }
    )
    emas = [Ema("_up", "_gain", 1 / 14, 1), Ema("_dn", "_loss", 1 / 14, 1)]
    for w in WINDOWS:
        emas += [Ema(f"_ce{w}", "close", span(w)), Ema(f"_he{w}", "_hl", span(w)), Ema(f"vol_ema_{w}", "_v", span(w))]
    df = add_emas(df, [*emas, *more])
    out = {f"ema_{w}": F.try_divide(F.col(f"_ce{w}"), c) - 1 for w in WINDOWS}
    out |= {f"atr_{w}": F.try_divide(F.col(f"_he{w}"), c) for w in WINDOWS}
    out["rsi_14"] = I.rsi_of("_up", "_dn")
    return df.withColumns(out)


def _momentum(df: DataFrame) -> DataFrame:
    """The bounded-memory part of the momentum features on a blocked frame that has the ``MACD`` averages."""
    k, r = I.stochastic(14)
    df = I.add_cci(I.add_adx(df, 14, "adx_14"), 20, "cci_20")
    return df.withColumns({"stoch_k": k, "williams_r": r, "macd": F.col("_mf") - F.col("_ms"),
                           "prev_close": F.lag("close").over(block_window())})


BASIC_BACK = ema_back([span(w) for w in WINDOWS] + [1 / 14])
MOMENTUM_BACK = max(ema_back([span(12), span(26)]), 30)


def basic_pack(bars: DataFrame, fill: bool = True) -> DataFrame:
    """Returns, averages, ranges, volume averages, RSI and z-score (26 columns)."""
    out = core(_basic(blocked(bars, back=BASIC_BACK)))
    return _zero_fill(out, BASIC) if fill else out


def _cumulative(df: DataFrame) -> DataFrame:
    step = F.coalesce(F.signum(F.col("close") - F.col("prev_close")), F.lit(0.0)) * F.col("volume")
    df = prefix(df, {"obv": ("sum", step), "_pv": ("sum", F.col("close") * F.col("volume")), "_vv": ("sum", F.col("volume"))})
    return df.withColumn("vwap", F.coalesce(F.try_divide("_pv", "_vv"), F.col("close"))).drop("_pv", "_vv", "prev_close")


def momentum_pack(bars: DataFrame, fill: bool = True) -> DataFrame:
    """ADX, MACD, stochastic, CCI, Williams %R, on-balance volume and cumulative VWAP."""
    out = _cumulative(core(_momentum(add_emas(blocked(bars, back=MOMENTUM_BACK), MACD))))
    return _zero_fill(out, MOMENTUM) if fill else out


def full_pack(bars: DataFrame, fill: bool = True) -> DataFrame:
    """Basic and momentum features (33 columns) from one shuffle of the bars plus one prefix scan."""
    out = _cumulative(core(_momentum(_basic(blocked(bars, back=max(BASIC_BACK, MOMENTUM_BACK)), MACD))))
    return _zero_fill(out, BASIC + MOMENTUM) if fill else out


def _log_returns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"_r": F.coalesce(I.log_return(), F.lit(0.0)), "_ret": I.pct_change("close")}
    )


def micro_pack(bars: DataFrame, keep_nulls: bool = True) -> DataFrame:
    """The 12 microstructure features, warm-up rows null.

    The volatility ratio is taken against the symbol's mean volatility, which is
    one small aggregate joined back.
    """
    df = _log_returns(blocked(bars, back=64))
    df = I.add_atr(df, 14, "half", "atr")
    df = df.withColumns(
        {
            "_vw": I.vwap_rolling(15, 1),
            "_vol": F.coalesce(I.rolling("_r", 10, "std", 6), F.lit(0.01)),
            "realized_vol": F.coalesce(I.rolling("_ret", 60, "std", 10), F.lit(0.0)),
            "price_efficiency": I.price_efficiency("_r", 8, 4),
            "volume_anomaly": I.zscore("volume", 8, 4),
            "momentum_5": I.pct_change("close", 5),
            "momentum_10": I.pct_change("close", 10),
            "trend_strength": I.zscore("close", 20, 10),
            "high_low_vol": F.try_divide(I.rolling(F.col("high") - F.col("low"), 10, "mean", 6), F.col("close")),
        }
    )
    df = df.withColumn("dev", F.try_divide(F.col("close") - F.col("_vw"), F.col("_vw")))
    df = df.withColumns(
        {
            "dev_mom": F.col("dev") - I.lag("dev", 2),
            "liquidity_score": F.col("close") * F.col("volume") / (F.col("_vol") + 1e-9),
            "vol10": F.col("_vol"),
        }
    )
    df = core(df)
    mean_vol = df.groupBy("symbol").agg(F.avg("vol10").alias("_mv"))
    df = join_safe(df, mean_vol, ["symbol"]).withColumn("volatility_regime", F.col("vol10") / (F.col("_mv") + 1e-9)).drop("vol10", "_mv")
    return df.withColumns({c: finite(c) for c in MICRO})


def light_pack(bars: DataFrame) -> DataFrame:
    """Four features of the light model: efficiency, volume anomaly, volatility ratio, liquidity."""
    df = _log_returns(blocked(bars, back=16))
    df = df.withColumns(
        {
            "_vol": F.coalesce(I.rolling("_r", 10, "std", 5), F.lit(0.01)),
            "price_efficiency": F.coalesce(I.price_efficiency("_r", 10, 10), F.lit(0.5)),
            "volume_anomaly": F.coalesce(I.zscore("volume", 10, 5), F.lit(0.0)),
        }
    )
    df = core(df.withColumn("vol10", F.col("_vol")))
    mean_vol = df.groupBy("symbol").agg(F.avg("vol10").alias("_mv"))
    df = join_safe(df, mean_vol, ["symbol"])
    return df.withColumns(
        {
            "volatility_regime": F.col("vol10") / (F.col("_mv") + 1e-9),
            "liquidity_score": F.col("close") * F.col("volume") / (F.col("vol10") + 1e-9),
        }
    ).drop("vol10", "_mv")


def enrich_for_filters(bars: DataFrame) -> DataFrame:
    """Volume ratio, acceleration and the inputs of the entry quality filter."""
    df = _log_returns(blocked(bars, back=64))
    df = df.withColumns(
        {
            "volume_ratio": F.try_divide(F.col("volume"), I.rolling("volume", 20, "mean")),
            "realized_vol": I.rolling("_ret", 60, "std", 10),
            "trend_strength": I.zscore("close", 20, 10),
            "momentum_5": I.pct_change("close", 5),
            "price_efficiency": I.price_efficiency("_r", 8, 4),
        }
    )
    return core(df.withColumn("acceleration", F.col("momentum_5") - I.lag("momentum_5", 1)))


def winsorise(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Fill nulls with the median, then limit to the lo/hi quantiles, per symbol and column.

    Quantiles come from ``fit`` (default: the frame itself); pass the training
    part to keep later rows out of the statistics.
    """
    df = cut(df)
    src = df if fit is None else fit
    med = quantile_columns(exact_quantiles(src, cols, [0.5]), {(c, 0.5): f"_m_{c}" for c in cols})
    filled = join_safe(df, med, ["symbol"]).withColumns({c: F.coalesce(c, f"_m_{c}") for c in cols})
    filled_src = filled if fit is None else join_safe(fit, med, ["symbol"]).withColumns(
        {c: F.coalesce(c, f"_m_{c}") for c in cols}
    )
    q = exact_quantiles(filled_src, cols, [lo, hi])
    names = {(c, p): f"_{n}_{c}" for c in cols for p, n in ((lo, "lo"), (hi, "hi"))}
    out = join_safe(filled, quantile_columns(q, names), ["symbol"])
    out = out.withColumns(
        {
            c: F.when(F.col(f"_lo_{c}") < F.col(f"_hi_{c}"), F.least(F.greatest(c, f"_lo_{c}"), F.col(f"_hi_{c}")))
            .otherwise(F.col(c))
            for c in cols
        }
    )
    return out.drop(*[f"_{p}_{c}" for p in ("m", "lo", "hi") for c in cols])


def stationary(df: DataFrame, cols: Sequence[str], gain: float = 0.8) -> DataFrame:
    """Make columns stationary, decided per symbol and column.

    A first difference where it cuts the lag-1 autocorrelation by a fifth, then
    log1p where the minimum is positive; columns with at most two distinct values
    stay as they are.  The decision is one small row of flags per symbol, joined
    back, so the plan does not depend on the data.
    """
    w = block_window()
    d = blocked(df.select("symbol", "bar", *cols), back=2)
    d = d.withColumns({f"_p_{c}": F.lag(c).over(w) for c in cols})
    d = d.withColumns({f"_d_{c}": F.col(c) - F.col(f"_p_{c}") for c in cols})
    d = d.withColumns({f"_e_{c}": F.lag(f"_d_{c}").over(w) for c in cols}).filter("_core")
    ends = d.groupBy("symbol").agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("min", F.min), ("max", F.max))])
    d = join_safe(d, ends, ["symbol"])
    flags = []
    for c in cols:
        varied = F.count_if((F.col(c) != F.col(f"_min_{c}")) & (F.col(c) != F.col(f"_max_{c}"))) > 0
        diff = F.abs(correlation(f"_d_{c}", f"_e_{c}")) < F.abs(correlation(c, f"_p_{c}")) * gain
        diff = F.coalesce(varied & diff, F.lit(False))
        low = F.when(diff, F.min(f"_d_{c}")).otherwise(F.min(c))
        flags += [diff.alias(f"_diff_{c}"), F.coalesce(varied & (low > 0), F.lit(False)).alias(f"_log_{c}")]
    out = blocked(df, back=1).withColumns({f"_dd_{c}": F.col(c) - F.lag(c).over(w) for c in cols}).filter("_core")
    out = join_safe(out, d.groupBy("symbol").agg(*flags), ["symbol"])
    out = out.withColumns({c: F.when(F.col(f"_diff_{c}"), F.col(f"_dd_{c}")).otherwise(F.col(c)) for c in cols})
    out = out.withColumns({c: F.when(F.col(f"_log_{c}"), F.log1p(c)).otherwise(F.col(c)) for c in cols})
    return core(out)
