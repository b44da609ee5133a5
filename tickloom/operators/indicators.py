"""Rolling, exponential and cumulative indicators.

Functions that take a frame expect it to be ``blocked`` with enough rows before
each block (the ``*_BACK`` helpers) and leave working columns (leading underscore)
to ``core``; column helpers only build expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.scalars import col
from tickloom.operators.blocks import KEYS, block_window, prefix, trailing
from tickloom.operators.ema import Ema, add_emas, span

_AGG = {
    "mean": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "std_pop": F.stddev_pop,
}


def lag(c: Column | str, k: int = 1, keys: Sequence[str] = KEYS) -> Column:
    return F.lag(col(c), k).over(block_window(keys))


def lead(c: Column | str, k: int = 1, keys: Sequence[str] = KEYS) -> Column:
    return F.lead(col(c), k).over(block_window(keys))


def rolling(c: Column | str, n: int, how: str, min_rows: int | None = None, keys: Sequence[str] = KEYS,
            q: float | None = None) -> Column:
    """Trailing aggregate over ``n`` rows; null until ``min_rows`` (default n) values are there."""
    x, w = col(c), trailing(n, keys)
    need = n if min_rows is None else min_rows
    if how in ("quantile", "median"):
        return _window_quantile(x, w, 0.5 if how == "median" else q, need)
    return F.when(F.count(x).over(w) >= need, _AGG[how](x).over(w))


def _window_quantile(x: Column, w: WindowSpec, q: float, need: int) -> Column:
    """Interpolated quantile of a bounded frame.

    Sorting the frame's values is several times faster than ``percentile`` over it,
    which fills and sorts a hash map per row.
    """

    def interpolate(v: Column) -> Column:
        pos = (F.size(v) - 1) * F.lit(q)
        lo, hi = F.get(v, F.floor(pos).cast("int")), F.get(v, F.ceil(pos).cast("int"))
        return F.when(F.size(v) >= need, lo + (hi - lo) * (pos - F.floor(pos)))

    # the one-element array binds the sorted values, so they are sorted once
    return F.get(F.transform(F.array(F.sort_array(F.collect_list(x).over(w))), interpolate), 0)


def pct_change(c: Column | str, k: int = 1, keys: Sequence[str] = KEYS) -> Column:
    return F.try_divide(col(c), lag(c, k, keys)) - 1


def log_return(c: Column | str = "close", keys: Sequence[str] = KEYS) -> Column:
    return F.ln(col(c)) - F.ln(lag(c, 1, keys))


def zscore(c: Column | str, n: int, min_rows: int | None = None, eps: float | None = 1e-9,
           keys: Sequence[str] = KEYS) -> Column:
    """Distance from the trailing mean in sample deviations (``eps`` added, or null for none)."""
    sd = rolling(c, n, "std", min_rows, keys)
    diff = col(c) - rolling(c, n, "mean", min_rows, keys)
    return F.try_divide(diff, sd) if eps is None else diff / (sd + eps)


def true_range(keys: Sequence[str] = KEYS, first: str = "skip") -> Column:
    """Range including the gap to the previous close.

    First row: ``skip`` uses high-low alone, ``null`` gives none, ``fill`` takes
    the row's own close as the previous one.
    """
    h, l, p = F.col("high"), F.col("low"), lag("close", 1, keys)
    if first == "fill":
        p = F.coalesce(p, F.col("close"))
    tr = F.greatest(h - l, F.abs(h - p), F.abs(l - p))
    return F.when(p.isNotNull(), tr) if first == "null" else tr


def add_atr(df: DataFrame, n: int = 14, variant: str = "mean", out: str = "atr", keys: Sequence[str] = KEYS) -> DataFrame:
    """Average true range.

    ``mean1``  rolling mean from the first row; ``half`` from max(2, n/2) rows;
    ``mean``   full window; ``wilder`` alpha 1/n from the second row;
    ``span``   n-bar span from the first row.
    """
    if variant in ("wilder", "span"):
        wilder = variant == "wilder"
        df = df.withColumn("_tr", true_range(keys, "null" if wilder else "fill"))
        return add_emas(df, [Ema(out, "_tr", 1.0 / n if wilder else span(n), first=1 if wilder else 0)], keys)
    need = {"mean1": 1, "half": max(2, n // 2), "mean": n}[variant]
    df = df.withColumn("_tr", true_range(keys))
    return df.withColumn(out, rolling("_tr", n, "mean", need, keys))


def rsi_inputs(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    d = F.col("close") - lag("close", 1, keys)
    return df.withColumns({"_gain": F.greatest(d, F.lit(0.0)), "_loss": F.greatest(-d, F.lit(0.0))})


def rsi_of(up: Column | str, dn: Column | str) -> Column:
    return 100.0 - 100.0 / (1.0 + col(up) / (col(dn) + 1e-9))


def add_rsi(df: DataFrame, n: int = 14, out: str = "rsi", keys: Sequence[str] = KEYS) -> DataFrame:
    """Relative strength with Wilder smoothing (null in the first row)."""
    df = rsi_inputs(df, keys).withColumns(
        # the first difference is undefined; the averages start with the second row
        {"_gain": F.greatest(F.coalesce("_gain", F.lit(0.0)), F.lit(0.0)), "_loss": F.coalesce("_loss", F.lit(0.0))}
    )
    df = add_emas(df, [Ema("_up", "_gain", 1.0 / n, 1), Ema("_dn", "_loss", 1.0 / n, 1)], keys)
    return df.withColumn(out, rsi_of("_up", "_dn"))


def rsi_simple(df: DataFrame, n: int = 14, out: str = "rsi", keys: Sequence[str] = KEYS) -> DataFrame:
    """Relative strength from plain rolling means; 100 without losses, null without any move."""
    d = F.coalesce(F.col("close") - lag("close", 1, keys), F.lit(0.0))
    df = df.withColumn("_d", d)
    g = rolling(F.greatest("_d", F.lit(0.0)), n, "mean", keys=keys)
    l = rolling(F.greatest(-F.col("_d"), F.lit(0.0)), n, "mean", keys=keys)
    df = df.withColumn("_g", g).withColumn("_l", l)
    value = F.when(F.col("_l") > 0, 100.0 - 100.0 / (1.0 + F.col("_g") / F.col("_l"))).when(F.col("_g") > 0, 100.0)
    return df.withColumn(out, value)


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Middle, upper and lower band (population deviation) and the position between them."""
    df = df.withColumns({"bb_mid": rolling("close", n, "mean", keys=keys), "_sd": rolling("close", n, "std_pop", keys=keys)})
    df = df.withColumns({"bb_up": F.col("bb_mid") + k * F.col("_sd"), "bb_dn": F.col("bb_mid") - k * F.col("_sd")})
    pos = F.try_divide(F.col("close") - F.col("bb_dn"), F.col("bb_up") - F.col("bb_dn"))
    return df.withColumn("bb_pos", pos)


def prior_channel(n: int = 30, keys: Sequence[str] = KEYS) -> tuple[Column, Column]:
    """Highest high and lowest low of the n bars before this one, full windows only."""
    w = block_window(keys).rowsBetween(-n, -1)
    full = F.count("high").over(w) >= n
    return F.when(full, F.max("high").over(w)), F.when(full, F.min("low").over(w))


def add_adx(df: DataFrame, n: int = 14, out: str = "adx", keys: Sequence[str] = KEYS) -> DataFrame:
    """Directional index: rolling means of range and directional moves, then of their spread."""
    up = F.col("high") - lag("high", 1, keys)
    dn = lag("low", 1, keys) - F.col("low")
    df = df.withColumns(
        {
            "_tr": true_range(keys),
            "_pdm": F.when((up > dn) & (up > 0), up).otherwise(0.0),
            "_mdm": F.when((dn > up) & (dn > 0), dn).otherwise(0.0),
        }
    )
    df = df.withColumns({f"_a{c}": rolling(c, n, "mean", keys=keys) for c in ("_tr", "_pdm", "_mdm")})
    df = df.withColumns(
        {"_pdi": 100.0 * F.try_divide(F.col("_a_pdm"), F.col("_a_tr")), "_mdi": 100.0 * F.try_divide(F.col("_a_mdm"), F.col("_a_tr"))}
    )
    df = df.withColumn("_dx", 100.0 * F.abs(F.col("_pdi") - F.col("_mdi")) / (F.col("_pdi") + F.col("_mdi") + 1e-9))
    return df.withColumn(out, rolling("_dx", n, "mean", keys=keys))


def add_macd(df: DataFrame, fast: int = 12, slow: int = 26, out: str = "macd", adjust: bool = True,
             keys: Sequence[str] = KEYS) -> DataFrame:
    df = add_emas(df, [Ema("_mf", "close", span(fast), adjust=adjust), Ema("_ms", "close", span(slow), adjust=adjust)], keys)
    return df.withColumn(out, F.col("_mf") - F.col("_ms"))


def add_macd_histogram(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, out: str = "macd_hist",
                       keys: Sequence[str] = KEYS) -> DataFrame:
    """MACD minus its own average, with values once both windows are full.

    As in common TA libraries the line starts at bar ``slow-1`` and the signal
    average is seeded there.
    """
    df = add_macd(df, fast, slow, "_line", adjust=False, keys=keys)
    df = add_emas(df, [Ema("_sig", "_line", span(signal), first=slow - 1)], keys)
    ok = F.col("bar") >= slow + signal - 2
    return df.withColumn(out, F.when(ok, F.col("_line") - F.col("_sig")))


def stochastic(n: int = 14, keys: Sequence[str] = KEYS) -> tuple[Column, Column]:
    """Stochastic %K and Williams %R over n bars."""
    lo, hi = rolling("low", n, "min", keys=keys), rolling("high", n, "max", keys=keys)
    rng = hi - lo + 1e-9
    return 100.0 * (F.col("close") - lo) / rng, -100.0 * (hi - F.col("close")) / rng


def add_cci(df: DataFrame, n: int = 20, out: str = "cci", keys: Sequence[str] = KEYS) -> DataFrame:
    """Commodity channel index; the mean deviation is taken around each window's own mean."""
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3.0)
    df = df.withColumns({"_m": rolling("_tp", n, "mean", keys=keys), "_win": F.collect_list("_tp").over(trailing(n, keys))})
    mad = F.aggregate("_win", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_m"))) / n
    return df.withColumn(out, (F.col("_tp") - F.col("_m")) / (0.015 * mad + 1e-9))


def price_efficiency(r: Column | str, n: int = 8, min_rows: int = 4, keys: Sequence[str] = KEYS) -> Column:
    """Net move over path length of returns ``r``."""
    return rolling(r, n, "sum", min_rows, keys) / (rolling(F.abs(col(r)), n, "sum", min_rows, keys) + 1e-9)


def vwap_rolling(n: int = 15, min_rows: int = 1, keys: Sequence[str] = KEYS) -> Column:
    pv = rolling(F.col("close") * F.col("volume"), n, "sum", min_rows, keys)
    return F.try_divide(pv, rolling("volume", n, "sum", min_rows, keys))


def bias_corrected_moments(c: Column | str, n: int, keys: Sequence[str] = KEYS) -> tuple[Column, Column]:
    """Rolling skewness and excess kurtosis with sample corrections, from power sums of one window."""
    x, w = col(c), trailing(n, keys)
    full = F.count(x).over(w) >= n
    skew = F.skewness(x).over(w) * ((n * (n - 1)) ** 0.5 / (n - 2))
    kurt = ((n + 1) * F.kurtosis(x).over(w) + 6.0) * ((n - 1) / ((n - 2) * (n - 3)))
    return F.when(full, skew), F.when(full, kurt)


def on_balance_volume(df: DataFrame, out: str = "obv", prev: str = "_prev_close", keys: Sequence[str] = KEYS) -> DataFrame:
    """Running volume signed by the direction of the close; ``prev`` holds the previous close."""
    step = F.coalesce(F.signum(F.col("close") - F.col(prev)), F.lit(0.0)) * F.col("volume")
    return prefix(df, {out: ("sum", step)}, keys=keys)


def vwap_cumulative(df: DataFrame, out: str = "vwap", keys: Sequence[str] = KEYS) -> DataFrame:
    """Volume-weighted close since the first bar; the close itself while there is no volume."""
    df = prefix(df, {"_pv": ("sum", F.col("close") * F.col("volume")), "_v": ("sum", F.col("volume"))}, keys=keys)
    return df.withColumn(out, F.coalesce(F.try_divide("_pv", "_v"), F.col("close"))).drop("_pv", "_v")


def majority(c: str, n: int = 5, keys: Sequence[str] = KEYS) -> Column:
    """Most frequent of the last n labels; ties go to the most recent of the tied labels."""
    labels = [F.col(c)] + [lag(c, k, keys) for k in range(1, n)]
    window = F.array_compact(F.array(*labels))
    scored = F.transform(
        window,
        lambda x, i: F.struct(F.size(F.filter(window, lambda y: y == x)).alias("n"), (-i).alias("age"), x.alias("v")),
    )
    return F.array_max(scored)["v"]
