"""Equity, profit and exposure metrics; ranking quality of predictions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import correlation, finite, safe_divide
from tickloom.operators import indicators as I
from tickloom.operators.blocks import KEYS, blocked, core, join_safe, prefix
from tickloom.operators.episodes import streaks
from tickloom.operators.quantiles import exact_quantiles, quantile_columns, value_slices
from tickloom.schema import require_columns
from tickloom.session import cut

EPS = 1e-12


def add_drawdown(df: DataFrame, equity: str = "equity", keys: Sequence[str] = KEYS) -> DataFrame:
    """Running ``peak`` and ``drawdown`` (0 or negative)."""
    df = prefix(df, {"peak": ("max", F.col(equity))}, keys=keys)
    return df.withColumn("drawdown", F.try_divide(equity, "peak") - 1.0)


def _path(df: DataFrame, equity: str, keys: Sequence[str], have: bool) -> DataFrame:
    d = blocked(df if have else add_drawdown(df, equity, keys), back=1)
    ret = F.coalesce(finite(F.try_divide(F.col(equity), I.lag(equity, 1, keys)) - 1.0), F.lit(0.0))
    return core(d.withColumn("ret", ret))


def equity_metrics(df: DataFrame, periods: float = 252.0, equity: str = "equity", keys: Sequence[str] = KEYS,
                   has_drawdown: bool = False) -> DataFrame:
    """Return, drawdown, Calmar, annualised volatility and Sharpe, bars, final equity.

    Undefined ratios are null (never infinite); fewer than two bars give zeros and nulls.
    """
    d = _path(df.filter(F.col(equity).isNotNull()), equity, keys, has_drawdown)
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"), F.min_by(equity, "bar").alias("_a"), F.max_by(equity, "bar").alias("final_equity"),
        F.min("drawdown").alias("_dd"), F.stddev_samp("ret").alias("_sd"), F.avg("ret").alias("_mu"),
    )
    a, z, two = F.col("_a"), F.col("final_equity"), F.col("bars") >= 2
    tr = F.when(F.abs(a) > EPS, z / a - 1.0).otherwise((z - a) / F.greatest(F.abs(a), F.abs(z), F.lit(1.0)))
    dd = F.when(two, F.col("_dd")).otherwise(0.0)
    calmar = F.when(dd < -EPS, tr / F.abs(dd)).when(tr > 0, None).otherwise(0.0)
    root = math.sqrt(periods)
    sharpe = F.when(F.col("_sd") > EPS, F.col("_mu") / F.col("_sd") * root).otherwise(0.0)
    return g.select(
        *keys, F.when(two, tr).otherwise(0.0).alias("total_return"), dd.alias("max_drawdown"),
        F.when(two, calmar).alias("calmar"), F.when(two, F.col("_sd") * root).alias("volatility_ann"),
        F.when(two, sharpe).alias("sharpe_ann"), "bars", "final_equity",
    )


def equity_metrics_variant(df: DataFrame, variant: str, equity: str = "equity", keys: Sequence[str] = KEYS) -> DataFrame:
    """Older conventions: ``clipped`` (equity floored at 0, Calmar null without losses but gains)
    and ``positive`` (drawdown as a positive share, share of bars with a gain)."""
    if variant == "clipped":
        d = add_drawdown(df.withColumn("_eq", F.greatest(F.col(equity), F.lit(0.0))), "_eq", keys)
        g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("bars"), F.min_by("_eq", "bar").alias("_a"),
                                 F.max_by("_eq", "bar").alias("final_equity"), F.min("drawdown").alias("max_drawdown"))
        tr = F.try_divide(F.col("final_equity"), F.col("_a")) - 1.0
        dd = F.col("max_drawdown")
        return g.select(*keys, "bars", "final_equity", tr.alias("total_return"), "max_drawdown",
                        F.when(dd < 0, tr / F.abs(dd)).when(tr > 0, None).otherwise(0.0).alias("calmar"))
    if variant == "positive":
        d = _path(df, equity, keys, False)
        return d.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("bars"), (F.try_divide(F.max_by(equity, "bar"), F.min_by(equity, "bar")) - 1.0).alias("total_return"),
            F.max(-F.col("drawdown")).alias("max_drawdown"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"),
            F.max_by(equity, "bar").alias("final_equity"),
        )
    raise ValueError(f"unknown variant {variant!r}")


def rule_metrics(path: DataFrame, trades: DataFrame, pnl: str = "pnl_abs", periods: float = 252.0, equity: str = "equity",
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """Equity and trade metrics of a rule in one row per key: per-bar volatility and Sharpe times the root of ``periods``,
    Calmar 0 without a drawdown, population deviation of the trade profits, zeros without trades.  ``path`` is a ledger."""
    d = _path(path.filter(F.col(equity).isNotNull()), equity, keys, True)
    a, z, dd, sd = F.min_by(equity, "bar"), F.max_by(equity, "bar"), F.min("drawdown"), F.coalesce(F.stddev_samp("ret"), F.lit(0.0))
    tr = F.when(a > 0, z / a - 1.0).otherwise(0.0)
    root = math.sqrt(periods)
    e = d.groupBy(*keys).agg(
        tr.alias("total_return"), F.least(dd, F.lit(0.0)).alias("max_drawdown"), F.when(dd < -EPS, tr / F.abs(dd)).otherwise(0.0).alias("calmar"),
        (sd * root).alias("volatility_ann"), F.when(sd > 0, F.avg("ret") / sd * root).otherwise(0.0).alias("sharpe_ann"))
    t = pnl_metrics(trades, pnl, keys, ddof=0).select(
        *keys, F.col("trades").alias("trade_count"), "win_rate", F.col("pnl_mean").alias("avg_trade"), "pnl_sum", "pnl_mean", "pnl_std")
    numbers = [c for c in t.columns if c not in keys]
    return join_safe(e, t, keys).na.fill(0, numbers)


def pnl_metrics(df: DataFrame, pnl: str = "pnl", keys: Sequence[str] = KEYS, ddof: int = 1) -> DataFrame:
    """Sum, mean, deviation, trades, wins, losses, ties and win rate of trade profits."""
    x = finite(pnl)
    sd = F.stddev_samp(x) if ddof == 1 else F.stddev_pop(x)
    return df.groupBy(*keys).agg(
        F.coalesce(F.sum(x), F.lit(0.0)).alias("pnl_sum"), F.coalesce(F.avg(x), F.lit(0.0)).alias("pnl_mean"),
        F.coalesce(sd, F.lit(0.0)).alias("pnl_std"), F.count(x).alias("trades"), F.count_if(x > 0).alias("wins"),
        F.count_if(x < 0).alias("losses"), F.count_if(x == 0).alias("ties"), F.avg((x > 0).cast("double")).alias("win_rate"),
    )


def trade_performance(df: DataFrame, pnl: str = "pnl", keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.avg((F.col(pnl) > 0).cast("double")).alias("win_rate"),
        F.avg(pnl).alias("avg_pnl"), F.sum(pnl).alias("total_pnl"),
    )


def exposure(df: DataFrame, side: str = "side", keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of bars in the market, long and short."""
    s = F.col(side)
    share = lambda c: F.avg(c.cast("double"))
    return df.groupBy(*keys).agg(share(s != 0).alias("exposure_total"), share(s > 0).alias("exposure_long"),
                                 share(s < 0).alias("exposure_short"))


def distribution(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Count, min, quartiles and max of columns, long form."""
    q = exact_quantiles(df, cols, [0.0, 0.25, 0.5, 0.75, 1.0], keys)
    v = lambda p: F.max(F.when(F.col("q") == p, F.col("value")))
    wide = q.groupBy(*keys, "feature").agg(v(0.0).alias("min_x"), v(0.25).alias("p25"), v(0.5).alias("median_x"),
                                           v(0.75).alias("p75"), v(1.0).alias("max_x"))
    n = df.select(*keys, *cols).groupBy(*keys).agg(*[F.count(c).alias(c) for c in cols]).unpivot(
        list(keys), list(cols), "feature", "n")
    return join_safe(n, wide, [*keys, "feature"])


def moments(x: Column) -> tuple[Column, Column]:
    """Skewness and excess kurtosis about the sample deviation; 0 without variation."""
    n = F.count(x)
    f = F.try_divide(n - 1, n)
    ok = F.coalesce(F.stddev_samp(x) > 0, F.lit(False))
    return (F.when(ok, F.skewness(x) * F.pow(f, 1.5)).otherwise(0.0),
            F.when(ok, (F.kurtosis(x) + 3.0) * F.pow(f, 2) - 3.0).otherwise(0.0))


def core_pack(led: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One aggregate over a ledger: return, drawdown, trades, turnover, profit factor, proxies, exposure.

    Everything the sweep score needs; no second pass over the bars.
    """
    require_columns(led, [*keys, "bar", "side", "pnl", "equity", "drawdown", "traded", "turnover", "cost"], "metrics")
    x, s = F.col("pnl"), F.col("side")
    gain, loss = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)), F.coalesce(F.sum(F.when(x < 0, x)), F.lit(0.0))
    dn = F.coalesce(F.sqrt(F.avg(F.when(x < 0, x * x))), F.lit(0.0))
    skew, kurt = moments(x)
    share = lambda c: F.avg(c.cast("double"))
    g = led.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"), F.max_by("equity", "bar").alias("final_equity"), F.min_by("equity", "bar").alias("_a"),
        F.min("drawdown").alias("max_drawdown"), F.count_if(F.col("traded") != 0).alias("trade_count"),
        F.sum("turnover").alias("turnover"), F.sum("cost").alias("commission_paid"), gain.alias("gross_profit"),
        loss.alias("gross_loss"), F.sum("pnl").alias("_sum"), F.avg(x).alias("_mu"), F.stddev_samp(x).alias("_sd"), dn.alias("_dn"),
        F.coalesce(F.avg(F.when(x != 0, x)), F.lit(0.0)).alias("avg_trade"),
        F.coalesce(F.avg(F.when(x != 0, (x > 0).cast("double"))), F.lit(0.0)).alias("hit_rate"),
        F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(x < 0, x)), F.lit(0.0)).alias("avg_loss"),
        skew.alias("skewness"), kurt.alias("kurtosis"), share(s != 0).alias("exposure_total"),
        share(s > 0).alias("exposure_long"), share(s < 0).alias("exposure_short"),
    )
    g = g.withColumn("total_return", F.when(F.col("bars") > 1, F.try_divide("final_equity", "_a") - 1.0).otherwise(0.0))
    tr, dd = F.col("total_return"), F.col("max_drawdown")
    g = g.withColumns(
        {
            "calmar_proxy": F.when(dd < 0, tr / F.abs(dd)).when(tr > 0, None).otherwise(0.0),
            "profit_factor": F.when(F.col("gross_loss") < 0, F.col("gross_profit") / F.abs("gross_loss"))
            .when(F.col("gross_profit") > 0, None).otherwise(0.0),
            "profit_per_trade": safe_divide("_sum", F.col("trade_count").cast("double"), 0.0),
            "profit_per_bar": F.col("_sum") / F.col("bars"),
            "sharpe_proxy": safe_divide("_mu", "_sd", 0.0),
            "sortino_proxy": safe_divide("_mu", "_dn", 0.0),
        }
    )
    return g.drop("_a", "_sum", "_mu", "_sd", "_dn")


def extended_pack(led: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``core_pack`` plus holding lengths, win/loss streaks and the median trade."""
    keys = list(keys)
    led = cut(led.select(*keys, "bar", "side", "pnl", "equity", "drawdown", "traded", "turnover", "cost"))
    base = core_pack(led, keys)
    hold = streaks(led, F.col("side") != 0, keys, "hold_bars")
    # trades in order: the non-zero profits, numbered densely by a running count
    nz = prefix(led.select(*keys, "bar", "pnl"), {"_n": ("sum", (F.col("pnl") != 0).cast("long"))}, keys=keys)
    nz = cut(nz.filter(F.col("pnl") != 0).select(*keys, (F.col("_n") - 1).alias("bar"), "pnl"))
    wins = streaks(nz, F.col("pnl") > 0, keys, "win_streak").drop("avg_win_streak")
    losses = streaks(nz, F.col("pnl") < 0, keys, "loss_streak").drop("avg_loss_streak")
    med = quantile_columns(exact_quantiles(nz, ["pnl"], [0.5], keys), {("pnl", 0.5): "median_trade"}, keys)
    out = base
    for part in (hold, wins, losses, med):
        out = join_safe(out, part, keys)
    return out.na.fill(0)


def auc(df: DataFrame, score: str = "p", label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Exact rank AUC with half credit for ties.

    Counts per distinct score (map-side combined), then a two-level running count of
    the negatives: over slices of the score, and inside each slice.
    """
    keys = list(keys)
    d = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    pos, neg = F.col(label) > 0.5, F.col(label) <= 0.5
    d = d.groupBy(*keys, F.col(score).alias("_x")).agg(F.count_if(pos).alias("_p"), F.count_if(neg).alias("_q"))
    group = [*keys, "_g"]
    d = value_slices(d.withColumn("_g", F.lit(0)), group, "_x")
    tot = d.groupBy(*group, "_s").agg(F.sum("_q").alias("_bq"))
    before = Window.partitionBy(*group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("_base", F.coalesce(F.sum("_bq").over(before), F.lit(0))).drop("_bq")
    inner = Window.partitionBy(*group, "_s").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    d = join_safe(d.withColumn("_in", F.coalesce(F.sum("_q").over(inner), F.lit(0))), tot, [*group, "_s"])
    below = F.col("_base") + F.col("_in")
    g = d.groupBy(*keys).agg(
        F.sum(F.col("_p") * (below + F.col("_q") / 2)).alias("_u"), F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg")
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return g.select(*keys, "n_pos", "n_neg", safe_divide("_u", pairs, 0.5).alias("auc"))


def f1_by_threshold(df: DataFrame, p: str = "p", label: str = "label", thresholds: Sequence[float] | None = None,
                    keys: Sequence[str] = KEYS) -> DataFrame:
    """F1 of ``p >= t`` for each threshold: one row per key and threshold, from one aggregate."""
    ts = list(thresholds or [round(0.45 + 0.02 * i, 2) for i in range(15)])
    y = F.col(label) > 0.5
    aggs = [F.count_if(y).alias("pos")]
    for i, t in enumerate(ts):
        aggs += [F.count_if(F.col(p) >= t).alias(f"n{i}"), F.count_if((F.col(p) >= t) & y).alias(f"t{i}")]
    g = df.filter(F.col(p).isNotNull() & F.col(label).isNotNull()).groupBy(*keys).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n"), F.col(f"t{i}").alias("tp"))
                     for i, t in enumerate(ts)])
    g = g.select(*keys, "pos", F.explode(rows).alias("r"))
    return g.select(*keys, "r.threshold",
                    safe_divide(2.0 * F.col("r.tp"), (F.col("r.n") + F.col("pos")).cast("double"), 0.0).alias("f1"))


def best_f1(df: DataFrame, p: str = "p", label: str = "label", keys: Sequence[str] = KEYS) -> DataFrame:
    """Best threshold per key; ties go to the lowest one, 0.55 when no threshold scores."""
    f = f1_by_threshold(df, p, label, keys=keys).withColumn("_f", F.round("f1", 12))
    g = f.groupBy(*keys).agg(F.max(F.struct("_f", (-F.col("threshold")).alias("t"), "f1")).alias("b"))
    return g.select(*keys, F.when(F.col("b.f1") > 0, -F.col("b.t")).otherwise(0.55).alias("threshold"), F.col("b.f1").alias("f1"))


def profit_thresholds(df: DataFrame, p: str = "p", ret: str = "ret", keys: Sequence[str] = KEYS) -> DataFrame:
    """Long and short limits that maximise the mean of side * return over a 19 x 19 grid.

    Every long limit (0.52..0.70) lies above every short limit (0.30..0.48), so the
    two sides separate: 38 conditional sums in one aggregate replace 361 passes.
    """
    longs = [round(0.52 + 0.01 * i, 2) for i in range(19)]
    shorts = [round(0.30 + 0.01 * i, 2) for i in range(19)]
    r, q = F.coalesce(F.col(ret), F.lit(0.0)), F.col(p)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.coalesce(F.sum(F.when(q >= t, r)), F.lit(0.0)).alias(f"l{i}") for i, t in enumerate(longs)]
    aggs += [F.coalesce(F.sum(F.when(q <= t, -r)), F.lit(0.0)).alias(f"s{i}") for i, t in enumerate(shorts)]
    g = df.filter(q.isNotNull()).groupBy(*keys).agg(*aggs)
    pick = lambda pre, ts: F.array_max(F.array(*[
        F.struct(F.round(F.col(f"{pre}{i}"), 10).alias("v"), F.lit(-t).alias("t")) for i, t in enumerate(ts)]))
    g = g.withColumns({"bl": pick("l", longs), "bs": pick("s", shorts)})
    return g.select(*keys, "n", (-F.col("bl.t")).alias("th_long"), (-F.col("bs.t")).alias("th_short"),
                    ((F.col("bl.v") + F.col("bs.v")) / F.col("n")).alias("score"))


def feature_correlations(df: DataFrame, cols: Sequence[str], p: str = "p", k: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Features by absolute correlation with the prediction; ``k`` asks for the k largest only."""
    g = df.groupBy(*keys).agg(*[F.abs(correlation(c, p)).alias(c) for c in cols])
    long = g.unpivot(list(keys), list(cols), "feature", "abs_corr")
    if not keys:
        long = long.orderBy(F.col("abs_corr").desc_nulls_last(), "feature")
        return long if k is None else long.limit(k)
    if k is None:
        return long
    w = Window.partitionBy(*keys).orderBy(F.col("abs_corr").desc_nulls_last(), "feature")
    return long.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k).drop("_rk")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight ``n / (k * n_c)`` per class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    every = Window.partitionBy(F.lit(1))  # over the classes, not the rows
    return c.select(label, "n_c", (F.sum("n_c").over(every) / (F.count(F.lit(1)).over(every) * F.col("n_c"))).alias("weight"))
