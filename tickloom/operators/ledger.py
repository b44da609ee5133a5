"""Target-position ledgers, portfolio valuation and risk budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import clip
from tickloom.operators import indicators as I
from tickloom.operators.asof import asof_backward
from tickloom.operators.blocks import KEYS, blocked, core, equity_path, index_bars, prefix
from tickloom.schema import require_columns
from tickloom.session import cut

# Default costs.
COMMISSION = 0.0005
SLIPPAGE_BPS = 1.0


def trade_cost(price: Column, shares: Column, commission: float = COMMISSION, slippage_bps: float = SLIPPAGE_BPS) -> Column:
    return F.abs(shares) * price * F.lit(commission + slippage_bps / 10_000.0)


def positions(df: DataFrame, side: str = "side", size: str = "size", commission: float = COMMISSION,
              slippage_bps: float = SLIPPAGE_BPS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per-bar target position, trade, costs and both profit measures.

    Shares after a bar always equal the target ``size * side / price``, so the
    previous target is a one-row lag and nothing depends on the path.
    ``pnl`` marks the held shares to market; ``cashflow`` is signed cash only.
    """
    require_columns(df, [*keys, "bar", "close", side, size], "ledger")
    p = F.col("close")
    d = blocked(df, back=1)
    d = d.withColumn("shares", F.col(size) * F.col(side) / F.greatest(p, F.lit(1e-9)))
    d = d.withColumns(
        {"_prev": F.coalesce(I.lag("shares", 1, keys), F.lit(0.0)), "_move": F.coalesce(p - I.lag("close", 1, keys), F.lit(0.0))}
    )
    d = d.withColumn("traded", F.col("shares") - F.col("_prev"))
    d = d.withColumns(
        {
            "turnover": F.abs("traded") * p,
            "cost": trade_cost(p, F.col("traded"), commission, slippage_bps),
        }
    )
    d = d.withColumns(
        {"cashflow": -F.col("traded") * p - F.col("cost"), "pnl": F.col("_prev") * F.col("_move") - F.col("cost")}
    )
    return core(d)


def ledger(df: DataFrame, side: str = "side", size: str = "size", equity0: float = 1_000_000.0, use: str = "pnl",
           commission: float = COMMISSION, slippage_bps: float = SLIPPAGE_BPS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Positions plus running ``equity``, its ``peak`` and ``drawdown``; ``use`` names the profit column."""
    d = cut(positions(df, side, size, commission, slippage_bps, keys))
    d = equity_path(d, F.col(use), equity0, keys)
    return d.withColumn("drawdown", F.try_divide("equity", "peak") - 1.0)


def portfolio_value(trades: DataFrame, prices: DataFrame, cash0: float = 1_000_000.0, tie: Sequence[str] = ("trade_no",)) -> DataFrame:
    """Equity of a multi-symbol trade log at every trade or price time.

    Instead of a dense time x symbol table, each symbol contributes the *changes*
    of its position value and cash at its own events; changes are summed per time
    and accumulated.  ``trades``: symbol, ts, side BUY/SELL, quantity, price,
    commission and a tie-break; ``prices``: symbol, ts, close.
    """
    sign = F.when(F.upper("side") == "BUY", 1.0).otherwise(-1.0)
    q = sign * F.col("quantity")
    ev = prices.select("symbol", "ts", F.lit(0).alias("_kind"), *[F.lit(0).cast("long").alias(t) for t in tie],
                       F.col("close").alias("_px"), F.lit(0.0).alias("_q"), F.lit(0.0).alias("_cash"))
    tr = trades.select("symbol", "ts", F.lit(1).alias("_kind"), *[F.col(t).cast("long").alias(t) for t in tie],
                       F.lit(None).cast("double").alias("_px"), q.alias("_q"),
                       (-q * F.col("price") - F.coalesce("commission", F.lit(0.0))).alias("_cash"))
    ev = cut(index_bars(ev.unionByName(tr), every_days=1, order=["ts", "_kind", *tie]))
    ev = prefix(ev, {"pos": ("sum", F.col("_q")), "px": ("last", F.col("_px"))})
    ev = ev.withColumn("value", F.col("pos") * F.coalesce("px", F.lit(0.0)))
    ev = blocked(ev.select("symbol", "ts", "bar", "value", F.col("_cash").alias("flow")), back=1)
    ev = core(ev.withColumn("change", F.col("value") - F.coalesce(I.lag("value"), F.lit(0.0))))
    per = ev.groupBy("ts").agg(F.sum("change").alias("dv"), F.sum("flow").alias("dc"), F.count(F.lit(1)).alias("events"))
    per = cut(index_bars(per.withColumn("portfolio", F.lit("all")), keys=["portfolio"], every_days=1))
    out = prefix(per, {"holdings": ("sum", F.col("dv")), "cash": ("sum", F.col("dc"))}, keys=["portfolio"])
    out = out.withColumn("cash", F.col("cash") + F.lit(cash0))
    return out.withColumn("equity", F.col("cash") + F.col("holdings")).select("ts", "bar", "events", "holdings", "cash", "equity")


def risk_budget(equity: DataFrame, scores: DataFrame, limit: float = 0.3, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """0 when the drawdown exceeds the limit, else the last known risk score, within [0, 1].

    ``equity``: keys, ts, bar, equity; ``scores``: keys, ts, risk_score.
    """
    e = prefix(equity, {"peak": ("max", F.col("equity"))}, keys=keys)
    e = e.withColumn("drawdown", F.when(F.col("peak") != 0, (F.col("peak") - F.col("equity")) / F.col("peak")).otherwise(0.0))
    e = asof_backward(e, scores, ["risk_score"], keys=keys, width_s=86400 * 90, defaults={"risk_score": 1.0})
    gate = F.when(F.col("drawdown") > limit, 0.0).otherwise(1.0)
    return e.withColumn("budget", clip(gate * F.col("risk_score"), 0.0, 1.0)).drop("match_ts")
