"""Column formulas: safe arithmetic, bins, prices, position sizes and scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(x: Column | str) -> Column:
    """``x`` when it is a finite number, else null."""
    x = col(x)
    # NaN sorts above infinity, so one comparison rules out both
    return F.when(F.abs(x) < float("inf"), x)


def safe_divide(a: Column | str, b: Column | str, default: float | None = None, eps: float = 0.0) -> Column:
    """``a / b``; ``default`` where the divisor is null or not larger than ``eps`` in size."""
    a, b = col(a), col(b)
    return F.when(F.abs(b) > eps, F.try_divide(a, b)).otherwise(F.lit(default).cast("double"))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Aggregate: Pearson correlation of the pairs without a null; null where a side does not vary (``corr`` ends the job there)."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


def clip(x: Column | str, lo: float, hi: float) -> Column:
    """Limit to [lo, hi]; null stays null."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def cut_bins(x: Column | str, edges: Sequence[float], labels: Sequence[int], default: int | None = None,
             include_lowest: bool = False) -> Column:
    """Right-closed bins ``(e0, e1], (e1, e2], ...``; ``default`` outside or for null."""
    x = col(x)
    low = x >= edges[0] if include_lowest else x > edges[0]
    out = F.when(low & (x <= edges[1]), labels[0])
    for lo, hi, lab in zip(edges[1:], edges[2:], labels[1:]):
        out = out.when((x > lo) & (x <= hi), lab)
    return out.otherwise(F.lit(default))


def side_of(x: Column | str) -> Column:
    """Direction -1/0/1 of a score or signal."""
    return F.signum(col(x).cast("double")).cast("int")


def clip_side(x: Column | str) -> Column:
    return F.least(F.greatest(col(x).cast("int"), F.lit(-1)), F.lit(1))


def round_to_tick(price: Column | str, tick: Column | str) -> Column:
    """Nearest multiple of the tick, half to even."""
    return F.bround(col(price) / col(tick), 0) * col(tick)


def adverse_price(price: Column | str, side: Column | str, tick: Column | str, ticks: Column | str) -> Column:
    """Fill price moved against the trade by a number of ticks."""
    return round_to_tick(col(price) + F.signum(col(side).cast("double")) * col(ticks) * col(tick), tick)


def slippage_ticks(is_liquid: Column | str, liquid: int = 1, illiquid: int = 3) -> Column:
    return F.when(col(is_liquid), liquid).otherwise(illiquid)


def risk_notional(vol: Column | str, p: Column | str, equity: float = 1_000_000.0, risk: float = 0.001,
                  max_gross: float = 1.0) -> Column:
    """Money position ``risk*equity / (vol*p)`` between 0 and ``max_gross * equity``."""
    budget = max(risk * equity, 1.0)
    pc = F.least(F.greatest(col(p), F.lit(1e-6)), F.lit(1.0))
    return clip(F.try_divide(F.lit(budget), col(vol) * pc), 0.0, max_gross * equity)


def atr_quantity(atr: Column | str, equity: float, risk_per_trade: float, stop_mult: float) -> Column:
    """Units so that a stop of ``stop_mult`` ATR loses the risk amount; 1 when undefined."""
    amount = max(equity * risk_per_trade, 1e-9)
    a = col(atr)
    if stop_mult <= 0:
        return F.lit(1.0)
    return F.when(a > 0, F.lit(amount) / (a * stop_mult)).otherwise(1.0)


def cap_leverage(qty: Column | str, price: Column | str, equity: float, leverage: float = 3.0) -> Column:
    """Units whose value stays within ``leverage`` times equity."""
    return F.least(col(qty), F.lit(equity * leverage) / col(price))


def vol_target_weight(signal: Column | str, vol: Column | str, daily: float = 0.02, bars_per_day: int = 30) -> Column:
    """Signal scaled to a volatility target, within +-0.5; 0 without volatility."""
    target = daily / math.sqrt(bars_per_day)
    v = col(vol)
    return F.when(v > 0, clip(col(signal) * F.lit(target) / v, -0.5, 0.5)).otherwise(0.0)


def strength_size(signal: Column | str, trend: Column | str, vol: Column | str, risk: Column | str,
                  base: float = 0.015, boost: float = 0.5, vol_floor: float = 0.01, cap: float = 0.08) -> Column:
    """Portfolio share grown by trend strength, shrunk by volatility and risk, capped."""
    up = 1.0 + F.least(F.abs(F.coalesce(col(trend), F.lit(0.0))) * boost, F.lit(boost))
    by_vol = 0.02 / F.greatest(F.coalesce(col(vol), F.lit(0.02)), F.lit(vol_floor))
    return F.least(F.lit(base) * up * by_vol * col(risk) * F.abs(col(signal)), F.lit(cap))


def sweep_score(total_return="total_return", max_drawdown="max_drawdown", sharpe="sharpe_proxy",
                profit_factor="profit_factor", profit_per_trade="profit_per_trade", sortino="sortino_proxy",
                trades="trade_count", turnover="turnover") -> Column:
    """Ranking score of one sweep row, with penalties for many trades and turnover."""
    z = lambda c: F.coalesce(col(c).cast("double"), F.lit(0.0))
    base = z(total_return) / (F.abs(z(max_drawdown)) + 1e-12)
    base = base + 0.5 * z(sharpe) + 0.25 * z(profit_factor) + 50.0 * z(profit_per_trade) + 0.5 * z(sortino)
    return base - 0.0005 * z(trades) - 0.005 * (z(turnover) / 1e6)


def feature_set_score(total_return="total_return", max_drawdown="max_drawdown", profit_factor="profit_factor",
                      avg_trade="avg_trade", trades="trade_count") -> Column:
    """Ranking score of one feature set; only trades beyond 200 are penalised."""
    z = lambda c: F.coalesce(col(c).cast("double"), F.lit(0.0))
    base = z(total_return) / (F.abs(z(max_drawdown)) + 1e-12) + 0.5 * z(profit_factor) + 50.0 * z(avg_trade)
    return base - 0.0005 * F.greatest(z(trades) - 200.0, F.lit(0.0))
