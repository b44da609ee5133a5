"""Ledgers, episodes, barriers, metrics, portfolio and sweeps."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from tickloom.functions.scalars import feature_set_score, sweep_score
from tickloom.operators import barriers as br
from tickloom.operators import episodes as ep
from tickloom.operators import filters as fl
from tickloom.operators import indicators as I
from tickloom.operators import labels as lb
from tickloom.operators import ledger as lg
from tickloom.operators import metrics as mx
from tickloom.operators import quantile_sketch as qs
from tickloom.operators import signals as sg
from tickloom.operators import user_metrics as um
from tickloom.operators.blocks import blocked, core, join_safe
from tickloom.operators.rollup import pnl_levels
from tickloom.plans import sweep as sw
from tickloom.plans.inputs import bars, orders_daily, price_probability, risk_scores, trades
from tickloom.plans.queries.bars import ORD
from tickloom.plans.queries.sqlbase import bars_cte, debounce_cte, ema_cte, frame, lag, r
from tickloom.session import cut, shared_dir

B = bars_cte()
Q, S = {}, {}


def user_metrics(s, sf):
    """Python metrics and a column aggregate of the close's drawdown."""
    d = mx.add_drawdown(cut(bars(s, sf)), "close")
    return um.evaluate(d, {"ulcer": um.ULCER, "longest_under": um.LONGEST_UNDER, "worst": F.min("drawdown")}, size=512)


Q["udf_user_metrics"] = user_metrics
S["udf_user_metrics"] = f"""WITH {B}, x AS (SELECT *, close / nullif(max(close) OVER (PARTITION BY symbol ORDER BY bar), 0) - 1 AS dd FROM b),
y AS (SELECT *, sum((coalesce(dd, 0) >= 0)::INT) OVER (PARTITION BY symbol ORDER BY bar) AS g FROM x), n AS (SELECT symbol, g, count(*) FILTER (dd < 0) AS k FROM y GROUP BY 1, 2),
l AS (SELECT symbol, max(k)::DOUBLE AS longest_under FROM n GROUP BY 1)
SELECT x.symbol, {r('sqrt(avg(dd * dd))', 'ulcer')}, any_value(longest_under) AS longest_under, {r('min(dd)', 'worst')} FROM x JOIN l ON l.symbol = x.symbol GROUP BY 1"""


def sided(spark, sf, source=bars):
    """Bars with a simple level rule as the direction and a fixed notional."""
    side = F.when(F.col("close") > 300, 1).when(F.col("close") < 180, -1).otherwise(0)
    return source(spark, sf).withColumns({"side": side, "size": F.lit(10_000.0)})


SIDED = "sd AS (SELECT *, CASE WHEN close > 300 THEN 1 WHEN close < 180 THEN -1 ELSE 0 END AS side, 10000.0::DOUBLE AS size FROM b)"


def ledger_sql(src="sd", key="symbol", pre="l"):
    w = f"(PARTITION BY {key} ORDER BY bar)"
    return f"""{pre}1 AS (SELECT *, size * side / close AS shares FROM {src}),
{pre}2 AS (SELECT *, coalesce(lag(shares) OVER {w}, 0) AS prev, coalesce(close - lag(close) OVER {w}, 0) AS mv FROM {pre}1),
{pre}3 AS (SELECT *, shares - prev AS traded, abs(shares - prev) * close AS turnover, abs(shares - prev) * close * 0.0006 AS cost FROM {pre}2),
{pre}4 AS (SELECT *, -traded * close - cost AS cashflow, prev * mv - cost AS pnl FROM {pre}3),
{pre}5 AS (SELECT *, 1e6 + sum(pnl) OVER {w} AS equity FROM {pre}4),
{pre}6 AS (SELECT *, max(equity) OVER {w} AS peak FROM {pre}5),
{pre} AS (SELECT *, equity / peak - 1 AS drawdown FROM {pre}6)"""


LED = f"{B}, {SIDED}, {ledger_sql()}"


def d12(s, sf):
    d = lg.ledger(sided(s, sf))
    return d.select("symbol", "bar", "shares", "traded", *[F.round(c, 4).alias(c) for c in ("turnover", "cost", "cashflow", "pnl")],
                    F.round("equity", 1).alias("equity"), "drawdown")


Q["d12_position_ledger"] = d12
S["d12_position_ledger"] = f"""WITH {LED} SELECT symbol, bar, {r('shares', 'shares')}, {r('traded', 'traded')}, {r('turnover', 'turnover', 4)}, {r('cost', 'cost', 4)},
 {r('cashflow', 'cashflow', 4)}, {r('pnl', 'pnl', 4)}, {r('equity', 'equity', 1)}, {r('drawdown', 'drawdown')} FROM l"""


def d12_cash(s, sf):
    d = lg.ledger(sided(s, sf), use="cashflow")
    return d.groupBy("symbol").agg(F.round(F.max_by("equity", "bar"), 2).alias("final_equity"), F.round(F.min("equity"), 2).alias("low"))


Q["d12_cash_ledger"] = d12_cash
S["d12_cash_ledger"] = f"""WITH {LED}, c AS (SELECT symbol, bar, 1e6 + sum(cashflow) OVER (PARTITION BY symbol ORDER BY bar) AS eq FROM l)
SELECT symbol, {r('arg_max(eq, bar)', 'final_equity', 2)}, {r('min(eq)', 'low', 2)} FROM c GROUP BY symbol"""


def held(s, sf):
    return sided(s, sf).withColumn("signal", F.col("side"))


Q["d13_trade_log"] = lambda s, sf: ep.trade_log(held(s, sf))
EPI = f"""i1 AS (SELECT *, lag(side) OVER w AS ps, lead(close) OVER w AS nc, lead(ts) OVER w AS nt FROM sd WINDOW w AS (PARTITION BY symbol ORDER BY bar)),
i2 AS (SELECT *, sum(CASE WHEN side <> 0 AND side <> coalesce(ps, 0) THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY bar) AS tid FROM i1),
t1 AS (SELECT symbol, tid AS trade_id, min(ts) AS entry_ts, coalesce(arg_max(nt, bar), max(ts)) AS exit_ts, arg_min(close, bar) AS e,
 any_value(side) AS d, count(*) AS bars_held, max(side * close) AS best, min(side * close) AS worst, max(bar) AS lb, arg_max(close, bar) AS lc, max(nt) AS mnt FROM i2 WHERE side <> 0 GROUP BY 1, 2),
t2 AS (SELECT t1.*, i2.nc, i2.nt FROM t1 JOIN i2 ON t1.symbol = i2.symbol AND t1.lb = i2.bar),
tl AS (SELECT *, coalesce(nc, lc) AS x, CASE WHEN nt IS NULL THEN 'open' ELSE 'signal_change' END AS exit_reason FROM t2)"""
S["d13_trade_log"] = f"""WITH {B}, {SIDED}, {EPI} SELECT symbol, trade_id::BIGINT AS trade_id, entry_ts, coalesce(nt, exit_ts) AS exit_ts, {r('e', 'entry_price')}, {r('x', 'exit_price')}, d AS direction, bars_held,
 {r('d * (x - e) / e', 'ret_gross')}, {r('d * (x - e) - x * 0.0011', 'pnl_abs')}, {r('(d * (x - e) - x * 0.0011) / e', 'ret_net')},
 {r('greatest(best - d * e, 0)', 'mfe')}, {r('least(worst - d * e, 0)', 'mae')}, exit_reason FROM tl"""

Q["d13_bar_log"] = lambda s, sf: ep.bar_log(held(s, sf)).select("symbol", "bar", "signal", "trade_id", "open_pnl")
S["d13_bar_log"] = f"""WITH {B}, {SIDED}, {EPI} SELECT i2.symbol, i2.bar, side AS signal, CASE WHEN side <> 0 THEN tid END::BIGINT AS trade_id,
 {r('CASE WHEN side <> 0 THEN (close - e) * side ELSE 0 END', 'open_pnl')} FROM i2 LEFT JOIN t1 ON i2.symbol = t1.symbol AND side <> 0 AND tid = trade_id"""

Q["a15_trade_performance"] = lambda s, sf: mx.trade_performance(ep.trade_log(held(s, sf)), "pnl_abs")
S["a15_trade_performance"] = f"""WITH {B}, {SIDED}, {EPI}, p AS (SELECT symbol, d * (x - e) - x * 0.0011 AS pnl FROM tl)
SELECT symbol, count(*) AS trades, {r('avg((pnl > 0)::INT)', 'win_rate')}, {r('avg(pnl)', 'avg_pnl')}, {r('sum(pnl)', 'total_pnl')} FROM p GROUP BY 1"""

Q["a11_pnl_metrics"] = lambda s, sf: mx.pnl_metrics(ep.trade_log(held(s, sf)), "pnl_abs")
S["a11_pnl_metrics"] = f"""WITH {B}, {SIDED}, {EPI}, p AS (SELECT symbol, d * (x - e) - x * 0.0011 AS pnl FROM tl)
SELECT symbol, {r('sum(pnl)', 'pnl_sum')}, {r('avg(pnl)', 'pnl_mean')}, {r('stddev_samp(pnl)', 'pnl_std')}, count(*) AS trades, count_if(pnl > 0) AS wins,
 count_if(pnl < 0) AS losses, count_if(pnl = 0) AS ties, {r('avg((pnl > 0)::INT)', 'win_rate')} FROM p GROUP BY 1"""

Q["a16_distribution"] = lambda s, sf: mx.distribution(ep.trade_log(held(s, sf)), ["pnl_abs", "mfe"])
S["a16_distribution"] = f"""WITH {B}, {SIDED}, {EPI}, p AS (SELECT symbol, 'pnl_abs' AS feature, d * (x - e) - x * 0.0011 AS v FROM tl UNION ALL SELECT symbol, 'mfe', greatest(best - d * e, 0) FROM tl)
SELECT symbol, feature, count(v) AS n, {r('min(v)', 'min_x')}, {r('quantile_cont(v, 0.25)', 'p25')}, {r('quantile_cont(v, 0.5)', 'median_x')}, {r('quantile_cont(v, 0.75)', 'p75')}, {r('max(v)', 'max_x')} FROM p GROUP BY 1, 2"""

EQ = "eq AS (SELECT symbol, bar, equity, peak, drawdown, coalesce(equity / lag(equity) OVER (PARTITION BY symbol ORDER BY bar) - 1, 0) AS ret FROM l)"
Q["a11_levels"] = lambda s, sf: pnl_levels(ep.trade_log(held(s, sf)), "pnl_abs", ["symbol", "direction"])
S["a11_levels"] = f"""WITH {B}, {SIDED}, {EPI}, p AS (SELECT symbol, d AS direction, d * (x - e) - x * 0.0011 AS pnl FROM tl)
SELECT symbol, direction, grouping_id(symbol, direction)::INT AS level, count(*) AS trades, {r('sum(pnl)', 'pnl_sum')}, {r('avg(pnl)', 'pnl_mean')},
 {r('coalesce(stddev_samp(pnl), 0)', 'pnl_std')}, count_if(pnl > 0) AS wins, count_if(pnl < 0) AS losses, {r('avg((pnl > 0)::INT)', 'win_rate')},
 {r('min(pnl)', 'pnl_min')}, {r('max(pnl)', 'pnl_max')} FROM p GROUP BY ROLLUP (symbol, direction)"""


def a16_sketches(s, sf):
    """Days from the second to the third quarter of the bars from stored sketches; ``good``: all quartiles are within 1 % of the rows."""
    d = bars(s, sf)
    path = f"{shared_dir(s)}/tickloom/a16-{uuid.uuid4().hex}"
    qs.write_days(qs.day_sketches(d, ["close", "volume"]), path)
    first, last = d.agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
    quarter = (last - first) // 4
    since, until = first + timedelta(days=quarter.days), last - timedelta(days=quarter.days)
    merged = qs.merge(qs.read_days(s, path, str(since), str(until)))
    found = qs.quantiles(merged, [0.25, 0.5, 0.75])
    miss = qs.rank_misses(d.filter((F.to_date("ts") >= F.lit(since)) & (F.to_date("ts") < F.lit(until))), found)
    good = miss.groupBy("symbol", "feature").agg((F.max("miss") <= 0.01).alias("good"))
    return join_safe(merged.select("symbol", "feature", "n", "min_x", "max_x"), good, ["symbol", "feature"])


Q["a16_sketched_range"] = a16_sketches
S["a16_sketched_range"] = f"""WITH {B}, e AS (SELECT min(ts)::DATE AS a, max(ts)::DATE AS z FROM b),
d AS (SELECT b.* FROM b, e WHERE ts::DATE >= a + ((z - a) // 4)::INT AND ts::DATE < z - ((z - a) // 4)::INT),
l AS (SELECT symbol, 'close' AS feature, close AS x FROM d UNION ALL SELECT symbol, 'volume', volume FROM d)
SELECT symbol, feature, count(x) AS n, {r('min(x)', 'min_x')}, {r('max(x)', 'max_x')}, true AS good FROM l GROUP BY 1, 2"""

Q["a10_equity_metrics"] = lambda s, sf: mx.equity_metrics(lg.ledger(sided(s, sf)), 252.0 * 48, has_drawdown=True).withColumn("final_equity", F.round("final_equity", 2))
S["a10_equity_metrics"] = f"""WITH {LED}, {EQ}, g AS (SELECT symbol, count(*) AS bars, arg_min(equity, bar) AS a, arg_max(equity, bar) AS z, min(drawdown) AS dd, stddev_samp(ret) AS sd, avg(ret) AS mu FROM eq GROUP BY 1)
SELECT symbol, {r('z / a - 1', 'total_return')}, {r('dd', 'max_drawdown')}, {r('(z / a - 1) / abs(dd)', 'calmar')}, {r('sd * sqrt(252 * 48)', 'volatility_ann')},
 {r('mu / sd * sqrt(252 * 48)', 'sharpe_ann')}, bars, {r('z', 'final_equity', 2)} FROM g"""


def a12(s, sf):
    led = lg.ledger(sided(s, sf), equity0=2_000.0)
    c = mx.equity_metrics_variant(led, "clipped").select("symbol", F.lit("clipped").alias("variant"), "bars", F.round("final_equity", 3).alias("final_equity"),
                                                         "total_return", "max_drawdown", F.lit(None).cast("double").alias("win_rate"))
    p = mx.equity_metrics_variant(led, "positive").select("symbol", F.lit("positive").alias("variant"), "bars", F.round("final_equity", 3).alias("final_equity"),
                                                          "total_return", "max_drawdown", "win_rate")
    return c.unionByName(p)


LED2 = LED.replace("1e6 +", "2000.0 +")
Q["a12_metric_variants"] = a12
S["a12_metric_variants"] = f"""WITH {LED2}, {EQ}, c0 AS (SELECT symbol, bar, greatest(equity, 0) AS e FROM eq), c1 AS (SELECT *, e / max(e) OVER (PARTITION BY symbol ORDER BY bar) - 1 AS dd FROM c0)
SELECT symbol, 'clipped' AS variant, count(*) AS bars, {r('arg_max(e, bar)', 'final_equity', 3)}, {r('arg_max(e, bar) / arg_min(e, bar) - 1', 'total_return')}, {r('min(dd)', 'max_drawdown')}, NULL::DOUBLE AS win_rate FROM c1 GROUP BY 1
UNION ALL SELECT symbol, 'positive', count(*), {r('arg_max(equity, bar)', 'final_equity', 3)}, {r('arg_max(equity, bar) / arg_min(equity, bar) - 1', 'total_return')}, {r('max(-drawdown)', 'max_drawdown')}, {r('avg((ret > 0)::INT)', 'win_rate')} FROM eq GROUP BY 1"""

def a12_rule(s, sf):
    d = cut(held(s, sf))
    return mx.rule_metrics(lg.ledger(d), ep.trade_log(d))


Q["a12_rule_metrics"] = a12_rule
S["a12_rule_metrics"] = f"""WITH {LED}, {EQ}, {EPI}, p AS (SELECT symbol, d * (x - e) - x * 0.0011 AS pnl FROM tl),
g AS (SELECT symbol, arg_min(equity, bar) AS a, arg_max(equity, bar) AS z, min(drawdown) AS dd, stddev_samp(ret) AS sd, avg(ret) AS mu FROM eq GROUP BY 1),
t AS (SELECT symbol, count(*) AS n, avg((pnl > 0)::INT) AS w, avg(pnl) AS m, sum(pnl) AS t, stddev_pop(pnl) AS sp FROM p GROUP BY 1)
SELECT g.symbol, {r('z / a - 1', 'total_return')}, {r('dd', 'max_drawdown')}, {r('CASE WHEN dd < 0 THEN (z / a - 1) / abs(dd) ELSE 0 END', 'calmar')}, {r('sd * sqrt(252)', 'volatility_ann')},
 {r('mu / sd * sqrt(252)', 'sharpe_ann')}, coalesce(n, 0) AS trade_count, {r('coalesce(w, 0)', 'win_rate')}, {r('coalesce(m, 0)', 'avg_trade')}, {r('coalesce(t.t, 0)', 'pnl_sum')},
 {r('coalesce(m, 0)', 'pnl_mean')}, {r('coalesce(sp, 0)', 'pnl_std')} FROM g LEFT JOIN t ON g.symbol = t.symbol"""

Q["a14_exposure"] = lambda s, sf: mx.exposure(sided(s, sf))
S["a14_exposure"] = f"WITH {B}, {SIDED} SELECT symbol, {r('avg((side <> 0)::INT)', 'exposure_total')}, {r('avg((side > 0)::INT)', 'exposure_long')}, {r('avg((side < 0)::INT)', 'exposure_short')} FROM sd GROUP BY 1"

Q["w26_streaks"] = lambda s, sf: ep.streaks(sided(s, sf), F.col("side") != 0, prefix_name="hold_bars")


def streak_sql(src, flag, name, pre):
    return f"""{pre}1 AS (SELECT symbol, bar, {flag} AS f, lag({flag}) OVER (PARTITION BY symbol ORDER BY bar) AS pf FROM {src}),
{pre}2 AS (SELECT *, sum(CASE WHEN f AND NOT coalesce(pf, false) THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY bar) AS k FROM {pre}1),
{pre} AS (SELECT symbol, avg(n) AS avg_{name}, max(n) AS max_{name} FROM (SELECT symbol, k, count(*) AS n FROM {pre}2 WHERE f GROUP BY 1, 2) GROUP BY 1)"""


S["w26_streaks"] = f"WITH {B}, {SIDED}, {streak_sql('sd', 'side <> 0', 'hold_bars', 'h')} SELECT symbol, {r('avg_hold_bars', 'avg_hold_bars')}, max_hold_bars FROM h"

PACK = ["bars", "trade_count", "hit_rate", "avg_win", "avg_loss", "avg_trade", "profit_per_trade", "profit_per_bar", "profit_factor", "sharpe_proxy", "sortino_proxy",
        "skewness", "kurtosis", "total_return", "max_drawdown", "calmar_proxy", "exposure_total", "exposure_long", "exposure_short"]


def core_sql(src="l", key="symbol", name="pk"):
    return f"""{name}0 AS (SELECT {key}, count(*) AS bars, arg_max(equity, bar) AS z, arg_min(equity, bar) AS a, min(drawdown) AS max_drawdown, count_if(traded <> 0) AS trade_count,
 sum(turnover) AS turnover, sum(cost) AS commission_paid, coalesce(sum(CASE WHEN pnl > 0 THEN pnl END), 0) AS gross_profit, coalesce(sum(CASE WHEN pnl < 0 THEN pnl END), 0) AS gross_loss,
 sum(pnl) AS tot, avg(pnl) AS mu, stddev_samp(pnl) AS sd, coalesce(sqrt(avg(CASE WHEN pnl < 0 THEN pnl * pnl END)), 0) AS dn, coalesce(avg(CASE WHEN pnl <> 0 THEN pnl END), 0) AS avg_trade,
 coalesce(avg(CASE WHEN pnl <> 0 THEN (pnl > 0)::INT END), 0) AS hit_rate, coalesce(avg(CASE WHEN pnl > 0 THEN pnl END), 0) AS avg_win, coalesce(avg(CASE WHEN pnl < 0 THEN pnl END), 0) AS avg_loss,
 avg((side <> 0)::INT) AS exposure_total, avg((side > 0)::INT) AS exposure_long, avg((side < 0)::INT) AS exposure_short,
 count(pnl) AS n, sum(pnl * pnl) AS s2, sum(pnl * pnl * pnl) AS s3, sum(pnl * pnl * pnl * pnl) AS s4 FROM {src} GROUP BY {key}),
{name} AS (SELECT *, z / a - 1 AS total_return, CASE WHEN max_drawdown < 0 THEN (z / a - 1) / abs(max_drawdown) WHEN z > a THEN NULL ELSE 0 END AS calmar_proxy,
 CASE WHEN gross_loss < 0 THEN gross_profit / abs(gross_loss) WHEN gross_profit > 0 THEN NULL ELSE 0 END AS profit_factor,
 CASE WHEN trade_count > 0 THEN tot / trade_count ELSE 0 END AS profit_per_trade, tot / bars AS profit_per_bar, CASE WHEN sd > 0 THEN mu / sd ELSE 0 END AS sharpe_proxy,
 CASE WHEN dn > 0 THEN mu / dn ELSE 0 END AS sortino_proxy, CASE WHEN sd > 0 THEN (s3 / n - 3 * mu * s2 / n + 2 * mu ** 3) / sd ** 3 ELSE 0 END AS skewness,
 CASE WHEN sd > 0 THEN (s4 / n - 4 * mu * s3 / n + 6 * mu ** 2 * s2 / n - 3 * mu ** 4) / sd ** 4 - 3 ELSE 0 END AS kurtosis FROM {name}0)"""


def a13(s, sf):
    return mx.extended_pack(lg.ledger(sided(s, sf))).select("symbol", *PACK, "avg_hold_bars", "max_hold_bars", "max_win_streak", "max_loss_streak", "median_trade",
                                                            *[F.round(c, 2).alias(c) for c in ("final_equity", "turnover", "commission_paid", "gross_profit", "gross_loss")])


Q["a13_extended_pack"] = a13
NZ = "nz AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS bar, pnl FROM l WHERE pnl <> 0)"
S["a13_extended_pack"] = f"""WITH {LED}, {core_sql()}, {streak_sql('sd', 'side <> 0', 'hold_bars', 'h')}, {NZ}, {streak_sql('nz', 'pnl > 0', 'win_streak', 'ws')},
{streak_sql('nz', 'pnl < 0', 'loss_streak', 'ls')}, md AS (SELECT symbol, quantile_cont(pnl, 0.5) AS median_trade FROM nz GROUP BY 1)
SELECT symbol, {', '.join(c if c in ('bars', 'trade_count') else r(c, c) for c in PACK)}, {r('avg_hold_bars', 'avg_hold_bars')}, max_hold_bars, max_win_streak, max_loss_streak, {r('median_trade', 'median_trade')},
 {r('z', 'final_equity', 2)}, {r('turnover', 'turnover', 2)}, {r('commission_paid', 'commission_paid', 2)}, {r('gross_profit', 'gross_profit', 2)}, {r('gross_loss', 'gross_loss', 2)}
FROM pk JOIN h USING (symbol) JOIN ws USING (symbol) JOIN ls USING (symbol) JOIN md USING (symbol)"""

SCORE = "total_return / (abs(max_drawdown) + 1e-12) + 0.5 * sharpe_proxy + 0.25 * coalesce(profit_factor, 0) + 50 * profit_per_trade + 0.5 * sortino_proxy - 0.0005 * trade_count - 0.005 * (turnover / 1e6)"


def t5(s, sf):
    m = mx.core_pack(lg.ledger(sided(s, sf)))
    return m.select("symbol", sweep_score().alias("score"), feature_set_score(trades="trade_count").alias("fs_score"))


Q["t5_scores"] = t5
S["t5_scores"] = f"""WITH {LED}, {core_sql()} SELECT symbol, {r(SCORE, 'score')},
 {r('total_return / (abs(max_drawdown) + 1e-12) + 0.5 * coalesce(profit_factor, 0) + 50 * avg_trade - 0.0005 * greatest(trade_count - 200.0, 0)', 'fs_score')} FROM pk"""

Q["t4_report_order"] = lambda s, sf: fl.report_order(mx.equity_metrics(lg.ledger(sided(s, sf)), has_drawdown=True).select("symbol", "sharpe_ann", "total_return"))
S["t4_report_order"] = f"""WITH {LED}, {EQ} SELECT symbol, {r('avg(ret) / stddev_samp(ret) * sqrt(252)', 'sharpe_ann')}, {r('arg_max(equity, bar) / arg_min(equity, bar) - 1', 'total_return')} FROM eq GROUP BY symbol ORDER BY sharpe_ann DESC"""

# barriers and labels


def entries(s, sf, source=bars):
    d = I.add_atr(blocked(source(s, sf), back=1 + 14), 14, "mean1", "atr")
    return core(d).withColumn("side", F.when(F.col("close") > 250, -1).otherwise(1))


def barrier_sql(stop, take, trail, hold, unit, intrabar, atr_at="entry", digits=6):
    u = {"pct": "e", "atr": "ea" if atr_at == "entry" else "f.atr"}[unit]
    worst, best = ("CASE WHEN d > 0 THEN f.low ELSE f.high END", "CASE WHEN d > 0 THEN f.high ELSE f.low END") if intrabar else ("f.close", "f.close")
    cases, px = [], []
    if stop is not None:
        cases.append(f"WHEN (({worst}) - (e - d * {stop} * {u})) * d <= 0 THEN 'stop'")
        px.append(f"WHEN 'stop' THEN {'e - d * ' + str(stop) + ' * u' if intrabar else 'c'}")
    if take is not None:
        cases.append(f"WHEN (({best}) - (e + d * {take} * {u})) * d >= 0 THEN 'take'")
        px.append(f"WHEN 'take' THEN {'e + d * ' + str(take) + ' * u' if intrabar else 'c'}")
    if trail:
        cases.append(f"WHEN d * f.close <= greatest(max(d * f.close) OVER (PARTITION BY n.symbol, n.bar ORDER BY f.bar), d * e) - {trail} * {u} THEN 'trail'")
    cases.append(f"WHEN f.bar >= n.bar + {hold} THEN 'time'")
    return f"""WITH {B}, t AS (SELECT *, greatest(high - low, abs(high - p), abs(low - p)) AS tr FROM (SELECT *, {lag('close')} AS p FROM b)),
a AS (SELECT *, {frame(14, 'avg(tr)', 1)} AS atr FROM t),
n AS (SELECT symbol, bar, ts AS ets, close AS e, CASE WHEN close > 250 THEN -1 ELSE 1 END AS d, atr AS ea FROM a),
j AS (SELECT n.*, f.bar AS fb, f.ts AS fts, f.close AS c, {u} AS u, CASE {' '.join(cases)} END AS hit FROM n LEFT JOIN a f ON n.symbol = f.symbol AND f.bar > n.bar AND f.bar <= n.bar + {hold}),
h AS (SELECT symbol, bar, any_value(ets) AS ets, any_value(e) AS e, any_value(d) AS d, coalesce(min(CASE WHEN hit IS NOT NULL THEN fb END), max(fb)) AS xb FROM j GROUP BY 1, 2),
x AS (SELECT h.*, j.fts, j.c, j.u, coalesce(j.hit, 'open') AS outcome FROM h LEFT JOIN j ON h.symbol = j.symbol AND h.bar = j.bar AND h.xb = j.fb),
y AS (SELECT *, coalesce(CASE outcome {' '.join(px)} ELSE c END, e) AS xp FROM x)
SELECT symbol, bar, ets AS entry_ts, {r('e', 'entry_price')}, d AS direction, coalesce(fts, ets) AS exit_ts, coalesce(xb - bar, 0) AS bars_held, outcome, {r("xp", "exit_price")}, {r("(xp / e - 1) * d", "ret", digits)} FROM y"""


for name, rule, sql in (
    ("d14_barriers_percent", br.Barriers(0.3, 0.5, None, 12), barrier_sql(0.3, 0.5, None, 12, "pct", False)),
    ("d14_barriers_trailing", br.Barriers(0.5, 0.9, 0.4, 10), barrier_sql(0.5, 0.9, 0.4, 10, "pct", False)),
    ("d14_barriers_atr_intrabar", br.Barriers(1.5, 1.0, None, 20, "atr", True), barrier_sql(1.5, 1.0, None, 20, "atr", True)),
    ("d14_barriers_atr_current", br.Barriers(1.0, 1.5, 1.0, 15, "atr", False, "current"), barrier_sql(1.0, 1.5, 1.0, 15, "atr", False, "current")),
):
    Q[name] = lambda s, sf, rule=rule: br.barrier_outcomes(cut(entries(s, sf)), rule)
    S[name] = sql


def j7(s, sf):
    b = cut(entries(s, sf))
    e = b.filter(F.col("side") != 0).select("symbol", F.col("bar").alias("e_bar"), F.col("close").alias("e_close"))
    j = br.following_bars(e, b.select("symbol", "bar", "close", "high"), 5)
    return j.groupBy("symbol", "e_bar", "e_close").agg(F.count("bar").alias("n"), F.max("high").alias("hi"))


Q["j7_range_join"] = j7
S["j7_range_join"] = f"""WITH {B} SELECT e.symbol, e.bar AS e_bar, {r('e.close', 'e_close')}, count(f.bar) AS n, {r('max(f.high)', 'hi')} FROM b e LEFT JOIN b f
 ON e.symbol = f.symbol AND f.bar > e.bar AND f.bar <= e.bar + 5 GROUP BY e.symbol, e.bar, e.close"""

Q["d15_labels"] = lambda s, sf: lb.add_labels(bars(s, sf), 6, 0.3, 1.0).select("symbol", "bar", "fwd_ret", "y_up", "y_move", "y_adaptive")
LAB = f"""f0 AS (SELECT *, lead(close, 6) OVER w / close - 1 AS fr, close / lag(close) OVER w - 1 AS rr FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar)),
lb AS (SELECT *, coalesce({frame(20, 'stddev_samp(rr)')}, 0.01) AS th FROM f0),
ly AS (SELECT *, CASE WHEN fr > th THEN 1 WHEN fr < -th THEN -1 WHEN fr IS NOT NULL THEN 0 END AS ya FROM lb)"""
S["d15_labels"] = f"WITH {B}, {LAB} SELECT symbol, bar, {r('fr', 'fwd_ret')}, (fr > 0)::INT AS y_up, (abs(fr) > 0.3)::INT AS y_move, ya AS y_adaptive FROM ly"
Q["d15_direction"] = lambda s, sf: lb.add_direction(bars(s, sf), 3).select("symbol", "bar", "y_dir")
S["d15_direction"] = f"WITH {B} SELECT symbol, bar, sign(lead(close, 3) OVER (PARTITION BY symbol ORDER BY bar) - close)::INT AS y_dir FROM b"
Q["d16_label_quality"] = lambda s, sf: lb.label_quality(lb.add_labels(bars(s, sf), 6, 0.3, 1.0), keys=["symbol"])
S["d16_label_quality"] = f"WITH {B}, {LAB} SELECT symbol, ya AS y_adaptive, count(*) AS n, {r('avg(fr)', 'mean_ret')} FROM ly WHERE ya IS NOT NULL GROUP BY 1, 2"

# portfolio


def d17(s, sf):
    d = lg.portfolio_value(trades(s, sf), orders_daily(s, sf), 7e8)
    return d.select("ts", "bar", *[(F.col(c) / 7e8).alias(c) for c in ("holdings", "cash", "equity")])


D17 = f"""{ORD}, ax AS (SELECT DISTINCT o_orderdate AS ts FROM orders), sy AS (SELECT DISTINCT o_orderpriority AS symbol FROM orders),
dn AS (SELECT ts, symbol FROM ax, sy), tq AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END) AS q,
 sum(-(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END) * o_totalprice - o_totalprice * 0.0005) AS cf FROM orders GROUP BY 1, 2),
dv AS (SELECT ts, symbol, sum(coalesce(q, 0)) OVER w AS pos, last_value(close IGNORE NULLS) OVER w AS px, coalesce(cf, 0) AS cf FROM dn LEFT JOIN tq USING (symbol, ts) LEFT JOIN o0 USING (symbol, ts)
 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
pf0 AS (SELECT ts, sum(pos * coalesce(px, 0)) AS holdings, sum(cf) AS cf FROM dv GROUP BY 1),
pf AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS bar, holdings, 1e9 + sum(cf) OVER (ORDER BY ts) AS cash FROM pf0)"""
Q["d17_portfolio_value"] = d17
S["d17_portfolio_value"] = f"WITH {D17} SELECT ts, bar, {r('holdings / 7e8', 'holdings')}, {r('(cash - 3e8) / 7e8', 'cash')}, {r('(holdings + cash - 3e8) / 7e8', 'equity')} FROM pf"


def d18(s, sf):
    eq = lg.portfolio_value(trades(s, sf), orders_daily(s, sf), 1e9).withColumn("portfolio", F.lit("all")).select("portfolio", "ts", "bar", "equity")
    sc = risk_scores(s, sf).filter(F.dayofmonth("ts") % 5 == 0).withColumn("portfolio", F.lit("all"))
    return lg.risk_budget(cut(eq), sc, 0.02).select("ts", "drawdown", "risk_score", "budget")


Q["d18_risk_budget"] = d18
S["d18_risk_budget"] = f"""WITH {D17}, e AS (SELECT ts, holdings + cash AS eq FROM pf), g AS (SELECT *, (max(eq) OVER (ORDER BY ts) - eq) / max(eq) OVER (ORDER BY ts) AS dd FROM e),
rs AS (SELECT o_orderdate AS ts, avg((o_orderstatus = 'F')::INT) AS s FROM orders WHERE day(o_orderdate) % 5 = 0 GROUP BY 1)
SELECT g.ts, {r('dd', 'drawdown')}, {r('coalesce(s, 1)', 'risk_score')}, {r('CASE WHEN dd > 0.02 THEN 0 ELSE least(greatest(coalesce(s, 1), 0), 1) END', 'budget')} FROM g ASOF LEFT JOIN rs ON g.ts >= rs.ts"""

# sweeps
GRID = {"rsi_low": [40, 45], "rsi_high": [55, 60], "rsi_len": [7, 14], "boll_window": [10, 20], "boll_mult": [0.5, 1.0], "min_gap_bars": [5, 15]}


#: The reference's own grid (app2/config.json): 2,160 combinations.
FULL_GRID = {"rsi_low": [20, 25, 30, 35], "rsi_high": [65, 70, 75, 80], "rsi_len": [10, 14, 20], "boll_window": [14, 20, 30], "boll_mult": [1.5, 2.0, 2.5],
             "min_gap_bars": [10, 15, 20, 25, 30]}


def d19(s, sf, grid=GRID):
    m = sw.meanrev_sweep(bars(s, sf), grid)
    return m.select("symbol", "combo", *sw.DEFAULTS, "bars", "trade_count", "total_return", "max_drawdown", "sharpe_proxy", "sortino_proxy", "profit_factor", "exposure_total",
                    F.round("turnover", 1).alias("turnover"), F.round("score", 5).alias("score"))


def d19_sql():
    vals = ", ".join(f"({g['combo']}, {g['rsi_len']}, {float(g['rsi_low'])}::DOUBLE, {float(g['rsi_high'])}::DOUBLE, {g['bb_len']}, {float(g['bb_k'])}::DOUBLE, {g['gap']})" for g in sw.grid_rows(GRID))
    return f"""WITH RECURSIVE {B}, dx AS (SELECT *, greatest(close - p, 0) AS up, greatest(p - close, 0) AS dn FROM (SELECT *, {lag('close')} AS p FROM b)),
{ema_cte('dx', 'e', [('u7', 'up', 1 / 7), ('d7', 'dn', 1 / 7), ('u14', 'up', 1 / 14), ('d14', 'dn', 1 / 14)], first=1)},
g(combo, rsi_len, rsi_low, rsi_high, bb_len, bb_k, gap) AS (VALUES {vals}),
m AS (SELECT b.symbol, b.bar, b.close, {frame(10, 'avg(close)')} AS m10, {frame(20, 'avg(close)')} AS m20, {frame(10, 'stddev_pop(close)')} AS s10, {frame(20, 'stddev_pop(close)')} AS s20 FROM b),
z AS (SELECT m.*, 100 - 100 / (1 + u7 / (d7 + 1e-9)) AS r7, 100 - 100 / (1 + u14 / (d14 + 1e-9)) AS r14 FROM m LEFT JOIN e USING (symbol, bar)),
w AS (SELECT symbol, combo, bar, close, gap, CASE WHEN rsi_len = 7 THEN r7 ELSE r14 END AS rs, CASE WHEN bb_len = 10 THEN m10 ELSE m20 END AS mm, CASE WHEN bb_len = 10 THEN s10 ELSE s20 END AS ss, rsi_low, rsi_high, bb_k FROM z, g),
x AS (SELECT symbol, combo, bar, close, gap, CASE WHEN rs < rsi_low AND close <= mm - bb_k * ss THEN 1 WHEN rs > rsi_high AND close >= mm + bb_k * ss THEN -1 ELSE 0 END AS raw_dir FROM w),
{debounce_cte('x', 'y', 's.gap', key='symbol, combo')},
sd AS (SELECT x.symbol, x.combo, x.bar, x.close, y.dir AS side, 10000.0::DOUBLE AS size FROM x JOIN y USING (symbol, combo, bar)), {ledger_sql('sd', 'symbol, combo')}, {core_sql('l', 'symbol, combo')}
SELECT symbol, pk.combo, rsi_len, rsi_low, rsi_high, bb_len, bb_k, gap, bars, trade_count, {', '.join(r(c, c) for c in ('total_return', 'max_drawdown', 'sharpe_proxy', 'sortino_proxy', 'profit_factor', 'exposure_total'))},
 {r('turnover', 'turnover', 1)}, {r(SCORE, 'score', 5)} FROM pk JOIN g ON pk.combo = g.combo"""


Q["d19_meanrev_sweep"] = d19
S["d19_meanrev_sweep"] = d19_sql()
Q["d19_meanrev_full_grid"] = lambda s, sf: d19(s, sf, FULL_GRID)  # no SQL: the same sweep, which d19_meanrev_sweep compares


def d20_base(s, sf):
    d = bars(s, sf).withColumn("p", price_probability())
    d = core(sg.add_realized_vol(blocked(d, back=60), 48, "vol"))
    return sw.probability_sweep(d, sw.around(0.58, 0.40, 0.001))


VAR = ", ".join(f"({i}, '{v['kind']}', '{v['param']}', {v['value']}::DOUBLE, {v['th_long']}::DOUBLE, {v['th_short']}::DOUBLE, {v['risk']}::DOUBLE)" for i, v in enumerate(sw.around(0.58, 0.40, 0.001)))
D20 = f"""{B}, q AS (SELECT *, close / (close + open) AS p, close / {lag('close')} - 1 AS rr FROM b), v AS (SELECT *, nullif({frame(48, 'stddev_samp(rr)')}, 0) AS vol FROM q),
g(combo, kind, param, value, tl, ts_, rk) AS (VALUES {VAR}),
sd AS (SELECT symbol, combo, bar, close, CASE WHEN p >= tl THEN 1 WHEN p <= ts_ THEN -1 ELSE 0 END AS side, coalesce(least(1e6 * rk / (vol * p), 1e6), 0) AS size FROM v, g),
{ledger_sql('sd', 'symbol, combo')}, {core_sql('l', 'symbol, combo')}, sc AS (SELECT pk.*, kind, param, value, {SCORE} AS score FROM pk JOIN g ON pk.combo = g.combo)"""
Q["d20_probability_sweep"] = lambda s, sf: d20_base(s, sf).select("symbol", "kind", "param", "value", "trade_count", "total_return", "max_drawdown", "sharpe_proxy", "profit_factor", F.round("score", 4).alias("score"))
S["d20_probability_sweep"] = f"WITH {D20} SELECT symbol, kind, param, value, trade_count, {', '.join(r(c, c) for c in ('total_return', 'max_drawdown', 'sharpe_proxy', 'profit_factor'))}, {r('score', 'score', 4)} FROM sc"
Q["t2_top_configs"] = lambda s, sf: sw.best_configs(d20_base(s, sf), 2).select("symbol", "kind", "param", "value", "rank", F.round("score", 4).alias("score"))
S["t2_top_configs"] = f"WITH {D20}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind, param ORDER BY score DESC, combo) AS rank FROM sc) SELECT symbol, kind, param, value, rank, {r('score', 'score', 4)} FROM t WHERE rank <= 2"
Q["t3_best_per_key"] = lambda s, sf: fl.best_per_key(d20_base(s, sf).select("symbol", "kind", "param", "value", "score", "combo"), ["symbol", "kind"], "score", ["combo"]).select("symbol", "kind", "param", "value", F.round("score", 4).alias("score"))
S["t3_best_per_key"] = f"WITH {D20}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY score DESC, combo) AS k FROM sc) SELECT symbol, kind, param, value, {r('score', 'score', 4)} FROM t WHERE k = 1"

RULES = {"tight": br.Barriers(0.2, 0.3, None, 10), "wide": br.Barriers(0.5, 0.8, None, 20)}
Q["d20_barrier_sweep"] = lambda s, sf: sw.barrier_sweep(entries(s, sf), RULES)
S["d20_barrier_sweep"] = " UNION ALL ".join(
    f"SELECT symbol, '{n}' AS rule, count(*) AS trades, {r('avg((ret > 0)::INT)', 'win_rate')}, {r('avg(ret)', 'avg_pnl')}, {r('sum(ret)', 'total_pnl')} FROM ({barrier_sql(k.stop, k.take, None, k.max_hold, 'pct', False, digits=13)}) GROUP BY 1"
    for n, k in RULES.items())

QUERIES, SQL = Q, S
