"""Indicator and feature queries on 30-minute event bars and daily brand bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import features as X
from tickloom.operators import indicators as I
from tickloom.operators.asof import carry_forward
from tickloom.operators.blocks import blocked, core, prefix
from tickloom.operators.ema import Ema, add_emas, ema_back, span
from tickloom.operators.metrics import add_drawdown
from tickloom.operators.order_stats import Rolling, add_order_stats
from tickloom.operators.quantiles import exact_quantiles, quantile_columns
from tickloom.plans.inputs import bars, daily
from tickloom.plans.queries.sqlbase import DAILY, bars_cte, ema_cte, frame, lag, r

B = bars_cte()


def on_bars(back, build, source=bars):
    """Blocked bars, some columns added, keys and new columns returned."""

    def run(spark, sf):
        df = source(spark, sf)
        out = core(build(blocked(df, back=back)))
        return out.select("symbol", "bar", *[c for c in out.columns if c not in df.columns])

    return run


def cols(**exprs):
    return lambda d: d.withColumns(exprs)


Q = {}
S = {}

Q["w1_returns"] = on_bars(
    100, lambda d: d.withColumns({**{f"ret_{k}": I.pct_change("close", k) for k in (1, 5, 12, 48, 96)}, "log_ret": I.log_return()})
)
S["w1_returns"] = f"""WITH {B} SELECT symbol, bar, {', '.join(r(f"close / {lag('close', k)} - 1", f'ret_{k}') for k in (1, 5, 12, 48, 96))},
 {r(f"ln(close) - ln({lag('close')})", 'log_ret')} FROM b"""

Q["w2_ema"] = on_bars(
    ema_back([span(3), span(12), span(48), 1 / 14]),
    lambda d: add_emas(d, [Ema("ema_3", "close", span(3)), Ema("ema_12", "close", span(12)), Ema("ema_48", "close", span(48)),
                           Ema("wilder_14", "close", 1 / 14)]),
)
E4 = [("ema_3", "close", span(3)), ("ema_12", "close", span(12)), ("ema_48", "close", span(48)), ("wilder_14", "close", 1 / 14)]
S["w2_ema"] = f"""WITH RECURSIVE {B}, {ema_cte('b', 'e', E4)}
SELECT symbol, bar, {', '.join(r(n, n) for n, _, _ in E4)} FROM e"""

Q["w3_ema_adjusted"] = on_bars(ema_back([span(12), span(26)]),
                               lambda d: add_emas(d, [Ema(f"a{n}", "close", span(n), adjust=True) for n in (12, 26)]))


def adj_cte(src, out, spans):
    """Weighted sums and weight sums as two recursions each."""
    seed = ", ".join(f"close AS n{k}, 1.0::DOUBLE AS d{k}" for k in spans)
    step = ", ".join(f"s.close + {1 - span(k)!r} * e.n{k}, 1.0 + {1 - span(k)!r} * e.d{k}" for k in spans)
    return f"""{out} AS (SELECT symbol, bar, {seed} FROM {src} WHERE bar = 0 UNION ALL
 SELECT s.symbol, s.bar, {step} FROM {out} e JOIN {src} s ON s.symbol = e.symbol AND s.bar = e.bar + 1)"""


S["w3_ema_adjusted"] = f"WITH RECURSIVE {B}, {adj_cte('b', 'e', (12, 26))} SELECT symbol, bar, {r('n12 / d12', 'a12')}, {r('n26 / d26', 'a26')} FROM e"

Q["w4_rolling"] = on_bars(
    40,
    lambda d: d.withColumns(
        {
            "m20": I.rolling("close", 20, "mean"), "s20": I.rolling("close", 20, "std"), "p20": I.rolling("close", 20, "std_pop"),
            "lo14": I.rolling("low", 14, "min"), "hi14": I.rolling("high", 14, "max"), "v10": I.rolling("volume", 10, "sum", 1),
            "q80": I.rolling("close", 40, "quantile", 10, q=0.8), "med": I.rolling("close", 15, "median"),
        }
    ),
)
S["w4_rolling"] = f"""WITH {B} SELECT symbol, bar, {r(frame(20, 'avg(close)'), 'm20')}, {r(frame(20, 'stddev_samp(close)'), 's20')},
 {r(frame(20, 'stddev_pop(close)'), 'p20')}, {r(frame(14, 'min(low)'), 'lo14')}, {r(frame(14, 'max(high)'), 'hi14')},
 {r(frame(10, 'sum(volume)', 1), 'v10')}, {r(frame(40, 'quantile_cont(close, 0.8)', 10), 'q80')}, {r(frame(15, 'quantile_cont(close, 0.5)'), 'med')} FROM b"""

Q["w4_long_frames"] = on_bars(
    2000,
    lambda d: add_order_stats(d, {"q20": Rolling("volume", 2000, 0.2, 20), "med": Rolling("close", 2000, min_rows=100),
                                  "q98": Rolling("high", 200, 0.98), "dev": Rolling("close", 199, None)}),  # an odd length: no sums that lie just between two roundings
)
S["w4_long_frames"] = f"""WITH {B}, m AS (SELECT symbol, bar, {frame(2000, 'quantile_cont(volume, 0.2)', 20)} AS q20, {frame(2000, 'quantile_cont(close, 0.5)', 100)} AS med,
 {frame(200, 'quantile_cont(high, 0.98)')} AS q98, {frame(199, 'avg(close)')} AS mean FROM b),
v AS (SELECT m.symbol, m.bar, avg(abs(b.close - mean)) AS dev FROM m JOIN b ON b.symbol = m.symbol AND b.bar BETWEEN m.bar - 198 AND m.bar
 WHERE mean IS NOT NULL GROUP BY 1, 2)
SELECT symbol, bar, {r('q20', 'q20')}, {r('med', 'med')}, {r('q98', 'q98')}, {r('dev', 'dev')} FROM m LEFT JOIN v USING (symbol, bar)"""


def w5(spark, sf):
    q = exact_quantiles(daily(spark, sf), ["close", "volume"], [0.05, 0.5, 0.95])
    names = {(c, p): f"{c}_{int(p * 100)}" for c in ("close", "volume") for p in (0.05, 0.5, 0.95)}
    return quantile_columns(q, names)


Q["w5_series_quantiles"] = w5
S["w5_series_quantiles"] = f"""WITH {DAILY} SELECT symbol, {', '.join(r(f'quantile_cont({c}, {p})', f'{c}_{int(p * 100)}') for c in ('close', 'volume') for p in (0.05, 0.5, 0.95))} FROM b GROUP BY symbol"""


def atrs(d):
    for v in ("mean1", "half", "mean", "wilder", "span"):
        d = I.add_atr(d, 14, v, f"atr_{v}")
    return d


Q["w6_atr_variants"] = on_bars(ema_back([1 / 14, span(14)], 1), atrs)
TR = """t AS (SELECT *, greatest(high - low, abs(high - p), abs(low - p)) AS tr, CASE WHEN p IS NOT NULL THEN greatest(high - low, abs(high - p), abs(low - p)) END AS trn,
 greatest(high - low, abs(high - coalesce(p, close)), abs(low - coalesce(p, close))) AS trf FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bar) AS p FROM b))"""
S["w6_atr_variants"] = f"""WITH RECURSIVE {B}, {TR}, {ema_cte('t', 'e1', [('w', 'trn', 1 / 14)], first=1)}, {ema_cte('t', 'e2', [('s', 'trf', span(14))])},
x AS (SELECT *, {frame(14, 'avg(tr)', 1)} AS m1, {frame(14, 'avg(tr)', 7)} AS mh, {frame(14, 'avg(tr)')} AS mm FROM t)
SELECT x.symbol, x.bar, {r('m1', 'atr_mean1')}, {r('mh', 'atr_half')}, {r('mm', 'atr_mean')}, {r('w', 'atr_wilder')}, {r('s', 'atr_span')}
FROM x LEFT JOIN e1 USING (symbol, bar) LEFT JOIN e2 USING (symbol, bar)"""

Q["w7_rsi"] = on_bars(ema_back([1 / 14], 1), lambda d: I.rsi_simple(I.add_rsi(d, 14, "rsi"), 14, "rsi_simple"))
RSI0 = """g AS (SELECT *, greatest(close - p, 0) AS up, greatest(p - close, 0) AS dn, coalesce(greatest(close - p, 0), 0) AS up0, coalesce(greatest(p - close, 0), 0) AS dn0
 FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bar) AS p FROM b))"""
S["w7_rsi"] = f"""WITH RECURSIVE {B}, {RSI0}, {ema_cte('g', 'e', [('u', 'up', 1 / 14), ('d', 'dn', 1 / 14)], first=1)},
x AS (SELECT *, {frame(14, 'avg(up0)')} AS gu, {frame(14, 'avg(dn0)')} AS gd FROM g)
SELECT x.symbol, x.bar, {r('100 - 100 / (1 + u / (d + 1e-9))', 'rsi')},
 {r('CASE WHEN gd > 0 THEN 100 - 100 / (1 + gu / gd) WHEN gu > 0 THEN 100 END', 'rsi_simple')} FROM x LEFT JOIN e USING (symbol, bar)"""

Q["w8_bollinger"] = on_bars(20, lambda d: I.bollinger(d, 20, 2.0))
S["w8_bollinger"] = f"""WITH {B}, x AS (SELECT *, {frame(20, 'avg(close)')} AS m, {frame(20, 'stddev_pop(close)')} AS sd FROM b)
SELECT symbol, bar, {r('m', 'bb_mid')}, {r('m + 2 * sd', 'bb_up')}, {r('m - 2 * sd', 'bb_dn')}, {r('(close - (m - 2 * sd)) / nullif(4 * sd, 0)', 'bb_pos')} FROM x"""


def w9(d):
    hi, lo = I.prior_channel(30)
    return d.withColumns({"ch_hi": hi, "ch_lo": lo})


Q["w9_prior_channel"] = on_bars(31, w9)
W30 = "(PARTITION BY symbol ORDER BY bar ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"
S["w9_prior_channel"] = f"""WITH {B} SELECT symbol, bar, {r(f'CASE WHEN count(*) OVER {W30} >= 30 THEN max(high) OVER {W30} END', 'ch_hi')},
 {r(f'CASE WHEN count(*) OVER {W30} >= 30 THEN min(low) OVER {W30} END', 'ch_lo')} FROM b"""

Q["w10_drawdown"] = lambda s, sf: add_drawdown(bars(s, sf), "close").select("symbol", "bar", "peak", "drawdown")
S["w10_drawdown"] = f"WITH {B} SELECT symbol, bar, {r('max(close) OVER (PARTITION BY symbol ORDER BY bar)', 'peak')}, {r('close / max(close) OVER (PARTITION BY symbol ORDER BY bar) - 1', 'drawdown')} FROM b"

Q["w11_adx"] = on_bars(30, lambda d: I.add_adx(d, 14, "adx_14"))
ADX = f"""a1 AS (SELECT *, lag(close) OVER w AS p, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dw FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar)),
a2 AS (SELECT *, greatest(high - low, abs(high - p), abs(low - p)) AS tr, CASE WHEN up > dw AND up > 0 THEN up ELSE 0 END AS pdm,
 CASE WHEN dw > up AND dw > 0 THEN dw ELSE 0 END AS mdm FROM a1),
a3 AS (SELECT *, {frame(14, 'avg(tr)')} AS ta, {frame(14, 'avg(pdm)')} AS pa, {frame(14, 'avg(mdm)')} AS ma FROM a2),
a4 AS (SELECT *, 100 * pa / nullif(ta, 0) AS pdi, 100 * ma / nullif(ta, 0) AS mdi FROM a3),
a5 AS (SELECT *, 100 * abs(pdi - mdi) / (pdi + mdi + 1e-9) AS dx FROM a4),
a6 AS (SELECT *, {frame(14, 'avg(dx)')} AS adx FROM a5)"""
S["w11_adx"] = f"WITH {B}, {ADX} SELECT symbol, bar, {r('adx', 'adx_14')} FROM a6"

Q["w12_macd"] = on_bars(ema_back([span(12), span(26)]), lambda d: I.add_macd(d))
S["w12_macd"] = f"WITH RECURSIVE {B}, {adj_cte('b', 'e', (12, 26))} SELECT symbol, bar, {r('n12 / d12 - n26 / d26', 'macd')} FROM e"

Q["w12b_macd_histogram"] = on_bars(ema_back([span(12), span(26)], ema_back([span(9)])), I.add_macd_histogram)
MACDH = f"""{ema_cte('b', 'm1', [('f', 'close', span(12)), ('s', 'close', span(26))])}, m2 AS (SELECT symbol, bar, f - s AS line FROM m1),
{ema_cte('m2', 'm3', [('sig', 'line', span(9))], first=25)},
mh AS (SELECT m2.symbol, m2.bar, CASE WHEN m2.bar >= 33 THEN line - sig END AS hist FROM m2 LEFT JOIN m3 USING (symbol, bar))"""
S["w12b_macd_histogram"] = f"WITH RECURSIVE {B}, {MACDH} SELECT symbol, bar, {r('hist', 'macd_hist')} FROM mh"

Q["w13_stochastic_williams"] = on_bars(14, lambda d: d.withColumns(dict(zip(("stoch_k", "williams_r"), I.stochastic(14)))))
STO = f"st AS (SELECT *, {frame(14, 'min(low)')} AS lo14, {frame(14, 'max(high)')} AS hi14 FROM b)"
S["w13_stochastic_williams"] = f"WITH {B}, {STO} SELECT symbol, bar, {r('100 * (close - lo14) / (hi14 - lo14 + 1e-9)', 'stoch_k')}, {r('-100 * (hi14 - close) / (hi14 - lo14 + 1e-9)', 'williams_r')} FROM st"

Q["w14_cci"] = on_bars(20, lambda d: I.add_cci(d, 20, "cci_20"))
CCI = f"""c1 AS (SELECT *, (high + low + close) / 3 AS tp FROM b),
c2 AS (SELECT *, {frame(20, 'avg(tp)')} AS m, list(tp) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS win FROM c1),
c3 AS (SELECT *, (tp - m) / (0.015 * (list_sum(list_transform(win, lambda x: abs(x - m))) / 20) + 1e-9) AS cci FROM c2)"""
S["w14_cci"] = f"WITH {B}, {CCI} SELECT symbol, bar, {r('cci', 'cci_20')} FROM c3"


def w15(spark, sf):
    d = core(blocked(bars(spark, sf), back=1).withColumn("prev", I.lag("close")))
    return I.on_balance_volume(d, prev="prev").select("symbol", "bar", "obv")


Q["w15_obv"] = w15
OBV = f"ov AS (SELECT *, sum(coalesce(sign(close - p), 0) * volume) OVER (PARTITION BY symbol ORDER BY bar) AS obv FROM (SELECT *, {lag('close')} AS p FROM b))"
S["w15_obv"] = f"WITH {B}, {OBV} SELECT symbol, bar, {r('obv', 'obv')} FROM ov"


def w16(spark, sf):
    d = blocked(bars(spark, sf), back=20).withColumn("vwap15", I.vwap_rolling(15, 1))
    d = d.withColumn("dev", F.try_divide(F.col("close") - F.col("vwap15"), F.col("vwap15")))
    d = core(d.withColumn("dev_mom", F.col("dev") - I.lag("dev", 2)))
    return I.vwap_cumulative(d).select("symbol", "bar", F.ln("vwap").alias("ln_vwap"), F.ln("vwap15").alias("ln_vwap15"), "dev", "dev_mom")


Q["w16_vwap"] = w16
VW = f"""vw AS (SELECT *, {frame(15, 'sum(pv)', 1)} / nullif({frame(15, 'sum(volume)', 1)}, 0) AS vwap15,
 sum(pv) OVER (PARTITION BY symbol ORDER BY bar) / nullif(sum(volume) OVER (PARTITION BY symbol ORDER BY bar), 0) AS vw0 FROM (SELECT *, close * volume AS pv FROM b)),
vd AS (SELECT *, (close - vwap15) / vwap15 AS dev FROM vw)"""
S["w16_vwap"] = f"WITH {B}, {VW} SELECT symbol, bar, {r('ln(coalesce(vw0, close))', 'ln_vwap')}, {r('ln(vwap15)', 'ln_vwap15')}, {r('dev', 'dev')}, {r('dev - ' + lag('dev', 2), 'dev_mom')} FROM vd"


def w17(d):
    d = d.withColumn("_r", I.pct_change("close"))
    return d.withColumns({"z_close": I.zscore("close", 24), "z_ret": I.zscore("_r", 48, eps=None), "z_vol": I.zscore("volume", 20, 4)})


Q["w17_zscores"] = on_bars(60, w17)


def z(x, n, m=None, eps="+ 1e-9"):
    sd = f"({frame(n, f'stddev_samp({x})', m)})"
    den = f"({sd} {eps})" if eps else f"nullif({sd}, 0)"
    return f"({x} - ({frame(n, f'avg({x})', m)})) / {den}"


S["w17_zscores"] = f"""WITH {B}, q AS (SELECT *, close / {lag('close')} - 1 AS rr FROM b)
SELECT symbol, bar, {r(z('close', 24), 'z_close')}, {r(z('rr', 48, eps=''), 'z_ret')}, {r(z('volume', 20, 4), 'z_vol')} FROM q"""


def w18(d):
    d = d.withColumn("_lr", F.coalesce(I.log_return(), F.lit(0.0)))
    return d.withColumns({"eff_8": I.price_efficiency("_lr", 8, 4), "eff_10": I.price_efficiency("_lr", 10, 10)})


Q["w18_price_efficiency"] = on_bars(16, w18)


def eff(n, m):
    return f"({frame(n, 'sum(lr)', m)}) / (({frame(n, 'sum(abs(lr))', m, x='lr')}) + 1e-9)"


LR = f"lr0 AS (SELECT *, coalesce(ln(close) - ln({lag('close')}), 0) AS lr, close / {lag('close')} - 1 AS rr FROM b)"
S["w18_price_efficiency"] = f"WITH {B}, {LR} SELECT symbol, bar, {r(eff(8, 4), 'eff_8')}, {r(eff(10, 10), 'eff_10')} FROM lr0"

Q["w19_strength_volume"] = lambda s, sf: X.enrich_for_filters(bars(s, sf)).select(
    "symbol", "bar", "volume_ratio", "realized_vol", "trend_strength", "momentum_5", "price_efficiency", "acceleration")
S["w19_strength_volume"] = f"""WITH {B}, {LR}, q AS (SELECT *, close / {lag('close', 5)} - 1 AS mom FROM lr0)
SELECT symbol, bar, {r(f"volume / ({frame(20, 'avg(volume)')})", 'volume_ratio')}, {r(frame(60, 'stddev_samp(rr)', 10), 'realized_vol')},
 {r(z('close', 20, 10), 'trend_strength')}, {r('mom', 'momentum_5')}, {r(eff(8, 4), 'price_efficiency')}, {r('mom - ' + lag('mom'), 'acceleration')} FROM q"""


def w20(d):
    d = d.withColumn("_r", F.coalesce(I.pct_change("close"), F.lit(0.0)))
    sk, ku = I.bias_corrected_moments("_r", 30)
    return d.withColumns({"skew_30": sk, "kurt_30": ku, "vol_20": I.rolling("_r", 20, "std")})


Q["w20_skew_kurtosis"] = on_bars(40, w20)
W29 = "(PARTITION BY symbol ORDER BY bar ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
S["w20_skew_kurtosis"] = f"""WITH {B}, q AS (SELECT symbol, bar, coalesce(close / {lag('close')} - 1, 0) AS x FROM b),
p AS (SELECT *, count(*) OVER {W29} AS n, avg(x) OVER {W29} AS m, list(x) OVER {W29} AS win, {frame(20, 'stddev_samp(x)')} AS v20 FROM q),
k AS (SELECT *, list_sum(list_transform(win, lambda y: (y - m) ** 2)) / n AS m2, list_sum(list_transform(win, lambda y: (y - m) ** 3)) / n AS m3,
 list_sum(list_transform(win, lambda y: (y - m) ** 4)) / n AS m4 FROM p)
SELECT symbol, bar, {r('CASE WHEN n >= 30 THEN m3 / m2 ** 1.5 * sqrt(30.0 * 29) / 28 END', 'skew_30')},
 {r('CASE WHEN n >= 30 THEN ((31 * (m4 / (m2 * m2) - 3) + 6) * 29.0 / (28 * 27)) END', 'kurt_30')}, {r('v20', 'vol_20')} FROM k"""


def w21(spark, sf):
    d = core(blocked(daily(spark, sf), back=20).withColumns({"ret": I.pct_change("close"), "zs": I.zscore("close", 20)}))
    return X.winsorise(d.select("symbol", "bar", "ret", "zs"), ["ret", "zs"])


Q["w21_winsorise"] = w21
S["w21_winsorise"] = f"""WITH {DAILY}, f AS (SELECT symbol, bar, close / {lag('close')} - 1 AS ret, {z('close', 20)} AS zs FROM b),
m AS (SELECT symbol, quantile_cont(ret, 0.5) AS mr, quantile_cont(zs, 0.5) AS mz FROM f GROUP BY 1),
g AS (SELECT f.symbol, bar, coalesce(ret, mr) AS ret, coalesce(zs, mz) AS zs FROM f JOIN m USING (symbol)),
q AS (SELECT symbol, quantile_cont(ret, 0.05) AS rl, quantile_cont(ret, 0.95) AS rh, quantile_cont(zs, 0.05) AS zl, quantile_cont(zs, 0.95) AS zh FROM g GROUP BY 1)
SELECT g.symbol, bar, {r('least(greatest(ret, rl), rh)', 'ret')}, {r('least(greatest(zs, zl), zh)', 'zs')} FROM g JOIN q USING (symbol)"""

Q["w22_stationary"] = lambda s, sf: X.stationary(
    prefix(bars(s, sf), {"cum": ("sum", F.col("close"))}).select("symbol", "bar", "cum", "close", F.least("volume", F.lit(2.0)).alias("two")),
    ["cum", "close", "two"])


def w22_sql():
    parts, outs = [], []
    for c in ("cum", "close", "two"):
        parts.append(f"abs(corr(d_{c}, e_{c})) < abs(corr({c}, p_{c})) * 0.8 AND count(DISTINCT {c}) > 2 AS df_{c}, "
                     f"min({c}) AS mn_{c}, min(d_{c}) AS md_{c}, count(DISTINCT {c}) AS n_{c}")
        v = f"CASE WHEN coalesce(df_{c}, false) THEN d_{c} ELSE {c} END"
        lg = f"n_{c} > 2 AND CASE WHEN coalesce(df_{c}, false) THEN md_{c} ELSE mn_{c} END > 0"
        outs.append(r(f"CASE WHEN {lg} THEN ln(1 + {v}) ELSE {v} END", c))
    lags = ", ".join(f"{c} - {lag(c)} AS d_{c}, {lag(c)} AS p_{c}" for c in ("cum", "close", "two"))
    lag2 = ", ".join(f"{lag('d_' + c)} AS e_{c}" for c in ("cum", "close", "two"))
    return f"""WITH {B}, x0 AS (SELECT symbol, bar, sum(close) OVER (PARTITION BY symbol ORDER BY bar) AS cum, close, least(volume, 2.0) AS two FROM b),
x1 AS (SELECT *, {lags} FROM x0), x2 AS (SELECT *, {lag2} FROM x1), st AS (SELECT symbol, {', '.join(parts)} FROM x2 GROUP BY symbol)
SELECT x2.symbol, bar, {', '.join(outs)} FROM x2 JOIN st USING (symbol)"""


S["w22_stationary"] = w22_sql()

KEEP = ["symbol", "bar"]


def log_vwap(d):
    """Compare the logarithm: volume-weighted prices are short decimals and often end on a rounding boundary."""
    return d.withColumn("ln_vwap", F.ln("vwap"))


Q["w23_basic_pack"] = lambda s, sf: X.basic_pack(bars(s, sf)).select(*KEEP, *X.BASIC)
EB = [(f"ce{w}", "close", span(w)) for w in X.WINDOWS] + [(f"he{w}", "hl", span(w)) for w in X.WINDOWS] + [(f"ve{w}", "volume", span(w)) for w in X.WINDOWS]
BASIC_SQL = f"""{RSI0}, g1 AS (SELECT *, high - low AS hl FROM g), {ema_cte('g1', 'e', EB)}, {ema_cte('g1', 'e1', [('u', 'up', 1 / 14), ('d', 'dn', 1 / 14)], first=1)},
basic AS (SELECT g1.*, e.* EXCLUDE (symbol, bar), e1.u, e1.d, {', '.join(f"close / lag(close, {w}) OVER (PARTITION BY g1.symbol ORDER BY g1.bar) - 1 AS rt{w}" for w in X.WINDOWS)},
 (close - avg(close) OVER z) / (stddev_samp(close) OVER z + 1e-9) AS z24, count(close) OVER z AS n24
 FROM g1 JOIN e ON g1.symbol = e.symbol AND g1.bar = e.bar LEFT JOIN e1 ON g1.symbol = e1.symbol AND g1.bar = e1.bar
 WINDOW z AS (PARTITION BY g1.symbol ORDER BY g1.bar ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""
BASIC_OUT = ", ".join(
    [r(f"coalesce(rt{w}, 0)", f"ret_{w}") for w in X.WINDOWS] + [r(f"ce{w} / close - 1", f"ema_{w}") for w in X.WINDOWS]
    + [r(f"he{w} / close", f"atr_{w}") for w in X.WINDOWS] + [r(f"ve{w}", f"vol_ema_{w}") for w in X.WINDOWS]
    + [r("coalesce(100 - 100 / (1 + u / (d + 1e-9)), 0)", "rsi_14"), r("CASE WHEN n24 >= 24 THEN z24 ELSE 0 END", "zscore_24")])
S["w23_basic_pack"] = f"WITH RECURSIVE {B}, {BASIC_SQL} SELECT symbol, bar, {BASIC_OUT} FROM basic"

Q["w23_momentum_pack"] = lambda s, sf: log_vwap(X.momentum_pack(bars(s, sf))).select(*KEEP, *X.MOMENTUM[:-1], "ln_vwap")
S["w23_momentum_pack"] = f"""WITH RECURSIVE {B}, {ADX}, {adj_cte('b', 'e', (12, 26))}, {STO}, {CCI}, {OBV}, {VW}
SELECT b.symbol, b.bar, {r('coalesce(adx, 0)', 'adx_14')}, {r('n12 / d12 - n26 / d26', 'macd')},
 {r('coalesce(100 * (b.close - lo14) / (hi14 - lo14 + 1e-9), 0)', 'stoch_k')}, {r('coalesce(cci, 0)', 'cci_20')},
 {r('coalesce(-100 * (hi14 - b.close) / (hi14 - lo14 + 1e-9), 0)', 'williams_r')}, {r('obv', 'obv')}, {r('ln(coalesce(vw0, b.close))', 'ln_vwap')}
FROM b JOIN a6 USING (symbol, bar) JOIN e USING (symbol, bar) JOIN st USING (symbol, bar) JOIN c3 USING (symbol, bar) JOIN ov USING (symbol, bar) JOIN vd USING (symbol, bar)"""

Q["w23_full_pack"] = lambda s, sf: log_vwap(X.full_pack(bars(s, sf))).select(*KEEP, *X.BASIC, *X.MOMENTUM[:-1], "ln_vwap")
S["w23_full_pack"] = f"SELECT p.*, m.* EXCLUDE (symbol, bar) FROM ({S['w23_basic_pack']}) p JOIN ({S['w23_momentum_pack']}) m USING (symbol, bar)"

Q["w23_micro_pack"] = lambda s, sf: X.micro_pack(bars(s, sf)).select(*KEEP, *X.MICRO)
MICRO_SQL = f"""{LR}, {VW}, v1 AS (SELECT lr0.*, dev, greatest(high - low, abs(high - p), abs(low - p)) AS tr FROM (SELECT *, {lag('close')} AS p FROM lr0) lr0 JOIN (SELECT symbol, bar, dev FROM vd) USING (symbol, bar)),
v2 AS (SELECT *, coalesce({frame(10, 'stddev_samp(lr)', 6)}, 0.01) AS vol10 FROM v1),
v3 AS (SELECT *, avg(vol10) OVER (PARTITION BY symbol) AS mv, high - low AS hl FROM v2)"""
S["w23_micro_pack"] = f"""WITH {B}, {MICRO_SQL} SELECT symbol, bar, {r(eff(8, 4), 'price_efficiency')}, {r(z('volume', 8, 4), 'volume_anomaly')},
 {r('vol10 / (mv + 1e-9)', 'volatility_regime')}, {r('close * volume / (vol10 + 1e-9)', 'liquidity_score')}, {r(f"close / {lag('close', 5)} - 1", 'momentum_5')},
 {r(f"close / {lag('close', 10)} - 1", 'momentum_10')}, {r(z('close', 20, 10), 'trend_strength')}, {r(f"({frame(10, 'avg(hl)', 6)}) / close", 'high_low_vol')},
 {r('dev', 'dev')}, {r('dev - ' + lag('dev', 2), 'dev_mom')}, {r(frame(14, 'avg(tr)', 7), 'atr')}, {r(f"coalesce({frame(60, 'stddev_samp(rr)', 10)}, 0)", 'realized_vol')} FROM v3"""

Q["w23_light_pack"] = lambda s, sf: X.light_pack(bars(s, sf)).select(*KEEP, *X.LIGHT)
S["w23_light_pack"] = f"""WITH {B}, {LR}, v2 AS (SELECT *, coalesce({frame(10, 'stddev_samp(lr)', 5)}, 0.01) AS vol10 FROM lr0),
v3 AS (SELECT *, avg(vol10) OVER (PARTITION BY symbol) AS mv FROM v2)
SELECT symbol, bar, {r(f"coalesce({eff(10, 10)}, 0.5)", 'price_efficiency')}, {r(f"coalesce({z('volume', 10, 5)}, 0)", 'volume_anomaly')},
 {r('vol10 / (mv + 1e-9)', 'volatility_regime')}, {r('close * volume / (vol10 + 1e-9)', 'liquidity_score')} FROM v3"""


def w24(spark, sf):
    d = X.full_pack(bars(spark, sf))
    have, _ = X.feature_set("fs_core_all_light", d.columns)
    return log_vwap(d.select(*KEEP, *have)).drop("vwap")


Q["w24_feature_set"] = w24
S["w24_feature_set"] = f"SELECT symbol, bar, {', '.join(c for c in X.FEATURE_SETS['fs_core_all_light'] if c != 'atr_14').replace('vwap', 'ln_vwap')} FROM ({S['w23_full_pack']})"


def w25(spark, sf):
    d = bars(spark, sf).withColumn("x", F.when(F.col("bar") % 5 == 2, F.col("close")))
    return carry_forward(d, "x", 1.0).select("symbol", "bar", "x")


Q["w25_forward_fill"] = w25
S["w25_forward_fill"] = f"""WITH {B} SELECT symbol, bar, {r("coalesce(last_value(CASE WHEN bar % 5 = 2 THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar), 1.0)", 'x')} FROM b"""

QUERIES, SQL = Q, S
