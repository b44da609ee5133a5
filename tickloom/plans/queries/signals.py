"""Signals, regimes, filters and selections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.functions import scalars as fx
from tickloom.operators import filters as fl
from tickloom.operators import indicators as I
from tickloom.operators import regimes as rg
from tickloom.operators import signals as sg
from tickloom.operators.blocks import blocked, core
from tickloom.operators.debounce import debounce, debounce_many
from tickloom.operators.ema import span
from tickloom.operators.warmup import with_warmup
from tickloom.plans.inputs import bars, daily, event_signals, price_probability
from tickloom.plans.queries.indicators import LR, MACDH, RSI0, eff, z
from tickloom.plans.queries.sqlbase import DAILY, bars_cte, debounce_cte, ema_cte, frame, lag, r
from tickloom.session import cut, shared_dir
from tickloom.sources.block_store import load_blocks, save_blocks

B = bars_cte()
Q, S = {}, {}

# thresholds lowered against the defaults: the event values are independent draws and rarely trend
TREND = sg.Trend(threshold=0.3, gap=25)
MEANREV = sg.MeanReversion(rsi_low=42.0, rsi_high=58.0, bb_k=1.0, gap=15)
BREAK = sg.Breakout(channel=10, confirm_bars=1, gap=15)
OUT = ["symbol", "bar", "raw_dir", "signal"]

Q["d1_trend_signal"] = lambda s, sf: sg.trend_signal(bars(s, sf), TREND).select(*OUT)
TREND_SQL = f"""tf AS (SELECT *, greatest(high - low, abs(high - coalesce(p, close)), abs(low - coalesce(p, close))) AS trf FROM (SELECT *, {lag('close')} AS p FROM b)),
{ema_cte('tf', 'te', [('f', 'close', span(12)), ('s', 'close', span(48)), ('a', 'trf', span(14))])},
tr AS (SELECT b.symbol, b.bar, CASE WHEN (f - s) / (a + 1e-9) > 0.3 AND close > s THEN 1 WHEN (f - s) / (a + 1e-9) < -0.3 AND close < s THEN -1 ELSE 0 END AS raw_dir
 FROM b JOIN te USING (symbol, bar)), {debounce_cte('tr', 'td', 25)}"""
SIG = "SELECT x.symbol, x.bar, x.raw_dir, y.dir AS signal FROM {} x JOIN {} y USING (symbol, bar)"
S["d1_trend_signal"] = f"WITH RECURSIVE {B}, {TREND_SQL} {SIG.format('tr', 'td')}"

Q["d2_meanrev_signal"] = lambda s, sf: sg.meanrev_signal(bars(s, sf), MEANREV).select(*OUT)
MR_SQL = f"""{RSI0}, {ema_cte('g', 'me', [('u', 'up', 1 / 14), ('d', 'dn', 1 / 14)], first=1)},
mb AS (SELECT *, {frame(20, 'avg(close)')} AS m, {frame(20, 'stddev_pop(close)')} AS sd FROM b),
mr AS (SELECT mb.symbol, mb.bar, CASE WHEN 100 - 100 / (1 + u / (d + 1e-9)) < 42 AND close <= m - sd THEN 1
 WHEN 100 - 100 / (1 + u / (d + 1e-9)) > 58 AND close >= m + sd THEN -1 ELSE 0 END AS raw_dir FROM mb LEFT JOIN me USING (symbol, bar)),
{debounce_cte('mr', 'md', 15)}"""
S["d2_meanrev_signal"] = f"WITH RECURSIVE {B}, {MR_SQL} {SIG.format('mr', 'md')}"

Q["d3_breakout_signal"] = lambda s, sf: sg.breakout_signal(bars(s, sf), BREAK).select(*OUT)
W10 = "(PARTITION BY symbol ORDER BY bar ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
BR_SQL = f"""bk AS (SELECT symbol, bar, CASE WHEN count(*) OVER {W10} >= 10 AND close > max(high) OVER {W10} THEN 1
 WHEN count(*) OVER {W10} >= 10 AND close < min(low) OVER {W10} THEN -1 ELSE 0 END AS raw_dir FROM b), {debounce_cte('bk', 'bd', 15)}"""
S["d3_breakout_signal"] = f"WITH RECURSIVE {B}, {BR_SQL} {SIG.format('bk', 'bd')}"

Q["d3_breakout_confirmed"] = lambda s, sf: sg.breakout_signal(bars(s, sf), sg.Breakout(channel=5, confirm_bars=2, gap=3)).select(*OUT)
W5 = "(PARTITION BY symbol ORDER BY bar ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
S["d3_breakout_confirmed"] = f"""WITH RECURSIVE {B}, k0 AS (SELECT symbol, bar, CASE WHEN count(*) OVER {W5} >= 5 AND close > max(high) OVER {W5} THEN 1
 WHEN count(*) OVER {W5} >= 5 AND close < min(low) OVER {W5} THEN -1 ELSE 0 END AS raw0 FROM b),
bk AS (SELECT symbol, bar, CASE WHEN raw0 = {lag('raw0')} THEN raw0 ELSE 0 END AS raw_dir FROM k0), {debounce_cte('bk', 'bd', 3)} {SIG.format('bk', 'bd')}"""


def d4(spark, sf):
    d = bars(spark, sf).withColumn("raw_dir", F.when(F.col("close") > 300, 1).when(F.col("close") < 180, -1).otherwise(0))
    return debounce(d, 7).select(*OUT)


Q["d4_debounce"] = d4
S["d4_debounce"] = f"""WITH RECURSIVE {B}, x AS (SELECT symbol, bar, CASE WHEN close > 300 THEN 1 WHEN close < 180 THEN -1 ELSE 0 END AS raw_dir FROM b),
{debounce_cte('x', 'y', 7)} {SIG.format('x', 'y')}"""

Q["d5_technical_vote"] = lambda s, sf: sg.technical_vote(bars(s, sf)).select("symbol", "bar", "v_rsi", "v_macd", "v_band", "v_volume", "score", "signal")
S["d5_technical_vote"] = f"""WITH RECURSIVE {B}, {MACDH}, {RSI0}, {ema_cte('g', 'me', [('u', 'up', 1 / 14), ('d', 'dn', 1 / 14)], first=1)},
x AS (SELECT *, {frame(20, 'avg(close)')} AS m, {frame(20, 'stddev_pop(close)')} AS sd, volume / ({frame(20, 'avg(volume)')}) AS vr, close / {lag('close', 5)} - 1 AS ch FROM b),
v AS (SELECT x.symbol, x.bar, CASE WHEN x.bar >= 13 AND 100 - 100 / (1 + u / (d + 1e-9)) < 30 THEN 1.0 WHEN x.bar >= 13 AND 100 - 100 / (1 + u / (d + 1e-9)) > 70 THEN -1.0 ELSE 0.0 END AS v_rsi,
 CASE WHEN hist > 0 THEN 1.0 ELSE -1.0 END AS v_macd,
 CASE WHEN (close - (m - 2 * sd)) / nullif(4 * sd, 0) < 0.2 THEN 1.0 WHEN (close - (m - 2 * sd)) / nullif(4 * sd, 0) > 0.8 THEN -1.0 ELSE 0.0 END AS v_band,
 CASE WHEN vr > 1.5 AND ch > 0.01 THEN 1.0 WHEN vr > 1.5 AND ch < -0.01 THEN -1.0 ELSE 0.0 END AS v_volume
 FROM x LEFT JOIN me USING (symbol, bar) LEFT JOIN mh USING (symbol, bar)),
w AS (SELECT *, round(3 * v_rsi + 3 * v_macd + 2 * v_band + 2 * v_volume) AS ten FROM v)
SELECT symbol, bar, v_rsi::DOUBLE AS v_rsi, v_macd::DOUBLE AS v_macd, v_band::DOUBLE AS v_band, v_volume::DOUBLE AS v_volume, {r('ten / 10', 'score')},
 CASE WHEN abs(ten) > 3 THEN sign(ten)::INT ELSE 0 END AS signal FROM w"""

Q["d6_default_signals"] = lambda s, sf: sg.default_signals(bars(s, sf))
S["d6_default_signals"] = f"""WITH RECURSIVE {B}, {ema_cte('b', 'e', [('f', 'close', span(5)), ('s', 'close', span(25))])},
x AS (SELECT b.symbol, b.ts, b.bar, sign(f - s)::INT AS side FROM b JOIN e USING (symbol, bar))
SELECT symbol, ts, bar, side, 0.75::DOUBLE AS conf FROM (SELECT *, coalesce({lag('side')}, 0) AS p FROM x) WHERE side <> p"""


def with_p(spark, sf):
    return bars(spark, sf).withColumn("p", price_probability())


PB = "pb AS (SELECT *, close / (close + open) AS p FROM b)"
VOL = f"""pv0 AS (SELECT *, close / {lag('close')} - 1 AS rr FROM pb), pv1 AS (SELECT *, nullif({frame(48, 'stddev_samp(rr)')}, 0) AS vol FROM pv0),
pv2 AS (SELECT *, {frame(200, 'quantile_cont(vol, 0.5)', 20)} AS med, {frame(200, 'quantile_cont(vol, 0.2)', 20)} AS q20 FROM pv1)"""


def d7_sql(filters):
    keep = "vol >= q20 AND ((s0 > 0 AND f > s) OR (s0 < 0 AND f < s))" if filters else "true"
    return f"""WITH RECURSIVE {B}, {PB}, {VOL}, {ema_cte('b', 'e', [('f', 'close', span(20)), ('s', 'close', span(60))])},
x AS (SELECT *, CASE WHEN vol >= med THEN 0.60 ELSE 0.55 END AS fl FROM pv2),
y AS (SELECT *, CASE WHEN (CASE WHEN p <= 0.40 THEN 1 - p ELSE p END) >= fl AND p >= 0.55 THEN 1
 WHEN (CASE WHEN p <= 0.40 THEN 1 - p ELSE p END) >= fl AND p <= 0.40 THEN -1 ELSE 0 END AS s0 FROM x),
w AS (SELECT y.*, coalesce(s0 <> 0 AND {keep}, false) AS k FROM y JOIN e USING (symbol, bar))
SELECT symbol, bar, {r('vol', 'vol')}, fl::DOUBLE AS floor, CASE WHEN k THEN s0 ELSE 0 END AS side,
 {r("CASE WHEN k THEN coalesce(least(greatest(1000.0 / (vol * least(greatest(p, 1e-6), 1.0)), 0), 1e6), 0) ELSE 0 END", 'size', 4)} FROM w"""


def d7(filters):
    def run(s, sf):
        d = sg.probability_signal(with_p(s, sf), "p", 0.55, 0.42, use_filters=filters)
        return d.select("symbol", "bar", "vol", "floor", "side", F.round("size", 4).alias("size"))

    return run


Q["d7_probability_signal"] = d7(False)
S["d7_probability_signal"] = d7_sql(False)
Q["p7_volatility_trend_filter"] = d7(True)
S["p7_volatility_trend_filter"] = d7_sql(True)

Q["d7_symmetric_side"] = lambda s, sf: with_p(s, sf).select("symbol", "bar", sg.symmetric_side("p", 0.55).alias("side"))
S["d7_symmetric_side"] = f"WITH {B}, {PB} SELECT symbol, bar, CASE WHEN p > 0.55 THEN 1 WHEN p < 0.45 THEN -1 ELSE 0 END AS side FROM pb"

Q["p8_momentum_entries"] = lambda s, sf: sg.momentum_entries(bars(s, sf)).select("symbol", "bar", "z", "enter_long", "enter_short")
S["p8_momentum_entries"] = f"""WITH RECURSIVE {B}, {ema_cte('b', 'e', [('f', 'close', span(20)), ('s', 'close', span(60))])},
q AS (SELECT b.*, f, s, f - lag(f) OVER (PARTITION BY b.symbol ORDER BY b.bar) AS sl, coalesce(close / lag(close) OVER (PARTITION BY b.symbol ORDER BY b.bar) - 1, 0) AS rr FROM b JOIN e ON b.symbol = e.symbol AND b.bar = e.bar),
x AS (SELECT *, coalesce({z('rr', 48, eps='')}, 0) AS zz, {frame(100, 'quantile_cont(volume, 0.2)')} AS vq FROM q)
SELECT symbol, bar, {r('zz', 'z')}, coalesce(zz >= 1 AND f > s AND sl > 0 AND volume >= vq, false) AS enter_long,
 coalesce(zz <= -1 AND f < s AND sl < 0 AND volume >= vq, false) AS enter_short FROM x"""

# regimes
RP = rg.RegimeParams(trend_threshold=0.25, high_vol_quantile=0.9)
Q["d8_regime"] = lambda s, sf: rg.detect_regime(bars(s, sf), RP).select("symbol", "bar", "regime")


def regime_sql(thr=0.25, q=0.9):
    return f"""rx AS (SELECT *, {frame(14, 'max(high)')} - {frame(14, 'min(low)')} AS rng FROM b), ry AS (SELECT *, rng / (close + 1e-8) AS pct FROM rx),
rz AS (SELECT *, {frame(100, f'quantile_cont(pct, {q})')} AS q0 FROM ry), {ema_cte('b', 're', [('f', 'close', span(12)), ('s', 'close', span(48))])},
rl AS (SELECT *, lag(q0) OVER (PARTITION BY symbol ORDER BY bar) AS ql FROM rz),
rgm AS (SELECT rl.symbol, rl.bar, CASE WHEN pct > ql THEN 'high_vol' WHEN abs(f - s) / (rng + 1e-8) > {thr} THEN 'trend' ELSE 'range' END AS regime FROM rl JOIN re USING (symbol, bar))"""


S["d8_regime"] = f"WITH RECURSIVE {B}, {regime_sql()} SELECT symbol, bar, regime FROM rgm"


def s12_blocks(s, sf):
    """Regimes and a long channel of bars that lie in a block table: two jobs' features from one read without a shuffle."""
    name = f"bars_{uuid.uuid4().hex}"
    back = max(rg.regime_back(RP), 200)
    save_blocks(bars(s, sf), name, back, 8, path=f"{shared_dir(s)}/tickloom/{name}")
    d = load_blocks(s, name, back).withColumns({"lo200": I.rolling("low", 200, "min"), "hi200": I.rolling("high", 200, "max")})
    return core(rg.regime_raw(d, RP)).select("symbol", "bar", "regime", "lo200", "hi200")


Q["s12_stored_blocks"] = s12_blocks
S["s12_stored_blocks"] = f"""WITH RECURSIVE {B}, {regime_sql()} SELECT symbol, bar, regime, {r(frame(200, 'min(low)'), 'lo200')}, {r(frame(200, 'max(high)'), 'hi200')}
FROM (SELECT symbol, bar, regime FROM rgm) JOIN (SELECT symbol, bar, low, high FROM b) USING (symbol, bar)"""

Q["a17_regime_shares"] = lambda s, sf: rg.regime_shares(rg.detect_regime(bars(s, sf), RP))
S["a17_regime_shares"] = f"""WITH RECURSIVE {B}, {regime_sql()} SELECT symbol, {', '.join(f"round(avg((regime = '{n}')::INT) * 100, 2) AS {n}" for n in rg.REGIME_NAMES)} FROM rgm GROUP BY symbol"""

DYN = f"""da AS (SELECT *, abs(({frame(10, 'avg(close)')}) - ({frame(30, 'avg(close)')})) / close AS ts0, hl, ({frame(14, 'avg(hl)')}) / close AS vl,
 (volume - ({frame(20, 'avg(volume)')})) / nullif({frame(20, 'stddev_samp(volume)')}, 0) AS vz, hl / close AS rg FROM (SELECT *, high - low AS hl FROM b))"""


def dyn_labels(src, keys):
    return f"""dc AS (SELECT *, CASE WHEN coalesce(ts0 > qt, false) AND coalesce(vz > 1, false) AND coalesce(rg > qr, false) THEN 'BREAKOUT'
 WHEN coalesce(vl > qv, false) THEN 'VOLATILE' WHEN coalesce(ts0 > qt, false) THEN 'TRENDING' ELSE 'RANGING' END AS regime_raw FROM {src}),
dw AS (SELECT a.symbol, a.bar, a.regime_raw, c.regime_raw AS v, count(*) AS n, max(c.bar) AS latest FROM dc a JOIN dc c ON a.symbol = c.symbol AND c.bar BETWEEN a.bar - 4 AND a.bar GROUP BY 1, 2, 3, 4)
SELECT symbol, bar, any_value(regime_raw) AS regime_raw, arg_max(v, (n, latest)) AS regime FROM dw GROUP BY symbol, bar"""


Q["d9_dynamic_regime_full"] = lambda s, sf: rg.dynamic_regime(bars(s, sf)).select("symbol", "bar", "regime_raw", "regime")
S["d9_dynamic_regime_full"] = f"""WITH {B}, {DYN}, dq AS (SELECT symbol, quantile_cont(ts0, 0.7) AS qt, quantile_cont(vl, 0.8) AS qv, quantile_cont(rg, 0.7) AS qr FROM da GROUP BY 1),
db AS (SELECT * FROM da JOIN dq USING (symbol)), {dyn_labels('db', '')}"""
Q["d9_dynamic_regime_trailing"] = lambda s, sf: rg.dynamic_regime(bars(s, sf), mode="trailing", window=120).select("symbol", "bar", "regime_raw", "regime")
S["d9_dynamic_regime_trailing"] = f"""WITH {B}, {DYN}, db AS (SELECT *, {frame(120, 'quantile_cont(ts0, 0.7)', 30)} AS qt, {frame(120, 'quantile_cont(vl, 0.8)', 30)} AS qv,
 {frame(120, 'quantile_cont(rg, 0.7)', 30)} AS qr FROM da), {dyn_labels('db', '')}"""


def d9b(s, sf):
    d = rg.dynamic_regime(bars(s, sf), mode="trailing", window=120).withColumn("p", price_probability())
    return rg.dynamic_strategy(d).select("symbol", "bar", "th", "mult", "side", "size")


Q["d9_dynamic_strategy"] = d9b
S["d9_dynamic_strategy"] = f"""WITH g AS ({S['d9_dynamic_regime_trailing']}), y AS (WITH {B} SELECT * FROM b),
x AS (SELECT symbol, bar, close / (close + open) AS p, CASE regime WHEN 'TRENDING' THEN 0.52 WHEN 'VOLATILE' THEN 0.55 WHEN 'BREAKOUT' THEN 0.51 ELSE 0.53 END AS th,
 CASE regime WHEN 'TRENDING' THEN 1.2 WHEN 'VOLATILE' THEN 0.5 WHEN 'BREAKOUT' THEN 1.0 ELSE 0.8 END AS mult FROM y JOIN g USING (symbol, bar))
SELECT symbol, bar, th::DOUBLE AS th, mult::DOUBLE AS mult, CASE WHEN p > th THEN 1 WHEN p < 1 - th THEN -1 ELSE 0 END AS side,
 CASE WHEN p > th OR p < 1 - th THEN 10000.0 * mult ELSE 0.0 END::DOUBLE AS size FROM x"""

Q["d10_atr_regime"] = lambda s, sf: rg.atr_regime(bars(s, sf), 14, (0.3, 0.8)).select("symbol", "bar", "atr_pct", "regime", "conf")
S["d10_atr_regime"] = f"""WITH {B}, t AS (SELECT *, greatest(high - low, abs(high - p), abs(low - p)) AS tr FROM (SELECT *, {lag('close')} AS p FROM b)),
x AS (SELECT *, ({frame(14, 'avg(tr)', 7)}) / close AS ap FROM t), m AS (SELECT symbol, avg(ap) AS mu, stddev_pop(ap) AS sd FROM x GROUP BY 1)
SELECT symbol, bar, {r('ap', 'atr_pct')}, CASE WHEN ap > 0 AND ap <= 0.3 THEN 0 WHEN ap > 0.3 AND ap <= 0.8 THEN 1 WHEN ap > 0.8 AND ap <= 1 THEN 2 ELSE 1 END AS regime,
 {r('CASE WHEN ap IS NOT NULL THEN 1 - least(greatest(abs(ap - mu) / nullif(sd, 0), 0), 1) END', 'conf')} FROM x JOIN m USING (symbol)"""

Q["d10_volatility_regime"] = lambda s, sf: rg.volatility_regime(daily(s, sf), 20, 10, (0.6, 0.9)).select("symbol", "bar", "regime")
S["d10_volatility_regime"] = f"""WITH {DAILY}, q AS (SELECT *, close / {lag('close')} - 1 AS rr FROM b), x AS (SELECT *, coalesce({frame(20, 'stddev_samp(rr)', 10)}, 0.01) AS v FROM q)
SELECT symbol, bar, CASE WHEN v >= 0 AND v <= 0.6 THEN 0 WHEN v > 0.6 AND v <= 0.9 THEN 1 WHEN v > 0.9 AND v <= 1 THEN 2 ELSE 1 END AS regime FROM x"""


def routed(s, sf):
    """All three raw directions and the regime from one blocked pass, then one debounce per signal."""
    b = bars(s, sf)
    back = max(sg.TREND_BACK(TREND), sg.MEANREV_BACK(MEANREV), sg.BREAKOUT_BACK(BREAK), rg.regime_back(RP))
    d = blocked(b, back=back)
    d = sg.breakout_raw(sg.meanrev_raw(sg.trend_raw(d, TREND, "r_t"), MEANREV, "r_m"), BREAK, "r_b")
    d = cut(core(rg.regime_raw(d, RP)))  # read for the runs and again for the bars
    d = debounce_many(d, {"signal_trend": ("r_t", TREND.gap), "signal_meanrev": ("r_m", MEANREV.gap),
                          "signal_breakout": ("r_b", BREAK.gap)})
    return sg.route_by_regime(d, use_breakout=True)


Q["d11_regime_routing"] = lambda s, sf: routed(s, sf).select("symbol", "bar", "regime", "signal_trend", "signal_meanrev", "signal_breakout", "signal")
ROUTE = f"""{TREND_SQL}, {MR_SQL}, {BR_SQL}, {regime_sql()}"""
ROUTED = """rt AS (SELECT rgm.symbol, rgm.bar, regime, td.dir AS signal_trend, md.dir AS signal_meanrev, bd.dir AS signal_breakout,
 CASE regime WHEN 'trend' THEN td.dir WHEN 'range' THEN md.dir ELSE bd.dir END AS signal
 FROM rgm JOIN td USING (symbol, bar) JOIN md USING (symbol, bar) JOIN bd USING (symbol, bar))"""
S["d11_regime_routing"] = f"WITH RECURSIVE {B}, {ROUTE}, {ROUTED} SELECT * FROM rt"

# filters
EV = """ev AS (SELECT event_type AS symbol, ts, sign(value - 50)::INT AS side, value / (value + 50) AS conf, value AS score, value / 10 AS atr,
 50 - value / 10 AS spread_bps, user_id % 3 <> 0 AS regime_ok, event_id AS seq FROM events)"""
EVC = "symbol, ts, side, seq, " + r("conf", "conf")


def ev_out(d):
    return d.select("symbol", "ts", "side", "seq", "conf")


Q["p1_date_range"] = lambda s, sf: ev_out(fl.date_range(event_signals(s, sf), "2024-01-05 00:00:00", "2024-01-09 12:00:00"))
S["p1_date_range"] = f"WITH {EV} SELECT {EVC} FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 12:00:00'"


def p1_warmup(s, sf):
    """Features of nine days of January, reading only the bars before them that the features look back to."""
    def feats(d):
        d = blocked(d, back=60).withColumns({"ret_12": I.pct_change("close", 12), "mean_50": I.rolling("close", 50, "mean"), "dev_20": I.rolling("close", 20, "std")})
        return core(d)

    stored = cut(bars(s, sf).drop("bar"))
    out = with_warmup(stored, "2024-01-12 06:00:00", "2024-01-20 12:00:00", 60, feats)
    return out.select("symbol", "ts", "close", "ret_12", "mean_50", "dev_20")


Q["p1_warmup_features"] = p1_warmup
S["p1_warmup_features"] = f"""WITH {B}, x AS (SELECT *, close / nullif({lag('close', 12)}, 0) - 1 AS r12, {frame(50, 'avg(close)')} AS m50, {frame(20, 'stddev_samp(close)')} AS d20 FROM b)
SELECT symbol, ts, {r('close', 'close')}, {r('r12', 'ret_12')}, {r('m50', 'mean_50')}, {r('d20', 'dev_20')} FROM x WHERE ts BETWEEN TIMESTAMP '2024-01-12 06:00:00' AND TIMESTAMP '2024-01-20 12:00:00'"""
Q["p2_session_window"] = lambda s, sf: ev_out(fl.session_window(event_signals(s, sf), "11:10", "18:30", "Europe/Moscow"))
SESS = "strftime(ts + INTERVAL 3 HOUR, '%H:%M:%S') BETWEEN '11:10:00' AND '18:30:00'"
S["p2_session_window"] = f"WITH {EV} SELECT {EVC} FROM ev WHERE {SESS}"
Q["p3_min_confidence"] = lambda s, sf: ev_out(fl.filter_signals(event_signals(s, sf), min_conf=0.65))
S["p3_min_confidence"] = f"WITH {EV} SELECT {EVC} FROM ev WHERE conf >= 0.65"
Q["p4_atr_spread_regime"] = lambda s, sf: ev_out(fl.filter_signals(event_signals(s, sf), min_atr=5.0, max_spread=30.0, use_regime=True))
S["p4_atr_spread_regime"] = f"WITH {EV} SELECT {EVC} FROM ev WHERE atr >= 5 AND spread_bps <= 30 AND regime_ok"
Q["p5_side_normalisation"] = lambda s, sf: fl.normalise_side(event_signals(s, sf).drop("side").withColumn("score", F.col("score") - 120)).select("symbol", "seq", "side")
S["p5_side_normalisation"] = "SELECT event_type AS symbol, event_id AS seq, sign(value - 120)::INT AS side FROM events"
Q["p6_filter_chain"] = lambda s, sf: ev_out(fl.filter_signals(
    event_signals(s, sf), min_conf=0.65, per_day=20, start="11:10", end="18:30", min_atr=5.0, max_spread=30.0, use_regime=True, zone="Europe/Moscow", tie=["seq"]))
TOPD = "row_number() OVER (PARTITION BY symbol, ts::DATE ORDER BY conf DESC, score DESC, ts, seq)"
S["p6_filter_chain"] = f"""WITH {EV}, a AS (SELECT *, {TOPD} AS rk FROM ev WHERE conf >= 0.65)
SELECT {EVC} FROM a WHERE rk <= 20 AND {SESS} AND atr >= 5 AND spread_bps <= 30 AND regime_ok"""
Q["t1_top_k_per_day"] = lambda s, sf: ev_out(fl.top_k_per_day(event_signals(s, sf), 3, tie=["seq"]))
S["t1_top_k_per_day"] = f"WITH {EV} SELECT {EVC} FROM (SELECT *, {TOPD} AS rk FROM ev) WHERE rk <= 3"


def p9(s, sf):
    from tickloom.operators.features import enrich_for_filters

    d = enrich_for_filters(bars(s, sf)).withColumn("signal", F.signum(F.col("close") - F.col("open")))
    return fl.quality_filter(d, min_volume=0.9, max_vol=20.0, min_trend=0.2).select("symbol", "bar", "signal")


Q["p9_quality_filter"] = p9
S["p9_quality_filter"] = f"""WITH {B}, {LR}, q AS (SELECT *, close / {lag('close', 5)} - 1 AS mom, volume / ({frame(20, 'avg(volume)')}) AS vr,
 {frame(60, 'stddev_samp(rr)', 10)} AS rv, {z('close', 20, 10)} AS tsn, {eff(8, 4)} AS ef, sign(close - open) AS signal FROM lr0)
SELECT symbol, bar, signal::DOUBLE AS signal FROM q WHERE abs(signal) >= 0.3 AND coalesce(vr, 1) > 0.9 AND coalesce(rv, 0) < 20 AND abs(coalesce(tsn, 0)) > 0.2
 AND abs(coalesce(mom, 0)) > 0.001 AND coalesce(ef, 0) > -0.8"""

Q["p10_mid_volatility"] = lambda s, sf: fl.mid_volatility(bars(s, sf)).select("symbol", "bar", "vol20", "volume_ok", "volatility_ok")
S["p10_mid_volatility"] = f"""WITH {B}, q AS (SELECT *, close / {lag('close')} - 1 AS rr FROM b), x AS (SELECT *, {frame(20, 'stddev_samp(rr)')} AS v, {frame(20, 'avg(volume)')} AS vm FROM q),
m AS (SELECT symbol, quantile_cont(v, 0.3) AS lo, quantile_cont(v, 0.7) AS hi FROM x GROUP BY 1)
SELECT symbol, bar, {r('v', 'vol20')}, coalesce(volume > vm * 1.3, false) AS volume_ok, coalesce(v BETWEEN lo AND hi, false) AS volatility_ok FROM x JOIN m USING (symbol)"""

Q["p11_confidence_floor"] = lambda s, sf: sg.probability_signal(with_p(s, sf), "p", 0.55, 0.42, sg.Risk(vol_lb=20), use_filters=False).select("symbol", "bar", "floor", "side")
S["p11_confidence_floor"] = f"SELECT symbol, bar, floor, side FROM ({S['d7_probability_signal']})".replace(
    frame(48, "stddev_samp(rr)"), frame(20, "stddev_samp(rr)"))


def p12(s, sf):
    rows = []
    for tl, ts in ((0.52, 0.48), (0.7, 0.3), (0.56, 0.55), (None, None)):
        lo, sh = sg.thresholds(tl, ts)
        rows.append(F.struct(F.lit(f"{tl}/{ts}").alias("asked"), F.lit(lo).alias("lo"), F.lit(sh).alias("sh")))
    d = with_p(s, sf).withColumn("g", F.explode(F.array(*rows)))
    side = F.when(F.col("p") >= F.col("g.lo"), 1).when(F.col("p") <= F.col("g.sh"), -1).otherwise(0)
    return d.groupBy("symbol", F.col("g.asked").alias("asked")).agg(
        F.max("g.lo").alias("lo"), F.max("g.sh").alias("sh"), F.count_if(side > 0).alias("n_long"), F.count_if(side < 0).alias("n_short"))


Q["p12_thresholds"] = p12
S["p12_thresholds"] = f"""WITH {B}, {PB}, g(asked, lo, sh) AS (VALUES ('0.52/0.48', 0.55, 0.40), ('0.7/0.3', 0.7, 0.3), ('0.56/0.55', 0.56, 0.40), ('None/None', 0.55, 0.0))
SELECT symbol, asked, lo::DOUBLE AS lo, sh::DOUBLE AS sh, count_if(p >= lo) AS n_long, count_if(p <= sh) AS n_short FROM pb, g GROUP BY ALL"""


def p13(s, sf):
    ticks_ = F.create_map(*[x for k, v in {"click": 0.5, "error": 0.25, "purchase": 1.0, "signup": 0.1, "view": 0.05}.items() for x in (F.lit(k), F.lit(v))])
    d = bars(s, sf).withColumn("tick", ticks_[F.col("symbol")]).withColumn("side", F.when(F.col("close") > F.col("open"), 1).otherwise(-1))
    d = d.withColumn("n_ticks", fx.slippage_ticks(F.col("volume") > 2))
    return d.select("symbol", "bar", "n_ticks", fx.round_to_tick("close", "tick").alias("rounded"), fx.adverse_price("close", "side", "tick", "n_ticks").alias("fill"))


Q["p13_tick_rounding"] = p13
S["p13_tick_rounding"] = f"""WITH {B}, t(symbol, tick) AS (VALUES ('click', 0.5::DOUBLE), ('error', 0.25::DOUBLE), ('purchase', 1.0::DOUBLE), ('signup', 0.1::DOUBLE), ('view', 0.05::DOUBLE)),
x AS (SELECT *, CASE WHEN close > open THEN 1 ELSE -1 END AS side, CASE WHEN volume > 2 THEN 1 ELSE 3 END AS n_ticks FROM b JOIN t USING (symbol))
SELECT symbol, bar, n_ticks, {r('round_even(close / tick, 0) * tick', 'rounded')}, {r('round_even((close + side * n_ticks * tick) / tick, 0) * tick', 'fill')} FROM x"""


def sizes(s, sf):
    d = blocked(with_p(s, sf), back=60)
    d = I.add_atr(sg.add_realized_vol(d, 20, "vol"), 14, "mean", "atr").withColumn("trend", I.zscore("close", 20, 10))
    d = core(d)
    sig = F.col("p") - 0.5
    return d.select(
        "symbol", "bar", F.round(fx.risk_notional("vol", "p"), 4).alias("notional"),
        fx.cap_leverage(fx.atr_quantity("atr", 1e6, 0.0015, 1.5), "close", 1e6).alias("qty"),
        fx.vol_target_weight(sig, "vol").alias("weight"), fx.strength_size(sig, "trend", "vol", F.lit(0.8)).alias("share"),
        fx.strength_size(sig, "trend", "vol", F.lit(0.8), base=0.02, boost=0.3, vol_floor=0.015, cap=0.06).alias("share2"),
    )


Q["p14_p17_position_sizes"] = sizes
S["p14_p17_position_sizes"] = f"""WITH {B}, {PB}, t AS (SELECT *, greatest(high - low, abs(high - c1), abs(low - c1)) AS tr, close / c1 - 1 AS rr FROM (SELECT *, {lag('close')} AS c1 FROM pb)),
x AS (SELECT *, nullif({frame(20, 'stddev_samp(rr)')}, 0) AS vol, {frame(14, 'avg(tr)')} AS atr, {z('close', 20, 10)} AS trend, p - 0.5 AS sig FROM t)
SELECT symbol, bar, {r('CASE WHEN vol IS NOT NULL THEN least(greatest(1000 / (vol * p), 0), 1e6) END', 'notional', 4)},
 {r('least(CASE WHEN atr > 0 THEN 1500.0 / (atr * 1.5) ELSE 1.0 END, 3e6 / close)', 'qty')},
 {r('CASE WHEN vol > 0 THEN least(greatest(sig * (0.02 / sqrt(30)) / vol, -0.5), 0.5) ELSE 0 END', 'weight')},
 {r('least(0.015 * (1 + least(abs(coalesce(trend, 0)) * 0.5, 0.5)) * (0.02 / greatest(coalesce(vol, 0.02), 0.01)) * 0.8 * abs(sig), 0.08)', 'share')},
 {r('least(0.02 * (1 + least(abs(coalesce(trend, 0)) * 0.3, 0.3)) * (0.02 / greatest(coalesce(vol, 0.02), 0.015)) * 0.8 * abs(sig), 0.06)', 'share2')} FROM x"""


def p18(s, sf):
    d = bars(s, sf)
    return d.select("symbol", "bar", fx.safe_divide("close", F.col("high") - F.col("low"), 0.0).alias("ratio"),
                    fx.finite(F.try_divide(F.lit(1.0), F.col("open") - F.col("close"))).alias("inv"))


Q["p18_safe_divide"] = p18
S["p18_safe_divide"] = f"WITH {B} SELECT symbol, bar, {r('CASE WHEN high - low <> 0 THEN close / (high - low) ELSE 0 END', 'ratio')}, {r('1 / nullif(open - close, 0)', 'inv')} FROM b"

Q["p20_probability_gate"] = lambda s, sf: fl.probability_gate(with_p(s, sf).withColumn("p", F.when(F.col("bar") % 7 != 0, F.col("p")))).select("symbol", "bar", "p")
S["p20_probability_gate"] = f"WITH {B}, {PB}, x AS (SELECT symbol, bar, CASE WHEN bar % 7 <> 0 THEN p END AS p FROM pb) SELECT symbol, bar, {r('p', 'p')} FROM x WHERE coalesce(p, 1) > 0.55"

Q["t6_last_rows"] = lambda s, sf: fl.last_rows(bars(s, sf), 3).select("symbol", "ts", "bar", "close")
S["t6_last_rows"] = f"WITH {B}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM b) SELECT symbol, ts, bar, {r('close', 'close')} FROM x WHERE k <= 3"

Q["w27_majority"] = lambda s, sf: core(blocked(bars(s, sf).withColumn("lab", F.when(F.col("close") > 300, "hi").when(F.col("close") < 150, "lo").otherwise("mid")), back=5)
                                      .withColumn("smooth", I.majority("lab", 5))).select("symbol", "bar", "lab", "smooth")
S["w27_majority"] = f"""WITH {B}, dc AS (SELECT symbol, bar, CASE WHEN close > 300 THEN 'hi' WHEN close < 150 THEN 'lo' ELSE 'mid' END AS lab FROM b),
dw AS (SELECT a.symbol, a.bar, a.lab, c.lab AS v, count(*) AS n, max(c.bar) AS latest FROM dc a JOIN dc c ON a.symbol = c.symbol AND c.bar BETWEEN a.bar - 4 AND a.bar GROUP BY 1, 2, 3, 4)
SELECT symbol, bar, any_value(lab) AS lab, arg_max(v, (n, latest)) AS smooth FROM dw GROUP BY symbol, bar"""

QUERIES, SQL = Q, S
