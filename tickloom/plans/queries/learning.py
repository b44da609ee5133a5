"""Folds, thresholds, model quality and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import features as X
from tickloom.operators import labels as lb
from tickloom.operators import metrics as mx
from tickloom.operators import regimes as rg
from tickloom.operators.filters import probability_gate
from tickloom.plans import folds as fo
from tickloom.plans import learning as ml
from tickloom.plans.fold_table import fold_rows
from tickloom.plans.inputs import bars, daily, price_probability
from tickloom.plans.queries.indicators import LR, VW, eff, z
from tickloom.plans.queries.sqlbase import DAILY, bars_cte, frame, r
from tickloom.session import cut

B = bars_cte()
Q, S = {}, {}


def scored(s, sf):
    """Bars with a stand-in probability, the next-bar direction and the same-bar return."""
    d = lb.add_labels(bars(s, sf), 1)
    from tickloom.operators import indicators as I
    from tickloom.operators.blocks import blocked, core

    d = core(blocked(d, back=1).withColumn("ret", I.pct_change("close")))
    return d.withColumns({"p": F.round(price_probability(), 3), "label": F.col("y_up")})


SC = f"sc AS (SELECT symbol, bar, round(close / (close + open), 3) AS p, (lead(close) OVER w > close)::INT AS label, close / lag(close) OVER w - 1 AS ret FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar))"

Q["a22_auc"] = lambda s, sf: mx.auc(scored(s, sf), keys=["symbol"])
S["a22_auc"] = f"""WITH {B}, {SC}, k AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2 AS rk FROM sc WHERE label IS NOT NULL)
SELECT symbol, sum(label)::BIGINT AS n_pos, count(*) - sum(label)::BIGINT AS n_neg, {r('(sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label)))', 'auc')} FROM k GROUP BY 1"""
Q["a22_auc_overall"] = lambda s, sf: mx.auc(scored(s, sf))
S["a22_auc_overall"] = S["a22_auc"].replace("PARTITION BY symbol, p", "PARTITION BY p").replace("PARTITION BY symbol ORDER BY p", "ORDER BY p").replace("SELECT symbol, sum(label)", "SELECT sum(label)").replace(" FROM k GROUP BY 1", " FROM k")

TH = [round(0.45 + 0.02 * i, 2) for i in range(15)]
F1 = f"""t(th) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in TH)}), f AS (SELECT symbol, th, coalesce(2.0 * count_if(p >= th AND label = 1) / nullif(count_if(p >= th) + count_if(label = 1), 0), 0) AS f1 FROM sc, t WHERE label IS NOT NULL GROUP BY 1, 2)"""
Q["a23_f1_by_threshold"] = lambda s, sf: mx.f1_by_threshold(scored(s, sf))
S["a23_f1_by_threshold"] = f"WITH {B}, {SC}, {F1} SELECT symbol, th AS threshold, {r('f1', 'f1')} FROM f"
Q["a23_best_threshold"] = lambda s, sf: mx.best_f1(scored(s, sf))
S["a23_best_threshold"] = f"WITH {B}, {SC}, {F1} SELECT symbol, arg_max(th, (round(f1, 12), -th)) AS threshold, {r('max(f1)', 'f1')} FROM f GROUP BY 1"

Q["a24_profit_thresholds"] = lambda s, sf: mx.profit_thresholds(scored(s, sf))
S["a24_profit_thresholds"] = f"""WITH {B}, {SC}, l AS (SELECT unnest(range(19)) AS i), g AS (SELECT round(0.52 + 0.01 * a.i, 2)::DOUBLE AS tl, round(0.30 + 0.01 * c.i, 2)::DOUBLE AS ts_ FROM l a, l c),
m AS (SELECT symbol, tl, ts_, count(*) AS n, sum(CASE WHEN p >= tl THEN 1 WHEN p <= ts_ THEN -1 ELSE 0 END * coalesce(ret, 0)) / count(*) AS score FROM sc, g GROUP BY 1, 2, 3)
SELECT symbol, any_value(n) AS n, arg_max(tl, (round(score, 10), -tl, -ts_)) AS th_long, arg_max(ts_, (round(score, 10), -tl, -ts_)) AS th_short, {r('max(score)', 'score')} FROM m GROUP BY 1"""


def a21(s, sf):
    d = X.light_pack(bars(s, sf)).withColumn("p", price_probability())
    return mx.feature_correlations(d, [*X.LIGHT, "close", "open", "volume"], "p", 3, ["symbol"])


Q["a21_feature_correlations"] = a21
S["a21_feature_correlations"] = f"""WITH {B}, {LR}, v2 AS (SELECT *, coalesce({frame(10, 'stddev_samp(lr)', 5)}, 0.01) AS vol10, close / (close + open) AS p FROM lr0),
v3 AS (SELECT *, coalesce({eff(10, 10)}, 0.5) AS pe, coalesce({z('volume', 10, 5)}, 0) AS va FROM v2),
c AS (SELECT symbol, abs(corr(pe, p)) AS price_efficiency, abs(corr(va, p)) AS volume_anomaly, abs(corr(vol10, p)) AS volatility_regime, abs(corr(close * volume / (vol10 + 1e-9), p)) AS liquidity_score,
 abs(corr(close, p)) AS close, abs(corr(open, p)) AS open, abs(corr(volume, p)) AS volume FROM v3 GROUP BY 1),
u AS (UNPIVOT c ON COLUMNS(* EXCLUDE symbol) INTO NAME feature VALUE abs_corr)
SELECT symbol, feature, {r('abs_corr', 'abs_corr')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs_corr DESC) AS k FROM u) WHERE k <= 3"""

Q["a25_class_weights"] = lambda s, sf: mx.class_weights(lb.add_labels(bars(s, sf), 6, 0.3, 1.0).filter("y_adaptive is not null").withColumn("label", F.col("y_adaptive")))
S["a25_class_weights"] = f"""WITH {B}, f0 AS (SELECT *, lead(close, 6) OVER w / close - 1 AS fr, close / lag(close) OVER w - 1 AS rr FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar)),
l AS (SELECT *, coalesce({frame(20, 'stddev_samp(rr)')}, 0.01) AS th FROM f0), y AS (SELECT CASE WHEN fr > th THEN 1 WHEN fr < -th THEN -1 ELSE 0 END AS label FROM l WHERE fr IS NOT NULL)
SELECT label, count(*) AS n_c, {r('(SELECT count(*) FROM y) / ((SELECT count(DISTINCT label) FROM y) * count(*))', 'weight')} FROM y GROUP BY label"""

# folds
ROLE = "symbol, fold, role, count(*) AS n, min(bar) AS first_bar, max(bar) AS last_bar"


def fold_report(d):
    return d.groupBy("symbol", "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar"))


Q["d22_month_folds"] = lambda s, sf: fold_report(fo.month_folds(daily(s, sf).select("symbol", "ts", "bar"), 6, purge=3))
S["d22_month_folds"] = f"""WITH {DAILY}, m AS (SELECT *, dense_rank() OVER (ORDER BY date_trunc('month', ts)) - 1 AS rk FROM b), n AS (SELECT least(6, greatest(max(rk), 1)) AS k FROM m),
x AS (SELECT symbol, bar, unnest(range(rk, (SELECT k FROM n))) AS fold, 'train' AS role FROM m UNION ALL SELECT symbol, bar, rk - 1, 'test' FROM m WHERE rk >= 1 AND rk <= (SELECT k FROM n)),
t AS (SELECT symbol, fold, min(bar) AS t0 FROM x WHERE role = 'test' GROUP BY 1, 2)
SELECT x.symbol, x.fold::INT AS fold, role, count(*) AS n, min(bar) AS first_bar, max(bar) AS last_bar FROM x LEFT JOIN t ON x.symbol = t.symbol AND x.fold = t.fold WHERE role = 'test' OR t0 IS NULL OR bar + 3 < t0 GROUP BY 1, 2, 3"""
Q["d22_rolling_folds"] = lambda s, sf: fold_report(fo.rolling_folds(bars(s, sf).select("symbol", "ts", "bar"), 400, 100, 150, purge=6))
S["d22_rolling_folds"] = f"""WITH {B}, n AS (SELECT symbol, max(bar) AS mx FROM b GROUP BY 1), f AS (SELECT symbol, unnest(range(0, mx // 150 + 1)) AS fold, mx FROM n),
g AS (SELECT * FROM f WHERE fold * 150 + 400 <= mx),
x AS (SELECT b.symbol, bar, fold, CASE WHEN bar < fold * 150 + 400 THEN 'train' ELSE 'test' END AS role FROM b JOIN g ON b.symbol = g.symbol AND bar >= fold * 150 AND bar < fold * 150 + 500)
SELECT symbol, fold::INT AS fold, role, count(*) AS n, min(bar) AS first_bar, max(bar) AS last_bar FROM x WHERE role = 'test' OR bar + 6 < fold * 150 + 400 GROUP BY 1, 2, 3"""
Q["d22_table_function"] = lambda s, sf: fold_report(fold_rows(bars(s, sf).select("symbol", "ts", "bar"), 400, 100, 150, purge=6))
S["d22_table_function"] = S["d22_rolling_folds"]
Q["d22_split_folds"] = lambda s, sf: fold_report(fo.split_folds(bars(s, sf).select("symbol", "ts", "bar"), 3))
S["d22_split_folds"] = f"""WITH {B}, n AS (SELECT symbol, count(*) AS n, count(*) // 4 AS w FROM b GROUP BY 1), f AS (SELECT *, unnest(range(0, 3)) AS fold FROM n),
x AS (SELECT b.symbol, bar, fold, CASE WHEN bar < n - (3 - fold) * w THEN 'train' WHEN bar < n - (3 - fold) * w + w THEN 'test' END AS role FROM b JOIN f USING (symbol))
SELECT symbol, fold::INT AS fold, role, count(*) AS n, min(bar) AS first_bar, max(bar) AS last_bar FROM x WHERE role IS NOT NULL GROUP BY 1, 2, 3"""


def d27(drop):
    def run(s, sf):
        d = lb.add_labels(X.micro_pack(bars(s, sf)), 6, 0.3)
        t = lb.training_set(d, X.MICRO, "y_up", drop)
        return t.groupBy("symbol", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("dev_mom").alias("dev_mom"), F.min("bar").alias("first_bar"), F.avg("momentum_10").alias("momentum_10"))

    return run


D27 = f"""{LR}, {VW}, v1 AS (SELECT lr0.*, vd.dev, vd.dev - lag(vd.dev, 2) OVER w AS dm, lr0.close / lag(lr0.close, 10) OVER w - 1 AS m10, (lead(lr0.close, 6) OVER w / lr0.close - 1 > 0)::INT AS y,
 count(lr0.bar) OVER (PARTITION BY lr0.symbol ORDER BY lr0.bar ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS k FROM lr0 JOIN vd ON lr0.symbol = vd.symbol AND lr0.bar = vd.bar WINDOW w AS (PARTITION BY lr0.symbol ORDER BY lr0.bar))"""
Q["d27_training_set_drop"] = d27(True)
S["d27_training_set_drop"] = f"WITH {B}, {D27} SELECT symbol, y::DOUBLE AS label, count(*) AS n, {r('avg(dm)', 'dev_mom')}, min(bar) AS first_bar, {r('avg(m10)', 'momentum_10')} FROM v1 WHERE y IS NOT NULL AND bar >= 10 GROUP BY 1, 2"
Q["d27_training_set_zero"] = d27(False)
S["d27_training_set_zero"] = f"WITH {B}, {D27} SELECT symbol, y::DOUBLE AS label, count(*) AS n, {r('avg(coalesce(dm, 0))', 'dev_mom')}, min(bar) AS first_bar, {r('avg(coalesce(m10, 0))', 'momentum_10')} FROM v1 WHERE y IS NOT NULL GROUP BY 1, 2"


# models: numbers depend on the solver, so these have no SQL; tests check their properties
FEATS = ["ret_3", "ret_12", "ema_12", "ema_48", "rsi_14", "zscore_24"]


def labelled(s, sf):
    d = ml.volatility_state(X.basic_pack(bars(s, sf)))
    return lb.add_labels(d, 3).withColumn("label", F.col("y_up").cast("double"))


def d24(s, sf):
    d = cut(labelled(s, sf).filter("label is not null"))
    model = ml.fit_blend(d, FEATS, balanced=True)
    return ml.tree_importances(model.forest, FEATS, d)


def d25(s, sf):
    d = cut(labelled(s, sf))
    model = ml.fit_blend(d.filter("label is not null"), FEATS)
    return ml.score_blend(model, d).select("symbol", "ts", "bar", "p_base", "p_forest", "volatile", "p")


def d25_regime(s, sf):
    d = rg.volatility_regime(X.light_pack(bars(s, sf)), edges=(0.6, 0.9))
    d = cut(lb.add_labels(d, 6, 0.3).withColumn("label", F.col("y_move")))
    reg, val = ml.fit_regime_and_validator(d.filter("label is not null"), X.LIGHT)
    out = ml.class_and_confidence(reg, d.drop("regime", "label"), "regime", "conf")
    return probability_gate(ml.probability(val, out, "p"), "p").select("symbol", "ts", "bar", "regime", "conf", "p")


def d23(s, sf):
    d = labelled(s, sf).filter("label is not null")
    return ml.walk_forward(fo.split_folds(d, 3), FEATS)


def d24_compare(s, sf):
    d = labelled(s, sf).filter("label is not null").select("symbol", "bar", *FEATS, "label")
    return ml.compare_models(fo.split_folds(d, 2), FEATS, ("logistic", "forest", "boosting"), {"logistic": [dict(regParam=0.01), dict(regParam=0.1)], "boosting": [dict(maxIter=5)]})


def d21(s, sf):
    d = lb.add_labels(X.full_pack(bars(s, sf)), 1).withColumn("label", F.col("y_up").cast("double")).filter("label is not null")
    d = fo.split_folds(d, 2).filter("fold = 1")
    return ml.feature_set_sweep(d).select("symbol", "feature_set", "n_features", "missing", "trade_count", "total_return", "max_drawdown", "score")


def d26(s, sf):
    d = cut(labelled(s, sf).filter("label is not null"))
    model = ml.pipeline(FEATS, "logistic").fit(d.select(*FEATS, "label"))
    return ml.permutation_importance(model, d.select("symbol", "bar", *FEATS, "label"), FEATS, n=2)


def d23_fixed(s, sf):
    """Folds and their quality for a given probability: walk-forward without the fits."""
    d = lb.add_labels(bars(s, sf), 3).filter("y_up is not null").select("symbol", "bar", "close", "open", F.col("y_up").cast("double").alias("label"))
    return ml.fold_quality(fo.split_folds(d, 3).filter("role = 'test'").select("fold", price_probability().alias("p"), "label"))


Q["d23_fixed_score"] = d23_fixed
S["d23_fixed_score"] = f"""WITH {B}, l AS (SELECT symbol, bar, close / (close + open) AS p, (lead(close, 3) OVER (PARTITION BY symbol ORDER BY bar) / close - 1 > 0)::INT AS label FROM b),
d AS (SELECT * FROM l WHERE label IS NOT NULL), n AS (SELECT symbol, max(bar) + 1 AS n, (max(bar) + 1) // 4 AS w FROM d GROUP BY 1), f AS (SELECT *, unnest(range(0, 3)) AS fold FROM n),
x AS (SELECT fold, p, label FROM d JOIN f USING (symbol) WHERE bar >= n - (3 - fold) * w AND bar < n - (3 - fold) * w + w),
k AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2 AS rk FROM x)
SELECT fold::INT AS fold, count(*) AS rows, sum(label)::BIGINT AS n_pos, {r('(sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label)))', 'auc')},
 {r('sum(greatest(p - 0.5, 0) * CASE WHEN label = 1 THEN 1 ELSE -1 END)', 'pseudo_return')} FROM k GROUP BY 1"""


def d26_fixed(s, sf):
    """Permutation loss of a fixed linear score: every step but a fit, so SQL can check it."""
    d = lb.add_labels(bars(s, sf), 1).filter("y_up is not null")
    d = d.select("symbol", "bar", F.coalesce(F.try_divide("close", "open") - 1, F.lit(0.0)).alias("gain"), (F.col("high") - F.col("low")).alias("spread"),
                 F.col("y_up").cast("double").alias("label"))
    linear = lambda x: x.withColumn("p", F.col("gain") + 0.001 * F.col("spread"))
    return ml.permutation_importance(None, d, ["gain", "spread"], n=2, score=linear)


Q["d26_fixed_score"] = d26_fixed
S["d26_fixed_score"] = f"""WITH {B}, l AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY bar) AS nx FROM b),
d AS (SELECT symbol, bar, coalesce(close / nullif(open, 0) - 1, 0) AS gain, high - low AS spread, (nx > close)::INT AS label FROM l WHERE nx IS NOT NULL),
k(feature, round) AS (VALUES ('gain', 0), ('gain', 1), ('spread', 0), ('spread', 1)),
o AS (SELECT k.*, d.*, row_number() OVER (PARTITION BY feature, round ORDER BY md5(concat_ws('|', (42 + 101 * round)::VARCHAR, symbol, bar::VARCHAR)), symbol, bar) - 1 AS rk FROM d, k),
t AS (SELECT x.feature, x.round, x.label, CASE WHEN x.feature = 'gain' THEN y.gain ELSE x.gain END + 0.001 * CASE WHEN x.feature = 'spread' THEN y.spread ELSE x.spread END AS p
 FROM o x JOIN o y ON x.feature = y.feature AND x.round = y.round AND x.rk = (y.rk + 1) % (SELECT count(*) FROM d)
 UNION ALL SELECT '', 0, label, gain + 0.001 * spread FROM d),
r AS (SELECT *, rank() OVER (PARTITION BY feature, round ORDER BY p) + (count(*) OVER (PARTITION BY feature, round, p) - 1) / 2 AS rnk FROM t),
a AS (SELECT feature, round, (sum(rnk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS auc FROM r GROUP BY 1, 2)
SELECT feature, {r("(SELECT auc FROM a WHERE feature = '') - avg(auc)", 'auc_loss')} FROM a WHERE feature <> '' GROUP BY 1"""

Q["d24_fit_importances"] = d24
Q["d24_compare_models"] = d24_compare
Q["d25_blended_scores"] = d25
Q["d25_regime_and_gate"] = d25_regime
Q["d23_walk_forward"] = d23
Q["d21_feature_set_sweep"] = d21
Q["d26_permutation_importance"] = d26

QUERIES, SQL = Q, S
