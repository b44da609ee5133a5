import numpy as np
import pandas as pd
import pytest
from helpers import debounce_loop, to_pandas, walk
from pyspark.sql import functions as F

from tickloom.operators import features as X
from tickloom.operators import filters as fl
from tickloom.operators import indicators as I
from tickloom.operators import regimes as rg
from tickloom.operators import signals as sg
from tickloom.operators.blocks import blocked, core
from tickloom.operators.debounce import debounce_many
from tickloom.operators.ema import span


def ewm(s, n):
    return s.ewm(span=n, adjust=False).mean()


def test_trend_signal_equals_pandas(spark):
    pdf = walk(n=700)
    p = sg.Trend(threshold=0.8, gap=9)
    out = to_pandas(sg.trend_signal(spark.createDataFrame(pdf), p))
    for s, g in pdf.groupby("symbol"):
        prev = g.close.shift(1).bfill()
        tr = pd.concat([g.high - g.low, (g.high - prev).abs(), (g.low - prev).abs()], axis=1).max(axis=1)
        strength = (ewm(g.close, 12) - ewm(g.close, 48)) / (ewm(tr, 14) + 1e-9)
        slow = ewm(g.close, 48)
        raw = np.where((strength > 0.8) & (g.close > slow), 1, np.where((strength < -0.8) & (g.close < slow), -1, 0))
        o = out[out.symbol == s]
        assert o.raw_dir.tolist() == raw.tolist()
        assert o.signal.tolist() == debounce_loop(raw.tolist(), 9)
        assert len(set(raw)) == 3


def test_several_signals_in_one_pass(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"symbol": ["A"] * 500 + ["B"] * 90, "bar": [*range(500), *range(90)],
                        "a": rng.integers(-1, 2, 590), "b": np.repeat(rng.integers(-1, 2, 59), 10), "c": rng.integers(-1, 2, 590)})
    out = to_pandas(debounce_many(spark.createDataFrame(pdf), {"x": ("a", 7), "y": ("b", 15), "z": ("c", 1)}, size=64))
    for s, g in pdf.groupby("symbol"):
        o = out[out.symbol == s]
        assert o.x.tolist() == debounce_loop(g.a.tolist(), 7)
        assert o.y.tolist() == debounce_loop(g.b.tolist(), 15)
        assert o.z.tolist() == g.c.tolist()


def test_features_do_not_see_the_future(spark):
    pdf = walk(n=260)
    full = to_pandas(X.full_pack(spark.createDataFrame(pdf)))
    part = to_pandas(X.full_pack(spark.createDataFrame(pdf[pdf.bar < 150])))
    both = full[full.bar < 150].reset_index(drop=True)
    for c in X.BASIC + X.MOMENTUM:
        np.testing.assert_allclose(part[c].astype(float), both[c].astype(float), rtol=1e-9, atol=1e-12, err_msg=c)


def test_result_does_not_depend_on_partitions(spark):
    pdf = walk(("A", "B", "C"), 200)
    a = to_pandas(rg.detect_regime(spark.createDataFrame(pdf).repartition(1)))
    b = to_pandas(rg.detect_regime(spark.createDataFrame(pdf).repartition(7)))
    assert a.regime.tolist() == b.regime.tolist()


def test_full_pack_against_pandas(spark):
    pdf = walk(n=300, symbols=("A",))
    out = to_pandas(X.full_pack(spark.createDataFrame(pdf)))
    c = pdf.close
    np.testing.assert_allclose(out.ema_48, ewm(c, 48) / c - 1, rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(out.atr_24, ewm(pdf.high - pdf.low, 24) / c, rtol=1e-9)
    d = c.diff()
    up, dn = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean(), (-d.clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean()
    np.testing.assert_allclose(out.rsi_14, (100 - 100 / (1 + up / (dn + 1e-9))).fillna(0), rtol=1e-9)
    macd = c.ewm(span=12).mean() - c.ewm(span=26).mean()
    np.testing.assert_allclose(out.macd, macd, rtol=1e-8, atol=1e-10)
    np.testing.assert_allclose(out.obv, (np.sign(d).fillna(0) * pdf.volume).cumsum(), rtol=1e-12)


def test_constant_price_and_single_row(spark):
    pdf = pd.DataFrame({"symbol": ["F"] * 60 + ["S"], "ts": [*pd.date_range("2024-01-01", periods=60, freq="h"), pd.Timestamp("2024-01-01")],
                        "open": 5.0, "high": 5.0, "low": 5.0, "close": 5.0, "volume": 0.0, "bar": [*range(60), 0]})
    out = to_pandas(X.full_pack(spark.createDataFrame(pdf)))
    assert len(out) == 61 and np.isfinite(out[X.BASIC + X.MOMENTUM].to_numpy(dtype=float)).all()
    assert (out.vwap == 5.0).all() and (out.adx_14 == 0).all()


def test_warm_up_rows_are_null_not_partial(spark):
    d = core(blocked(spark.createDataFrame(walk(n=40, symbols=("A",))), back=20).withColumns(
        {"m": I.rolling("close", 20, "mean"), "k": I.rolling("close", 20, "std", 5)}))
    out = to_pandas(d)
    assert out.m.isna().sum() == 19 and out.k.isna().sum() == 4


def test_filter_order_takes_top_k_before_the_session(spark):
    df = spark.createDataFrame([("A", "2024-01-02 09:00:00", 1, 0.9), ("A", "2024-01-02 12:00:00", -5, 0.8), ("A", "2024-01-02 12:30:00", 1, 0.7)],
                               "symbol string, t string, side int, conf double").withColumn("ts", F.to_timestamp("t"))
    out = fl.filter_signals(df, per_day=2, start="11:00", end="18:00").collect()
    assert [(r.t, r.side) for r in out] == [("2024-01-02 12:00:00", -1)]


def test_filters_without_their_columns_do_nothing(spark):
    df = spark.createDataFrame([("A", 1)], "symbol string, side int").withColumn("ts", F.to_timestamp(F.lit("2024-01-02 12:00:00")))
    assert fl.filter_signals(df, min_conf=0.9, min_atr=1.0, max_spread=1.0, use_regime=True).count() == 1


def test_short_confidence_lets_shorts_pass(spark):
    pdf = walk(n=400, symbols=("A",))
    pdf["p"] = np.where(pdf.bar % 2 == 0, 0.1, 0.9)
    df = spark.createDataFrame(pdf)
    both = sg.probability_signal(df, "p", 0.6, 0.4, use_filters=False).groupBy("side").count().collect()
    only_long = sg.probability_signal(df, "p", 0.6, 0.4, use_filters=False, short_confidence=False).groupBy("side").count().collect()
    assert {r.side for r in both} >= {-1, 1}
    assert -1 not in {r.side for r in only_long}


@pytest.mark.parametrize("asked,got", [((0.52, 0.48), (0.55, 0.40)), ((0.7, 0.3), (0.7, 0.3)), ((None, None), (0.55, 0.0))])
def test_threshold_limits(asked, got):
    assert sg.thresholds(*asked) == got


def test_majority_ties_go_to_the_most_recent(spark):
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate("aabb")], "symbol string, bar long, v string")
    out = to_pandas(core(blocked(df, back=5).withColumn("m", I.majority("v", 5))))
    assert out.m.tolist() == ["a", "a", "a", "b"]


def test_feature_sets_report_unknown_columns():
    have, missing = X.feature_set("fs_core_price_osc", X.BASIC + X.MOMENTUM)
    assert missing == ["atr_14"] and "vwap" in have
    with pytest.raises(ValueError):
        X.feature_set("nope", [])


def test_missing_columns_fail_early(spark):
    with pytest.raises(ValueError, match="high"):
        sg.trend_signal(spark.createDataFrame([("A", 0, 1.0, 1.0)], "symbol string, bar long, close double, low double"))


def test_custom_rule(spark):
    pdf = walk(n=50, symbols=("A",))
    out = to_pandas(sg.custom_signal(spark.createDataFrame(pdf), F.col("close") - F.col("open"), gap=4))
    raw = np.sign(pdf.close - pdf.open).astype(int).tolist()
    assert out.signal.tolist() == debounce_loop(raw, 4)


def test_winsorise_with_a_training_part(spark):
    pdf = pd.DataFrame({"symbol": "A", "bar": range(100), "x": [float(i) for i in range(99)] + [1e9]})
    df = spark.createDataFrame(pdf)
    out = to_pandas(X.winsorise(df, ["x"], fit=df.filter("bar < 50")))
    lo, hi = pdf.x[:50].quantile(0.05), pdf.x[:50].quantile(0.95)
    assert out.x.min() == pytest.approx(lo) and out.x.max() == pytest.approx(hi)
    assert span(3) == 0.5
