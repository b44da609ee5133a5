import numpy as np
import pandas as pd
import pytest
from helpers import to_pandas, walk
from pyspark.sql import functions as F

from tickloom.operators import asof
from tickloom.operators import relations as rel
from tickloom.operators.barriers import Barriers, barrier_outcomes
from tickloom.operators.labels import add_labels
from tickloom.operators.ledger import portfolio_value, risk_budget
from tickloom.operators.resample import dense_grid, resample, resample_cascade
from tickloom.plans import folds, sweep


def loop_barriers(g, rule):
    rows = list(g.itertuples())
    out = []
    for i, e in enumerate(rows):
        if e.side == 0:
            continue
        d, entry, res, top = e.side, e.close, None, e.side * e.close
        for r in rows[i + 1 : i + 1 + rule.max_hold]:
            unit = entry if rule.unit == "pct" else (e.atr if rule.atr_at == "entry" else r.atr)
            worst, best = ((r.low, r.high) if d > 0 else (r.high, r.low)) if rule.intrabar else (r.close, r.close)
            top = max(top, d * r.close)
            stop, take = entry - d * (rule.stop or 0) * unit, entry + d * (rule.take or 0) * unit
            if rule.stop is not None and (worst - stop) * d <= 0:
                res = ("stop", stop if rule.intrabar else r.close, r.bar)
            elif rule.take is not None and (best - take) * d >= 0:
                res = ("take", take if rule.intrabar else r.close, r.bar)
            elif rule.trail and d * r.close <= top - rule.trail * unit:
                res = ("trail", r.close, r.bar)
            elif r.bar >= e.bar + rule.max_hold:
                res = ("time", r.close, r.bar)
            if res:
                break
        last = rows[-1]
        out.append((e.bar, *(res or ("open", last.close, last.bar))))
    return out


@pytest.mark.parametrize("rule", [
    Barriers(0.01, 0.02, None, 7), Barriers(0.02, None, 0.01, 12), Barriers(1.0, 1.5, None, 9, "atr", True),
    Barriers(0.8, 2.0, 0.7, 15, "atr", False, "current"), Barriers(None, None, None, 3)])
def test_barriers_equal_bar_loop(spark, rule):
    pdf = walk(n=220)
    rng = np.random.default_rng(4)
    pdf["side"] = rng.choice([-1, 0, 0, 1], len(pdf))
    pdf["atr"] = (pdf.high - pdf.low).clip(lower=0.1)
    pdf.loc[pdf.groupby("symbol").tail(1).index, "side"] = 1  # an entry on the last bar must not vanish
    out = to_pandas(barrier_outcomes(spark.createDataFrame(pdf), rule))
    for s, g in pdf.groupby("symbol"):
        o = out[out.symbol == s]
        want = loop_barriers(g, rule)
        assert o.bar.tolist() == [w[0] for w in want]
        assert o.outcome.tolist() == [w[1] for w in want]
        np.testing.assert_allclose(o.exit_price, [w[2] for w in want], rtol=1e-12)
        assert (o.bar + o.bars_held).tolist() == [w[3] for w in want]


@pytest.mark.parametrize("width", [600, 86400])
def test_asof_equals_merge_asof(spark, width):
    rng = np.random.default_rng(6)
    t0 = pd.Timestamp("2024-01-01")
    def frame(n, col):
        return pd.DataFrame({"symbol": rng.choice(["A", "B"], n), "ts": t0 + pd.to_timedelta(rng.integers(0, 400, n) * 60, "s"), col: rng.random(n)})
    left = frame(300, "x")
    right = frame(80, "v").drop_duplicates(["symbol", "ts"])
    left["id"] = range(len(left))
    sl, sr = spark.createDataFrame(left), spark.createDataFrame(right)
    for direction, fn in (("backward", asof.asof_backward), ("forward", asof.asof_forward)):
        got = to_pandas(fn(sl, sr, ["v"], width_s=width), "id")
        want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts"), on="ts", by="symbol", direction=direction).sort_values("id")
        np.testing.assert_array_equal(got.v.astype(float), want.v.to_numpy())
        m = got.match_ts.dropna()
        assert (m <= got.ts[m.index]).all() if direction == "backward" else (m >= got.ts[m.index]).all()


def test_resample_of_resample(spark):
    pdf = walk(n=400, step_s=600)
    df = spark.createDataFrame(pdf).drop("bar")
    one = to_pandas(resample(df, "1h"), "symbol", "ts")
    two = to_pandas(resample(resample(df, "30min"), "1h"), "symbol", "ts")
    pd.testing.assert_frame_equal(one, two)
    casc = to_pandas(resample_cascade(df, ["10min", "1h"]).filter("interval = '1h'").drop("interval"), "symbol", "ts")
    pd.testing.assert_frame_equal(one, casc[one.columns])


def test_dense_grid_fills_gaps_with_zero_volume(spark):
    df = spark.createDataFrame([("A", "2024-01-01 00:00:00"), ("A", "2024-01-01 02:00:00")], "symbol string, t string")
    df = df.select("symbol", F.to_timestamp("t").alias("ts"), *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume")])
    out = to_pandas(dense_grid(df, "30min"), "symbol", "ts")
    assert len(out) == 5 and out.volume.tolist() == [1, 0, 0, 0, 1] and out.close.isna().sum() == 3


def test_labels_are_null_at_the_end(spark):
    out = to_pandas(add_labels(spark.createDataFrame(walk(n=60, symbols=("A",))), 6))
    assert out.y_up.isna().sum() == 6 and out.y_up.iloc[:-6].notna().all()


def test_portfolio_equals_dense_loop(spark):
    rng = np.random.default_rng(8)
    t0 = pd.Timestamp("2024-01-01")
    prices = pd.DataFrame([(s, t0 + pd.Timedelta(hours=int(h)), 10 + rng.random()) for s in "AB" for h in sorted(rng.choice(60, 30, replace=False))],
                          columns=["symbol", "ts", "close"])
    trades = pd.DataFrame({"symbol": rng.choice(["A", "B"], 25), "ts": t0 + pd.to_timedelta(rng.integers(0, 60, 25), "h"),
                           "side": rng.choice(["BUY", "SELL"], 25), "quantity": 2.0, "price": 10.5, "commission": 0.1, "trade_no": range(25)})
    out = portfolio_value(spark.createDataFrame(trades), spark.createDataFrame(prices), 1000.0).toPandas().sort_values("ts")
    times = sorted(set(prices.ts) | set(trades.ts))
    want = []
    for t in times:
        tr = trades[trades.ts <= t]
        sign = np.where(tr.side == "BUY", 1, -1)
        cash = 1000 - (sign * tr.quantity * tr.price).sum() - tr.commission.sum()
        hold = 0.0
        for s in "AB":
            px = prices[(prices.symbol == s) & (prices.ts <= t)].sort_values("ts").close
            pos = (np.where(tr.side == "BUY", 1, -1) * tr.quantity)[tr.symbol == s].sum()
            hold += pos * (px.iloc[-1] if len(px) else 0.0)
        want.append(cash + hold)
    np.testing.assert_allclose(out.equity, want, rtol=1e-10)


def test_risk_budget_gate_and_default(spark):
    e = spark.createDataFrame([("all", "2024-01-01", 0, 100.0), ("all", "2024-01-02", 1, 60.0), ("all", "2024-01-03", 2, 90.0)], "portfolio string, t string, bar long, equity double")
    s = spark.createDataFrame([("all", "2024-01-02", 0.4)], "portfolio string, t string, risk_score double")
    ts = lambda d: d.withColumn("ts", F.to_timestamp("t")).drop("t")
    out = risk_budget(ts(e), ts(s), 0.3).orderBy("ts").collect()
    assert [r.budget for r in out] == [1.0, 0.0, 0.4]


def test_sweep_names_and_unknown_parameters():
    rows = sweep.grid_rows({"boll_window": [10, 20], "boll_mult": [1.0], "min_gap_bars": [5]})
    assert len(rows) == 2 and rows[1]["bb_len"] == 20 and rows[0]["gap"] == 5 and rows[0]["rsi_len"] == 14
    with pytest.raises(ValueError):
        sweep.grid_rows({"speed": [1]})


def test_folds_never_train_on_later_bars(spark):
    pdf = walk(n=300, step_s=86400)
    df = spark.createDataFrame(pdf).select("symbol", "ts", "bar")
    for f in (folds.month_folds(df, 6, purge=2), folds.rolling_folds(df, 100, 30, 40, purge=2), folds.split_folds(df, 3)):
        g = f.groupBy("symbol", "fold").agg(F.max(F.when(F.col("role") == "train", F.col("bar"))).alias("tr"),
                                            F.min(F.when(F.col("role") == "test", F.col("bar"))).alias("te")).filter("te is not null and tr is not null").collect()
        assert g and all(r.tr < r.te for r in g)


def test_keyed_dedup_and_merge(spark):
    a = spark.createDataFrame([("A", "2024-01-01", 1.0), ("A", "2024-01-02", 2.0)], "symbol string, ts string, close double")
    b = spark.createDataFrame([("A", "2024-01-02", 9.0)], "symbol string, ts string, close double")
    assert [r.close for r in rel.merge_sources([a, b], keep="last").orderBy("ts").collect()] == [1.0, 9.0]
    assert [r.close for r in rel.merge_sources([a, b], keep="first").orderBy("ts").collect()] == [1.0, 2.0]
    with pytest.raises(ValueError):
        rel.match_trades(a.drop("symbol"), b.drop("symbol"), ["close"], ["close"])
