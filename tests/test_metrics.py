import numpy as np
import pandas as pd
import pytest
from helpers import to_pandas, walk
from pyspark.sql import functions as F

from tickloom.operators import metrics as mx
from tickloom.operators.episodes import label_episodes, streaks, trade_log
from tickloom.operators.ledger import ledger, positions
from tickloom.operators.quantiles import exact_quantiles


def test_exact_quantiles_of_large_and_small_groups(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"symbol": ["A"] * 900 + ["B"] * 37, "x": np.r_[rng.normal(size=600), [1.5] * 300, rng.integers(0, 5, 37)]})
    out = exact_quantiles(spark.createDataFrame(pdf), ["x"], [0.0, 0.05, 0.5, 0.73, 1.0]).toPandas()
    for _, r in out.iterrows():
        assert r["value"] == pytest.approx(pdf[pdf.symbol == r.symbol].x.quantile(r.q), abs=1e-12)
    assert len(out) == 10


def test_auc_equals_pair_counting(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"p": np.round(rng.random(300), 2), "label": rng.integers(0, 2, 300).astype(float)})
    pos, neg = pdf[pdf.label == 1].p.to_numpy(), pdf[pdf.label == 0].p.to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    got = mx.auc(spark.createDataFrame(pdf)).first()
    assert got["auc"] == pytest.approx(want, abs=1e-12)


def test_auc_without_one_class_is_half(spark):
    df = spark.createDataFrame([(0.3, 1.0), (0.4, 1.0)], "p double, label double")
    assert mx.auc(df).first()["auc"] == 0.5


def test_ledger_equals_bar_loop(spark):
    pdf = walk(n=120)
    rng = np.random.default_rng(1)
    pdf["side"], pdf["size"] = rng.integers(-1, 2, len(pdf)), 1000.0
    out = to_pandas(ledger(spark.createDataFrame(pdf), equity0=5000.0))
    for s, g in pdf.groupby("symbol"):
        shares, eq, peak, want = 0.0, 5000.0, -np.inf, []
        prev = None
        for r in g.itertuples():
            pnl = shares * (r.close - prev) if prev is not None else 0.0
            target = r.size * r.side / r.close
            pnl -= abs(target - shares) * r.close * 0.0006
            shares, prev, eq = target, r.close, eq + pnl
            peak = max(peak, eq)
            want.append((eq, eq / peak - 1))
        o = out[out.symbol == s]
        np.testing.assert_allclose(o.equity, [w[0] for w in want], rtol=1e-12)
        np.testing.assert_allclose(o.drawdown, [w[1] for w in want], atol=1e-12)


def test_cash_flow_counts_only_signed_cash(spark):
    df = spark.createDataFrame([("A", 0, 10.0, 1, 100.0), ("A", 1, 20.0, 0, 100.0)], "symbol string, bar long, close double, side int, size double")
    out = to_pandas(positions(df, commission=0.0, slippage_bps=0.0))
    assert out.cashflow.tolist() == [-100.0, 200.0]
    assert out.pnl.tolist() == [0.0, 100.0]


def test_two_signals_give_one_episode(spark):
    close = [10.0, 10.0, 10.5, 10.7, 10.2, 10.0]
    side = [0, 1, 1, 1, 0, 0]
    ts = pd.date_range("2024-01-01 10:00", periods=6, freq="min")
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": ts, "bar": range(6), "close": close, "signal": side}))
    log = trade_log(df, commission=0.0, slippage_bps=0.0).collect()
    assert len(log) == 1
    t = log[0]
    assert (t.entry_price, t.exit_price, t.bars_held, t.exit_reason) == (10.0, 10.2, 3, "signal_change")
    assert t.mfe == pytest.approx(0.7) and t.mae == 0.0 and t.pnl_abs == pytest.approx(0.2)


def test_direct_flip_makes_two_trades_and_open_end(spark):
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=4, freq="D"), "bar": range(4),
                                             "close": [1.0, 2.0, 3.0, 4.0], "signal": [1, 1, -1, -1]}))
    log = to_pandas(trade_log(df), "symbol", "trade_id")
    assert log.direction.tolist() == [1, -1]
    assert log.exit_price.tolist() == [3.0, 4.0]
    assert log.exit_reason.tolist() == ["signal_change", "open"]
    ids = to_pandas(label_episodes(df)).trade_id.tolist()
    assert ids == [1, 1, 2, 2]


def test_equity_metrics_edge_cases(spark):
    rows = [("flat", i, 100.0) for i in range(4)] + [("one", 0, 100.0)] + [("up", i, 100.0 + i) for i in range(4)]
    out = {r.symbol: r for r in mx.equity_metrics(spark.createDataFrame(rows, "symbol string, bar long, equity double")).collect()}
    assert out["flat"].total_return == 0.0 and out["flat"].calmar == 0.0 and out["flat"].sharpe_ann == 0.0
    assert out["one"].calmar is None and out["one"].bars == 1
    assert out["up"].calmar is None and out["up"].max_drawdown == 0.0


def test_streaks(spark):
    df = spark.createDataFrame([("A", i, f) for i, f in enumerate([True, True, False, True, True, True])] + [("B", 0, False)],
                               "symbol string, bar long, f boolean")
    out = {r.symbol: r for r in streaks(df, F.col("f")).collect()}
    assert (out["A"].avg_hold, out["A"].max_hold) == (2.5, 3)
    assert out["B"].max_hold == 0


def test_thresholds_prefer_the_lowest_on_ties(spark):
    df = spark.createDataFrame([("A", 0.9, 1.0, 1), ("A", 0.1, -1.0, 0)], "symbol string, p double, ret double, label int")
    r = mx.profit_thresholds(df).first()
    assert (r.th_long, r.th_short, r.score) == (0.52, 0.30, 1.0)
    assert mx.best_f1(df).first()["threshold"] == 0.45
