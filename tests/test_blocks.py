import numpy as np
import pandas as pd
import pytest
from helpers import debounce_loop, to_pandas, walk
from pyspark.sql import functions as F

from tickloom.operators import indicators as I
from tickloom.operators.blocks import blocked, core, equity_path, index_bars, prefix
from tickloom.operators.debounce import debounce
from tickloom.operators.ema import Ema, add_emas, ema_back, span, sub_length


def test_index_is_dense_and_ordered(spark):
    pdf = walk(("A", "B", "C"), 2000)
    out = to_pandas(index_bars(spark.createDataFrame(pdf.drop(columns="bar").sample(frac=1, random_state=1)), every_days=3))
    assert (out["bar"].to_numpy() == pdf["bar"].to_numpy()).all()
    assert (out["ts"].to_numpy() == pdf["ts"].to_numpy()).all()


@pytest.mark.parametrize("size", [16, 64, 32768])
def test_bounded_frames_do_not_notice_blocks(spark, size):
    pdf = walk(n=200)
    d = blocked(spark.createDataFrame(pdf), back=10, ahead=3, size=size)
    d = core(d.withColumns({"m": I.rolling("close", 10, "mean"), "nx": I.lead("close", 3)}))
    out = to_pandas(d)
    want = pdf.groupby("symbol").close.rolling(10).mean().to_numpy()
    np.testing.assert_allclose(out.m.astype(float), want, rtol=1e-12)
    nx = pdf.groupby("symbol").close.shift(-3).to_numpy()
    np.testing.assert_array_equal(out.nx.astype(float), nx)


@pytest.mark.parametrize("size", [16, 32768])
def test_prefix_scans(spark, size):
    pdf = walk(n=150)
    pdf["x"] = np.where(pdf.bar % 7 == 3, pdf.close, np.nan)
    sdf = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    out = to_pandas(prefix(sdf, {"s": ("sum", F.col("close")), "mx": ("max", F.col("close")),
                                 "mn": ("min", F.col("close")), "lx": ("last", F.col("x"))}, size=size))
    g = pdf.groupby("symbol").close
    np.testing.assert_allclose(out.s, g.cumsum(), rtol=1e-12)
    np.testing.assert_array_equal(out.mx, g.cummax())
    np.testing.assert_array_equal(out.mn, g.cummin())
    np.testing.assert_array_equal(out.lx.astype(float), pdf.groupby("symbol").x.ffill())


@pytest.mark.parametrize("size", [16, 32768])
def test_equity_and_peak(spark, size):
    pdf = walk(n=150)
    pdf["pnl"] = pdf.groupby("symbol").close.diff().fillna(0)
    out = to_pandas(equity_path(spark.createDataFrame(pdf), F.col("pnl"), 50.0, size=size))
    eq = pdf.groupby("symbol").pnl.cumsum() + 50
    np.testing.assert_allclose(out.equity, eq, rtol=1e-12)
    np.testing.assert_allclose(out.peak, eq.groupby(pdf.symbol).cummax(), rtol=1e-12)


@pytest.mark.parametrize("n,adjust", [(1, False), (3, False), (12, False), (48, False), (96, False), (400, False), (26, True)])
def test_ema_equals_recursion(spark, n, adjust):
    pdf = walk(n=9000, symbols=("A",))
    a = span(n)
    d = blocked(spark.createDataFrame(pdf), back=ema_back([a]), size=512)
    out = to_pandas(core(add_emas(d, [Ema("e", "close", a, adjust=adjust)])))
    want = pdf.close.ewm(span=n, adjust=adjust).mean()
    np.testing.assert_allclose(out.e, want, rtol=1e-12)


def test_ema_copies_cover_downstream_needs(spark):
    pdf = walk(n=6000, symbols=("A",))
    a = span(12)
    need = 5
    d = blocked(spark.createDataFrame(pdf), back=ema_back([a], need), size=sub_length(a))
    d = add_emas(d, [Ema("e", "close", a, first=1)])
    out = to_pandas(core(d.withColumn("d5", I.lag("e", need))))
    want = pdf.close.iloc[1:].ewm(span=12, adjust=False).mean().reindex(pdf.index).shift(need)
    np.testing.assert_allclose(out.d5.astype(float), want, rtol=1e-12)


@pytest.mark.parametrize("gap", [0, 1, 2, 7, 25])
@pytest.mark.parametrize("size", [32, 8192])
@pytest.mark.parametrize("stay", [0.0, 0.6, 0.97])
def test_debounce_equals_state_machine(spark, gap, size, stay):
    rng = np.random.default_rng(gap * 100 + size + int(stay * 10))
    frames = []
    for s, n in (("A", 700), ("B", 333), ("C", 1)):
        raw, cur = [], 0
        for _ in range(n):
            if rng.random() > stay:
                cur = int(rng.integers(-1, 2))
            raw.append(cur)
        frames.append(pd.DataFrame({"symbol": s, "bar": range(n), "raw_dir": raw}))
    pdf = pd.concat(frames, ignore_index=True)
    out = to_pandas(debounce(spark.createDataFrame(pdf), gap, size=size))
    for s, g in pdf.groupby("symbol"):
        got = out[out.symbol == s].signal.tolist()
        assert got == debounce_loop(g.raw_dir.tolist(), max(gap, 1))


def test_no_group_grows_with_a_hot_symbol(spark):
    """A symbol with most of the rows is cut into blocks of bounded size, and every row is kept once."""
    hot = spark.range(50_000).select(F.lit("hot").alias("symbol"), F.col("id").alias("bar"), F.rand(1).alias("close"))
    cold = spark.range(100).select(F.lit("cold").alias("symbol"), F.col("id").alias("bar"), F.rand(2).alias("close"))
    d = blocked(hot.unionByName(cold), back=100, ahead=10, size=1024)
    assert d.groupBy("symbol", "_blk").count().agg(F.max("count")).first()[0] <= 1024 + 110
    assert core(d).count() == 50_100


def test_rolling_quantiles(spark):
    pdf = walk(n=150)
    pdf.loc[pdf.bar % 11 == 5, "close"] = np.nan
    sdf = spark.createDataFrame(pdf).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    d = core(blocked(sdf, back=40, size=64).withColumns(
        {"q": I.rolling("close", 40, "quantile", 10, q=0.83), "m": I.rolling("close", 7, "median", 7)}))
    out = to_pandas(d)
    g = pdf.groupby("symbol").close
    np.testing.assert_allclose(out.q.astype(float), g.rolling(40, min_periods=10).quantile(0.83), rtol=1e-12)
    np.testing.assert_allclose(out.m.astype(float), g.rolling(7).median(), rtol=1e-12)


def test_rows_without_time_or_symbol_stay(spark):
    rows = [("A", 1.0, i) for i in range(5)] + [(None, 2.0, i) for i in range(3)] + [("A", 3.0, None), (None, 4.0, None)]
    d = spark.createDataFrame(rows, "symbol string, close double, t long").withColumn("ts", F.timestamp_seconds("t"))
    b = index_bars(d)
    got = sorted((r.symbol or "", -1 if r.t is None else r.t, -1 if r.bar is None else r.bar) for r in b.collect())
    assert got == [("", -1, -1), ("", 0, 0), ("", 1, 1), ("", 2, 2), ("A", -1, -1), *[("A", i, i) for i in range(5)]]
    assert core(blocked(b, back=3)).count() == core(blocked(b)).count() == 10
    assert prefix(b, {"s": ("sum", F.col("close"))}).filter("s is not null").count() == 10
    assert equity_path(b, F.col("close")).count() == 10


@pytest.mark.parametrize("fan,size,gap", [(4, 16, 7), (3, 8, 20)])
def test_hold_over_many_super_blocks_also_for_a_periodic_signal(spark, monkeypatch, fan, size, gap):
    from tickloom.operators import debounce as module

    monkeypatch.setattr(module, "FAN", fan)
    n = 1200
    raws = {"A": np.random.default_rng(1).integers(-1, 2, n), "B": np.tile([1, 1, 1, -1, -1, -1, 0], n)[:n]}
    pdf = pd.concat([pd.DataFrame({"symbol": k, "bar": np.arange(n), "raw_dir": v.astype("int32")}) for k, v in raws.items()])
    out = to_pandas(debounce(spark.createDataFrame(pdf), gap, size=size))
    for k, v in raws.items():
        assert list(out[out.symbol == k].signal) == debounce_loop(v, gap)
