"""Rolling order statistics against sorting every frame."""

import time

import numpy as np
import pytest
from helpers import to_pandas, walk
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.operators import indicators as I
from tickloom.operators.blocks import blocked, core
from tickloom.operators.order_stats import RankTree, Rolling, add_order_stats, deviation_of_frames, quantile_of_frames


def brute(x, present, n, need, f):
    out = []
    for i in range(len(x)):
        v = x[max(0, i + 1 - n) : i + 1][present[max(0, i + 1 - n) : i + 1]]
        out.append(f(v) if len(v) >= max(need, 1) else None)
    return out


VALUES = st.lists(st.one_of(st.none(), st.integers(-3, 3).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=70)


@settings(max_examples=150, deadline=None)
@given(VALUES, st.integers(1, 80), st.integers(0, 20), st.sampled_from([0.0, 0.2, 0.5, 0.98, 1.0]))
def test_quantiles_of_any_frame(values, n, need, q):
    x = np.array([0.0 if v is None else v for v in values])
    present = np.array([v is not None for v in values])
    if not present.any():
        return
    got, ok = quantile_of_frames(x, present, Rolling("x", n, q, need), RankTree(x[present]))
    want = brute(x, present, n, need, lambda v: np.quantile(v, q))
    assert ok.tolist() == [w is not None for w in want]
    np.testing.assert_allclose(got[ok], [w for w in want if w is not None], rtol=1e-9, atol=1e-9)


@settings(max_examples=150, deadline=None)
@given(VALUES, st.integers(1, 80), st.integers(0, 20))
def test_mean_deviations_of_any_frame(values, n, need):
    x = np.array([0.0 if v is None else v for v in values])
    present = np.array([v is not None for v in values])
    if not present.any():
        return
    got, ok = deviation_of_frames(x, present, Rolling("x", n, None, need))
    want = brute(x, present, n, need, lambda v: np.abs(v - v.mean()).mean())
    assert ok.tolist() == [w is not None for w in want]
    np.testing.assert_allclose(got[ok], [w for w in want if w is not None], rtol=1e-7, atol=1e-7)


def test_deviation_far_from_zero_and_not_finite():
    x = 1e9 + np.array([0.0, 0.01, 0.03, np.inf, 0.02, 0.05, np.nan, 0.0])
    got, ok = deviation_of_frames(x, np.ones(8, bool), Rolling("x", 2, None))
    assert ok.tolist() == [False] + [True] * 7
    np.testing.assert_allclose(got[[1, 2, 5]], [0.005, 0.01, 0.015], atol=1e-6)
    assert np.isnan(got[[3, 4, 6, 7]]).all()


def test_same_as_sorted_frames_across_blocks(spark):
    pdf = walk(n=400)
    pdf.loc[::17, "close"] = None
    bars = spark.createDataFrame(pdf).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    bars = bars.withColumn("extra", F.lit("x")).unionByName(
        bars.limit(1).withColumns({"symbol": F.lit(None).cast("string"), "bar": F.lit(None).cast("long"), "extra": F.lit("y")}))
    d = blocked(bars, back=120, size=128)
    slow = d.withColumns({"q20": I.rolling("close", 100, "quantile", 20, q=0.2), "med": I.rolling("volume", 15, "median")})
    fast = add_order_stats(d, {"q20": Rolling("close", 100, 0.2, 20), "med": Rolling("volume", 15), "dev": Rolling("high", 20, None)})
    cci = I.add_cci(d.withColumns({c: F.col("high") for c in ("low", "close")}), 20)
    a, b = to_pandas(core(slow)), to_pandas(core(fast))
    assert len(a) == len(b) == len(pdf) + 1 and list(b.columns) == [*a.columns, "dev"] and set(b.extra) == {"x", "y"}
    for c in ("q20", "med"):
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-12)
    hand = b.groupby("symbol").high.transform(lambda h: h.rolling(20).apply(lambda v: np.abs(v - v.mean()).mean(), raw=True))
    np.testing.assert_allclose(b.dev.astype(float)[:-1], hand[:-1], rtol=1e-9)
    c = to_pandas(core(cci))  # the indicator's own deviation, from its definition
    both = b.assign(cci=c.cci).dropna(subset=["cci"])
    mean = b.groupby("symbol").high.transform(lambda h: h.rolling(20).mean())[both.index]
    np.testing.assert_allclose(both.cci, (both.high - mean) / (0.015 * both.dev.astype(float) + 1e-9), rtol=1e-6)


def test_empty_nulls_and_errors(spark):
    bars = spark.createDataFrame(walk(n=5, symbols=("A",)))
    empty = add_order_stats(blocked(bars.limit(0), back=5), {"m": Rolling("close", 3)})
    assert empty.count() == 0 and empty.columns[-1] == "m"
    none = add_order_stats(blocked(bars.withColumn("close", F.lit(None).cast("double")), back=5),
                           {"m": Rolling("close", 2, min_rows=0), "d": Rolling("close", 2, None, 0)})
    assert [(r.m, r.d) for r in none.collect()] == [(None, None)] * 5
    with pytest.raises(ValueError):
        add_order_stats(blocked(bars), {"close": Rolling("close", 3)})
    for bad in (lambda: Rolling("x", 0), lambda: Rolling("x", 3, 1.5)):
        with pytest.raises(ValueError):
            bad()


def test_cost_does_not_grow_with_the_frame():
    x = np.random.default_rng(1).normal(size=60_000)
    present = np.ones(len(x), bool)
    tree = RankTree(x)

    def seconds(n):
        t = time.perf_counter()
        quantile_of_frames(x, present, Rolling("x", n), tree)
        return time.perf_counter() - t

    seconds(10)
    assert min(seconds(20_000) for _ in range(3)) < 3 * min(seconds(200) for _ in range(3))
