"""Quantiles whose position is a whole rank but for the rounding of probability times size."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators.order_stats import RankTree, Rolling, quantile_of_frames
from tickloom.operators.quantiles import between, exact_quantiles

N, Q = 1411, 0.7  # 0.7 * 1410 = 986.9999999999999


def series(seed):
    return np.sort(np.random.default_rng(seed).random(N))


def crossing():
    """Series whose value of rank 987 exceeds the quantile, but not ``lo + (hi - lo) * f``."""
    f = Q * (N - 1) - 986
    for seed in range(1000):
        lo, hi = series(seed)[986:988]
        if math.fma(lo, 1 - f, hi * f) < hi == lo + (hi - lo) * f:
            return series(seed)
    raise AssertionError("none found")


def test_one_rounding_of_product_and_sum():
    rng = np.random.default_rng(0)
    a = rng.normal(size=20_000) * 10.0 ** rng.integers(-6, 7, 20_000)
    b = a * (1 + rng.random(20_000) * 10.0 ** -rng.integers(0, 14, 20_000))
    f = np.where(rng.random(20_000) < 0.5, rng.random(20_000), 1 - 2.0 ** -rng.integers(30, 52, 20_000))
    assert list(between(a, b, f)) == [math.fma(x, 1 - t, y * t) for x, y, t in zip(a, b, f)]


def test_series_quantile_is_that_of_the_sql(spark):
    x = crossing()
    want = duckdb.execute("SELECT quantile_cont(x, 0.7) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [x.tolist()]).fetchone()[0]
    d = spark.createDataFrame(pd.DataFrame({"symbol": "A", "x": x}))
    got = exact_quantiles(d, ["x"], [Q]).first().value
    assert got == want < x[987] and d.filter(F.col("x") > got).count() == N - 987


def test_rolling_quantile_agrees_with_the_series(spark):
    x = crossing()
    value, ok = quantile_of_frames(x, np.ones(N, bool), Rolling("x", N, Q), RankTree(x))
    f = Q * (N - 1) - 986
    assert ok[-1] and value[-1] == math.fma(x[986], 1 - f, x[987] * f) < x[987]


def test_infinite_values_do_not_spoil_a_quantile(spark):
    x = [-math.inf, 1.0, 3.0, math.inf, math.inf]
    got = {r.q: r.value for r in exact_quantiles(spark.createDataFrame([("A", v) for v in x], "symbol string, x double"), ["x"], [0.0, 0.375, 0.75, 0.9]).collect()}
    assert got == {0.0: -math.inf, 0.375: pytest.approx(2.0), 0.75: math.inf, 0.9: math.inf}
