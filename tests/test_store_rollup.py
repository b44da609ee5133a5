"""Block tables plan without an exchange; report levels equal separate reports."""

import numpy as np
import pytest
from helpers import to_pandas, walk
from pyspark.sql import functions as F

from tickloom.operators import metrics as mx
from tickloom.operators import regimes as rg
from tickloom.operators.blocks import core
from tickloom.operators.rollup import pnl_levels
from tickloom.sources import block_store as bs


@pytest.fixture
def stored(spark, tmp_path):
    bars = spark.createDataFrame(walk(n=400))
    bars = bars.unionByName(bars.limit(1).withColumns({"symbol": F.lit(None).cast("string"), "bar": F.lit(None).cast("long")}))
    bs.save_blocks(bars, "stored_bars", rg.regime_back(), 4, path=str(tmp_path / "t"), size=64)
    yield bars
    spark.sql("DROP TABLE stored_bars")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_from_a_block_table_need_no_exchange(spark, stored):
    out = core(rg.regime_raw(bs.load_blocks(spark, "stored_bars", rg.regime_back())))
    assert "Exchange" not in plan(out)
    a, b = to_pandas(rg.detect_regime(stored)), to_pandas(out)
    assert len(b) == stored.count()
    assert b[["symbol", "bar", "regime"]].astype(str).equals(a[["symbol", "bar", "regime"]].astype(str))
    assert sorted(map(str, bs.stored_bars(spark, "stored_bars").collect())) == sorted(map(str, stored.collect()))


def test_joins_of_block_tables_need_no_exchange(spark, stored):
    a = bs.load_blocks(spark, "stored_bars").hint("merge")
    b = a.select("symbol", "_blk", "bar", F.col("close").alias("again"))
    joined = a.join(b, ["symbol", "_blk", "bar"])
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        assert "Exchange" not in plan(joined)
        assert joined.count() == a.filter("symbol is not null and bar is not null").count()
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")


def test_a_table_that_keeps_too_little_is_refused(spark, stored, tmp_path):
    for back, keys in ((10_000, ("symbol",)), (1, ("symbol", "bar"))):
        with pytest.raises(ValueError):
            bs.load_blocks(spark, "stored_bars", back, keys)
    spark.range(3).write.option("path", str(tmp_path / "p")).saveAsTable("plain_rows")
    with pytest.raises(ValueError):
        bs.load_blocks(spark, "plain_rows")
    spark.sql("DROP TABLE plain_rows")


def test_levels_equal_separate_reports(spark):
    rng = np.random.default_rng(3)
    rows = [(str(rng.choice(["A", "B"])), [None, "x", "y"][rng.integers(3)], float(1e6 + rng.normal())) for _ in range(300)]
    rows += [("A", "x", None), ("A", "y", float("nan")), ("C", "x", None), ("B", "z", 5.0)]
    d = spark.createDataFrame(rows, "symbol string, strategy string, pnl double")
    got = {(r.level, r.symbol, r.strategy): r for r in pnl_levels(d, "pnl", ["symbol", "strategy"]).collect()}
    assert len(got) == d.select("symbol", "strategy").distinct().count() + 3 + 1
    one = lambda df, keys: mx.pnl_metrics(df, "pnl", keys).collect()
    for r in one(d, ["symbol", "strategy"]):
        same(got[0, r.symbol, r.strategy], r)
    for r in one(d, ["symbol"]):
        same(got[1, r.symbol, None], r)
    same(got[3, None, None], one(d.withColumn("k", F.lit(1)), ["k"])[0])


def same(a, b):
    assert (a.trades, a.wins, a.losses, a.win_rate is None) == (b.trades, b.wins, b.losses, b.win_rate is None)
    np.testing.assert_allclose([a.pnl_sum, a.pnl_mean, a.pnl_std], [b.pnl_sum, b.pnl_mean, b.pnl_std], rtol=1e-6)


def test_chosen_levels_and_empty_tables(spark):
    d = spark.createDataFrame([("A", "x", 1.0), ("B", "x", -1.0)], "symbol string, strategy string, pnl double")
    got = pnl_levels(d, "pnl", ["symbol", "strategy"], [["strategy"], []]).collect()
    assert sorted((r.level, r.strategy, r.trades, r.win_rate) for r in got if r.level == 2) == [(2, "x", 2, 0.5)]
    assert [(r.trades, r.pnl_sum) for r in got if r.level == 3] == [(2, 0.0)]
    assert all(r.trades == 0 for r in pnl_levels(d.limit(0), "pnl", ["symbol", "strategy"]).collect())
    with pytest.raises(ValueError):
        pnl_levels(d, "pnl", ["symbol"], [["strategy"]])
