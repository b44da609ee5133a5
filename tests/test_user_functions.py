"""User metrics, folds from a table function, reads with warm-up and fits side by side."""

import threading
import time

import numpy as np
import pandas as pd
import pytest
from helpers import to_pandas, walk
from pyspark.sql import functions as F

from tickloom.operators import features, indicators
from tickloom.operators import user_metrics as um
from tickloom.operators.blocks import blocked, core
from tickloom.operators.ema import ema_back
from tickloom.operators.metrics import add_drawdown
from tickloom.operators.warmup import warmup_days, with_warmup
from tickloom.plans import folds
from tickloom.plans import learning as ml
from tickloom.plans.fold_table import fold_rows


@pytest.mark.parametrize("size", [7, 64, 32768])
def test_metrics_over_blocks_equal_whole_series(spark, size):
    pdf = walk(n=300)
    d = add_drawdown(spark.createDataFrame(pdf).repartition(5), "close")
    median = um.Metric(("close", "volume"), lambda c, v: [len(c), (c * v).sum(), v.sum()], lambda b: b[:, 1].sum() / b[:, 2].sum())
    got = to_pandas(um.evaluate(d, {"ulcer": um.ULCER, "under": um.LONGEST_UNDER, "vwap": median, "n": F.count("*")}, size=size), "symbol")
    for s, g in pdf.groupby("symbol"):
        dd = (g.close / g.close.cummax() - 1).to_numpy()
        runs = "".join("x" if x < 0 else " " for x in dd).split()
        r = got[got.symbol == s].iloc[0]
        assert r.ulcer == pytest.approx(np.sqrt((dd**2).mean())) and r.under == max(map(len, runs)) and r.n == len(g)
        assert r.vwap == pytest.approx((g.close * g.volume).sum() / g.volume.sum())


def test_metrics_of_odd_rows(spark):
    d = spark.createDataFrame([(None, 0, -0.5), (None, 1, None), ("A", None, -0.1), ("A", 0, 0.0), ("B", 0, None)], "symbol string, bar long, drawdown double")
    got = {r.symbol: r for r in um.evaluate(d, {"ulcer": um.ULCER, "rows": F.count("*")}).collect()}
    assert got[None].ulcer == 0.5 and got["A"].ulcer == pytest.approx(np.sqrt(0.005)) and got["B"].ulcer is None and got[None].rows == 2
    assert um.evaluate(d.where("false"), {"ulcer": um.ULCER}).count() == 0
    with pytest.raises(ValueError):
        um.evaluate(d.drop("drawdown"), {"ulcer": um.ULCER})


def test_blocks_bound_the_groups(spark):
    d = add_drawdown(spark.createDataFrame(walk(n=100)), "close")
    plan = um.evaluate(d, {"ulcer": um.ULCER, "worst": F.min("drawdown")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("AggregateInPandas") + plan.count("ArrowAggregatePython") >= 2 and "_blk" in plan


@pytest.mark.parametrize("purge", [0, 6])
def test_rolling_folds_of_the_function_equal_the_columns(spark, purge):
    d = spark.createDataFrame(walk(n=400)).select("symbol", "ts", "bar")
    a = fold_rows(d, 100, 40, 60, purge).select("symbol", "bar", "fold", "role")
    b = folds.rolling_folds(d, 100, 40, 60, purge).select("symbol", "bar", "fold", "role")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() > 0


def test_expanding_folds_and_refused_arguments(spark):
    d = spark.createDataFrame([("A", i) for i in range(10)] + [(None, i) for i in range(5)], "symbol string, bar long")
    got = {(r.symbol, r.fold, r.role): (r.lo, r.hi) for r in fold_rows(d, 4, 2, 3, 1, "expanding").groupBy("symbol", "fold", "role")
           .agg(F.min("bar").alias("lo"), F.max("bar").alias("hi")).collect()}
    assert got == {("A", 0, "train"): (0, 2), ("A", 0, "test"): (4, 5), ("A", 1, "train"): (0, 5), ("A", 1, "test"): (7, 8), (None, 0, "train"): (0, 2), (None, 0, "test"): (4, 4)}
    for bad in (dict(mode="other"), dict(train=0), dict(purge=-1)):
        with pytest.raises(Exception, match="mode|whole numbers"):
            fold_rows(d, **{**dict(train=4, test=2, step=3, purge=0, mode="rolling"), **bad}).collect()


FEATURES = {
    "windows": (60, lambda d: core(blocked(d, back=60).withColumns({"m": indicators.rolling("close", 50, "mean"), "r": indicators.pct_change("close", 12)})), ["m", "r"]),
    "averages": (features.BASIC_BACK, lambda d: features.basic_pack(d, fill=False), ["ema_12", "ema_48", "rsi_14"]),
}


@pytest.mark.parametrize("name", list(FEATURES))
def test_features_with_warmup_equal_the_full_run(spark, tmp_path, name):
    back, fn, cols = FEATURES[name]
    pdf = walk(("A", "B", "C"), n=back + 700)
    pdf = pdf[~((pdf.symbol == "B") & (pdf.bar % 480 > 100))]  # long gaps
    path = str(tmp_path / "bars")
    spark.createDataFrame(pdf.drop(columns="bar")).write.parquet(path)
    bars = spark.read.parquet(path)
    ts = pdf[pdf.symbol == "A"].ts
    start, end = str(ts.iloc[-400]), str(ts.iloc[-300])
    from tickloom.operators.blocks import index_bars

    full = to_pandas(fn(index_bars(bars)).filter(F.col("ts").between(start, end)), "symbol", "ts")
    out = with_warmup(bars, start, end, back, fn)
    part = to_pandas(out, "symbol", "ts")
    assert len(part) == len(full) > 0
    for c in cols:
        np.testing.assert_allclose(part[c].to_numpy(float), full[c].to_numpy(float), rtol=1e-9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan
    if name == "windows":
        days = {r.symbol: r.day for r in warmup_days(bars, start, back).collect()}
        assert days["B"] < days["A"]
    assert with_warmup(bars.where("false"), start, end, back, fn).count() == 0


def test_jobs_run_side_by_side_and_keep_their_order():
    running, most, lock = [0], [0], threading.Lock()

    def job(i):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.05)
        with lock:
            running[0] -= 1
        return i

    assert ml.together([lambda i=i: job(i) for i in range(9)], 3) == list(range(9)) and 1 < most[0] <= 3
    assert ml.together([]) == []


def test_fits_side_by_side_equal_fits_in_turn(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"symbol": "A", "bar": np.arange(n), "x1": x, "label": (x + rng.normal(size=n) > 0).astype(float)})
    d = folds.split_folds(spark.createDataFrame(pdf), 3)
    one, four = (ml.compare_models(d, ["x1"], ("logistic",), {"logistic": [dict(regParam=0.0), dict(regParam=0.5)]}, workers=w).collect() for w in (1, 4))
    assert [(r.model, r.setting, r.folds) for r in four] == [("logistic", 0, 3), ("logistic", 1, 3)]
    assert [r.mean_auc for r in one] == pytest.approx([r.mean_auc for r in four])
