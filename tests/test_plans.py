"""Properties of physical plans that keep the jobs scalable."""

import re

from helpers import walk
from pyspark.sql import functions as F

from tickloom.operators import features as X
from tickloom.operators import filters as fl
from tickloom.operators import regimes as rg
from tickloom.operators.blocks import prefix
from tickloom.plans.inputs import event_signals, ticks
from tickloom.operators.resample import resample


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def window_keys(text):
    """Partition keys of every window node."""
    found = re.findall(r"Window \[.*?windowspecdefinition\(([^)]*?)specifiedwindowframe", text)
    return [re.sub(r"#\d+L?", "", k) for k in found]


def indexed(spark, tmp_path):
    path = str(tmp_path / "bars")
    spark.createDataFrame(walk(n=100)).write.parquet(path)
    return spark.read.parquet(path)


def test_feature_windows_stay_inside_blocks(spark, tmp_path):
    text = plan(X.basic_pack(indexed(spark, tmp_path)))
    keys = window_keys(text)
    assert keys and all("_blk" in k for k in keys)
    # 26 features, one shuffle
    assert text.count("Exchange hashpartitioning") == 1
    assert "Python" not in text and "Arrow" not in text


def test_regime_uses_one_shuffle(spark, tmp_path):
    text = plan(rg.detect_regime(indexed(spark, tmp_path)))
    assert text.count("Exchange hashpartitioning") == 1


def test_running_sums_are_two_level(spark, tmp_path):
    text = plan(prefix(indexed(spark, tmp_path), {"s": ("sum", F.col("close"))}))
    assert any("_pb" in k for k in window_keys(text))
    assert "partial_sum" in text


def test_top_k_prunes_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(fl.top_k_per_day(event_signals(spark, sf_dir), 3))


def test_bar_building_combines_without_sorting_ticks(spark, sf_dir):
    text = plan(resample(ticks(spark, sf_dir), "30min", order=["ts", "seq"], price="price"))
    assert "SortAggregate" not in text and text.count("HashAggregate") == 2


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    df = fl.date_range(spark.read.parquet(f"{sf_dir}/events.parquet"), "2024-01-05", "2024-01-06").select("ts", "value")
    text = plan(df)
    assert "GreaterThanOrEqual(ts" in text and "ReadSchema: struct<ts:timestamp_ntz,value:double>" in text


def test_a_scope_removes_what_was_cut_in_it(spark, checkpoint_dir):
    import pathlib

    from tickloom.session import cut, scope, shared_dir

    folder = pathlib.Path(shared_dir(spark).removeprefix("file:")) / "tickloom"
    kept = cut(spark.range(3))
    before = {p.name for p in folder.iterdir()}
    with scope(spark):
        assert cut(spark.range(5)).count() == 5 and len({p.name for p in folder.iterdir()}) == len(before) + 1
    assert {p.name for p in folder.iterdir()} == before and kept.count() == 3


def test_missing_columns_are_named_while_planning(spark):
    import pytest

    from tickloom.operators import barriers, episodes, ledger, metrics, regimes

    d = spark.createDataFrame([("A", 1)], "symbol string, bar long")
    for fn, name in ((regimes.detect_regime, "close"), (ledger.ledger, "size"), (barriers.barrier_outcomes, "high"),
                     (episodes.trade_log, "signal"), (metrics.core_pack, "pnl")):
        with pytest.raises(ValueError, match=f"missing column.*{name}"):
            fn(d)
