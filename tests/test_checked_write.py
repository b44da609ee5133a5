"""Reports from a checked write equal those of a scan; totals arrive with the write."""

import math

import pytest
from helpers import walk
from pyspark.sql import functions as F

from tickloom.operators import quality
from tickloom.sources import checked_write as cw


def untidy(spark):
    bars = spark.createDataFrame(walk(n=500))
    bad = F.col("bar") % 37
    return bars.withColumns({
        "open": F.when(bad == 1, F.col("high") + 1).otherwise(F.col("open")), "low": F.when(bad == 2, F.col("high") + 2).otherwise(F.col("low")),
        "volume": F.when(bad == 3, -F.col("volume")).when(bad == 4, F.lit(None)).otherwise(F.col("volume")),
        "close": F.when(bad == 5, F.lit(None)).when(bad == 6, F.lit(0.0)).when(bad == 7, F.lit(math.inf)).otherwise(F.col("close")),
    })


def same(a, b):
    a, b = (x.toPandas().sort_values("symbol").reset_index(drop=True) for x in (a, b))
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        for x, y in zip(a[c], b[c]):
            if isinstance(x, float) and isinstance(y, float):
                assert (math.isnan(x) and math.isnan(y)) or x == pytest.approx(y, rel=1e-9, abs=1e-12), c
            else:
                assert x == y, c


@pytest.mark.parametrize("every", ["day", "month"])
def test_reports_equal_a_scan(spark, tmp_path, every):
    bars, path = untidy(spark), str(tmp_path / "bars")
    cw.write_checked(bars, path, every)
    same(cw.bar_report(spark, path), quality.bar_report(bars))
    same(cw.density(spark, path), quality.density(bars))
    clean, path = spark.createDataFrame(walk(n=500)), str(tmp_path / "clean")
    cw.write_checked(clean, path, every, jump=0.001)
    same(cw.value_report(spark, path), quality.value_report(clean, 0.001))
    assert cw.slices(spark, path).count() == clean.select("symbol", F.date_trunc(every, "ts")).distinct().count()


def test_counts_of_nulls_zeros_and_infinities(spark, tmp_path):
    bars, path = untidy(spark), str(tmp_path / "bars")
    cw.write_checked(bars, path, "day")
    names = ["symbol", "n_rows", "null_close", "null_volume", "inf_close", "nonpositive_close", "min_close", "max_close", "min_volume", "max_volume"]
    same(cw.value_report(spark, path).select(names), quality.value_report(bars).select(names))


def test_totals_come_with_the_write_and_rows_stay(spark, tmp_path):
    bars, path = untidy(spark), str(tmp_path / "bars")
    extra = bars.unionByName(bars.where("bar < 3")).unionByName(
        bars.where("bar = 9").withColumns({"ts": F.lit(None).cast("timestamp"), "symbol": F.lit(None).cast("string")}))
    got = cw.write_checked(extra, path)
    scan = quality.bar_report(extra).agg(*(F.sum(c).alias(c) for c in ("rows_out", "duplicate_ts", "low_above_high", "open_outside"))).first()
    assert {k: got[k] for k in scan.asDict()} == scan.asDict()
    assert sorted(map(str, cw.read_checked(spark, path).select(bars.columns).collect())) == sorted(map(str, extra.collect()))
    same(cw.bar_report(spark, path), quality.bar_report(extra))


def test_an_append_adds_slices_and_an_empty_table_has_none(spark, tmp_path):
    clean, path = spark.createDataFrame(walk(n=500)), str(tmp_path / "bars")
    assert cw.write_checked(clean.where("false"), path)["rows_out"] == 0
    assert cw.value_report(spark, path).count() == 0
    day = F.date_trunc("day", "ts")
    middle = clean.select(F.expr("date_trunc('day', timestamp_micros(cast(avg(unix_micros(ts)) as bigint)))")).first()[0]
    for part in (clean.where(day < F.lit(middle)), clean.where(day >= F.lit(middle))):
        cw.write_checked(part, path, "day", mode="append")
    same(cw.value_report(spark, path), quality.value_report(clean))


def test_one_exchange_and_two_columns(spark, tmp_path):
    path = str(tmp_path / "bars")
    bars = spark.createDataFrame(walk(n=50))
    assert cw.checked(bars)._jdf.queryExecution().sparkPlan().toString().count("Window ") >= 1
    assert cw.checked(bars)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    cw.write_checked(bars, path)
    text = cw.slices(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "close:double" not in text.split("ReadSchema: struct<")[1].split("_quality")[0]
