"""Day sketches against the exact quantiles of the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import quantile_sketch as qs
from tickloom.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def rows(spark):
    """A symbol with most rows, a small one, a null one; 30 days; nulls and NaN among the values."""
    d = spark.range(200_000, numPartitions=6)
    day = F.pmod(F.xxhash64("id"), F.lit(30)).cast("int")
    x = F.exp(F.randn(5) * 3)
    return d.select(F.when(F.col("id") % 50 == 1, "B").when(F.col("id") % 50 != 2, "A").alias("symbol"),
                    F.timestamp_add("DAY", day, F.lit("2024-01-01").cast("timestamp")).alias("ts"),
                    F.when(F.col("id") % 97 == 0, None).when(F.col("id") % 89 == 0, float("nan")).otherwise(x).alias("x"),
                    (F.col("id") % 3).alias("ties"))


def test_ranks_are_within_the_stated_error(spark, rows, tmp_path):
    path = str(tmp_path / "days")
    qs.write_days(qs.day_sketches(rows, ["x", "ties"]), path)
    kept = qs.read_days(spark, path, "2024-01-05", "2024-01-25")
    assert kept.agg(F.min("day").cast("string"), F.max("day").cast("string")).first()[:] == ("2024-01-05", "2024-01-24")
    found = qs.quantiles(qs.merge(kept), [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]).drop("n")
    part = rows.filter("ts >= '2024-01-05' and ts < '2024-01-25'")
    misses = qs.rank_misses(part, found).collect()
    assert len(misses) == 3 * 2 * 7
    assert max(r.miss for r in misses) <= 3 * qs.rank_error()
    assert np.mean([r.miss <= qs.rank_error() for r in misses]) >= 0.95
    exact = {(r.symbol, r.feature, r.q): r.value for r in exact_quantiles(part, ["x", "ties"], [0.0, 1.0]).collect()}
    assert {(r.symbol, r.feature, r.q): r.value for r in found.filter("q in (0, 1)").collect()} == exact


def test_the_sketch_stays_small_and_counts_are_exact(rows):
    merged = {(r.symbol, r.feature): r for r in qs.merge(qs.day_sketches(rows, ["x"])).collect()}
    n = {r.symbol: r.n for r in rows.filter("not isnan(x) and x is not null").groupBy("symbol").agg(F.count("x").alias("n")).collect()}
    assert {k[0]: r.n for k, r in merged.items()} == n
    assert max(len(r.sketch) for r in merged.values()) < 40_000


def test_a_day_is_replaced_whole(spark, rows, tmp_path):
    path = str(tmp_path / "days")
    qs.write_days(qs.day_sketches(rows, ["x"]), path)
    before = {(r.symbol, str(r.day)): r.n for r in qs.read_days(spark, path).collect()}
    again = rows.filter("to_date(ts) = '2024-01-10' and symbol = 'A'").limit(10).withColumn("x", F.lit(7.0))
    qs.write_days(qs.day_sketches(again, ["x"]), path)
    after = {(r.symbol, str(r.day)): r for r in qs.read_days(spark, path).collect()}
    assert after["A", "2024-01-10"].n == 10 and after["A", "2024-01-10"].max_x == 7.0
    assert {k: r.n for k, r in after.items() if k[1] != "2024-01-10"} == {k: n for k, n in before.items() if k[1] != "2024-01-10"}


def test_small_groups_are_exact_and_empty_ones_absent(spark):
    d = spark.createDataFrame([("A", "2024-01-01", 1.0), ("A", "2024-01-02", 2.0), ("A", None, 3.0), ("B", "2024-01-01", None)],
                              "symbol string, t string, x double").withColumn("ts", F.to_timestamp("t"))
    out = qs.distribution(qs.day_sketches(d, ["x"])).collect()
    assert [(r.symbol, r.n, r.min_x, r.median_x, r.max_x) for r in out] == [("A", 3, 1.0, 2.0, 3.0)]
    assert qs.distribution(qs.day_sketches(d.limit(0), ["x"])).count() == 0
