"""Versioned tables under readers and failures; signals over bars in any order of arrival."""

import numpy as np
import pytest
from helpers import to_pandas, walk
from pyspark.sql import functions as F

from tickloom.operators import signals as sg
from tickloom.streaming import versions as V
from tickloom.streaming.bars import file_stream, run_available
from tickloom.streaming.ordered import ordered_signals, rocksdb_state


def rows(spark, *r):
    return spark.createDataFrame(list(r), "symbol string, t string, price double, seq long").withColumn("ts", F.to_timestamp("t")).drop("t")


def prices(df):
    return {(r.symbol, str(r.ts)[:10]): r.price for r in df.collect()}


@pytest.fixture
def first(spark):
    return rows(spark, ("A", "2024-01-31", 1.0, 1), ("A", "2024-02-01", 2.0, 2), ("007", "2024-01-31", 3.0, 3), (None, "2024-01-01", 4.0, 4))


@pytest.fixture
def second(spark):
    return rows(spark, ("A", "2024-02-01", 9.0, 5), ("A", "2024-02-01", 8.0, 6), ("C/=x", "2024-03-01", 7.0, 7), ("A", "2024-02-02", 6.0, 8))


ONE = {("A", "2024-01-31"): 1.0, ("A", "2024-02-01"): 2.0, ("007", "2024-01-31"): 3.0, (None, "2024-01-01"): 4.0}
TWO = ONE | {("A", "2024-02-01"): 8.0, ("C/=x", "2024-03-01"): 7.0, ("A", "2024-02-02"): 6.0}


def test_readers_keep_their_version(spark, tmp_path, first, second):
    path = str(tmp_path / "t")
    seen = []
    V.version_batch(path)(first, 0)
    pinned = V.read_version(spark, path)
    V.version_batch(path, before_publishing=lambda n: seen.append(prices(V.read_version(spark, path))))(second, 1)
    assert seen == [ONE]  # data of batch 1 lies there, but is not published
    assert prices(pinned) == ONE and prices(V.read_version(spark, path)) == TWO and prices(V.read_version(spark, path, 0)) == ONE
    assert V.published(spark, path) == [0, 1]
    with pytest.raises(ValueError):
        V.read_version(spark, path, 5)
    with pytest.raises(ValueError):
        V.read_version(spark, str(tmp_path / "none"))


def test_only_touched_partitions_are_written(spark, tmp_path, first, second):
    path = str(tmp_path / "t")
    V.version_batch(path)(first, 0)
    V.version_batch(path)(second, 1)
    written = {str(p.relative_to(tmp_path / "t/data/v=1")) for p in (tmp_path / "t/data/v=1").glob("*/*") if p.is_dir()}
    assert written == {"p_symbol=sA/p_month=m2024-02", "p_symbol=sC%2F%3Dx/p_month=m2024-03"}


def test_a_killed_batch_leaves_the_old_table_and_can_run_again(spark, tmp_path, first, second):
    path = str(tmp_path / "t")
    V.version_batch(path)(first, 0)

    def stop(n):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        V.version_batch(path, before_publishing=stop)(second, 1)
    assert prices(V.read_version(spark, path)) == ONE and V.published(spark, path) == [0]
    V.version_batch(path)(second, 1)
    assert prices(V.read_version(spark, path)) == TWO
    V.version_batch(path)(first, 1)  # published: not run twice
    assert prices(V.read_version(spark, path)) == TWO


def test_expired_versions_leave_live_folders(spark, tmp_path, first, second):
    path = str(tmp_path / "t")
    third = rows(spark, ("C/=x", "2024-03-02", 5.0, 9))
    for n, batch in enumerate((first, second, third)):
        V.version_batch(path)(batch, n)
    assert V.expire(spark, path, keep=1) == [0, 1] and V.published(spark, path) == [2]
    assert prices(V.read_version(spark, path)) == TWO | {("C/=x", "2024-03-02"): 5.0}
    left = {str(p.relative_to(tmp_path / "t/data")) for p in (tmp_path / "t/data").glob("*/*/*") if p.is_dir()}
    assert left == {"v=0/p_symbol=sA/p_month=m2024-01", "v=0/p_symbol=s007/p_month=m2024-01", "v=0/p_symbol=n/p_month=m2024-01", "v=1/p_symbol=sA/p_month=m2024-02",
                    "v=2/p_symbol=sC%2F%3Dx/p_month=m2024-03"}
    assert V.expire(spark, path, keep=1) == [] and V.expire(spark, str(tmp_path / "none")) == []


def test_a_stream_feeds_versions(spark, tmp_path, first, second):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for part in (first, second):
        part.write.mode("append").parquet(src)
        table = V.run_versions(file_stream(spark, src, first.schema), out, cp)
    assert prices(table) == TWO and len(V.published(spark, out)) == 2


def test_shuffled_arrival_equals_the_batch(spark, tmp_path):
    """Bars in blocks of time whose rows and neighbours are mixed, within the delay."""
    pdf = walk(n=240)
    p = sg.Trend(threshold=0.8, gap=9)
    df = spark.createDataFrame(pdf)
    batch = to_pandas(sg.trend_signal(df, p))
    rng = np.random.default_rng(1)
    order = np.argsort(pdf.bar.to_numpy() + rng.uniform(0, 60, len(pdf)))  # up to 60 bars late
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = df.drop("bar").schema
    emitted = []
    with rocksdb_state(spark):
        for part in np.array_split(order, 3):
            spark.createDataFrame(pdf.iloc[part].drop(columns="bar"), schema).write.mode("append").parquet(src)
            emitted.append(run_available(ordered_signals(file_stream(spark, src, schema), "40 hours", p), out, cp).count())
        beat = pdf.iloc[-1:].drop(columns="bar").assign(symbol="beat", ts=pdf.ts.max() + np.timedelta64(60, "D"))
        spark.createDataFrame(beat, schema).write.mode("append").parquet(src)
        res = run_available(ordered_signals(file_stream(spark, src, schema), "40 hours", p), out, cp)
    got = to_pandas(res, "symbol", "ts")
    assert 0 < emitted[1] < emitted[2] < len(batch) == len(got)
    assert got.ts.tolist() == batch.ts.tolist() and got.raw_dir.tolist() == batch.raw_dir.tolist() and got.signal.tolist() == batch.signal.tolist() and not got.late.any()
