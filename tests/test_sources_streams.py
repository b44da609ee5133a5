import json

import pandas as pd
import pytest
from helpers import to_pandas, walk
from pyspark.sql import functions as F

from tickloom.functions import timeparse as tp
from tickloom.operators import signals as sg
from tickloom.session import shared_dir
from tickloom.sources import files, sinks
from tickloom.streaming.bars import TICK_SCHEMA, file_stream, run_available, stream_bars
from tickloom.streaming.stateful import stateful_signals
from tickloom.streaming.upsert import run_upsert


def test_csv_folder_with_file_names_as_symbols(spark, tmp_path):
    for s in ("ABC", "XYZ"):
        (tmp_path / f"{s}.csv").write_text("TradeDate,SysTime,Last,Qty\n2024-01-02,9:30:00,10.5,3\n2024-01-02,10:00:00,bad,4\n")
    out = to_pandas(files.normalize_bars(files.read_bar_csv(spark, str(tmp_path))), "symbol")
    assert out.symbol.tolist() == ["ABC", "XYZ"]
    assert out.ts.tolist() == [pd.Timestamp("2024-01-02 09:30:00")] * 2
    assert out.close.tolist() == out.open.tolist() == [10.5, 10.5] and out.volume.tolist() == [3.0, 3.0]


def test_old_encoding(spark, tmp_path):
    (tmp_path / "A.csv").write_bytes("begin,close,имя\n2024-01-02 10:00:00,1.5,акция\n".encode("cp1251"))
    assert "имя" in files.read_bar_csv(spark, str(tmp_path), encoding="windows-1251").columns


def test_epoch_and_missing_time(spark):
    df = spark.createDataFrame([(1704103200,), (1704103200000,)], "timestamp long")
    assert {str(r.ts) for r in df.select(tp.parse_epoch(F.col("timestamp")).alias("ts")).collect()} == {"2024-01-01 10:00:00"}
    with pytest.raises(ValueError):
        tp.resolve_time(spark.createDataFrame([("x",)], "when_ string"))


def test_candle_payload(spark, tmp_path):
    doc = {"candles": {"columns": ["open", "close", "high", "low", "volume", "begin"],
                       "data": [["1 234,5", 10, 11.5, 9, "7", "2024-01-02 10:00:00"], [1, None, 2, 1, 3, "2024-01-02 10:10:00"]]}}
    (tmp_path / "ABC_p1.json").write_text(json.dumps(doc))
    out = files.read_candles(spark, str(tmp_path)).collect()
    assert len(out) == 1 and out[0].symbol == "ABC" and out[0].open == 1234.5 and out[0].low == 9.0


def test_universe():
    assert files.universe(["A"]) == ["A"] and len(files.universe(["all"])) == 17


def test_sink_layout(spark, tmp_path):
    df = spark.createDataFrame(walk(n=60)).withColumn("interval", F.lit("30min"))
    sinks.write_bars(df, str(tmp_path / "bars"))
    back = spark.read.parquet(str(tmp_path / "bars"))
    assert back.count() == df.count() and (tmp_path / "bars" / "interval=30min" / "symbol=A").is_dir()
    plan = back.filter("symbol = 'A'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan


def _ticks(n=400):
    pdf = walk(n=n, step_s=300)
    return pdf.assign(price=pdf.close, seq=pdf.bar)[["symbol", "ts", "price", "volume", "seq"]]


def test_stream_bars_arrive_once_and_drop_late_rows(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    pdf = _ticks()
    df = spark.createDataFrame(pdf, TICK_SCHEMA)
    mid = pdf.ts.min() + (pdf.ts.max() - pdf.ts.min()) / 2
    build = lambda: stream_bars(file_stream(spark, src, TICK_SCHEMA))
    df.filter(F.col("ts") < F.lit(mid)).write.mode("append").parquet(src)
    run_available(build(), out, cp)
    df.filter(F.col("ts") >= F.lit(mid)).write.mode("append").parquet(src)
    late = df.orderBy("ts").limit(1).withColumn("price", F.lit(1e6))
    res = run_available(build(), out, cp).toPandas()
    late.write.mode("append").parquet(src)
    res2 = run_available(build(), out, cp).toPandas()
    assert not res.duplicated(["symbol", "ts"]).any() and res2.high.max() < 1e6
    a = pdf[pdf.symbol == "A"].set_index("ts").price
    want = a.resample("30min").agg(["first", "max", "min", "last"])
    got = res2[res2.symbol == "A"].set_index("ts").sort_index()
    assert len(got) >= len(want) - 2
    assert (got.open == want["first"].reindex(got.index)).all() and (got.close == want["last"].reindex(got.index)).all()


def test_stateful_stream_equals_batch(spark, tmp_path):
    pdf = walk(n=500)
    p = sg.Trend(threshold=0.8, gap=9)
    df = spark.createDataFrame(pdf)
    batch = to_pandas(sg.trend_signal(df, p))
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = df.drop("bar").schema
    for lo, hi in ((0, 130), (130, 131), (131, 500)):
        df.filter(F.col("bar").between(lo, hi - 1)).drop("bar").write.mode("append").parquet(src)
        res = run_available(stateful_signals(file_stream(spark, src, schema), p), out, cp)
    got = to_pandas(res, "symbol", "ts")
    assert got.raw_dir.tolist() == batch.raw_dir.tolist()
    assert got.signal.tolist() == batch.signal.tolist()
    assert not got.late.any()
    df.filter("bar = 3").drop("bar").write.mode("append").parquet(src)
    again = run_available(stateful_signals(file_stream(spark, src, schema), p), out, cp)
    assert again.filter("late").count() == 2 and again.count() == len(batch) + 2


def test_upsert_newest_wins_over_batches(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rows = lambda r: spark.createDataFrame(r, "symbol string, t string, price double, seq long").withColumn("ts", F.to_timestamp("t")).drop("t")
    first = rows([("A", "2024-01-31 10:00:00", 1.0, 1), ("A", "2024-02-01 10:00:00", 2.0, 2), ("B", "2024-01-31 10:00:00", 3.0, 3)])
    second = rows([("A", "2024-02-01 10:00:00", 9.0, 4), ("A", "2024-02-01 10:00:00", 8.0, 5), ("C", "2024-03-01 10:00:00", 7.0, 6)])
    for part in (first, second):
        part.write.mode("append").parquet(src)
        table = run_upsert(file_stream(spark, src, first.schema), out, cp)
    got = {(r.symbol, str(r.ts)): r.price for r in table.collect()}
    assert got == {("A", "2024-01-31 10:00:00"): 1.0, ("A", "2024-02-01 10:00:00"): 8.0, ("B", "2024-01-31 10:00:00"): 3.0, ("C", "2024-03-01 10:00:00"): 7.0}


def test_shared_dir_comes_from_the_session(spark, checkpoint_dir):
    assert shared_dir(spark) == checkpoint_dir
