"""The given tables seen as ticks, bars, signals, trades and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.blocks import index_bars
from tickloom.operators.resample import resample
from tickloom.session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str, by: str = "type") -> DataFrame:
    """events as ticks: symbol, ts, price, volume 1, seq."""
    symbol = F.col("event_type") if by == "type" else F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string"))
    return table(spark, sf_dir, "events").select(
        symbol.alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
        F.lit(1.0).alias("volume"), F.col("event_id").alias("seq"),
    )


def bars(spark: SparkSession, sf_dir: str, interval: str | int = "30min", by: str = "type") -> DataFrame:
    """Indexed bars of the events; the bars are written once, the raw ticks are read once."""
    return index_bars(cut(resample(ticks(spark, sf_dir, by), interval, order=["ts", "seq"], price="price")))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed daily bars per brand: price = extended price per unit, volume = quantity.

    The part table grows with the data, so the join strategy is left to the optimizer.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_orderkey", "l_suppkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"), F.col("l_quantity").alias("volume"),
    )
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    t = li.join(part, li.l_partkey == part.p_partkey)
    d = resample(t, "1d", order=["ts", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "price"], price="price")
    return index_bars(cut(d), every_days=3650)


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_totalprice").alias("price"), F.lit(1.0).alias("volume"), F.col("o_orderkey").alias("seq"),
    )
    return index_bars(cut(resample(o, "1d", order=["ts", "seq"], price="price")), every_days=3650)


def event_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as scored signals: side, conf, score, spread, a regime flag."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        F.signum(v - 50.0).cast("int").alias("side"), (v / (v + 50.0)).alias("conf"),
        F.col("value").alias("score"), (v / 10.0).alias("atr"), (F.lit(50.0) - v / 10.0).alias("spread_bps"),
        (F.col("user_id") % 3 != 0).alias("regime_ok"), F.col("event_id").alias("seq"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a trade log."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.when(F.col("o_orderstatus") == "F", "BUY").otherwise("SELL").alias("side"), F.lit(1.0).alias("quantity"),
        F.col("o_totalprice").alias("price"), (F.col("o_totalprice") * 0.0005).alias("commission"),
        F.col("o_orderkey").alias("trade_no"),
    )


def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day the share of finished orders."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("ts")).agg(
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("risk_score")
    )


def price_probability() -> Column:
    """A stand-in for a model probability: the close's share of open plus close."""
    return F.try_divide(F.col("close"), F.col("close") + F.col("open"))


def half_away(x: Column, digits: int) -> Column:
    """Round on the binary value, halves away from zero, as most SQL engines do."""
    k = float(10**digits)
    y = F.floor(F.abs(x) * k + 0.5) / k
    return F.when(F.abs(x) < 1e12, F.when(y == 0, 0.0).otherwise(F.signum(x) * y)).otherwise(x)


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles and show timestamps without a zone, for comparing results."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = half_away(c.cast("double"), digits)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)
