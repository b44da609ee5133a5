"""Features of a date range without reading the whole history: the range is widened by what the features look back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.blocks import index_bars, join_safe


def warmup_days(bars: DataFrame, start: str, back: int) -> DataFrame:
    """Per symbol the latest day from which ``back`` bars lie before ``start`` (its first day if there are fewer).

    Counts bars per symbol and day from the time column alone; gaps of any length between bars are allowed for.
    """
    before = bars.filter(F.col("ts") < F.lit(start).cast("timestamp"))
    days = before.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    later = Window.partitionBy("symbol").orderBy(F.col("day").desc())  # the days of a calendar
    days = days.withColumn("upto", F.sum("n").over(later))
    return days.groupBy("symbol").agg(F.coalesce(F.max(F.when(F.col("upto") >= back, F.col("day"))), F.min("day")).alias("day"))


def with_warmup(bars: DataFrame, start: str, end: str, back: int, features: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``features`` of the bars from start to end, both included, equal to those of the full history.

    ``back`` is the number of earlier bars the features read (for exponential averages ``ema_back``). The first needed
    day of all symbols is one literal and reaches the Parquet scan with the end of the range; symbols with denser bars are cut further
    by their own day. Bars are numbered within what is read.
    """
    first = warmup_days(bars, start, back)
    day = first.agg(F.min("day")).first()[0]  # one row
    lo = F.lit(start).cast("timestamp") if day is None else F.least(F.lit(str(day)).cast("timestamp"), F.lit(start).cast("timestamp"))
    read = bars.filter((F.col("ts") >= lo) & (F.col("ts") <= F.lit(end).cast("timestamp")))
    own = join_safe(read, first.withColumnRenamed("day", "_day"), ["symbol"])
    read = own.filter(F.col("_day").isNull() | (F.to_date("ts") >= F.col("_day"))).drop("_day")
    out = features(index_bars(read.drop("bar")))
    return out.filter((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") <= F.lit(end).cast("timestamp")))
