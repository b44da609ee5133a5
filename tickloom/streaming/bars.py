"""Streaming ticks to bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.schema import BAR_SCHEMA
from tickloom.session import cut

TICK_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("seq", T.LongType()),
    ]
)


def file_stream(spark: SparkSession, path: str, schema: T.StructType = TICK_SCHEMA, fmt: str = "parquet",
                files_per_batch: int | None = None, glob: str | None = None) -> DataFrame:
    """Landing folder as a stream; ``files_per_batch`` bounds the rows of a micro-batch."""
    r = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def from_json_topic(df: DataFrame, schema: T.StructType = TICK_SCHEMA) -> DataFrame:
    """Ticks from a message stream whose ``value`` holds one JSON document."""
    return df.select(F.from_json(F.col("value").cast("string"), schema).alias("t")).select("t.*")


def drop_repeats(ticks: DataFrame, keys: list[str], delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Keep the first row per key; state is kept only for ``delay``."""
    return ticks.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def _ohlcv() -> list:
    k = F.struct("ts", "seq")
    return [F.min_by("price", k).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", k).alias("close"), F.sum("volume").alias("volume")]


def stream_bars(ticks: DataFrame, interval: str = "30 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding bars; a bar is final once the watermark has passed its end."""
    w = F.window("ts", interval, slide) if slide else F.window("ts", interval)
    g = ticks.withWatermark("ts", delay).groupBy("symbol", w.alias("w")).agg(*_ohlcv())
    return g.select("symbol", F.col("w.start").alias("ts"), *[c for c in BAR_SCHEMA.names if c not in ("symbol", "ts")])


def session_bars(ticks: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """One bar per burst of activity: sessions end after ``gap`` without ticks, so days never mix."""
    g = ticks.withWatermark("ts", delay).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(
        *_ohlcv(), F.count(F.lit(1)).alias("n_ticks"))
    return g.select("symbol", F.col("w.start").alias("ts"), F.col("w.end").alias("end_ts"), "open", "high", "low", "close", "volume", "n_ticks")


def with_open_bars(emitted: DataFrame, ticks: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Closing pass: the emitted bars and, from a batch frame of all ticks, the bars no watermark has passed yet.

    ``build`` is the function that made the streaming bars (on a batch frame it gives every bar).
    """
    rest = cut(build(ticks))  # written whole: a join on it must not prune a session's aggregates away
    return emitted.unionByName(rest.join(emitted.select("symbol", "ts"), ["symbol", "ts"], "left_anti"))


def with_static(stream: DataFrame, static: DataFrame, keys: list[str], defaults: dict | None = None) -> DataFrame:
    """Left join of a stream with a parameter or risk table that has one row per key."""
    out = stream.join(static, keys, "left")
    return out.fillna(defaults) if defaults else out


def run_available(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> DataFrame:
    """Process what is there, append it to Parquet exactly once, and return the result as a batch frame."""
    w = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.trigger(availableNow=True).start(path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
