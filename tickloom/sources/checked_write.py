"""Bars checked while they are written: the reports of ``operators.quality`` without a second scan.

Bars are dealt by symbol and calendar slice (a hot symbol is many tasks) and sorted by time, as a good layout wants anyway. In that one
pass running aggregates are kept per slice, and the slice's last row carries their final values in the column ``_quality``, which is null on all
other rows. The reports read that column alone: one row per slice, merged per symbol, the return over the seam of two slices
included. Totals of the whole write reach the caller as observed metrics of the same job, a fixed count of numbers.

Rows without a time are a slice of their own, counted but without returns. An appended batch adds slices; a repeated time is found
within a batch, not between two. Failed tasks that run again do not count twice: metrics of a task count once and the
column is part of the task's output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.schema import require_columns

QUALITY = "_quality"
NEEDED = ("symbol", "ts", "open", "high", "low", "close", "volume")


def _flags() -> dict[str, Column]:
    o, h, l, c, v = (F.col(x) for x in NEEDED[2:])
    return {"low_above_high": l > h, "open_outside": (o < l) | (o > h), "close_outside": (c < l) | (c > h), "negative_volume": v < 0,
            "null_close": c.isNull(), "null_volume": v.isNull(), "inf_close": F.abs(c) == float("inf"), "nonpositive_close": c <= 0}


def checked(bars: DataFrame, every: str = "month", jump: float = 0.10) -> DataFrame:
    """``bars`` with ``_quality`` on the last row of each symbol and calendar slice (``every`` as in ``date_trunc``)."""
    require_columns(bars, NEEDED, "checked write")
    w = Window.partitionBy("symbol", "_slice").orderBy(*NEEDED[1:])
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = bars.withColumn("_slice", F.date_trunc(every, "ts")).withColumns({
        "_again": (F.row_number().over(w) > 1) & F.lag("ts").over(w).eqNullSafe(F.col("ts")),
        "_r": F.when(F.col("ts").isNotNull(), F.try_divide(F.col("close"), F.lag("close").over(w)) - 1),
        "_last": F.lead(F.lit(1)).over(w).isNull(),
    })

    def count(pred: Column) -> Column:
        return F.count_if(pred).over(so_far)

    parts = {"slice": F.col("_slice"), "n_rows": F.count(F.lit(1)).over(so_far), "duplicate_ts": count(F.col("_again")),
             **{k: count(p) for k, p in _flags().items()},
             "first_ts": F.min("ts").over(so_far), "last_ts": F.max("ts").over(so_far),
             "first_close": F.first("close").over(so_far), "last_close": F.col("close")}
    for c in ("close", "volume"):
        parts |= {f"min_{c}": F.min(c).over(so_far), f"max_{c}": F.max(c).over(so_far), f"sum_{c}": F.sum(c).over(so_far),
                  f"n_{c}": F.count(c).over(so_far)}
    parts |= {"n_ret": F.count("_r").over(so_far), "mean_ret": F.avg("_r").over(so_far), "var_ret": F.var_pop("_r").over(so_far),
              "min_ret": F.min("_r").over(so_far), "max_ret": F.max("_r").over(so_far), "jumps": count(F.abs("_r") > jump),
              "jump": F.lit(float(jump))}
    quality = F.when(F.col("_last"), F.struct(*(v.alias(k) for k, v in parts.items())))
    return d.withColumn(QUALITY, quality).select(*bars.columns, QUALITY)


def write_checked(bars: DataFrame, path: str, every: str = "month", jump: float = 0.10, mode: str = "overwrite",
                  rows_per_file: int = 5_000_000) -> dict:
    """Write ``bars`` with their slice checks; the totals of this write (``rows_out``, ``duplicate_ts`` and the flag counts)."""
    seen = Observation()
    out = checked(bars, every, jump)
    totals = [F.count(F.lit(1)).alias("rows_out"), F.coalesce(F.sum(f"{QUALITY}.duplicate_ts"), F.lit(0)).alias("duplicate_ts")]
    out = out.observe(seen, *totals, *(F.count_if(p).alias(k) for k, p in _flags().items()))
    out.write.mode(mode).option("maxRecordsPerFile", rows_per_file).parquet(path)
    return seen.get


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """The bars of a checked table."""
    return spark.read.parquet(path).drop(QUALITY)


def slices(spark: SparkSession, path: str) -> DataFrame:
    """One row per symbol and slice with its checks; reads two columns."""
    d = spark.read.parquet(path).filter(F.col(QUALITY).isNotNull())
    return d.select("symbol", f"{QUALITY}.*")


def bar_report(spark: SparkSession, path: str) -> DataFrame:
    """``quality.bar_report`` of the written bars."""
    names = ["duplicate_ts", "low_above_high", "open_outside", "close_outside", "negative_volume"]
    return slices(spark, path).groupBy("symbol").agg(F.sum("n_rows").alias("rows_out"), *(F.sum(c).alias(c) for c in names))


def density(spark: SparkSession, path: str, low: float = 20.0) -> DataFrame:
    """``quality.density`` of the written bars."""
    out = slices(spark, path).groupBy("symbol").agg(
        F.sum("n_rows").alias("n_rows"), F.datediff(F.max("last_ts"), F.min("first_ts")).alias("days"))
    per_day = F.col("n_rows") / F.greatest("days", F.lit(1))
    return out.withColumn("bars_per_day", per_day).withColumn("low_density", F.col("bars_per_day") < low)


def value_report(spark: SparkSession, path: str) -> DataFrame:
    """``quality.value_report`` of the written bars, with the jump size they were checked for.

    The return into a slice is one more observation; deviations come from the counts, means and variances of the slices. A symbol's
    slices are ordered in one task: one short row per calendar slice, whatever the number of bars.
    """
    w = Window.partitionBy("symbol").orderBy("slice", "first_ts")
    seam = F.when(F.col("slice").isNotNull() & F.lag("slice").over(w).isNotNull(), F.try_divide(F.col("first_close"), F.lag("last_close").over(w)) - 1)
    d = slices(spark, path).withColumn("seam", seam)
    n = F.sum(F.col("n_ret") + F.col("seam").isNotNull().cast("long"))
    total = F.sum(F.coalesce(F.col("n_ret") * F.col("mean_ret"), F.lit(0.0)) + F.coalesce("seam", F.lit(0.0)))
    square = F.sum(F.coalesce(F.col("n_ret") * (F.col("var_ret") + F.col("mean_ret") * F.col("mean_ret")), F.lit(0.0))
                   + F.coalesce(F.col("seam") * F.col("seam"), F.lit(0.0)))
    counts = ("n_rows", "null_close", "null_volume", "inf_close", "nonpositive_close")
    merged = d.groupBy("symbol").agg(
        *(F.sum(c).alias(c) for c in counts),
        *(x for c in ("close", "volume") for x in (F.min(f"min_{c}").alias(f"min_{c}"), F.max(f"max_{c}").alias(f"max_{c}"),
                                                   F.try_divide(F.sum(f"sum_{c}"), F.sum(f"n_{c}")).alias(f"mean_{c}"))),
        n.alias("_n"), total.alias("_t"), square.alias("_s"), F.min(F.least("min_ret", "seam")).alias("min_ret"),
        F.max(F.greatest("max_ret", "seam")).alias("max_ret"),
        F.sum(F.col("jumps") + F.coalesce((F.abs("seam") > F.col("jump")).cast("long"), F.lit(0))).alias("jumps"))
    mean = F.try_divide("_t", "_n")
    std = F.when(F.col("_n") > 1, F.sqrt(F.greatest((F.col("_s") - F.col("_t") * mean) / F.greatest(F.col("_n") - 1, F.lit(1)), F.lit(0.0))))
    return merged.select("symbol", *counts, "min_close", "max_close", "mean_close", "min_volume", "max_volume", "mean_volume",
                         mean.alias("mean_ret"), std.alias("std_ret"), "min_ret", "max_ret", "jumps")
