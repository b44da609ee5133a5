"""Quantiles of any date range from small sketches kept per key and day.

``quantiles.exact_quantiles`` reads every value of the range. Here each (key, day, column) is summarised once by a KLL
sketch of bounded size; sketches merge, so a range costs its days, not its rows, and a late bar costs one day. The rank of a
returned value is off by at most ``rank_error(k)`` of the rows with a probability of 99 %, whatever the number of merges;
counts, minima and maxima are exact. Sketches draw random bits: two runs may return different values within that error.

Nulls and NaN are left out, as in the exact form. Null keys are a key of their own; rows without a time are the day null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.blocks import KEYS, join_safe
from tickloom.schema import require_columns

K = 800
PARTS = ("min_x", "max_x", "n", "sketch")


def rank_error(k: int = K) -> float:
    """Share of the rows by which a rank may be off, at 99 % confidence: the published fit for KLL sketches."""
    return 2.296 / k**0.9723


def day_sketches(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS, ts: str = "ts", k: int = K) -> DataFrame:
    """One row per key, day and column: ``n``, ``min_x``, ``max_x`` and ``sketch``; combined before the shuffle."""
    require_columns(df, [*keys, ts, *cols], "quantile sketches")
    long = df.select(*keys, F.to_date(ts).alias("day"), *[F.col(c).cast("double").alias(c) for c in cols])
    long = long.unpivot([*keys, "day"], list(cols), "feature", "x").filter(F.col("x").isNotNull() & ~F.isnan("x"))
    return long.groupBy(*keys, "day", "feature").agg(
        F.count("x").alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.kll_sketch_agg_double("x", k).alias("sketch"))


def write_days(sketches: DataFrame, path: str) -> None:
    """Put days into a table; days that are there already are replaced whole, the others stay."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """The days from ``since`` up to and without ``until``; only their folders are read."""
    d = spark.read.parquet(path)
    d = d.withColumn("day", F.col("day").cast("date"))
    if since is not None:
        d = d.filter(F.col("day") >= F.lit(since).cast("date"))
    return d if until is None else d.filter(F.col("day") < F.lit(until).cast("date"))


def merge(sketches: DataFrame, group: Sequence[str] = (*KEYS, "feature"), k: int = K) -> DataFrame:
    """Sketches of coarser groups, for example a key's days or all keys together; partial merges go before the shuffle."""
    return sketches.groupBy(*group).agg(F.sum("n").alias("n"), F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"),
                                        F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantiles(sketches: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Long form: the columns beside the sketch, ``q`` and ``value``. Probabilities 0 and 1 are the exact ends."""
    plain = [c for c in sketches.columns if c not in PARTS]

    def at(p: float):
        if p in (0.0, 1.0):
            return F.col("min_x" if p == 0.0 else "max_x")
        return F.kll_sketch_get_quantile_double("sketch", F.lit(p))

    pairs = [F.struct(F.lit(p).alias("q"), at(p).alias("value")) for p in map(float, probs)]
    return sketches.select(*plain, "n", F.inline(F.array(*pairs)))


def distribution(sketches: DataFrame, group: Sequence[str] = (*KEYS, "feature"), k: int = K) -> DataFrame:
    """Count, min, quartiles and max per group, like ``metrics.distribution``, from sketches."""
    s = merge(sketches, group, k)
    at = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(p))
    return s.select(*group, "n", "min_x", at(0.25).alias("p25"), at(0.5).alias("median_x"), at(0.75).alias("p75"), "max_x")


def rank_misses(df: DataFrame, found: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """How far the ranks of found values lie from the wanted ones in the rows of ``df``: ``found`` with ``miss`` (share of rows).

    ``found``: keys, ``feature``, ``q``, ``value``, a few rows per key; the rows of ``df`` are counted against them.
    """
    cols = [r[0] for r in found.select("feature").distinct().collect()]  # column names
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(keys), cols, "feature", "x")
    # equal values are one row before they meet the wanted ranks
    long = long.filter(F.col("x").isNotNull() & ~F.isnan("x")).groupBy(*keys, "feature", "x").agg(F.count(F.lit(1)).alias("_m"))
    met = join_safe(long, found, [*keys, "feature"], "inner")
    share = lambda c: F.sum(F.when(c, F.col("_m")).otherwise(0)) / F.sum("_m")
    g = met.groupBy(*keys, "feature", "q", "value").agg(share(F.col("x") < F.col("value")).alias("_lo"), share(F.col("x") <= F.col("value")).alias("_hi"))
    miss = F.greatest(F.col("_lo") - F.col("q"), F.col("q") - F.col("_hi"), F.lit(0.0))
    return g.withColumn("miss", miss).drop("_lo", "_hi")
