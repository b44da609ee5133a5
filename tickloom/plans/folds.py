"""Time folds that keep the future out of training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.blocks import KEYS, join_safe


def month_folds(df: DataFrame, n_folds: int = 6, purge: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Expanding months: fold i trains on months 0..i and tests on month i+1.

    A row appears once per fold it belongs to, with ``fold`` and ``role``.  Fewer
    months give fewer folds.  ``purge`` drops the last training rows (by ``bar``)
    whose label horizon would reach into the test month.
    """
    m = F.trunc(F.to_date("ts"), "MM")
    d = df.withColumn("_month", m)
    calendar = d.select("_month").distinct()
    every = Window.partitionBy(F.lit(1))  # over the months of the calendar
    calendar = calendar.withColumn("_rank", F.row_number().over(every.orderBy("_month")) - 1).withColumn(
        "_folds", F.least(F.lit(n_folds), F.greatest(F.count(F.lit(1)).over(every) - 1, F.lit(1))).cast("int")
    )
    d = join_safe(d, calendar, ["_month"])
    train = F.when(
        F.col("_rank") <= F.col("_folds") - 1,
        F.transform(F.sequence(F.col("_rank"), F.col("_folds") - 1), lambda i: F.struct(i.cast("int").alias("fold"), F.lit("train").alias("role"))),
    ).otherwise(F.array().cast("array<struct<fold:int,role:string>>"))
    test = F.when(
        (F.col("_rank") >= 1) & (F.col("_rank") <= F.col("_folds")),
        F.array(F.struct((F.col("_rank") - 1).cast("int").alias("fold"), F.lit("test").alias("role"))),
    ).otherwise(F.array().cast("array<struct<fold:int,role:string>>"))
    out = d.withColumn("_f", F.explode(F.concat(train, test))).select(
        *df.columns, F.col("_f.fold").alias("fold"), F.col("_f.role").alias("role")
    )
    return _purge(out, purge, keys)


def rolling_folds(df: DataFrame, train: int, test: int, step: int, purge: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sliding windows of bars: fold k trains on [k*step, k*step+train) and tests on the next ``test`` bars.

    Folds without a test row are left out.
    """
    b, none = F.col("bar"), F.array().cast("array<struct<fold:int,role:string>>")

    def members(pos, width, role):
        lo = F.greatest(F.ceil((pos - width + 1) / step), F.lit(0))
        hi = F.floor(pos / step)
        rows = F.transform(F.sequence(lo, hi), lambda k: F.struct(k.cast("int").alias("fold"), F.lit(role).alias("role")))
        return F.when((pos >= 0) & (lo <= hi), rows).otherwise(none)

    size = df.groupBy(*keys).agg(F.max("bar").alias("_n"))
    out = join_safe(df, size, keys).withColumn("_f", F.explode(F.concat(members(b, train, "train"), members(b - train, test, "test"))))
    out = out.filter(F.col("_f.fold") * step + train <= F.col("_n"))
    out = out.select(*df.columns, F.col("_f.fold").alias("fold"), F.col("_f.role").alias("role"))
    return _purge(out, purge, keys)


def split_folds(df: DataFrame, n_splits: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Successive splits: the last ``n_splits`` equal blocks are tests, everything before trains."""
    size = df.groupBy(*keys).agg((F.max("bar") + 1).alias("_n"))
    d = join_safe(df, size, keys).withColumn("_w", F.floor(F.col("_n") / (n_splits + 1)))
    rows = F.array(*[
        F.struct(F.lit(i).alias("fold"), (F.col("_n") - (n_splits - i) * F.col("_w")).alias("s")) for i in range(n_splits)
    ])
    d = d.withColumn("_f", F.explode(rows))
    b = F.col("bar")
    role = F.when(b < F.col("_f.s"), "train").when(b < F.col("_f.s") + F.col("_w"), "test")
    return d.withColumn("role", role).filter("role is not null").select(*df.columns, F.col("_f.fold").alias("fold"), "role")


def _purge(df: DataFrame, purge: int, keys: Sequence[str]) -> DataFrame:
    if purge <= 0:
        return df
    start = df.filter("role = 'test'").groupBy(*keys, "fold").agg(F.min("bar").alias("_t"))
    out = join_safe(df, start, [*keys, "fold"])
    keep = (F.col("role") == "test") | F.col("_t").isNull() | (F.col("bar") + purge < F.col("_t"))
    return out.filter(keep).select(*df.columns)
