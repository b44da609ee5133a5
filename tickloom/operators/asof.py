"""Time alignment between tables: as-of lookups, union time axis, forward fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.blocks import KEYS, join_safe


def _asof(left: DataFrame, right: DataFrame, cols: Sequence[str], keys: Sequence[str], ts: str, width_s: int,
          forward: bool) -> DataFrame:
    """Common part: merge both sides by time inside slices, carry values across slices."""
    keys = list(keys)
    lcols = [c for c in left.columns if c not in keys and c != ts]
    sl = F.floor(F.unix_seconds(F.col(ts)) / width_s).alias("_sl")
    pay = F.struct(F.col(ts).alias("match_ts"), *cols)
    nil = F.lit(None)
    lrow = left.select(*keys, F.col(ts), sl, F.lit(True).alias("_left"), F.struct(*[F.col(c) for c in lcols]).alias("_l")
                       if lcols else F.struct(F.lit(1).alias("_")).alias("_l"))
    rrow = right.filter(F.col(ts).isNotNull()).select(*keys, F.col(ts), sl, F.lit(False).alias("_left"), pay.alias("_r"))
    rrow = rrow.withColumn("_l", nil.cast(lrow.schema["_l"].dataType))
    lrow = lrow.withColumn("_r", nil.cast(rrow.schema["_r"].dataType))
    both = lrow.unionByName(rrow)
    # equal times match: right rows must come before left rows in looking direction
    if forward:
        w = Window.partitionBy(*keys, "_sl").orderBy(F.col(ts).desc(), F.col("_left").asc())
        edge = F.min_by("_r", F.when(~F.col("_left"), F.col(ts)))
        over = Window.partitionBy(*keys).orderBy(F.col("_sl").desc()).rowsBetween(Window.unboundedPreceding, -1)
    else:
        w = Window.partitionBy(*keys, "_sl").orderBy(F.col(ts).asc(), F.col("_left").asc())
        edge = F.max_by("_r", F.when(~F.col("_left"), F.col(ts)))
        over = Window.partitionBy(*keys).orderBy(F.col("_sl").asc()).rowsBetween(Window.unboundedPreceding, -1)
    local = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    edges = both.groupBy(*keys, "_sl").agg(edge.alias("_e"))
    edges = edges.select(*keys, "_sl", F.last("_e", ignorenulls=True).over(over).alias("_e"))
    hit = both.withColumn("_m", local).filter("_left")
    hit = join_safe(hit, edges, [*keys, "_sl"])
    hit = hit.withColumn("_m", F.coalesce("_m", "_e"))
    return hit.select(*keys, ts, *[F.col("_l")[c].alias(c) for c in lcols],
                      F.col("_m.match_ts").alias("match_ts"), *[F.col("_m")[c].alias(c) for c in cols])


def asof_backward(left: DataFrame, right: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS, ts: str = "ts",
                  width_s: int = 21600, defaults: dict[str, float] | None = None) -> DataFrame:
    """For each left row the last right row at or before it, plus its time ``match_ts``.

    Right rows must be unique per (keys, ts).  Work is split into time slices of
    ``width_s`` seconds; one value per slice is carried over.
    """
    out = _asof(left, right, cols, keys, ts, width_s, forward=False)
    return out.fillna(defaults) if defaults else out


def asof_forward(left: DataFrame, right: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS, ts: str = "ts",
                 width_s: int = 21600) -> DataFrame:
    """For each left row the first right row at or after it (signal to next bar)."""
    return _asof(left, right, cols, keys, ts, width_s, forward=True)


def union_axis(df: DataFrame, cols: Sequence[str], symbols: Sequence[str] | None = None, width_s: int = 21600) -> DataFrame:
    """Every symbol on the union of all times, values carried forward.

    The result has times x symbols rows by its nature. The symbols are those of the data (one
    aggregated array, attached to each distinct time) unless a universe is given.
    """
    every = df.agg(F.array_sort(F.collect_set("symbol"))).scalar() if symbols is None else F.array(*[F.lit(s) for s in symbols])
    axis = df.select("ts").distinct().withColumn("symbol", F.explode(every))
    return asof_backward(axis, df, cols, width_s=width_s)


def carry_forward(df: DataFrame, col: str, default: float | Column | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Fill nulls of ``col`` with the last value before them, then with ``default`` (needs ``bar``)."""
    from tickloom.operators.blocks import prefix

    out = prefix(df, {"_ff": ("last", F.col(col))}, keys=keys)
    d = default if isinstance(default, Column) else F.lit(default)
    return out.withColumn(col, F.coalesce("_ff", d)).drop("_ff")
