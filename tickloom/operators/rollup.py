"""Reports at several levels (per symbol and strategy, per symbol, overall) from one pass over the trades.

Trades are summed up once at the finest level into numbers that merge: counts, sums, and squares about the level's own mean. The
coarser levels are grouping sets over those few rows, so trades are neither read again nor multiplied by the number of levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import finite
from tickloom.schema import require_columns


def pnl_moments(df: DataFrame, pnl: str, dims: Sequence[str]) -> DataFrame:
    """Mergeable numbers of trade profits per combination of ``dims``; nulls and values that are not finite count as no trade."""
    require_columns(df, [*dims, pnl], "report levels")
    x = finite(pnl)
    return df.groupBy(*dims).agg(
        F.count(x).alias("_n"), F.coalesce(F.sum(x), F.lit(0.0)).alias("_s"), F.avg(x).alias("_mean"), (F.var_pop(x) * F.count(x)).alias("_m2"),
        F.count_if(x > 0).alias("_w"), F.count_if(x < 0).alias("_l"), F.min(x).alias("_min"), F.max(x).alias("_max"))


def pnl_levels(df: DataFrame, pnl: str, dims: Sequence[str], levels: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Profit metrics per level.

    ``levels`` are subsets of ``dims``; by default the roll-up: all dims, then without the last, and so on to the total. ``level``
    is the grouping id (a bit per dim, the first highest, 1 where the dim is summed up), which tells a null value of a dim from a
    summed-up dim. Without trades a level has zeros and a null win rate; an empty table has no rows but the total of the levels
    that ask for it.
    """
    dims = list(dims)
    levels = [dims[:i] for i in range(len(dims), -1, -1)] if levels is None else [list(v) for v in levels]
    unknown = sorted({d for v in levels for d in v} - set(dims))
    if unknown:
        raise ValueError(f"levels use columns that are no dims: {', '.join(unknown)}")
    fine = pnl_moments(df, pnl, dims)
    # distances from one common middle keep the squares of the means small
    middle = fine.agg(F.try_divide(F.sum("_s"), F.sum("_n"))).scalar()
    fine = fine.withColumn("_d", F.coalesce(F.col("_mean") - middle, F.lit(0.0)))
    n, total = F.sum("_n"), F.sum("_s")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    drift = F.sum(F.col("_n") * F.col("_d"))
    squares = F.greatest(F.sum("_m2") + F.sum(F.col("_n") * F.col("_d") * F.col("_d")) - F.try_divide(drift * drift, n), F.lit(0.0))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return fine.groupingSets([[F.col(c) for c in v] for v in levels], *dims).agg(
        F.grouping_id().cast("int").alias("level"), count("_n").alias("trades"), zero(total).alias("pnl_sum"),
        zero(F.try_divide(total, n)).alias("pnl_mean"), zero(F.when(n > 1, F.sqrt(F.try_divide(squares, n - 1)))).alias("pnl_std"),
        count("_w").alias("wins"), count("_l").alias("losses"), _share("_w", n).alias("win_rate"), F.min("_min").alias("pnl_min"),
        F.max("_max").alias("pnl_max"))


def _share(c: str, n: Column) -> Column:
    return F.try_divide(F.sum(c).cast("double"), n.cast("double"))
