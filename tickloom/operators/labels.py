"""Forward-looking labels; rows whose horizon is not complete are null (drop them for training)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import indicators as I
from tickloom.operators.blocks import KEYS, blocked, core


def add_labels(bars: DataFrame, horizon: int = 6, move: float = 0.003, sigma: float = 2.0, vol_n: int = 20,
               keys: Sequence[str] = KEYS) -> DataFrame:
    """Forward return and the labels derived from it, in one pass.

    ``y_up`` 1 when the price rises; ``y_move`` 1 when it moves more than ``move``;
    ``y_adaptive`` -1/0/1 against ``sigma`` trailing deviations (0.01 during warm-up).
    """
    df = blocked(bars, back=vol_n + 1, ahead=horizon)
    df = df.withColumns({"fwd_ret": F.try_divide(I.lead("close", horizon, keys), F.col("close")) - 1.0,
                         "_r": I.pct_change("close", 1, keys)})
    df = df.withColumn("_th", sigma * F.coalesce(I.rolling("_r", vol_n, "std", keys=keys), F.lit(0.01)))
    f = F.col("fwd_ret")
    known = lambda e: F.when(f.isNotNull(), e)
    return core(
        df.withColumns(
            {
                "y_up": known((f > 0).cast("int")),
                "y_move": known((F.abs(f) > move).cast("int")),
                "y_adaptive": known(F.when(f > F.col("_th"), 1).when(f < -F.col("_th"), -1).otherwise(0)),
            }
        )
    )


def add_direction(bars: DataFrame, horizon: int = 3, out: str = "y_dir", keys: Sequence[str] = KEYS) -> DataFrame:
    """Sign of the move over the next bars."""
    df = blocked(bars, ahead=horizon)
    nxt = I.lead("close", horizon, keys)
    return core(df.withColumn(out, F.when(nxt.isNotNull(), F.signum(nxt - F.col("close")).cast("int"))))


def label_quality(df: DataFrame, label: str = "y_adaptive", ret: str = "fwd_ret", keys: Sequence[str] = ()) -> DataFrame:
    """Rows and mean forward return per class."""
    return df.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), F.avg(ret).alias("mean_ret"))


def training_set(df: DataFrame, features: Sequence[str], label: str, drop_nulls: bool = True,
                 extra: Sequence[str] = ()) -> DataFrame:
    """Features and label of all symbols; null features are dropped or become 0, null labels are dropped."""
    out = df.select("symbol", "ts", "bar", *extra, *features, F.col(label).cast("double").alias("label")).filter("label is not null")
    return out.na.drop(subset=list(features)) if drop_nulls else out.na.fill(0.0, list(features))


def align(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features with labels on (symbol, ts) when they come from different tables."""
    return features.join(labels, ["symbol", "ts"])
