"""Runs of a held direction as trades, and streak lengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import indicators as I
from tickloom.operators.blocks import KEYS, blocked, core, join_safe, prefix
from tickloom.operators.ledger import COMMISSION, SLIPPAGE_BPS
from tickloom.schema import require_columns
from tickloom.session import cut


def label_episodes(df: DataFrame, side: str = "signal", keys: Sequence[str] = KEYS,
                   carry: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """``carry`` names more running values (see ``prefix``) to take along; they may use ``is_start``.

    Bar log: adds ``trade_id`` (1, 2, ... per key; null while flat) and the next bar's close and time."""
    require_columns(df, [*keys, "bar", "ts", "close", side], "episodes")
    s = F.coalesce(F.col(side), F.lit(0))
    d = blocked(df, back=1, ahead=1)
    d = d.withColumns(
        {
            "_start": ((s != 0) & (s != F.coalesce(I.lag(s, 1, keys), F.lit(0)))).cast("long"),
            "next_close": I.lead("close", 1, keys),
            "next_ts": I.lead("ts", 1, keys),
        }
    ).withColumn("is_start", F.col("_start"))
    d = prefix(cut(core(d)), {"trade_id": ("sum", F.col("is_start")), **(carry or {})}, keys=keys)
    return d.withColumn("trade_id", F.when(s != 0, F.col("trade_id"))).drop("is_start")


def trade_log(df: DataFrame, side: str = "signal", commission: float = COMMISSION, slippage_bps: float = SLIPPAGE_BPS,
              keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per run of a direction, unit quantity.

    Entry at the close of the first bar; exit at the close of the bar on which the
    signal changes, or at the last close for a run still open at the end.
    Costs: commission on both sides and slippage, on the exit value.
    """
    bars = label_episodes(df, side, keys).filter(F.col("trade_id").isNotNull())
    d = F.col(side)
    g = bars.groupBy(*keys, "trade_id").agg(
        F.min("ts").alias("entry_ts"), F.max("ts").alias("last_ts"),
        F.min_by("close", "bar").alias("entry_price"), F.max_by("close", "bar").alias("last_close"),
        F.max_by("next_close", "bar").alias("next_close"), F.max_by("next_ts", "bar").alias("next_ts"),
        F.first(d).alias("direction"), F.count(F.lit(1)).alias("bars_held"),
        F.max(d * F.col("close")).alias("_best"), F.min(d * F.col("close")).alias("_worst"),
    )
    closed = F.col("next_ts").isNotNull()
    g = g.withColumns(
        {
            "exit_ts": F.coalesce("next_ts", "last_ts"),
            "exit_price": F.when(closed, F.col("next_close")).otherwise(F.col("last_close")),
            "exit_reason": F.when(closed, "signal_change").otherwise("open"),
        }
    )
    e, x, s = F.col("entry_price"), F.col("exit_price"), F.col("direction")
    cost = x * F.lit(2.0 * commission + slippage_bps / 10_000.0)
    g = g.withColumns({"pnl_gross": (x - e) * s, "pnl_abs": (x - e) * s - cost})
    return g.select(
        *keys, "trade_id", "entry_ts", "exit_ts", "entry_price", "exit_price", "direction", "bars_held",
        F.try_divide("pnl_gross", e).alias("ret_gross"), "pnl_abs", F.try_divide("pnl_abs", e).alias("ret_net"),
        F.greatest(F.col("_best") - s * e, F.lit(0.0)).alias("mfe"),
        F.least(F.col("_worst") - s * e, F.lit(0.0)).alias("mae"), "exit_reason",
    )


def bar_log(df: DataFrame, side: str = "signal", keys: Sequence[str] = KEYS) -> DataFrame:
    """Per bar: direction, episode number and the open profit of the unit position at the close."""
    d = label_episodes(df, side, keys, {"entry_price": ("last", F.when(F.col("is_start") == 1, F.col("close")))})
    d = d.withColumn("entry_price", F.when(F.col("trade_id").isNotNull(), F.col("entry_price")))
    return d.withColumn("open_pnl", F.coalesce((F.col("close") - F.col("entry_price")) * F.col(side), F.lit(0.0)))


def streaks(df: DataFrame, flag: Column, keys: Sequence[str] = KEYS, prefix_name: str = "hold") -> DataFrame:
    """Average and longest run of consecutive rows with the flag, per key."""
    d = df.select(*keys, "bar", F.coalesce(flag, F.lit(False)).alias("f"))
    d = blocked(d, back=1)
    d = core(d.withColumn("start", (F.col("f") & ~F.coalesce(I.lag("f", 1, keys), F.lit(False))).cast("long")))
    d = prefix(d, {"run": ("sum", F.col("start"))}, keys=keys).filter("f")
    runs = d.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("n"))
    out = runs.groupBy(*keys).agg(F.avg("n").alias(f"avg_{prefix_name}"), F.max("n").alias(f"max_{prefix_name}"))
    return join_safe(df.select(*keys).distinct(), out, keys).na.fill(0)
