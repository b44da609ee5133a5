"""First barrier hit after an entry: stop, take, trailing stop or time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.blocks import KEYS
from tickloom.schema import require_columns


@dataclass(frozen=True)
class Barriers:
    """Distances are shares of the entry price, or multiples of ATR with ``unit='atr'``.

    ``intrabar`` tests high and low and exits at the level; otherwise closes are
    tested and the exit is the close.  ``atr_at``: 'entry' or 'current'.
    """

    stop: float | None = 0.02
    take: float | None = 0.04
    trail: float | None = None
    max_hold: int = 120
    unit: str = "pct"
    intrabar: bool = False
    atr_at: str = "entry"


def following_bars(entries: DataFrame, bars: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Range join: each entry (``e_*`` columns) with the bars 1..n after it.

    Equi-join on the key and a bucket of n positions (an entry touches at most two
    buckets), so a hot symbol is spread over its buckets and the fan-out is n.
    Entries without a later bar stay, with nulls.
    """
    keys = list(keys)
    e = entries.withColumn(
        "_bk", F.explode(F.array_distinct(F.array(F.floor((F.col("e_bar") + 1) / n), F.floor((F.col("e_bar") + n) / n))))
    )
    b = bars.withColumn("_bk", F.floor(F.col("bar") / n)).alias("b")
    e = e.alias("e")
    on = (F.col("e._bk") == F.col("b._bk")) & (F.col("b.bar") > F.col("e.e_bar")) & (F.col("b.bar") <= F.col("e.e_bar") + n)
    for k in keys:
        on = on & F.col(f"e.{k}").eqNullSafe(F.col(f"b.{k}"))
    rest = [F.col(f"b.{c}") for c in bars.columns if c not in keys]
    return e.join(b, on, "left").select(*[F.col(f"e.{c}") for c in entries.columns], *rest)


def barrier_outcomes(bars: DataFrame, rule: Barriers = Barriers(), side: str = "side", keys: Sequence[str] = KEYS) -> DataFrame:
    """Outcome per entry (rows with a non-zero side); entries do not influence each other.

    Ties on one bar resolve stop, take, trail, time.  ``open`` means the data ended first.
    """
    return outcomes_by_rule(bars, {"": rule}, side, keys).drop("rule")


def _first_hit(rule: Barriers) -> tuple[Column, Column]:
    """Name and price of the barrier that a joined bar hits, if any."""
    s, e, c = F.col("direction"), F.col("entry_price"), F.col("close")
    unit = e if rule.unit != "atr" else F.col("e_atr") if rule.atr_at == "entry" else F.col("atr")
    worst = F.when(s > 0, F.col("low")).otherwise(F.col("high")) if rule.intrabar else c
    best = F.when(s > 0, F.col("high")).otherwise(F.col("low")) if rule.intrabar else c
    order = []
    if rule.stop is not None:
        level = e - s * rule.stop * unit
        order.append(((worst - level) * s <= 0, "stop", level if rule.intrabar else c))
    if rule.take is not None:
        level = e + s * rule.take * unit
        order.append(((best - level) * s >= 0, "take", level if rule.intrabar else c))
    if rule.trail:
        order.append((s * c <= F.col("_top") - rule.trail * unit, "trail", c))
    order.append((F.col("bar") >= F.col("e_bar") + rule.max_hold, "time", c))
    hit, px = F.lit(None).cast("string"), F.lit(None).cast("double")
    for cond, name, price in reversed(order):
        hit = F.when(cond, name).otherwise(hit)
        px = F.when(cond, price).otherwise(px)
    return hit, px


def outcomes_by_rule(bars: DataFrame, rules: Mapping[str, Barriers], side: str = "side", keys: Sequence[str] = KEYS) -> DataFrame:
    """Outcomes of every entry under every named rule (column ``rule``): one range join, one aggregate for all of them."""
    keys = list(keys)
    atr = ["atr"] if any(r.unit == "atr" for r in rules.values()) else []
    require_columns(bars, [*keys, "bar", "ts", "high", "low", "close", side, *atr], "barriers")
    ents = bars.filter(F.coalesce(F.col(side), F.lit(0)) != 0).select(
        *keys, F.col("bar").alias("e_bar"), F.col("ts").alias("entry_ts"), F.col("close").alias("entry_price"),
        F.col(side).alias("direction"), *[F.col(c).alias(f"e_{c}") for c in atr],
    )
    j = following_bars(ents, bars.select(*keys, "bar", "ts", "high", "low", "close", *atr), max(r.max_hold for r in rules.values()), keys)
    s, e, c = F.col("direction"), F.col("entry_price"), F.col("close")
    if any(r.trail for r in rules.values()):
        w = Window.partitionBy(*keys, "e_bar").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
        j = j.withColumn("_top", F.greatest(F.max(s * c).over(w), s * e))
    hits = {f"_{k}{i}": x for i, r in enumerate(rules.values()) for k, x in zip(("hit", "px"), _first_hit(r))}
    j = j.withColumns(hits)
    aggs = []
    for i, r in enumerate(rules.values()):
        near = F.col("bar") <= F.col("e_bar") + r.max_hold
        ref = F.struct("bar", "ts", F.col(f"_hit{i}").alias("outcome"), F.col(f"_px{i}").alias("exit_price"))
        last = F.struct("bar", "ts", F.lit("open").alias("outcome"), c.alias("exit_price"))
        aggs += [F.min(F.when(near & F.col(f"_hit{i}").isNotNull(), ref)).alias(f"h{i}"), F.max(F.when(near, last)).alias(f"o{i}")]
    g = j.groupBy(*keys, "e_bar", "entry_ts", "entry_price", "direction").agg(*aggs)
    none = F.struct(F.col("e_bar").alias("bar"), F.col("entry_ts").alias("ts"), F.lit("open").alias("outcome"), e.alias("exit_price"))
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(f"h{i}", f"o{i}", none).alias("x")) for i, n in enumerate(rules)])
    g = g.withColumn("r", F.explode(rows)).withColumn("x", F.col("r.x"))
    return g.select(
        *keys, F.col("r.rule").alias("rule"), F.col("e_bar").alias("bar"), "entry_ts", "entry_price", "direction",
        F.col("x.ts").alias("exit_ts"), (F.col("x.bar") - F.col("e_bar")).alias("bars_held"),
        F.col("x.outcome").alias("outcome"), F.col("x.exit_price").alias("exit_price"),
        ((F.try_divide("x.exit_price", e) - 1.0) * s).alias("ret"),
    )
