"""Bounded work units for per-symbol time series.

``Window.partitionBy("symbol")`` would put a whole symbol into one task, and one
symbol may hold a third of the table.  Here every row gets a dense position
``bar`` within its symbol, and windows run over fixed-length blocks of positions:

* ``index_bars``  positions without a per-symbol sort (calendar counts + offsets);
* ``blocked``     blocks with copies of the neighbouring rows that a bounded frame
                  needs, so that a frame of n rows never leaves its block;
* ``prefix``      running sum/min/max/last over the whole symbol: per-block totals,
                  a scan over the totals, and a local scan in each block.

Results equal those of the plain per-symbol window; no group exceeds
``size + back + ahead`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 32768
KEYS = ("symbol",)


def join_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys where null equals null, so no row is lost for a null key; the keys stay those of ``left``."""
    keys = list(keys)
    named = right.select(*[F.col(k).alias(f"_j_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(named[f"_j_{k}"]) for k in keys])
    return left.join(named, on, how).drop(*[f"_j_{k}" for k in keys])


def alone(df: DataFrame) -> Column:
    """A negative number per row, far from any slice or block: groups rows without a position into tiny groups."""
    return F.lit(-(1 << 40)) - F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(1 << 40))


def index_bars(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = "ts", every_days: int = 30,
               order: Sequence[str] | None = None, out: str = "bar") -> DataFrame:
    """Add the dense position ``bar`` (0, 1, ...) in time order per key; null keys are a key of their own.

    Rows without a time stay, with a null ``bar``.  Rows are counted per calendar slice first.  A slice holds a bounded number of
    bars (at most one per interval), and the table of counts is bounded by the
    calendar, so neither step collects a symbol.
    """
    keys = list(keys)
    order = list(order or [ts])
    sl = F.coalesce(F.floor(F.unix_seconds(F.col(ts)) / F.lit(86400 * every_days)), alone(df))
    cut_up = df.withColumn("_slice", sl)
    counts = cut_up.filter(F.col(ts).isNotNull()).groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        join_safe(cut_up.withColumn("_rn", F.row_number().over(local)), starts, [*keys, "_slice"])
        .withColumn(out, (F.col("_start") + F.col("_rn") - 1).cast("long"))  # no slice of the calendar: null
        .drop("_slice", "_rn", "_start")
    )


def _div(col: Column | str, n: int) -> Column:
    return F.floor((F.col(col) if isinstance(col, str) else col) / F.lit(n)).cast("long")


def blocked(df: DataFrame, back: int = 0, ahead: int = 0, size: int = BLOCK) -> DataFrame:
    """Assign rows to blocks of ``size`` positions, copying neighbours as needed.

    A row without a position is a block of its own: it stays, and a frame sees nothing but
    itself.  A block also receives the ``back`` rows before it and the ``ahead`` rows
    after it.  Copies are dropped again by ``core``.
    """
    while size < back or size < ahead:
        size *= 2
    if back == 0 and ahead == 0:
        return df.withColumn("_blk", F.coalesce(_div("bar", size), alone(df))).withColumn("_core", F.lit(True))
    first = F.greatest(_div(F.col("bar") - ahead, size), F.lit(0).cast("long"))
    last = _div(F.col("bar") + back, size)
    blocks = F.when(F.col("bar").isNull(), F.array(alone(df))).otherwise(F.sequence(first, last))
    return df.withColumn("_blk", F.explode(blocks)).withColumn("_core", F.col("bar").isNull() | (F.col("_blk") == _div("bar", size)))


def core(df: DataFrame) -> DataFrame:
    """Keep each row once and drop working columns (leading underscore)."""
    return df.filter("_core").drop(*[c for c in df.columns if c.startswith("_")])


def block_window(keys: Sequence[str] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys, "_blk").orderBy("bar")


def trailing(n: int, keys: Sequence[str] = KEYS) -> WindowSpec:
    """The last ``n`` rows including the current one."""
    return block_window(keys).rowsBetween(-(n - 1), 0)


_SCAN = {
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "last": (None, lambda a, b: F.coalesce(b, a)),
}


def prefix(df: DataFrame, scans: dict[str, tuple[str, Column]], keys: Sequence[str] = KEYS,
           order: str = "bar", size: int = BLOCK) -> DataFrame:
    """Running aggregates from the start of each key up to the current row.

    ``scans`` maps an output name to ``(kind, expression)`` with kind ``sum``,
    ``max``, ``min`` or ``last`` (last non-null).  ``df`` is read twice: once,
    column-pruned, for block totals and once for the local scan; ``cut`` it
    first when it is expensive.
    """
    keys = list(keys)
    d = df.withColumn("_pb", F.coalesce(_div(order, size), alone(df)))
    exprs = {name: expr for name, (_, expr) in scans.items()}
    totals = d.select(*keys, "_pb", order, *[e.alias(f"_x_{n}") for n, e in exprs.items()])
    aggs = []
    for name, (kind, _) in scans.items():
        x = F.col(f"_x_{name}")
        if kind == "last":
            aggs.append(F.max_by(x, F.when(x.isNotNull(), F.col(order))).alias(f"_t_{name}"))
        else:
            aggs.append(_SCAN[kind][0](x).alias(f"_t_{name}"))
    totals = totals.filter(F.col(order).isNotNull()).groupBy(*keys, "_pb").agg(*aggs)
    before = Window.partitionBy(*keys).orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)
    carry = []
    for name, (kind, _) in scans.items():
        t = F.col(f"_t_{name}")
        agg = F.last(t, ignorenulls=True) if kind == "last" else _SCAN[kind][0](t)
        carry.append(agg.over(before).alias(f"_c_{name}"))
    carries = totals.select(*keys, "_pb", *carry)
    local = Window.partitionBy(*keys, "_pb").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    here = []
    for name, (kind, _) in scans.items():
        e = exprs[name]
        agg = F.last(e, ignorenulls=True) if kind == "last" else _SCAN[kind][0](e)
        here.append(agg.over(local).alias(f"_l_{name}"))
    out = join_safe(d.select("*", *here), carries, [*keys, "_pb"])
    out = out.withColumns(
        {n: _SCAN[k][1](F.col(f"_c_{n}"), F.col(f"_l_{n}")) for n, (k, _) in scans.items()}
    )
    return out.drop("_pb", *[f"_{p}_{n}" for n in scans for p in "cl"])


def equity_path(df: DataFrame, pnl: Column, equity0: float = 1.0, keys: Sequence[str] = KEYS,
                size: int = BLOCK) -> DataFrame:
    """Add ``equity`` (running sum of ``pnl`` on ``equity0``) and its running ``peak``.

    Both come from one pair of passes: a block is summarised by its total and by
    the highest partial sum it reaches, which is all that later blocks need.
    """
    keys = list(keys)
    d = df.withColumn("_pb", F.coalesce(_div("bar", size), alone(df))).withColumn("_pnl", pnl)
    local = Window.partitionBy(*keys, "_pb").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    part = d.select(*keys, "_pb", "bar", "_pnl").withColumn("_cum", F.sum("_pnl").over(local))
    totals = part.filter("bar is not null").groupBy(*keys, "_pb").agg(F.sum("_pnl").alias("_tot"), F.max("_cum").alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.withColumn("_base", F.coalesce(F.sum("_tot").over(before), F.lit(0.0)))
    base = base.withColumn("_peak_in", F.max(F.col("_base") + F.col("_top")).over(before))
    base = base.select(*keys, "_pb", "_base", "_peak_in")
    out = d.withColumn("_cum", F.sum("_pnl").over(local)).withColumn("_top", F.max("_cum").over(local))
    out = join_safe(out, base, [*keys, "_pb"])
    return (
        out.withColumn("equity", F.col("_base") + F.col("_cum") + F.lit(float(equity0)))
        .withColumn("peak", F.greatest(F.col("_peak_in"), F.col("_base") + F.col("_top")) + F.lit(float(equity0)))
        .drop("_pb", "_pnl", "_cum", "_top", "_base", "_peak_in")
    )
