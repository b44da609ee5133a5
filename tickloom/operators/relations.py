"""Keyed joins and set operations of the trade and bar tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Key sets tried for matching trades with signals, in this order.
TRADE_KEYS = [["ts", "symbol", "side"], ["dt", "symbol", "side"], ["ts", "symbol"], ["dt", "symbol"]]


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], keep: str = "last") -> DataFrame:
    """One row per key: the first or last in a given order (deterministic, unlike dropDuplicates).

    An aggregate rather than a window: duplicates of a hot key are folded before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*order) if len(order) > 1 else (F.col(order[0]) if isinstance(order[0], str) else order[0])
    pick = F.max_by if keep == "last" else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), by).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def match_trades(trades: DataFrame, signals: DataFrame, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Left-join signal columns on the first key set both tables have; signals unique per key."""
    for keys in TRADE_KEYS:
        if all(k in trades.columns and k in signals.columns for k in keys):
            right = dedup(signals.select(*keys, *[c for c in dict.fromkeys([*cols, *order]) if c not in keys]), keys, order, "first")
            return trades.join(right.select(*keys, *cols), keys, "left")
    raise ValueError("trades and signals share no usable key set")


def merge_sources(frames: Sequence[DataFrame], ts: str = "ts", keep: str = "last", page: str | None = None) -> DataFrame:
    """Union of tables in priority order, one row per (symbol, ts).

    ``last``: later tables win; ``first``: earlier ones.  ``page`` breaks ties within a table.
    """
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_prio", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return dedup(out, ["symbol", ts], ["_prio"] + ([page] if page else []), keep).drop("_prio")


def prefer(processed: DataFrame, raw: DataFrame) -> DataFrame:
    """Processed rows where a symbol has any, raw rows of the other symbols."""
    rest = raw.join(processed.select("symbol").distinct(), "symbol", "left_anti")
    return processed.unionByName(rest, allowMissingColumns=True)


def with_data(df: DataFrame, universe: DataFrame) -> DataFrame:
    return universe.join(df.select("symbol").distinct(), "symbol", "left_semi")


def without_data(df: DataFrame, universe: DataFrame) -> DataFrame:
    return universe.join(df.select("symbol").distinct(), "symbol", "left_anti")


def pivot_symbols(df: DataFrame, symbols: Sequence[str], value: str = "side") -> DataFrame:
    """Time x symbol matrix with 0 for missing cells; the symbol list is given, so no extra pass.

    ``n_other`` counts the rows of a time whose symbol is not in the list (a null one included), so none goes unseen.
    """
    other = F.count_if(~F.coalesce(F.col("symbol").isin(list(symbols)), F.lit(False))).alias("n_other")
    cells = [F.max(F.when(F.col("symbol") == s, F.col(value))).alias(s) for s in symbols]
    return df.groupBy("ts").agg(*cells, other).na.fill(0, list(symbols))


def average_per_time(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean over symbols of each column per time."""
    return df.groupBy("ts").agg(*[F.avg(c).alias(c) for c in cols], F.count(F.lit(1)).alias("n_symbols"))


def common_times(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("symbol", "ts").intersect(b.select("symbol", "ts"))


def all_times(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("symbol", "ts").union(b.select("symbol", "ts")).distinct()


