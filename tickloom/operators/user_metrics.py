"""Metrics that users write in Python, evaluated per key over bars or a ledger.

A metric has two functions. ``partial`` sees one block of a key's rows in the order of ``bar`` and returns a few numbers;
``merge`` sees the numbers of all blocks, one row per block in order, and returns the metric. Both run as
grouped-aggregate ``pandas_udf``s, so a key with a third of all rows is many blocks of bounded size and one short table. Column
aggregates (``Column`` values) stay in the JVM with their partial sums.

Rows without a ``bar`` are a block before all others. A metric that is no finite number is null. Null keys are a key of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.blocks import BLOCK, KEYS, join_safe
from tickloom.schema import require_columns


@dataclass(frozen=True)
class Metric:
    """``partial(*arrays) -> numbers`` of the named columns of a block; ``merge(matrix) -> number`` over the blocks' numbers."""

    columns: tuple[str, ...]
    partial: Callable[..., Sequence[float]]
    merge: Callable[[np.ndarray], float]


def _partial_udf(m: Metric):
    partial = m.partial

    def run(order: pd.Series, *columns: pd.Series) -> bytes:
        at = np.argsort(order.to_numpy(), kind="stable")
        return np.asarray(partial(*(c.to_numpy(dtype=float)[at] for c in columns)), float).tobytes()

    return F.pandas_udf(run, "binary")


def _merge_udf(m: Metric):
    merge = m.merge

    def run(block: pd.Series, parts: pd.Series) -> float:
        at = np.argsort(block.to_numpy(), kind="stable")
        value = float(merge(np.stack([np.frombuffer(parts.iloc[i]) for i in at])))
        return value if np.isfinite(value) else None

    return F.pandas_udf(run, "double")


def evaluate(df: DataFrame, metrics: Mapping[str, Metric | Column], keys: Sequence[str] = KEYS, order: str = "bar", size: int = BLOCK) -> DataFrame:
    """One row per key with every metric as a column."""
    own = {n: m for n, m in metrics.items() if isinstance(m, Metric)}
    native = {n: m for n, m in metrics.items() if not isinstance(m, Metric)}
    require_columns(df, [*keys, order, *{c for m in own.values() for c in m.columns}], "user metrics")
    out = df.groupBy(*keys).agg(*[m.alias(n) for n, m in native.items()]) if native else None
    if own:
        used = sorted({c for m in own.values() for c in m.columns} - {order, *keys})
        d = df.select(*keys, F.col(order).alias("_order"), *used, *([F.col(order)] if any(order in m.columns for m in own.values()) else []),
                      F.coalesce(F.floor(F.col(order) / size), F.lit(-1)).cast("long").alias("_blk"))
        d = d.withColumn("_order", F.coalesce("_order", F.lit(-1)))
        parts = d.groupBy(*keys, "_blk").agg(*[_partial_udf(m)("_order", *m.columns).alias(n) for n, m in own.items()])
        merged = parts.groupBy(*keys).agg(*[_merge_udf(m)("_blk", n).alias(n) for n, m in own.items()])
        out = merged if out is None else join_safe(out, merged, keys)
    return out.select(*keys, *metrics)


def _squares(drawdown: np.ndarray) -> list[float]:
    x = drawdown[~np.isnan(drawdown)]
    return [len(x), float((x * x).sum())]


def _under(drawdown: np.ndarray) -> list[float]:
    """Length of the block, of the runs below the peak that touch its ends, and of the longest one."""
    under = np.concatenate(([False], drawdown < 0, [False]))
    edge = np.flatnonzero(under[1:] != under[:-1])
    runs = edge[1::2] - edge[::2]
    n = len(drawdown)
    head = runs[0] if len(runs) and edge[0] == 0 else 0
    tail = runs[-1] if len(runs) and edge[-1] == n else 0
    return [n, head, tail, runs.max(initial=0)]


def _longest(blocks: np.ndarray) -> float:
    best = open_run = 0.0
    for n, head, tail, inside in blocks.tolist():
        best = max(best, open_run + head, inside)
        open_run = open_run + n if head == n else tail
    return best


#: Root mean square of the drawdown, and the most bars in a row below the peak.
ULCER = Metric(("drawdown",), _squares, lambda b: np.sqrt(b[:, 1].sum() / b[:, 0].sum()) if b[:, 0].sum() else np.nan)
LONGEST_UNDER = Metric(("drawdown",), _under, _longest)
