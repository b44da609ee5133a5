"""Exponential moving averages without a per-row recursion.

With ``d = 1 - alpha`` a sub-block of L rows has the closed form
``e = d^off * sum(c_j * d^-off_j)``, and what came before it enters as
``carry * d^(off+1)``.  L is chosen so that ``d^L`` is below 2^-80: then only the
sub-block directly before the current one still matters in double precision, so
the carry is one neighbouring value and no fold over a symbol is needed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.blocks import KEYS


@dataclass(frozen=True)
class Ema:
    """One average: output name, input column, smoothing, first position with a value.

    Input values must not be null from ``first`` on.  ``adjust=True`` divides by
    the sum of weights instead of seeding with the first value.
    """

    out: str
    x: str
    alpha: float
    first: int = 0
    adjust: bool = False


def span(n: float) -> float:
    """Smoothing factor of an n-bar span."""
    return 2.0 / (n + 1.0)


def sub_length(alpha: float) -> int:
    """Smallest 8*8^k rows after which older values fall below 2^-80."""
    if alpha >= 1.0:
        return 1
    bits = -math.log2(1.0 - alpha)
    length = 8
    while length * bits < 80.0:
        length *= 8
    return length


def ema_back(alphas: Sequence[float], need: int = 0) -> int:
    """Rows to copy before a block so that averages are right from ``need`` rows before it."""
    back = need
    for a in alphas:
        length = sub_length(a)
        back = max(back, length * (1 + math.ceil(need / length)))
    return back


def add_emas(df: DataFrame, specs: Sequence[Ema], keys: Sequence[str] = KEYS) -> DataFrame:
    """Add the averages to a ``blocked`` frame; averages of like memory share one pass."""
    by_length: dict[int, list[Ema]] = {}
    for s in specs:
        by_length.setdefault(sub_length(s.alpha), []).append(s)
    for length, group in sorted(by_length.items()):
        if length == 1:
            df = df.withColumns({s.out: F.when(F.col("bar") >= s.first, F.col(s.x)) for s in group})
            continue
        sub = F.floor(F.col("bar") / length).cast("long")
        local = Window.partitionBy(*keys, "_blk", sub).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
        prev = Window.partitionBy(*keys, "_blk").orderBy(sub).rangeBetween(-1, -1)
        locs, carries, outs = {}, {}, []
        for s in group:
            d, loc, car = f"{1.0 - s.alpha!r}D", f"_loc_{s.out}", f"_car_{s.out}"
            scale = "1D" if s.adjust else f"{s.alpha!r}D"
            c = f"CASE WHEN bar < {s.first} THEN 0D WHEN bar = {s.first} THEN `{s.x}` ELSE `{s.x}` * {scale} END"
            total = F.expr(f"sum({c} * pow({d}, -(bar % {length})))").over(local)
            locs[loc] = F.expr(f"pow({d}, bar % {length})") * total
            carries[car] = F.expr(f"last(CASE WHEN bar % {length} = {length - 1} THEN `{loc}` END, true)").over(prev)
            e = f"(`{loc}` + coalesce(`{car}`, 0D) * pow({d}, bar % {length} + 1))"
            if s.adjust:
                e += f" * {s.alpha!r}D / (1D - pow({d}, bar - {s.first} + 1))"
            outs.append(F.expr(f"CASE WHEN bar >= {s.first} THEN {e} END").alias(s.out))
        new = {s.out for s in group}
        keep = [F.col(c) for c in df.columns if c not in new]
        df = df.withColumns(locs).withColumns(carries).select(*keep, *outs)
    return df
