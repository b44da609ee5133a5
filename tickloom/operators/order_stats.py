"""Rolling quantiles and mean deviations whose cost does not grow with the frame.

``indicators.rolling`` sorts the values of each frame: right for some tens of rows, dear for thousands.
Here the values of a block become ranks and the ranks a wavelet matrix: one level per bit, which keeps for
each position how many earlier ranks have a 0 there. The k-th smallest value of any frame is found by
walking the levels, for all rows of the block at once, so a row costs log2(block) steps for any frame.

A block is a group of its own (``blocks.blocked``), bounded by its size and the rows it looks back to.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tickloom.operators.blocks import KEYS
from tickloom.operators.quantiles import between
from tickloom.schema import require_columns


@dataclass(frozen=True)
class Rolling:
    """An order statistic of the last ``n`` rows of ``column``; null below ``min_rows`` values (default ``n``).

    ``q`` is the probability of a linear-interpolated quantile; without it the result is the mean
    absolute deviation of the frame's values from their own mean.
    """

    column: str
    n: int
    q: float | None = 0.5
    min_rows: int | None = None

    def __post_init__(self):
        if self.n < 1 or (self.q is not None and not 0 <= self.q <= 1):
            raise ValueError(f"rolling statistic over {self.n} rows at {self.q}")


class RankTree:
    """Wavelet matrix over the ranks of an array; ties take their ranks in order of position, NaN is largest."""

    def __init__(self, values: np.ndarray, sums: bool = False):
        at = np.argsort(values, kind="stable")
        self.values = values[at]
        ranks = np.empty(len(values), np.int64)
        ranks[at] = np.arange(len(values))
        self.levels = []
        for bit in reversed(range(max(len(values) - 1, 1).bit_length())):
            one = (ranks >> bit & 1).astype(bool)
            zeros = np.concatenate(([0], np.cumsum(~one)))
            total = np.concatenate(([0.0], np.cumsum(np.where(one, 0.0, self.values[ranks])))) if sums else None
            self.levels.append((bit, zeros, total))
            ranks = np.concatenate((ranks[~one], ranks[one]))

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the values at positions lo up to hi, per row; needs k < hi - lo."""
        found = np.zeros(len(k), np.int64)
        for bit, zeros, _ in self.levels:
            a, b = zeros[lo], zeros[hi]
            right = k >= b - a
            k = np.where(right, k - (b - a), k)
            found += right.astype(np.int64) << bit
            lo, hi = np.where(right, lo - a + zeros[-1], a), np.where(right, hi - b + zeros[-1], b)
        return self.values[found]

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of the values below ``bound`` at positions lo up to hi, per row (a tree with sums)."""
        rank = np.searchsorted(self.values, bound)  # all ranks below it are meant
        everything = rank == len(self.values)
        rank = np.minimum(rank, len(self.values) - 1)
        count, total = np.zeros(len(rank), np.int64), np.zeros(len(rank))
        for bit, zeros, sums in self.levels:
            a, b = zeros[lo], zeros[hi]
            right = (rank >> bit & 1).astype(bool)
            count += np.where(right, b - a, 0)
            total += np.where(right, sums[hi] - sums[lo], 0.0)
            lo, hi = np.where(right, lo - a + zeros[-1], a), np.where(right, hi - b + zeros[-1], b)
        # the walk leaves out the rank it ends at: the largest value, where the bound lies above all
        count += np.where(everything, hi - lo, 0)
        total += np.where(everything, (hi - lo) * self.values[-1], 0.0)
        return count, total


def _frames(present: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first and last (exclusive) place of its frame among the rows that have a value."""
    before = np.concatenate(([0], np.cumsum(present)))
    end = np.arange(1, len(present) + 1)
    return before[np.maximum(end - n, 0)], before[end]


def quantile_of_frames(x: np.ndarray, present: np.ndarray, spec: Rolling, tree: RankTree) -> tuple[np.ndarray, np.ndarray]:
    """Quantile of each row's frame and whether the frame has enough values; ``x`` holds anything where not present."""
    lo, hi = _frames(present, spec.n)
    size = hi - lo
    ok = size >= max(spec.n if spec.min_rows is None else spec.min_rows, 1)
    out = np.zeros(len(x))
    lo, hi, pos = lo[ok], hi[ok], (size[ok] - 1) * spec.q
    k = np.floor(pos).astype(np.int64)
    with np.errstate(invalid="ignore"):
        a, b = tree.kth(lo, hi, k), tree.kth(lo, hi, np.ceil(pos).astype(np.int64))
        f = pos - k
        plain = (np.abs(a) < 1e290) & (np.abs(b) < 1e290)
        mixed = np.where(plain, between(np.where(plain, a, 0.0), np.where(plain, b, 0.0), f), a * (1 - f) + b * f)
        out[ok] = np.where(f == 0, a, mixed)
    return out, ok


def deviation_of_frames(x: np.ndarray, present: np.ndarray, spec: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Mean absolute deviation of each row's frame from its mean; NaN where a value of the frame is not finite."""
    lo, hi = _frames(present, spec.n)
    ok = hi - lo >= max(spec.n if spec.min_rows is None else spec.min_rows, 1)
    v = x[present]
    fine = np.isfinite(v)
    bad = np.concatenate(([0], np.cumsum(~fine)))
    # sums of distances from one middle value lose no digits to the level of the series
    v = np.where(fine, v, 0.0) - (np.median(v[fine]) if fine.any() else 0.0)
    tree = RankTree(np.where(fine, v, 0.0), sums=True)
    upto = np.concatenate(([0.0], np.cumsum(np.where(fine, v, 0.0))))
    lo, hi = lo[ok], hi[ok]
    size, total = hi - lo, upto[hi] - upto[lo]
    mean = total / size
    n_low, low = tree.below(lo, hi, mean)
    out = np.zeros(len(x))
    # both sides of the mean deviate by the same sum
    out[ok] = np.where(bad[hi] > bad[lo], np.nan, np.maximum(2.0 * (mean * n_low - low) / size, 0.0))
    return out, ok


def add_order_stats(df: DataFrame, stats: Mapping[str, Rolling], keys: Sequence[str] = KEYS) -> DataFrame:
    """Add one column per named statistic to a ``blocked`` frame (blocked with ``back`` of at least the longest frame).

    Null values are left out of a frame but its rows count. NaN is the largest value of a quantile. Statistics of one
    column share its tree; the blocks are shuffled once for all of them.
    """
    require_columns(df, [*keys, "_blk", "bar", *{s.column for s in stats.values()}], "rolling order statistics")
    clash = [n for n in stats if n in df.columns]
    if clash:
        raise ValueError(f"columns exist already: {', '.join(clash)}")
    stats = dict(stats)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in stats]])

    def run(block: pa.Table) -> pa.Table:
        block = block.take(pa.compute.sort_indices(block, sort_keys=[("bar", "ascending")]))
        trees, data, made = {}, {}, []
        for spec in stats.values():
            if spec.column not in data:
                c = block.column(spec.column).combine_chunks().cast(pa.float64())
                data[spec.column] = (c.fill_null(0.0).to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False))
            x, present = data[spec.column]
            if not present.any():
                value, ok = np.zeros(len(x)), np.zeros(len(x), bool)
            elif spec.q is None:
                value, ok = deviation_of_frames(x, present, spec)
            else:
                if spec.column not in trees:
                    trees[spec.column] = RankTree(x[present])
                value, ok = quantile_of_frames(x, present, spec, trees[spec.column])
            made.append(pa.array(value, pa.float64(), mask=~ok))
        for name, column in zip(stats, made):
            block = block.append_column(name, column)
        return block

    return df.groupBy(*keys, "_blk").applyInArrow(run, schema)
