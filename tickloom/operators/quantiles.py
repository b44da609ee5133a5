"""Exact order statistics of large groups.

``percentile`` keeps every distinct value of a group in one task's memory, and a
window over a group sorts it in one task.  Here a group is cut into value slices
by its mean and deviation; only the slices that hold the wanted ranks are sorted.
The slices steer the work, not the result: the order statistics are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.blocks import KEYS, join_safe

PER_UNIT = 4096


def value_slices(counts: DataFrame, group: Sequence[str], x: str) -> DataFrame:
    """Add ``_s``, a slice number that grows with ``x``, to rows that are distinct in (group, x).

    Slices are equal steps of log(1 + distance from the group's mean in deviations), to either side:
    fine where values are dense, coarse in the tails, some ten thousands at most, and the same for any size.
    Every operation in it is monotone, so slices never cross.
    """
    fit = F.when(F.abs(x) < 1e300, F.col(x))
    stats = counts.groupBy(*group).agg(F.avg(fit).alias("_mean"), F.stddev_pop(fit).alias("_dev"))
    d = F.col(x) - F.col("_mean")
    step = F.signum(d) * F.log1p(F.abs(d) / F.col("_dev")) * PER_UNIT
    s = F.when(F.col("_dev") > 0, F.floor(F.least(F.greatest(step, F.lit(-1e15)), F.lit(1e15)))).otherwise(F.signum(d))
    return join_safe(counts, stats, group).withColumn("_s", F.coalesce(s.cast("long"), F.lit(0))).drop("_mean", "_dev")


def _halves(x):
    """``x`` as a sum of two numbers of 26 bits, whose products are exact."""
    c = x * 134217729.0  # 2^27 + 1
    high = c - (c - x)
    return high, x - high


def between(a, b, f):
    """``a * (1 - f) + b * f`` for 0 <= f < 1, the first product and the sum rounded once together (a fused multiply-add, as SQL
    engines compile it); plain arithmetic, for columns and arrays below 1e290 in size.

    A probability such as 0.7 puts a whole rank a hair low (0.7 * 1410 = 986.9999999999999).  The quantile is then below the value
    of that rank by less than the error of ``a + (b - a) * f``, and comparing the two would depend on that error.
    """
    x, z = 1 - f, b * f
    p = a * x
    (ah, al), (xh, xl) = _halves(a), _halves(x)
    lost = ((ah * xh - p) + ah * xl + al * xh) + al * xl
    s = p + z
    back = s - p
    return s + (((p - (s - back)) + (z - back)) + lost)


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], keys: Sequence[str] = KEYS) -> DataFrame:
    """Linear-interpolated quantiles per key and column, ignoring nulls.

    Result in long form: keys, ``feature``, ``q`` (the probability), ``value``.
    """
    keys = list(keys)
    group = [*keys, "feature"]
    long = (
        df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
        .unpivot(keys, list(cols), "feature", "x")
        .filter(F.col("x").isNotNull() & ~F.isnan("x"))
        .groupBy(*group, "x")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    placed = value_slices(long, group, "x")
    counts = placed.groupBy(*group, "_s").agg(F.sum("n").alias("m"))
    by_group = Window.partitionBy(*group)  # over the slices of a group, some ten thousands at most
    before = by_group.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"start": F.coalesce(F.sum("m").over(before), F.lit(0)), "total": F.sum("m").over(by_group)})
    want = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("q")
    want = counts.select(*group, "_s", "start", "m", "total", want)
    pos = F.col("q") * (F.col("total") - 1)
    want = want.withColumn("pos", pos).withColumn("lo", F.floor("pos")).withColumn("hi", F.ceil("pos"))
    inside = lambda r: (F.col(r) >= F.col("start")) & (F.col(r) < F.col("start") + F.col("m"))
    want = want.filter(inside("lo") | inside("hi")).select(*group, "_s", "start", "q", "pos", "lo", "hi")
    hit = join_safe(placed.select(*group, "_s", "x", "n"), want, [*group, "_s"], "inner")
    run = Window.partitionBy(*group, "_s", "q").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.withColumn("end", F.col("start") + F.sum("n").over(run)).withColumn("beg", F.col("end") - F.col("n"))
    at = lambda r: F.max(F.when((F.col(r) >= F.col("beg")) & (F.col(r) < F.col("end")), F.col("x")))
    out = hit.groupBy(*group, "q").agg(
        at("lo").alias("a"), at("hi").alias("b"), F.first(F.col("pos") - F.col("lo")).alias("f")
    )
    a, b, f = F.col("a"), F.col("b"), F.col("f")
    plain = (F.abs(a) < 1e290) & (F.abs(b) < 1e290)
    value = F.when(f == 0, a).when(plain, between(a, b, f)).otherwise(a * (1 - f) + b * f)
    return out.select(*group, "q", value.alias("value"))


def quantile_columns(quantiles: DataFrame, names: dict[tuple[str, float], str], keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per key with the named (column, probability) quantiles side by side."""
    return quantiles.groupBy(*keys).agg(
        *[F.max(F.when((F.col("feature") == c) & (F.col("q") == q), F.col("value"))).alias(n)
          for (c, q), n in names.items()]
    )
