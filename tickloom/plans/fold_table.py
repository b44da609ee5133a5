"""Folds from a table function: ranges of bars per symbol, joined back to the rows.

The function reads one row per symbol (its number of bars), so its partitions are small however many bars a symbol has.
Its arguments are checked and its columns follow from the input's type while the query is planned.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_function():
    """The table function ``(TABLE(symbol, n) PARTITION BY symbol, mode, train, test, step, purge)``.

    ``rolling``: fold k trains on ``train`` bars from k*step and tests on the next ``test`` bars. ``expanding``: it trains on all
    bars before its test part, which starts at train + k*step. The last ``purge`` training bars are left out. Folds without a test bar do not come.
    """
    from pyspark.sql.functions import udtf
    from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

    class FoldRanges:
        @staticmethod
        def analyze(sizes: AnalyzeArgument, mode: AnalyzeArgument, train: AnalyzeArgument, test: AnalyzeArgument, step: AnalyzeArgument,
                    purge: AnalyzeArgument) -> AnalyzeResult:
            from pyspark.sql import types as T

            if not sizes.isTable or [f.name for f in sizes.dataType.fields] != ["symbol", "n"]:
                raise ValueError("the first argument is a table of symbol and n")
            if mode.value not in ("rolling", "expanding"):
                raise ValueError("mode is rolling or expanding")
            if any(not isinstance(x.value, int) or x.value < low for x, low in ((train, 1), (test, 1), (step, 1), (purge, 0))):
                raise ValueError("train, test and step are whole numbers above 0, purge is at least 0")
            return AnalyzeResult(T.StructType([
                T.StructField("symbol", sizes.dataType["symbol"].dataType), T.StructField("fold", T.IntegerType()), T.StructField("role", T.StringType()),
                T.StructField("first_bar", T.LongType()), T.StructField("end_bar", T.LongType())]))

        def eval(self, row, mode: str, train: int, test: int, step: int, purge: int) -> Iterator[tuple]:
            n, k = row["n"], 0
            while n is not None and k * step + train < n:
                start = k * step + train
                first = k * step if mode == "rolling" else 0
                if start - purge > first:
                    yield row["symbol"], k, "train", first, start - purge
                yield row["symbol"], k, "test", start, min(start + test, n)
                k += 1

    return udtf(FoldRanges)


def fold_rows(df: DataFrame, train: int, test: int, step: int, purge: int = 0, mode: str = "rolling") -> DataFrame:
    """Every row of ``df`` (symbol, bar) once per fold it belongs to, with ``fold`` and ``role``; null symbols are a symbol."""
    sizes = df.groupBy("symbol").agg((F.max("bar") + 1).cast("long").alias("n"))
    ranges = fold_function()(sizes.asTable().partitionBy("symbol"), F.lit(mode), F.lit(train), F.lit(test), F.lit(step), F.lit(purge))
    ranges = ranges.select(F.col("symbol").alias("_s"), "fold", "role", "first_bar", "end_bar")
    on = df["symbol"].eqNullSafe(ranges["_s"]) & (df["bar"] >= ranges["first_bar"]) & (df["bar"] < ranges["end_bar"])
    return df.join(ranges, on).select(*[df[c] for c in df.columns], "fold", "role")
