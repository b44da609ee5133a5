"""Column conventions of the library."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

OHLCV = ["open", "high", "low", "close", "volume"]


def require_columns(df: DataFrame, needed: Iterable[str], what: str = "input") -> DataFrame:
    """Fail while planning, with the missing names, rather than deep in a job."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing column(s) {', '.join(missing)}; has {', '.join(df.columns)}")
    return df
