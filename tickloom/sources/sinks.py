"""Writing bars, logs and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_bars(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ("interval", "symbol"),
               mode: str = "overwrite", rows_per_file: int = 5_000_000) -> None:
    """Bars partitioned by interval and symbol.

    Rows are spread by partition value and month, so a large symbol is written by
    many tasks, and files are limited in rows.
    """
    by = [c for c in by if c in df.columns]
    spread = df.repartition(*by, F.date_trunc("month", F.col("ts"))) if "ts" in df.columns else df
    w = spread.write.mode(mode).partitionBy(*by).option("maxRecordsPerFile", rows_per_file)
    if fmt == "csv":
        w = w.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
    w.format(fmt).save(path)


def write_log(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Bar logs, trade logs and sweep tables, one folder each."""
    w = df.write.mode(mode)
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A metrics table as JSON lines in one file: one short row per symbol and configuration."""
    df.coalesce(1).write.mode(mode).option("ignoreNullFields", False).json(path)
