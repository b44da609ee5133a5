"""Bars stored in the blocks that windows run over, so that later jobs read them without a shuffle.

Every feature job begins by cutting bars into blocks (``blocks.blocked``) and shuffling them by block. A block table keeps the
result: bars, block numbers and the copies of neighbouring rows, bucketed by key and block and sorted inside. Windows over
blocks then plan without an exchange. So do joins of two such tables with the same buckets on key, block and bar where the session
sets ``spark.sql.requireAllClusterKeysForCoPartition`` to false (Spark's default wants all join keys in the buckets). A key with a
third of all bars is many blocks, so buckets are even; the copies cost ``back`` rows per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.blocks import BLOCK, KEYS, blocked
from tickloom.schema import require_columns

BACK, KEY_LIST = "tickloom.back", "tickloom.keys"


def save_blocks(bars: DataFrame, table: str, back: int, buckets: int, path: str | None = None, keys: Sequence[str] = KEYS,
                size: int = BLOCK, mode: str = "overwrite") -> None:
    """Store indexed bars as a block table with ``back`` earlier rows in each block.

    Choose ``buckets`` so that one holds some hundred megabytes. Without ``path`` the table lies in the warehouse. The table
    says how far it looks back only after all rows are written; before that it cannot be loaded.
    """
    require_columns(bars, [*keys, "bar"], "block table")
    if back < 0 or buckets < 1:
        raise ValueError(f"a block table with {back} earlier rows in {buckets} buckets")
    spark = bars.sparkSession
    # the exchange and the buckets use one hash, so a task writes one file
    placed = blocked(bars, back=back, size=size).repartition(buckets, *keys, "_blk")
    w = placed.write.mode(mode).bucketBy(buckets, *keys, "_blk").sortBy(*keys, "_blk", "bar").format("parquet")
    (w if path is None else w.option("path", path)).saveAsTable(table)
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{BACK}' = '{back}', '{KEY_LIST}' = '{','.join(keys)}')")


def load_blocks(spark: SparkSession, table: str, back: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """The blocked frame of a table, for functions that read at most ``back`` earlier rows; ``blocks.core`` ends it as usual."""
    kept = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    if BACK not in kept:
        raise ValueError(f"{table} is no complete block table")
    if int(kept[BACK]) < back or kept[KEY_LIST] != ",".join(keys):
        raise ValueError(f"{table} keeps {kept[BACK]} earlier rows per {kept[KEY_LIST]}, {back} per {','.join(keys)} are needed")
    return spark.table(table)


def stored_bars(spark: SparkSession, table: str) -> DataFrame:
    """The bars of a table, each once."""
    d = spark.table(table)
    return d.filter(F.col("_core")).drop("_blk", "_core")
