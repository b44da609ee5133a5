"""Helpers shared by the operators."""

from __future__ import annotations

import pathlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def findable(df: DataFrame) -> DataFrame:
    """Lets Python workers import this package from where the driver has it (an installed package needs nothing)."""
    env, root = df.sparkSession.sparkContext.environment, str(pathlib.Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), root]))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names; other columns cannot clash."""
    return findable(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def partitions(df: DataFrame) -> int:
    """The cluster's own setting for shuffles, which follows the size of its data."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, cols[f.name]) for f in schema)], schema=schema)


def mapped(docs: DataFrame, task, ddl: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``task()`` is called once in each Spark task and gives a function from a batch (doc_id, text) to batches of results."""
    def run(batches):
        fn = task()
        for b in batches:
            yield from fn(b)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, ddl)


def carried(docs: DataFrame, task, ddl: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like ``mapped``, with all columns of ``docs`` kept in a struct ``row`` beside the results, whatever their names."""
    kind = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).schema["row"].dataType
    at = [docs.columns.index(c) for c in (id_col, text_col)]

    def run(batches):
        fn = task()
        for b in batches:
            row, done = b.column(0), 0
            key, text = (row.field(i) for i in at)
            for out in fn(pa.RecordBatch.from_arrays([key.cast(pa.int64()), text.cast(pa.string())], ["doc_id", "text"])):
                yield pa.RecordBatch.from_arrays([row.slice(done, len(out)), *out.columns], ["row", *out.schema.names])
                done += len(out)

    return findable(docs).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).mapInArrow(run, f"row {kind.simpleString()}, {ddl}")


def unpacked(rows: DataFrame, docs: DataFrame, **replaced: str) -> DataFrame:
    """The columns of ``docs`` out of ``carried``'s struct; ``replaced`` names result columns that take a column's place."""
    return rows.select(*(F.col(replaced[c]).alias(c) if c in replaced else F.col("row").getField(c).alias(c) for c in docs.columns))
