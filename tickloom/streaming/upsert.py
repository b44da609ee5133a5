"""Newest-wins tables fed by micro-batches, and periodic model refresh."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.blocks import join_safe
from tickloom.operators.relations import dedup
from tickloom.session import cut


def _existing(batch: DataFrame, path: str) -> DataFrame | None:
    try:
        return batch.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def upsert_batch(path: str, keys: Sequence[str] = ("symbol", "ts"), order: Sequence[str] = ("seq",)) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: later batches replace rows of the same key.

    Only the (symbol, month) partitions a batch touches are merged and rewritten.
    Rows carry the batch that wrote them, so a batch that runs again after a
    failure gives the same table.
    """
    parts = ["p_symbol", "p_month"]

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.withColumns({
            "_gen": F.lit(batch_id).cast("long"), "p_symbol": F.col("symbol"), "p_month": F.date_format("ts", "yyyy-MM"),
        })
        old = _existing(batch, path)
        if old is not None:
            new = new.select(*new.columns)
            touched = cut(new.select(*parts).distinct())
            # the values of the batch's own partitions (bounded by the batch) prune the folders that are read
            names = {p: [r[0] for r in touched.select(p).distinct().collect()] for p in parts}
            old = old.withColumn("p_month", F.col("p_month").cast("string"))
            kept = [F.col(p).isin([v for v in names[p] if v is not None]) | F.col(p).isNull() for p in parts]
            new = new.unionByName(join_safe(old.filter(kept[0] & kept[1]), touched, parts, "left_semi"))
        merged = cut(dedup(new, keys, ["_gen", *order]))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)

    return write


def run_upsert(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ("symbol", "ts"),
               order: Sequence[str] = ("seq",)) -> DataFrame:
    """Drive a stream into an upsert table and return the table."""
    q = stream.writeStream.foreachBatch(upsert_batch(path, keys, order)).option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path).drop("_gen", "p_symbol", "p_month")


def refresh_batch(table: str, models: str, fit: Callable[[DataFrame], object], every: int = 1) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: append labelled rows, refit and save a model every n batches.

    Each batch goes to its own folder, so a repeated batch replaces itself.
    A saved model's number is listed in ``finished``; readers take the highest (``newest_model``).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        if (batch_id + 1) % every == 0:
            rows = batch.sparkSession.read.parquet(table).filter(F.col("batch") <= batch_id)
            fit(rows).write().overwrite().save(f"{models}/{batch_id:08d}")
            done = batch.sparkSession.range(batch_id, batch_id + 1).withColumnRenamed("id", "number")
            done.write.mode("overwrite").parquet(f"{models}/finished/batch={batch_id}")

    return write


def newest_model(spark: SparkSession, models: str) -> PipelineModel:
    """The finished model with the highest number; ``refresh_batch`` lists a model only after it was saved whole."""
    numbers = spark.read.parquet(f"{models}/finished").agg(F.max("number")).first()
    return PipelineModel.load(f"{models}/{numbers[0]:08d}")
