"""Newest-wins tables in versions: readers never see a half-written batch.

``path/data/v=N`` holds the partitions that batch N wrote anew, ``path/manifests/N`` lists for every (symbol, month) the version that
holds it. A batch reads the newest manifest before its own number, merges and writes only the partitions it touches, and
publishes its manifest last; the manifest counts once its write is committed. A batch that was killed left data but no
manifest and is not seen; run again it writes over its own folder, and a batch that was published is not run twice.
A reader is pinned to the version it opened, until ``expire`` removes it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.relations import dedup
from tickloom.session import cut

PARTS = ["p_symbol", "p_month"]


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _manifest(path: str, number: int) -> str:
    return f"{path}/manifests/{number:012d}"


def published(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions, ascending."""
    found = []
    for name in _names(spark, f"{path}/manifests"):
        p, fs = _folder(spark, f"{path}/manifests/{name}/_SUCCESS")
        if name.isdigit() and fs.exists(p):
            found.append(int(name))
    return found


def _rows(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The rows of a version with their partition columns and ``_gen``, the batch that brought them."""
    live = spark.read.parquet(_manifest(path, number))
    versions = sorted(r[0] for r in live.select("v").distinct().collect())  # as many as versions are kept or partly live
    data = spark.read.option("basePath", f"{path}/data").option("mergeSchema", True).parquet(*[f"{path}/data/v={v}" for v in versions])
    return data.withColumn("v", F.col("v").cast("long")).join(live, ["v", *PARTS], "left_semi").drop("v")


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table as published by batch ``number`` (default: the newest), whatever is written meanwhile."""
    known = published(spark, path)
    if not known or number is not None and number not in known:
        raise ValueError(f"no published version {'' if number is None else number} in {path}")
    return _rows(spark, path, known[-1] if number is None else number).drop("_gen", *PARTS)


def version_batch(path: str, keys: Sequence[str] = ("symbol", "ts"), order: Sequence[str] = ("seq",),
                  before_publishing: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: later batches replace rows of the same key, as one new version of the table."""
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = published(spark, path)
        if number in known:
            return
        base = max((n for n in known if n < number), default=None)
        # a letter in front keeps folder names text
        symbol = F.when(F.col("symbol").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("symbol").cast("string")))
        month = F.coalesce(F.concat(F.lit("m"), F.date_format("ts", "yyyy-MM")), F.lit("n"))
        new = batch.withColumns({"_gen": F.lit(number).cast("long"), "p_symbol": symbol, "p_month": month})
        touched = cut(new.select(*PARTS).distinct())
        live = touched.withColumn("v", F.lit(number).cast("long"))
        if base is not None:
            new = new.unionByName(_rows(spark, path, base).join(touched, PARTS, "left_semi"), allowMissingColumns=True)
            live = live.unionByName(spark.read.parquet(_manifest(path, base)).join(touched, PARTS, "left_anti"))
        merged = dedup(new, keys, ["_gen", *order])
        merged.write.mode("overwrite").partitionBy(*PARTS).parquet(f"{path}/data/v={number}")
        if before_publishing:
            before_publishing(number)
        live.write.mode("overwrite").parquet(_manifest(path, number))

    return write


def run_versions(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ("symbol", "ts"), order: Sequence[str] = ("seq",)) -> DataFrame:
    """Drive a stream into a versioned table and return its newest version."""
    q = stream.writeStream.foreachBatch(version_batch(path, keys, order)).option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination()
    return read_version(stream.sparkSession, path)


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Remove all versions but the newest ``keep``, and the folders that none of those refers to; returns the numbers removed.

    Folders above the newest version belong to a batch under way and stay.
    """
    known = published(spark, path)
    old, kept = known[:-keep], known[-keep:]
    if not kept:
        return []
    live = None
    for n in kept:
        m = spark.read.parquet(_manifest(path, n)).select("v", *PARTS)
        live = m if live is None else live.unionByName(m)
    live = {(r.v, r.p_symbol, r.p_month) for r in live.distinct().collect()}  # one short row per folder
    for n in old:  # the list first: nobody opens what is about to go
        p, fs = _folder(spark, _manifest(path, n))
        fs.delete(p, True)
    for name in _names(spark, f"{path}/data"):
        v = int(name.removeprefix("v=")) if name.startswith("v=") else kept[-1] + 1
        for s in _names(spark, f"{path}/data/{name}") if v <= kept[-1] else []:
            for m in _names(spark, f"{path}/data/{name}/{s}") if s.startswith("p_symbol=") else []:
                if (v, _value(spark, s), _value(spark, m)) not in live:
                    p, fs = _folder(spark, f"{path}/data/{name}/{s}/{m}")
                    fs.delete(p, True)
        if v <= kept[-1] and not any(x[0] == v for x in live):
            p, fs = _folder(spark, f"{path}/data/{name}")
            fs.delete(p, True)
    return old


def _value(spark: SparkSession, folder: str) -> str:
    """The value that a partition folder's name stands for."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(folder.partition("=")[2])
