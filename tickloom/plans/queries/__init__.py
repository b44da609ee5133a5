"""Registered queries and their equivalent SQL, by topic."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans.inputs import plain

TOPICS = ["bars", "indicators", "signals", "trading", "alignment", "learning", "streams"]

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    return [import_module(f"{__name__}.{t}") for t in TOPICS]


def _wrap(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return plain(fn(spark, sf_dir))

    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Query]:
    return {n: _wrap(f) for m in _modules() for n, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {n: s for m in _modules() for n, s in m.SQL.items()}
