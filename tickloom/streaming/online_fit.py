"""A logistic model that learns each batch once and never reads history again.

``upsert.refresh_batch`` refits on all rows at every refresh, which is quadratic over a stream's life. Here the past is a
Gaussian around the last coefficients: ``weights`` and their ``precision`` (the curvature of everything learned so far). A
batch is fitted with that as its prior, by Newton steps whose gradient and curvature are summed per partition, and its own
curvature is added. A refresh therefore reads the new batch and one row of state, whatever came before. The first batch is an
ordinary fit; later ones differ from a fit on all rows by the curvature of old rows being kept where it was taken.

Rows with a null, NaN or infinite feature or a label other than 0 and 1 teach nothing; rows that lack a feature score null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.schema import require_columns
from tickloom.session import cut

STATE = ("number long, rows long, features array<string>, center array<double>, scale array<double>, weights array<double>, "
         "precision array<double>")


@dataclass(frozen=True)
class Learned:
    """What the batches up to ``number`` left behind; weights (last: the constant) are those of centred, scaled features."""

    number: int
    rows: int
    features: list[str]
    center: list[float]
    scale: list[float]
    weights: list[float]
    precision: list[float]


def _usable(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    d = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("_y"))
    for c in features:
        d = d.filter(F.abs(c) < float("inf"))  # neither null, NaN (larger than all) nor infinite
    return d.filter(F.col("_y").isin(0.0, 1.0))


def start(rows: DataFrame, features: Sequence[str], ridge: float = 1e-3) -> Learned:
    """A model that knows the position and spread of usable rows and nothing else; ``ridge`` is its precision."""
    stats = rows.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    d = len(features)
    center = [stats[f"m{i}"] or 0.0 for i in range(d)]
    return Learned(-1, 0, list(features), center, [stats[f"s{i}"] or 1.0 for i in range(d)], [0.0] * (d + 1),
                   (np.eye(d + 1) * ridge).ravel().tolist())


def _sums(rows: DataFrame, model: Learned, weights: np.ndarray) -> np.ndarray | None:
    """Rows, loss, gradient and curvature at ``weights``, summed per partition and then by place; None without rows."""
    features, center, scale = model.features, np.array(model.center), np.array(model.scale)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = np.column_stack([*[(b.column(c).to_numpy(zero_copy_only=False) - center[i]) / scale[i] for i, c in enumerate(features)],
                                 np.ones(b.num_rows)])
            y = b.column("_y").to_numpy(zero_copy_only=False)
            z = x @ weights
            p = 0.5 * (1.0 + np.tanh(0.5 * z))
            part = np.concatenate(([len(y), (np.logaddexp(0.0, z) - y * z).sum()], x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()))
            total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = rows.mapInArrow(partial, "sums array<double>").select(F.posexplode("sums").alias("at", "v"))
    got = parts.groupBy("at").agg(F.sum("v").alias("v")).collect()  # features squared at most
    if not got:
        return None
    out = np.zeros(len(got))
    for r in got:
        out[r["at"]] = r["v"]
    return out


def learn(model: Learned, rows: DataFrame, number: int, keep: float = 1.0, steps: int = 25, tolerance: float = 1e-8) -> Learned:
    """The model after ``rows`` (usable rows, read once per step). ``keep`` below 1 fades older batches by that factor."""
    k = len(model.features) + 1
    prior, center = np.array(model.precision).reshape(k, k) * keep, np.array(model.weights)

    def at(w: np.ndarray):
        s = _sums(rows, model, w)
        if s is None:
            return None
        d = w - center
        return s[0], s[1] + 0.5 * d @ prior @ d, s[2 : k + 2] + prior @ d, s[k + 2 :].reshape(k, k) + prior

    w = center
    here = at(w)
    if here is None:
        return Learned(**{**asdict(model), "number": number})
    for _ in range(steps):
        step = np.linalg.solve(here[3], here[2])
        if np.abs(step).max() < tolerance:
            break
        there = at(w - step)
        while there[1] > here[1] + 1e-9 * abs(here[1]) and np.abs(step).max() >= tolerance:
            step = step / 2
            there = at(w - step)
        w, here = w - step, there
    return Learned(number, model.rows + int(here[0]), model.features, model.center, model.scale, w.tolist(), here[3].ravel().tolist())


def newest(spark: SparkSession, path: str, before: int | None = None) -> Learned | None:
    """The newest saved state, or the newest one of a batch before ``before``."""
    try:
        d = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    d = d if before is None else d.filter(F.col("batch") < before)
    last = d.agg(F.max("batch")).first()[0]
    if last is None:
        return None
    return Learned(**d.filter(F.col("batch") == last).drop("batch").first().asDict())


def learn_batch(path: str, features: Sequence[str], label: str = "label", keep: float = 1.0, ridge: float = 1e-3) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: learn the batch on top of the state before it and save the result.

    The state is one row per batch in a folder of its own, so a batch that runs again replaces its own state and learns its
    rows once. Batches without a usable row save nothing before the first that has one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        require_columns(batch, [*features, label], "online fit")
        spark = batch.sparkSession
        rows = cut(_usable(batch, features, label))
        model = newest(spark, path, batch_id)
        if model is None:
            if rows.isEmpty():
                return
            model = start(rows, features, ridge)
        elif model.features != list(features):
            raise ValueError(f"the saved model has the features {model.features}")
        state = learn(model, rows, batch_id, keep)
        spark.createDataFrame([asdict(state)], STATE).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def probability(model: Learned, df: DataFrame, out: str = "p") -> DataFrame:
    """Add the model's probability as a column expression; null where a feature is null, NaN or infinite."""
    z = F.lit(model.weights[-1])
    fine = F.lit(True)
    for c, m, s, w in zip(model.features, model.center, model.scale, model.weights):
        x = F.col(c).cast("double")
        z, fine = z + (x - m) * (w / s), fine & F.coalesce(F.abs(x) < float("inf"), F.lit(False))
    return df.withColumn(out, F.when(fine, 0.5 * (1.0 + F.tanh(0.5 * z))))
