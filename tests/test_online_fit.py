"""The batch-wise logistic model against the same mathematics on plain arrays and against a fit on all rows."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tickloom.operators.metrics import auc
from tickloom.streaming import online_fit as O
from tickloom.streaming.bars import file_stream

X = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.range(12_000, numPartitions=4).select("id", F.randn(1).alias("a"), (F.randn(2) * 5 + 100).alias("b"))
    p = 1 / (1 + F.exp(-(0.7 * F.col("a") - 0.3 * (F.col("b") - 100) + 0.2)))
    return d.withColumn("label", (F.rand(3) < p).cast("int"))


def by_hand(batches, ridge=1e-3):
    """The same recursion with numpy, whole batches at a time."""
    first = batches[0]
    m, s = first[:, :2].mean(0), first[:, :2].std(0)
    w, prec = np.zeros(3), np.eye(3) * ridge
    for b in batches:
        x, y = np.column_stack([(b[:, :2] - m) / s, np.ones(len(b))]), b[:, 2]
        old, v = prec, w.copy()
        for _ in range(30):
            p = 1 / (1 + np.exp(-x @ v))
            h = (x.T * (p * (1 - p))) @ x + old
            v = v - np.linalg.solve(h, x.T @ (p - y) + old @ (v - w))
        p = 1 / (1 + np.exp(-x @ v))
        w, prec = v, (x.T * (p * (1 - p))) @ x + old
    return w


def test_same_as_arrays_and_close_to_all_rows(spark, rows, tmp_path):
    path = str(tmp_path / "m")
    write = O.learn_batch(path, X)
    for k in range(4):
        write(rows.filter(F.col("id") % 4 == k), k)
    model = O.newest(spark, path)
    pdf = rows.toPandas()
    np.testing.assert_allclose(model.weights, by_hand([pdf[pdf.id % 4 == k][[*X, "label"]].to_numpy(float) for k in range(4)]), rtol=1e-5)
    assert model.rows == 12_000 and model.number == 3
    full = LogisticRegression(featuresCol="f", labelCol="label", tol=1e-10, maxIter=200).fit(VectorAssembler(inputCols=X, outputCol="f").transform(rows))
    slopes = np.array(model.weights[:-1]) / model.scale
    np.testing.assert_allclose(slopes, full.coefficients.toArray(), rtol=0.02)
    one = O.probability(model, rows)
    z = F.lit(full.intercept) + sum(F.col(c) * float(w) for c, w in zip(X, full.coefficients))
    worst = one.select(F.max(F.abs(F.col("p") - 1 / (1 + F.exp(-z))))).first()[0]
    assert worst < 0.02
    assert auc(one.withColumn("k", F.lit(1)).withColumn("label", F.col("label").cast("double")), keys=["k"]).first().auc > 0.8


def test_a_repeated_batch_learns_once(spark, rows, tmp_path):
    path = str(tmp_path / "m")
    write = O.learn_batch(path, X)
    write(rows.filter("id % 2 = 0"), 0)
    write(rows.filter("id % 2 = 1"), 1)
    a = O.newest(spark, path)
    write(rows.filter("id % 2 = 1"), 1)
    b = O.newest(spark, path)
    assert b.rows == a.rows == 12_000
    np.testing.assert_allclose(a.weights, b.weights, rtol=1e-9)
    assert O.newest(spark, path, before=1).rows == 6000


def test_fading_follows_a_turned_rule(spark, rows, tmp_path):
    turned = rows.withColumn("label", 1 - F.col("label"))
    ends = {}
    for keep in (1.0, 0.1):
        write = O.learn_batch(str(tmp_path / f"m{keep}"), X, keep=keep)
        write(rows, 0)
        write(turned, 1)
        ends[keep] = O.newest(spark, str(tmp_path / f"m{keep}")).weights[0]
    assert ends[0.1] < -0.2 and ends[0.1] < ends[1.0]


def test_unusable_rows_empty_batches_and_separable_ones(spark, tmp_path):
    path = str(tmp_path / "m")
    write = O.learn_batch(path, X)
    make = lambda *r: spark.createDataFrame(list(r), "a double, b double, label int, extra string")
    bad = make((None, 1.0, 1, "x"), (float("nan"), 1.0, 0, "x"), (1.0, float("inf"), 1, "x"), (1.0, 1.0, None, "x"), (1.0, 1.0, 7, "x"))
    write(bad, 0)
    assert O.newest(spark, path) is None
    write(make((1.0, 5.0, 1, "x"), (-1.0, 5.0, 0, "x")).unionByName(bad), 1)  # separable, and b never varies
    write(bad.limit(0), 2)
    model = O.newest(spark, path)
    assert (model.rows, model.number) == (2, 2) and np.isfinite(model.weights).all() and model.weights[0] > 0
    p = [r.p for r in O.probability(model, bad).collect()]
    assert p[:3] == [None] * 3 and 0 < p[3] < 1
    with pytest.raises(ValueError):
        O.learn_batch(path, ["b", "a"])(bad, 3)


def test_on_a_stream_each_batch_reads_its_own_rows(spark, rows, tmp_path):
    land, path = str(tmp_path / "land"), str(tmp_path / "m")
    rows.repartition(3).write.parquet(land)
    q = file_stream(spark, land, rows.schema, files_per_batch=1).writeStream.foreachBatch(O.learn_batch(path, X))
    q = q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]] == [4000, 4000, 4000]
    assert O.newest(spark, path).rows == 12_000
