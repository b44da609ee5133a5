import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators.metrics import auc
from tickloom.plans import folds
from tickloom.plans import learning as ml


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(9)
    n = 600
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = (x1 + 0.3 * rng.normal(size=n) > 0).astype(float)
    pdf = pd.DataFrame({"symbol": np.where(np.arange(n) % 2 == 0, "A", "B"), "bar": np.arange(n) // 2, "x1": x1, "x2": x2, "label": y,
                        "close": 100 + np.cumsum(rng.normal(size=n)) * 0.1,
                        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) // 2, "h")})
    return spark.createDataFrame(pdf).cache()


def test_blend_learns_and_round_trips(spark, data, tmp_path):
    model = ml.fit_blend(data, ["x1", "x2"], balanced=True, numTrees=5)
    out = ml.score_blend(model, data)
    assert auc(out.select("p", "label")).first()["auc"] > 0.9
    model.save(str(tmp_path / "m"))
    again = ml.score_blend(ml.Blend.load(str(tmp_path / "m"), ["x1", "x2"]), data)
    a, b = (d.agg(F.sum("p")).first()[0] for d in (out, again))
    assert a == pytest.approx(b)


def test_no_model_gives_one_half(data):
    assert {r.p for r in ml.score_blend(None, data).select("p").distinct().collect()} == {0.5}


def test_missing_features_count_as_zero(data):
    model = ml.fit_blend(data, ["x1", "x2"], numTrees=3)
    assert ml.score_blend(model, data.drop("x2")).filter("p is null").count() == 0


def test_permutation_keeps_values_and_finds_the_signal(data):
    p = ml.permute(data, "x1", 3)
    key = ["symbol", "bar"]
    a = data.select("x1").toPandas().x1.sort_values().to_numpy()
    b = p.select("x1").toPandas().x1.sort_values().to_numpy()
    np.testing.assert_array_equal(a, b)
    moved = data.select(*key, F.col("x1").alias("o")).join(p.select(*key, "x1"), key).filter("o != x1").count()
    assert moved > 550
    model = ml.pipeline(["x1", "x2"], "logistic").fit(data.select("x1", "x2", "label"))
    imp = ml.permutation_importance(model, data, ["x1", "x2"], n=1).collect()
    assert imp[0].feature == "x1" and imp[0].auc_loss > 0.2 and abs(imp[1].auc_loss) < 0.1


def test_walk_forward_rows(data):
    out = ml.walk_forward(folds.split_folds(data, 2), ["x1", "x2"]).collect()
    assert [r.fold for r in out] == [0, 1] and all(r.auc > 0.85 and r.pseudo_return > 0 for r in out)


def test_model_comparison_uses_time_folds(data):
    out = ml.compare_models(folds.split_folds(data, 2), ["x1"], ("logistic",), {"logistic": [dict(regParam=0.0), dict(regParam=1.0)]}).collect()
    assert len(out) == 2 and all(r.folds == 2 for r in out)


def test_regime_class_and_confidence(data):
    d = data.withColumn("regime", (F.col("x2") > 0).cast("int") + (F.col("x2") > 1).cast("int"))
    reg, val = ml.fit_regime_and_validator(d, ["x1", "x2"])
    out = ml.class_and_confidence(reg, data, "r", "c").select("r", "c").toPandas()
    assert set(out.r) == {0, 1, 2} and out.c.between(1 / 3, 1).all()
    assert ml.probability(val, data, "p").filter("p between 0 and 1").count() == 600
