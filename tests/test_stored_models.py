"""Models score in a session that has observed a job, and give what they gave straight from the fit."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tickloom.plans import learning as ml
from tickloom.session import scope, shared_dir


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x1, x2 = rng.normal(size=(2, 300))
    d = spark.createDataFrame(pd.DataFrame({"bar": np.arange(300), "x1": x1, "x2": x2, "label": (x1 + rng.normal(size=300) > 0).astype(float)})).cache()
    seen = Observation()  # from here on the session cannot be sent to a task
    d.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 300}
    return d


@pytest.mark.parametrize("kind", ["logistic", "forest", "boosting"])
def test_models_score_after_an_observation(rows, kind):
    model = ml.pipeline(["x1", "x2"], kind).fit(rows)
    assert ml.probability(model, rows, "p").filter("p between 0 and 1").count() == 300


@pytest.mark.parametrize("kind", ["logistic", "boosting"])
def test_a_stored_model_is_the_fitted_one(rows, kind):
    stages = ml.pipeline(["x1", "x2"], kind).getStages()
    direct, stored = Pipeline(stages=stages).fit(rows).stages[-1], ml.pipeline(["x1", "x2"], kind).fit(rows).stages[-1]
    if kind == "logistic":
        assert direct.coefficients == stored.coefficients and direct.intercept == stored.intercept
        assert direct.hasSummary and not stored.hasSummary
    else:
        assert direct.toDebugString.split("\n")[1:] == stored.toDebugString.split("\n")[1:]


def test_a_scope_removes_its_models(spark, rows):
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tickloom")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda: {str(x.getPath()) for x in fs.listStatus(folder)} if fs.exists(folder) else set()
    before = names()
    with scope(spark):
        ml.pipeline(["x1", "x2"], "logistic").fit(rows)
        assert len(names() - before) == 1
    assert names() == before
