"""Fitting, scoring and judging classifiers with ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import feature_set_score
from tickloom.operators import indicators as I
from tickloom.operators.blocks import blocked, core, join_safe
from tickloom.operators.features import FEATURE_SETS, feature_set
from tickloom.operators.ledger import ledger
from tickloom.operators.metrics import auc, class_weights, core_pack
from tickloom.session import cut, new_path


def classifier(kind: str, seed: int = 42, weight: str | None = None, **params):
    """Estimator by name: ``logistic``, ``forest`` or ``boosting``; ``params`` override its settings."""
    make = {"logistic": LogisticRegression, "forest": RandomForestClassifier, "boosting": GBTClassifier}
    settings = {
        "logistic": dict(maxIter=50, regParam=0.01),
        "forest": dict(numTrees=30, maxDepth=6, seed=seed),
        "boosting": dict(maxIter=20, maxDepth=4, seed=seed),
    }
    if kind not in make:
        raise ValueError(f"unknown classifier {kind!r}; use one of {', '.join(make)}")
    est = make[kind](featuresCol="scaled", labelCol="label", **{**settings[kind], **params})
    return est.setWeightCol(weight) if weight else est


class StoredPipeline(Pipeline):
    """A pipeline whose fitted model is written to the shared folder and read back, as ``cut`` does with a table.

    A model straight from its fit holds its training summary, and the summary of a two-class model holds the session.
    Spark would send both to every task that scores, which fails once the session has had an ``Observation``.
    A stored model has the fitted numbers alone.
    """

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        path = new_path(dataset.sparkSession)
        super()._fit(dataset).save(path)
        return PipelineModel.load(path)


def pipeline(features: Sequence[str], kind: str, weight: str | None = None, seed: int = 42, **params) -> Pipeline:
    """Assemble, scale (centred, unit deviation), classify; training leaves out rows with a null feature."""
    return StoredPipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip"),
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
        classifier(kind, seed, weight, **params),
    ])


def add_class_weights(df: DataFrame) -> DataFrame:
    """Balanced ``weight`` per row; the table of weights has one row per class (a null label is a class)."""
    return join_safe(df, class_weights(df).select("label", "weight"), ["label"])


@dataclass
class Blend:
    """A logistic base and a forest, mixed by volatility state."""

    base: PipelineModel | None
    forest: PipelineModel | None
    features: list[str] = field(default_factory=list)

    def save(self, path: str) -> None:
        self.base.write().overwrite().save(f"{path}/base")
        self.forest.write().overwrite().save(f"{path}/forest")

    @staticmethod
    def load(path: str, features: Sequence[str]) -> Blend:
        return Blend(PipelineModel.load(f"{path}/base"), PipelineModel.load(f"{path}/forest"), list(features))


def fit_blend(train: DataFrame, features: Sequence[str], seed: int = 42, balanced: bool = False, **forest) -> Blend:
    """Fit both models on (features, label) rows of all symbols."""
    d = add_class_weights(train) if balanced else train
    w = "weight" if balanced else None
    d = cut(d.select(*features, "label", *(["weight"] if balanced else [])))
    return Blend(pipeline(features, "logistic", w, seed).fit(d), pipeline(features, "forest", w, seed, **forest).fit(d), list(features))


def transform_all(model: PipelineModel, df: DataFrame) -> tuple[DataFrame, Column]:
    """Scored rows, none left out, and whether a row has all features (without, its scores mean nothing)."""
    assembler = model.stages[0]
    stages = [assembler.copy({assembler.handleInvalid: "keep"}), *model.stages[1:]]
    for s in stages:
        df = s.transform(df)
    names = assembler.getInputCols()
    return df, reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in names])


def probability(model: PipelineModel, df: DataFrame, out: str) -> DataFrame:
    """Probability of class 1, null for rows with a null feature; scoring columns are removed again."""
    s, whole = transform_all(model, df)
    s = s.withColumn(out, F.when(whole, vector_to_array("probability")[1]))
    return s.drop("features", "scaled", "rawPrediction", "probability", "prediction")


def class_and_confidence(model: PipelineModel, df: DataFrame, cls: str = "regime", conf: str = "conf") -> DataFrame:
    """Most probable class and its probability; null for rows with a null feature."""
    s, whole = transform_all(model, df)
    s = s.withColumn("_pr", F.when(whole, vector_to_array("probability")))
    top = F.array_max("_pr")
    return s.withColumns({cls: (F.array_position("_pr", top) - 1).cast("int"), conf: top}).drop(
        "features", "scaled", "rawPrediction", "probability", "prediction", "_pr"
    )


def volatility_state(bars: DataFrame, out: str = "volatile", n: int = 96, min_rows: int = 10) -> DataFrame:
    """Flag: trailing deviation of returns above its own trailing median (needs ``bar`` and ``close``)."""
    d = blocked(bars, back=2 * n).withColumn("_r", I.pct_change("close"))
    d = d.withColumn("_rv", I.rolling("_r", n, "std", min_rows))
    med = I.rolling("_rv", n, "median", min_rows)
    return core(d.withColumn(out, F.coalesce(F.col("_rv") > med, F.lit(False))))


def mix(p_base: str = "p_base", p_forest: str = "p_forest", volatile: str = "volatile"):
    """High volatility trusts the forest more, calm periods the base model."""
    hi = 0.6 * F.col(p_forest) + 0.4 * F.col(p_base)
    return F.when(F.col(volatile), hi).otherwise(0.8 * F.col(p_base) + 0.2 * F.col(p_forest))


def score_blend(model: Blend | None, df: DataFrame, out: str = "p") -> DataFrame:
    """Blended probability per bar; 0.5 without a model, missing feature columns count as 0."""
    if model is None or model.base is None or model.forest is None:
        return df.withColumn(out, F.lit(0.5))
    d = volatility_state(df)
    d = d.withColumns({c: F.lit(0.0) for c in model.features if c not in d.columns})
    d = d.na.fill(0.0, model.features)
    d = probability(model.forest, probability(model.base, d, "p_base"), "p_forest")
    return d.withColumn(out, mix())


def fold_quality(scored: DataFrame) -> DataFrame:
    """Rows, AUC and pseudo-return per ``fold`` of scored rows (fold, p, label), in one pass over all folds."""
    gain = F.greatest(F.col("p") - 0.5, F.lit(0.0)) * F.when(F.col("label") > 0.5, 1.0).otherwise(-1.0)
    ret = scored.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.sum(gain).alias("pseudo_return"))
    return join_safe(ret, auc(scored, keys=["fold"]), ["fold"]).select("fold", "rows", "n_pos", "auc", "pseudo_return").orderBy("fold")


def together(jobs: Sequence[Callable[[], object]], workers: int = 4) -> list:
    """Results of driver-side jobs in order, some at a time: while one fit waits for its last tasks the next ones use the cluster."""
    spark = SparkSession.getActiveSession()
    kept = inheritable_thread_target(spark) if spark else lambda job: job  # properties and tags go along
    with ThreadPoolExecutor(max_workers=max(1, min(workers, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(kept(job)) for job in jobs]]


def walk_forward(data: DataFrame, features: Sequence[str], seed: int = 42, workers: int = 4) -> DataFrame:
    """Fit and score every fold: rows, AUC and pseudo-return of the test part.

    ``data`` carries ``fold`` and ``role``; it is written once because every fold
    reads it.  ``workers`` fits run at a time (each is distributed); the scored
    folds are one table and are judged together.
    """
    d = cut(data)
    folds = sorted(r[0] for r in d.select("fold").distinct().collect())
    part = {k: d.filter(F.col("fold") == k) for k in folds}
    models = together([partial(fit_blend, part[k].filter("role = 'train'"), features, seed) for k in folds], workers)
    scored = [score_test(m, part[k].filter("role = 'test'")).select(F.lit(k).alias("fold"), "p", "label") for k, m in zip(folds, models)]
    return fold_quality(reduce(DataFrame.unionByName, scored))


def score_test(model: Blend, test: DataFrame) -> DataFrame:
    """Blend by a ``volatile`` flag computed on the full history, if there, else base and forest half each."""
    d = probability(model.forest, probability(model.base, test, "p_base"), "p_forest")
    return d.withColumn("p", mix() if "volatile" in test.columns else (F.col("p_base") + F.col("p_forest")) / 2)


def compare_models(data: DataFrame, features: Sequence[str], kinds: Sequence[str] = ("logistic", "forest", "boosting"),
                   grid: Mapping[str, Sequence[Mapping]] | None = None, workers: int = 4) -> DataFrame:
    """Mean and deviation of the fold AUCs per model and setting.

    Folds come from ``data`` (fold, role): a random cross-validation would train on the future.
    """
    d = cut(data)
    folds = [r[0] for r in d.select("fold").distinct().orderBy("fold").collect()]
    runs = [(kind, i, params, k) for kind in kinds for i, params in enumerate((grid or {}).get(kind, [{}])) for k in folds]
    train = {k: d.filter((F.col("fold") == k) & (F.col("role") == "train")).select(*features, "label") for k in folds}
    models = together([partial(pipeline(features, kind, **params).fit, train[k]) for kind, _, params, k in runs], workers)
    scored = [probability(m, d.filter((F.col("fold") == k) & (F.col("role") == "test")), "p").select(
        F.lit(kind).alias("model"), F.lit(i).alias("setting"), F.lit(k).alias("fold"), "p", "label") for m, (kind, i, _, k) in zip(models, runs)]
    rows = reduce(DataFrame.unionByName, scored)
    return auc(rows, keys=["model", "setting", "fold"]).groupBy("model", "setting").agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"), F.count("auc").alias("folds")).orderBy("model", "setting")


def feature_set_sweep(data: DataFrame, sets: Sequence[str] = tuple(FEATURE_SETS), th_long: float = 0.55, th_short: float = 0.45,
                      notional: float = 10_000.0, workers: int = 4) -> DataFrame:
    """Fit one model per named feature set and trade the last part of each symbol.

    ``missing`` names the features of a set that ``data`` has not.

    ``data``: symbol, ts, bar, close, label, role and the features.
    """
    d = cut(data)
    found = {name: feature_set(name, d.columns) for name in sets}
    models = together([partial(pipeline(cols, "logistic").fit, d.filter("role = 'train'").select(*cols, "label")) for cols, _ in found.values()], workers)
    out = None
    for model, (name, (cols, missing)) in zip(models, found.items()):
        test = probability(model, d.filter("role = 'test'"), "p")
        test = test.select(F.lit(name).alias("feature_set"), F.lit(len(cols)).alias("n_features"), F.lit(",".join(missing)).alias("missing"),
                           "symbol", "bar", "close", "p")
        out = test if out is None else out.unionByName(test)
    return trade_sets(out, th_long, th_short, notional)


def trade_sets(scored: DataFrame, th_long: float = 0.55, th_short: float = 0.45, notional: float = 10_000.0) -> DataFrame:
    """Ledger metrics and score per (symbol, feature_set) of scored bars, all sets in one ledger."""
    q = F.col("p")
    side = F.when(q >= th_long, 1).when(q <= th_short, -1).otherwise(0)
    keys = ["symbol", "feature_set", *[c for c in ("n_features", "missing") if c in scored.columns]]
    d = scored.select(*keys, "bar", "close", side.alias("side"), F.lit(notional).alias("size"))
    return core_pack(ledger(d, keys=keys), keys).withColumn("score", feature_set_score())


def shuffled_position(df: DataFrame, seed: int, key: Sequence[str] = ("symbol", "bar"), out: str = "_at") -> DataFrame:
    """Number the rows 0, 1, ... in the order of ``md5(seed|key...)``, ties by key.

    The leading 16 bits of the hash cut the rows into 65,536 even slices; slice counts
    become offsets and rows are numbered inside their slice, so no task orders the table.
    """
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]))
    d = df.withColumn("_h", h).withColumn("_hs", F.left("_h", F.lit(4)))
    before = Window.partitionBy(F.lit(1)).orderBy("_hs").rowsBetween(Window.unboundedPreceding, -1)  # 65,536 slices at most
    starts = d.groupBy("_hs").agg(F.count(F.lit(1)).alias("_n")).select("_hs", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy("_hs").orderBy("_h", *key))
    return d.withColumn("_rn", local).join(starts, "_hs").withColumn(out, F.col("_start") + F.col("_rn") - 1).drop("_h", "_hs", "_rn", "_start")


def permute(df: DataFrame, col: str, seed: int, key: Sequence[str] = ("symbol", "bar")) -> DataFrame:
    """Permute one column over all rows: in a random order each row takes the value of the row before it, the first the last's.

    One permutation of the whole table, the same for any partitioning and any size.
    """
    d = shuffled_position(df, seed, key)
    taken = d.select(((F.col("_at") + 1) % d.agg(F.count(F.lit(1))).scalar()).alias("_at"), F.col(col).alias("_taken"))
    return d.join(taken, "_at").withColumn(col, F.col("_taken")).select(*df.columns)


def permutation_importance(model: PipelineModel | None, df: DataFrame, features: Sequence[str], n: int = 5, seed: int = 42,
                           top: int | None = None, score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Loss of AUC when a feature is permuted (mean of n permutations), largest first; ``top`` keeps only so many.

    ``score`` adds ``p`` to a frame (default: the model's probability).  The permuted frames are scored
    into one table with their feature and round, so the AUCs are one query.
    """
    d = cut(df)
    score = score or (lambda x: probability(model, x, "p"))
    runs = score(d).select(F.lit("").alias("feature"), F.lit(0).alias("round"), "p", "label")
    for c in features:
        for i in range(n):
            runs = runs.unionByName(score(permute(d, c, seed + 101 * i)).select(F.lit(c).alias("feature"), F.lit(i).alias("round"), "p", "label"))
    per_run = auc(runs, keys=["feature", "round"])
    base = per_run.filter("feature = ''").select(F.col("auc").alias("_base"))
    g = per_run.filter("feature <> ''").groupBy("feature").agg(F.avg("auc").alias("_m"))
    out = g.select("feature", (base.scalar() - F.col("_m")).alias("auc_loss")).orderBy(F.col("auc_loss").desc(), "feature")
    return out if top is None else out.limit(top)


def tree_importances(model: PipelineModel, features: Sequence[str], df: DataFrame) -> DataFrame:
    """Importances of a tree model beside the mean of each feature in ``df``."""
    imp = model.stages[-1].featureImportances.toArray()
    long = df.agg(*[F.avg(c).alias(c) for c in features]).unpivot([], list(features), "feature", "mean_x")
    table = F.create_map(*[x for c, v in zip(features, imp) for x in (F.lit(c), F.lit(float(v)))])
    return long.withColumn("importance", table[F.col("feature")]).orderBy(F.col("importance").desc(), "feature")


def fit_regime_and_validator(train: DataFrame, features: Sequence[str], regime: str = "regime", label: str = "label",
                             light: bool = True, seed: int = 42) -> tuple[PipelineModel, PipelineModel]:
    """Two models on the same rows: a regime classifier (three classes) and a signal validator."""
    kind = "logistic" if light else "forest"
    d = cut(train.select(*features, regime, label))
    r = pipeline(features, kind, seed=seed).fit(d.select(*features, F.col(regime).cast("double").alias("label")))
    v = pipeline(features, kind, seed=seed).fit(d.select(*features, F.col(label).cast("double").alias("label")))
    return r, v
