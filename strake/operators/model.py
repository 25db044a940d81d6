"""Combining features into a score, walking forward over the dates, with Spark's own learners.

Kinds: 'logistic' and 'boosted' classify an outcome of 0 and 1; 'regress' fits boosted trees to any outcome, 'regress_cs' to
the outcome's rank within its date.
"""

from __future__ import annotations

import json
import os

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ops import cs_rank
from .labels import Fold, positive_weight
from .metrics import daily_gini
from .relational import ContractError

KINDS = ("logistic", "boosted", "regress", "regress_cs")


def between(df: DataFrame, span: tuple[int, int]) -> DataFrame:
    return df.where((F.col("t") >= span[0]) & (F.col("t") < span[1]))


def fit(train: DataFrame, features: list[str], y: str = "y", kind: str = "logistic", seed: int = 1, iterations: int | None = None, depth: int = 5) -> PipelineModel:
    """A model of y on the features, missing ones at their mean; in classification positives weigh what they are outnumbered by.

    iterations: of the logistic fit (30 if not given), or trees (40)."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    train = train.where(F.col(y).isNotNull())
    common = {"featuresCol": "_s", "labelCol": "_label", "weightCol": "_w"}
    trees = {"maxDepth": depth, "maxIter": iterations or 40, "stepSize": 0.05, "subsamplingRate": 0.8, "seed": seed}
    if kind.startswith("regress"):
        train = train.withColumns({"_label": cs_rank(F.col(y)) if kind == "regress_cs" else F.col(y).cast("double"), "_w": F.lit(1.0)})
        learner = GBTRegressor(**common, **trees)
    else:
        w = positive_weight(train, y).first()[0]
        train = train.withColumns({"_label": F.col(y), "_w": F.when(F.col(y) > 0, w).otherwise(1.0)})
        learner = LogisticRegression(regParam=0.01, maxIter=iterations or 30, **common) if kind == "logistic" else GBTClassifier(**common, **trees)
    filled = [f"_f{i}" for i in range(len(features))]
    stages = [Imputer(inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_v"), StandardScaler(withMean=True, inputCol="_v", outputCol="_s"), learner]
    return Pipeline(stages=stages).fit(train)


def predict(model: PipelineModel, df: DataFrame, name: str = "prediction_score") -> DataFrame:
    scored = model.transform(df)
    value = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
    return scored.select(*[F.col(f"`{c}`") for c in df.columns], value.alias(name))


def mean_gini(scored: DataFrame, y: str = "y", name: str = "prediction_score") -> float | None:
    return daily_gini(scored, name, y).agg(F.avg("gini")).first()[0]


def fit_early(train: DataFrame, valid: DataFrame, features: list[str], y: str = "y", kind: str = "boosted", seed: int = 1, steps: tuple[int, ...] = (10, 20, 40)) -> tuple[PipelineModel, int]:
    """The model, and its iterations, whose daily gini on the validation dates is best; ends when one step is no better."""
    best: tuple[float, PipelineModel, int] | None = None
    for n in steps:
        model = fit(train, features, y, kind, seed, n)
        got = mean_gini(predict(model, valid), y)
        if best is not None and (got is None or got <= best[0]):
            break
        best = (-2.0 if got is None else got, model, n)
    return best[1], best[2]


def save_model(model: PipelineModel, path: str, features: list[str], kind: str, expressions: dict[str, str] | None = None) -> None:
    """The model and, beside it, what it must be fed with."""
    model.write().overwrite().save(os.path.join(path, "model"))
    meta = json.dumps({"features": features, "kind": kind, "expressions": expressions or {}})
    spark = SparkSession.active()
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "meta"))


def load_model(path: str, features: list[str], expressions: dict[str, str] | None = None) -> PipelineModel:
    """The model, refused where it was fitted to other features, another order of them, or other expressions behind them."""
    meta = json.loads(SparkSession.active().read.text(os.path.join(path, "meta")).first()["value"])
    if meta["features"] != list(features) or meta["expressions"] != (expressions or {}):
        raise ContractError(f"the model was fitted to {meta['features']} {meta['expressions']}, not to {list(features)} {expressions or {}}")
    return PipelineModel.load(os.path.join(path, "model"))


def ablation(df: DataFrame, base: list[str], extra: list[str], fold: Fold, seeds: tuple[int, ...], y: str = "y", kind: str = "boosted", **kw) -> list[tuple[str, int, float | None]]:
    """(arm, seed, mean daily gini on the test dates) without and with the extra features."""
    train, test = between(df, fold.train).persist(), between(df, fold.test).persist()
    try:
        arms = {"base": base, "with": [*base, *extra]}
        return [(arm, seed, mean_gini(predict(fit(train, cols, y, kind, seed, **kw), test), y)) for arm, cols in arms.items() for seed in seeds]
    finally:
        train.unpersist()
        test.unpersist()


def walk_forward_scores(df: DataFrame, features: list[str], folds: list[Fold], y: str = "y", kind: str = "logistic") -> DataFrame:
    """df's rows of the folds' test dates with ``fold`` and the score of the model fitted to that fold's training dates."""
    out = None
    for f in folds:
        scored = predict(fit(between(df, f.train), features, y, kind), between(df, f.test)).withColumn("fold", F.lit(f.index))
        out = scored if out is None else out.unionByName(scored)
    return out
