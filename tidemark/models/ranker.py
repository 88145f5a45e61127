"""Rankers: a pointwise gradient-boosted classifier and LambdaMART, and what they share."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.models.lambdamart import GROUP, LambdaMart, fit_lambdamart, lambdas, ndcg, require_features
from tidemark.operators.features import feature_columns
from tidemark.operators.ranking import lists_from_scores
from tidemark.operators.sampling import holdout_sessions

__all__ = ["GROUP", "LambdaMart", "fit_gbt", "fit_lambdamart", "group_sizes", "holdout", "importance", "lambdas", "ndcg", "predict_lists", "require_features", "score_gbt"]


def holdout(data: DataFrame, valid_ratio: float = 0.2, seed: int = 2024) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows, parted by session: ``max(1, int(n * valid_ratio))`` of ``n`` sessions are held out."""
    out = holdout_sessions(data, valid_ratio, seed)
    return data.join(out, "session", "left_anti"), data.join(out, "session", "left_semi")


def group_sizes(data: DataFrame) -> DataFrame:
    return data.groupBy(*GROUP).agg(F.count("*").alias("size"))


def fit_gbt(data: DataFrame, features: list[str] | None = None, rounds: int = 20, depth: int = 5, seed: int = 2024) -> PipelineModel:
    """A pointwise ranker; ``PipelineModel.write().save`` and ``load`` keep it."""
    features = features or feature_columns(data)
    rows = require_features(data, features).withColumn("label", F.col("label").cast("double"))
    stages = [VectorAssembler(inputCols=features, outputCol="features"), GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, subsamplingRate=0.85, stepSize=0.1)]
    assembled = stages[0].transform(rows)
    return PipelineModel([stages[0], stages[1].fit(assembled)])


def score_gbt(model: PipelineModel, data: DataFrame) -> DataFrame:
    """The rows with ``score``, the probability of label 1."""
    features = model.stages[0].getInputCols()
    out = model.transform(require_features(data, features))
    return out.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def importance(model: PipelineModel) -> DataFrame:
    """``feature, importance``, largest first."""
    from pyspark.sql import SparkSession

    names = model.stages[0].getInputCols()
    values = model.stages[1].featureImportances.toArray()
    rows = sorted(((n, float(v)) for n, v in zip(names, values)), key=lambda r: (-r[1], r[0]))
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def predict_lists(scored: DataFrame, targets: DataFrame, k: int = 20) -> DataFrame:
    return lists_from_scores(scored, targets, "score", k)
