"""Lists from scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.vector_search import item_list


def top_by_score(scored: DataFrame, score: str = "score", k: int = 20) -> DataFrame:
    """``session, type, aid, rank``: the best ``k`` of each (session, type), ties to the smaller id."""
    w = Window.partitionBy("session", "type").orderBy(F.desc(score), "aid")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("session", "type", "aid", "rank")


def lists_from_scores(scored: DataFrame, targets: DataFrame, score: str = "score", k: int = 20) -> DataFrame:
    """``session, type, predictions`` of every target row."""
    return item_list(top_by_score(scored, score, k), targets.select("session", "type"))
