"""Ranking features: labels, popularity and session statistics, and session-item history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.items import parse_items
from tidemark.operators.split import with_position
from tidemark.schema import TYPES, require_columns, type_id

ID_COLUMNS = ("session", "type", "aid", "label")
KEY = ["session", "target_type_id", "aid"]


def check_unique(pool: DataFrame) -> DataFrame:
    """The pool, or ValueError if a (session, type, aid) repeats."""
    if not pool.groupBy("session", "type", "aid").count().where("count > 1").isEmpty():
        raise ValueError("the pool repeats a (session, type, aid)")
    return pool


def positives(labels: DataFrame) -> DataFrame:
    """``session, target_type_id, aid, label`` of all labels of known types."""
    x = labels.select("session", type_id().alias("target_type_id"), F.explode(parse_items(F.col("labels"))).alias("aid"))
    return x.where("target_type_id > 0").distinct().withColumn("label", F.lit(1))


def add_labels(pool: DataFrame, labels: DataFrame) -> DataFrame:
    return pool.join(positives(labels), KEY, "left").withColumn("label", F.coalesce("label", F.lit(0)))


def item_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("aid").agg(F.count("*").alias("item_popularity"), *(F.count_if(F.col("type") == t).alias(f"item_{t}_count") for t in TYPES))


def session_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("session").agg(F.count("*").alias("session_len"), *(F.count_if(F.col("type") == t).alias(f"session_{t}_count") for t in TYPES))


def history_stats(events: DataFrame) -> DataFrame:
    """``session, aid, session_aid_count, aid_last_pos_from_end, aid_last_type_id``."""
    e = with_position(events)
    return e.groupBy("session", "aid").agg(F.count("*").alias("session_aid_count"), F.min(F.col("n") - F.col("pos") - 1).alias("aid_last_pos_from_end"), F.max_by(type_id(), "pos").alias("aid_last_type_id"))


def add_stats(pool: DataFrame, events: DataFrame) -> DataFrame:
    items, sessions = item_stats(events), session_stats(events)
    out = pool.join(items, "aid", "left").join(sessions, "session", "left")
    return out.fillna(0, [c for c in (*items.columns[1:], *sessions.columns[1:])])


def add_history(pool: DataFrame, events: DataFrame) -> DataFrame:
    """History of each candidate; unseen ones have counts 0, last place -1, type 0 and ``in_session_history`` 0."""
    out = pool.join(history_stats(events), ["session", "aid"], "left")
    seen = F.col("session_aid_count").isNotNull().cast("int")
    return out.withColumn("in_session_history", seen).fillna({"session_aid_count": 0, "aid_last_pos_from_end": -1, "aid_last_type_id": 0})


def narrow(df: DataFrame) -> DataFrame:
    """Small types for storage, by name; nulls become 0. Values must fit, as Spark's ANSI casts check."""

    def kind(c: str) -> str | None:
        if c.startswith("from_") or c in ("label", "source_count", "target_type_id", "in_session_history", "aid_last_type_id"):
            return "tinyint"
        if c.endswith("_rank") or c in ("session_len", "session_aid_count", "aid_last_pos_from_end") or c.startswith("session_") and c.endswith("_count"):
            return "smallint"
        if c.endswith(("_score", "_score_norm")):
            return "float"
        if c == "item_popularity" or c.startswith("item_") and c.endswith("_count"):
            return "int"
        return None

    return df.select(*(F.coalesce(F.col(c), F.lit(0)).cast(kind(c)).alias(c) if kind(c) else F.col(c) for c in df.columns))


def train_data(pool: DataFrame, events: DataFrame, labels: DataFrame, unique: bool = False) -> DataFrame:
    """The pool with labels and all features. ``unique`` says that the pool's keys are, as those of
    :func:`~tidemark.operators.candidates.candidate_pool`; others are checked, by a job of its own."""
    require_columns(events, ("session", "aid", "ts", "type"), "events")
    return add_history(add_stats(add_labels(pool if unique else check_unique(pool), labels), events), events)


def inference_data(pool: DataFrame, events: DataFrame, unique: bool = False) -> DataFrame:
    """The pool with all features, from the events given; a label is dropped."""
    pool = pool.drop("label")
    return add_history(add_stats(pool if unique else check_unique(pool), events), events)


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ID_COLUMNS]
