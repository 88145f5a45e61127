"""Target rows: the (session, type) slots that want a list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.items import normalize_items
from tidemark.schema import TYPES, require_columns


def from_labels(labels: DataFrame) -> DataFrame:
    return require_columns(labels, ("session", "type"), "labels").select("session", "type")


def from_events(events: DataFrame) -> DataFrame:
    """Every session with each of the three types."""
    s = events.select("session").distinct()
    return s.select("session", F.explode(F.array(*map(F.lit, TYPES))).alias("type"))


def target_rows(labels: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """From labels or from events, exactly one of them."""
    if (labels is None) == (events is None):
        raise ValueError("give either labels or events")
    return from_labels(labels) if labels is not None else from_events(events)


def order_by_targets(predictions: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """One cleaned list for every target row; of repeated keys the first in the order of the rows, of missing ones an
    empty list."""
    p = predictions.withColumn("place", F.monotonically_increasing_id())
    p = p.groupBy("session", "type").agg(F.min_by("predictions", "place").alias("predictions"))
    return targets.join(p, ["session", "type"], "left").select("session", "type", normalize_items(F.col("predictions"), k).alias("predictions"))
