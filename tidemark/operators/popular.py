"""Popular items by type, filled up with popular items of all types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.items import fill_to_k, join_items
from tidemark.schema import TYPES


def item_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("type", "aid").agg(F.count("*").alias("cnt"))


def top_by_type(events: DataFrame, k: int = 20) -> DataFrame:
    """``type, aid, cnt, rk``: the ``k`` most frequent items of each known type; ties go to the smaller id."""
    w = Window.partitionBy("type").orderBy(F.desc("cnt"), "aid")
    return item_counts(events).where(F.col("type").isin(*TYPES)).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def popular_lists(events: DataFrame, k: int = 20) -> DataFrame:
    """``type, items`` of the three types: typed items first, then items popular over all types. At most ``3 k`` rows
    meet in one task."""
    typed = top_by_type(events, k).groupBy("type").agg(F.sort_array(F.collect_list(F.struct("rk", "aid"))).alias("x")).select("type", F.col("x.aid").alias("typed"))
    best = events.groupBy("aid").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "aid").limit(k)
    everyone = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("c"), "aid"))).alias("g")).select(F.col("g.aid").alias("g"), F.explode(F.array(*map(F.lit, TYPES))).alias("type"))
    out = everyone.join(typed, "type", "left")
    empty = F.array().cast("array<bigint>")
    return out.select("type", fill_to_k(F.coalesce("typed", empty), F.coalesce("g", empty), k).alias("items"))


def popular_recall(events: DataFrame, targets: DataFrame, k: int = 20) -> DataFrame:
    """``session, type, predictions``; an unknown type has an empty list."""
    lists = F.broadcast(popular_lists(events, k))  # three rows
    return targets.join(lists, "type", "left").select("session", "type", F.coalesce(join_items(F.col("items")), F.lit("")).alias("predictions"))
