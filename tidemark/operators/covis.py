"""Item co-visitation: pair counts within sessions, the truncated graph, and recall by recency-weighted look-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.items import join_items


def recency(events: DataFrame) -> DataFrame:
    """Events with ``rpos``, 1 for a session's latest event."""
    w = Window.partitionBy("session").orderBy(F.desc("ts"), F.desc("seq"))
    return events.withColumn("rpos", F.row_number().over(w))


def pair_counts(events: DataFrame, session_limit: int = 30) -> DataFrame:
    """``aid, neighbor, cnt``: ordered pairs of different items among a session's latest ``session_limit`` events.

    Items are counted within the session first, and pairs add the product of their counts; a session has at most
    ``session_limit`` items there, so the join on the session is bounded by its square, whatever the session's length."""
    c = recency(events).where(F.col("rpos") <= session_limit).groupBy("session", "aid").agg(F.count("*").alias("c"))
    other = c.select("session", F.col("aid").alias("neighbor"), F.col("c").alias("d"))
    pairs = c.join(other, "session").where("aid <> neighbor")
    return pairs.groupBy("aid", "neighbor").agg(F.sum(F.col("c") * F.col("d")).alias("cnt"))


def covis_topk(events: DataFrame, session_limit: int = 30, top_k: int = 20) -> DataFrame:
    """``aid, neighbor, cnt, rk``: the ``top_k`` neighbours of every item; ties go to the smaller id."""
    w = Window.partitionBy("aid").orderBy(F.desc("cnt"), "neighbor")
    return pair_counts(events, session_limit).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= top_k)


def covis_scores(events: DataFrame, edges: DataFrame, k: int = 20) -> DataFrame:
    """``session, aid, rank, score``: sum of count / recency over the whole history, repeats included; the best ``k``
    of a session, scores rounded to 6 digits, ties to the smaller id. Items of the history aren't left out."""
    w = F.sum(F.lit(1.0) / F.col("rpos")).alias("w")
    h = recency(events).groupBy("session", "aid").agg(w)
    s = h.join(edges, "aid").groupBy("session", F.col("neighbor").alias("aid")).agg(F.round(F.sum(F.col("cnt") * F.col("w")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("score"), "aid"))
    return s.withColumn("rank", rank).where(F.col("rank") <= k).select("session", "aid", "rank", "score")


def covis_details(events: DataFrame, edges: DataFrame, targets: DataFrame, k: int = 20) -> DataFrame:
    """``session, type, aid, rank, covis_score`` of every target row; the list doesn't depend on the type."""
    s = covis_scores(events, edges, k)
    return targets.join(s, "session").select("session", "type", "aid", "rank", F.col("score").alias("covis_score"))


def covis_recall(events: DataFrame, edges: DataFrame, targets: DataFrame, k: int = 20) -> DataFrame:
    """``session, type, predictions``; empty where nothing is near."""
    s = covis_scores(events, edges, k).groupBy("session").agg(F.sort_array(F.collect_list(F.struct("rank", "aid"))).alias("x"))
    out = targets.join(s.select("session", F.col("x.aid").alias("items")), "session", "left")
    return out.select("session", "type", F.coalesce(join_items(F.col("items")), F.lit("")).alias("predictions"))
