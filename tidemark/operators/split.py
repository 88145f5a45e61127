"""Sessions in order, and their split in time into history and future labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.items import clamp, join_items, share_of
from tidemark.schema import TYPES

ORDER = ("ts", "seq")


def with_position(events: DataFrame) -> DataFrame:
    """Events with ``pos`` (from 0) in their session and the session's length ``n``. Order: time, then ``seq``."""
    w = Window.partitionBy("session")
    return events.withColumns({"pos": (F.row_number().over(w.orderBy(*ORDER)) - 1).cast("bigint"), "n": F.count("*").over(w)})


def split_sessions(events: DataFrame, history_ratio: float = 0.8) -> DataFrame:
    """Events of sessions of two or more, with ``future``: the place is at or beyond ``clamp(int(n * ratio), 1, n - 1)``."""
    if not 0 < history_ratio < 1:
        raise ValueError("history_ratio must lie between 0 and 1")
    e = with_position(events).where("n >= 2")
    return e.withColumn("future", F.col("pos") >= clamp(share_of(F.col("n"), history_ratio), 1, F.col("n") - 1))


def history(split: DataFrame) -> DataFrame:
    return split.where("NOT future").select("session", "aid", "ts", "seq", "type")


def future_items(split: DataFrame) -> DataFrame:
    """``session, type, aid, first_pos``: distinct future items of the known types."""
    f = split.where(F.col("future") & F.col("type").isin(*TYPES))
    return f.groupBy("session", "type", "aid").agg(F.min("pos").alias("first_pos"))


def label_rows(split: DataFrame) -> DataFrame:
    """``session, type, labels``: future items in order of first occurrence; never empty."""
    items = future_items(split).groupBy("session", "type").agg(F.sort_array(F.collect_list(F.struct("first_pos", "aid"))).alias("x"))
    return items.select("session", "type", join_items(F.col("x.aid")).alias("labels"))


def skipped_sessions(events: DataFrame) -> DataFrame:
    """One row ``skipped``: sessions too short to split."""
    return events.groupBy("session").count().where("count < 2").agg(F.count("*").alias("skipped"))


def build_validation(events: DataFrame, history_ratio: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """History events, labels, and the number of skipped sessions."""
    split = split_sessions(events, history_ratio)
    return history(split), label_rows(split), skipped_sessions(events)


def session_items(events: DataFrame) -> DataFrame:
    """``session, items``: all items of a session in order."""
    x = events.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("ts", "seq", "aid"))).alias("x"))
    return x.select("session", F.col("x.aid").alias("items"))
