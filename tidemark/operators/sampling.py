"""Training pairs, samples and splits by hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.split import ORDER, with_position
from tidemark.schema import SAMPLE_WEIGHTS, type_id, type_value


def vocabulary(events: DataFrame, buckets: int = 256) -> DataFrame:
    """``aid, item_id``: dense ids from 1, by first appearance (session, time, sequence). Items are numbered within
    buckets of sessions between approximate quantiles, after those of the buckets before; so no task sorts all items."""
    first = events.groupBy("aid").agg(F.min(F.struct("session", *ORDER)).alias("f")).withColumn("s", F.col("f.session"))
    cuts = sorted(set(first.agg(F.percentile_approx("s", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= F.col("s"))) if cuts else F.lit(0)
    first = first.withColumn("bucket", F.when(F.col("s").isNull(), -1).otherwise(bucket))
    per = first.groupBy(F.col("bucket").alias("b")).agg(F.count("*").alias("n"))
    per = per.select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("before"))  # one row for each bucket
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("f", "aid"))
    return first.join(F.broadcast(per), F.col("bucket") == F.col("b")).select("aid", (F.col("before") + place).cast("bigint").alias("item_id"))


def pair_windows(events: DataFrame, max_seq_len: int = 50) -> DataFrame:
    """A row for each event but a session's first: ``session, pos, aid, target_type_id, sample_weight, history,
    history_types``, the latest ``max_seq_len`` events before it in order; 0 takes all."""
    low = -max_seq_len if max_seq_len else Window.unboundedPreceding
    w = Window.partitionBy("session").orderBy(*ORDER).rowsBetween(low, -1)
    e = with_position(events).withColumn("tid", type_id())
    e = e.withColumns({"history": F.collect_list("aid").over(w), "history_types": F.collect_list("tid").over(w)}).where("pos > 0")
    return e.select("session", "pos", "aid", F.col("tid").alias("target_type_id"), type_value("type", SAMPLE_WEIGHTS, 1.0).alias("sample_weight"), "history", "history_types")


def pair_stats(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("target_type_id").agg(F.count("*").alias("pairs"), F.count_distinct("aid").alias("items"))


def hash_key(*columns: str, seed: int = 2024):
    """A hash in hexadecimal that any SQL engine gives alike."""
    return F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in columns), F.lit(str(seed))))


def sample_pairs(events: DataFrame, max_pairs: int = 500_000, seed: int = 2024) -> DataFrame:
    """``session, pos`` of at most ``max_pairs`` target events, those of the smallest hashes; 0 takes all. Only keys
    are sampled; histories are built for them later."""
    p = with_position(events).where("pos > 0").select("session", "pos")
    if not max_pairs:
        return p
    return p.withColumn("h", hash_key("session", "pos", seed=seed)).orderBy("h", "session", "pos").limit(max_pairs).select("session", "pos")


def split_by_session(sessions: DataFrame, valid_ratio: float = 0.2, seed: int = 2024) -> DataFrame:
    """``session, holdout``: a share of about ``valid_ratio`` by the last four hexadecimal digits of the hash."""
    if not 0 < valid_ratio < 1:
        raise ValueError("valid_ratio must lie between 0 and 1")
    digits = F.conv(F.substring(hash_key("session", seed=seed), 29, 4), 16, 10).cast("int")
    return sessions.select("session").distinct().select("session", (digits < int(valid_ratio * 65536)).cast("int").alias("holdout"))


def holdout_sessions(sessions: DataFrame, valid_ratio: float = 0.2, seed: int = 2024) -> DataFrame:
    """``session`` of exactly ``max(1, int(n * valid_ratio))`` of the ``n`` distinct sessions: those of the smallest hashes.

    Sessions are counted by the hash's first four digits; all below the cell where the number is reached are in, and
    of that cell, one in 65,536, the smallest hashes. So no task sorts all sessions."""
    if not 0 < valid_ratio < 1:
        raise ValueError("valid_ratio must lie between 0 and 1")
    s = sessions.select("session").distinct().withColumn("h", hash_key("session", seed=seed))
    s = s.withColumn("cell", F.conv(F.substring("h", 1, 4), 16, 10).cast("int"))
    cells = sorted(s.groupBy("cell").count().collect())  # at most 65,536
    wanted, at, taken = max(1, int(sum(n for _, n in cells) * valid_ratio)), -1, 0
    for at, n in cells:
        if taken + n >= wanted:
            break
        taken += n
    last = s.where(F.col("cell") == at).orderBy("h", "session").limit(wanted - taken)
    return s.where(F.col("cell") < at).unionByName(last).select("session")
