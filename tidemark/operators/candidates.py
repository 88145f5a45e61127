"""The candidate pool: items of all sources with their ranks and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.items import parse_items
from tidemark.schema import SOURCES, require_columns, type_id

KEY = ["session", "type", "aid"]


def ranked_items(predictions: DataFrame, k: int | None = None) -> DataFrame:
    """``session, type, aid, rank`` of prediction lists; equal tokens once, ranks from 1."""
    require_columns(predictions, ("session", "type", "predictions"), "predictions")
    return predictions.select("session", "type", F.posexplode(parse_items(F.col("predictions"), k=k)).alias("p", "aid")).select("session", "type", "aid", (F.col("p") + 1).alias("rank"))


def candidate_pool(sources: dict[str, DataFrame], k: int = 50) -> DataFrame:
    """One row for each (session, type, aid) of any source's first ``k`` items, with ``from_s, s_rank, s_score`` of
    every source s, and ``source_count, min_rank, rrf_score, target_type_id``. One shuffle on the key: the sources are
    stacked and pivoted by conditional aggregates. A score is 1 / rank; absent sources have zeros."""
    names = list(sources)
    stacked = None
    for name, df in sources.items():
        one = df.where(F.col("rank") <= k).select(*KEY, "rank", F.lit(name).alias("source"))
        stacked = one if stacked is None else stacked.unionByName(one)
    ranks = [F.coalesce(F.min(F.when(F.col("source") == s, F.col("rank"))), F.lit(0)).cast("int").alias(f"{s}_rank") for s in names]
    pool = stacked.groupBy(*KEY).agg(*ranks)
    out = []
    for s in names:
        r = F.col(f"{s}_rank")
        out += [(r > 0).cast("int").alias(f"from_{s}"), r, F.when(r > 0, F.lit(1.0) / r).otherwise(0.0).alias(f"{s}_score")]
    pool = pool.select(*KEY, *out)
    count = sum((F.col(f"from_{s}") for s in names[1:]), F.col(f"from_{names[0]}"))
    rrf = sum((F.col(f"{s}_score") for s in names[1:]), F.col(f"{names[0]}_score"))
    used = F.filter(F.array(*(F.col(f"{s}_rank") for s in names)), lambda x: x > 0)
    return pool.withColumns({"source_count": count, "min_rank": F.coalesce(F.array_min(used), F.lit(0)), "rrf_score": rrf, "target_type_id": type_id()})


def score_column(details: DataFrame, source: str) -> str:
    """Name of a detail table's score."""
    for name in (f"{source}_score", "score"):
        if name in details.columns:
            return name
    raise ValueError(f"the details of {source} have no score")


def normalized_scores(details: DataFrame, source: str) -> DataFrame:
    """``session, type, aid, norm``: min-max over each (session, type); 1 where all scores are equal."""
    c = F.col(score_column(details, source))
    w = Window.partitionBy("session", "type")
    d = details.select(*KEY, c.cast("double").alias("s")).withColumns({"lo": F.min("s").over(w), "hi": F.max("s").over(w)})
    norm = F.when(F.col("hi") > F.col("lo"), (F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return d.select(*KEY, norm.alias("norm"))


def with_raw_norms(pool: DataFrame, details: dict[str, DataFrame], sources: tuple[str, ...] = SOURCES[1:]) -> DataFrame:
    """The pool with ``s_raw_score_norm`` of all ``sources`` if any details are given, else unchanged. Rows without a
    detail have 0; details never add rows."""
    if not details:
        return pool
    for s in sources:
        if s in details:
            n = normalized_scores(details[s], s).groupBy(*KEY).agg(F.max("norm").alias("norm"))
            pool = pool.join(n, KEY, "left").withColumn(f"{s}_raw_score_norm", F.coalesce("norm", F.lit(0.0))).drop("norm")
        else:
            pool = pool.withColumn(f"{s}_raw_score_norm", F.lit(0.0))
    return pool


def matched_scores(pool: DataFrame, details: DataFrame) -> DataFrame:
    """One row ``candidates, matched``: pool rows, and those of them that have a row in ``details``."""
    known = details.select(*KEY).distinct().withColumn("hit", F.lit(1))
    return pool.select(*KEY).join(known, KEY, "left").agg(F.count("*").alias("candidates"), F.count("hit").alias("matched"))


def pool_summary(pool: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: candidates, groups, distinct and repeated keys, mean candidates for each group, label groups."""
    per = pool.groupBy("session", "type").agg(F.count("*").alias("c"), F.count_distinct("aid").alias("d"))
    one = per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("candidates"), F.count("*").alias("groups"), F.coalesce(F.sum("d"), F.lit(0)).alias("distinct_keys"))
    one = one.withColumn("label_groups", F.lit(labels.select("session", "type").distinct().count()))
    return one.select("candidates", "groups", (F.col("candidates") - F.col("distinct_keys")).alias("repeated"), F.coalesce(F.try_divide(F.col("candidates").cast("double"), F.col("groups")), F.lit(0.0)).alias("mean_candidates"), "label_groups")
