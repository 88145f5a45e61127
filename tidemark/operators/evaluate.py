"""Weighted Recall@k, the oracle of a candidate pool, and submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.items import hits, normalize_items, parse_items
from tidemark.schema import METRIC_WEIGHTS, TYPES, require_columns


def per_row(labels: DataFrame, predictions: DataFrame, k: int = 20, dedup: bool = False) -> DataFrame:
    """``session, type, hits, denominator`` of every label row. Repeated prediction keys count each; without ``dedup``
    repeated tokens take places in the first ``k``. The denominator is at most ``k``."""
    require_columns(labels, ("session", "type", "labels"), "labels")
    require_columns(predictions, ("session", "type", "predictions"), "predictions")
    p = predictions.select("session", "type", parse_items(F.col("predictions"), dedup, k).alias("p"))
    j = labels.select("session", "type", parse_items(F.col("labels")).alias("w")).join(p, ["session", "type"], "left")
    empty = F.array().cast("array<bigint>")
    return j.select("session", "type", hits(F.coalesce("p", empty), F.col("w")).cast("bigint").alias("hits"), F.least(F.size("w"), F.lit(k)).cast("bigint").alias("denominator"))


def by_type(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``type, rows, hits, denominator, recall, weight, contribution`` of all three types; recall 0 without labels."""
    weights = weights or METRIC_WEIGHTS
    known = rows.sparkSession.createDataFrame([(t, float(weights[t])) for t in TYPES], "type string, weight double")
    sums = rows.groupBy("type").agg(F.count("*").alias("rows"), F.sum("hits").alias("hits"), F.sum("denominator").alias("denominator"))
    j = known.join(sums, "type", "left")
    zero = F.lit(0).cast("bigint")
    j = j.select("type", F.coalesce("rows", zero).alias("rows"), F.coalesce("hits", zero).alias("hits"), F.coalesce("denominator", zero).alias("denominator"), "weight")
    j = j.withColumn("recall", F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("denominator")), F.lit(0.0)))
    return j.select("type", "rows", "hits", "denominator", "recall", "weight", (F.col("recall") * F.col("weight")).alias("contribution"))


def overall(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row: sums over all types, micro recall, and the weighted score."""
    t = by_type(rows, weights)
    one = t.agg(F.sum("rows").alias("rows"), F.sum("hits").alias("hits"), F.sum("denominator").alias("denominator"), F.sum("contribution").alias("weighted_score"))
    return one.select("rows", "hits", "denominator", F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("denominator")), F.lit(0.0)).alias("recall"), "weighted_score")


def oracle_rows(pool: DataFrame, labels: DataFrame, k: int = 20) -> DataFrame:
    """``session, type, hits, denominator, covered``: what an ideal ranking of the pool would hit. Label items and the
    pool meet on the item, so no group of candidates is gathered."""
    w = labels.select("session", "type", parse_items(F.col("labels")).alias("w"))
    items = w.select("session", "type", F.explode(F.array_distinct("w")).alias("aid"))
    found = items.join(pool.select("session", "type", "aid"), ["session", "type", "aid"], "left_semi").groupBy("session", "type").agg(F.count("*").alias("h"))
    j = w.join(found, ["session", "type"], "left")
    h = F.coalesce("h", F.lit(0))
    return j.select("session", "type", F.least(h, F.lit(k)).cast("bigint").alias("hits"), F.least(F.size("w"), F.lit(k)).cast("bigint").alias("denominator"), (h > 0).cast("bigint").alias("covered"))


def oracle(pool: DataFrame, labels: DataFrame, k: int = 20) -> DataFrame:
    """Recall by type of the ideal ranking, with the label rows it covers."""
    rows = oracle_rows(pool, labels, k)
    cover = rows.groupBy("type").agg(F.sum("covered").alias("covered"))
    return by_type(rows).join(cover, "type", "left").withColumn("covered", F.coalesce("covered", F.lit(0).cast("bigint")))


def label_counts(labels: DataFrame) -> DataFrame:
    """``type, rows, items, mean_items`` of all three types: label rows, and the items in them."""
    known = labels.sparkSession.createDataFrame([(t,) for t in TYPES], "type string")
    n = F.size(parse_items(F.col("labels")))
    sums = labels.groupBy("type").agg(F.count("*").alias("rows"), F.sum(n).alias("items"))
    zero = F.lit(0).cast("bigint")
    j = known.join(sums, "type", "left").select("type", F.coalesce("rows", zero).alias("rows"), F.coalesce("items", zero).alias("items"))
    return j.withColumn("mean_items", F.coalesce(F.try_divide(F.col("items").cast("double"), F.col("rows")), F.lit(0.0)))


def as_table(report: DataFrame, digits: int = 6, rows: int = 100) -> str:
    """The first rows of a small report as text in columns of fixed width: numbers to the right, others to the left."""
    found = [[f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v) for v in r] for r in report.limit(rows).collect()]
    right = [kind not in ("string", "boolean") for _, kind in report.dtypes]
    width = [max(len(x) for x in column) for column in zip(report.columns, *found)]
    lines = ["  ".join(x.rjust(w) if r else x.ljust(w) for x, w, r in zip(line, width, right)).rstrip() for line in [report.columns, *found]]
    return "\n".join([lines[0], "-" * len(lines[0]), *lines[1:]])


def submission(predictions: DataFrame, k: int = 20) -> DataFrame:
    """``session_type, labels``: cleaned lists of at most ``k`` items."""
    require_columns(predictions, ("session", "type", "predictions"), "predictions")
    return predictions.select(F.concat_ws("_", F.col("session").cast("string"), "type").alias("session_type"), normalize_items(F.col("predictions"), k).alias("labels"))


def list_counters(predictions: DataFrame, k: int = 20) -> DataFrame:
    """One row: lists, empty lists, and lists of fewer than ``k`` items."""
    n = F.size(parse_items(F.col("predictions")))
    return predictions.agg(F.count("*").alias("rows"), F.count_if(n == 0).alias("empty"), F.count_if(n < k).alias("underfilled"))
