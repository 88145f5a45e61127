"""Fusion of ranked sources by weighted reciprocal ranks, and its grid search."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.items import fill_to_k, join_items, parse_items
from tidemark.schema import FUSION_WEIGHTS, METRIC_WEIGHTS, TYPES

#: Order in which sources give the list of last resort.
FALLBACK_ORDER = ("popular", "dssm", "covis")
DEFAULT_GRID = {"popular": (0.1, 0.2), "covis": (1.0, 1.5, 2.0), "dssm": (0.5, 0.8, 1.0, 1.5)}


def fallback_items(sources: dict[str, DataFrame], k: int) -> list[int]:
    """The first list that isn't empty, by source order, then session and type; maybe empty. The rows of the smallest keys
    are taken of one source after the other, at most ``k`` each, so that later sources mostly aren't run."""
    for name in (s for s in FALLBACK_ORDER if s in sources):
        rows = sources[name].select("session", "type", "rank", "aid").orderBy("session", "type", "rank", "aid").limit(k).collect()
        if rows:
            return [r["aid"] for r in rows if (r["session"], r["type"]) == (rows[0]["session"], rows[0]["type"])]
    return []


def stack(sources: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sources.items():
        one = df.select("session", "type", "aid", "rank", F.lit(name).alias("source"))
        out = one if out is None else out.unionByName(one)
    return out


def fused_items(targets: DataFrame, sources: dict[str, DataFrame], grid: DataFrame, k: int) -> DataFrame:
    """``grid_idx, session, type, items``: fused lists before the fill, for every row of weights in ``grid``
    (``grid_idx, source, weight``): one job, whatever the number of weights."""
    rows = stack(sources).join(targets.distinct(), ["session", "type"])
    scored = rows.join(F.broadcast(grid), "source")  # a few rows of weights
    scored = scored.groupBy("grid_idx", "session", "type", "aid").agg(F.round(F.sum(F.col("weight") / F.col("rank")), 6).alias("score"))
    w = Window.partitionBy("grid_idx", "session", "type").orderBy(F.desc("score"), "aid")
    top = scored.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
    return top.groupBy("grid_idx", "session", "type").agg(F.sort_array(F.collect_list(F.struct("rk", "aid"))).alias("x")).select("grid_idx", "session", "type", F.col("x.aid").alias("items"))


def weight_rows(targets: DataFrame, weights: list[dict[str, float]]) -> DataFrame:
    rows = [(i, s, float(w)) for i, ws in enumerate(weights) for s, w in ws.items()]
    return targets.sparkSession.createDataFrame(rows, "grid_idx int, source string, weight double")


def fuse(targets: DataFrame, sources: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = 20) -> DataFrame:
    """``session, type, predictions, n_before``: fused lists filled up to ``k`` with the list of last resort; ``n_before``
    counts items before that."""
    grid = weight_rows(targets, [weights or FUSION_WEIGHTS])
    items = fused_items(targets, sources, grid, k).drop("grid_idx")
    fallback = fallback_items(sources, k)
    out = targets.join(items, ["session", "type"], "left")
    have = F.coalesce("items", F.array().cast("array<bigint>"))
    last = F.array(*map(F.lit, fallback)).cast("array<bigint>")
    return out.select("session", "type", join_items(fill_to_k(have, last, k)).alias("predictions"), F.size(have).alias("n_before"))


def grid_search(targets: DataFrame, labels: DataFrame | None, sources: dict[str, DataFrame], grid: dict[str, tuple[float, ...]] | None = None, k: int = 20) -> DataFrame:
    """A row for each combination of weights, best first: the weights, recall by type, the weighted score, and lists
    shorter than ``k`` before and after the fill."""
    if labels is None:
        raise ValueError("a grid search needs labels")
    grid = grid or DEFAULT_GRID
    combos = [dict(zip(grid, c)) for c in product(*grid.values())]
    weights = weight_rows(targets, combos)
    items = fused_items(targets, sources, weights, k)
    fallback = fallback_items(sources, k)
    slots = targets.select("session", "type", F.explode(F.array(*map(F.lit, range(len(combos))))).alias("grid_idx"))
    have = F.coalesce("items", F.array().cast("array<bigint>"))
    last = F.array(*map(F.lit, fallback)).cast("array<bigint>")
    lists = slots.join(items, ["grid_idx", "session", "type"], "left").select("grid_idx", "session", "type", F.size(have).alias("before"), fill_to_k(have, last, k).alias("items"))
    wanted = labels.select("session", "type", parse_items(F.col("labels")).alias("wanted"))
    judged = lists.join(wanted, ["session", "type"], "left").withColumn("wanted", F.coalesce("wanted", F.array().cast("array<bigint>")))
    hit = F.size(F.array_intersect("items", "wanted"))
    out = judged.groupBy("grid_idx").agg(
        *(F.sum(F.when(F.col("type") == t, hit)).alias(f"h_{t}") for t in TYPES),
        *(F.sum(F.when(F.col("type") == t, F.least(F.size("wanted"), F.lit(k)))).alias(f"d_{t}") for t in TYPES),
        F.count_if(F.col("before") < k).alias("underfilled_before_fallback"),
        F.count_if(F.size("items") < k).alias("underfilled_after_fallback"),
    )
    recall = {t: F.coalesce(F.try_divide(F.col(f"h_{t}").cast("double"), F.col(f"d_{t}")), F.lit(0.0)) for t in TYPES}
    score = sum((recall[t] * METRIC_WEIGHTS[t] for t in TYPES[1:]), recall[TYPES[0]] * METRIC_WEIGHTS[TYPES[0]])
    frame = targets.sparkSession.createDataFrame([(i, *(float(c[s]) for s in grid)) for i, c in enumerate(combos)], "grid_idx int, " + ", ".join(f"{s}_weight double" for s in grid))
    out = out.join(F.broadcast(frame), "grid_idx")
    out = out.select("grid_idx", *(f"{s}_weight" for s in grid), *(recall[t].alias(f"{t}_recall") for t in TYPES), score.alias("weighted_score"), "underfilled_before_fallback", "underfilled_after_fallback")
    return out.orderBy(F.desc("weighted_score"), "grid_idx")


