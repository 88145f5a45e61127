"""LambdaMART on histogram trees: boosting by the lambdas of NDCG@k.

Features are cut into bins at quantiles once. Every round writes the lambdas of all rows, then grows one tree level by
level: each task counts gradients, weights and rows by (node, feature, bin), the sums of these meet by node and feature,
and only they come to the driver, which splits the nodes of the largest gain until the tree has ``leaves`` leaves. The
numbers on the driver are bounded by leaves, features and bins, whatever the data."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.features import feature_columns
from tidemark.session import ship, shared_dir
from tidemark.sources import io

GROUP = ["session", "type"]


def require_features(df: DataFrame, features: list[str]) -> DataFrame:
    missing = sorted(set(features) - set(df.columns))
    if missing:
        raise ValueError(f"features are missing: {', '.join(missing)}")
    return df.fillna(0, features)


def lambdas(scored: DataFrame, k: int = 20) -> DataFrame:
    """``scored`` (``label``, ``score``) with ``gradient`` and ``weight`` of every row.

    Positives and negatives of a group meet by an equi-join on the group; the swap's change of NDCG@k scales each pair.
    Groups are candidate pools, bounded by the sources' list lengths."""
    w = Window.partitionBy(*GROUP).orderBy(F.desc("score"), "aid")
    r = scored.select(*GROUP, "aid", "label", "score").withColumn("rank", F.row_number().over(w))
    r = r.withColumn("discount", F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    r = r.withColumn("positives", F.sum("label").over(Window.partitionBy(*GROUP)))
    r = r.where("positives > 0").withColumn("ideal", _ideal(F.col("positives"), k))
    a = r.where("label > 0").select(*GROUP, *(F.col(c).alias(f"a_{c}") for c in ("aid", "score", "discount")), "ideal")
    b = r.where("label = 0").select(*GROUP, *(F.col(c).alias(f"b_{c}") for c in ("aid", "score", "discount")))
    p = a.join(b, GROUP)
    rho = 1.0 / (1.0 + F.exp(F.col("a_score") - F.col("b_score")))
    delta = F.abs(F.col("a_discount") - F.col("b_discount")) / F.col("ideal")
    p = p.select(*GROUP, "a_aid", "b_aid", (rho * delta).alias("g"), (rho * (1 - rho) * delta).alias("h"))
    up = p.select(*GROUP, F.col("a_aid").alias("aid"), "g", "h")
    down = p.select(*GROUP, F.col("b_aid").alias("aid"), (-F.col("g")).alias("g"), "h")
    per = up.unionByName(down).groupBy(*GROUP, "aid").agg(F.sum("g").alias("gradient"), F.sum("h").alias("weight"))
    return scored.join(per, [*GROUP, "aid"], "left").fillna(0.0, ["gradient", "weight"])


def _ideal(positives: Column, k: int) -> Column:
    places = F.sequence(F.lit(1), F.least(positives.cast("int"), F.lit(k)))
    return F.aggregate(places, F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))


def ndcg(scored: DataFrame, k: int = 20) -> float:
    """Mean NDCG@k of the groups with a positive."""
    w = Window.partitionBy(*GROUP).orderBy(F.desc("score"), "aid")
    r = scored.withColumn("rank", F.row_number().over(w))
    gain = F.when(F.col("rank") <= k, F.col("label") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    g = r.groupBy(*GROUP).agg(F.sum(gain).alias("g"), F.sum("label").cast("int").alias("n")).where("n > 0")
    return g.agg(F.coalesce(F.avg(F.col("g") / _ideal(F.col("n"), k)), F.lit(0.0))).first()[0]


@dataclass
class Tree:
    """Nodes in arrays: the feature and cut of inner nodes (values up to the cut go left), and values of leaves."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: float, gain: float, values: tuple[float, float]) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.cut[node], self.gain[node], self.left[node], self.right[node] = feature, cut, gain, at, at + 1
        for v in values:
            for column, x in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, v), (self.gain, 0.0)):
                column.append(x)
        return at, at + 1

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of features."""
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(feature[at] >= 0)).size:
            f = feature[at[inner]]
            low = x[inner, f] <= cut[at[inner]]
            at[inner] = np.where(low, left[at[inner]], right[at[inner]])
        return at

    def values(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(x)]


@dataclass
class LambdaMart:
    features: list[str]
    rate: float = 0.05
    trees: list[Tree] = field(default_factory=list)

    def score(self, data: DataFrame) -> DataFrame:
        """The rows with ``score``; a missing feature is an error, a null one is 0."""
        rows, rate, trees = require_features(data, self.features), self.rate, self.trees
        ship(data.sparkSession)

        @F.pandas_udf("double")
        def total(frame: pd.DataFrame) -> pd.Series:
            x = frame.to_numpy(np.float64)
            return pd.Series(sum((rate * t.values(x) for t in trees), np.zeros(len(x))))

        return rows.withColumn("score", total(F.struct(*(F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(self.features)))))

    def importance(self, spark: SparkSession) -> DataFrame:
        """``feature, importance``: the gain of all splits on a feature, largest first."""
        total = dict.fromkeys(self.features, 0.0)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    total[self.features[f]] += g
        return spark.createDataFrame(sorted(total.items(), key=lambda r: (-r[1], r[0])), "feature string, importance double")

    def save(self, spark: SparkSession, path: str) -> None:
        io.write_metadata(spark, {"features": self.features, "rate": self.rate, "trees": [asdict(t) for t in self.trees]}, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LambdaMart:
        found = io.read_metadata(spark, path)
        return LambdaMart(found["features"], found["rate"], [Tree(**t) for t in found["trees"]])


def _histograms(rows: DataFrame, tree: Tree, frontier: list[int], chosen: list[int], cuts: list[np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """(node, feature): gradients, weights and rows by bin, of ``x, gradient, weight``."""
    width = max(map(len, cuts)) + 1
    position = np.full(len(tree.feature), -1, np.int64)
    position[frontier] = np.arange(len(frontier))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(frontier), len(chosen), 3, width))
        for pdf in frames:
            x = np.array(pdf["x"].tolist(), np.float64).reshape(len(pdf), -1)
            at = position[tree.nodes(x)]
            own = at >= 0
            x, at, g, h = x[own], at[own], *(pdf[c].to_numpy(np.float64)[own] for c in ("gradient", "weight"))
            for j, f in enumerate(chosen):
                cell = at * width + np.searchsorted(cuts[f], x[:, f], side="left")
                for c, w in enumerate((g, h, None)):
                    total[:, j, c] += np.bincount(cell, w, len(frontier) * width).reshape(len(frontier), width)
        nodes, columns = np.indices(total.shape[:2])
        yield pd.DataFrame({"node": nodes.ravel(), "feature": columns.ravel(), "data": [a.tobytes() for a in total.reshape(-1, 3 * width)]})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(d, np.float64) for d in pdf["data"]], axis=0)
        return pd.DataFrame({"node": [key[0]], "feature": [key[1]], "data": [total.tobytes()]})

    shape = "node int, feature int, data binary"
    found = rows.select("x", "gradient", "weight").mapInPandas(count, shape).groupBy("node", "feature").applyInPandas(add, shape).collect()
    return {(frontier[r[0]], chosen[r[1]]): np.frombuffer(r[2], np.float64).reshape(3, width) for r in found}


def _best_split(held: dict[int, np.ndarray], min_rows: int) -> tuple[float, int, int, tuple[float, float]] | None:
    """Gain, feature, last bin on the left, and both values, of one node's histograms by feature."""
    best = None
    for f, (g, h, n) in held.items():
        gl, hl, nl = (np.cumsum(v)[:-1] for v in (g, h, n))
        gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
        fit = (nl >= min_rows) & (nr >= min_rows)
        if not fit.any():
            continue
        tiny = 1e-9
        gain = np.where(fit, gl**2 / (hl + tiny) + gr**2 / (hr + tiny) - g.sum() ** 2 / (h.sum() + tiny), -1.0)
        b = int(gain.argmax())
        if gain[b] > 1e-12 and (best is None or gain[b] > best[0]):
            best = float(gain[b]), f, b, (float(gl[b] / (hl[b] + tiny)), float(gr[b] / (hr[b] + tiny)))
    return best


def fit_lambdamart(
    data: DataFrame, features: list[str] | None = None, valid: DataFrame | None = None, rounds: int = 10, patience: int = 3, rate: float = 0.05, depth: int = 6, leaves: int = 63,
    min_rows: int = 50, feature_share: float = 1.0, row_share: float = 1.0, truncation: int | None = None, bins: int = 64, k: int = 20, seed: int = 2024, folder: str | None = None,
) -> LambdaMart:
    """Boost for ``rounds`` rounds, or until ``patience`` rounds bring no better NDCG@k on ``valid``. Trees have at most
    ``leaves`` leaves and ``depth`` levels; each sees ``feature_share`` of the features and, by a hash, ``row_share`` of the
    sessions. Pairs count as far as one of them ranks within ``truncation`` (else ``k``). Each round's rows are written to
    ``folder`` (else the checkpoint folder), so the plan doesn't grow and lost executors don't matter."""
    spark = data.sparkSession
    ship(spark)
    features = features or feature_columns(data)
    model = LambdaMart(features, rate)
    base = (folder.rstrip("/") if folder else shared_dir(spark)) + f"/lambdamart-{uuid.uuid4().hex}"
    rows = require_features(data, features).select(*GROUP, "aid", "label", F.array(*(F.col(c).cast("double") for c in features)).alias("x"), F.lit(0.0).alias("score"))
    levels = [i / bins for i in range(1, bins)]
    marks = rows.agg(*(F.percentile_approx(F.col("x")[i], levels, 10_000) for i in range(len(features)))).first()
    cuts = [np.unique(np.array(m if m else [0.0], np.float64)) for m in marks]
    rng = np.random.default_rng(seed)
    best, best_size, stale = -1.0, 0, 0
    for i in range(rounds):
        lambdas(rows, truncation or k).write.mode("overwrite").parquet(f"{base}/{i}")
        rows = spark.read.parquet(f"{base}/{i}")
        seen = rows if row_share >= 1 else rows.where(F.pmod(F.xxhash64("session", F.lit(seed + i)), F.lit(10_000)) < int(row_share * 10_000))
        chosen = sorted(rng.choice(len(features), max(1, round(feature_share * len(features))), replace=False).tolist())
        tree, frontier, open_leaves = Tree(), [0], 1
        for _ in range(depth):
            found = _histograms(seen, tree, frontier, chosen, cuts)
            splits = {n: _best_split({f: found[n, f] for f in chosen if (n, f) in found}, min_rows) for n in frontier}
            order = sorted((n for n in frontier if splits[n]), key=lambda n: -splits[n][0])[: leaves - open_leaves]
            frontier = []
            for n in order:
                gain, f, b, values = splits[n]
                frontier += tree.split(n, f, float(cuts[f][b]), gain, values)
                open_leaves += 1
            if not frontier or open_leaves >= leaves:
                break
        model.trees.append(tree)
        step = LambdaMart([f"x{j}" for j in range(len(features))], rate, [tree])
        flat = rows.select(*GROUP, "aid", "label", "x", F.col("score").alias("before"), *(F.col("x")[j].alias(f"x{j}") for j in range(len(features))))
        rows = step.score(flat).select(*GROUP, "aid", "label", "x", (F.col("before") + F.col("score")).alias("score"))
        if valid is not None:
            now = ndcg(model.score(valid), k)
            if now > best:
                best, best_size, stale = now, len(model.trees), 0
            else:
                stale += 1
                if stale >= patience:
                    break
    if valid is not None:
        model.trees = model.trees[:best_size]
    return model
