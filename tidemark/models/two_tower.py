"""A two-tower model of sessions and items, trained with numpy on a bounded sample of pairs.

The item tower is a unit-length embedding; the session tower is the unit-length sum of recency-weighted item and type
embeddings and the target type's embedding. The loss is cross entropy over the batch's own items, at a temperature,
weighted by target type; AdamW steps with closed-form gradients."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import sampling, vector_search
from tidemark.schema import TYPES
from tidemark.sources import io


@dataclass
class TwoTower:
    items: np.ndarray  # row 0 is padding
    types: np.ndarray  # row 0 is padding
    aids: np.ndarray  # aid of item 1, 2, ...

    def item_vectors(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(int(a), [float(x) for x in v]) for a, v in zip(self.aids, self.items[1:])], "aid bigint, vec array<double>")

    def type_vectors(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, [float(x) for x in self.types[i + 1]]) for i, t in enumerate(TYPES)], "type string, vec array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        io.write_table(self.item_vectors(spark), f"{path}/items")
        io.write_table(self.type_vectors(spark), f"{path}/types")
        io.write_metadata(spark, {"embedding_dim": int(self.items.shape[1])}, f"{path}/metadata")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TwoTower:
        rows = spark.read.parquet(f"{path}/items").orderBy("aid").collect()
        kinds = {r[0]: r[1] for r in spark.read.parquet(f"{path}/types").collect()}
        dim = io.read_metadata(spark, f"{path}/metadata")["embedding_dim"]
        items = np.vstack([np.zeros((1, dim)), np.array([r[1] for r in rows]).reshape(-1, dim)])
        return TwoTower(items, np.vstack([np.zeros(dim), *(kinds[t] for t in TYPES)]), np.array([r[0] for r in rows], np.int64))

    def recall(self, events: DataFrame, targets: DataFrame, k: int = 20) -> DataFrame:
        """Details ``session, type, aid, rank, dssm_score`` of the target rows with history."""
        spark = events.sparkSession
        items = self.item_vectors(spark)
        q = vector_search.session_vectors(events, targets, items, self.type_vectors(spark))
        return vector_search.search(q, items, k)


def normalize(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x / n, n


def loss_and_gradients(items, types, batch, temperature: float = 0.1):
    """Weighted loss of a batch ``(history, history_types, weights, target, target_type, sample_weight)`` and the
    gradients of both tables. Histories are padded with 0, their weights are 0 there."""
    h, ht, w, t, tt, sw = batch
    raw = np.einsum("bl,bld->bd", w, items[h] + types[ht]) + types[tt]
    s, s_norm = normalize(raw)
    v, v_norm = normalize(items[t])
    logits = s @ v.T / temperature
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    share = sw / sw.sum()
    loss = float(-(share * np.log(np.maximum(p[np.arange(len(t)), np.arange(len(t))], 1e-300))).sum())
    g = p.copy()
    g[np.arange(len(t)), np.arange(len(t))] -= 1
    g *= share[:, None] / temperature
    ds, dv = g @ v, g.T @ s
    d_raw = (ds - s * (s * ds).sum(axis=1, keepdims=True)) / s_norm
    d_item = (dv - v * (v * dv).sum(axis=1, keepdims=True)) / v_norm
    gi, gt = np.zeros_like(items), np.zeros_like(types)
    spread = w[:, :, None] * d_raw[:, None, :]
    np.add.at(gi, h, spread)
    np.add.at(gt, ht, spread)
    np.add.at(gt, tt, d_raw)
    np.add.at(gi, t, d_item)
    gi[0] = 0
    gt[0] = 0
    return loss, gi, gt


def train(events: DataFrame, embedding_dim: int = 128, epochs: int = 20, batch_size: int = 256, lr: float = 1e-3, weight_decay: float = 1e-5, max_pairs: int = 500_000, max_seq_len: int = 50, seed: int = 2024) -> TwoTower:
    """Fit on at most ``max_pairs`` pairs, chosen by hash: what comes to the driver is bounded by
    ``max_pairs * max_seq_len`` numbers and the vocabulary."""
    vocab = sampling.vocabulary(events)
    chosen = sampling.sample_pairs(events, max_pairs, seed)
    pairs = sampling.pair_windows(events, max_seq_len).join(chosen, ["session", "pos"], "left_semi")
    rows = pairs.orderBy("session", "pos").select("aid", "target_type_id", "sample_weight", "history", "history_types").toPandas()
    known = vocab.orderBy("item_id").select("aid").toPandas()["aid"].to_numpy(np.int64)
    ids = {int(a): i + 1 for i, a in enumerate(known)}
    rng = np.random.default_rng(seed)
    items = rng.normal(0, 1, (len(known) + 1, embedding_dim)) * 0.1
    types = rng.normal(0, 1, (len(TYPES) + 1, embedding_dim)) * 0.1
    items[0] = types[0] = 0
    tables = [items, types]
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in tables]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch_size):
            part = rows.iloc[order[at : at + batch_size]]
            width = max(map(len, part["history"]))
            h, ht, w = (np.zeros((len(part), width), t) for t in (np.int64, np.int64, np.float64))
            for i, (x, y) in enumerate(zip(part["history"], part["history_types"])):
                n = len(x)
                h[i, width - n :] = [ids[int(a)] for a in x]
                ht[i, width - n :] = y
                w[i, width - n :] = np.arange(1, n + 1) / (n * (n + 1) / 2)
            batch = h, ht, w, np.array([ids[int(a)] for a in part["aid"]]), part["target_type_id"].to_numpy(np.int64), part["sample_weight"].to_numpy(np.float64)
            _, *grads = loss_and_gradients(*tables, batch)
            step += 1
            for x, g, (m, v) in zip(tables, grads, state):
                m += (g - m) * 0.1
                v += (g * g - v) * 0.001
                x -= lr * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + weight_decay * x)
    return TwoTower(items, types, known)


def vocabulary_size(events: DataFrame) -> int:
    return events.select(F.count_distinct("aid")).first()[0]
