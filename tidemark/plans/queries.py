"""Queries over the driver's tables, one for each operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.items import item_tokens, join_items, normalize_items, parse_items
from tidemark.models import ranker, two_tower
from tidemark.operators import candidates, covis, evaluate, features, fusion, popular, ranking, sampling, split, targets, vector_search
from tidemark.schema import TYPES, type_id
from tidemark.session import shared_dir
from tidemark.sources import adapters, io

K, POOL_K, LIMIT, NEIGHBORS, RATIO = 20, 50, 30, 50, 0.8


@dataclass
class Workload:
    """Adapter A's events, split, and what follows from them. Details are made once for each ``k``, so that a plan that
    has them twice reuses their exchanges, and a search gathers its items once."""

    spark: SparkSession
    sf_dir: str

    def __post_init__(self):
        self._made: dict[tuple[str, int], DataFrame] = {}
        self.events = adapters.dense_events(self.spark, self.sf_dir)
        self.split = split.split_sessions(self.events, RATIO)
        self.history = split.history(self.split)
        self.labels = split.label_rows(self.split)
        self.targets = targets.from_labels(self.labels)

    def edges(self, top_k: int = NEIGHBORS) -> DataFrame:
        return covis.covis_topk(self.history, LIMIT, top_k)

    def items(self) -> DataFrame:
        return adapters.item_vectors(self.spark, self.sf_dir).join(self.history.select("aid").distinct(), "aid", "left_semi")

    def types(self) -> DataFrame:
        v = adapters.item_vectors(self.spark, self.sf_dir).where(F.col("aid").between(1, 3))
        return v.select(F.element_at(F.array(*map(F.lit, TYPES)), F.col("aid").cast("int")).alias("type"), "vec")

    def session_vectors(self) -> DataFrame:
        return vector_search.session_vectors(self.history, self.targets, self.items(), self.types())

    def _once(self, name: str, k: int, make: Callable[[], DataFrame]) -> DataFrame:
        return self._made.get((name, k)) or self._made.setdefault((name, k), make())

    def dssm_details(self, k: int) -> DataFrame:
        return self._once("dssm", k, lambda: vector_search.search(self.session_vectors(), self.items(), k))

    def covis_details(self, k: int) -> DataFrame:
        return self._once("covis", k, lambda: covis.covis_details(self.history, self.edges(), self.targets, k))

    def sources(self, k: int) -> dict[str, DataFrame]:
        pop = candidates.ranked_items(popular.popular_recall(self.history, self.targets, k))
        return {"popular": pop, "covis": self.covis_details(k), "dssm": self.dssm_details(k)}

    def pool(self) -> DataFrame:
        return candidates.candidate_pool(self.sources(POOL_K), POOL_K)

    def ranker_data(self) -> DataFrame:
        """The training table, written once to the shared folder: models read it many times."""
        path = f"{shared_dir(self.spark)}/ranker-data-{uuid.uuid4().hex}"
        io.write_table(features.train_data(self.pool(), self.history, self.labels, unique=True), path)
        return self.spark.read.parquet(path)

    def popular(self, k: int = K) -> DataFrame:
        return popular.popular_recall(self.history, self.targets, k)


Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Callable[[Workload], DataFrame]) -> Callable[[Workload], DataFrame]:
    _QUERIES[f.__name__] = lambda spark, sf_dir: f(Workload(spark, sf_dir))
    return f


def _r(column: str):
    return F.round(column, 6).alias(column)


@query
def explode_events(w: Workload) -> DataFrame:
    nested = w.events.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("ts", "seq", "aid", "type"))).alias("x"))
    nested = nested.select("session", F.transform("x", lambda e: F.struct(e["aid"].alias("aid"), F.unix_micros(e["ts"].cast("timestamp")).alias("ts"), e["type"].alias("type"))).alias("events"))
    return io.explode_sessions(nested).select("session", "aid", "ts", "seq", "type")


@query
def split_history(w: Workload) -> DataFrame:
    return w.history.select("session", "aid", "seq", "type")


@query
def split_labels(w: Workload) -> DataFrame:
    return w.labels


@query
def label_counts(w: Workload) -> DataFrame:
    return evaluate.label_counts(w.labels).select("type", "rows", "items", _r("mean_items"))


@query
def vocabulary_counts(w: Workload) -> DataFrame:
    return vector_search.vocabulary_counts(adapters.sparse_events(w.spark, w.sf_dir), adapters.item_vectors(w.spark, w.sf_dir))


@query
def matched_scores(w: Workload) -> DataFrame:
    return candidates.matched_scores(w.pool(), w.covis_details(K))


@query
def session_holdout(w: Workload) -> DataFrame:
    return sampling.holdout_sessions(w.events)


@query
def split_summary(w: Workload) -> DataFrame:
    skipped = split.skipped_sessions(w.events)
    kept = w.split.agg(F.count_distinct("session").alias("sessions"), F.count_if(~F.col("future")).alias("history_events"), F.count_if("future").alias("future_events"))
    return kept.withColumn("k", F.lit(1)).join(skipped.withColumn("k", F.lit(1)), "k").drop("k")


@query
def target_rows(w: Workload) -> DataFrame:
    return targets.from_events(w.events)


@query
def session_item_lists(w: Workload) -> DataFrame:
    return split.session_items(w.events).select("session", join_items(F.col("items")).alias("items"))


@query
def popular_topk(w: Workload) -> DataFrame:
    return popular.top_by_type(w.history, K).select("type", "aid", "cnt", F.col("rk").cast("bigint").alias("rk"))


@query
def popular_recall(w: Workload) -> DataFrame:
    return w.popular()


@query
def covis_pairs(w: Workload) -> DataFrame:
    return covis.pair_counts(w.history, LIMIT)


@query
def covis_topk(w: Workload) -> DataFrame:
    return w.edges(20).select("aid", "neighbor", "cnt", F.col("rk").cast("bigint").alias("rk"))


@query
def covis_topk_sparse(w: Workload) -> DataFrame:
    e = adapters.sparse_events(w.spark, w.sf_dir)
    return covis.covis_topk(e, LIMIT, 20).select("aid", "neighbor", "cnt", F.col("rk").cast("bigint").alias("rk"))


@query
def covis_recall(w: Workload) -> DataFrame:
    return covis.covis_recall(w.history, w.edges(), w.targets, K)


@query
def covis_details(w: Workload) -> DataFrame:
    return w.covis_details(K).select("session", "type", "aid", F.col("rank").cast("bigint").alias("rank"), "covis_score")


@query
def session_vectors(w: Workload) -> DataFrame:
    v = w.session_vectors().select("session", "type", F.posexplode("vec").alias("d", "x"))
    return v.select("session", "type", (F.col("d") + 1).cast("bigint").alias("d"), F.round("x", 6).alias("x"))


@query
def vector_topk(w: Workload) -> DataFrame:
    return w.dssm_details(K).select("session", "type", "aid", F.col("rank").cast("bigint").alias("rank"), "dssm_score")


@query
def item_similarity(w: Workload) -> DataFrame:
    """The 20 nearest others, among all items, of every item whose id is divisible by 20: a stated set of queries."""
    items = adapters.item_vectors(w.spark, w.sf_dir)
    n = vector_search.neighbors(items, K, queries=items.where("aid % 20 = 0"))
    return n.select("aid", "neighbor", F.col("rank").cast("bigint").alias("rank"), "cosine")


@query
def item_neighbors(w: Workload) -> DataFrame:
    """Every item's nearest others, over the whole table."""
    n = vector_search.neighbors(adapters.item_vectors(w.spark, w.sf_dir), K)
    return n.select("aid", "neighbor", F.col("rank").cast("bigint").alias("rank"), "cosine")


@query
def fusion_rrf(w: Workload) -> DataFrame:
    return fusion.fuse(w.targets, w.sources(POOL_K), k=K).select("session", "type", "predictions", F.col("n_before").cast("bigint").alias("n_before"))


@query
def fusion_grid(w: Workload) -> DataFrame:
    g = fusion.grid_search(w.targets, w.labels, w.sources(POOL_K), k=K)
    return g.select("popular_weight", "covis_weight", "dssm_weight", *(_r(f"{t}_recall") for t in TYPES), _r("weighted_score"), "underfilled_before_fallback", "underfilled_after_fallback")


def _pool_columns(df: DataFrame) -> DataFrame:
    keys = ("session", "type", "aid")
    return df.select(*keys, *(F.round(F.col(c).cast("double"), 6).alias(c) for c in df.columns if c not in keys))


@query
def candidate_pool(w: Workload) -> DataFrame:
    return _pool_columns(w.pool())


@query
def candidate_raw_norm(w: Workload) -> DataFrame:
    pool = candidates.with_raw_norms(w.pool(), {"covis": w.covis_details(POOL_K), "dssm": w.dssm_details(POOL_K)})
    return _pool_columns(pool.select("session", "type", "aid", "covis_raw_score_norm", "dssm_raw_score_norm"))


@query
def candidate_summary(w: Workload) -> DataFrame:
    s = candidates.pool_summary(w.pool(), w.labels)
    return s.select(*(F.col(c).cast("bigint").alias(c) for c in ("candidates", "groups", "repeated", "label_groups")), _r("mean_candidates"))


@query
def labels_attached(w: Workload) -> DataFrame:
    return features.add_labels(w.pool(), w.labels).select("session", "type", "aid", F.col("label").cast("bigint").alias("label"))


@query
def item_stats(w: Workload) -> DataFrame:
    return features.item_stats(w.history)


@query
def session_stats(w: Workload) -> DataFrame:
    return features.session_stats(w.history)


@query
def history_features(w: Workload) -> DataFrame:
    return features.history_stats(w.history).withColumn("aid_last_type_id", F.col("aid_last_type_id").cast("bigint"))


@query
def ranker_features(w: Workload) -> DataFrame:
    return _pool_columns(features.narrow(features.train_data(w.pool(), w.history, w.labels, unique=True)))


@query
def inference_features(w: Workload) -> DataFrame:
    return _pool_columns(features.inference_data(w.pool(), w.history, unique=True).select("session", "type", "aid", "item_popularity", "session_len", "in_session_history", "aid_last_pos_from_end"))


@query
def topk_per_group(w: Workload) -> DataFrame:
    return ranking.top_by_score(w.pool().withColumn("score", F.round("rrf_score", 6)), k=K).select("session", "type", "aid", F.col("rank").cast("bigint").alias("rank"))


@query
def lists_from_scores(w: Workload) -> DataFrame:
    return ranking.lists_from_scores(w.pool().withColumn("score", F.round("rrf_score", 6)), w.targets, k=K)


@query
def eval_by_type(w: Workload) -> DataFrame:
    t = evaluate.by_type(evaluate.per_row(w.labels, covis.covis_recall(w.history, w.edges(), w.targets, K), K))
    return t.select("type", "rows", "hits", "denominator", _r("recall"), "weight", _r("contribution"))


@query
def eval_overall(w: Workload) -> DataFrame:
    o = evaluate.overall(evaluate.per_row(w.labels, w.popular(), K))
    return o.select("rows", "hits", "denominator", _r("recall"), _r("weighted_score"))


@query
def oracle_recall(w: Workload) -> DataFrame:
    o = evaluate.oracle(w.pool(), w.labels, K)
    return o.select("type", "rows", "hits", "denominator", "covered", _r("recall"), _r("contribution"))


@query
def submission(w: Workload) -> DataFrame:
    return evaluate.submission(w.popular(), K)


@query
def list_counters(w: Workload) -> DataFrame:
    return evaluate.list_counters(covis.covis_recall(w.history, w.edges(), w.targets, K), K)


@query
def parse_item_lists(w: Workload) -> DataFrame:
    d = w.spark.read.parquet(f"{w.sf_dir}/events.parquet").select("event_id", F.concat_ws(" ", F.col("user_id").cast("string"), F.lit("x1 01 1 -3"), F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.lit("1.0")).alias("s"))
    return d.select("event_id", join_items(parse_items(F.col("s"))).alias("ids"), F.array_join(item_tokens(F.col("s"), False), " ").alias("tokens"), normalize_items(F.col("s"), 3).alias("first_three"))


@query
def vocabulary(w: Workload) -> DataFrame:
    return sampling.vocabulary(w.history)


@query
def pair_windows(w: Workload) -> DataFrame:
    p = sampling.pair_windows(w.history, 50)
    return p.select("session", "pos", "aid", F.col("target_type_id").cast("bigint").alias("target_type_id"), "sample_weight", join_items(F.col("history")).alias("history"), join_items(F.col("history_types")).alias("history_types"))


@query
def pair_stats(w: Workload) -> DataFrame:
    return sampling.pair_stats(sampling.pair_windows(w.history, 50)).withColumn("target_type_id", F.col("target_type_id").cast("bigint"))


@query
def sample_pairs(w: Workload) -> DataFrame:
    return sampling.sample_pairs(w.history, 1000)


@query
def session_split_md5(w: Workload) -> DataFrame:
    return sampling.split_by_session(w.events).withColumn("holdout", F.col("holdout").cast("bigint"))


@query
def recency_weights(w: Workload) -> DataFrame:
    r = covis.recency(w.history)
    return r.select("session", "seq", F.col("rpos").cast("bigint").alias("rpos"), type_id().cast("bigint").alias("type_id"), F.round(F.lit(1.0) / F.col("rpos"), 6).alias("weight"))


@query
def ranker_predict(w: Workload) -> DataFrame:
    """Pointwise ranker, trained on four fifths of the sessions, applied to all; lists for every target row."""
    data = w.ranker_data()
    train, _ = ranker.holdout(data)
    model = ranker.fit_gbt(train, rounds=5, depth=4)
    return ranker.predict_lists(ranker.score_gbt(model, data), w.targets, K)


@query
def lambdamart_predict(w: Workload) -> DataFrame:
    """LambdaMART on the same data."""
    data = w.ranker_data()
    train, valid = ranker.holdout(data)
    model = ranker.fit_lambdamart(train, valid=valid, rounds=4, depth=4)
    return ranker.predict_lists(model.score(data), w.targets, K)


@query
def two_tower_recall(w: Workload) -> DataFrame:
    """A two-tower model trained on a bounded sample of pairs, and its lists."""
    model = two_tower.train(w.history, embedding_dim=32, epochs=2, max_pairs=20_000)
    return vector_search.item_list(model.recall(w.history, w.targets, K), w.targets)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
