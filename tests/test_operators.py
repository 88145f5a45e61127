"""Operators on small literal tables."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.items import fill_to_k, normalize_items, parse_items
from tidemark.models import ranker, two_tower
from tidemark.operators import candidates, covis, evaluate, features, fusion, popular, sampling, split, targets, vector_search
from tidemark.plans import queries, workflows
from tidemark.schema import require_columns
from tidemark.streaming import upkeep

EVENT = "session long, aid long, ts long, seq long, type string"


def events(spark, sessions):
    rows = [(s, a, i, i, t) for s, xs in sessions.items() for i, (a, t) in enumerate(xs)]
    return spark.createDataFrame(rows, EVENT)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def lists(spark, data):
    return spark.createDataFrame(data, "session long, type string, predictions string")


def test_items(spark):
    df = spark.createDataFrame([("12 a -3 1.0 12 01",), (None,), ("",), ("  5\t6 ",)], "s string")
    got = df.select(parse_items(F.col("s")), normalize_items(F.col("s"), 2), parse_items(F.col("s"), dedup=False)).collect()
    assert [tuple(r) for r in got] == [([12, 1], "12 01", [12, 12, 1]), ([], "", []), ([], "", []), ([5, 6], "5 6", [5, 6])]
    x = spark.range(1).select(fill_to_k(F.array(F.lit(9)), F.array(*map(F.lit, (1, 9, 2, 3))), 3)).first()[0]
    assert x == [9, 1, 2]
    with pytest.raises(ValueError):
        require_columns(df, ["t"], "x")


def test_split(spark):
    e = events(spark, {1: [(5, "clicks"), (6, "carts")], 2: [(1, "clicks")], 3: [(1, "clicks")] * 2 + [(7, "clicks"), (3, "clicks"), (7, "clicks")]})
    history, labels, skipped = split.build_validation(e, 0.5)
    assert rows(history, "session", "aid") == [(1, 5), (3, 1), (3, 1)]
    assert rows(labels) == [(1, "carts", "6"), (3, "clicks", "7 3")]
    assert skipped.first()[0] == 1
    for bad in (0, 1, -0.1):
        with pytest.raises(ValueError):
            split.split_sessions(e, bad)
    with pytest.raises(ValueError):
        targets.target_rows()
    assert targets.target_rows(events=e).count() == 9


def test_covis_against_a_pair_loop(spark):
    rng = random.Random(1)
    data = {s: [(rng.randrange(8), "clicks") for _ in range(rng.randrange(1, 12))] for s in range(30)}
    want = Counter()
    for xs in data.values():
        xs = [a for a, _ in xs][-5:]
        for i in range(len(xs)):
            for j in range(len(xs)):
                if xs[i] != xs[j]:
                    want[xs[i], xs[j]] += 1
    got = {(a, b): c for a, b, c in rows(covis.pair_counts(events(spark, data), 5), "aid", "neighbor", "cnt")}
    assert got == dict(want)
    assert all(got[b, a] == c for (a, b), c in got.items())


def test_covis_scores(spark):
    e = events(spark, {1: [(1, "clicks"), (2, "clicks")]})
    edges = spark.createDataFrame([(2, 3, 4, 1), (1, 3, 2, 1)], "aid long, neighbor long, cnt long, rk int")
    assert rows(covis.covis_scores(e, edges)) == [(1, 3, 1, 5.0)]
    t = targets.from_events(e)
    assert len({r[2] for r in rows(covis.covis_recall(e, edges, t))}) == 1


def test_popular_fill(spark):
    e = events(spark, {1: [(1, "clicks"), (1, "clicks"), (2, "clicks"), (9, "carts")]})
    got = dict(popular.popular_lists(e, 3).select("type", "items").collect())
    assert got["carts"] == [9, 1, 2] and got["orders"] == [1, 2, 9]


def test_fusion_and_fallback(spark):
    t = spark.createDataFrame([(1, "clicks"), (2, "carts")], "session long, type string")
    p = candidates.ranked_items(lists(spark, [(1, "clicks", "7 8")]))
    c = candidates.ranked_items(lists(spark, [(1, "clicks", "8 9")]))
    d = candidates.ranked_items(lists(spark, [(1, "clicks", "")]))
    sources = {"popular": p, "covis": c, "dssm": d}
    out = {r["session"]: r for r in fusion.fuse(t, sources, k=3).collect()}
    assert out[1]["predictions"] == "8 9 7" and out[2]["predictions"] == "7 8" and out[2]["n_before"] == 0
    labels = spark.createDataFrame([(1, "clicks", "9"), (2, "carts", "7")], "session long, type string, labels string")
    g = fusion.grid_search(t, labels, sources, {"popular": (0.1,), "covis": (0.0, 1.0), "dssm": (1.0,)}, k=2).collect()
    assert len(g) == 2 and g[0]["weighted_score"] >= g[1]["weighted_score"]
    with pytest.raises(ValueError):
        fusion.grid_search(t, None, sources)


def test_pool_and_norms(spark):
    p = candidates.ranked_items(lists(spark, [(1, "clicks", "4 5")]))
    c = candidates.ranked_items(lists(spark, [(1, "clicks", "1 2 3 5")]))
    d = candidates.ranked_items(lists(spark, [(1, "clicks", "6 6 6")]))
    pool = candidates.candidate_pool({"popular": p, "covis": c, "dssm": d})
    r = pool.where("aid = 5").first()
    assert (r["source_count"], r["min_rank"], r["rrf_score"], r["dssm_rank"]) == (2, 2, 0.75, 0)
    details = spark.createDataFrame([(1, "clicks", 1, 2.0), (1, "clicks", 77, 2.0)], "session long, type string, aid long, score double")
    n = candidates.with_raw_norms(pool, {"covis": details})
    assert {r["aid"]: r["covis_raw_score_norm"] for r in n.collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0}
    assert "dssm_raw_score_norm" in n.columns and candidates.with_raw_norms(pool, {}) is pool


def test_evaluate(spark):
    labels = spark.createDataFrame([(1, "clicks", "2"), (2, "carts", " ".join(map(str, range(25))))], "session long, type string, labels string")
    p = lists(spark, [(1, "clicks", "1 1 2")])
    assert rows(evaluate.per_row(labels, p, 2), "session", "hits", "denominator") == [(1, 0, 1), (2, 0, 2)]
    assert rows(evaluate.per_row(labels, p, 2, dedup=True), "session", "hits") == [(1, 1), (2, 0)]
    assert {r["type"]: (r["denominator"], r["recall"]) for r in evaluate.by_type(evaluate.per_row(labels, p)).collect()} == {"clicks": (1, 1.0), "carts": (20, 0.0), "orders": (0, 0.0)}
    assert rows(evaluate.submission(p, 1)) == [("1_clicks", "1")]


def test_features(spark):
    e = events(spark, {1: [(1, "clicks"), (2, "carts"), (1, "orders"), (3, "odd")]})
    labels = spark.createDataFrame([(1, "clicks", "9 1 9"), (1, "odd", "1")], "session long, type string, labels string")
    pool = candidates.candidate_pool({"popular": candidates.ranked_items(lists(spark, [(1, "clicks", "1 9 8")]))})
    got = {r["aid"]: r for r in features.train_data(pool, e, labels).collect()}
    assert (got[1]["label"], got[1]["session_aid_count"], got[1]["aid_last_pos_from_end"], got[1]["aid_last_type_id"], got[1]["in_session_history"]) == (1, 2, 1, 3, 1)
    assert (got[8]["label"], got[8]["session_aid_count"], got[8]["aid_last_pos_from_end"], got[8]["aid_last_type_id"], got[8]["item_popularity"]) == (0, 0, -1, 0, 0)
    assert got[9]["session_len"] == 4
    with pytest.raises(ValueError):
        features.check_unique(pool.unionByName(pool))
    assert "label" not in features.inference_data(features.add_labels(pool, labels), e).columns
    assert features.narrow(features.add_labels(pool, labels)).schema["label"].dataType.simpleString() == "tinyint"


def test_neighbors_of_all_items(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(60, 4)), 1)
    v[10:16] = v[3]  # more copies than neighbours asked for
    data = [(i, x.tolist()) for i, x in enumerate(v)]
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    want = []
    for i in range(60):
        best = sorted((-round(float(unit[i] @ unit[j]), 6), j) for j in range(60) if j != i)[:4]
        want += [(i, j, r + 1, -s) for r, (s, j) in enumerate(best)]
    items = spark.createDataFrame([*data, (99, None)], "aid long, vec array<double>")
    for most in (10**6, 10):
        monkeypatch.setattr(vector_search, "BROADCAST_NUMBERS", most)
        got = rows(vector_search.neighbors(items, 4))
        want.sort()
        assert [r[:3] for r in got] == [r[:3] for r in want]
        assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=2e-6)
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = queries.queries()["item_neighbors"](spark, str(tmp_path))
    assert {r["aid"] for r in got.collect()} == set(range(60)) and got.count() == 60 * 20


def test_vector_search_paths_agree(spark, monkeypatch):
    rng = np.random.default_rng(0)
    items = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(60)], "aid long, vec array<double>")
    q = spark.createDataFrame([(s, "clicks", rng.normal(size=8).tolist()) for s in range(20)], "session long, type string, vec array<double>")
    one = rows(vector_search.search(q, items, 5))
    monkeypatch.setattr(vector_search, "BROADCAST_NUMBERS", 10)
    assert rows(vector_search.search(q, items, 5, block=16)) == one and len(one) == 100


def test_sampling(spark):
    e = events(spark, {s: [(a, "clicks") for a in range(5)] for s in range(40)})
    p = sampling.pair_windows(e, 2).where("session = 0")
    assert rows(p, "pos", "history") == [(1, [0]), (2, [0, 1]), (3, [1, 2]), (4, [2, 3])]
    assert sampling.sample_pairs(e, 7).count() == 7 and sampling.sample_pairs(e, 0).count() == 160
    assert rows(sampling.sample_pairs(e.repartition(7), 7)) == rows(sampling.sample_pairs(e, 7))
    assert rows(sampling.vocabulary(e)) == [(i, i + 1) for i in range(5)]
    assert 0 < sampling.split_by_session(e, 0.5).where("holdout = 1").count() < 40


def test_two_tower_gradients():
    rng = np.random.default_rng(3)
    items, types = rng.normal(size=(6, 4)), rng.normal(size=(4, 4))
    items[0] = types[0] = 0
    h = np.array([[0, 1], [2, 3], [4, 5]])
    batch = h, np.array([[0, 1], [2, 3], [1, 2]]), np.array([[0, 1.0], [1 / 3, 2 / 3], [1 / 3, 2 / 3]]), np.array([2, 4, 5]), np.array([1, 2, 3]), np.array([1.0, 3.0, 6.0])
    _, gi, gt = two_tower.loss_and_gradients(items, types, batch)
    for table, g in ((items, gi), (types, gt)):
        for i, j in ((1, 0), (2, 3), (3, 1)):
            old, eps = table[i, j], 1e-6
            table[i, j] = old + eps
            up = two_tower.loss_and_gradients(items, types, batch)[0]
            table[i, j] = old - eps
            down = two_tower.loss_and_gradients(items, types, batch)[0]
            table[i, j] = old
            assert abs((up - down) / (2 * eps) - g[i, j]) < 1e-5


def test_lambdamart_learns(spark):
    rng = random.Random(5)
    data = []
    for s in range(60):
        for a in range(8):
            x = rng.random()
            data.append((s, "clicks", a, x, rng.random(), int(x > 0.8)))
    df = spark.createDataFrame(data, "session long, type string, aid long, good double, noise double, label int")
    model = ranker.fit_lambdamart(df, ["good", "noise"], rounds=2, min_rows=5, depth=3)
    scored = model.score(df)
    assert ranker.ndcg(scored) > 0.95 > ranker.ndcg(df.withColumn("score", F.col("noise")))
    with pytest.raises(ValueError):
        model.score(df.drop("good"))


def test_lambdamart_trees(spark, tmp_path):
    rng = random.Random(7)
    data = []
    for s in range(80):
        for a in range(8):
            x, y = rng.random(), rng.random()
            data.append((s, "clicks", a, x, y, rng.random(), int((x > 0.6) != (y > 0.6))))
    df = spark.createDataFrame(data, "session long, type string, aid long, x double, y double, noise double, label int")
    model = ranker.fit_lambdamart(df, ["x", "y", "noise"], valid=df, rounds=3, patience=2, rate=0.3, depth=4, leaves=6, min_rows=5, feature_share=1.0, row_share=0.8, folder=str(tmp_path))
    assert all(sum(f < 0 for f in t.feature) <= 6 for t in model.trees) and ranker.ndcg(model.score(df)) > 0.8
    gains = {r["feature"]: r["importance"] for r in model.importance(spark).collect()}
    assert gains["x"] > gains["noise"] and gains["y"] > gains["noise"]
    model.save(spark, str(tmp_path / "m"))
    again = ranker.LambdaMart.load(spark, str(tmp_path / "m"))
    assert rows(again.score(df)) == rows(model.score(df))
    one = ranker.fit_lambdamart(df, ["x", "y", "noise"], rounds=1, depth=1, min_rows=5, feature_share=0.4, folder=str(tmp_path))
    assert len(one.trees[0].feature) <= 3 and ranker.fit_lambdamart(df, ["noise"], rounds=1, min_rows=10**6, folder=str(tmp_path)).trees[0].feature == [-1]


def test_best_split_is_the_best():
    from tidemark.models.lambdamart import _best_split

    rng = np.random.default_rng(1)
    g, h, n = rng.normal(size=9), rng.random(9) + 0.1, rng.integers(1, 9, 9).astype(float)
    gain, f, b, values = _best_split({3: np.array([g, h, n])}, 4)
    plain = max((g[:i].sum() ** 2 / h[:i].sum() + g[i:].sum() ** 2 / h[i:].sum() - g.sum() ** 2 / h.sum(), i - 1) for i in range(1, 9) if n[:i].sum() >= 4 and n[i:].sum() >= 4)
    assert f == 3 and b == plain[1] and abs(gain - plain[0]) < 1e-6 and abs(values[0] - g[: b + 1].sum() / h[: b + 1].sum()) < 1e-6


def test_holdout_is_exact(spark):
    e = events(spark, {s: [(1, "clicks")] * 3 for s in range(101)})
    out = rows(sampling.holdout_sessions(e, 0.2))
    assert len(out) == len(set(out)) == 20 and out == rows(sampling.holdout_sessions(e.repartition(9), 0.2))
    import hashlib

    assert out == sorted(sorted(((s,) for s in range(101)), key=lambda s: hashlib.md5(f"{s[0]}:2024".encode()).hexdigest())[:20])
    assert sampling.holdout_sessions(events(spark, {5: [(1, "clicks")]}), 0.2).count() == 1
    data = e.withColumns({"label": F.lit(1)})
    fit, held = ranker.holdout(data, 0.5)
    assert held.select("session").distinct().count() == 50 and fit.count() + held.count() == data.count()


def test_vocabulary_over_buckets(spark):
    rng = random.Random(9)
    e = events(spark, {s: [(rng.randrange(300), "clicks") for _ in range(5)] for s in range(100)})
    first, want = {}, {}
    for r in sorted(e.collect(), key=lambda r: (r["session"], r["ts"], r["seq"])):
        first.setdefault(r["aid"], len(first) + 1)
    want = sorted(first.items())
    assert rows(sampling.vocabulary(e)) == want == rows(sampling.vocabulary(e, 3))
    assert sampling.vocabulary(e.limit(0)).count() == 0


def test_counts_and_reports(spark):
    labels = spark.createDataFrame([(1, "clicks", "2 3"), (2, "clicks", "5"), (2, "carts", "")], "session long, type string, labels string")
    counts = evaluate.label_counts(labels)
    assert rows(counts) == [("carts", 1, 0, 0.0), ("clicks", 2, 3, 1.5), ("orders", 0, 0, 0.0)]
    text = evaluate.as_table(counts.orderBy("type"), 2).split("\n")
    assert text[0].split() == ["type", "rows", "items", "mean_items"] and text[3].split() == ["clicks", "2", "3", "1.50"]
    e = events(spark, {1: [(1, "clicks"), (2, "clicks"), (2, "carts")]})
    items = spark.createDataFrame([(2, [1.0]), (2, [1.0]), (9, [1.0])], "aid long, vec array<double>")
    assert rows(vector_search.vocabulary_counts(e, items)) == [(3, 2, 1)]
    pool = spark.createDataFrame([(1, "clicks", 1), (1, "clicks", 2)], "session long, type string, aid long")
    assert rows(candidates.matched_scores(pool, pool.where("aid = 2").union(pool.where("aid = 2")))) == [(2, 1)]


def test_read_sessions(spark, tmp_path):
    from tidemark.sources import io

    (tmp_path / "s.jsonl").write_text("".join(json.dumps({"session": s, "events": [{"aid": s, "ts": 1, "type": "clicks"}]}) + "\n" for s in (5, 3, 9, 1)))
    read = lambda n: [r[0] for r in rows(io.read_sessions(spark, str(tmp_path / "s.jsonl"), n), "session")]
    assert read(None) == read(0) == [1, 3, 5, 9] and read(2) == [1, 3]
    with pytest.raises(ValueError):
        read(-1)


def test_command_line(spark, tmp_path, capsys):
    from tidemark.sources import config

    assert config.parse_floats("0.1, 2,") == (0.1, 2.0) and config.parse_weights("a=1, b=0.5") == {"a": 1.0, "b": 0.5} and config.parse_grid("a=1,2;b=3") == {"a": (1.0, 2.0), "b": (3.0,)}
    out = tmp_path / "out"
    (tmp_path / "s.jsonl").write_text("".join(json.dumps({"session": s, "events": [{"aid": (s * i) % 7, "ts": i, "type": "clicks"} for i in range(6)]}) + "\n" for s in range(30)))
    workflows.main(["build-validation", "--out", str(out), "--input", str(tmp_path / "s.jsonl"), "--nrows", "10", "--history-ratio", "0.5"])
    history = spark.read.parquet(f"{out}/events.parquet")
    assert history.count() == 30 and history.select("session").distinct().count() == 10
    (tmp_path / "c.json").write_text(json.dumps({"popular-recall": {"k": 2}, "type_weights": {"clicks": 1.0, "carts": 0.0, "orders": 0.0}}))
    workflows.main(["popular-recall", "--out", str(out), "--config", str(tmp_path / "c.json")])
    assert all(len(r["predictions"].split()) == 2 for r in spark.read.option("header", True).csv(f"{out}/popular_predictions.csv").collect())
    workflows.main(["popular-recall", "--out", str(out), "--config", str(tmp_path / "c.json"), "--k", "3"])
    assert all(len(r["predictions"].split()) == 3 for r in spark.read.option("header", True).csv(f"{out}/popular_predictions.csv").collect())
    workflows.main(["evaluate", "--out", str(out), "--config", str(tmp_path / "c.json"), "--source", "popular"])
    assert "contribution" in capsys.readouterr().out
    workflows.main(["--list"])
    assert "--history-ratio" in capsys.readouterr().out
    for bad in (["popular-recall", "--leaves", "3"], ["evaluate", "--workflow", "all"]):
        with pytest.raises(SystemExit):
            workflows.main([*bad, "--out", str(out)])


def test_order_by_targets(spark):
    t = spark.createDataFrame([(1, "clicks"), (2, "carts")], "session long, type string")
    assert rows(targets.order_by_targets(lists(spark, [(1, "clicks", "3 x 3 4")]), t, 5)) == [(1, "clicks", "3 4"), (2, "carts", "")]
    twice = lists(spark, [(1, "clicks", "9"), (1, "clicks", "1 2")]).coalesce(1)
    assert rows(targets.order_by_targets(twice, t, 5))[0] == (1, "clicks", "9")


def test_workflow_from_files(spark, tmp_path):
    rng = random.Random(2)
    kinds = ["clicks"] * 6 + ["carts", "orders"]
    src = tmp_path / "train.jsonl"
    src.write_text("".join(json.dumps({"session": s, "events": [{"aid": rng.randrange(12), "ts": i, "type": rng.choice(kinds)} for i in range(rng.randrange(1, 15))]}) + "\n" for s in range(60)))
    settings = {"train_dssm": {"embedding_dim": 8, "epochs": 1}, "train_ranker": {"rounds": 2}}
    out = workflows.run_workflow(spark, "all", str(tmp_path / "out"), str(src), **settings)
    assert {r["type"] for r in out.collect()} == {"clicks", "carts", "orders"}
    workflows.run_workflow(spark, "test", str(tmp_path / "out"), str(src))
    sub = spark.read.option("header", True).csv(str(tmp_path / "out" / "test_submission.csv"))
    assert sub.count() == 180 and sub.columns == ["session_type", "labels"]
    with pytest.raises(ValueError):
        workflows.run_workflow(spark, "none", str(tmp_path))


def test_stream(spark, tmp_path):
    e = spark.createDataFrame([(1, 7, "2024-01-01 00:10:00", "clicks"), (1, 7, "2024-01-01 00:20:00", "clicks"), (2, 8, "2024-01-01 05:00:00", "carts")], "session long, aid long, ts string, type string")
    e.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session long, aid long, ts timestamp, type string").parquet(str(tmp_path / "in"))
    upkeep.start(upkeep.windowed_popularity(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = rows(upkeep.popularity(spark.read.parquet(str(tmp_path / "out"))))
    assert ("clicks", 7, 2) in got


def test_determinism_under_repartition(spark):
    rng = random.Random(4)
    e = events(spark, {s: [(rng.randrange(6), "clicks") for _ in range(6)] for s in range(20)})
    assert rows(covis.covis_topk(e.repartition(5), 30, 3)) == rows(covis.covis_topk(e, 30, 3))
