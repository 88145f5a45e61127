"""Tasks and workflows over files: thin compositions of the operators, with paths as arguments."""

from __future__ import annotations

import argparse
import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.models import ranker
from tidemark.models.two_tower import TwoTower, train
from tidemark.operators import candidates, covis, evaluate, features, fusion, popular, split, targets, vector_search
from tidemark.sources import io
from tidemark.sources.config import parse_grid, parse_weights, read_settings


@dataclass
class Paths:
    """Files of a run, below ``out``; ``test`` names the files of the unlabelled run apart."""

    spark: SparkSession
    out: str
    test: bool = False

    def at(self, name: str) -> str:
        return f"{self.out.rstrip('/')}/{'test_' if self.test else ''}{name}"

    def shared(self, name: str) -> str:
        return f"{self.out.rstrip('/')}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.at(name))

    def events(self) -> DataFrame:
        return self.read("events.parquet")

    def targets(self) -> DataFrame:
        return targets.target_rows(events=self.events()) if self.test else targets.target_rows(labels=self.read("labels.parquet"))

    def lists(self, source: str) -> DataFrame:
        return io.read_predictions(self.spark, self.at(f"{source}_predictions.csv"))


def build_validation(p: Paths, train_file: str, nrows: int | None = None, history_ratio: float = 0.8) -> None:
    history, labels, _ = split.build_validation(io.read_sessions(p.spark, train_file, nrows), history_ratio)
    io.write_table(history, p.at("events.parquet"))
    io.write_table(labels, p.at("labels.parquet"))


def build_test_events(p: Paths, test_file: str, nrows: int | None = None) -> None:
    io.write_table(io.read_sessions(p.spark, test_file, nrows), p.at("events.parquet"))


def build_covis(p: Paths, session_limit: int = 30, top_k: int = 50) -> None:
    io.write_table(covis.covis_topk(p.events(), session_limit, top_k), p.shared("covis_edges.parquet"))


def popular_recall(p: Paths, k: int = 50) -> None:
    io.write_csv(popular.popular_recall(p.events(), p.targets(), k), p.at("popular_predictions.csv"))


def covis_recall(p: Paths, k: int = 50) -> None:
    edges = p.spark.read.parquet(p.shared("covis_edges.parquet"))
    details = covis.covis_details(p.events(), edges, p.targets(), k)
    io.write_table(details, p.at("covis_details.parquet"))
    io.write_csv(vector_search.item_list(p.read("covis_details.parquet"), p.targets()), p.at("covis_predictions.csv"))


def train_two_tower(
    p: Paths, embedding_dim: int = 128, epochs: int = 20, batch_size: int = 256, lr: float = 1e-3, weight_decay: float = 1e-5, max_pairs: int = 500_000, max_seq_len: int = 50, seed: int = 2024
) -> None:
    train(p.events(), embedding_dim, epochs, batch_size, lr, weight_decay, max_pairs, max_seq_len, seed).save(p.spark, p.shared("two_tower"))


def two_tower_recall(p: Paths, k: int = 50) -> None:
    details = TwoTower.load(p.spark, p.shared("two_tower")).recall(p.events(), p.targets(), k)
    io.write_table(details, p.at("dssm_details.parquet"))
    io.write_csv(vector_search.item_list(p.read("dssm_details.parquet"), p.targets()), p.at("dssm_predictions.csv"))


def _sources(p: Paths) -> dict[str, DataFrame]:
    return {s: candidates.ranked_items(p.lists(s)) for s in ("popular", "covis", "dssm")}


def fuse(p: Paths, k: int = 20, weights: dict[str, float] | None = None) -> None:
    io.write_csv(fusion.fuse(p.targets(), _sources(p), weights, k).drop("n_before"), p.at("fusion_predictions.csv"))


def fusion_grid(p: Paths, k: int = 20, grid: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    found = fusion.grid_search(p.targets(), None if p.test else p.read("labels.parquet"), _sources(p), grid, k)
    io.write_csv(found, p.at("fusion_grid.csv"))
    return p.spark.read.option("header", True).option("inferSchema", True).csv(p.at("fusion_grid.csv")).orderBy(F.desc("weighted_score"))


def build_candidates(p: Paths, k: int = 50, raw_scores: bool = False) -> None:
    pool = candidates.candidate_pool(_sources(p), k)
    if raw_scores:
        pool = candidates.with_raw_norms(pool, {s: p.read(f"{s}_details.parquet") for s in ("covis", "dssm")})
    io.write_table(pool, p.at("candidates.parquet"))


def build_ranker_data(p: Paths) -> None:
    pool = p.read("candidates.parquet")
    data = features.inference_data(pool, p.events()) if p.test else features.train_data(pool, p.events(), p.read("labels.parquet"))
    io.write_table(features.narrow(data), p.at("ranker_data.parquet"))


def train_ranker(
    p: Paths, model: str = "lambdamart", valid_ratio: float = 0.2, seed: int = 2024, rounds: int = 300, patience: int = 30, rate: float = 0.05, leaves: int = 63, depth: int = 8,
    min_rows: int = 50, feature_share: float = 0.85, row_share: float = 0.85, truncation: int | None = None, k: int = 20,
) -> DataFrame:
    """Fits on the training sessions, stopping early by the held-out ones; writes the model, its importances, and the
    held-out sessions, their labels and lists. Gives their recall. ``model``: lambdamart, or gbt, the pointwise one."""
    fit, out = ranker.holdout(p.read("ranker_data.parquet"), valid_ratio, seed)
    if model == "lambdamart":
        made = ranker.fit_lambdamart(fit, None, out, rounds, patience, rate, depth, leaves, min_rows, feature_share, row_share, truncation, k=k, seed=seed)
        made.save(p.spark, p.shared("ranker_model"))
        scored, weights = made.score(out), made.importance(p.spark)
    elif model == "gbt":
        made = ranker.fit_gbt(fit, rounds=rounds, depth=min(depth, 5), seed=seed)
        made.write().overwrite().save(p.shared("ranker_model"))
        scored, weights = ranker.score_gbt(made, out), ranker.importance(made)
    else:
        raise ValueError(f"no such model: {model}")
    io.write_metadata(p.spark, {"model": model}, p.shared("ranker_kind"))
    io.write_csv(weights, p.shared("feature_importance.csv"))
    sessions = out.select("session").distinct()
    io.write_table(sessions, p.shared("holdout_sessions.parquet"))
    labels = p.read("labels.parquet").join(sessions, "session", "left_semi")
    io.write_table(labels, p.shared("holdout_labels.parquet"))
    io.write_csv(ranker.predict_lists(scored, targets.from_labels(labels), k), p.shared("holdout_predictions.csv"))
    return evaluate.by_type(evaluate.per_row(labels, io.read_predictions(p.spark, p.shared("holdout_predictions.csv")), k))


def ranker_predict(p: Paths, k: int = 20) -> None:
    data, path = p.read("ranker_data.parquet"), p.shared("ranker_model")
    if io.read_metadata(p.spark, p.shared("ranker_kind"))["model"] == "gbt":
        scored = ranker.score_gbt(PipelineModel.load(path), data)
    else:
        scored = ranker.LambdaMart.load(p.spark, path).score(data)
    io.write_csv(ranker.predict_lists(scored, p.targets(), k), p.at("ranker_predictions.csv"))


def evaluate_lists(p: Paths, source: str = "ranker", k: int = 20, type_weights: dict[str, float] | None = None) -> DataFrame:
    return evaluate.by_type(evaluate.per_row(p.read("labels.parquet"), p.lists(source), k), type_weights)


def count_labels(p: Paths) -> DataFrame:
    return evaluate.label_counts(p.read("labels.parquet"))


def analyze_candidates(p: Paths, k: int = 20) -> DataFrame:
    return evaluate.oracle(p.read("candidates.parquet"), p.read("labels.parquet"), k)


def build_submission(p: Paths, source: str = "ranker", k: int = 20) -> None:
    io.write_csv(evaluate.submission(p.lists(source), k), p.at("submission.csv"))


Step = Callable[..., object]
TASKS: dict[str, Step] = {
    "build-validation": build_validation, "build-test-events": build_test_events, "build-covis-matrix": build_covis, "popular-recall": popular_recall,
    "covisitation-recall": covis_recall, "train-dssm": train_two_tower, "dssm-recall": two_tower_recall, "fusion-recall": fuse, "fusion-grid": fusion_grid,
    "build-recall-candidates": build_candidates, "build-ranker-data": build_ranker_data, "train-ranker": train_ranker, "ranker-predict": ranker_predict,
    "evaluate": evaluate_lists, "count-labels": count_labels, "analyze-recall-candidates": analyze_candidates, "build-submission": build_submission,
}
RECALL = ["popular-recall", "covisitation-recall", "dssm-recall", "build-recall-candidates"]
WORKFLOWS: dict[str, list[str]] = {
    "validation": ["build-validation", "build-covis-matrix", "train-dssm", *RECALL, "analyze-recall-candidates"],
    "ranker": ["build-ranker-data", "train-ranker", "ranker-predict", "evaluate"],
    "test": ["build-test-events", *RECALL, "build-ranker-data", "ranker-predict", "build-submission"],
}
WORKFLOWS["all"] = [*WORKFLOWS["validation"], *WORKFLOWS["ranker"]]


def run_workflow(spark: SparkSession, name: str, out: str, input_file: str | None = None, **settings: dict) -> object:
    """Run a workflow's tasks in turn; ``settings`` maps a task (with underscores) to its keyword arguments. Returns
    what the last task gives."""
    if name not in WORKFLOWS:
        raise ValueError(f"no such workflow: {name}")
    p, result = Paths(spark, out, test=name == "test"), None
    for task in WORKFLOWS[name]:
        own = dict(settings.get(task.replace("-", "_"), {}))
        if task in ("build-validation", "build-test-events"):
            own["train_file" if task == "build-validation" else "test_file"] = input_file
        result = TASKS[task](p, **own)
    return result


#: How the text of a flag is read, by the annotation of the argument.
READERS: dict[str, Callable[[str], object]] = {
    "int": int, "float": float, "str": str, "bool": lambda x: x.lower() in ("1", "true", "yes"), "dict[str, float]": parse_weights, "dict[str, tuple[float, ...]]": parse_grid,
}


def arguments(task: str) -> dict[str, Callable[[str], object]]:
    """A task's arguments, but for its paths and input file, and how each is read."""
    own = list(inspect.signature(TASKS[task]).parameters.values())[1:]
    return {a.name: READERS[str(a.annotation).removesuffix(" | None")] for a in own if not a.name.endswith("_file")}


def main(argv: list[str] | None = None) -> None:
    """``TASK [--flag value ...]`` or ``--workflow NAME``: every argument of a task is a flag, with dashes; in a workflow
    they are ``--task.flag``. Flags go before the settings file's sections, those before the defaults."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("task", nargs="?", choices=sorted(TASKS))
    parser.add_argument("--workflow", choices=sorted(WORKFLOWS))
    parser.add_argument("--list", action="store_true", help="tasks with their flags, and workflows")
    parser.add_argument("--out", default="outputs")
    parser.add_argument("--input")
    parser.add_argument("--config", help="YAML or JSON file with a section for each task")
    parser.add_argument("--test", action="store_true")
    args, rest = parser.parse_known_args(argv)
    if args.task and args.workflow:
        parser.error("give a task or a workflow, not both")
    if args.list or not (args.task or args.workflow):
        for name in TASKS:
            print(name, *(f"--{a.replace('_', '-')}" for a in arguments(name)))
        for name, steps in WORKFLOWS.items():
            print(f"{name}:", *steps)
        return
    flags: dict[str, dict[str, object]] = {}
    own = argparse.ArgumentParser(prog=args.task or args.workflow)
    for name in [args.task] if args.task else dict.fromkeys(WORKFLOWS[args.workflow]):
        for a, read in arguments(name).items():
            own.add_argument(f"--{'' if args.task else name + '.'}{a.replace('_', '-')}", dest=f"{name}.{a}", type=read, default=argparse.SUPPRESS)
    for key, value in vars(own.parse_args(rest)).items():
        name, _, a = key.rpartition(".")
        flags.setdefault(name.replace("-", "_"), {})[a] = value
    spark = SparkSession.builder.getOrCreate()
    config = read_settings(spark, args.config) if args.config else {}
    if "type_weights" in config:
        config["evaluate"] = {"type_weights": config.pop("type_weights")} | config.get("evaluate", {})
    settings = {name: (config.get(name) or {}) | flags.get(name, {}) for name in {*config, *flags}}
    if args.workflow:
        result = run_workflow(spark, args.workflow, args.out, args.input, **settings)
    else:
        result = TASKS[args.task](Paths(spark, args.out, args.test), *([args.input] if args.input else []), **settings.get(args.task.replace("-", "_"), {}))
    if isinstance(result, DataFrame):
        print(evaluate.as_table(result))


if __name__ == "__main__":
    main()
