"""Settings of tasks from a YAML or JSON file."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def read_settings(spark: SparkSession, path: str) -> dict[str, dict]:
    """The sections of a settings file on any of Spark's file systems, by name with underscores: a task's section holds
    its arguments, ``type_weights`` the metric's weights."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text)
    return {str(k).replace("-", "_"): v for k, v in (found or {}).items()}


def parse_floats(text: str) -> tuple[float, ...]:
    """A list like ``0.1, 0.2``; empty parts are passed over."""
    return tuple(float(x) for x in text.split(",") if x.strip())


def parse_weights(text: str) -> dict[str, float]:
    """Weights like ``popular=0.1,covis=2.5``."""
    return {name.strip(): float(value) for name, _, value in (part.partition("=") for part in text.split(",") if part.strip())}


def parse_grid(text: str) -> dict[str, tuple[float, ...]]:
    """Lists of weights like ``popular=0.1,0.2;covis=1.0``."""
    return {name.strip(): parse_floats(values) for name, _, values in (part.partition("=") for part in text.split(";") if part.strip())}
