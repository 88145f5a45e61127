"""Readers and writers of the engine's files. All paths are arguments; any file system of Spark works."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import LABELS, PREDICTIONS, RAW_SESSION, require_columns


def read_sessions(spark: SparkSession, path: str, nrows: int | None = None) -> DataFrame:
    """Events of a JSON-lines file of sessions: ``session, aid, ts, seq, type``; ``nrows`` takes the sessions with the
    smallest ids, each task keeping no more than so many. Null and 0 are all; less is refused."""
    if nrows is not None and nrows < 0:
        raise ValueError("nrows must not be negative")
    raw = spark.read.schema(RAW_SESSION).json(path)
    if nrows:
        raw = raw.orderBy("session").limit(nrows)
    return explode_sessions(raw)


def explode_sessions(raw: DataFrame) -> DataFrame:
    """Flat events of nested sessions; ``seq`` is the place in the list. Sessions without events vanish."""
    e = raw.select("session", F.posexplode("events").alias("seq", "e"))
    return e.select("session", F.col("e.aid").alias("aid"), F.col("e.ts").alias("ts"), F.col("seq").cast("bigint").alias("seq"), F.col("e.type").alias("type"))


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table with its required columns checked; Spark's own error tells a missing path."""
    df = spark.read.parquet(path)
    return require_columns(df, columns, path).select(*columns) if columns else df


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of a CSV file, always as text; blank lists are null."""
    return spark.read.schema(PREDICTIONS).option("header", True).csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(spark.read.parquet(path), LABELS.names, path).select(*LABELS.names)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; empty strings are written as nothing."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_metadata(spark: SparkSession, values: dict, path: str) -> None:
    """A dictionary as one line of JSON."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def load_named_sources(spark: SparkSession, specs: list[str], k: int) -> dict[str, DataFrame]:
    """Prediction files given as ``name=path``, as ranked items ``session, type, aid, rank``."""
    from tidemark.operators.candidates import ranked_items

    out = {}
    for spec in specs:
        name, sep, path = spec.partition("=")
        if not sep or not name or not path or name in out:
            raise ValueError(f"not a new name=path: {spec}")
        out[name] = ranked_items(read_predictions(spark, path), k)
    return out
