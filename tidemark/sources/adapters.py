"""Adapters from tables to the event schema ``session, aid, ts, seq, type``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _choice(column: str, values: dict[str, str]):
    out = None
    for k, v in values.items():
        out = F.when(F.col(column) == k, v) if out is None else out.when(F.col(column) == k, v)
    return out


def dense_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter A: the table ``events``; a user is a session, the property ``k`` the item. Errors are dropped."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = {"view": "clicks", "click": "clicks", "signup": "carts", "purchase": "orders"}
    e = e.where(F.col("event_type").isin(*kinds))
    return e.select(F.col("user_id").alias("session"), F.get_json_object("props", "$.k").cast("bigint").alias("aid"), "ts", F.col("event_id").alias("seq"), _choice("event_type", kinds).alias("type"))


def sparse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter B: ``orders`` joined with ``lineitem``; a customer is a session, a part the item. Rows equal in time,
    item and type are interchangeable."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_shipdate", "l_returnflag")
    kinds = {"N": "clicks", "A": "carts", "R": "orders"}
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("session"), F.col("l_partkey").alias("aid"), F.col("l_shipdate").alias("ts"), _choice("l_returnflag", kinds).alias("type"))
    from tidemark.schema import type_id

    order = Window.partitionBy("session").orderBy("ts", "aid", type_id())
    return j.withColumn("seq", F.row_number().over(order).cast("bigint")).select("session", "aid", "ts", "seq", "type")


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter C: the table ``embeddings`` as item vectors ``aid, vec``."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").cast("bigint").alias("aid"), F.col("embedding").cast("array<double>").alias("vec"))
