"""The corpus pipeline: quality filter, near-duplicate removal, mixing to target weights, and packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``documents``, which lie in one struct meanwhile, so that extra columns may have any name. The two filters judge rows,
by a hash of all columns: rows with a null or repeated id are each judged on their own, and only rows equal in all
columns stand or fall together. An empty table passes all stages; null and empty texts are rejected by the first; very
long texts are judged, mixed and packed whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing
from tidemark.llm.common import materialize, release
from tidemark.llm.ngram_join import NgramJaccard
from tidemark.llm.quality_lm import QualityModel

#: Keys of dropped rows up to this number (16 bytes each) are broadcast; more are joined by shuffling.
BROADCAST_IDS = 100_000
#: The quality model learns from all trusted documents; its thresholds come from all of them, by models without their fold.
FOLDS = 5
#: Pieces of text that the last stage's encoders remember: executors still hold memory of the stages before.
REMEMBERED = 300_000


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _rows(docs: DataFrame) -> DataFrame:
    """``doc, row_key``. Hashes pass over nulls, so it is hashed, too, which columns are null."""
    columns = _columns(docs)
    return docs.select(F.struct(*columns).alias("doc"), F.xxhash64(*columns, *(c.isNull() for c in columns)).alias("row_key"))


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose key and id aren't in ``dropped(row_key, id)``."""
    dropped, _ = materialize(dropped.distinct(), "dropped")
    gone = _few(dropped).select(F.col("row_key").alias("k"), F.col("id").alias("i"))
    return rows.join(gone, (F.col("row_key") == F.col("k")) & F.col("doc.doc_id").cast("bigint").eqNullSafe(F.col("i")), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    rows = _rows(docs)
    judged = QualityModel(folds=FOLDS).classify(rows.select("doc.doc_id", "doc.lang", "doc.text", "row_key"), spark.read.parquet(f"{sf_dir}/labels.parquet"), "row_key")
    return _without(rows, judged.where("NOT keep").select(F.col("row").alias("row_key"), F.col("doc_id").alias("id"))).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group linked by five-word shingles of similarity 0.8; a null id
    is larger than others, and of equal ids the smaller key counts. Of rows equal in all columns one stays."""
    rows = _rows(docs)
    found = NgramJaccard(n=5, num=80, den=100).components(rows.select("row_key", "doc.text"), "row_key").select(F.col("doc_id").alias("row_key"), "component_id")
    found, p1 = materialize(found.groupBy("row_key").agg(F.min("component_id").alias("component_id"), F.count("*").alias("copies")), "groups")
    groups, p2 = materialize(found.where("component_id <> row_key").select("component_id").distinct(), "groups")
    members = found.join(_few(groups), "component_id").select("component_id", "row_key")
    ids = rows.select("row_key", F.col("doc.doc_id").cast("bigint").alias("id"))
    members, p3 = materialize(members.join(ids, "row_key").distinct(), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key")).alias("m"))
    first, p4 = materialize(first.select("component_id", F.col("m.row_key").alias("first")), "first")
    left = _without(rows, members.join(_few(first), "component_id").where("row_key <> first").select("row_key", "id"))
    repeated, _ = materialize(found.where("copies > 1").select("row_key"), "repeated")
    release(spark, p1, p2, p3, p4)
    if not repeated.isEmpty():
        some = _few(repeated)
        left = left.join(some, "row_key", "left_anti").unionByName(left.join(some, "row_key", "left_semi").dropDuplicates(["row_key"]))
    return left.select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass over a document; the last document of a pass may be cut after a word. Every file
    written from it holds its rows in the order of the schedule's slots."""
    keys = mixing.KEY
    rows = docs.select(F.struct(*_columns(docs)).alias("doc"), *mixing.row_keys(_columns(docs)))
    spans, _ = mixing.mix(rows.select("doc.doc_id", "doc.source", "doc.text", *keys), keys=[F.col(k) for k in keys])
    takes = spans.groupBy("source", *keys, "at", "pass").agg(F.sum("n").alias("n"), F.min("slot").alias("slot")).select(*keys, "n", "slot", "pass")
    rows = rows.dropDuplicates(keys).join(takes, keys).sortWithinPartitions("slot", *keys, "pass")
    begun = F.regexp_substr("doc.text", F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("n").cast("string"), F.lit("}+")))
    text = F.when(F.col("n") == F.regexp_count("doc.text", F.lit(mixing.WORD)), F.col("doc.text")).otherwise(begun)
    rows = rows.withColumn("doc", F.col("doc").withField("text", text))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("doc", F.col("doc").withField("n_chars", F.length("doc.text").cast(docs.schema["n_chars"].dataType)))
    return rows.select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, remembered=REMEMBERED)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: A language model, an exact join's components, and a tokenizer: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
