"""Queries over the driver's tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat_format, fingerprints, mixing, packing, token_output, url_filter
from tidemark.llm.common import shared_dir
from tidemark.llm.embedding_dedup import near_duplicates
from tidemark.llm.html_extract import extract
from tidemark.llm.ngram_join import NgramJaccard
from tidemark.llm.quality_lm import QualityModel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tidemark/tokens-{uuid.uuid4().hex}"
    token_output.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_output.read_tokens(spark, path, ids_crc32=F.crc32("ids"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QualityModel().classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, sizes = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken(spans, sizes).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "slots")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NgramJaccard(n=3, num=90, den=100).components(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    c = chat_format.format_chats(rows.unionByName(own))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    c = c.select("conv_id", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    return c.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.encode(F.array_join(turns, ""), "UTF-8"), 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars")


#: (verdict, host, path)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op5_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.rule_table(spark, URL_RULES)
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_pack": op1_pack, "op2_html": op2_html, "op3_ngram_join": op3_ngram_join, "op4_chat": op4_chat, "op5_url": op5_url, "op6_quality": op6_quality, "op7_embedding": op7_embedding, "op8_mix": op8_mix, "op9_tokens": op9_tokens, "op10_fingerprint": op10_fingerprint}


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; the others are tested against brute force."""
    rules = " UNION ALL ".join(f"SELECT '{h}{p}' AS rule, '{h}' AS h, '{p}' AS p, '{v}' AS v" for v, h, p in URL_RULES)
    return {
        "op4_chat": """WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL
            SELECT -1, n, r, '<|im_end|><|im_start|>assistant ok' FROM (SELECT 0 AS n, 'user' AS r UNION ALL SELECT 1, 'assistant') x),
            w AS (SELECT *, coalesce(lag(role) OVER o <> role, true) AS first, coalesce(lead(role) OVER o <> role, true) AS last FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length(text) + (length(text) - length(replace(text, '<|', ''))) // 2 + CASE WHEN first THEN 13 + length(role) ELSE 10 END + CASE WHEN last THEN 11 ELSE 0 END) AS BIGINT) AS formatted_chars
            FROM w GROUP BY conv_id""",
        "op5_url": f"""WITH r AS ({rules}), u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
            s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
            m AS (SELECT s.page_id, r.rule, r.v, row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule) DESC) AS n FROM s JOIN r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p))
            SELECT s.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM s LEFT JOIN m ON m.page_id = s.page_id AND n = 1""",
        "op7_embedding": """WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
            l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
            reach AS (SELECT vec_id AS n, vec_id AS r FROM e UNION SELECT l.b, reach.r FROM reach JOIN l ON l.a = reach.n),
            c AS (SELECT n, min(r) AS c FROM reach GROUP BY n)
            SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept FROM e JOIN c ON c.n = e.vec_id""",
    }
