"""URL rules by host suffix and path prefix, matched through short hash prefixes.

Every rule (host, path) has a digest of ``host`` and ``path``; every URL expands into the suffixes of its host and the
prefixes of its path, limited to the shapes that some rule has, which leaves out nothing that could match. Expressions meet rules
on the first 32 bits of their digests, and the full digest confirms. Of the rules that fit, the longest host and
path together wins, then the longer host, then ``block``.

Where the rules are few enough to be broadcast and have few shapes, every shape (labels of the host, length of the path)
is one equi-join with the broadcast rules, and rows are judged where they lie. Else expressions of the distinct places
meet the rules by shuffling, and the verdicts of the places that have one go back to the rows.

Nulls and odd rows: a null URL, or one without ``://``, has an empty host and path and gets the default; repeated rows
stay; very long URLs are judged whole, by as many expressions as rules have shapes; rules alike in host and path are one,
``block`` before ``allow``; an empty table or an empty rule list works; extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number are broadcast (a few dozen bytes each); more are joined by shuffling.
BROADCAST_RULES = 50_000
#: Shapes of rules up to this number are joined one by one.
MAX_SHAPES = 32


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``rule_host, rule_path, verdict`` from tuples (verdict, host, path)."""
    return spark.createDataFrame([(h, p, v) for v, h, p in rules], "rule_host string, rule_path string, verdict string")


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def prefix(d: Column) -> Column:
    return F.conv(F.substring(d, 1, 8), 16, 10).cast("bigint")


def host_suffixes(host: Column, labels: list[int]) -> Column:
    parts = F.split(host, F.lit(r"\."), F.lit(-1))
    wanted = F.filter(F.array(*map(F.lit, labels)), lambda k: k <= F.size(parts))
    return F.transform(wanted, lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))


def path_prefixes(path: Column, lengths: list[int]) -> Column:
    wanted = F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= F.length(path))
    return F.transform(wanted, lambda k: path.substr(F.lit(1), k))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url", key: str = "page_id") -> DataFrame:
    """``page_id, url, host, path, rule, verdict`` of every row."""
    rules = rules.select(F.translate("rule_host", UPPER, LOWER).alias("rule_host"), "rule_path", "verdict").where("rule_host IS NOT NULL AND rule_path IS NOT NULL")
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))  # block after allow
    shape = rules.agg(F.count("*"), F.collect_set(F.struct(F.size(F.split("rule_host", F.lit(r"\."), F.lit(-1))).alias("labels"), F.length("rule_path").alias("length")))).first()
    count, shapes = shape[0], sorted((s["labels"], s["length"]) for s in shape[1])
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(key), F.col(url_col), host.alias("host"), path.alias("path"))
    if not count:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    known = rules.withColumn("rule_digest", digest(F.col("rule_host"), F.col("rule_path"))).withColumn("prefix", prefix(F.col("rule_digest")))
    strength = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), F.col("verdict").alias("v"), F.concat("rule_host", "rule_path").alias("rule"))
    known = known.select("prefix", "rule_digest", strength.alias("strength"))
    if count <= BROADCAST_RULES and len(shapes) <= MAX_SHAPES:
        out, held = rows.withColumn("_best", F.lit(None).cast(known.schema["strength"].dataType)), F.broadcast(known)
        for labels, length in shapes:
            h, p = F.get(host_suffixes(F.col("host"), [labels]), 0), F.get(path_prefixes(F.col("path"), [length]), 0)
            out = out.withColumn("_digest", digest(h, p)).withColumn("_prefix", prefix(F.col("_digest")))
            out = out.join(held, (F.col("_prefix") == F.col("prefix")) & (F.col("_digest") == F.col("rule_digest")), "left")
            # greatest passes over nulls
            out = out.select(key, url_col, "host", "path", F.greatest("_best", "strength").alias("_best"))
        return out.select(key, url_col, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.v", F.lit(default)).alias("verdict"))
    labels, lengths = sorted({a for a, _ in shapes}), sorted({b for _, b in shapes})
    places = rows.select("host", "path").distinct()
    exprs = places.withColumn("h", F.explode(host_suffixes(F.col("host"), labels))).withColumn("p", F.explode(path_prefixes(F.col("path"), lengths)))
    exprs = exprs.withColumn("digest", digest(F.col("h"), F.col("p"))).select("host", "path", "digest", prefix(F.col("digest")).alias("prefix"))
    hits = exprs.join(F.broadcast(known) if count <= BROADCAST_RULES else known, "prefix").where("digest = rule_digest")
    best = hits.groupBy("host", "path").agg(F.max("strength").alias("best"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select(key, url_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))
