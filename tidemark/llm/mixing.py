"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations only.

Each source is a stream of its documents in hash order, ``passes`` times over, cut into blocks of equal tokens. Slots
take the points ``frac(i * golden ratio)``; cumulative target shares map a point to its source, and the slot's rank
within its source is the block it takes. Slots of one source are spread as evenly as any sequence allows, so every
prefix of the schedule has close to the target shares, and the numbers of slots meet the targets within a few blocks;
a short tail of slots makes up what is missing, and a source's last block is cut at its target.

Places in a stream are sums over buckets of a hash first, then within each. Equal rows are one row with a number of
copies until the result, in portions of ``COPIES``, so that neither a large source nor a group of copies meets in one
task. The table of sources has one row for each; its weights follow their order, in one task.

Nulls and odd rows: a null text has no tokens; a null source is a source, ordered last; null and repeated ids are rows
like others, each taken at most ``passes`` times its size; rows are told apart by 128-bit hashes that see nulls; equal rows
share what their places take; very long texts span as many blocks as they need; sources without tokens have target 0;
an empty table gives an empty result; extra columns are ignored unless asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: frac(golden ratio), the step of the schedule's points.
GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"
#: Cells of [0, 1) by which points find their source.
CELLS = 4096
#: Copies of a row that lie side by side at most.
COPIES = 1024
KEY = ["key_a", "key_b"]


def row_keys(columns: list[Column]) -> list[Column]:
    """A 128-bit hash of a row as two numbers. Hashes pass over nulls, so which columns are null is hashed, too."""
    flags = [c.isNull() for c in columns]
    return [F.xxhash64(*columns, *flags).alias("key_a"), F.xxhash64(F.lit(1), *flags, *columns).alias("key_b")]


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, passes: int = 2) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources in code-point order, null last, take the weights in turn and share ``share`` times all tokens. No target
    exceeds ``passes`` times its source; what is above is shared anew by weight among the others. With the sources in
    order of cap / weight, the level ``(total - caps so far) / weights left`` says which are full, in one pass."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    chain = F.lit(float(weights[-1]))
    for k, w in reversed(list(enumerate(weights[:-1]))):
        chain = F.when(turn == k, F.lit(float(w))).otherwise(chain)
    s = sizes.withColumn("weight", chain).withColumn("cap", F.col("source_size").cast("double") * passes)
    everything = Window.partitionBy()
    rank = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("all_weight", F.sum("weight").over(everything))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(rank), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(rank), F.lit(0.0))))
    s = s.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    left = (F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)) / F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).over(everything)
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(left * F.col("weight")))
    return s.select("source", "source_size", "target")


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """Slots ``slot, source, rank``: the block of its source's stream that each slot of the mix takes."""
    spark = targets.sparkSession
    t = targets.where("target > 0").withColumn("need", F.ceil(F.col("target") / block))
    total = t.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.coalesce(F.max("need"), F.lit(0))).first()
    slots = int(total[0] // block)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    high = F.sum("target").over(order) / F.lit(float(total[0] or 1.0))
    shares = t.select("source", "need", (high - F.col("target") / F.lit(float(total[0] or 1.0))).alias("low"), high.alias("high"))
    last = F.max("high").over(Window.partitionBy())
    shares = shares.select("source", "need", "low", F.when(F.col("high") == last, F.lit(2.0)).otherwise(F.col("high")).alias("high"))
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)).cast("bigint"))))
    points = spark.range(slots).withColumn("point", (F.col("id") + 1) * F.lit(GOLDEN))
    points = points.select("id", (F.col("point") - F.floor("point")).alias("point")).withColumn("cell", F.floor(F.col("point") * CELLS))
    main = points.join(cells, "cell").where("point >= low AND point < high").select(F.col("id").alias("slot"), "source")
    # ranks: blocks of slots first, so that no source's slots meet in one task
    span = F.floor(F.col("slot") / 65536).alias("span")
    main, _ = materialize(main.withColumn("span", span), "slots")
    per, _ = materialize(main.groupBy("source", "span").agg(F.count("*").alias("n")), "per")
    had = per.groupBy(F.col("source").alias("s2")).agg(F.sum("n").alias("n"))
    per = per.select("source", "span", (F.sum("n").over(Window.partitionBy("source").orderBy("span")) - F.col("n")).alias("before"))
    main = main.join(per.select(F.col("source").alias("s2"), F.col("span").alias("p2"), "before"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("span") == F.col("p2")))
    main = main.select("slot", "source", (F.col("before") + F.row_number().over(Window.partitionBy("source", "span").orderBy("slot")) - 1).alias("rank"))
    tail = t.join(had, F.col("source").eqNullSafe(F.col("s2")), "left").where("coalesce(n, 0) < need")
    tail = tail.select("source", F.explode(F.sequence(F.coalesce("n", F.lit(0)), F.col("need") - 1)).alias("rank"))
    tail = tail.select((F.lit(slots) + F.row_number().over(Window.orderBy("rank", F.col("source").asc_nulls_last())) - 1).alias("slot"), "source", "rank")
    return main.unionByName(tail)


def mix(rows: DataFrame, size: Column | None = None, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, passes: int = 2, block: int = 1024, seed: int = 17, bucket_rows: int = 8192, keys: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix of ``rows`` (``doc_id, source, text``): its spans and its sizes.

    ``spans``: ``slot, doc_id, source, key_a, key_b, at, pass, first, n`` - slot takes ``n`` tokens of the document from
    its token ``first`` on. ``sizes``: ``doc_id, source, key_a, key_b, at, size, source_size, target``. Rows are told
    apart by ``keys``, else :func:`row_keys` of id, source and text, and rows of one key by their place ``at`` in their
    source's stream."""
    size = F.regexp_count("text", F.lit(WORD)).cast("bigint") if size is None else size
    keys = row_keys([F.col(c) for c in ("doc_id", "source", "text")]) if keys is None else keys
    d = rows.select("doc_id", "source", F.coalesce(size, F.lit(0)).cast("bigint").alias("size"), *keys)
    d = d.groupBy(*d.columns).agg(F.count("*").alias("copies"))
    d = d.withColumn("portion", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / COPIES))))
    d = d.withColumn("copies", F.least(F.lit(COPIES).cast("bigint"), F.col("copies") - F.col("portion") * COPIES))
    d, _ = materialize(d, "mix")  # read three times; only ids, sizes and hashes
    d = d.withColumn("place", F.xxhash64(*KEY, "portion", F.lit(seed)))
    buckets = max(1, -(-d.count() // bucket_rows))
    d = d.withColumn("bucket", F.pmod(F.shiftright("place", 20), F.lit(buckets)))
    all_size = F.col("size") * F.col("copies")
    per, _ = materialize(d.groupBy("source", "bucket").agg(F.sum(all_size).alias("n")), "buckets")
    totals = per.groupBy("source").agg(F.sum("n").alias("source_size"))
    targets, _ = materialize(source_targets(totals, weights, share, passes), "targets")
    per = per.select("source", "bucket", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("before"))
    info = per.join(targets.withColumnRenamed("source", "s1"), F.col("source").eqNullSafe(F.col("s1"))).drop("s1")
    info = info.select(F.col("source").alias("s1"), F.col("bucket").alias("b1"), "before", "source_size", "target")
    d = d.join(info, F.col("source").eqNullSafe(F.col("s1")) & (F.col("bucket") == F.col("b1"))).drop("s1", "b1")
    inside = Window.partitionBy("source", "bucket").orderBy("place", *KEY, "portion", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("at", F.col("before") + F.sum(all_size).over(inside) - all_size)
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))).withColumn("at", F.col("at") + F.col("copy") * F.col("size"))
    sizes = d.select("doc_id", "source", *KEY, "at", "size", "source_size", "target")
    runs = d.where("size > 0 AND target > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    runs = runs.withColumn("begin", F.col("at") + F.col("pass") * F.col("source_size")).withColumn("end", F.least(F.col("begin") + F.col("size"), F.round("target").cast("bigint")))
    runs = runs.where("begin < end").withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    slots = schedule(targets, block).select("slot", F.col("source").alias("s1"), F.col("rank").alias("r1"))
    low, high = F.greatest(F.col("begin"), F.col("rank") * block), F.least(F.col("end"), (F.col("rank") + 1) * block)
    spans = runs.join(slots, F.col("source").eqNullSafe(F.col("s1")) & (F.col("rank") == F.col("r1")))
    spans = spans.select("slot", "doc_id", "source", *KEY, "at", "pass", (low - F.col("begin")).alias("first"), (high - low).alias("n"))
    return spans, sizes


def taken(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """``doc_id, source, key_a, key_b, size, source_size, target, taken, first_slot, slots`` of every row; ``taken`` counts
    repeats, and the slots are the schedule's part that takes from the row."""
    got = spans.groupBy(*(F.col(c).alias(f"g_{c}") for c in ("source", *KEY, "at"))).agg(F.sum("n").alias("n"), F.min("slot").alias("first_slot"), F.count("*").alias("slots"))
    same = F.col("source").eqNullSafe(F.col("g_source")) & (F.col("at") == F.col("g_at"))
    for c in KEY:
        same = same & (F.col(c) == F.col(f"g_{c}"))
    out = sizes.join(got, same & (F.col("size") > 0), "left")
    return out.select("doc_id", "source", *KEY, "size", "source_size", "target", F.coalesce("n", F.lit(0)).alias("taken"), "first_slot", F.coalesce("slots", F.lit(0)).alias("slots"))
