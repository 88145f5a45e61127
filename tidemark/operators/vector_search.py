"""Session vectors of the two-tower model and exact retrieval by inner product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators.split import ORDER
from tidemark.session import ship

#: Item matrices up to this many numbers (8 bytes each) are broadcast; larger ones are searched block by block.
BROADCAST_NUMBERS = 16_000_000
#: Scores that are held at once (8 bytes each, twice).
SCORES = 4_000_000
#: Queries that meet a block of items in one task.
QUERIES = 20_000


def session_vectors(events: DataFrame, targets: DataFrame, items: DataFrame, types: DataFrame, max_seq_len: int = 0) -> DataFrame:
    """``session, type, vec``: unit vectors of target rows.

    A session's events in the vocabulary get weights 1..L over their order, divided by their sum, L the session's own
    number of such events; the weighted sum of item and event-type vectors plus the target type's vector is normalised.
    ``items``: ``aid, vec``; ``types``: ``type, vec`` (three rows). ``max_seq_len`` keeps the latest events; 0 keeps
    all. Sessions without known events have no row."""
    ship(events.sparkSession)
    kinds = F.broadcast(types.select("type", F.col("vec").alias("tvec")))
    e = events.where("session IS NOT NULL").join(items, "aid").join(kinds, "type", "left")
    if max_seq_len:
        latest = Window.partitionBy("session").orderBy(*(F.desc(c) for c in ORDER))
        e = e.withColumn("back", F.row_number().over(latest)).where(F.col("back") <= max_seq_len)
    w = Window.partitionBy("session")
    e = e.withColumns({"place": F.row_number().over(w.orderBy(*ORDER)), "n": F.count("*").over(w)})
    share = F.col("place") / (F.col("n") * (F.col("n") + 1) / 2)
    none = F.transform("vec", lambda _: F.lit(0.0))
    # the window has parted the rows by session already
    x = e.select("session", "place", share.alias("share"), "vec", F.coalesce("tvec", none).alias("tvec")).sortWithinPartitions("session", "place")
    s = x.select("session", "share", "vec", "tvec").mapInArrow(_session_sums, "session bigint, h array<double>")
    out = targets.join(s, "session").join(kinds, "type", "left")
    return out.select("session", "type", V.l2_normalize(F.when(F.col("tvec").isNull(), F.col("h")).otherwise(V.add("h", F.col("tvec")))).alias("vec"))


def _session_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted sums ``session, h`` of rows ``session, share, vec, tvec`` that come session by session."""
    last, rest = None, None

    def given(sessions: list, sums: np.ndarray) -> pa.RecordBatch:
        width = sums.shape[1] if len(sums) else 0
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sessions) + 1, dtype=np.int32) * width), pa.array(sums.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(sessions, pa.int64()), lists], ["session", "h"])

    for batch in batches:
        if not batch.num_rows:
            continue
        session = batch.column(0).to_numpy(zero_copy_only=False)
        vec, tvec = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in (2, 3))
        begin = np.flatnonzero(np.concatenate(([True], session[1:] != session[:-1])))
        sums = np.add.reduceat((vec + tvec) * batch.column(1).to_numpy(zero_copy_only=False)[:, None], begin)
        found = session[begin].tolist()
        if last is not None and found[0] == last:
            sums[0] += rest
        elif last is not None:
            yield given([last], rest[None])
        if len(found) > 1:
            yield given(found[:-1], sums[:-1])
        last, rest = found[-1], sums[-1]
    if last is not None:
        yield given([last], rest[None])


def vocabulary_counts(events: DataFrame, items: DataFrame) -> DataFrame:
    """One row ``events, known, skipped``: events, and how many of them have a vector or don't."""
    held = items.select("aid").distinct().withColumn("hit", F.lit(1))
    e = events.select("aid").join(held, "aid", "left")
    return e.agg(F.count("*").alias("events"), F.count("hit").alias("known"), (F.count("*") - F.count("hit")).alias("skipped"))


def _rank(scored: DataFrame, k: int, digits: int) -> DataFrame:
    w = Window.partitionBy("session", "type").orderBy(F.desc("score"), "aid")
    rounded = scored.withColumn("score", F.round("score", digits))
    return rounded.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("session", "type", "aid", "rank", F.col("score").alias("dssm_score"))


def search(queries: DataFrame, items: DataFrame, k: int = 20, block: int = 200_000, digits: int = 6) -> DataFrame:
    """``session, type, aid, rank, dssm_score``: the ``k`` items of largest inner product, ties to the smaller id.

    Item vectors are normalised once. A matrix of bounded size is broadcast and every batch of queries multiplied with
    it; a larger one is cut into blocks by a hash of the item, all queries meet each block in parts of about ``QUERIES``,
    and the blocks' best ``k`` are ranked together. So a task holds a block and a part, whatever their numbers."""
    spark = queries.sparkSession
    ship(spark)
    unit = items.select("aid", V.l2_normalize(F.col("vec")).alias("vec"))
    count, width = unit.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not count:
        return queries.sparkSession.createDataFrame([], "session bigint, type string, aid bigint, rank int, dssm_score double")
    blocks = 1 if count * width <= BROADCAST_NUMBERS else -(-count // max(1, min(block, BROADCAST_NUMBERS // width)))

    def best(q: np.ndarray, aids: np.ndarray, m: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        step = max(1, SCORES // len(m))
        for row in (row for at in range(0, len(q), step) for row in np.round(q[at : at + step] @ m.T, digits)):
            if len(row) > k:  # all that tie with the k-th
                limit = np.partition(row, -k)[-k]
                keep = np.flatnonzero(row >= limit)
            else:
                keep = np.arange(len(row))
            order = np.lexsort((aids[keep], -row[keep]))[:k]
            out.append((aids[keep][order], row[keep][order]))
        return out

    def rows(pdf: pd.DataFrame, aids: np.ndarray, m: np.ndarray) -> pd.DataFrame:
        found = best(np.array(pdf["vec"].tolist(), np.float64).reshape(len(pdf), -1), aids, m)
        n = [len(a) for a, _ in found]
        return pd.DataFrame({"session": np.repeat(pdf["session"].to_numpy(), n), "type": np.repeat(pdf["type"].to_numpy(object), n), "aid": np.concatenate([a for a, _ in found]), "score": np.concatenate([s for _, s in found])})

    schema = "session bigint, type string, aid bigint, score double"
    if blocks == 1:
        held = unit.orderBy("aid").collect()
        matrix = spark.sparkContext.broadcast((np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.float64)))

        def run(frames):
            aids, m = matrix.value
            for pdf in frames:
                for at in range(0, len(pdf), 1024):
                    yield rows(pdf.iloc[at : at + 1024], aids, m)

        scored = queries.mapInPandas(run, schema)
    else:
        parts = max(1, -(-queries.count() // QUERIES))
        q = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("part", F.pmod(F.xxhash64("session", "type"), F.lit(parts)).cast("int"))
        i = unit.withColumn("block", F.pmod(F.xxhash64("aid"), F.lit(blocks)).cast("int"))
        i = i.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"session": np.empty(0, np.int64), "type": np.empty(0, object), "aid": np.empty(0, np.int64), "score": np.empty(0)})
            return rows(left, right["aid"].to_numpy(np.int64), np.array(right["vec"].tolist(), np.float64))

        scored = q.groupBy("block", "part").cogroup(i.groupBy("block", "part")).applyInPandas(meet, schema)
    return _rank(scored, k, digits)


def neighbors(items: DataFrame, k: int = 20, digits: int = 6, queries: DataFrame | None = None) -> DataFrame:
    """``aid, neighbor, rank, cosine``: the ``k`` nearest others by cosine of every item, or of those in ``queries``
    (``aid, vec``), ties to the smaller id.

    They meet all items by :func:`search`. Ids are unique; items without a vector have no row and are nobody's
    neighbour."""
    known = items.where("aid IS NOT NULL AND vec IS NOT NULL")
    asked = known if queries is None else queries.where("aid IS NOT NULL AND vec IS NOT NULL")
    q = asked.select(F.col("aid").alias("session"), F.lit("item").alias("type"), V.l2_normalize(F.col("vec")).alias("vec"))
    found = search(q, known, k + 1, digits=digits).where("aid <> session")  # an item may be pushed out by its own copies
    w = Window.partitionBy("session").orderBy("rank")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("session").alias("aid"), F.col("aid").alias("neighbor"), "rank", F.col("dssm_score").alias("cosine"))


def item_list(details: DataFrame, targets: DataFrame) -> DataFrame:
    """``session, type, predictions`` of ranked items; empty lists for the other target rows."""
    x = details.groupBy("session", "type").agg(F.sort_array(F.collect_list(F.struct("rank", "aid"))).alias("x"))
    text: Column = F.array_join(F.col("x.aid").cast("array<string>"), " ")
    return targets.join(x, ["session", "type"], "left").select("session", "type", F.coalesce(text, F.lit("")).alias("predictions"))
