"""Shared pieces: durable intermediate tables, connected components and vectorised word hashing."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a session of one machine (tests)
    takes a temporary folder; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage and survives lost
    executors. Returns the table and its path for :func:`release`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete tables that :func:`materialize` wrote and that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def slices(batch: pa.RecordBatch, column: int, rows: int = 128, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows, whose texts in ``column`` have at most ``size`` bytes, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = before = 0
    while at < batch.num_rows:
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, end - at)
        before, at = int(ends[end - 1]), end


def settle() -> None:
    """Give freed memory back to the system: workers live on, and theirs counts against their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def connected_components(edges: DataFrame, max_rounds: int = 60) -> tuple[DataFrame, str]:
    """Component of every node of ``edges(a, b)`` by alternating large-star and small-star rounds.

    Every round is a few aggregations and joins on the node, written to the shared folder; no links or labels go to
    the driver, only a count and a checksum for the stopping test. A hub is a key with many rows on one side of a join and
one on the other, which adaptive execution splits. Returns ``(node, component)`` with the smallest
    reachable node as component, and the path of its table; fails if ``max_rounds`` don't do. Null ends and self links are ignored."""
    spark = edges.sparkSession
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    now, path = materialize(now, "cc")
    seen = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: larger neighbours of every node hang on the smallest of its neighbourhood
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: a node and its smaller neighbours hang on the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "m").where("x <> m").union(
            least.select(F.col("a").alias("x"), "m")
        )
        small = small.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()
        after, new_path = materialize(small, "cc")
        mark = after.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint"))).first()
        release(spark, path)
        now, path = after, new_path
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        release(spark, path)
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
    return out, path


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) from links a, b of ids."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == label).all():
            return nodes, nodes[label]
        label = after


# --- word hashing -------------------------------------------------------------------------------------------------

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _byte_table() -> np.ndarray:
    """A pseudo-random odd word per byte; A-Z share the words of a-z."""
    table = mix64(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95)) | _U(1)
    table[65:91] = table[97:123]
    return table


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_TABLE = _byte_table()
_POW = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_P, _P_INV)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _POW[k] = np.multiply.accumulate(steps)
    return _POW[0], _POW[1]


def _window_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of one byte window that begins and ends between words."""
    solid = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, _U), starts
    up, down = _powers(len(raw) + 1)
    total = np.empty(len(raw) + 1, _U)
    total[0] = 0
    np.cumsum(_TABLE[raw] * up[: len(raw)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U)), starts


def word_hashes(texts: list, window: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, A-Z lower-cased, one after the other, and
    the offset of every text's first word (one more entry than texts). A null text has no words. Memory is bounded by
    ``window`` bytes times a small factor, or the longest word where it is longer."""
    data = b"\n".join(b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else bytes(t) for t in texts)
    raw = np.frombuffer(data, np.uint8)
    hashes, places, at = [], [], 0
    while at < len(raw):
        end = min(at + window, len(raw))
        if end < len(raw):
            gaps = np.flatnonzero(_SPACE[raw[at:end]])
            while not len(gaps) and end < len(raw):
                end = min(end + window, len(raw))
                gaps = np.flatnonzero(_SPACE[raw[at:end]])
            end = at + int(gaps[-1]) + 1 if end < len(raw) or len(gaps) else len(raw)
        h, s = _window_words(raw[at:end])
        hashes.append(h)
        places.append(s + at)
        at = end
    sizes = np.fromiter((0 if t is None else len(t.encode("utf-8", "surrogatepass")) if isinstance(t, str) else len(t) for t in texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    words = np.concatenate(hashes) if hashes else np.empty(0, _U)
    first = np.concatenate(places) if places else np.empty(0, np.int64)
    return words, np.searchsorted(first, begins)


def shingle_sets(texts: list, n: int) -> list[np.ndarray]:
    """The distinct ``n``-word shingles of every text as 64-bit hashes, unordered. A text of fewer words has its
    whole sequence as one shingle; a text without words has none."""
    words, offsets = word_hashes(texts)
    k1 = _U(0xA24BAED4963EE407)
    out = []
    if len(words) >= n:
        rolled = np.full(len(words) - n + 1, n, _U)
        for j in range(n):
            rolled = mix64(rolled * k1 + words[j : len(words) - n + 1 + j])
    for i in range(len(texts)):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            h = np.full(1, b - a, _U)
            for j in range(a, b):
                h = mix64(h * k1 + words[j : j + 1])
            out.append(h)
        else:
            out.append(np.empty(0, _U))
    return out
