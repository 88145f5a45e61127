"""Token-id files with Elias-Fano encoded document borders.

A file is a Parquet table of segments, written by Spark's committing writer so that lost executors leave nothing
half-done. A segment holds consecutive documents in ascending id order:

    magic b"TMEF1", id width (1 byte), documents n (u32), tokens u (u64), low bits l (1 byte), select samples s (u32),
    low halves: n + 1 values of l bits, packed; high halves: unary, (n + 1) + (u >> l) + 1 bits, packed;
    select samples: position of every 64th one bit (u32 each); token ids, one after the other.

The borders are the n + 1 running totals of the documents' lengths. Their low ``l`` bits stand packed, their high bits
as gaps in unary, in about 2 + log2(u / n) bits a document instead of 64. The samples let :meth:`Segment.select` find
one document's offset, and :meth:`Segment.borders` those of a run of documents, without decoding the others.

Nulls and odd rows: a null text is empty (its end id alone); null ids come first; repeated ids and rows stay repeated, in any
order among themselves, and may fall into several ranges; a document longer than a segment is one segment; an empty table
makes a table without segments; other columns are ignored."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import settle, slices
from tidemark.session import ship

MAGIC = b"TMEF1"
HEADER = struct.Struct("<5sBIQBI")
SAMPLE = 64
#: A segment closes once it has this many tokens; a longer document has a segment of its own.
SEGMENT_TOKENS = 1 << 20


def encode_borders(lengths: np.ndarray) -> tuple[int, bytes, bytes, np.ndarray]:
    """Low bits, packed low halves, packed unary high halves and select samples of the running totals."""
    ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.uint64))).astype(np.uint64)
    n, u = len(lengths), int(ends[-1])
    low_bits = max(0, (u // max(1, n)).bit_length() - 1)
    low = ((ends[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    ones = (ends >> np.uint64(low_bits)).astype(np.int64) + np.arange(n + 1)
    high = np.zeros(n + 1 + (u >> low_bits) + 1, np.uint8)
    high[ones] = 1
    return low_bits, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4")


def encode_segment(ids: list[bytes], width: int) -> bytes:
    """A segment of documents given as little-endian unsigned 32-bit ids."""
    lengths = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
    low_bits, low, high, samples = encode_borders(lengths)
    flat = np.frombuffer(b"".join(ids), "<u4").astype("<u2" if width == 2 else "<u4")
    return b"".join((HEADER.pack(MAGIC, width, len(ids), int(lengths.sum()), low_bits, len(samples)), low, high, samples.astype("<u4").tobytes(), flat.tobytes()))


class Segment:
    """A segment's bytes, read without copying."""

    def __init__(self, data: bytes):
        magic, self.width, self.n, self.tokens, self.low_bits, samples = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = HEADER.size
        low_bytes = ((self.n + 1) * self.low_bits + 7) // 8
        high_bytes = (self.n + 1 + (self.tokens >> self.low_bits) + 1 + 7) // 8
        self.low = np.frombuffer(data, np.uint8, low_bytes, at)
        self.high = np.frombuffer(data, np.uint8, high_bytes, at + low_bytes)
        at += low_bytes + high_bytes
        self.samples = np.frombuffer(data, "<u4", samples, at)
        self.ids = np.frombuffer(data, "<u2" if self.width == 2 else "<u4", self.tokens, at + 4 * samples)

    def select(self, i: int) -> int:
        """The ``i``-th border: from the nearest sample, count one bits up to it, then add the low half."""
        place, seen = int(self.samples[i // SAMPLE]), i - i % SAMPLE
        at = place // 8
        mask = 0xFF << (place % 8) & 0xFF
        while True:
            byte = int(self.high[at]) & mask
            ones = byte.bit_count()
            if seen + ones > i:
                break
            seen, at, mask = seen + ones, at + 1, 0xFF
        for _ in range(i - seen):
            byte &= byte - 1
        place = at * 8 + (byte & -byte).bit_length() - 1
        low, begin = 0, i * self.low_bits
        for k in range(self.low_bits):
            bit = begin + k
            low |= (int(self.low[bit // 8]) >> (bit % 8) & 1) << k
        return (place - i) << self.low_bits | low

    def borders(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The borders ``first`` to ``last``, read between the samples around them."""
        last = self.n if last is None else last
        count, sample, after = last - first + 1, first // SAMPLE, last // SAMPLE + 1
        begin = int(self.samples[sample]) // 8
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little")) + begin * 8
        ones = ones[np.searchsorted(ones, self.samples[sample]) + first - sample * SAMPLE :][:count]
        high = ones - np.arange(first, last + 1)
        if not self.low_bits:
            return high
        at = first * self.low_bits
        bits = np.unpackbits(self.low[at // 8 : ((last + 1) * self.low_bits + 7) // 8], bitorder="little")[at % 8 :][: count * self.low_bits]
        return high << self.low_bits | bits.reshape(count, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.select(i) : self.select(i + 1)]


def write_tokens(docs: DataFrame, path: str, end_id: int | None = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode all documents in ascending id order and write their segments to ``path``. The texts are dealt once, by
    ranges of ids; a range is a run of segments ``(part, seq)``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from tidemark.llm.tokens import encoder

        enc = encoder(tokenizer)
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        width = 2 if enc.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        part, seq, keys, ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        names = ["part", "seq", "n_docs", "n_tokens", "doc_ids", "data"]

        def segment() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([size], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([encode_segment(ids, width)], pa.binary())], names)

        for batch in batches:
            for rows in slices(batch, 1, 256):
                for key, x in zip(rows.column(0).to_pylist(), enc.encode(rows.column(1).to_pylist())):
                    x += tail
                    if ids and size + len(x) // 4 > segment_tokens:
                        yield segment()
                        seq, keys, ids, size = seq + 1, [], [], 0
                    keys.append(key)
                    ids.append(x)
                    size += len(x) // 4
        if ids:
            yield segment()
        settle()

    spark = docs.sparkSession
    # hashes and places part the rows of one id, and copies
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("mark"), F.monotonically_increasing_id().alias("place"))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.col("doc_id").asc_nulls_first(), "mark", "place"]
    plain = plain.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text")
    plain.mapInArrow(run, "part int, seq int, n_docs bigint, n_tokens bigint, doc_ids array<bigint>, data binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, **values: Column) -> DataFrame:
    """Every document back from the files: ``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit), or instead
    of ``ids`` the named expressions of it, which are taken before the rows are joined with their starts.

    ``start`` counts the ids of all documents before it. Running totals are taken over the parts' sums and then inside
    a part, from the segments' small columns only."""
    ship(spark)
    segments = spark.read.schema("part int, seq int, n_docs bigint, n_tokens bigint, doc_ids array<bigint>, data binary").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidemark.llm.token_output import Segment

        names = ["part", "seq", "doc_id", "local", "n_tokens", "ids"]
        for batch in batches:
            for part, seq, keys, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
                s = Segment(data)
                for at in range(0, s.n, 1024):
                    ends = s.borders(at, min(at + 1024, s.n))
                    n = len(ends) - 1
                    ids = [s.ids[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(keys[at : at + 1024], pa.int64()), pa.array(ends[:-1], pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(ids, pa.binary())], names)
        settle()

    by_part = segments.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    by_part = by_part.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inside = segments.select("part", "seq", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("within"))
    starts = inside.join(by_part, "part").select("part", "seq", (F.col("before") + F.col("within")).alias("base"))
    rows = segments.select("part", "seq", "doc_ids", "data").mapInArrow(run, "part int, seq int, doc_id bigint, local bigint, n_tokens bigint, ids binary")
    rows = rows.select("part", "seq", "doc_id", "local", "n_tokens", *([c.alias(k) for k, c in values.items()] or ["ids"]))
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), *rows.columns[4:])
