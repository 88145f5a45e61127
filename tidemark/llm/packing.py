"""Best-fit packing of token sequences, improved by swap-based local search.

Documents become pieces of at most ``capacity`` tokens, of which one at most isn't full. Full pieces are sequences of
their own. The others are dealt in turn, whatever their ids, into groups of about ``group_pieces``, and every group is
packed by itself: best-fit decreasing first, then a local search that exchanges one piece for one, two for one, or moves
a piece, from the least filled bin to a fuller one. Every step raises the sum of squared fills, until bins run empty and
disappear; the search ends when no bin has a step left, or after 8 steps a piece, and 20,000 at least. Groups never grow
with the data, so memory is bounded and more data are more tasks; full pieces have groups of their own, by their number.

Nulls and odd rows: a null or empty text has the end id alone; a null id is an id like others; repeated rows are packed
as often as they occur; a very long document is tokenised at once, and its pieces are dealt like others; documents of equal
length are packed in the order of their ids, texts and places; an empty table gives an empty result; extra columns of the pieces are carried through, extra
columns of the documents are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import settle, slices
from tidemark.session import ship

#: Pieces that one task packs together.
GROUP_PIECES = 16384


def tokenize_pieces(docs: DataFrame, capacity: int = 1024, end_id: int | None = 2, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", remembered: int | None = None) -> DataFrame:
    """Pieces of every document: ``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit). ``remembered``
    bounds the pieces of text that an encoder remembers: fewer take less memory and more time.

    Only documents of more than ``capacity`` ids are cut; all pieces but the first are full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidemark.llm.tokens import REMEMBERED, encoder

        enc = encoder(tokenizer, remembered or REMEMBERED)
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids"]
        for batch in batches:
            for part in slices(batch, 1, 256):
                keys, rows = part.column(0), []
                for i, ids in enumerate(enc.encode(part.column(1).to_pylist())):
                    ids += tail
                    n = len(ids) // 4
                    first = n % capacity or min(n, capacity)
                    cuts = [0, *range(first, n + 1, capacity)] if n else [0, 0]
                    rows += [(i, k, a, b - a, ids[4 * a : 4 * b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())], names)
        settle()

    ship(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that takes it. Open bins wait by free space, and a
    bit set of the free spaces in use finds the tightest fit."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    in_use = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = in_use >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                in_use &= ~(1 << free)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        left = free - size
        if left:
            if not by_free[left]:
                in_use |= 1 << left
            by_free[left].append(b)
    return bins


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int, steps: int | None = None) -> list[list[int]]:
    """Local search among the underfull bins. The least filled bin gives: a piece moves to a bin with room; or one of
    its pieces, or any two together, change places with a smaller piece of a fuller bin, the exchange that fills it
    best. Each step raises the squared fill. An emptied bin goes; a bin with no step left rests until all others do, and
    is tried again if one has changed since. ``steps`` bounds the search: 8 for each piece, and 20,000 at least."""
    fills = [int(lengths[b].sum()) for b in bins]
    least = -(-sum(fills) // capacity)
    done = [b for b, f in zip(bins, fills) if f == capacity]
    work = [list(b) for b, f in zip(bins, fills) if f < capacity]
    fill = np.array([f for f in fills if f < capacity], np.int64)
    live = np.ones(len(work), bool)
    resting = np.zeros(len(work), bool)
    item = np.array([i for b in work for i in b], np.int64)
    size = lengths[item].astype(np.int64) if len(item) else np.empty(0, np.int64)
    home = np.repeat(np.arange(len(work)), [len(b) for b in work])
    count = len(bins)
    steps = max(20_000, 8 * len(item)) if steps is None else steps
    changed = False
    while steps > 0 and count > least:
        open_bins = np.flatnonzero(live & ~resting & (fill < capacity))
        if not len(open_bins):
            if not changed:
                break
            resting[:] = changed = False
            continue
        v = int(open_bins[np.argmin(fill[open_bins])])
        while steps > 0:
            steps -= 1
            mine = np.flatnonzero(home == v)
            if not len(mine):
                live[v] = False
                count -= 1
                break
            free = capacity - fill
            free[v] = -1
            free[~live] = -1
            free[fill < fill[v]] = -1
            big = mine[np.argsort(-size[mine], kind="stable")]
            room = free.max(initial=-1)
            movable = big[size[big] <= room]
            if len(movable):
                x = movable[0]
                fits = np.flatnonzero(free >= size[x])
                j = fits[np.argmin(free[fits])]
                home[x] = j
                fill[j] += size[x]
                fill[v] -= size[x]
                changed = True
                continue
            # the least piece that may come back for each total given: of bins with at least so much room with it
            space = free[home]
            there = np.flatnonzero(space > 0)
            back = np.full(2 * capacity + 1, capacity + 1, np.int64)
            np.minimum.at(back, size[there] + space[there], size[there])
            back = np.minimum.accumulate(back[::-1])[::-1]
            kinds, one, many = np.unique(size[mine], return_index=True, return_counts=True)
            i, j = np.triu_indices(len(kinds))
            pair = (i != j) | (many[i] > 1)
            i, j = i[pair], j[pair]
            total = np.concatenate((kinds, kinds[i] + kinds[j]))
            gains = total - back[total]
            at = int(np.argmax(gains)) if len(there) else 0
            if not len(there) or gains[at] <= 0:
                resting[v] = True
                break
            k = there[np.flatnonzero((size[there] == back[total[at]]) & (size[there] + space[there] >= total[at]))[0]]
            if at < len(kinds):
                xs = mine[one[at]]
            else:
                x, y = i[at - len(kinds)], j[at - len(kinds)]
                xs = [mine[one[x]], mine[one[y]] if x != y else mine[size[mine] == kinds[x]][1]]
            gain = int(gains[at])
            changed = True
            j = home[k]
            home[xs] = j
            home[k] = v
            fill[j] += gain
            fill[v] -= gain
    for b in np.flatnonzero(live):
        done.append(item[home == b].tolist())
    return done


def pack_pieces(pieces: DataFrame, capacity: int = 1024, group_pieces: int = GROUP_PIECES, n_docs: int | None = None, n_full: int | None = None) -> DataFrame:
    """``pieces`` (``doc_id, piece, length`` and any more columns, carried through) with ``sequence_id`` and
    ``offset``. ``n_docs``, of the pieces that may be part full, and ``n_full``, of full ones at most, set the numbers of
    groups; they are counted where absent."""
    ship(pieces.sparkSession)
    if n_docs is None or n_full is None:
        n_docs, n_full = pieces.agg(F.count_if(F.col("length") < capacity), F.count_if(F.col("length") >= capacity)).first()
    groups, full_groups = max(1, round(n_docs / group_pieces)), max(1, -(-n_full // group_pieces))
    # dealt by places, so that neither a repeated id nor copies of a text are a hot key
    deal = F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id())
    key = F.when(F.col("length") >= capacity, groups + F.pmod(deal, F.lit(full_groups))).otherwise(F.pmod(deal, F.lit(groups))).cast("int")
    held = pieces.columns

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "length"], kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        small = np.flatnonzero((lengths < capacity) & (lengths > 0))
        bins = [[i] for i in np.flatnonzero((lengths >= capacity) | (lengths == 0)).tolist()]
        packed = improve(best_fit_decreasing(lengths[small], capacity), lengths[small], capacity)
        bins += [small[b].tolist() for b in packed]
        group = int(pdf["_group"].iloc[0]) if len(pdf) else 0
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for k, b in enumerate(bins):
            sequence[b] = (group << 32) | k
            offset[b] = np.cumsum(lengths[b]) - lengths[b]
        return pdf[held].assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return pieces.withColumn("_group", key).groupBy("_group").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int | None = 2, tokenizer: str | None = None, group_pieces: int = GROUP_PIECES, remembered: int | None = None) -> DataFrame:
    """Tokenise and pack: the spans of every sequence, with the ids' checksum in place of the ids, so that only small
    rows are shuffled. :func:`tokenize_pieces` gives the ids of each span."""
    pieces = tokenize_pieces(docs, capacity, end_id, tokenizer, remembered=remembered)
    spans = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    # a token has a byte at least, so this bounds the full pieces
    n_docs, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return pack_pieces(spans, capacity, group_pieces, n_docs, size // capacity)


def pack_report(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row ``sequences, least, tokens, fill`` of a packing: its sequences, and the least number that could hold its pieces."""
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    full, rest = F.count_if(F.col("n") == capacity), F.coalesce(F.sum(F.when(F.col("n") < capacity, F.col("n"))), F.lit(0))
    tokens = F.coalesce(F.sum("n"), F.lit(0))
    return per.agg(F.count("*").alias("sequences"), (full + F.ceil(rest / capacity)).alias("least"), tokens.alias("tokens"), (tokens / (F.greatest(F.count("*"), F.lit(1)) * capacity)).alias("fill"))
