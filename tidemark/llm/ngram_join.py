"""Exact n-gram Jaccard self-join with rare-first prefix filtering, and its connected components.

Method. Every text is the set of its word shingles, as 64-bit hashes. All sets are ordered by one global order, rare
shingles first: a table of counters, of bounded size, counts the shingles of all documents by hash, and the order is
(rank of the counter, hash). Ranks tell counters apart by their height above the mean load, so that shingles more
frequent than the table's own noise stand last at any size. Two sets of similarity t share a shingle among the first
``n - ceil(t n) + 1`` of each, so sets are joined on these prefix shingles. Equal sets are one set from the start, by a
128-bit signature.

The join verifies no pair twice and wants no list of a hot shingle in one task:

0. A set stays in the list of a prefix shingle only if some other set of the list passes with it the length filter and
   the positional filter, and then a bound from bit maps: sets of a and b shingles, whose parities in 256 bins differ in h
   bins, share at most (a + b - h) / 2. Lists longer than a chunk stay whole, and those of shingles whose counter is
   high aren't gathered for this at all.
1. Every set goes to the list of the first prefix shingle that it shares with another set. Lists are cut into chunks by
   a hash, bounded by sets and by shingles. Inside a chunk, pairs that pass the length, positional and bit map filters
   and aren't linked through others yet are verified. What comes out is a spanning forest, at most one link a set.
2. As every set was in one chunk, the chunks' forests are the components so far. Lists whose sets all lie in one
   component need nothing more. Of the others, at most ``STANDINS`` sets stand for each component, others each time, and
   step 1 is repeated among these, which links chunks of one cluster; only the new links, between components, are
   searched for larger ones. Sets remember the chunks they have been in, and pairs that met before aren't taken again.
3. The pairs still unlinked that share a prefix shingle, never met in a chunk, and pass the filters become candidates,
   each once. Of the candidates between two components a hash picks about ``FIRST``; these are verified on their whole
   sets after the suffix filter, and components joined. Then so are all others whose components still differ. So two
   large clusters that are linked cost a few pairs, and pairs that are needed are never left out.

Memory: kernels take texts in slices of about 1 MB, counters are one array of fixed size in each task, and groups are
bounded by shingles. A very long text is one slice, and its set one row, of 8 bytes a shingle.

Nulls and odd rows: a null or wordless text has no shingles, size 0 and no links; a text of fewer words than a shingle
has its whole sequence as one shingle; rows with a null id get a result row with a null component and link nothing;
rows that share an id are one document with several texts: they are in one component, and get one row for each; an empty
table gives an empty result; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, forest, materialize, mix64, release, settle, shingle_sets, slices
from tidemark.session import ship

_U = np.uint64
#: Counters come in blocks of this many.
_BLOCK = 1 << 15
#: Shingles of the sets that one chunk, and one task's group of chunks, hold in the mean at most.
_CHUNK_SHINGLES, _GROUP_SHINGLES = 1 << 18, 1 << 19
#: A candidate is dropped where one of this many lists before has both sets; later lists are left to ``distinct``.
_BEFORE = 64
#: Candidates between two components that are verified before the others.
FIRST = 4
#: Sets that stand for a component in a list at most.
STANDINS = 8
_MAPS = ["b0", "b1", "b2", "b3"]


def prefix_length(n: np.ndarray | int, num: int, den: int):
    """Shingles of the prefix of a set of ``n``: n - ceil(n num / den) + 1."""
    return n - (n * num + den - 1) // den + 1


def overlap_needed(a, b, num: int, den: int):
    """Least common shingles of sets of ``a`` and ``b`` with similarity num / den: ceil(num (a + b) / (den + num))."""
    return (num * (a + b) + den + num - 1) // (den + num)


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 2) -> int:
    """An upper bound of the overlap of two sorted sets: both are parted at the middle of the larger one, and parts can
    share no more than the smaller has."""
    if depth == 0 or not len(a) or not len(b):
        return min(len(a), len(b))
    if len(a) < len(b):
        a, b = b, a
    w = a[len(a) // 2]
    i, j = len(a) // 2, int(np.searchsorted(b, w))
    hit = int(j < len(b) and b[j] == w)
    return suffix_bound(a[:i], b[:j], depth - 1) + hit + suffix_bound(a[i + 1 :], b[j + hit :], depth - 1)


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Verify a pair of sorted sets: length filter, suffix filter, then the whole overlap."""
    x, y = sorted((len(a), len(b)))
    if x * den < y * num:
        return False
    need = overlap_needed(x, y, num, den)
    return suffix_bound(a, b) >= need and len(np.intersect1d(a, b, assume_unique=True)) >= need


def local_links(keys: list[np.ndarray], groups: np.ndarray, num: int, den: int, pos: np.ndarray | None = None, bits: np.ndarray | None = None, met: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all similar sets of a chunk, as a spanning forest; ``groups`` are components known before.

    Every set in turn is compared with the later ones of another group that pass the length filter and, where given,
    the positional filter for places ``pos`` in the chunk's list, the bound from the bit maps ``bits`` (four words a set),
    and that share no value of a column of ``met``; these in one vectorised count over their sets."""
    sizes = np.array([len(k) for k in keys], np.int64)
    order = np.argsort(sizes, kind="stable")
    keys, sizes = [keys[i] for i in order], sizes[order]
    group = np.unique(groups[order], return_inverse=True)[1].reshape(-1).astype(np.int64)
    left = sizes - pos[order] if pos is not None else sizes
    bits, met = (None if x is None else x[order] for x in (bits, met))
    links = []
    for i in range(len(keys) - 1):
        end = int(np.searchsorted(sizes, sizes[i] * den // num, side="right"))
        if end <= i + 1 or not sizes[i]:
            continue
        others = np.arange(i + 1, end)
        others = others[group[i + 1 : end] != group[i]]
        need = overlap_needed(sizes[i], sizes[others], num, den)
        fit = np.minimum(left[i], left[others]) >= need
        others, need = others[fit], need[fit]
        if met is not None and len(others):
            fit = ~(met[others] == met[i]).any(axis=1)
            others, need = others[fit], need[fit]
        if bits is not None and len(others):
            differ = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
            fit = (sizes[i] + sizes[others] - differ) // 2 >= need
            others, need = others[fit], need[fit]
        if not len(others):
            continue
        part = np.concatenate([keys[j] for j in others])
        at = np.searchsorted(keys[i], part)
        at[at == sizes[i]] = 0
        common = np.add.reduceat((keys[i][at] == part).astype(np.int64), np.cumsum(sizes[others]) - sizes[others])
        for j in others[common >= need]:
            if group[j] != group[i]:
                links.append((int(order[i]), int(order[j])))
                group[group == group[j]] = group[i]
    return links


class NgramJaccard:
    """The join for ``n`` words and similarity ``num / den``; see the module's text."""

    def __init__(self, n: int = 3, num: int = 90, den: int = 100, max_bits: int = 24, chunk: int = 512, rounds: int = 3, broadcast_ids: int = 200_000, hot_list: int = 1 << 17):
        self.n, self.num, self.den, self.max_bits, self.chunk, self.rounds = n, num, den, max_bits, chunk, rounds
        self.broadcast_ids = broadcast_ids  # 16 bytes each; more are joined by shuffling the texts
        self.hot_list = hot_list  # lists that may be longer stay in many tasks

    # --- kernels

    def _count(self, texts: DataFrame) -> tuple[np.ndarray, int]:
        """The rank, 0 to 63, of each counter, by the number of documents under it, and the rank from which lists
        may be longer than ``hot_list``. There are about 32 counters a document, but at most 2^max_bits: 4 bytes each in a
        task, and as many bytes on the driver, whatever the corpus.

        Up to the mean load ranks are linear, as a counter bounds its shingles' frequencies; above it they grow with
        the logarithm of the height in standard deviations of the load, so that frequent shingles stand out from it."""
        bits = min(self.max_bits, max(16, (texts.count() * 32 - 1).bit_length()))
        n, blocks = self.n, (1 << bits) // _BLOCK

        def given(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            squeeze = zstandard.ZstdCompressor(level=1)
            for k in range(blocks):
                own = counts[k * _BLOCK : (k + 1) * _BLOCK]
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([squeeze.compress(own.astype("<u4").tobytes())], pa.binary())], ["block", "counts"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, held, size = np.zeros(1 << bits, np.uint32), [], 0

            def drain() -> None:
                cell, many = np.unique(np.concatenate(held) & _U((1 << bits) - 1), return_counts=True)
                counts[cell.astype(np.int64)] += many.astype(np.uint32)
                held.clear()

            for batch in batches:
                for part in slices(batch, 0):
                    sets = shingle_sets(part.column(0).to_pylist(), n)
                    held += sets
                    size += sum(map(len, sets))
                    if size > 1 << 17:
                        drain()
                        size = 0
            if held:
                drain()
            yield from given(counts)
            del counts
            settle()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a task's blocks only: sums of 4 bytes a counter
            inflate, sums = zstandard.ZstdDecompressor(), {}
            for batch in batches:
                for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    own = sums.setdefault(k, np.zeros(_BLOCK, np.uint32))
                    more = np.frombuffer(inflate.decompress(data.as_py()), "<u4")
                    np.minimum(own, ~more, out=own)  # saturates
                    own += more
            for k, own in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.astype("<u4").tobytes()], pa.binary()), pa.array([int(own.sum(dtype=np.int64))], pa.int64())], ["block", "counts", "total"])

        shape = "block int, counts binary"
        sums = texts.select("text").mapInArrow(run, shape).repartition("block").mapInArrow(add, f"{shape}, total bigint")
        sums, path = materialize(sums, "counts")
        base = (sums.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]) // (1 << bits)

        def ranked(c: np.ndarray) -> np.ndarray:
            above = 16 + 3 * np.log2(1 + np.maximum(c - base, 0) / max(1.0, base**0.5))
            return np.where(c <= base, 16 * c // (base + 1), np.minimum(above, 63)).astype(np.uint8)

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [ranked(np.frombuffer(data.as_py(), "<u4").astype(np.int64)).tobytes() for data in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["block", "ranks"])

        ranks = np.zeros(1 << bits, np.uint8)
        for block, data in sums.select("block", "counts").mapInArrow(rank, "block int, ranks binary").collect():
            ranks[block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(data, np.uint8)
        release(texts.sparkSession, path)
        return ranks, int(ranked(np.array([base + self.hot_list]))[0])

    def _ordered(self, texts: list, ranks: np.ndarray) -> list[np.ndarray]:
        """Sorted sets in the global order: six bits of rank above 58 bits of hash."""
        mask = _U(len(ranks) - 1)
        return [np.sort((ranks[(s & mask).astype(np.int64)].astype(_U) << _U(58)) | (s >> _U(6))) for s in shingle_sets(texts, self.n)]

    @staticmethod
    def _bits(keys: np.ndarray) -> bytes:
        """Parities of the set's shingles in 256 bins."""
        odd = np.bincount((keys & _U(0xFF)).astype(np.int64), minlength=256) & 1
        return np.packbits(odd.astype(np.uint8)).tobytes()

    @staticmethod
    def _signature(keys: np.ndarray) -> tuple[int, int]:
        a, b = mix64(keys + _U(1)), mix64(keys ^ _U(0x5851F42D4C957F2D))
        return int(a.sum(dtype=_U).astype(np.int64)), int(b.sum(dtype=_U).astype(np.int64))

    def _describe(self, texts: DataFrame, ranks) -> DataFrame:
        """``id, n, s1, s2, prefix, bits`` of every row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 1):
                    sets = self._ordered(part.column(1).to_pylist(), ranks.value)
                    sign = [self._signature(k) for k in sets]
                    heads = [k[: prefix_length(len(k), self.num, self.den)] if len(k) else k for k in sets]
                    offsets = np.concatenate(([0], np.cumsum([len(h) for h in heads]))).astype(np.int32)
                    flat = np.concatenate(heads).view(np.int64)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(k) for k in sets], pa.int64()), pa.array([s for s, _ in sign], pa.int64()), pa.array([s for _, s in sign], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([self._bits(k) for k in sets], pa.binary())], ["id", "n", "s1", "s2", "prefix", "bits"])
            settle()

        return texts.mapInArrow(run, "id bigint, n bigint, s1 bigint, s2 bigint, prefix array<bigint>, bits binary")

    def _prune(self, lists: DataFrame, use_bits: bool) -> DataFrame:
        """Step 0 on rows ``key, id, s1, n, pos`` and, with ``use_bits``, ``bits``: the rows with a partner that may do by
        length and position, or by bit maps, too. Lists longer than a chunk stay whole, and pass through as they come."""
        num, den, chunk = self.num, self.den, self.chunk
        names = ["key", "id", "s1", "n", "pos"]

        def partners(t: pa.Table) -> np.ndarray:
            key, n, pos = t["key"].to_numpy(), t["n"].to_numpy().astype(np.int64), t["pos"].to_numpy().astype(np.int64)
            bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(-1, 4) if use_bits else None
            first = np.searchsorted(key, key)
            good = np.searchsorted(key, key, side="right") - first > chunk
            i = np.flatnonzero(~good[:-1])
            for step in range(1, chunk):
                i = i[i + step < len(key)]
                j = i + step
                near = (key[i] == key[j]) & (n[j] * num <= n[i] * den)  # lists are sorted by size
                i, j = i[near], j[near]
                if not len(i):
                    break
                need = overlap_needed(n[i], n[j], num, den)
                fit = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need
                a, b, need = i[fit], j[fit], need[fit]
                if use_bits:
                    differ = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
                    fit = (n[a] + n[b] - differ) // 2 >= need
                    a, b = a[fit], b[fit]
                good[a] = good[b] = True
            return good

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest, passing = None, None
            for batch in batches:
                t = pa.Table.from_batches([batch])
                if passing is not None:  # more of a long list
                    end = int(np.searchsorted(t["key"].to_numpy(), passing, side="right"))
                    yield from t.slice(0, end).select(names).to_batches()
                    t = t.slice(end)
                if rest is not None:
                    t = pa.concat_tables([rest, t])
                rest = None
                if not len(t):
                    continue
                passing = None
                key = t["key"].to_numpy()
                last = int(np.searchsorted(key, key[-1]))  # the last list may go on
                done, rest = t.slice(0, last), t.slice(last)
                if len(rest) > chunk:
                    yield from rest.select(names).to_batches()
                    rest, passing = None, key[-1]
                if len(done):
                    yield from done.filter(pa.array(partners(done))).select(names).combine_chunks().to_batches()
            if rest is not None and len(rest):
                yield from rest.filter(pa.array(partners(rest))).select(names).combine_chunks().to_batches()
            settle()

        dealt = lists.repartition("key").sortWithinPartitions("key", "n")
        return dealt.select(*names, *(["bits"] if use_bits else [])).mapInArrow(run, "key bigint, id bigint, s1 bigint, n int, pos int")

    def _sets(self, texts: DataFrame, ranks) -> DataFrame:
        """``id, s1, keys, b0, b1, b2, b3`` of every text: its sorted shingles and their bit map."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 1):
                    sets = self._ordered(part.column(1).to_pylist(), ranks.value)
                    maps = np.frombuffer(b"".join(self._bits(k) for k in sets), "<i8").reshape(-1, 4)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([self._signature(k)[0] for k in sets], pa.int64()), pa.array([k.tobytes() for k in sets], pa.binary()), *(pa.array(maps[:, w].copy()) for w in range(4))], ["id", "s1", "keys", *_MAPS])
            settle()

        return texts.mapInArrow(run, "id bigint, s1 bigint, keys binary, b0 bigint, b1 bigint, b2 bigint, b3 bigint")

    def _homes(self, lists: DataFrame) -> DataFrame:
        """``id, s1, comp, pos, key, salt``: the chunk of each set's first list, of rows ``key, id, s1, n, comp, pos``."""
        first = lists.groupBy("id", "s1").agg(F.min(F.struct("pos", "key", "n")).alias("m"), F.first("comp").alias("comp")).select("id", "s1", "comp", "m.*")
        chunks = F.greatest(F.ceil(F.count("*") / self.chunk), F.ceil(F.sum("n") / _CHUNK_SHINGLES))
        per = first.groupBy("key").agg(chunks.alias("chunks"), F.count("*").alias("c")).where("c > 1")
        dealt = first.join(per.select("key", "chunks"), "key")
        return dealt.select("id", "s1", "comp", "pos", "n", "key", F.pmod(F.xxhash64("id", "s1"), F.col("chunks")).cast("int").alias("salt"))

    def _link_chunks(self, homes: DataFrame, sets: DataFrame, met: list[str]) -> DataFrame:
        """Step 1 on chunks of ``id, s1, comp, pos, key, salt`` and columns ``met``, earlier chunks: ``node, component`` of
        the components that a chunk links, with the smallest of them."""
        num, den = self.num, self.den
        count, shingles = homes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        rows = homes.drop("n").join(sets, ["id", "s1"])
        # many small lists share a task's group
        buckets = max(1, count // 2048, shingles // _GROUP_SHINGLES)
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "salt"), F.lit(buckets)))

        def link(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = [], []
            for _, part in pdf.groupby(["key", "salt"], sort=True):
                part = part.drop_duplicates(["id", "s1"]).sort_values(["id", "s1"])
                comp = part["comp"].to_numpy(np.int64)
                found = local_links(
                    [np.frombuffer(k, _U) for k in part["keys"]], comp, num, den, part["pos"].to_numpy(np.int64),
                    part[_MAPS].to_numpy(np.int64).view(_U), part[met].to_numpy(np.int64) if met else None,
                )
                if found:
                    nodes, roots = forest(*comp[np.array(found, np.int64).T])
                    a.append(nodes)
                    b.append(roots)
            return pd.DataFrame({"node": np.concatenate([np.empty(0, np.int64), *a]), "component": np.concatenate([np.empty(0, np.int64), *b])})

        return rows.groupBy("bucket").applyInPandas(link, "node bigint, component bigint")

    @staticmethod
    def _merged(members: DataFrame | None, links: DataFrame) -> tuple[DataFrame, list[str]]:
        """``members``, ``node, component``, after ``links`` between components ``node, component``; and its tables."""
        moved, path = connected_components(links.select(F.col("node").alias("a"), F.col("component").alias("b")))
        if members is None:
            return moved, [path]
        both = members.unionByName(moved.select("node", F.col("node").alias("component"))).distinct()
        after = both.join(moved.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left")
        after, own = materialize(after.select("node", F.coalesce("now", "component").alias("component")), "members")
        release(links.sparkSession, path)
        return after, [own]

    # --- the join

    def components(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``doc_id, n_shingles, component_id`` of every row: the smallest id that links reach."""
        spark = docs.sparkSession
        ship(spark)
        texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
        ranks, hot_rank = self._count(texts)
        ranks = spark.sparkContext.broadcast(ranks)
        described, p1 = materialize(self._describe(texts, ranks), "shingles")
        real = described.where("n > 0 AND id IS NOT NULL")
        classes = real.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
        classes, p0 = materialize(classes.select(F.col("rep").alias("id"), "s1", "s2", F.col("n").cast("int").alias("n"), "copies", "prefix", "bits"), "classes")
        named, _ = materialize(classes.select(F.col("id").alias("rep"), "s1", "s2", "n", "copies"), "named")
        lists = classes.select("id", "s1", "n", F.posexplode("prefix").alias("pos", "key")).select("key", "id", "s1", "n", "pos")
        hot = F.shiftrightunsigned("key", 58) >= hot_rank
        lists, p2 = materialize(self._prune(lists.where(~hot), False).unionByName(lists.where(hot)), "lists")
        bits = lists.where(~hot).join(classes.select("id", "s1", "bits"), ["id", "s1"])
        lists, p4 = materialize(self._prune(bits, True).unionByName(lists.where(hot)), "lists")
        release(spark, p0, p2)
        # rows of one id are one document: links from it to the class of each of its texts
        several = real.groupBy("id").agg(F.count("*").alias("rows"), F.min(F.struct("s1", "s2", "n")).alias("x"), F.max(F.struct("s1", "s2", "n")).alias("y")).where("rows > 1")
        several, p6 = materialize(several.select("id", (F.col("x") < F.col("y")).alias("unlike")), "several")
        repeated, members, tables, parts = not several.isEmpty(), None, [], []
        if repeated:
            texts_of = real.select("id", "s1", "s2", "n").distinct().join(several.where("unlike").select("id"), "id", "left_semi")
            links, p = materialize(texts_of.join(named, ["s1", "s2", "n"]).select(F.col("id").alias("node"), F.col("rep").alias("component")), "links")
            parts.append(p)
            if not links.isEmpty():
                members, tables = self._merged(None, links)
        wanted, p5 = materialize(lists.select("id", "s1").distinct(), "wanted")
        few = wanted.count() <= self.broadcast_ids
        ids = wanted.select("id").distinct()
        sets = self._sets(texts.join(F.broadcast(ids) if few else ids, "id", "left_semi"), ranks)
        if repeated:
            sets = sets.join(wanted, ["id", "s1"], "left_semi").dropDuplicates(["id", "s1"])
        sets, p3 = materialize(sets, "sets")
        ranks.destroy()

        met: list[str] = []
        now = self._open(lists, members)
        placed = []
        for turn in range(self.rounds):
            homes = self._homes(now)
            for k, (name, earlier) in enumerate(zip(met, placed)):
                homes = homes.join(earlier, ["id", "s1"], "left").withColumn(name, F.coalesce(name, F.xxhash64("id", "s1", F.lit(k))))
            homes, p = materialize(homes, "homes")
            parts.append(p)
            fresh, p = materialize(self._link_chunks(homes, sets, met), "links")
            parts.append(p)
            met.append(f"met{len(met)}")
            placed.append(homes.select("id", "s1", F.xxhash64("key", "salt").alias(met[-1])))
            if fresh.isEmpty():
                break
            if members is None and not repeated:
                members = fresh  # each set was in one chunk
            else:
                parts += tables
                members, tables = self._merged(members, fresh)
            # a few sets, others each time, stand for each component in a list
            part = F.pmod(F.xxhash64("id", "s1", F.lit(turn)), F.lit(STANDINS)).alias("part")
            now = self._open(lists, members).groupBy("key", "comp", part).agg(F.min_by(F.struct("id", "s1", "n", "pos"), F.xxhash64("id", "s1", F.lit(-turn))).alias("r")).select("key", "comp", "r.*")
        pairs, p = materialize(self._candidates(self._open(lists, members), sets, dict(zip(met, placed))), "pairs")
        parts.append(p)
        for first in (True, False):
            verified, p = materialize(self._verify(self._between(pairs, members, first), sets), "links")
            parts.append(p)
            if not verified.isEmpty():
                parts += tables
                members, tables = self._merged(members, verified)
        if members is not None and not tables:
            members, _ = materialize(members, "members")  # its table is one of the parts
        release(spark, p3, p4, p5, p6, *parts)
        # rows that are alone in their class and unlinked need no join
        if members is not None:
            named = named.join(members.withColumnRenamed("node", "rep"), "rep", "left")
        else:
            named = named.withColumn("component", F.lit(None).cast("bigint"))
        named = named.where("copies > 1 OR component IS NOT NULL").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
        out = real.select("id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left").select("id", "n", F.coalesce("component", "id").alias("component"))
        out = out.unionByName(described.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component")))
        return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))

    @staticmethod
    def _open(lists: DataFrame, members: DataFrame | None) -> DataFrame:
        """Rows of the lists that hold more than one component, with their ``comp``."""
        if members is None:
            placed = lists.withColumn("comp", F.col("id"))
        else:
            placed = lists.join(members.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        split = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
        return placed.join(split.hint("shuffle_hash"), "key", "left_semi")

    def _candidates(self, lists: DataFrame, sets: DataFrame, met: dict[str, DataFrame]) -> DataFrame:
        """Pairs of one list in different components that pass the length, positional and bit map filters and that no
        chunk of ``met`` held, each once."""
        held = lists.join(sets.drop("keys"), ["id", "s1"])
        for name, earlier in met.items():
            held = held.join(earlier, ["id", "s1"], "left")
        # a pair meets at the first list that both stand in; far lists are left to distinct, so that rows stay small
        earlier = Window.partitionBy("id", "s1").orderBy("pos").rowsBetween(-_BEFORE, -1)
        held = held.withColumn("before", F.collect_list("key").over(earlier))
        columns = ["id", "s1", "n", "pos", "comp", "before", *_MAPS, *met]
        a = held.select("key", *(F.col(c).alias(f"a_{c}") for c in columns))
        b = held.select("key", *(F.col(c).alias(f"b_{c}") for c in columns))
        need = F.floor((F.lit(self.num) * (F.col("a_n") + F.col("b_n")) + (self.den + self.num - 1)) / (self.den + self.num))
        room = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
        differ = sum((F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(f"b_{m}"))) for m in _MAPS[1:]), F.bit_count(F.col("a_b0").bitwiseXOR(F.col("b_b0"))))
        fits = (
            (F.col("a_comp") != F.col("b_comp"))
            & ((F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.struct("a_id", "a_s1") < F.struct("b_id", "b_s1"))))
            & (F.col("a_n") * self.den >= F.col("b_n") * self.num)
            & (room >= need)
            & (F.col("a_n") + F.col("b_n") - differ >= 2 * need)
            & ~F.arrays_overlap("a_before", "b_before")
        )
        for name in met:
            fits = fits & F.coalesce(F.col(f"a_{name}") != F.col(f"b_{name}"), F.lit(True))
        return a.join(b, "key").where(fits).select("a_id", "a_s1", "a_comp", "b_id", "b_s1", "b_comp").distinct()

    def _between(self, pairs: DataFrame, members: DataFrame | None, first: bool) -> DataFrame:
        """The candidates that are verified ``first``, about ``FIRST`` between two components, or else the others whose
        components still differ, with these."""
        low, high = F.least("a_comp", "b_comp").alias("low"), F.greatest("a_comp", "b_comp").alias("high")
        many = pairs.groupBy(low, high).agg(F.count("*").alias("many"))
        place = F.pmod(F.xxhash64("a_id", "a_s1", "b_id", "b_s1"), F.lit(1 << 30)) * F.col("many")
        chosen = place < (FIRST << 30)
        found = pairs.withColumns({"low": low, "high": high}).join(many, ["low", "high"]).where(chosen if first else ~chosen).select(*pairs.columns)
        if first or members is None:
            return found
        for c in ("a_comp", "b_comp"):
            now = members.select(F.col("node").alias(c), F.col("component").alias("now"))
            found = found.join(now, c, "left").withColumn(c, F.coalesce("now", c)).drop("now")
        return found.where("a_comp <> b_comp")

    def _verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """``node, component``: the components of the pairs that are similar."""
        num, den = self.num, self.den

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = batch.column(2), batch.column(3)
                good = [i for i in range(batch.num_rows) if similar(np.frombuffer(a[i].as_py(), _U), np.frombuffer(b[i].as_py(), _U), num, den)]
                yield batch.select([0, 1]).take(pa.array(good, pa.int64()))

        x, y = (sets.select(F.col("id").alias(f"{c}_id"), F.col("s1").alias(f"{c}_s1"), F.col("keys").alias(c)) for c in "ab")
        rows = pairs.join(x, ["a_id", "a_s1"]).join(y, ["b_id", "b_s1"]).select(F.col("a_comp").alias("node"), F.col("b_comp").alias("component"), "a", "b")
        return rows.mapInArrow(check, "node bigint, component bigint")
