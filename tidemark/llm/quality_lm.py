"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams, and thresholds by language.

The model is trained on trusted text. Every document's perplexity comes from sharded count joins:

1. Documents fall into shards of about ``shard_bytes``: ranges of ids between approximate quantiles, as rows of near
   ids tend to lie together, and where a range holds more (equal ids, null ids, long texts), parts of it by a hash of
   id and text. One scan counts the n-grams of the trusted documents and lists the distinct n-grams that each shard
   asks for.
2. Counts, continuation counts of all lower orders, and discounts are aggregations; the probability of every n-gram
   asked for is a chain of equi-joins with them, order by order, hash-sharded by n-gram and by context.
3. The probabilities go back to the shards that asked, as one compact row for each shard and hash slice, meet the
   shard's texts, and the documents are scored. No model is broadcast or collected, and no task holds more than a
   shard, which is bounded by bytes but for a single text, or one repeated under one id, that is longer.

A document is kept if its score, the mean negative log probability of its bytes, is at most the threshold of its
language: the median of held-out trusted documents plus ``reach`` times the distance from the median to an upper
quantile, and at least ``slack``. Scores of short texts are drawn towards the median, as by ``prior`` more bytes.

N-grams of bytes can't see a word or phrase said again and again, which is even likely text to them. So a document is
rejected, too, if its ``repeats`` are above a threshold got in the same way, by language, with ``repeat_slack``: the
share of words (see :func:`~tidemark.llm.common.word_hashes`) equal to the word ``k`` places before, for the ``k`` of 1
to ``LAGS`` where it is largest, drawn towards 0 as by a word more for every 4 bytes of ``prior``.

Trusted are all documents with label 1. A fifth of them, by a hash of their ids, is held out for the quantiles, and the
model is trained on all others. Quantiles are exact: the smallest value that reaches the rank, found by counts of cells and
then among the values of one cell. Languages with fewer than ``least`` held-out documents, and null, share the
quantiles of all languages.

With ``folds``, nothing is held out. The model is trained on all trusted documents, and the quantiles are of all of
them, too: the same hash deals them into folds, and a fold's documents are scored for the quantiles by a model of all
other folds, whose counts are the model's less the fold's. A fold without others to learn from gives no scores; if all
trusted documents lie in one, nothing is rejected but empty texts. Of the quantiles' scores the trusted documents' own
text is no part, but of their scores it is; scores of other documents come from a somewhat larger model than the
quantiles.

Trusted ids are masks of 64 neighbours each. Up to ``BROADCAST_ROWS`` masks are broadcast; more are joined by a shuffle,
which for the training counts moves the texts once, and with ``folds`` once more for the scores.

Nulls and odd rows: a null or empty text has no perplexity and is rejected; a null id or language is a value like
others, except that null ids are never trusted; ids may lie anywhere in a long; repeated rows are scored each, alike;
very long texts are scored whole; scores equal to a threshold are kept; repeated labels count as trusted if one of them is; with no trusted documents at all, or an empty table, nothing is rejected but empty texts; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, release, settle, slices, word_hashes
from tidemark.session import ship

#: Symbols of the model: bytes.
SYMBOLS = 256
#: Longest distance, in words, over which repeats are looked for.
LAGS = 8
_TRAIN, _HELD_OUT = 1, 2
#: Ranges of ids that are told apart at most: 8 bytes each.
MAX_RANGES = 1 << 16
#: Rows of a table (about 70 bytes each) up to which it is broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 500_000
#: Cells of a unit by which quantiles are sought.
CELLS = 4096


def grams(raw: np.ndarray, order: int) -> np.ndarray:
    """The n-gram ending at every byte, packed big-endian; before the first byte stand line breaks."""
    padded = np.concatenate((np.full(order - 1, 10, np.uint8), raw)).astype(np.int64)
    out = np.zeros(len(raw), np.int64)
    for k in range(order):
        out = out << 8 | padded[k : k + len(raw)]
    return out


def word_repeats(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Every text's number of words, and of those equal to the word ``k`` places before, for the best ``k``."""
    words, offsets = word_hashes(texts)
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(texts)), n)
    best = np.zeros(len(texts), np.int64)
    for k in range(1, LAGS + 1):
        same = (words[k:] == words[:-k]) & (doc[k:] == doc[:-k])
        best = np.maximum(best, np.bincount(doc[k:][same], minlength=len(texts)))
    return n.astype(np.int64), best


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def exact_quantiles(values: DataFrame, levels: list[float]) -> tuple[DataFrame, str]:
    """``part, lang, what, n, level, x`` of ``values(part, lang, what, x)``: for every group its number of rows, and for each
    level the smallest value that at least that share of the rows doesn't exceed. One task holds a group's cells, or the
    distinct values of the one cell that has the rank. Also the path of the table it reads."""
    group = ["part", "lang", "what"]
    counts, path = materialize(values.groupBy(*group, "x").agg(F.count("*").alias("n")), "values")
    counts = counts.withColumn("cell", F.floor(F.col("x") * CELLS))
    cells = counts.groupBy(*group, "cell").agg(F.sum("n").alias("n"))
    cells = cells.withColumns({"upto": F.sum("n").over(Window.partitionBy(*group).orderBy("cell")), "total": F.sum("n").over(Window.partitionBy(*group))})
    found = cells.withColumn("level", F.explode(F.array(*(F.lit(float(p)) for p in levels))))
    found = found.withColumn("rank", F.greatest(F.ceil(F.col("level") * F.col("total")), F.lit(1)))
    found = found.where("upto >= rank AND upto - n < rank").select(*(F.col(c).alias(f"f_{c}") for c in (*group, "cell")), "level", "rank", "total", (F.col("upto") - F.col("n")).alias("below"))
    same = F.lit(True)
    for c in (*group, "cell"):
        same = same & F.col(c).eqNullSafe(F.col(f"f_{c}"))
    inside = Window.partitionBy(*group, "level").orderBy("x")
    near = counts.join(found, same).withColumn("upto", F.col("below") + F.sum("n").over(inside))
    return near.where("upto >= rank").groupBy(*group, "level").agg(F.first("total").alias("n"), F.min("x").alias("x")).select(*group, "n", "level", "x"), path


class QualityModel:
    def __init__(self, order: int = 4, shard_bytes: int = 1 << 24, quantile: float = 0.99, reach: float = 2.0, slack: float = 0.15, prior: int = 64, least: int = 20, repeat_slack: float = 0.15, folds: int = 0):
        self.order, self.shard_bytes = order, shard_bytes
        self.quantile, self.reach, self.slack, self.prior, self.least = quantile, reach, slack, prior, least
        self.repeat_slack, self.folds = repeat_slack, folds
        self._paths: list[str] = []

    # --- pieces

    def _rows(self, docs: DataFrame, key: str | None = None) -> DataFrame:
        """``id, lang, text, row, mark`` rows; ``mark`` is a hash of id and text."""
        d = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), (F.col(key) if key else F.lit(None)).cast("bigint").alias("row"))
        return d.withColumn("mark", F.xxhash64("id", "text"))

    def _flagged(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        """``rows``, which have an ``id``, with a ``flag``: trusted for training, held out, or 0; with ``folds``, the
        fold of a trusted row, from 1 on, or 0."""
        bit = F.col("id").bitwiseAND(F.lit(63))
        trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("id"))
        masks = trusted.groupBy(F.shiftright("id", 6).alias("near")).agg(F.bit_or(F.expr("shiftleft(1L, int(id & 63))")).alias("mask"))
        masks, path = materialize(masks, "trusted")
        self._paths.append(path)
        # null ids meet no mask: their keys are larger than any, and many, so that a shuffle deals them out
        near = F.coalesce(F.shiftright("id", 6), F.lit(1 << 60) + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 16)))
        dealt = F.xxhash64("id", F.lit(3))
        use = F.pmod(dealt, F.lit(self.folds)).cast("int") + 1 if self.folds else F.when(F.pmod(dealt, F.lit(5)) == 0, _HELD_OUT).otherwise(_TRAIN)
        flag = F.when(F.col("mask").isNotNull() & (F.getbit("mask", bit.cast("int")) == 1), use).otherwise(0)
        return rows.withColumn("near", near).join(_few(masks), "near", "left").select(*rows.columns, flag.alias("flag"))

    def _packed(self, docs: DataFrame, labels: DataFrame, key: str | None = None) -> DataFrame:
        """The rows of ``docs`` with flags."""
        return self._flagged(self._rows(docs, key), labels)

    def _shards(self, docs: DataFrame) -> Callable[[pa.Array, pa.Array], np.ndarray]:
        """A function from ids and marks to shards. Ranges of ids lie between quantiles, which outlying ids don't move,
        and one range has the null ids; the bytes of each say into how many parts the marks cut it."""
        d = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.octet_length(F.col("text").cast("string")).alias("size"))
        size, count = d.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("id")).first()
        ranges = max(1, min(MAX_RANGES, size // self.shard_bytes))
        cuts = np.empty(0, np.int64)
        if ranges > 1 and count:
            levels = [k / ranges for k in range(1, ranges)]
            cuts = np.unique(np.array(d.agg(F.percentile_approx("id", levels, max(10_000, 8 * ranges))).first()[0], np.int64))

        def places(ids: pa.Array) -> np.ndarray:
            known = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
            return np.where(pc.is_null(ids).to_numpy(zero_copy_only=False), 0, 1 + np.searchsorted(cuts, known, side="right"))

        def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(cuts) + 2)
            for batch in batches:
                many = pc.fill_null(batch.column(1), 0).to_numpy(zero_copy_only=False)
                total += np.bincount(places(batch.column(0)), many, len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["place", "size"])

        parts = np.ones(len(cuts) + 2, np.int64)
        # a row for each range at most
        for place, size in d.mapInArrow(sizes, "place bigint, size bigint").groupBy("place").agg(F.sum("size")).where(F.col("sum(size)") > 2 * self.shard_bytes).collect():
            parts[place] = -(-size // self.shard_bytes)

        def shards(ids: pa.Array, marks: pa.Array) -> np.ndarray:
            at = places(ids)
            part = marks.to_numpy(zero_copy_only=False).view(np.uint64) % parts[at].astype(np.uint64)
            return at + part.astype(np.int64) * len(parts)

        return shards

    def _asked(self, packed: DataFrame, shards_of: Callable) -> DataFrame:
        """``shard, fold, gram, n``: distinct n-grams of every shard, with their counts in trusted training text, by fold;
        without ``folds``, all in fold 0."""
        order, folds = self.order, self.folds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
            size = 0

            def merged(parts):
                g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                return g, np.bincount(at, np.concatenate([p[1] for p in parts]), len(g)).astype(np.int64)

            def flush():
                for (shard, fold), parts in held.items():
                    g, n = merged(parts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), shard)), pa.array(np.full(len(g), fold, np.int32)), pa.array(g), pa.array(n)], ["shard", "fold", "gram", "n"])
                held.clear()

            for batch in batches:
                for part in slices(batch, 2, 512):
                    shards, flags = shards_of(part.column(0), part.column(3)), part.column(1).to_numpy(zero_copy_only=False)
                    texts = part.column(2).to_pylist()
                    for shard in np.unique(shards):
                        for flag in np.unique(flags[shards == shard]).tolist():
                            some = [grams(np.frombuffer(texts[i].encode(), np.uint8), order) for i in np.flatnonzero((shards == shard) & (flags == flag)) if texts[i]]
                            if some:
                                g, n = np.unique(np.concatenate(some), return_counts=True)
                                train = flag > 0 if folds else flag == _TRAIN
                                held.setdefault((int(shard), flag if folds else 0), []).append((g, n if train else np.zeros(len(g), np.int64)))
                                size += len(g)
                    if size > 1_000_000:  # draw together what has come; give it out if that doesn't help
                        for k in held:
                            held[k] = [merged(held[k])]
                        size = sum(len(p[0][0]) for p in held.values())
                        if size > 500_000:
                            yield from flush()
                            size = 0
            yield from flush()
            settle()

        return packed.select("id", "flag", "text", "mark").mapInArrow(run, "shard bigint, fold int, gram bigint, n bigint")

    @property
    def _by(self) -> list[str]:
        """The columns that tell models apart."""
        return ["model"] if self.folds else []

    def _wanted(self, asked: DataFrame, models: list[int]) -> DataFrame:
        """``asked`` for each of ``models`` that a row asks, as a column ``model``: 0, and that without its own fold."""
        if not self.folds:
            return asked
        both = asked.withColumn("model", F.explode(F.array_distinct(F.array(F.lit(0), F.col("fold")))))
        return both.where(F.col("model").isin(models))

    def _of_model(self, values: dict[int, float]) -> Column:
        """The value of a row's model."""
        if not self.folds:
            return F.lit(values[0])
        return F.element_at(F.array(*(F.lit(values.get(m, 0.0)) for m in range(self.folds + 1))), F.col("model") + 1)

    def _probabilities(self, asked: DataFrame) -> DataFrame:
        """``gram, logp`` of every distinct n-gram asked for, by interpolated modified Kneser-Ney; with ``folds``, by
        ``model``, too: 0 is that of all folds, and the others, named by the fold that they leave out, are asked by it.

        Order by order: counts of the highest order, and of lower ones the number of distinct bytes seen before; the
        discounts from counts of counts; a context's sum and discounted mass. A join on the n-gram gives the discounted
        share, a join on its context the weight of the next lower order; the lowest interpolates with 1 / 256."""
        order, by = self.order, self._by
        counts = {order: asked.where("n > 0").groupBy("gram").agg(F.sum("n").alias("c"), *(F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(1, self.folds + 1)))}
        if self.folds:
            left = (F.struct(F.lit(k).alias("model"), (F.col("c") - F.col(f"c{k}") if k else F.col("c")).alias("c")) for k in range(self.folds + 1))
            counts[order] = counts[order].select("gram", F.inline(F.array(*left))).where("c > 0")
        counts[order], path = materialize(counts[order], "counts")
        self._paths.append(path)
        for k in range(order - 1, 0, -1):
            lower = counts[k + 1].groupBy(*by, (F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))).alias("gram")).agg(F.count("*").alias("c"))
            counts[k], path = materialize(lower, "counts")
            self._paths.append(path)
        spectrum = None
        for k, table in counts.items():
            one = table.groupBy(*by).agg(*(F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4))).withColumn("k", F.lit(k))
            spectrum = one if spectrum is None else spectrum.unionByName(one)
        discount = {}
        for r in spectrum.collect():  # one row for each order and model
            n1, n2, n3, n4 = (max(1, r[f"n{i}"]) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            discount[r["k"], r["model"] if by else 0] = [min(max(d, 0.05), i + 0.95) for i, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))]
        # models that nothing trains give no answers, but for the one of all folds
        q = self._wanted(asked, sorted({0} | {m for _, m in discount})).select(*by, "gram").distinct().withColumns({"p": F.lit(0.0), "w": F.lit(1.0)})
        for k in range(order, 0, -1):
            d1, d2, d3 = (self._of_model({m: d[i] for (at, m), d in discount.items() if at == k}) for i in range(3))
            cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
            context = counts[k].groupBy(*by, F.shiftright("gram", 8).alias("h")).agg(F.sum("c").alias("total"), F.sum(cut).alias("mass"))
            share = counts[k].select(*by, F.col("gram").alias("g"), (F.col("c") - cut).alias("a"))
            q = q.withColumns({"g": F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))}).withColumn("h", F.shiftright("g", 8))
            q = q.join(share, [*by, "g"], "left").join(context, [*by, "h"], "left")
            seen = F.col("total").isNotNull()
            q = q.select(*by, "gram", (F.col("p") + F.when(seen, F.col("w") * F.coalesce("a", F.lit(0.0)) / F.col("total")).otherwise(0.0)).alias("p"), F.when(seen, F.col("w") * F.col("mass") / F.col("total")).otherwise(F.col("w")).alias("w"))
        return q.select(*by, "gram", F.ln(F.col("p") + F.col("w") / SYMBOLS).alias("logp"))

    def _scored(self, rows: DataFrame, answers: DataFrame, shards_of: Callable) -> DataFrame:
        """``id, lang, row, n_bytes, loss, apart, n_words, n_same`` by meeting each shard's texts with the shard's answers;
        ``apart`` is a trusted text's loss by the model without its fold, ``flag``."""
        order = self.order
        names = ["shard", "ids", "langs", "rows", "flags", "blob", "lengths"]

        def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            deflate = zstandard.ZstdCompressor(level=3)
            for batch in batches:
                shards = shards_of(batch.column(0), batch.column(4))
                for shard in np.unique(shards):
                    for some in slices(batch.take(pa.array(np.flatnonzero(shards == shard))), 2, 256):
                        texts = [(t or "").encode() for t in some.column(2).to_pylist()]
                        yield pa.RecordBatch.from_arrays([pa.array([int(shard)], pa.int64()), pa.array([some.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([some.column(1).to_pylist()], pa.list_(pa.string())), pa.array([some.column(3).to_pylist()], pa.list_(pa.int64())), pa.array([some.column(5).to_pylist()], pa.list_(pa.int32())), pa.array([deflate.compress(b"".join(texts))], pa.binary()), pa.array([[len(t) for t in texts]], pa.list_(pa.int64()))], names)

        def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shards, models, g, p = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
                for shard, model in sorted(set(zip(shards.tolist(), models.tolist()))):
                    own = (shards == shard) & (models == model)
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([model], pa.int32()), pa.array([g[own].astype("<i8").tobytes()], pa.binary()), pa.array([p[own].astype("<f4").tobytes()], pa.binary())], ["shard", "model", "grams", "logps"])

        def score(texts: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
            inflate = zstandard.ZstdDecompressor()
            known = {}
            for model, own in tables.groupby("model"):
                g = np.frombuffer(b"".join(own["grams"]), "<i8")
                p = np.frombuffer(b"".join(own["logps"]), "<f4").astype(np.float64)
                turn = np.argsort(g)
                known[model] = g[turn], p[turn]

            def loss(asked: np.ndarray, model: int) -> float:
                g, p = known[model]
                return -p[np.searchsorted(g, asked)].sum()

            out = []
            for ids, langs, keys, flags, blob, lengths in zip(*(texts[c] for c in names[1:])):
                raw = np.frombuffer(inflate.decompress(blob), np.uint8)
                ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
                sums, apart = np.full((2, len(flags)), np.nan)
                for i, (a, b, flag) in enumerate(zip(ends, ends[1:], flags)):
                    if b > a:
                        asked = grams(raw[a:b], order)
                        sums[i] = loss(asked, 0)
                        if flag and flag in known:
                            apart[i] = loss(asked, flag)
                out += zip(ids, langs, keys, lengths, sums, apart, *word_repeats([raw[a:b].tobytes() for a, b in zip(ends, ends[1:])]))
            frame = pd.DataFrame(out, columns=["id", "lang", "row", "n_bytes", "loss", "apart", "n_words", "n_same"])
            del known, out
            settle()
            return frame.astype({"id": "Int64", "row": "Int64"})

        blobs = rows.mapInArrow(squeeze, "shard bigint, ids array<bigint>, langs array<string>, rows array<bigint>, flags array<int>, blob binary, lengths array<bigint>")
        tables = answers.repartition("shard").mapInArrow(table, "shard bigint, model int, grams binary, logps binary")
        return blobs.groupBy("shard").cogroup(tables.groupBy("shard")).applyInPandas(score, "id bigint, lang string, row bigint, n_bytes bigint, loss double, apart double, n_words bigint, n_same bigint")

    def _levels(self, held: DataFrame) -> tuple[DataFrame, dict]:
        """The median and the upper quantile of scores and of repeats of ``held(lang, mean, repeats)``: ``lang, mid, high,
        mid_same, high_same`` of the languages that have ``least`` rows, and those of all rows, by name."""
        names = {"mid": ("mean", 0.5), "high": ("mean", self.quantile), "mid_same": ("repeats", 0.5), "high_same": ("repeats", self.quantile)}
        values = held.select("lang", F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).alias("x")) for c in ("mean", "repeats")))).alias("v"))
        values = values.select(F.explode(F.array(F.struct(F.lit("lang").alias("part"), "lang"), F.struct(F.lit("all").alias("part"), F.lit(None).cast("string").alias("lang")))).alias("p"), "v.*").select("p.*", "what", "x")
        found, path = exact_quantiles(values, sorted({0.5, self.quantile}))
        self._paths.append(path)
        own = (F.max(F.when((F.col("what") == what) & (F.col("level") == level), F.col("x"))).alias(c) for c, (what, level) in names.items())
        found, _ = materialize(found.groupBy("part", "lang").agg(F.max("n").alias("n"), *own), "levels")
        overall = found.where("part = 'all'").select(*names).first()
        by_lang = found.where((F.col("part") == "lang") & (F.col("n") >= self.least)).select("lang", *names)
        return by_lang, overall.asDict() if overall else dict.fromkeys(names)

    def _release(self, spark: SparkSession) -> None:
        release(spark, *self._paths)
        self._paths.clear()

    # --- the classifier

    def classify(self, docs: DataFrame, labels: DataFrame, key: str | None = None) -> DataFrame:
        """``doc_id, lang, n_bytes, perplexity, score, threshold, repeats, repeat_threshold, keep`` of every row, and
        ``row``, the value of the column ``key`` (a bigint), where one is named."""
        ship(docs.sparkSession)
        shards_of = self._shards(docs)
        asked, path = materialize(self._asked(self._packed(docs, labels), shards_of), "asked")
        self._paths.append(path)
        known = self._probabilities(asked)
        by = self._by
        answers = self._wanted(asked, list(range(self.folds + 1))).select("shard", *by, "gram").distinct().join(known, [*by, "gram"])
        answers = answers.select("shard", F.col("model") if by else F.lit(0).alias("model"), "gram", "logp")
        rows = self._packed(docs, labels, key) if by else self._rows(docs, key).withColumn("flag", F.lit(0))
        scored, _ = materialize(self._scored(rows, answers, shards_of), "scores")
        self._release(docs.sparkSession)
        scored = scored.withColumn("repeats", F.col("n_same") / F.greatest(F.col("n_words") + self.prior // 4, F.lit(1)))
        mean = F.col("loss") / F.col("n_bytes")
        if by:
            held = scored.where("n_bytes > 0 AND apart IS NOT NULL").select("lang", (F.col("apart") / F.col("n_bytes")).alias("mean"), "repeats")
        else:
            held = scored.where("n_bytes > 0").select("id", "lang", mean.alias("mean"), "repeats")
            held = self._flagged(held, labels).where(F.col("flag") == _HELD_OUT)
        by_lang, overall = self._levels(held)
        self._release(docs.sparkSession)
        out = scored.join(_few(by_lang), "lang", "left").withColumns({c: F.coalesce(c, F.lit(x).cast("double")) for c, x in overall.items()})
        score = (F.col("loss") + F.col("mid") * self.prior) / (F.col("n_bytes") + self.prior)
        threshold = F.col("mid") + F.greatest((F.col("high") - F.col("mid")) * self.reach, F.lit(self.slack))
        repeat_threshold = F.col("mid_same") + F.greatest((F.col("high_same") - F.col("mid_same")) * self.reach, F.lit(self.repeat_slack))
        out = out.withColumns({"score": F.when(F.col("n_bytes") > 0, score), "threshold": threshold, "repeat_threshold": repeat_threshold})
        keep = (F.col("n_bytes") > 0) & F.coalesce((F.col("score") <= F.col("threshold")) & (F.col("repeats") <= F.col("repeat_threshold")), F.lit(True))
        return out.select(F.col("id").alias("doc_id"), "lang", "n_bytes", F.when(F.col("n_bytes") > 0, F.exp(mean)).alias("perplexity"), "score", "threshold", "repeats", "repeat_threshold", keep.alias("keep"), *(["row"] if key else []))
