"""Document fingerprints by a homomorphic multiset hash, in DataFrame operations only.

A document is the multiset of its paragraphs (lines). Every paragraph hashes to a wide vector of integers, and the
document's vector is the sum over its paragraphs, modulo 2^64 in the equality lanes and 2^16 in the likeness lanes. So
the order of paragraphs doesn't matter, and a paragraph is inserted or deleted by adding or subtracting its vector
(:func:`combine`), without the rest of the text.

Equality lanes: hashes of the whole paragraph under different seeds, summed as wrapping 64-bit numbers. Likeness lanes:
a paragraph's vector counts, for each bit position of hashes of its word shingles, how many have the bit set; the count
of shingles goes along. Centred, these are sums of random signs, whose inner products estimate how many shingles two
documents share, with an error of about one over the square root of the number of lanes.

Nulls and odd rows: a null or empty text is the empty multiset, its vector zero; two such are alike (1.0), one and
another text are not (0.0); a paragraph of fewer words than a shingle is one shingle, one without words none; repeated
paragraphs and rows count as often as they occur; counters of texts of more than 65,535 shingles wrap, so their
likeness is that of the wrapped counts; very long texts are hashed whole; an empty table gives an empty result; extra
columns are ignored."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Equality lanes of 64 bits.
EQUAL_LANES = 2
#: Seeds of shingle hashes; each gives 64 likeness lanes, four 16-bit counters in each of 16 numbers.
SEEDS = 2
#: Words of a shingle.
SHINGLE = 5
_FIELDS = 0x0001000100010001
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def _wrapping_sum(values: Column) -> Column:
    """Sum of longs modulo 2^64. Halves are summed apart, so that nothing overflows."""
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    zero = F.struct(F.lit(0).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("high"))

    def add(s: Column, x: Column) -> Column:
        return F.struct((s["low"] + x.bitwiseAND(mask)).alias("low"), (s["high"] + F.shiftrightunsigned(x, 32)).bitwiseAND(mask).alias("high"))

    def join(s: Column) -> Column:
        top = (s["high"] + F.shiftrightunsigned(s["low"], 32)).bitwiseAND(mask)
        return F.shiftleft(top, 32).bitwiseOR(s["low"].bitwiseAND(mask))

    return F.aggregate(values, zero, add, join)


def _field_sum(values: Column) -> Column:
    """Sum of numbers of four 16-bit fields, each field modulo 2^16: odd and even fields are summed apart."""
    even = F.lit(0x0000FFFF0000FFFF).cast("bigint")
    a = F.aggregate(values, F.lit(0).cast("bigint"), lambda s, x: (s + x.bitwiseAND(even)).bitwiseAND(even))
    b = F.aggregate(values, F.lit(0).cast("bigint"), lambda s, x: (s + F.shiftrightunsigned(x, 16).bitwiseAND(even)).bitwiseAND(even))
    return a.bitwiseOR(F.shiftleft(b, 16))


def paragraphs(text: Column) -> Column:
    """The lines of a text; none for an empty or null one."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, F.lit("\n"), F.lit(-1)))


def shingles(paragraph: Column) -> Column:
    """Hashes of a paragraph's word shingles."""

    def hashes(words: Column) -> Column:
        starts = F.when(F.size(words) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(SHINGLE))))

    return let(F.regexp_extract_all(paragraph, F.lit(WORD), F.lit(0)), hashes)


def _counters(h: Column) -> Column:
    """For each of 64 bit positions, how many hashes have the bit: 16 numbers of four 16-bit fields."""
    fields, places = F.lit(_FIELDS).cast("bigint"), F.sequence(F.lit(0), F.lit(15))

    def shifted(g: Column, k: Column) -> Column:
        return F.call_function("shiftrightunsigned", g, k).bitwiseAND(fields)

    short = F.transform(places, lambda k: F.aggregate(h, F.lit(0).cast("bigint"), lambda s, g: s + shifted(g, k)))
    long = F.transform(places, lambda k: let(F.transform(h, lambda g: shifted(g, k)), _field_sum))
    return F.when(F.size(h) < 0x8000, short).otherwise(long)


def _seeded(values: Column, seed: int) -> Column:
    return F.transform(values, lambda x: F.xxhash64(x, F.lit(seed)))


def vector(text: Column) -> Column:
    """The vector of a text as an array of longs: equality lanes, number of shingles, likeness lanes."""

    def lanes(lines: Column) -> Column:
        equal = [_wrapping_sum(_seeded(lines, k)) for k in range(EQUAL_LANES)]

        def likeness_lanes(grams: Column) -> Column:
            seeded = [let(_seeded(grams, k), _counters) for k in range(1, SEEDS)]
            return F.concat(F.array(F.size(grams).cast("bigint")), _counters(grams), *seeded)

        return F.concat(F.array(*equal), let(F.flatten(F.transform(lines, shingles)), likeness_lanes))

    return let(paragraphs(text), lanes)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of two texts' paragraphs together, or with ``sign`` -1 that of ``a`` without those of ``b``."""
    one = F.lit(1).cast("bigint")

    def negative(x: Column) -> Column:
        return x if sign > 0 else _wrapping_sum(F.array(F.bitwise_not(x), one))

    def fields(x: Column, y: Column) -> Column:
        if sign > 0:
            return _field_sum(F.array(x, y))
        ones = F.lit(_FIELDS).cast("bigint")
        return _field_sum(F.array(x, F.bitwise_not(y), ones))

    e, lanes = EQUAL_LANES, 16 * SEEDS
    return F.concat(
        F.zip_with(F.slice(a, 1, e), F.slice(b, 1, e), lambda x, y: _wrapping_sum(F.array(x, negative(y)))),
        F.array(a[e] + F.lit(sign) * b[e]),
        F.zip_with(F.slice(a, e + 2, lanes), F.slice(b, e + 2, lanes), fields),
    )


def as_text(v: Column) -> Column:
    """A vector in hexadecimal."""
    return F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def signs(v: Column) -> Column:
    """The centred likeness lanes of a vector: bits set less bits clear."""
    n = v[EQUAL_LANES]

    def field(x: Column, k: int) -> Column:
        c = F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("bigint"))
        return (F.pmod(c * 2 - n + 65536, F.lit(131072)) - 65536).cast("double")

    return F.flatten(F.transform(F.slice(v, EQUAL_LANES + 2, 16 * SEEDS), lambda x: F.array(*(field(x, k) for k in range(4)))))


def likeness(a: Column, b: Column, signs_a: Column | None = None, signs_b: Column | None = None) -> Column:
    """Estimated share of common shingles, 0 to 1: the cosine of the centred lanes, and 1 for equal vectors."""
    x, y = signs(a) if signs_a is None else signs_a, signs(b) if signs_b is None else signs_b
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    norm = [F.sqrt(F.aggregate(z, F.lit(0.0), lambda s, p: s + p * p)) for z in (x, y)]
    cosine = F.try_divide(dot, norm[0] * norm[1])
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.0)))))


def with_next(docs: DataFrame, bucket_rows: int = 5000, max_buckets: int = 16_384) -> DataFrame:
    """``doc_id, text, next_text``: the text of the next document by ascending id (null ids first, equal ids by a hash
    of the text, then the text); after the last comes the first.

    Ids fall into buckets between approximate quantiles, found by a two-level search in constant arrays; an id that is
    several quantiles, and null, is cut into as many buckets by the hash. Each bucket is sorted by itself and ends with a
    copy of the next bucket's first row. So no task sorts all rows; only rows equal in id and text are never parted."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.withColumn("mark", F.shiftrightunsigned(F.xxhash64("text"), 1))
    count, known = d.agg(F.count("*"), F.count("doc_id")).first()
    k = max(1, min(max_buckets, -(-count // bucket_rows)))
    found = []
    if k > 1:
        found = d.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], max(100_000, 8 * k))).first()[0] or []
    splits = sorted(set(found))
    step = max(1, int(len(splits) ** 0.5))
    bucket = F.lit(0)
    if splits:
        tops = splits[::step]
        inner = F.array(*(F.array(*map(F.lit, splits[i : i + step])) for i in range(0, len(splits), step)))
        top = F.size(F.filter(F.array(*map(F.lit, tops)), lambda x: x <= F.col("doc_id")))
        bucket = F.when(F.col("doc_id").isNull() | (top == 0), F.lit(0)).otherwise((top - 1) * step + F.size(F.filter(F.get(inner, top - 1), lambda x: x <= F.col("doc_id"))))

    def part(n: Column) -> Column:
        """One of ``n`` equal ranges of the hash."""
        return F.floor(F.col("mark") / (F.lit(2.0**63) / n)).cast("int")

    # within a bucket of ids: null ids, then an id that is the bucket's border in parts, then the others
    nulls, often, rest = max(1, -(-(count - known) // bucket_rows)), Counter(found), F.lit(1 << 30)
    d = d.withColumn("ids", bucket.cast("int"))
    side = F.when(F.col("doc_id").isNull(), part(F.lit(nulls)) - (1 << 30)).otherwise(rest)
    if len(found) > len(splits):
        at, parts = F.col("ids") - 1, F.get(F.array(*(F.lit(often[x]) for x in splits)), F.col("ids") - 1)
        border = F.coalesce((F.col("doc_id") == F.get(F.array(*map(F.lit, splits)), at)) & (parts > 1), F.lit(False))
        side = F.when(border, part(parts)).otherwise(side)
    d = d.withColumn("bucket", F.struct("ids", side.alias("side"))).drop("ids")
    order = F.struct(F.col("doc_id").isNotNull().alias("a"), F.col("doc_id").alias("b"), F.col("mark").alias("m"), F.col("text").alias("c"))
    firsts = d.groupBy("bucket").agg(F.min(order).alias("f"))
    line = Window.orderBy("bucket")
    after = F.coalesce(F.lead("f").over(line), F.first("f").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = firsts.select(after.alias("f"), "bucket").select("f.b", "f.c", "f.m", "bucket", F.lit(1).alias("end"))
    rows = d.select(F.col("doc_id").alias("b"), F.col("text").alias("c"), F.col("mark").alias("m"), "bucket", F.lit(0).alias("end")).unionByName(ends)
    rows = rows.withColumn("v", vector(F.col("c")))
    w = Window.partitionBy("bucket").orderBy("end", F.col("b").asc_nulls_first(), "m", "c")
    rows = rows.withColumns({"next_text": F.lead("c").over(w), "next_v": F.lead("v").over(w)})
    return rows.where("end = 0").select(F.col("b").alias("doc_id"), F.col("c").alias("text"), "v", "next_text", "next_v")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edits: the last quarter of the code points replaced by the first as
    many of the next document."""
    d = with_next(docs)
    k = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - k), F.substring(F.col("next_text"), F.lit(1), k))
    d = d.withColumn("edited", edited).withColumn("edited_v", vector(F.col("edited")))
    d = d.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "v", "edited_v", "next_v", signs(F.col("v")).alias("s"), signs(F.col("edited_v")).alias("edited_s"), signs(F.col("next_v")).alias("next_s"))
    v, s = F.col("v"), F.col("s")
    return d.select("doc_id", "n_chars", "edited_sha256", as_text(v).alias("fingerprint"), as_text(F.col("edited_v")).alias("edited_fingerprint"), likeness(v, F.col("edited_v"), s, F.col("edited_s")).alias("near_edited"), likeness(v, F.col("next_v"), s, F.col("next_s")).alias("near_next"))
