"""The operators against brute force on small tables, with nulls, ties, repeats, empty tables and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, common, embedding_dedup, fingerprints, html_extract, mixing, packing, quality_lm, queries, token_output, url_filter
from tidemark.llm.ngram_join import NgramJaccard

DOC = "doc_id long, text string, lang string, source string, n_chars long, id long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 0) for i, t, lang, s in rows], DOC)


def words(rng, n, v=400):
    return " ".join(f"w{rng.randrange(v)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    rows = []
    for i in range(60):
        rows.append([i, words(rng, rng.randrange(0, 80)), "en", f"s{i % 3}"])
    base = words(rng, 120).split()
    for i in range(60, 90):
        w = list(base)
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        rows.append([i, " ".join(w), "en", None])
    rows += [[90, None, None, "s0"], [91, "", "en", "s0"], [92, " \n\t ", "de", "s1"], [93, "Just two", "en", "s1"], [94, "just TWO", "en", "s1"], [95, rows[3][1], "en", "s2"], [96, "long " * 5000, "en", "s2"], [97, "a\nb\nc", "en", "s0"], [98, "c\na\nb", "en", "s0"]]
    return [tuple(r) for r in rows]


def components(ids, links):
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (300, 300), (None, 4)]
    got, _ = common.connected_components(spark.createDataFrame(edges, "a long, b long"))
    want = components([*range(41), 100, 200, 201], [e for e in edges if None not in e and e[0] != 300])
    assert {r["node"]: r["component"] for r in got.collect()} == want
    empty, _ = common.connected_components(spark.createDataFrame([], "a long, b long"))
    assert empty.count() == 0


@pytest.mark.parametrize("n, num, chunk", [(3, 90, 512), (5, 80, 4), (1, 70, 3)])
def test_ngram_join(spark, corpus, n, num, chunk):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in NgramJaccard(n, num, 100, chunk=chunk).components(docs(spark, corpus)).collect()}
    sets = {}
    for i, t, *_ in corpus:
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    label = components(sets, links)
    assert got == {i: (len(sets[i]), label[i]) for i in sets}


def test_ngram_join_odd_tables(spark):
    assert NgramJaccard().components(docs(spark, [])).count() == 0
    rows = [(1, "a b c d", "en", "s"), (1, "a b c d", "en", "s"), (None, "a b c d", "en", "s"), (2, "a b c d", "en", "s")]
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in NgramJaccard().components(docs(spark, rows)).collect())
    assert got == [(-1, None), (1, 1), (1, 1), (2, 1)]
    shared = [(2, "a b c d", "en", "s"), (2, "x y z w", "en", "s"), (1, "x y z w", "en", "s"), (3, "a b c d", "en", "s"), (4, "p q r s", "en", "s"), (4, "p q r s", "en", "s"), (5, None, "en", "s"), (5, "p q r s", "en", "s")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in NgramJaccard().components(docs(spark, shared)).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 2, 1), (4, 2, 4), (4, 2, 4), (5, 0, 5), (5, 2, 4)]


def test_ngram_join_long_texts_and_hot_lists(spark):
    rng = random.Random(5)
    base = words(rng, 3000, 10**6).split()
    rows = []
    for i in range(70):  # long near copies, some of them similar only to a few others
        w = list(base)
        for _ in range(rng.randrange(90)):
            w[rng.randrange(len(w))] = f"y{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s"))
    for i in range(70, 100):  # one frequent passage
        rows.append((i, "the one passage that all of them hold " * 2 + words(rng, rng.randrange(3)), "en", "s"))
    got = {r["doc_id"]: r["component_id"] for r in NgramJaccard(3, 90, 100, chunk=6).components(docs(spark, rows)).collect()}
    sets = {i: set(zip(*(t.split()[k:] for k in range(3)))) for i, t, *_ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    assert got == components(sets, links)


def test_pack(spark, corpus):
    from tidemark.llm.tokens import encoder

    rows = packing.pack_documents(docs(spark, [*corpus, corpus[0], (None, "x", "en", "s")]), capacity=64, group_pieces=40).collect()
    ids = {i: np.frombuffer(b, "<u4") for i, b in zip([r[0] for r in corpus], encoder().encode([r[1] for r in corpus]))}
    bins = {}
    total = Counter()
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total[r["doc_id"]] += r["length"]
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert all(total[i] == (len(x) + 1) * (2 if i == corpus[0][0] else 1) for i, x in ids.items())
    assert packing.pack_documents(docs(spark, [])).count() == 0


def library_ids(text, end_id):
    """Ids by the tokenizers library itself."""
    import public_tokenizers
    import tokenizers

    global _library
    _library = globals().get("_library") or tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    return [*_library.encode(text or "", add_special_tokens=False).ids, end_id]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pack_pieces_are_exact(spark, corpus):
    """Every column against the library's ids, with the documents cut by the rule; and the number of sequences."""
    many = [(None, f"same id {i % 7}", "en", "s") for i in range(300)] + [(7, f"one id {i}", "en", "s") for i in range(300)]
    rows = [*corpus, corpus[0], *many]
    packed = packing.pack_documents(docs(spark, rows), capacity=64, group_pieces=100)
    want = Counter()
    for i, t, *_ in rows:
        ids = library_ids(t, 2)
        first = len(ids) % 64 or min(64, len(ids))
        cuts = [0, *range(first, len(ids) + 1, 64)]
        assert len(ids) > 64 or len(cuts) == 2
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, crc(ids[a:b])] += 1
    got = packed.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    report = packing.pack_report(packed, 64).first()
    assert report["sequences"] == len({r["sequence_id"] for r in got}) and report["tokens"] == sum(r["length"] for r in got)
    assert report["least"] <= report["sequences"] <= 1.06 * report["least"]


def test_pack_a_million_tokens(spark):
    rows = [(1, "a b c d " * 250_000, "en", "s"), (2, "x", "en", "s")]
    packed = packing.pack_documents(docs(spark, rows), group_pieces=64).cache()
    n = packed.where("doc_id = 1").agg(F.sum("length"), F.count("*"), F.count_distinct("sequence_id")).first()
    assert n[0] >= 10**6 and n[1] == n[2] == -(-n[0] // 1024)
    groups = packed.select(F.shiftright("sequence_id", 32).alias("g")).groupBy("g").count()
    assert groups.count() > 8
    packed.unpersist()


def test_tokens_against_the_library(spark, corpus, tmp_path):
    """All columns against the library, with one id in many rows and a document longer than a segment."""
    rows = [*corpus, *((5000, f"one id {i}", "en", "s") for i in range(40)), *((5000, "copy", "en", "s") for _ in range(40))]
    path = f"file://{tmp_path}/t"
    token_output.write_tokens(docs(spark, rows), path, segment_tokens=300)
    got = token_output.read_tokens(spark, path, ids_crc32=F.crc32("ids")).orderBy("start").collect()
    want = Counter((i, len(ids), crc(ids)) for i, ids in ((r[0], library_ids(r[1], 0)) for r in rows))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["doc_id"] for r in got] == sorted(r[0] for r in rows)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()


def test_tokens_round_trip(spark, corpus, tmp_path):
    from tidemark.llm.tokens import encoder

    path = f"file://{tmp_path}/t"
    token_output.write_tokens(docs(spark, [*corpus, (None, "first", "en", "s")]), path, segment_tokens=300)
    got = token_output.read_tokens(spark, path).orderBy("start").collect()
    order = [(None, "first"), *((r[0], r[1]) for r in sorted(corpus))]
    assert [r["doc_id"] for r in got] == [i for i, _ in order]
    at = 0
    for r, ids in zip(got, encoder().encode([t for _, t in order])):
        assert bytes(r["ids"]) == ids + b"\0\0\0\0" and r["start"] == at and r["n_tokens"] == len(ids) // 4 + 1
        at += r["n_tokens"]
    token_output.write_tokens(docs(spark, []), f"{path}0")
    assert token_output.read_tokens(spark, f"{path}0").count() == 0


def test_mix(spark, corpus):
    d = docs(spark, [*corpus, corpus[5]])
    spans, sizes = mixing.mix(d, block=16)
    rows = mixing.taken(spans, sizes).collect()
    assert len(rows) == len(corpus) + 1
    total, got, target = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        total[r["source"]] += r["size"]
        got[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert abs(sum(target.values()) - 1.5 * sum(total.values())) < 1e-6
    assert all(abs(got[s] - target[s]) <= 1 and target[s] <= 2 * total[s] for s in total)
    again = mixing.taken(*mixing.mix(d.repartition(5), block=16)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    slots = [r["source"] for r in spans.select("slot", "source").distinct().orderBy("slot").collect()]
    for s in total:  # every prefix is close to the shares
        share = target[s] / sum(target.values())
        for n in range(20, len(slots) // 2, 7):
            assert abs(slots[:n].count(s) - share * n) < 4
    assert mixing.taken(*mixing.mix(docs(spark, []))).count() == 0


def test_mix_is_the_plain_schedule(spark, corpus):
    """Spans against a plain walk through the schedule, with places taken from ``sizes``."""
    block = 16
    d = docs(spark, [*corpus, *corpus[5:9], *([corpus[7]] * 3)])
    spans, sizes = mixing.mix(d, block=block)
    rows = sizes.collect()
    size, target = Counter(), {}
    for r in rows:
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)}
    want, open_ = {}, set(order)
    while True:  # share out, fix what is above its cap, share out the rest
        left = (1.5 * sum(size.values()) - sum(want.values())) / sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] >= 2 * size[s]}
        if not above:
            break
        want |= {s: 2.0 * size[s] for s in above}
        open_ -= above
    want |= {s: left * weight[s] for s in open_}
    assert all(abs(want[s] - target[s]) < 1e-6 for s in order)
    for s in order:  # places lie one after the other
        at = 0
        for r in sorted((r for r in rows if r["source"] == s), key=lambda r: (r["at"], r["size"])):
            if r["size"]:
                assert r["at"] == at
                at += r["size"]
    used = [s for s in order if target[s] > 0]
    total = sum(target[s] for s in used)
    need = {s: math.ceil(target[s] / block) for s in used}
    ends = np.cumsum([target[s] for s in used]) / total
    slots, ranks = [], Counter()
    for i in range(int(total // block)):
        point = (i + 1) * 0.6180339887498949 % 1
        s = used[min(int(np.searchsorted(ends, point, side="right")), len(used) - 1)]
        slots.append((s, ranks[s]))
        ranks[s] += 1
    tail = sorted(((k, used.index(s), s) for s in used for k in range(ranks[s], need[s])))
    slots += [(s, k) for k, _, s in tail]
    where = {x: i for i, x in enumerate(slots)}
    plain = Counter()
    for r in rows:
        for p in range(2):
            begin = r["at"] + p * size[r["source"]]
            end = min(begin + r["size"], round(r["target"]))
            for k in range(begin // block, -(-end // block) if end > begin else 0):
                low, high = max(begin, k * block), min(end, (k + 1) * block)
                plain[where[r["source"], k], r["doc_id"], r["source"], r["at"], p, low - begin, high - low] += 1
    got = Counter((r["slot"], r["doc_id"], r["source"], r["at"], r["pass"], r["first"], r["n"]) for r in spans.collect())
    assert got == plain


def test_mix_odd_rows(spark):
    rows = [(7, "aa bb cc", "en", None), (7, None, "en", "aa bb cc"), (None, None, None, None), (None, "a b", "en", "s"), (None, "a b", "en", "s"), (3, "", "en", "s")] + [(9, "x y z", "en", "t")] * 3000
    got = mixing.taken(*mixing.mix(docs(spark, rows), block=4, bucket_rows=500)).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by = {(r["doc_id"], r["source"]): r["taken"] for r in got if r["doc_id"] == 7}
    assert by[7, "aa bb cc"] == 0 and by[7, None] > 0
    assert abs(sum(r["taken"] for r in got if r["source"] == "t") - next(r["target"] for r in got if r["source"] == "t")) <= 1
    clash = docs(spark, rows[:6]).withColumns({c: F.lit(1) for c in ("n", "row_key", "key_a", "at", "size", "slot", "bucket")})
    assert mixing.taken(*mixing.mix(clash)).count() == 6


def test_targets_refill(spark):
    t = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(t).collect()}
    assert got["a"] == 20 and got[None] == 0
    left = 1.5 * 2010 - 20
    assert abs(got["b"] - min(2000, left * 2 / 3)) < 1e-9 and abs(got["b"] + got["c"] - left) < 1e-9


def test_fingerprints(spark, corpus):
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs(spark, corpus)).collect()}
    order = sorted(r[0] for r in corpus)
    text = {r[0]: r[1] or "" for r in corpus}
    for k, i in enumerate(order):
        x, y = text[i], text[order[(k + 1) % len(order)]]
        n = len(x) // 4
        assert rows[i]["edited_sha256"] == hashlib.sha256((x[: len(x) - n] + y[:n]).encode()).hexdigest() and rows[i]["n_chars"] == len(x)
    assert rows[97]["fingerprint"] == rows[98]["fingerprint"] and rows[90]["fingerprint"] == rows[91]["fingerprint"]
    assert rows[3]["fingerprint"] == rows[95]["fingerprint"] != rows[4]["fingerprint"]
    assert rows[90]["near_next"] == 1.0 and rows[91]["near_next"] == 0.0
    assert fingerprints.fingerprint_edits(docs(spark, [])).count() == 0


def test_fingerprint_lanes_are_plain_counts(spark):
    """Lanes against counts of the bits of shingle hashes, and order, copies and null or one id in many rows."""
    text = "one two three four five six seven\nb\n\nb\neight nine"
    grams = ["one two three four five", "two three four five six", "three four five six seven", "b", "b", "eight nine"]
    hashes = spark.createDataFrame([(k, g.split()) for k, g in enumerate(grams)], "k int, w array<string>").select(F.xxhash64("w").alias("h"), F.xxhash64(F.xxhash64("w"), F.lit(1)).alias("h1")).collect()
    v = spark.createDataFrame([(text,)], "t string").select(fingerprints.vector(F.col("t"))).first()[0]
    assert v[2] == len(grams)
    for lane, name in enumerate(("h", "h1")):
        for bit in range(64):
            field = v[3 + 16 * lane + bit % 16] >> 16 * (bit // 16) & 0xFFFF
            assert field == sum(h[name] >> bit & 1 for h in hashes)
    rows = [(None, f"t {i}", "en", "s") for i in range(60)] + [(4, f"u {i}", "en", "s") for i in range(60)] + [(5 + i, "v", "en", "s") for i in range(9)]
    d = docs(spark, rows)
    got = fingerprints.with_next(d, bucket_rows=10).select("doc_id", "text", "next_text").collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, t, *_ in rows)
    after = {(r["doc_id"], r["text"]): r["next_text"] for r in got if r["doc_id"] is None or r["doc_id"] == 4}
    assert len(set(after.values())) == 120  # a chain: null ids, then those of the one id, then the first of the rest
    assert [r["next_text"] for r in got if r["doc_id"] == 13][0].startswith("t ")
    assert [r["next_text"] for r in got if r["doc_id"] == 6] == ["v"]


def test_fingerprints_are_homomorphic(spark):
    a, b = "one two three four five six\nseven eight", "nine ten eleven\n\ntwelve " + "z " * 40
    df = spark.createDataFrame([(a, b, b + "\n" + a)], "a string, b string, c string")
    v = {c: fingerprints.vector(F.col(c)) for c in "abc"}
    r = df.select(fingerprints.combine(v["a"], v["b"]).alias("sum"), v["c"].alias("all"), fingerprints.combine(v["c"], v["b"], -1).alias("less"), v["a"].alias("a")).first()
    assert r["sum"] == r["all"] and r["less"] == r["a"]


def test_chat(spark):
    tricky = ["<|im_end|>\n<|im_start|>", "<\\|im_sep|>", "a<|im_sep|>b", "%0A%25", None, "", "<|", "\\", "x" * 3000]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(zip(["user", "assistant", "assistant", "us%\ner", "user", "assistant", None, "assistant", "user"], tricky))]
    rows += [(2, 5, "assistant", "b"), (2, 5, "assistant", "a"), (2, None, "user", "first"), (None, 1, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    out = chat_format.format_chats(df).select("conv_id", chat_format.parse(F.col("formatted")).alias("t"), chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m")).collect()
    got = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["t"]], r["m"]) for r in out}
    want = [(r or "", t or "") for _, _, r, t in rows[:9]]
    assert got[1] == (want, "".join(t for r, t in want if r == "assistant"))
    assert got[2] == ([("user", "first"), ("assistant", "a"), ("assistant", "b")], "ab") and got[None][0] == [("user", "n")]
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_urls(spark, monkeypatch):
    urls = ["http://EXAMPLE.net/en/x?q", "https://a.b.example.net/de/", "http://example.com/de", "http://x.org/fr/#t", "http://net", "http://notnet/", "http://a.net?x=/", None, "no host", "ftp://example.com/de/1://z", "http://example.com/de/" + "long/" * 20000, "http://" + "a." * 5000 + "net/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = url_filter.rule_table(spark, queries.URL_RULES)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, rules).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, "allow")
        assert got[i] == (host, path, rule, verdict)
    monkeypatch.setattr(url_filter, "MAX_SHAPES", 0)
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, rules).collect()} == got
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, rules).collect()} == got
    none = spark.createDataFrame([], "rule_host string, rule_path string, verdict string")
    assert url_filter.judge(df, none).where("verdict = 'allow'").count() == len(urls)
    assert url_filter.judge(df.limit(0), rules).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        base = rng.normal(size=8) if i % 4 == 0 else base + rng.normal(size=8) * 0.05
        rows.append((i, base.tolist(), i % 2))
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, None, 0), (203, [0.0] * 8, 0), (204, [1.0, math.nan] * 4, 0), (205, rows[0][1], None), (206, [None] + [1.0] * 7, 1), (207, [math.inf] * 8, 1), (208, [2 * x for x in rows[0][1]], 0), (209, [], 1), (210, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df, 0.98, cell_rows=20, chunk=16).collect()}
    fine = {i: np.array(e) for i, e, label in rows if e and label is not None and None not in e and np.isfinite(e).all() and np.any(e)}
    label = {i: x for i, _, x in rows}
    links = [(a, b) for a in fine for b in fine if a < b and label[a] == label[b] and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] / np.linalg.norm(fine[a]) / np.linalg.norm(fine[b]) >= 0.98]
    root, n = components([r[0] for r in rows], links), Counter(x for p in links for x in p)
    assert got == {i: (n[i], root[i], i == root[i]) for i, *_ in rows} and len(links) > 20
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    clash = df.withColumns({c: F.lit(7) for c in ("e", "id", "cell", "home", "copies", "n", "salt", "d")})
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(clash, 0.98, chunk=1000).collect()} == got


def test_cells_hold_all_partners():
    rng = np.random.default_rng(4)
    x = embedding_dedup.unit(np.concatenate([c + rng.normal(size=(60, 16)) * 0.2 for c in rng.normal(size=(6, 16))]).tolist())
    pivots = embedding_dedup.farthest_first(x, 6)
    reach = math.sqrt(2 - 2 * 0.98)
    who, cell, home = embedding_dedup.cells(x, pivots, reach)
    own = dict(zip(who[home].tolist(), cell[home].tolist()))
    held = set(zip(who.tolist(), cell.tolist()))
    i, j = np.nonzero(x @ x.T >= 0.98)
    assert len(own) == len(x) and all((a, own[b]) in held for a, b in zip(i.tolist(), j.tolist()))
    assert len(who) < 2 * len(x)  # clusters keep most vectors in one cell


def kneser_ney(train, order):
    """Plain modified Kneser-Ney over bytes."""
    counts = {order: Counter(g for t in train for g in quality_lm.grams(np.frombuffer(t, np.uint8), order).tolist())}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g & ((1 << 8 * k) - 1) for g in counts[k + 1])
    cut = {}
    for k, c in counts.items():
        n = [max(1, sum(v == i for v in c.values())) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        cut[k] = [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i] if i else 1 - 2 * y * n[1] / n[0], 0.05), i + 0.95) for i in range(3)]

    def p(g, k):
        if k == 0:
            return 1 / 256
        g &= (1 << 8 * k) - 1
        own = {x: v for x, v in counts[k].items() if x >> 8 == g >> 8}
        if not own:
            return p(g, k - 1)
        total, d = sum(own.values()), cut[k]
        mass = sum(d[min(v, 3) - 1] for v in own.values())
        c = own.get(g, 0)
        return (c - d[min(c, 3) - 1] if c else 0) / total + mass / total * p(g, k - 1)

    return p


def test_quality(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(90):
        junk = i % 9 == 8
        t = " ".join(rng.choice(["the", "of", "stone", "river", "green"]) for _ in range(40))
        rows.append((i, t.upper().replace(" ", "!! ") if junk else t + ".", "en" if i % 2 else "fr", "s"))
        if i < 60:
            labels.append((i, int(not junk), 0))
    rows += [(100, None, "en", "s"), (101, "", None, "s"), (None, "the river", "en", "s"), (102, "the stone", "xx", "s"), (102, "the stone", "xx", "s")]
    model = quality_lm.QualityModel(order=3, shard_bytes=2000, least=3)
    lab = spark.createDataFrame(labels + [(0, 0, 0)], "doc_id long, quality int, toxic int")
    out = model.classify(docs(spark, rows), lab).collect()
    assert len(out) == len(rows)
    keep = {r["doc_id"]: r["keep"] for r in out}
    assert all(keep[i] == (i % 9 != 8) for i in range(90)) and not keep[100] and not keep[101] and keep[102]
    flags = {r["id"]: r["flag"] for r in model._packed(docs(spark, rows), lab).collect()}
    p = kneser_ney([r[1].encode() for r in rows if flags.get(r[0]) == 1], 3)
    for r in out:
        if r["doc_id"] in (5, 8, 102):
            text = next(x[1] for x in rows if x[0] == r["doc_id"]).encode()
            want = math.exp(-np.mean([math.log(p(g, 3)) for g in quality_lm.grams(np.frombuffer(text, np.uint8), 3).tolist()]))
            assert abs(r["perplexity"] / want - 1) < 1e-4
    # ids at both ends of a long, one id and null ids in many rows, and a long text
    far = [(-(2**63) + 5, rows[0][1], "en", "s"), (2**63 - 3, rows[1][1], "en", "s"), (400, "the green river " * 9000, "en", "s")]
    far += [(None, rows[i][1], "en", "s") for i in range(60)] + [(300, rows[i][1], "en", "s") for i in range(60)]
    wide = model.classify(docs(spark, rows + far), lab).collect()
    mean = {(r["lang"], r["n_bytes"], r["doc_id"]): r["perplexity"] for r in out}
    assert len(wide) == len(rows) + len(far)
    assert all(abs(r["perplexity"] / mean[r["lang"], r["n_bytes"], r["doc_id"]] - 1) < 1e-9 for r in wide if (r["lang"], r["n_bytes"], r["doc_id"]) in mean and r["doc_id"] is not None and r["n_bytes"])
    shards = model._shards(docs(spark, rows + far))
    held = model._packed(docs(spark, rows + far), lab).toArrow()
    size = Counter(shards(held["id"].combine_chunks(), held["mark"].combine_chunks()).tolist())
    assert len(size) > 8 and max(size.values()) < 60
    assert model.classify(docs(spark, []), lab).count() == 0
    assert model.classify(docs(spark, rows), lab.limit(0)).where("keep").count() == len(rows) - 2


def test_style_tree_cuts_templates(spark):
    page = "<body><div class=top>Same words on all pages</div><div class=text><p>{}</p><p>{}</p></div><div class=end>Call us</div></body>"
    rows = [(i, f"http://h.net/{i}", page.format(f"own text {i}", f"more {i * 7}")) for i in range(12)]
    rows += [(50, None, None), (51, "x", ""), (52, "http://one.net/", page.format("a", "b"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert all(got[i]["text"] == f"own text {i}\nmore {i * 7}" for i in range(12))
    assert got[50]["text"] == "" and got[51]["n_chars"] == 0 and "a\nb" in got[52]["text"]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_style_tree_is_the_plain_one(spark):
    """Composite importance against a plain recursion over the merged pages of a host."""
    rng = random.Random(6)
    pages = []
    for i in range(30):
        body = f"<div class=a><p>own {i % 9}</p>" + "<p>said by all</p>" * (i % 3) + "</div>"
        body += "<div class=b><span>menu</span><ul>" + "".join(f"<li>{w}</li>" for w in ("x", "y", "z")[: 1 + i % 2]) + "</ul></div>"
        body += f"<section><div><h3>{'news' if i % 5 else 'other'}</h3><p>{rng.randrange(4)}</p></div></section>" if i % 4 else ""
        pages.append("<div class=all>" + body + "</div>")
    df = spark.createDataFrame([(i, "http://h.net/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["path"]: (r["pages"], r["importance"], r["branch"]) for r in html_extract.style_tree(df).collect()}

    read = {}
    for p in pages:
        page = html_extract.Page(p)
        read.setdefault(page.text(), page)
    found, kids = {}, {}
    for page in read.values():
        for path, above in page.above.items():
            have = found.setdefault(path, {"m": 0, "styles": Counter(), "texts": Counter()})
            have["m"] += 1
            have["styles"].update(set(page.styles[path]))
            have["texts"].update({t for k, t in page.blocks if k == path})
            if above:
                kids.setdefault(above[-1], set()).add(path)

    def importance(path):
        x = found[path]
        if x["m"] == 1:
            return 1.0
        return inner(path)

    def inner(path):
        x = found[path]
        shown, m = sum(x["styles"].values()), x["m"]
        look = -sum(n / shown * math.log(n / shown) for n in x["styles"].values()) / math.log(shown + 2) if shown > 1 else 1.0
        texts = x["texts"]
        told = 1 - sum(n * math.log(n) / math.log(m + 2) for n in texts.values()) / sum(texts.values()) if texts else 0.0
        share = 0.9 ** len(x["styles"])
        parts = [(min(sum(texts.values()), m), told)] + [(found[k]["m"], inner(k)) for k in kids.get(path, ())]
        weight = sum(w for w, _ in parts)
        return (1 - share) * look + share * (sum(w * v for w, v in parts) / weight if weight else 0.0)

    def branch(path):
        return max(importance(path), *(branch(k) for k in kids.get(path, ()))) if kids.get(path) else importance(path)

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    assert set(got) == {signed(p) for p in found} and len(read) > 15
    for p in found:
        m, i, b = got[signed(p)]
        assert m == found[p]["m"] and abs(i - importance(p)) < 1e-9 and abs(b - branch(p)) < 1e-9


def test_style_tree_decides(spark):
    """Pages whose text changes through the tree, and articles that it leaves alone."""
    rows, want = [], {}

    def page(host, markup, text):
        want[len(rows)] = text
        rows.append((len(rows), f"http://{host}/{len(rows)}", markup))

    for i in range(14):  # without an article: what all pages say goes, wherever it stands
        page("plain.net", f"<div class=x><div class=q><p>Our house</p></div><div class=r><h2>T{i}</h2><p>own {i}</p></div><div class=q2>Write to us</div></div>", f"T{i}\nown {i}")
    for i in range(14):  # in an article: containers go, paragraphs and headings stay
        page("art.net", f"<article><h1>All</h1><p>said by all</p><p>own text {i}</p><div class=box>Get our letters</div><div class=y><p>mine {i}</p></div></article>", f"All\nsaid by all\nown text {i}\nmine {i}")
    for i in range(14):  # copies of one text are no template, whatever stands around them
        page("copy.net", f"<nav>{i}</nav><div class=r><p>the one text</p></div>", "the one text")
    for i in range(3):  # too few pages to tell
        page("few.net", f"<div class=q>Our house</div><p>own {i}</p>", f"Our house\nown {i}")
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got == want
    changed = [i for i, _, markup in rows if html_extract.main_text(markup) != got[i]]
    assert set(changed) == set(range(28))
    assert {r["page_id"]: r["text"] for r in html_extract.extract(df, broadcast_rows=0, salts=3).collect()} == want
    again = html_extract.extract(df.union(df)).collect()
    assert len(again) == 2 * len(rows) and all(r["text"] == want[r["page_id"]] for r in again)


def test_quality_trains_on_all_trusted(spark, monkeypatch):
    rng = random.Random(6)
    words = ["the", "of", "stone", "river", "green", "house", "walks"]
    ids = [*range(70), -1, -64, -(2**63) + 5, 2**63 - 3]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)), "en" if n % 3 else None, "s") for n, i in enumerate(ids)]
    rows += [(None, rows[3][1], "en", "s"), (200_000, rows[4][1], "en", "s"), (200_001, rows[4][1].upper() + "!! " * 40, "en", "s")]
    lab = spark.range(150_000).select(F.col("id").alias("doc_id")).union(spark.createDataFrame([(i,) for i in ids[70:]] * 2 + [(None,)], "doc_id long"))
    lab = lab.withColumns({"quality": F.lit(1), "toxic": F.lit(0)}).unionByName(spark.createDataFrame([(200_000, 0, 0)], "doc_id long, quality int, toxic int"))
    model = quality_lm.QualityModel(order=3, shard_bytes=2000, least=3)
    flags = {r["id"]: r["flag"] for r in model._packed(docs(spark, rows), lab).collect()}
    assert len(flags) == len(rows) and {i for i, f in flags.items() if f} == set(ids) and set(flags.values()) == {0, 1, 2}
    out = {r["doc_id"]: r for r in model.classify(docs(spark, rows), lab).collect()}
    texts = {i: t.encode() for i, t, *_ in rows}
    p = kneser_ney([t for i, t in texts.items() if flags[i] == 1], 3)
    mean = {i: -np.mean([math.log(p(g, 3)) for g in quality_lm.grams(np.frombuffer(t, np.uint8), 3).tolist()]) for i, t in texts.items() if flags[i] == 2 or i == 200_000}
    assert all(abs(math.log(out[i]["perplexity"]) / m - 1) < 1e-4 for i, m in mean.items())
    for lang in ("en", None):  # null shares the quantiles of all languages
        held = sorted(mean[i] for i, _, own, _ in rows if flags[i] == 2 and lang in (own, None))
        mid, high = (held[max(math.ceil(q * len(held)), 1) - 1] for q in (0.5, 0.99))
        assert all(abs(r["threshold"] - (mid + max(2 * (high - mid), 0.15))) < 1e-3 for r in out.values() if r["lang"] == lang)
    assert not out[200_001]["keep"] and all(out[i]["keep"] for i in ids)
    monkeypatch.setattr(quality_lm, "BROADCAST_ROWS", 0)
    assert {r["doc_id"]: r for r in model.classify(docs(spark, rows), lab).collect()} == out


def test_quality_folds_leave_nothing_out(spark):
    rng = random.Random(9)
    words = ["the", "of", "stone", "river", "green", "house", "walks"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(25)), "en" if i % 3 else "fr", "s") for i in range(60)]
    rows += [(70, rows[0][1].upper(), "en", "s"), (None, rows[1][1], "en", "s"), (71, None, "fr", "s"), (72, rows[2][1], None, "s")]
    lab = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(71, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_lm.QualityModel(order=3, shard_bytes=1000, least=3, folds=3)
    flags = {r["id"]: r["flag"] for r in model._packed(docs(spark, rows), lab).collect()}
    assert {i for i, f in flags.items() if f} == {*range(60), 71} and set(flags.values()) == {0, 1, 2, 3}
    out = {r["doc_id"]: r for r in model.classify(docs(spark, rows), lab).collect()}
    texts = {i: t.encode() for i, t, *_ in rows if t}

    def mean(i, p):
        return -np.mean([math.log(p(g, 3)) for g in quality_lm.grams(np.frombuffer(texts[i], np.uint8), 3).tolist()])

    whole = kneser_ney([texts[i] for i in range(60)], 3)
    assert all(abs(math.log(out[i]["perplexity"]) / mean(i, whole) - 1) < 1e-4 for i in (0, 7, 70, None, 72))
    apart = {f: kneser_ney([texts[i] for i in range(60) if flags[i] != f], 3) for f in (1, 2, 3)}
    scores = {i: mean(i, apart[flags[i]]) for i in range(60)}
    for lang in ("en", "fr", None):  # null shares the quantiles of all languages
        held = sorted(scores[i] for i, _, own, _ in rows[:60] if lang in (own, None))
        mid, high = (held[max(math.ceil(q * len(held)), 1) - 1] for q in (0.5, 0.99))
        assert all(abs(r["threshold"] - (mid + max(2 * (high - mid), 0.15))) < 1e-3 for r in out.values() if r["lang"] == lang)
    assert {i for i, r in out.items() if not r["keep"]} == {70, 71}
    # all trusted documents in one fold, or none at all: no thresholds
    for some in (lab.where("doc_id = 5"), lab.limit(0)):
        assert {r["doc_id"] for r in model.classify(docs(spark, rows), some).where("NOT keep").collect()} == {71}
    assert model.classify(docs(spark, []), lab).count() == 0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate((rng.normal(2, 0.01, 12_000), np.zeros(8_000), rng.random(7)))
    groups = {("a", "en"): x, ("a", None): x[11_000:13_000], ("b", None): x[:1]}
    rows = [(*k, "w", v) for k, some in groups.items() for v in some.tolist()]
    found, _ = quality_lm.exact_quantiles(spark.createDataFrame(rows, "part string, lang string, what string, x double"), [0.3, 0.5, 0.99])
    got = {(r["part"], r["lang"], r["level"]): (r["n"], r["x"]) for r in found.collect()}
    assert got == {(*k, q): (len(v), np.sort(v)[max(math.ceil(q * len(v)), 1) - 1]) for k, v in groups.items() for q in (0.3, 0.5, 0.99)}


def test_quality_sees_repeated_words(spark):
    rng = random.Random(4)
    vocabulary = ["the", "of", "stone", "river", "green", "house", "and", "walks", "water", "over", "hills", "deep"]
    good = [" ".join(rng.choice(vocabulary) for _ in range(60)) + "." for _ in range(120)]
    junk = ["the " * 50, "Stone. " * 30, "over the deep river " * 20, " ".join(f"{w} {w}" for w in good[0].split()), "and and " * 7]
    fine = ["the the river", "green green", "stone"]
    rows = [(i, t, "en" if i % 2 else "fr", "s") for i, t in enumerate(good + junk + fine)]
    lab = spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    out = quality_lm.QualityModel(order=3, shard_bytes=5000).classify(docs(spark, rows), lab).collect()
    keep = {r["doc_id"]: r["keep"] for r in out}
    assert [keep[i] for i in range(len(rows))] == [True] * 120 + [False] * 5 + [True] * 3
    n, same = quality_lm.word_repeats(["a b a b a b", None, "", b"x X x", "a", "b a"])
    assert n.tolist() == [6, 0, 0, 3, 1, 2] and same.tolist() == [4, 0, 0, 2, 0, 0]


def test_components_fail_unless_found(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="2 rounds"):
        common.connected_components(edges, max_rounds=2)
