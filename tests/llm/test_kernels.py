"""Pure kernels against plain re-statements."""

import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import common, html_extract, ngram_join, packing, quality_lm, token_output
from tidemark.llm.embedding_dedup import forest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbÉé \t\n\x85 1", max_size=30)), min_size=1, max_size=6), st.integers(1, 4))
def test_shingles(texts, n):
    for text, got in zip(texts, common.shingle_sets(texts, n)):
        w = WORD.findall(lower(text or ""))
        want = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        assert len(got) == len(want)


def test_words_across_windows():
    texts = ["aaa bbb " * 50, None, "c" * 500, "", "Aaa bbb"]
    small, big = common.word_hashes(texts, window=64), common.word_hashes(texts)
    assert (small[0] == big[0]).all() and (small[1] == big[1]).all()
    assert small[0][0] == small[0][-2]


def test_encoder_is_exact():
    tokens = pytest.importorskip("tidemark.llm.tokens")
    e = tokens.encoder()
    texts = ["a   b  c\n\n d \n e\t f", " x", "x ", "  ", "it's <|endoftext|> b", "a\0 b c", "é  ,, ..  1 22   ", None, "", "word, Word!! a'b don't\nnext line"] * 2
    assert e.encode(texts) == [e._whole(t) if t else b"" for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'!12<|>aeTé"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=8))
def test_encoder_fuzz(texts):
    """The cached encoder against the library's encoding of whole texts."""
    tokens = pytest.importorskip("tidemark.llm.tokens")
    e = tokens.encoder()
    want = [np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert e.encode(texts) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=400), st.data())
def test_borders_of_runs(lengths, data):
    s = token_output.Segment(token_output.encode_segment([b"\0\0\0\0" * n for n in lengths], 4))
    first = data.draw(st.integers(0, len(lengths)))
    last = data.draw(st.integers(first, len(lengths)))
    ends = np.concatenate(([0], np.cumsum(lengths)))
    assert s.borders(first, last).tolist() == ends[first : last + 1].tolist() == [s.select(i) for i in range(first, last + 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_packing(lengths):
    sizes = np.array(lengths, np.int64)
    bins = packing.improve(packing.best_fit_decreasing(sizes, 100), sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(0 < sizes[b].sum() <= 100 for b in bins)
    assert len(bins) <= len(packing.best_fit_decreasing(sizes, 100))


def test_local_search_empties_a_bin():
    sizes = np.array([6, 5, 5, 4], np.int64)
    assert len(packing.improve([[0], [1], [2], [3]], sizes, 10)) == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=200))
def test_elias_fano(lengths):
    ids = [np.arange(n, dtype="<u4").tobytes() for n in lengths]
    s = token_output.Segment(token_output.encode_segment(ids, 2))
    want = np.concatenate(([0], np.cumsum(lengths))).astype(int)
    assert list(s.borders()) == list(want)
    assert [s.select(i) for i in range(len(want))] == list(want)
    assert all(zlib.crc32(s.document(i).astype("<u4").tobytes()) == zlib.crc32(x) for i, x in enumerate(ids))


def test_elias_fano_space():
    ids = [np.zeros(1000, "<u4").tobytes()] * 5000
    low, a, b, c = token_output.encode_borders(np.full(5000, 1000))
    assert (len(a) + len(b) + c.nbytes) * 8 / 5000 < 2 + np.log2(1000) + 1 and len(ids) == 5000


def brute_links(sets, num, den):
    return {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) * den >= num * len(sets[i] | sets[j])}


def groups(n, links):
    label = list(range(n))
    for _ in range(n):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=1, max_size=14))
def test_local_links(sets):
    keys = [np.sort(np.array(sorted(s), np.uint64)) for s in sets]
    got = ngram_join.local_links(keys, np.arange(len(keys)), 80, 100)
    want = brute_links([frozenset(s) for s in sets], 80, 100)
    assert {(max(p), min(p)) for p in got} <= want
    assert groups(len(sets), got) == groups(len(sets), want)
    for i in range(len(keys)):
        for j in range(i):
            common_ = len(set(sets[i]) & set(sets[j]))
            assert ngram_join.suffix_bound(keys[i], keys[j]) >= common_
            assert ngram_join.similar(keys[i], keys[j], 80, 100) == ((i, j) in want)


def test_forest():
    nodes, roots = forest(np.array([5, 7, 9]), np.array([7, 8, 1]))
    assert dict(zip(nodes.tolist(), roots.tolist())) == {5: 5, 7: 5, 8: 5, 9: 1, 1: 1}


def test_grams():
    assert quality_lm.grams(np.frombuffer(b"ab", np.uint8), 3).tolist() == [10 << 16 | 10 << 8 | 97, 10 << 16 | 97 << 8 | 98]


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><nav>a</nav><div><h1>T &amp; x</h1><p>One <b>two</b>three<p>Four<ul><li>a<li>b</ul></div><aside>s</aside>", "T & x\nOne twothree\nFour\na\nb"),
        ("<article><h1>H</h1><p>x\n  y</p><div class='ad'>buy</div><form><p>f</p></form></article><footer>z</footer>", "H\nx y"),
        ("<div class=cookie-notice>c</div><main><p>m</p><section id=comments><p>c</p></section></main>", "m"),
        ("<p>a<script>if(a<b)'</p>'</script>b<style>p{}</style><!-- c --><p>&eacute;&#33;", "ab\né!"),
        ("<p>cut &am", "cut &am"),
        ("<p>a<b", "a"),
        ("", ""),
        (None, ""),
        ("<header><p>h</p></header><article><header><h1>t</h1></header><p>b</p></article>", "t\nb"),
        ("<ul><li><a href=1>x</a><li><a href=2>y</a></ul><p>text", "text"),
        ('<article><h2 class="section-header">Heading</h2><p>Body', "Heading\nBody"),
        ('<article><p>The share of the <span class="share">profit</span> is', "The share of the profit is"),
        ('<article><header class="post-header"><h1>Title</h1></header><p>b</article>', "Title\nb"),
        ('<div class="post"><p>text</p></div><div id="comments"><article class="comment"><p>c1', "text"),
        ('<article><p>a text that is long</p><section id="comments"><article><p>c1</article></section></article>', "a text that is long"),
        ('<article><p>a</p></article><article class="comment"><p>c</p></article>', "a"),
        ("<main><h1>T</h1></main><article><p>real article text", "T\nreal article text"),
        ("<main></main><article><p>real", "real"),
        ('<p title="5" tall">Hello', "Hello"),
        ("<p data-x=it's>Two", "Two"),
        ("x<y text</p><p>more", "x\nmore"),
        ("a < b and 3<4", "a < b and 3<4"),
        ('<div class="no-comments"><article><p>t</article></div>', "t"),
        ('<a title="a>b" href=x>l</a> t<br/>u<p / >v', "l t u\nv"),
        ("<!--> a --><p>b<!-- x --!>c</ >d</p>", "a -->\nbcd"),
        ("<b><p>x</b> more</p><p>y", "x more\ny"),
        ("<table><tr><td>a<p>b</td><td>c</table>d", "a\nb\nc\nd"),
        ('<article class="post comments-open"><p>x<p hidden>y<div style="display: none">z</div>', "x"),
        ('<div class="layout with-sidebar"><article><h1>T</h1><p>p</article></div><aside>s', "T\np"),
        ('<article><p>the whole long body</p><div class="share-links">tell</div><p class="ad">buy</p><ul class=newsletter><li>n</ul></article>', "the whole long body"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


def test_long_page():
    page = "<article>" + "<div>" * 3000 + "<p>x</p>" * 2000
    assert html_extract.main_text(page).count("x") == 2000


def test_packing_tries_resting_bins_again():
    rng = np.random.default_rng(12)
    sizes = rng.integers(204, 512, 60)
    bins = packing.improve(packing.best_fit_decreasing(sizes, 1024), sizes, 1024)
    assert sorted(i for b in bins for i in b) == list(range(60)) and max(sizes[b].sum() for b in bins) <= 1024
    assert len(bins) == 22 == -(-sizes.sum() // 1024)
