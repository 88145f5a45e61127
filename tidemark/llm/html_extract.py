"""Main text of web pages by site style trees.

A page's elements become a tree. What is no article by its nature goes: scripts, styles, menus, footers, sidebars,
forms and hidden elements, told by tag and role. ``main`` and ``article`` elements, but for reader comments, are the
main text where there are any, else the whole page is. Class words (share, related, cookie, ...) are a prior: outside
an article they remove any block but headings; inside, only containers that are no content element and that hold
less than half of the article's text, or other blocks whose class is just a word like ``ad``. Comments go by their words anywhere.

Pages of one host then meet in a style tree of element paths (tag, classes, id). For every path it holds how many pages
have it, its presentation styles (the sequences of child elements) and its contents (the texts of blocks at it).
Pages of equal text count once, so that copies of an article don't look like a template. Presentation importance is the
entropy of the styles, content importance one less the mean entropy of the contents over the pages; an element's
composite importance is ``(1 - gamma^styles)`` of its presentation's and ``gamma^styles`` of the mean of its children's
and contents', by pages. Entropies are to the base of the pages plus ``unseen``, so that few pages don't tell much,
and a single one nothing. Where no element of a branch reaches ``least``, the branch reads the same on page
after page, and is cut: outside articles any branch, inside articles containers that are no content element and that
hold less than half of the text. So headings, paragraphs, lists and tables of an article stay, though other pages repeat them.

The counts are sums over (host, path, feature), and importance is summed along paths, so a host may hold any share of
the pages. Elements deeper than ``DEPTH`` count for the tree at the path above.

Markup follows the HTML standard's rules for tags, attributes, comments and raw text; so a ``<`` before a letter
begins a tag, up to the next ``>`` outside quoted values.

Nulls and odd rows: null or empty html gives an empty text; a null url, or one without a host, counts under the host
""; broken or cut-off markup is read as far as it goes; very long pages are read whole, one at a time; repeated rows are
pages of their own, with equal texts; an empty table gives an empty result; extra columns are ignored."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, release, settle, slices
from tidemark.session import ship

# Element names of the HTML standard, and words of class names that tell what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("aside button canvas datalist dialog embed footer form head iframe input math menu nav noscript object script select style svg template textarea title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = HEADINGS | frozenset("p ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NEVER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer "
    "feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo "
    "promoted promotion recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
#: Whole class names or ids that alone remove a block inside an article, but for headings.
NEVER_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsored sponsor promo promotion newsletter cookie cookies breadcrumb breadcrumbs pagination".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Words beside which a comment word only says whether there are, or may be, comments.
COMMENT_STATES = frozenset("open closed on off enabled disabled allowed no has with without".split())

#: Levels of elements that the style tree tells apart.
DEPTH = 48

_WS = " \t\n\f\r"
_VALUE = rf"=[{_WS}]*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^{_WS}>\"'][^{_WS}>]*+)|(?=>|\Z))"
_ATTR = re.compile(rf"[{_WS}/]*+([^{_WS}/>][^{_WS}/>=]*+)(?:[{_WS}]*+{_VALUE})?+")
_PLAIN = re.sub(r"\((?!\?)", "(?:", _VALUE)
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![A-Za-z])[^>]*(?:>|\Z)"
    rf"|<(/?)([A-Za-z][^{_WS}/>]*+)((?:[{_WS}/]*+[^{_WS}/>][^{_WS}/>=]*+(?:[{_WS}]*+{_PLAIN})?+)*+[{_WS}/]*+)(>|\Z)",
    re.S,
)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDES = re.compile(r"display\s*:\s*none", re.I)


class Node:
    """An element. ``kind``: article, main or nothing; ``gone``: no main text by its nature; ``worded``: by a class
    word; ``named``: by a whole class name; ``talk``: comments; ``size``, ``linked``: characters of text in it, and of
    those in links; ``holds``: whether it holds an article."""

    __slots__ = ("tag", "kind", "sign", "children", "parent", "gone", "worded", "named", "talk", "size", "linked", "holds")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.sign, self.parent = tag, tag, parent
        self.kind = tag if tag in ("article", "main") else ""
        self.gone, self.worded, self.named, self.talk = tag in NEVER, False, False, False
        self.size, self.linked, self.holds = 0, 0, False
        self.children: list[Node | str] = []

    def describe(self, attrs: str) -> None:
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), html.unescape("".join(values))
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDES.search(value):
                self.gone = True
            elif name == "role":
                self.gone = self.gone or value.lower() in NEVER_ROLES
                if value.lower() in ("main", "article"):
                    self.kind = value.lower()
            elif name == "itemprop" and value.lower() == "articlebody":
                self.kind = self.kind or "article"
            elif name in ("class", "id"):
                self.sign += ("." if name == "class" else "#") + re.sub(r"\d+", "0", value)
                for label in value.split():
                    words = [w.lower() for w in _WORDS.findall(label)]
                    self.worded = self.worded or not NEVER_WORDS.isdisjoint(words)
                    self.named = self.named or label.lower() in NEVER_NAMES
                    self.talk = self.talk or any(w in COMMENT_WORDS and COMMENT_STATES.isdisjoint(words[max(0, k - 1) : k + 2]) for k, w in enumerate(words))


#: Elements whose start ends open elements of these kinds, up to the containers named.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_CELLS = frozenset("td th caption table".split())


def parse(page: str) -> Node:
    """A tree of elements and texts; unclosed and stray tags are mended simply."""
    root = Node("html", None)
    here, at = root, 0
    for_raw: dict[str, re.Pattern] = {}
    while (m := _TOKEN.search(page, at)) is not None:
        if m.start() > at:
            here.children.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if not m[4]:
            return root  # cut off inside a tag
        if tag in ("html", "body"):
            continue
        if m[1]:
            up, stops = here, (frozenset({"table"}) if tag in _CELLS else _CELLS) - {tag}
            while up is not root and up.tag != tag and (up.tag not in BLOCK if tag not in BLOCK else up.tag not in stops):
                up = up.parent
            if up.tag == tag and up is not root:
                here = up.parent
            continue
        if tag in BLOCK:
            up = here
            while up is not root and up.tag not in BLOCK:
                up = up.parent
            if up.tag == "p" or tag in HEADINGS and up.tag in HEADINGS:
                here = up.parent
        if tag in _ENDS:
            kinds, stops = _ENDS[tag]
            up = here
            while up is not root and up.tag not in stops:
                if up.tag in kinds:
                    here = up.parent
                    if tag != "tr":
                        break
                up = up.parent
        node = Node(tag, here)
        if m[3]:
            node.describe(m[3])
        here.children.append(node)
        if tag in RAW:
            close = for_raw.get(tag) or for_raw.setdefault(tag, re.compile(rf"</{re.escape(tag)}(?=[{_WS}/>])[^>]*>", re.I))
            end = close.search(page, at)
            if end is None:
                return root
            at = end.end()
        elif tag not in VOID and not (m[3].endswith("/") and tag not in BLOCK):
            here = node
    if at < len(page):
        here.children.append(page[at:])
    return root


def weigh(root: Node) -> None:
    """Set every element's ``size``, ``linked`` and ``holds``, without what is no main text by its nature."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [c for c in n.children if isinstance(c, Node) and not c.gone]
    for n in reversed(order):
        for c in n.children:
            if isinstance(c, str):
                n.size += len("".join(c.split()))
            elif not c.gone:
                n.size += c.size
                n.linked += c.linked
                n.holds = n.holds or bool(c.kind or c.holds) and not c.talk
        if n.tag == "a":
            n.linked = n.size


def main_elements(root: Node) -> list[Node]:
    """The outermost ``main`` and ``article`` elements with text that aren't comments; those under a class word only if
    there are no others. Without any, the whole page."""
    better: list[Node] = []
    worse: list[Node] = []
    stack = [(root, False)]
    while stack:
        n, worded = stack.pop()
        worded = worded or n.worded or n.named
        if n.kind and n.size:
            (worse if worded else better).append(n)
        else:
            stack += [(c, worded) for c in reversed(n.children) if isinstance(c, Node) and not c.gone and not c.talk]
    return better or worse or [root]


def removed(n: Node, inside: Node | None, content: bool, whole: int, low: bool, links: float) -> bool:
    """Whether an element is no main text. ``inside``: the article it stands in; ``content``: whether it stands in a
    paragraph, heading or other content element; ``whole``: the size of its article, or else of the page; ``low``: the
    style tree finds its branch of low importance; ``links``: the share of links that makes a list a menu."""
    if n.gone:
        return True
    if inside is not None:
        if n.tag in HEADINGS or n.tag not in BLOCK:
            return False
        if n.talk or n.named:
            return True
        return n.tag not in CONTENT and n.tag != "header" and 2 * n.size < whole and (n.worded or low)
    if n.talk:
        return True
    if n.kind or n.holds:
        return False
    if n.tag in HEADINGS:
        return low
    if content and n.tag not in BLOCK:
        return False
    if low or n.named or n.tag == "header" or n.worded and (2 * n.size < whole or n.tag not in BLOCK):
        return True
    return n.tag in ("ul", "ol", "div", "section", "table", "dl") and n.linked > links * n.size


class Page:
    """A page's main elements, and its blocks of text with the paths of the elements they stand in."""

    def __init__(self, page: str, cut: frozenset[int] = frozenset(), links: float = 0.7):
        root = parse(page)
        weigh(root)
        self.cut, self.links = cut, links
        #: by path: the paths above, and the children's signs of each element; then (path, text)
        self.above: dict[int, tuple[int, ...]] = {}
        self.styles: dict[int, list[tuple[str, ...]]] = {}
        self.blocks: list[tuple[int, str]] = []
        tops = main_elements(root)
        for top in tops:
            self._read(top, links if tops == [root] else 1.0)

    def _read(self, top: Node, links: float) -> None:
        held: list[str] = []
        owner = 0

        def close() -> None:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                self.blocks.append((owner, text))

        # items: element, path of the parent, paths above, article, in content, block's path; or text; or an end of block
        stack: list[tuple] = [(top, None, (), None, False, 0)]
        while stack:
            item, parent, above, inside, content, block = stack.pop()
            if item is None:
                close()
                owner = block
                continue
            if isinstance(item, str):
                held.append(item)
                continue
            path = xxhash.xxh64_intdigest(item.sign.encode("utf-8", "replace"), parent or 0) if len(above) < DEPTH else parent
            if item is not top and removed(item, inside, content, inside.size if inside is not None else top.size, path in self.cut, links):
                if item.tag in BLOCK:
                    close()
                elif item.tag not in ("script", "style", "template", "noscript"):
                    held.append(" ")
                continue
            if item.tag in VOID and item.tag not in BLOCK:
                held.append(" ")
                continue
            if item.kind == "article" or item.kind == "main" and not item.holds:
                inside = inside if inside is not None else item
            if path != parent and item.size:
                self.above.setdefault(path, above)
                self.styles.setdefault(path, []).append(tuple(c.sign for c in item.children if isinstance(c, Node) and not c.gone and c.size))
            if item.tag in BLOCK:
                close()
                stack.append((None, None, None, None, None, block))
                owner = block = path
                content = content or item.tag in CONTENT
            chain = (*above, path) if path != parent else above
            for c in reversed(item.children):
                stack.append((c, path, chain, inside, content, block))
        close()

    def text(self) -> str:
        return "\n".join(text for _, text in self.blocks)


def main_text(page: str | None, cut: frozenset[int] = frozenset(), links: float = 0.7) -> str:
    """The page's main text: blocks in page order, one a line. Branches at the paths ``cut`` go, unless nothing is left."""
    if not page:
        return ""
    return Page(page, cut, links).text() or (Page(page, links=links).text() if cut else "")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hash(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "replace")))


def features(page: str) -> tuple[int, list[tuple[int, int, int, list[int] | None]]]:
    """A hash of the page's text, and rows (path, kind, feature, paths above), each once: kind 0 its presence, 1 its
    presentation styles, 2 its contents. Presence has the paths above."""
    read = Page(page)
    found: dict[tuple[int, int, int], list[int] | None] = {}
    for path, above in read.above.items():
        found[_signed(path), 0, 0] = [_signed(p) for p in above]
        for style in read.styles[path]:
            found[_signed(path), 1, _hash(" ".join(style))] = None
    for path, text in read.blocks:
        if path in read.above:
            found[_signed(path), 2, _hash(text)] = None
    return _hash(read.text()), [(p, k, f, above) for (p, k, f), above in found.items()]


def host_column(url):
    rest = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    return F.lower(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0))


def style_tree(pages: DataFrame, gamma: float = 0.9, unseen: float = 2.0) -> DataFrame:
    """``host, path, pages, importance, branch`` of every element path of every host: its composite importance, and the
    largest one of its branch."""
    spark = pages.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "path", "kind", "feature", "page", "above"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            for part in slices(batch, 1, 64):
                rows = []
                for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    mark, found = features(page or "")
                    rows += [(host, path, kind, feature, mark, above) for path, kind, feature, above in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        settle()

    rows = pages.select(host_column(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    rows = rows.mapInArrow(run, "host string, path bigint, kind int, feature bigint, page bigint, above array<bigint>")
    # every page's text once
    once = rows.groupBy("host", "path", "kind", "feature", "page").agg(F.any_value("above").alias("above"))
    by_feature = once.groupBy("host", "path", "kind", "feature").agg(F.count("*").cast("double").alias("n"), F.any_value("above").alias("above"))
    n = F.col("n")
    parts = by_feature.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 0, n)).alias("pages"),
        F.sum(F.when(F.col("kind") == 1, n)).alias("shown"),
        F.sum(F.when(F.col("kind") == 1, n * F.ln(n))).alias("looks"),
        F.count_if(F.col("kind") == 1).alias("styles"),
        F.coalesce(F.sum(F.when(F.col("kind") == 2, n)), F.lit(0.0)).alias("read"),
        F.coalesce(F.sum(F.when(F.col("kind") == 2, n * F.ln(n))), F.lit(0.0)).alias("same"),
        F.first("above", ignorenulls=True).alias("above"),
    )
    parts, p1 = materialize(parts, "styles")
    # children's weights: pages of each child, and of own contents
    kids = parts.where(F.size("above") > 0).groupBy("host", F.element_at("above", -1).alias("path")).agg(F.sum("pages").alias("below"))
    own = F.least(F.col("read"), F.col("pages"))
    look = F.when(F.col("shown") > 1, (F.ln("shown") - F.col("looks") / F.col("shown")) / F.ln(F.col("shown") + unseen)).otherwise(1.0)
    told = F.when(F.col("read") > 0, 1.0 - F.col("same") / F.col("read") / F.ln(F.col("pages") + unseen)).otherwise(0.0)
    share = F.pow(F.lit(gamma), F.col("styles"))
    info = parts.join(kids, ["host", "path"], "left").withColumn("weight", own + F.coalesce("below", F.lit(0.0)))
    info = info.select("host", "path", "pages", "above", ((1 - share) * look + share * F.when(F.col("weight") > 0, own / F.col("weight")).otherwise(0.0) * told).alias("own"), (F.col("styles") * F.ln(F.lit(gamma)) - F.ln(F.greatest("weight", F.lit(1e-300))) + F.ln("pages")).alias("step"))
    info, p2 = materialize(info, "styles")
    # an element's importance is a sum over its branch: each part's own times the shares of the steps down to it
    steps = info.select("host", F.explode("above").alias("up"), "path").join(info.select("host", F.col("path").alias("up"), "step"), ["host", "up"])
    depth = steps.groupBy("host", "path").agg(F.sum("step").alias("steps"))
    placed = info.join(depth, ["host", "path"], "left").withColumn("log", F.coalesce("steps", F.lit(0.0)) + F.ln("pages"))
    placed, p3 = materialize(placed.select("host", "path", "pages", "above", "own", "log"), "styles")
    branch = placed.select("host", F.explode(F.concat("above", F.array("path"))).alias("up"), "path", "own", "log")
    ups = placed.select("host", F.col("path").alias("up"), F.col("log").alias("up_log"))
    value = F.sum(F.col("own") * F.exp(F.col("log") - F.col("up_log")))
    scored = branch.join(ups, ["host", "up"]).groupBy("host", "up").agg(value.alias("importance"))
    scored = placed.join(scored.withColumnRenamed("up", "path"), ["host", "path"]).select("host", "path", "pages", "above", F.when(F.col("pages") <= 1, 1.0).otherwise(F.col("importance")).alias("importance"))
    scored, _ = materialize(scored, "styles")
    release(spark, p1, p2, p3)
    best = scored.select("host", F.explode(F.concat("above", F.array("path"))).alias("path"), F.col("importance").alias("i")).groupBy("host", "path").agg(F.max("i").alias("branch"))
    return scored.join(best, ["host", "path"]).select("host", "path", F.col("pages").cast("bigint").alias("pages"), "importance", "branch")


def extract(pages: DataFrame, least: float = 0.2, gamma: float = 0.9, unseen: float = 2.0, broadcast_rows: int = 100_000, salts: int = 64) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row. Branches of importance below ``least`` are cut; up to
    ``broadcast_rows`` of their paths (8 bytes each) are broadcast, more meet the pages by host and one of ``salts``."""
    ship(pages.sparkSession)
    low = style_tree(pages, gamma, unseen).where(F.col("branch") < least)
    low, _ = materialize(low.groupBy("host").agg(F.collect_set("path").alias("cut")), "low")
    count = low.agg(F.coalesce(F.sum(F.size("cut")), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 64):
                texts = []
                for page, cut in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    texts.append(main_text(page, frozenset(x & (1 << 64) - 1 for x in cut or ())))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
        settle()

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_column(F.col("url")).alias("host"))
    if count <= broadcast_rows:
        rows = rows.join(F.broadcast(low), "host", "left")
    else:
        low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(low, ["host", "salt"], "left")
    return rows.select("page_id", "url", "html", "cut").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
