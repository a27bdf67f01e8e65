"""HTML extraction by tag-path ratios.

A tolerant tokenizer yields text blocks with their root-to-leaf tag path (a step is an element's name and its class
names; inline elements belong to their block). Per path, running text (what is no link or menu) and punctuation are
aggregated and divided by the number of blocks; the two ratios are fused as sqrt(length ratio * (1 + punctuation ratio)),
up to ENOUGH, from where on a path is text beyond doubt, times the root of the path's share of the page's running text.

Scores are smoothed in two directions, upwards only. Along the page, runs of blocks of one path lend each other score with a Gaussian;
what a run lends shrinks by CLIMB for every element that has to be left to reach the other's surroundings, so a paragraph
vouches for headings and lists beside it and hardly for what stands outside its container. Along the path, a block has at
least VOTE times the score of the text directly inside one of the elements around it. A path's score is the mean of its
blocks', times the share of its text that is no link.

Names only weight a score: blocks in article and main elements count ARTICLE times, blocks in elements that HTML or their
class, id or role name as headers, footers, sidebars, notices, adverts, forms or reader comments NOISE times; words that
also name parts of articles ("discussion", "legal") count WEAK times inside articles. Content is every block whose
weighted score reaches THRESHOLD of the page's best, which counts at most ENOUGH.

Scale: one scan, no shuffle, Arrow batches of bounded size; work is linear in the page at any nesting depth. Defined
cases: null or empty html gives empty text; markup without text gives empty text; text outside any element is a block of
the page; unclosed elements end with their parent; hidden elements, scripts, styles and form controls are no text;
repeated rows and equal scores give equal results; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strider.llm.common import bounded_batches, table

THRESHOLD, ENOUGH, SIGMA, CLIMB, VOTE = 0.2, 150.0, 1.0, 16.0, 0.3
#: Weights by name.
ARTICLE, NOISE, WEAK, NAV = 3.0, 0.02, 0.8, 0.65
#: The least weighted score of a block; one letter in the page has 1.
LEAST = 0.45
#: Share that linked text keeps inside named articles, where a list of links may be one of references.
LINKED = 0.3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select noembed noframes xmp".split())
#: Elements that hold no text of the page.
CONTROLS = RAW | frozenset("head button option datalist dialog audio video canvas map".split())
NOISE_TAGS = frozenset("footer aside form label fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr output meter progress nobr blink".split())
P_CLOSERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
P_SCOPE = frozenset("article main section div td th li blockquote".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}

#: Words of class, id or role that name boilerplate; matched against whole words of the attribute.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner banners sponsor sponsored sponsors promo promos promoted "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager paginator toolbar topbar "
    "masthead footer sidebar sidebars aside complementary widget widgets "
    "sharing social socials sharebar newsletter subscribe signup login paywall comment comments commentlist respond disqus "
    "cookie cookies consent gdpr popup modal contentinfo".split()
)
#: Words that name boilerplate beside an article, but may name a part of it as well.
WEAK_WORDS = frozenset("header foot rail related recommended recommendations share subscription discussion replies reply notice notices notification alert overlay disclaimer copyright legal search searchbox form skip promotion crumbs crumb".split())
#: "with-sidebar" names the column beside a sidebar.
NEGATION = frozenset(("with", "has", "no", "without"))
#: Reader comments and teasers come as article elements too.
NO_ARTICLE = frozenset("comment comments reply replies related recommended sponsored promo advert ad".split())
_WORDS = re.compile(r"[a-z]+")
_ATTR = re.compile(r"""(?i)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HIDDEN = re.compile(r"""(?i)(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""")
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|[^<]+|<""", re.S)
#: After the last ">" nothing but comments and text can follow.
_REST = re.compile(r"<!--.*|<[!?].*|[^<]+|<", re.S)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCT = re.compile(r"[.,;:!?…、。，！？]")
_depth = lambda node: node.depth


def _weight(tag: str, words: set[str], inside: bool) -> float:
    """What an element's name, class, id and role say about its text; inside: of an article or main element."""
    if words & NEGATION:
        words = set()
    if tag in ("article", "main"):
        return NOISE if words & NO_ARTICLE else 1.0 if inside else ARTICLE
    if tag in NOISE_TAGS or words & NOISE_WORDS or (not inside and (tag == "header" or words & WEAK_WORDS)):
        return NOISE
    return NAV if tag in ("nav", "menu") else WEAK if words & WEAK_WORDS - {"header"} else 1.0


class Node:
    """An open element. path: number of its tag path; first, last: where it and its descendants are in page order."""

    __slots__ = ("tag", "parent", "path", "depth", "weight", "article", "block", "p", "link", "skip", "first", "last", "vote")

    def __init__(self, tag: str, parent: "Node | None", path: int, first: int):
        self.tag, self.parent, self.path, self.first, self.last, self.vote = tag, parent, path, first, math.inf, None
        self.depth, self.weight, self.article, self.link, self.skip = (parent.depth + 1, parent.weight, parent.article, parent.link, parent.skip) if parent else (0, 1.0, False, 0, False)
        self.block = self if tag not in INLINE or parent is None else parent.block
        self.p = self if tag == "p" else None if parent is None or tag in P_SCOPE else parent.p


class Block:
    """The text of one block element between two block boundaries. linked: characters of it in links, menu: in a menu."""

    __slots__ = ("node", "parts", "linked", "menu", "text", "score")

    def __init__(self, node: Node):
        self.node, self.parts, self.linked, self.menu, self.text, self.score = node, [], 0, node.link == 2, "", 0.0


def blocks(html: str) -> list[Block]:
    """The blocks with a text, in page order."""
    steps: dict[tuple[int, str, str], int] = {}
    root = node = Node("html", None, 0, 0)
    open_: dict[str, list[Node]] = {}
    out: list[Block] = []
    current: Block | None = None
    at, n, made = 0, len(html), 0
    low = None
    match, last_end = _TOKEN.match, html.rfind(">")

    def close(target: Node) -> Node:
        """Ends `target` and what is open inside; returns its parent."""
        x = node
        while True:
            x.last = made
            open_[x.tag].pop()
            if x is target:
                return x.parent
            x = x.parent

    while at < n:
        m = match(html, at) if at <= last_end else _REST.match(html, at)
        at = m.end()
        tag = m.group(2) if m.re is _TOKEN else None
        if tag is None:
            text = m.group()
            if node.skip or (text[0] == "<" and len(text) > 1):
                continue  # no text of the page, comment, declaration
            if current is None:
                if not text.strip():
                    continue
                current = Block(node.block)
                out.append(current)
            current.parts.append(unescape(text) if "&" in text else text)
            if node.link:
                current.linked += len(text.strip())
            continue
        tag = tag.lower()
        if m.group(1):  # an end tag closes down to its element; without one it is ignored
            if tag == "br" and current:
                current.parts.append(" ")
            elif open_.get(tag):
                target = open_[tag][-1]
                if tag in INLINE and target.depth < node.block.depth:
                    continue
                if target.block is target:
                    current = None
                node = close(target)
            elif tag == "p":
                current = None
            continue
        attrs = m.group(3)
        if tag in ("html", "body"):
            continue
        if tag in VOID:
            if tag == "hr":
                current = None
            elif tag == "br" and current:
                current.parts.append(" ")
            continue
        if tag in RAW:
            if attrs.endswith("/") and tag in ("svg", "math"):
                continue
            low = low or html.lower()
            end = low.find(f"</{tag}", at)
            at = n if end < 0 else (html.find(">", end) + 1 or n)
            continue
        if tag in P_CLOSERS and node.p:  # a paragraph ends where a block starts
            node = close(node.p)
        if tag in CLOSES:
            floor = max((open_[s][-1].depth for s in SCOPE[tag] if open_.get(s)), default=0)
            inside = [s[i] for s in map(open_.get, CLOSES[tag]) if s and (i := bisect_right(s, floor, key=_depth)) < len(s)]
            if inside:
                node = close(min(inside, key=_depth))
        if attrs.endswith("/") and tag not in INLINE and tag not in P_CLOSERS and "-" in tag:
            continue
        said = _ATTR.findall(attrs) if attrs else []
        names = " ".join(sorted({c for k, *v in said if k.lower() == "class" for c in "".join(v).split()})) if said else ""
        made += 1
        node = Node(tag, node, steps.setdefault((node.path, tag, names), len(steps) + 1), made)
        open_.setdefault(tag, []).append(node)
        words = {w for _, a, b, c in said for w in _WORDS.findall(_CAMEL.sub(" ", a or b or c).lower())} if said else set()
        node.weight *= _weight(tag, words, node.article)
        node.article = node.article or (tag in ("article", "main") and not words & NO_ARTICLE)
        node.link = 2 if tag in ("nav", "menu") else max(node.link, tag == "a")
        node.skip = node.skip or tag in CONTROLS or bool(attrs and _HIDDEN.search(attrs))
        if node.block is node:
            current = None
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out if b.text]


def ratios(found: list[Block]) -> tuple[dict[int, float], dict[int, float]]:
    """Per tag path the fused length and punctuation ratio, and the share of its text that is running text."""
    length: dict[int, int] = {}
    running: dict[int, int] = {}
    marks: dict[int, int] = {}
    count: dict[int, int] = {}
    fixed: dict[int, float] = {}
    for b in found:
        path, n, plain = b.node.path, len(b.text), max(0, len(b.text) - b.linked)
        length[path] = length.get(path, 0) + n
        running[path] = running.get(path, 0) + plain
        marks[path] = marks.get(path, 0) + (len(_PUNCT.findall(b.text)) if plain else 0)
        count[path] = count.get(path, 0) + 1
        fixed[path] = max(fixed.get(path, 0.0), LINKED if b.node.article and not b.menu else 0.0)
    whole = max(1, sum(running.values()))
    fused = {p: min(ENOUGH, math.sqrt(running[p] / count[p] * (1 + marks[p] / count[p]))) * math.sqrt(running[p] / whole) for p in count}
    return fused, {p: max(fixed[p], running[p] / length[p]) for p in count}


def _votes(found: list[Block], fused: dict[int, float]) -> None:
    """Every element's best score of text directly inside it or an element around it (the page itself does not count)."""
    text: dict[int, list] = {}
    for b in found:
        home = b.node.parent
        if home and home.parent:
            t = text.setdefault(home.first, [0.0, 0])
            t[0] += fused[b.node.path] * len(b.text)
            t[1] += len(b.text)
    for b in found:
        chain, x = [], b.node
        while x and x.vote is None:
            chain.append(x)
            x = x.parent
        best = x.vote if x else 0.0
        for x in reversed(chain):
            t = text.get(x.first)
            best = x.vote = max(best, t[0] / t[1]) if t else best


def path_scores(found: list[Block], sigma: float = SIGMA) -> dict[int, float]:
    """Per tag path the mean of its blocks' smoothed scores, linked text taken off."""
    fused, plain = ratios(found)
    _votes(found, fused)
    runs: list[list[Block]] = []
    for b in found:
        if not runs or runs[-1][0].node.path != b.node.path or runs[-1][0].node.parent is not b.node.parent:
            runs.append([])
        runs[-1].append(b)
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(reach + 1)]
    total: dict[int, float] = {}
    count: dict[int, int] = {}
    for i, run in enumerate(runs):
        here = run[0].node
        score, weights = fused[here.path], 1.0
        for j in range(max(0, i - reach), min(len(runs), i + reach + 1)):
            if j == i:
                continue
            there, w = runs[j][0].node.parent, kernel[abs(j - i)]
            while there and w > 1e-3 and not there.first <= here.first <= there.last:
                there, w = there.parent, w / CLIMB
            if w > 1e-3:
                score += w * fused[runs[j][0].node.path]
                weights += w
        total[here.path] = total.get(here.path, 0.0) + len(run) * max(fused[here.path], score / weights, VOTE * here.vote)
        count[here.path] = count.get(here.path, 0) + len(run)
    return {p: total[p] / count[p] * plain[p] for p in count}


def extract(html: str | None, threshold: float = THRESHOLD) -> str:
    """The main text: content blocks in page order joined by a blank line."""
    found = blocks(html) if html else []
    if not found:
        return ""
    scores = path_scores(found)
    weighted = [scores[b.node.path] * b.node.weight for b in found]
    bar = max(LEAST, threshold * min(ENOUGH, max(weighted)))
    return "\n\n".join(b.text for b, w in zip(found, weighted) if w >= bar)


def extracted(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id, url, text, n_chars of every page."""
    bounded_batches(pages.sparkSession)
    fields = pages.select(id_col, "url").schema

    def run(batches):
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, "url", "text", "n_chars"])

    return pages.select(id_col, "url", "html").mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


#: The main text of pages whose article is one `<article>` of h1 and p elements, as all pages of the test tables have it.
#: SQL has no tag paths, so this is not the method but its result.
ORACLE_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS a FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(a, '</?(h1|p)>', chr(1), 'g'), '<[^>]*>', ' ', 'g'), chr(1)) AS parts FROM a),
c AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(
  regexp_replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM b)
SELECT page_id, url, array_to_string(parts, chr(10) || chr(10)) AS text, CAST(length(array_to_string(parts, chr(10) || chr(10))) AS BIGINT) AS n_chars FROM c"""

QUERIES = {"op6_html": op6_html}
ORACLE = {"op6_html": ORACLE_SQL}
