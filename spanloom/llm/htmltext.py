"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their root-to-leaf tag path.  Each path gets
the length and the punctuation of its text over the number of its nodes; both
ratios are smoothed along the order in which paths first occur and fused by their
product, in logarithms, with the share of the text that is no link and, for paths through an
element that is boilerplate by its tag or by a word of its class, id or role, a low prior.
Paths whose fused score reaches the mean less half a deviation (of text by path) are strong.  The container is
the deepest path that holds nearly all text of strong paths (an ``article``, ``main`` or the
like that does is taken before a plain one).  A path below it is content if its
score, averaged with that of the text of the path above it (so that headings and short items of
an article count with the article), reaches SHARE of the threshold; all text of content paths
is the main text.  Only scripts, styles, hidden elements and the like are left out unscored.

Defined cases: null or empty html gives the empty text; broken or unclosed
markup is read as browsers would nest it (a block closes an open paragraph, elements nest to a
depth of DEEPEST at most); a page without markup is all text; pages of any length are read whole; repeated rows are
extracted each; an empty table gives an empty one; columns other than page_id, url and html
pass unused.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.storage import ship

# HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul br".split()
)
NO_TEXT = frozenset("script style noscript template head title select textarea input iframe object svg canvas option audio video math".split())
LOW_TAGS = frozenset("nav footer aside form button dialog menu label fieldset".split())
HEADER = frozenset(("header",))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span mark sub sup q cite abbr time kbd del ins".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_TAGS = frozenset(("article", "main"))
# Words of class, id and role that mark boilerplate or content.
SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners promo promos promotion promoted sponsor sponsored sponsors nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets footer foot copyright legal header masthead topbar toolbar comment comments commentlist discussion disqus replies reply respond reader readers cookie cookies consent gdpr notice notices banner alert popup modal overlay subscribe subscription newsletter signup login form forms search share sharing social related recommended recommendations pagination pager tags toc skip hidden complementary contentinfo".split()
)
MAIN_WORDS = frozenset("article content main post entry story body text maincontent articlebody".split())
#: Elements nest no deeper, as in browsers; deeper ones stand beside the last.
DEEPEST = 512
#: Prior of paths through boilerplate, and share of the threshold that content reaches.
LOW_PRIOR = 0.1
SHARE = 0.5
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?¡¿…]")


def _words(attrs: list[tuple[str, str | None]]) -> set[str]:
    """Lower-case words of class, id and role; camel case and joiners part words."""
    out: set[str] = set()
    for k, v in attrs:
        if k in ("class", "id", "role") and v:
            out.update(w.lower() for w in _WORD.findall(v))
    return out


class _Node:
    """An element: gone leaves it unscored; key is its step of a tag path, None for formatting."""

    __slots__ = ("tag", "parent", "depth", "gone", "low", "main", "inside", "link", "path")

    def __init__(self, tag: str, parent: "_Node | None", gone: bool = False, low: bool = False, main: bool = False):
        self.tag, self.parent, self.main = tag, parent, main
        self.depth = parent.depth + 1 if parent else 0
        self.gone = gone or bool(parent and parent.gone)
        self.low = low or bool(parent and parent.low)
        self.inside = main or bool(parent and parent.inside)
        self.link = tag == "a" or bool(parent and parent.link)
        above = parent.path if parent else ()
        self.path = above if parent is None or tag in FORMATTING and not low else (*above, tag + "-" * low + "+" * main)


class _Tree(HTMLParser):
    """Blocks of text, each with its element; block elements and br end a block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", None)
        self.blocks: list[tuple[_Node, list[tuple[_Node, str]]]] = [(self.root, [])]

    def _break(self) -> None:
        if self.blocks[-1][1]:
            self.blocks.append((self.at, []))
        else:
            self.blocks[-1] = (self.at, [])

    def _close(self, tag: str, stop: frozenset[str]) -> bool:
        node = self.at
        while node.parent is not None and node.tag != tag:
            if node.tag in stop:
                return False
            node = node.parent
        if node.parent is None:
            return False
        self.at = node.parent
        return True

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK and tag != "br":
            self._close("p", frozenset(("table", "td", "th", "button", "object", "li", "article", "section", "div")))
            if tag in ("li", "option"):
                self._close(tag, frozenset(("ul", "ol", "menu", "select", "table")))
            elif tag in ("dt", "dd"):
                self._close("dt", frozenset(("dl",))) or self._close("dd", frozenset(("dl",)))
            elif tag in ("td", "th"):
                self._close("td", frozenset(("tr", "table"))) or self._close("th", frozenset(("tr", "table")))
            elif tag == "tr":
                self._close("tr", frozenset(("table",)))
            elif tag == "body" or tag == "html":
                self._close("head", frozenset())
        words = _words(attrs)
        named = dict(attrs)
        hide = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in (named.get("style") or "").replace(" ", "").lower()
        main = tag in MAIN_TAGS or bool(words & MAIN_WORDS)
        low = tag in LOW_TAGS or (tag in HEADER and not self.at.inside)
        low = low or (tag not in ("html", "body", "article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6") and bool(words & SKIP_WORDS) and not main)
        if main and tag not in MAIN_TAGS and tag not in ("body", "html"):
            low = low or bool(words & SKIP_WORDS - {"header", "text", "form", "hidden", "reader"})
        if tag in VOID:
            if tag in BLOCK:
                self._break()
            return
        if self.at.depth >= DEEPEST:
            self.at = self.at.parent
        self.at = _Node(tag, self.at, tag in NO_TEXT or hide, low, main)
        if tag in BLOCK:
            self._break()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            if tag == "br":
                self._break()
            return
        stop = frozenset() if tag in BLOCK or tag in NO_TEXT or tag in LOW_TAGS else BLOCK - {"br"}
        if self._close(tag, stop) and tag in BLOCK:
            self._break()

    def handle_data(self, data: str) -> None:
        self.blocks[-1][1].append((self.at, data))

    def unknown_decl(self, data: str) -> None:
        """Marked sections are not text."""


class _Sums:
    """Length, punctuation, nodes and linked length of the text of a path."""

    __slots__ = ("length", "punctuation", "nodes", "linked", "low")

    def __init__(self, low: bool = False):
        self.length = self.punctuation = self.nodes = self.linked = 0
        self.low = low

    def add(self, length: int, punctuation: int, linked: int) -> None:
        self.length += length
        self.punctuation += punctuation
        self.nodes += 1
        self.linked += linked

    def ratios(self) -> tuple[float, float]:
        return self.length / self.nodes, self.punctuation / self.nodes

    def fused(self, ratios: tuple[float, float]) -> float:
        score = np.log1p(ratios[0] * (1 + ratios[1])) * (1 - self.linked / self.length)
        return float(score) * (LOW_PRIOR if self.low else 1.0)


def content_paths(nodes: list[tuple[_Node, str]]) -> set[tuple[str, ...]]:
    """The tag paths whose fused scores make them content."""
    leaf: dict[tuple[str, ...], _Sums] = {}
    inner: dict[tuple[str, ...], _Sums] = {}
    for node, text in nodes:
        linked = node.link and not (node.path and node.path[-1][:2] in HEADINGS)  # titles are often links
        own = (len(text), len(_PUNCT.findall(text)), len(text) if linked else 0)
        if node.path not in leaf:
            leaf[node.path] = _Sums(node.low)
        leaf[node.path].add(*own)
    paths = list(leaf)
    raw = np.array([leaf[p].ratios() for p in paths])
    kernel = np.array([0.25, 0.5, 0.25])
    smooth = np.stack([np.convolve(np.pad(raw[:, k], 1, mode="edge"), kernel, "valid") for k in (0, 1)], axis=1)
    score = {p: leaf[p].fused(tuple(r)) for p, r in zip(paths, smooth, strict=True)}
    plain = np.array([score[p] for p in paths if not leaf[p].low])
    if not len(plain):
        return set()
    weight = np.array([leaf[p].length for p in paths if not leaf[p].low], float)
    mean = np.average(plain, weights=weight)
    least = float(mean - 0.5 * np.sqrt(np.average((plain - mean) ** 2, weights=weight))) - 1e-9
    strong = {p for p in paths if not leaf[p].low and score[p] >= least}
    # Sums of paths above: of all text that is not boilerplate, and of strong text.
    held: dict[tuple[str, ...], int] = {}
    for p in paths:
        for k in range(len(p) + 1):
            if not leaf[p].low:
                s = inner.setdefault(p[:k], _Sums())
                s.length += leaf[p].length
                s.punctuation += leaf[p].punctuation
                s.nodes += leaf[p].nodes
                s.linked += leaf[p].linked
            if p in strong:
                held[p[:k]] = held.get(p[:k], 0) + leaf[p].length
    total = held[()]
    named = [q for q in held if q and q[-1].endswith("+") and q[-1].rstrip("-+") not in ("html", "body") and 2 * held[q] > total]
    if named:
        top = max(held[q] for q in named)
        named = [q for q in named if held[q] >= 0.9 * top]
        container = min((q for q in named if q[-1] == "article+"), key=len, default=None) or max(named, key=len)
    else:
        container = max((q for q in held if held[q] >= 0.9 * total and (not q or q[-1] != "p")), key=len)
    out = set()
    for p in paths:
        if p[: len(container)] != container:
            continue
        above = inner.get(p[: max(len(container), len(p) - 1)])
        around = above.fused(above.ratios()) * (1 - leaf[p].linked / leaf[p].length) if above else 0.0
        if leaf[p].low:
            around *= LOW_PRIOR
        if (score[p] + around) / 2 >= SHARE * least:
            out.add(p)
    return out


def main_text(html: str | None) -> str:
    """The text of the content paths: blocks in page order, joined by one space."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    nodes = [(n, t) for _, parts in tree.blocks for n, t in parts if not n.gone and t.strip()]
    if not nodes:
        return ""
    content = content_paths(nodes)
    out = []
    for _, parts in tree.blocks:
        text = "".join(t for n, t in parts if not n.gone and n.path in content)
        text = _SPACE.sub(" ", text).strip()
        if text:
            out.append(text)
    return " ".join(out)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its length in code points for every page."""
    ship(pages.sparkSession)

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
