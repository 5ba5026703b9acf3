"""Main text of web pages by tree scoring.

Each block of text (a run without a block tag inside) passes points to its container and half of them
to the container above: one, one more for every comma, and one for each 100 characters up to three.
A container's points are discounted by its link density and raised where its tag or names say that it
holds the article. The best container is kept with those of its siblings that are paragraphs, or
score near it. Menus, headers, footers, sidebars, notices, adverts, forms, comments and code are left out wherever they stand.

Defined cases: a null or empty page, or one without text, gives ''; of containers with equal scores the first is taken. Pages cut short are read as far as they go; a tag cut off at
the end is markup. Repeated rows give repeated results.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches

# HTML's element kinds, and words that name parts of pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes xmp svg math object canvas".split())
LEFT_OUT = frozenset("head nav footer aside form button select menu dialog fieldset audio video map datalist".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 hgroup header footer nav aside address blockquote pre ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "figure figcaption form fieldset details summary center hr dialog menu search".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "html", "body"}
UNWANTED = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|comments?|commentlist|disqus|respond|reply|replies"
    r"|cookies?|consent|notice|gdpr|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|widget|pagination|pager|skip|tags|toolbar|hidden)(?=$|[-_\s\d])",
    re.IGNORECASE,
)
WANTED = re.compile(r"(?:^|[-_\s])(?:article|articlebody|body|content|entry|main|post|story|text|blog|hentry)(?=$|[-_\s\d])", re.IGNORECASE)
UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>?|<[a-zA-Z][^>]*>?", re.DOTALL)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_SPACE = re.compile(r"\s+")


#: Elements open at once; deeper ones are read as if they stood beside each other, as browsers do.
DEPTH = 512


class Node:
    __slots__ = ("tag", "parent", "out", "points", "chars", "link_chars", "boost", "inside")

    def __init__(self, tag: str, parent: Node | None, out: bool, boost: float) -> None:
        self.tag, self.parent, self.out, self.boost = tag, parent, out, boost
        self.points = self.chars = self.link_chars = 0.0
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))


def _open(tag: str, attrs: str, parent: Node) -> Node:
    out, boost = parent.out or tag in LEFT_OUT, 1.0
    if tag == "header" and not (parent.inside or parent.tag in ("article", "main")):
        out = True
    if tag in ("article", "main"):
        boost = 3.0
    if attrs:
        for name, *values in _ATTR.findall(attrs):
            value, name = "".join(values), name.lower()
            if name in ("class", "id"):
                if tag not in ("html", "body", "article", "main") and UNWANTED.search(value) and not (WANTED.search(value) and not re.search(r"comment|sidebar|footer|menu|nav", value, re.IGNORECASE)):
                    out = True
                elif WANTED.search(value):
                    boost = max(boost, 1.5)
            elif name == "role":
                out = out or value.lower() in UNWANTED_ROLES
                boost = max(boost, 3.0) if value.lower() in ("main", "article") else boost
            elif name == "itemprop":
                boost = max(boost, 3.0) if value.lower() == "articlebody" else boost
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE)):
                out = True
    return Node(tag, parent, out, boost)


def _blocks(page: str) -> Iterator[tuple[Node, str, float]]:
    """The page's blocks in order: the element that a block stands in, its text, and how many of its characters are in links."""
    root = Node("", None, False, 1.0)
    here, links, depth, text, linked, pos, raw = root, 0, 0, [], [], 0, ""

    def block() -> tuple[Node, str, float] | None:
        nonlocal text, linked
        got = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        in_links = len(_SPACE.sub(" ", html.unescape("".join(linked))).strip()) if linked else 0
        text, linked = [], []
        at = here
        while at.tag and at.tag not in BLOCK and at.parent is not None:
            at = at.parent
        return (at, got, float(min(in_links, len(got)))) if got and not here.out else None

    def add(s: str) -> None:
        if s and not here.out:
            text.append(s)
            if links:
                linked.append(s)

    while True:
        if raw:  # nothing but its own end tag ends it
            m = re.compile(rf"</{re.escape(raw)}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(page, pos)
            if m is None:
                break
            pos, raw = m.end(), ""
            continue
        m = _TOKEN.search(page, pos)
        add(page[pos : m.start() if m else len(page)])
        if m is None:
            break
        pos, tag = m.end(), (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in BLOCK and (got := block()):
            yield got
        if tag == "br":
            add(" ")
        elif m["close"]:
            at = here
            while at.parent is not None and at.tag != tag:
                if tag not in BLOCK and at.tag in BLOCK:  # an inline end tag doesn't close blocks
                    at = root
                    break
                at = at.parent
            if at.parent is not None:
                while here is not at.parent:
                    if here.out and not here.parent.out:
                        text, linked = [], []
                    links, depth = links - (here.tag == "a"), depth - 1
                    here = here.parent
        elif tag in RAW:
            raw = "" if m["attrs"].endswith("/") and tag in ("svg", "math") else tag
        elif tag not in VOID:
            closing = ("p",) if tag in CLOSES_P else ()
            closing += {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "a": ("a",)}.get(tag, ())
            at, stop = here, {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}.get(tag, ())
            found = None
            while closing and at.parent is not None and at.tag not in stop and not (at.tag in BLOCK and at.tag not in closing):
                found, at = (at if at.tag in closing else found), at.parent
            if found is not None:
                while here is not found.parent:
                    links, depth = links - (here.tag == "a"), depth - 1
                    here = here.parent
            if depth >= DEPTH:
                links, depth, here = links - (here.tag == "a"), depth - 1, here.parent
            here, depth = _open(tag, m["attrs"] or "", here), depth + 1
            links += tag == "a"
    if got := block():
        yield got


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = list(_blocks(page))
    seen: dict[int, Node] = {}
    for node, text, in_links in blocks:
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        box = node.parent if node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "dd", "dt") and node.parent is not None else node
        above = box.parent
        for at, share in ((box, 1.0), (above, 0.5)):
            if at is not None:
                at.points += points * share
                seen[id(at)] = at
        at = node
        while at is not None:
            at.chars += len(text)
            at.link_chars += in_links
            at = at.parent
    if not seen:
        return ""

    def score(x: Node) -> float:
        return x.points * x.boost * (1 - x.link_chars / x.chars if x.chars else 0)

    best = max(seen.values(), key=score)
    # An article inside an article's wrapper: what surrounds the best container inside the same article belongs to it.
    at = best
    while at.parent is not None:
        at = at.parent
        if at.boost >= 3.0:
            best = at
    least, kept = max(5.0, 0.2 * score(best)), {id(best)}
    for x in seen.values():
        if x is not best and x.parent is best.parent and score(x) >= least and best.boost < 3.0:
            kept.add(id(x))
    out = []
    for node, text, in_links in blocks:
        at, keep = node, False
        while at is not None and not keep:
            keep, at = id(at) in kept, at.parent
        sibling = node.tag == "p" and node.parent is best.parent and best.boost < 3.0 and best.parent is not None
        # A long paragraph beside the best container may hold some links; a short one has to be a sentence without any.
        told = len(text) > 80 and in_links <= 0.25 * len(text) or not in_links and text.rstrip("\"')”’»").endswith((".", "!", "?", "…"))
        if keep or (sibling and told):
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 2):
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(page_id, url, page).mapInArrow(run, "page_id long, url string, text string, n_chars long")
