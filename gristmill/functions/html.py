"""Article extraction from HTML: title, metadata and the body found by stop words and link density.

The parser is the standard library's; it builds a small tree that tolerates
missing and surplus end tags. One Arrow UDF makes all fields in one pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "td", "tr", "table", "ul", "ol", "li", "pre", "article", "section", "h1", "h2", "h3", "h4", "blockquote", "body", "header", "footer", "nav"}
CLOSED_BY = {"p": BLOCKS - {"body"}, "li": {"li"}, "td": {"td", "tr"}, "tr": {"tr"}, "option": {"option"}}
DROPPED = {"script", "style", "noscript", "iframe", "form", "svg", "button", "select", "textarea"}
UNWANTED = re.compile(
    r"^(side|combx|retweet|menu|nav|foot(er)?$|ads?$|popup|breadcrumb|sponsor|share|social|related|comment|subscribe|toolbar|hidden|print|cookie|promo|widget|byline|caption)|(^|[-_ ])(advert|ads?|sidebar|comments?|footer|footnote|nav(bar|igation)?|menu|masthead|pagination)([-_ ]|$)",
    re.I,
)
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can did do for from had has have he her his if in into is it its more no not of on one or our out said she so some than that the their there they this to up was we were what when which who will with would you your"
    " der die das und ist nicht ein eine zu mit auf für von den im sich de la el los las que en y un una por con no es le les des et une est dans pour pas".split()
)
VIDEOS = re.compile(r"youtube|vimeo|dailymotion", re.I)


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "score")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children, self.score = tag, attrs, parent, [], 0.0

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in the order of the page; no recursion, so depth is no limit."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
                continue
            if node.tag in BLOCKS or node.tag == "br":
                out.append(" ")
            stack += reversed(node.children)
        return " ".join("".join(out).split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root", {}, None)

    def handle_starttag(self, tag, attrs):
        while self.at.tag in CLOSED_BY and tag in CLOSED_BY[self.at.tag]:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        if self.at.tag not in DROPPED:
            self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def longest_title_piece(title: str) -> str:
    """The longest piece of a title between ``|``, ``-``, ``»`` or ``:``, whichever sign comes first in this list."""
    title = " ".join(title.split())
    for sign in ("|", " - ", "»", ":"):
        if sign in title:
            return max((p.strip() for p in title.split(sign)), key=len)
    return title


def stop_words(text: str, words: frozenset[str] = STOP_WORDS) -> int:
    return sum(w in words or (not w.isalnum() and re.sub(r"\W+", "", w) in words) for w in text.lower().split())


def link_density(node: Node) -> float:
    """Share of words in links times the number of links."""
    links = [n for n in node.walk() if n.tag == "a"]
    words = len(node.text().split())
    return len(links) * sum(len(a.text().split()) for a in links) / words if links and words else float(bool(links))


def _clean(root: Node) -> None:
    """Drop scripts, forms and blocks named like menus or advertising; a div or span of text alone is a paragraph."""
    for node in list(root.walk()):
        label = [node.attrs.get(k, "") for k in ("id", "class", "name")]
        bad = node.tag in DROPPED or node.tag in ("nav", "footer", "aside") or (node.tag not in ("body", "html", "root", "article") and any(UNWANTED.search(x) for x in label if x))
        if bad and node.parent is not None:
            node.parent.children = [c for c in node.parent.children if c is not node]
    for node in root.walk():
        if node.tag == "div" and not any(isinstance(c, Node) and c.tag in BLOCKS for c in node.children):
            node.tag = "p"


def _siblings(nodes: list[Node]) -> dict[int, tuple[list[Node], int]]:
    """Of each node the nodes below its parent, and its place among them."""
    out = {}
    for parent in {id(n.parent): n.parent for n in nodes}.values():
        below = [c for c in parent.children if isinstance(c, Node)]
        out |= {id(c): (below, i) for i, c in enumerate(below)}
    return out


def best_node(root: Node) -> Node | None:
    """The node whose paragraphs have most stop words, with a boost for those near each other."""
    found = [n for n in root.walk() if n.tag in ("p", "td", "pre")]
    counts = {id(n): stop_words(n.text()) for n in found}
    good = [(n, counts[id(n)]) for n in found if counts[id(n)] > 2 and link_density(n) <= 1]
    place = _siblings([n for n, _ in good])
    start, tail = 1, len(good) * 0.75
    parents: dict[int, Node] = {}
    for i, (node, count) in enumerate(good):
        boost = 0.0
        siblings, at = place[id(node)]
        if any(s.tag == "p" and counts[id(s)] > 5 for s in siblings[max(0, at - 3) : at]):  # a paragraph of many stop words just before
            boost, start = 50 / start, start + 1
        if len(good) > 15 and i >= tail:
            penalty = (i - tail) ** 2
            boost = -penalty if penalty <= 40 else 5.0
        for up, share in ((node.parent, 1.0), (node.parent.parent, 0.5)):
            if up is not None:
                up.score += (count + boost) * share
                parents[id(up)] = up
    return max(parents.values(), key=lambda n: n.score, default=None)


def body_text(node: Node) -> str:
    """Paragraphs of a node, joined by empty lines; those of fewer than three stop words or of links are left out."""
    blocks = [n for n in node.walk() if n.tag in ("p", "pre", "td", "blockquote", "li") and not any(isinstance(c, Node) and c.tag in BLOCKS for c in n.children)]
    texts = [b.text() for b in blocks if link_density(b) <= 1]
    return "\n\n".join(t for t in texts if stop_words(t) >= 3)


def _meta(root: Node) -> dict[str, str]:
    out: dict[str, str] = {}
    for n in root.walk():
        if n.tag == "meta":
            key = (n.attrs.get("name") or n.attrs.get("property") or n.attrs.get("itemprop") or "").lower()
            if key and n.attrs.get("content"):
                out.setdefault(key, n.attrs["content"].strip())
    return out


PUBLISHED = ("article:published_time", "datepublished", "date", "dc.date", "dcterms.created", "pubdate", "publishdate")
MODIFIED = ("article:modified_time", "datemodified", "dcterms.modified", "last-modified", "og:updated_time")


def publish_date(meta: Mapping[str, str]) -> str | None:
    """The earliest published date, else the earliest modified one, as found."""
    for keys in (PUBLISHED, MODIFIED):
        found = sorted(meta[k] for k in keys if re.match(r"\d{4}-\d\d", meta.get(k, "")))
        if found:
            return found[0]
    return None


def best_image(root: Node, meta: Mapping[str, str], url: str | None) -> str | None:
    """The largest image by its stated size, no banners of more than five to one; else the linked or the shared one."""
    sized = []
    for n in root.walk():
        if n.tag == "img" and n.attrs.get("src"):
            try:
                w, h = int(n.attrs.get("width", "")), int(n.attrs.get("height", ""))
            except ValueError:
                continue
            if min(w, h) > 50 and max(w, h) <= 5 * min(w, h):
                sized.append((w * h, n.attrs["src"]))
    link = next((n.attrs.get("href") for n in root.walk() if n.tag == "link" and n.attrs.get("rel") == "image_src"), None)
    source = max(sized)[1] if sized else link or meta.get("og:image")
    return urljoin(url or "", source) if source else None


SCHEMA = "title string, description string, keywords string, canonical string, domain string, published string, tags array<string>, links array<string>, videos array<string>, image string, body string"


def extract(html: str | None, url: str | None = None, date: Callable[[Mapping[str, str]], str | None] = publish_date) -> dict:
    """All fields of SCHEMA; null html gives nulls and empty lists. date may be replaced by another reader of the metadata."""
    if html is None:
        return dict.fromkeys(("title", "description", "keywords", "canonical", "domain", "published", "image", "body")) | {"tags": [], "links": [], "videos": []}
    root = parse(html)
    meta = _meta(root)
    heads = [n.text() for n in root.walk() if n.tag == "title"]
    first = [n.text() for n in root.walk() if n.tag == "h1"]
    canonical = next((n.attrs.get("href") for n in root.walk() if n.tag == "link" and n.attrs.get("rel", "").lower() == "canonical"), None) or url
    links = [urljoin(url or "", n.attrs["href"]) for n in root.walk() if n.tag == "a" and n.attrs.get("href")]
    tags = sorted({n.text() for n in root.walk() if n.tag == "a" and "tag" in n.attrs.get("rel", "").lower().split()} - {""})
    videos = [n.attrs["src"] for n in root.walk() if n.tag in ("iframe", "embed", "video") and VIDEOS.search(n.attrs.get("src", ""))]
    image = best_image(root, meta, url)
    _clean(root)
    top = best_node(root)
    try:
        domain = urlsplit(canonical or "").hostname
    except ValueError:
        domain = None
    return {
        "title": longest_title_piece((heads or first or [meta.get("og:title", "")])[0]),
        "description": meta.get("description") or meta.get("og:description"),
        "keywords": meta.get("keywords"),
        "canonical": canonical,
        "domain": domain,
        "published": date(meta),
        "tags": tags,
        "links": links,
        "videos": videos,
        "image": image,
        "body": body_text(top) if top is not None else "",
    }


def article_udf():
    """Arrow UDF from the columns html and url to a struct of SCHEMA (made when called: it needs a session)."""

    @F.pandas_udf(SCHEMA)
    def article(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for html, url in batches:
            rows = [extract(h, u) for h, u in zip(html, url)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return article
