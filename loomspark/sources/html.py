"""HTML extraction: a small tolerant tree, a selector subset and Arrow-batched parsers.

Text comes in two modes: ``text`` strips every text node and joins with nothing, ``spaced``
joins with one blank. Unclosed paragraphs nest, as the standard library's parser sees them.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    __slots__ = ("attrs", "kids", "name", "page", "parent", "start", "stop")

    def __init__(self, name, attrs=None, parent=None, page=None):
        self.name, self.attrs, self.parent, self.kids = name, attrs or {}, parent, []
        #: the page's elements in document order; this one's place, and where what lies in it ends
        self.page, self.start, self.stop = page, 0, 0

    def walk(self, without: Node | None = None):
        stack = list(reversed(self.kids))
        while stack:
            n = stack.pop()
            if n is without and n is not None:
                continue
            yield n
            if isinstance(n, Node):
                stack.extend(reversed(n.kids))

    def texts(self, without: Node | None = None):
        return [t for n in self.walk(without) if isinstance(n, str) and (t := n.strip())]

    @property
    def text(self) -> str:
        return "".join(self.texts())

    @property
    def spaced(self) -> str:
        return " ".join(self.texts())

    def matches(self, step: tuple) -> bool:
        tag, ident, names, attrs = step
        if tag and tag != self.name or ident and self.attrs.get("id") != ident:
            return False
        if names:
            have = (self.attrs.get("class") or "").split()
            if not all(c in have for c in names):
                return False
        return all(a in self.attrs and _fits(self.attrs[a], how, v) for a, how, v in attrs)

    def found(self, selector: str):
        """What :meth:`select` gives, one at a time."""
        steps = _steps(selector)
        tag = steps[-1][0]
        places = self.page.by_tag.get(tag, ()) if tag else range(self.start + 1, self.stop)
        if tag:
            places = places[bisect_right(places, self.start) : bisect_left(places, self.stop)]
        for i in places:
            n = self.page.elements[i]
            if n.matches(steps[-1]):
                at, k = n.parent, len(steps) - 2
                while k >= 0 and at is not None and at is not self.parent:
                    k -= at.matches(steps[k])
                    at = at.parent
                if k < 0:
                    yield n

    def select(self, selector: str) -> list[Node]:
        """Descendants by tag, #id, .class, [attr], [attr="v"] and [attr^="v"] steps, in document order; ValueError for more."""
        return list(self.found(selector))

    def first(self, selector: str) -> Node | None:
        return next(self.found(selector), None)


def _fits(value: str, how: str, wanted: str) -> bool:
    return not how or (value.startswith(wanted) if how == "^" else value == wanted)


@lru_cache(1024)
def _steps(selector: str) -> list[tuple]:
    if re.search(r"[,>+~:*]", re.sub(r"\[[^\]]*\]", "", selector)) or not selector.strip():
        raise ValueError(f"selector {selector!r} has steps that are not supported")
    return [_step(x) for x in re.findall(r'(?:\[[^\]]*\]|[^\s\[])+', selector)]


def _step(x: str) -> tuple:
    attrs = [(name, (how or "=") if eq else "", value) for name, how, eq, value in re.findall(r"""\[([\w-]+)(?:(\^?)(=)["']?([^\]"']*)["']?)?\]""", x)]
    plain = re.sub(r"\[[^\]]*\]", "", x)
    return (re.match(r"[\w-]*", plain)[0] or "").lower(), next(iter(re.findall(r"#([\w-]+)", plain)), None), re.findall(r"\.([\w-]+)", plain), attrs


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = self.at = Node("#document", page=self)
        self.elements, self.by_tag = [self.top], {}

    def _add(self, tag, attrs) -> Node:
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at, self)
        n.start, n.stop = len(self.elements), len(self.elements) + 1
        self.elements.append(n)
        self.by_tag.setdefault(tag, []).append(n.start)
        self.at.kids.append(n)
        return n

    def _leave(self, until: Node | None) -> None:
        """Closes the open elements below ``until``."""
        while self.at is not until:
            self.at.stop = len(self.elements)
            self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        n = self._add(tag, attrs)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs)

    def handle_endtag(self, tag):
        n = self.at
        while n is not self.top and n.name != tag:
            n = n.parent
        if n is not self.top:
            self._leave(n.parent)

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    b._leave(None)
    return b.top


def hidden(a: Node) -> bool:
    """Links that a reader does not see or is told not to follow."""
    style = (a.attrs.get("style") or "").replace(" ", "").lower()
    return (
        "nofollow" in (a.attrs.get("rel") or "").lower().split() or "hidden" in a.attrs or (a.attrs.get("aria-hidden") or "").strip().lower() == "true"
        or "display:none" in style or "visibility:hidden" in style or re.search(r"opacity:0(\.0+)?(;|$)", style) is not None
    )


#: Fixed values of the page formats: selectors, patterns and labels below.
def cards(html: str, base: str) -> list[dict]:
    """Catalog cards. Chapters, status and age stand in the card's stat lines; an icon's word is no text."""
    out = []
    for card in parse(html).select("li.novel-item"):
        if (link := card.first("a[href]")) is None:
            continue
        href, head = link.attrs["href"], card.first("h4.novel-title")
        ident = re.search(r"/novel/([^/]+?)\.html", href)
        row = {"title": link.attrs.get("title") or (head.text if head else "") or link.text, "url": urljoin(base, href), "chapter_id": ident and ident[1], "chapters": None, "status": None, "updated_text": None}
        for line in card.select("div.novel-stats"):
            if (status := line.first("span.status")) is not None:
                row["status"] = status.text
                continue
            said = " ".join(line.texts(line.first("i")))
            if n := re.search(r"(\d+)\s+Chapters?", said, re.I):
                row["chapters"] = int(n[1])
            elif "ago" in said.lower():
                row["updated_text"] = said
        out.append(row)
    return out


def paragraphs(node: Node | None) -> str | None:
    """The texts of a node's paragraphs with a blank line between, else its own text, else null."""
    if node is None:
        return None
    return "\n\n".join(t for p in node.select("p") if (t := p.text)) or node.text or None


def metadata(html: str, base: str = "") -> dict:
    doc = parse(html)
    text = lambda q: n.text if (n := doc.first(q)) else None
    # value and label stand side by side; the last one labelled counts
    stats = [(s.first("small"), s.first("strong")) for s in doc.select("div.header-stats span")]
    status = [value and value.text for label, value in stats if label is not None and label.text.lower() == "status"]
    return {
        "alt_title": text("h2.alternative-title"), "author": text('div.author span[itemprop="author"]'), "rating": text("div.rating"), "status": status[-1] if status else None,
        "genres": [a.text for a in doc.select("div.categories ul li a")], "synopsis": paragraphs(doc.first("div.summary div.content")),
    }


def listing(html: str, base: str = "") -> dict:
    doc = parse(html)
    hits = [{"title": a.text, "url": a.attrs.get("href", "")} for a in doc.select("div.search_main_box_nu div.search_title a")]
    return {"hits": hits, "has_next": doc.first("div.digg_pagination a.next_page") is not None}


def link_texts(html: str, base: str = "") -> dict:
    return {"texts": [a.text for a in parse(html).select("div#genres a") if a.text]}


def chapter(html: str, n: int, phrases: tuple = ("advert",), least: int = 4, link_chars: int = 80, where: str = "div.chapter-content p", title: str = "h2", untitled: str = "Chapter {n}") -> dict:
    """Title and escaped paragraphs, without short ones, ones that hold a phrase and short ones with a link."""
    doc = parse(html)
    head = doc.first(title)
    kept = []
    for p in doc.select(where):
        t = p.text
        if len(t) < least or any(x in t for x in phrases) or (p.first("a") is not None and len(t) < link_chars):
            continue
        kept.append("<p>" + t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") + "</p>")
    return {"title": (head.text if head else "") or untitled.format(n=n), "body_html": "\n".join(kept)}


def release_frequency(doc: Node) -> str | None:
    """The bare text right after the heading that names it."""
    for h in doc.select("h5.seriesother"):
        if "release frequency" in h.text.lower():
            after = h.parent.kids[h.parent.kids.index(h) + 1 :][:1]
            if after and isinstance(after[0], str) and after[0].strip():
                return after[0].strip()
    return None


def series(html: str, base: str = "") -> dict:
    """The fields of a series page; the page's address is ``base``."""
    doc = parse(html)
    text = lambda q: n.text if (n := doc.first(q)) else None
    links = lambda q: [t for a in doc.select(q) if (t := a.text)]
    names = doc.first("div#editassociated")
    rated = (u.text for h in doc.select("h5.seriesother") if h.text.lower().startswith("rating") and (u := h.first("span.uvotes")))
    votes = next((m for t in rated if (m := re.search(r"\(([\d.]+)\s*/\s*5\.0,\s*([\d,]+)\s*votes?\)", t, re.I))), None)
    return {
        "url": base, "title": text(".seriestitlenu") or None, "associated_names": names.texts() if names else [], "genres": links("div#seriesgenre a"), "tags": links("div#showtags a"),
        "author": ", ".join(links("div#showauthors a") or links("a#authtag")) or None, "status": text("div#editstatus"), "groups": links('ol.sp_grouptable li span[style="padding-left:20px;"]'),
        "release_frequency": release_frequency(doc), "rating": votes and votes[1], "votes": votes and votes[2], "synopsis": paragraphs(doc.first("div#editdescription")),
    }


def outline(html: str, base: str = "") -> dict:
    """Of any page: language, title, links in order (absolute, without those a reader does not see) and
    number of paragraphs."""
    doc = parse(html)
    top, head = doc.first("html"), doc.first("title")
    return {
        "lang": top.attrs.get("lang") if top else None, "title": head.text if head else None,
        "links": [urljoin(base, a.attrs["href"]) for a in doc.select("a[href]") if not hidden(a)], "paragraphs": len(doc.select("p")),
    }


#: Parsers by name; a site may add its own.
PARSERS = {"cards": cards, "metadata": metadata, "listing": listing, "link_texts": link_texts, "series": series, "outline": outline}


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over the cores: a small file is one task to a reader, however long its pages take to parse."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def extract(df: DataFrame, parser, schema: str, key: str = "id", html: str = "html", base: str = "base", many: bool = False) -> DataFrame:
    """Rows (key, error, parsed: struct or array<struct>) for each page; a page that fails has its error as a value."""
    f = PARSERS[parser] if isinstance(parser, str) else parser
    kind = f"array<struct<{schema}>>" if many else f"struct<{schema}>"
    out = df.sparkSession.createDataFrame([], f"{key} {dict(df.dtypes)[key]}, error string, parsed {kind}").schema
    arrow = to_arrow_schema(out)

    def run(batches):
        for b in batches:
            keys, errors, parsed = b.column(0), [], []
            for page, root in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    parsed.append(f(page, root))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  the error is the value
                    parsed.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([keys.cast(arrow.field(0).type), pa.array(errors, pa.string()), pa.array(parsed, arrow.field(2).type)], schema=arrow)

    return df.select(F.col(key), F.col(html), F.col(base)).mapInArrow(run, out)
