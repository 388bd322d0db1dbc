"""What a site looks like, as data: selectors and patterns that the parsers read, and hooks that replace them.

A profile travels to the tasks in the parser's closure. A step that a site neither describes
nor hooks is known when the query is made, not in the middle of a job.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from urllib.parse import urlencode

from . import html as H


class Unsupported(NotImplementedError):
    """The site has no description of this step."""


@dataclass(frozen=True)
class IndexRules:
    link: str  # chapter link: id
    page: str  # the index page's own address: id
    number: str  # any link with a number
    count: str  # text that states the total
    title: str = "h1"


@dataclass(frozen=True)
class ChapterRules:
    address: str  # with {base}, {id} and {n}
    paragraphs: str = "p"
    title: str = "h2"
    untitled: str = "Chapter {n}"
    phrases: tuple[str, ...] = ()
    least: int = 4
    link_chars: int = 80


@dataclass(frozen=True)
class SearchRules:
    address: str
    item: str
    base: str = ""
    link: str = "a[href]"
    chapters: str | None = None
    method: str = "get"
    parameter: str = "q"
    more: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Site:
    key: str
    domains: tuple[str, ...]
    index: IndexRules | None = None
    chapter: ChapterRules | None = None
    search: SearchRules | None = None
    #: parsers by step ("index", "chapter", "metadata", "search") that go before the rules
    hooks: Mapping[str, Callable] = field(default_factory=dict)

    def parser(self, step: str) -> Callable:
        """The function of (page, base) for a step; Unsupported where the site has none."""
        if step in self.hooks:
            return self.hooks[step]
        rules = {"index": (self.index, parse_index), "chapter": (self.chapter, parse_chapter), "search": (self.search, parse_search)}.get(step)
        if rules is None or rules[0] is None:
            raise Unsupported(f"site {self.key!r} does not describe {step}")
        described, parse = rules
        return lambda page, base, *more: parse(described, page, base, *more)

    def search_request(self, query: str) -> tuple[str, str, str]:
        """(method, address, body) of a search; the answer is captured by whoever may use the network."""
        if self.search is None:
            raise Unsupported(f"site {self.key!r} does not describe search")
        sent = urlencode({**self.search.more, self.search.parameter: query})
        return ("post", self.search.address, sent) if self.search.method == "post" else ("get", f"{self.search.address}?{sent}", "")

    def chapter_address(self, base: str, ident: str, n: int) -> str:
        if self.chapter is None:
            raise Unsupported(f"site {self.key!r} does not describe chapter")
        return self.chapter.address.format(base=base, id=ident, n=n)


def parse_search(rules: SearchRules, page: str, base: str = "") -> list[dict]:
    """title, url and chapters of each result that has a link."""
    out = []
    for item in H.parse(page).select(rules.item):
        link = item.first(rules.link)
        if link is None or not link.attrs.get("href"):
            continue
        n = re.search(rules.chapters, item.spaced) if rules.chapters else None
        out.append({"title": link.attrs.get("title") or link.text, "url": H.urljoin(rules.base or base, link.attrs["href"]), "chapters": n and int(n[1])})
    return out


def parse_index(rules: IndexRules, page: str, base: str = "") -> dict:
    """title, chapter_id and total. The stated count goes before the greatest link number; links that a
    reader does not see do not count."""
    doc = H.parse(page)
    links = [a.attrs["href"] for a in doc.select("a[href]") if not H.hidden(a)]
    own = [m for h in links if (m := re.search(rules.link, h))]
    stated = next((m for t in doc.texts() if (m := re.search(rules.count, t))), None)
    numbers = [int(m[1]) for h in links if (m := re.search(rules.number, h))]
    head = doc.first(rules.title)
    page_id = re.search(rules.page, base)
    return {
        "title": (head.text if head else "") or "Unknown Novel", "chapter_id": own[0][1] if own else page_id and page_id[1],
        "total": int(stated[1]) if stated else max(numbers, default=None),
    }


def parse_chapter(rules: ChapterRules, page: str, base: str = "", n: int = 0) -> dict:
    """title and body_html of a chapter page."""
    return H.chapter(page, n, rules.phrases, rules.least, rules.link_chars, rules.paragraphs, rules.title, rules.untitled)


def site_for(sites: list[Site], host: str, key: str | None = None) -> Site:
    """The site named ``key``, else the one whose domain the host is or is under; LookupError else."""
    for s in sites:
        if s.key == key if key else any(host == d or host.endswith("." + d) for d in s.domains):
            return s
    raise LookupError(f"no site for {key or host!r}")
