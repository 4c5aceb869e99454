"""HTML pages to section rows (A10): a small tag walker on a page at a time, everything after it native."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements dropped whole, marks of page furniture, and where content is looked for.
DROPPED_TAGS = {"script", "style", "nav", "footer", "header", "aside", "noscript", "svg", "form", "iframe"}
FURNITURE = re.compile(
    r"nav(?:igation)?|menu|footer|sidebar|cookie|banner|breadcrumb|social[-_]?share|share[-_]?button"
    r"|related[-_]?(?:links|articles|content)|advertisement|\bad[-_]|promo|subscribe|newsletter|site[-_]?search"
    r"|skip[-_]?to[-_]?content|back[-_]?to[-_]?top|comment(?:s)?[-_]?section|print[-_]?(?:button|page)",
    re.IGNORECASE,
)
ROOT_TAGS = ("main", "article")
ROOT_IDS = ("main-content", "content", "main")
ROOT_CLASSES = ("article-body", "field--name-body", "content-body", "page-content")
MIN_CONTENT_CHARS = 200
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4}

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_ENDS_PARAGRAPH = {"p", "div", "ul", "ol", "table", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6"}


class _Node:
    __slots__ = ("tag", "ident", "classes", "role", "kids")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag = tag
        self.ident = attrs.get("id") or ""
        self.classes = (attrs.get("class") or "").split()
        self.role = attrs.get("role") or ""
        self.kids: list[_Node | str] = []

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids)

    def walk(self) -> Iterator[_Node]:
        for kid in self.kids:
            if not isinstance(kid, str):
                yield kid
                yield from kid.walk()


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("root", {})
        self.path = [self.root]
        self.title: _Node | None = None

    def _close(self, tag: str) -> None:
        for depth in range(len(self.path) - 1, 0, -1):
            if self.path[depth].tag == tag:
                del self.path[depth:]
                return

    def handle_starttag(self, tag, attrs):
        here = self.path[-1].tag
        if here == "p" and tag in _ENDS_PARAGRAPH or here == tag and tag in ("li", "tr", "td", "th"):
            self.path.pop()
        node = _Node(tag, dict(attrs))
        if tag == "title" and self.title is None:
            self.title = node
        self.path[-1].kids.append(node)
        if tag not in _VOID:
            self.path.append(node)

    def handle_startendtag(self, tag, attrs):
        self.path[-1].kids.append(_Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        self.path[-1].kids.append(data)


def _clean(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def _prune(node: _Node) -> None:
    node.kids = [
        k
        for k in node.kids
        if isinstance(k, str) or not (k.tag in DROPPED_TAGS or FURNITURE.search(f"{' '.join(k.classes)} {k.ident}"))
    ]
    for kid in node.kids:
        if not isinstance(kid, str):
            _prune(kid)


def _content_root(tree: _Node) -> _Node:
    nodes = list(tree.walk())
    tests = [lambda n, t=t: n.tag == t for t in ROOT_TAGS]
    tests += [lambda n, i=i: n.ident == i for i in ROOT_IDS]
    tests += [lambda n, c=c: c in n.classes for c in ROOT_CLASSES]
    tests.append(lambda n: n.role == "main")
    for test in tests:
        found = next((n for n in nodes if test(n)), None)
        if found is not None and len(found.text().strip()) >= MIN_CONTENT_CHARS:
            return found
    return next((n for n in nodes if n.tag == "body"), tree)


def page_sections(html: str) -> tuple[str, list[tuple[int, str, str]]]:
    """Title and (level, heading, text) of the sections of one page, in page order."""
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    title = (_clean(parser.title.text()) if parser.title else "") or "Untitled"
    _prune(parser.root)
    sections: list[tuple[int, str, str]] = []
    level, heading, lines = 1, title, []

    def close_section() -> None:
        text = _clean("\n".join(lines))
        if text:
            sections.append((level, heading, text))
        lines.clear()

    for node in _content_root(parser.root).walk():
        if node.tag in HEADINGS:
            name = _clean(node.text())
            if name:
                close_section()
                level, heading = HEADINGS[node.tag], name
        elif node.tag in ("p", "li"):
            text = _clean(node.text())
            if text:
                lines.append(text if node.tag == "p" else f"- {text}")
        elif node.tag == "table":
            for row in (n for n in node.walk() if n.tag == "tr"):
                cells = [_clean(c.text()) for c in row.walk() if c.tag in ("td", "th")]
                if any(cells):
                    lines.append(" | ".join(c for c in cells if c))
    close_section()
    return title, sections


def html_sections(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """A10: one row per section; ``usable`` tells whether the page holds enough text.

    Pages go to Python a few at a time: an Arrow batch is counted in rows, and thousands of pages with their trees'
    texts and sections, copied as frames, would be held at once.
    """

    def rows(source: str) -> list[tuple]:
        title, sections = page_sections(source)
        usable = sum(len(h) + len(t) for _, h, t in sections) >= MIN_CONTENT_CHARS
        return [(title, i, lv, h, t, usable) for i, (lv, h, t) in enumerate(sections)]

    schema = "array<struct<title: string, section_idx: int, level: int, heading: string, text: string, usable: boolean>>"
    return pages.select(key, F.explode(F.udf(rows, schema, useArrow=False)(html)).alias("s")).select(key, "s.*")
