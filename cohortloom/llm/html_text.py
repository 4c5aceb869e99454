"""Main text of pages: flat text blocks, classified by a decision tree over word counts and link density.

A page is cut into flat blocks at block tags. Each block has its word count, the share of its words inside
links, the same two of the blocks before and after, whether it stands in an article or main element, and its mark: 2 in
an element that is no part of an article by its tag or that holds comments or adverts by its name, 1 in one whose
role, class or id only names a place of the layout, 0 elsewhere. An article or main element undoes an
inherited mark of 1. A decision tree, grown here on a small labelled table of blocks, says which blocks are main text:
under a mark of 1 and outside of articles, words and the neighbours' words and links decide.

Defined cases: null or empty html, an empty table, or a page without main blocks, has an empty text or no rows. Broken
markup is read as far as it goes: a closing tag without its opening tag is ignored, an unclosed element ends with the
page, a head with the first tag of the body, and a form control without its end has no content. Pages of any length are
read whole. Repeated rows are judged alike, each on its own row; equally good splits of the tree go to the
earlier feature. Only page_id, url and html are read, so no name can clash.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from random import Random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Elements that close an open one of their own kind, and hold no context of their own.
FLAT_TAGS = frozenset("p li dt dd tr td th hr h1 h2 h3 h4 h5 h6 caption legend figcaption summary".split())
# The content of these is not text of the page: code, controls of forms, embedded documents, and the title, which is not shown in it.
SKIPPED_TAGS = frozenset("script style template iframe select option textarea button title".split())
RAW_TAGS = frozenset("script style iframe textarea title".split())
HEAD_TAGS = frozenset("head base link meta title style script noscript template html".split())
# Elements that are no part of an article.
ASIDE_TAGS = frozenset("nav footer aside form menu dialog".split())
# Words of role, class and id: contents that are no part of an article, and places of a layout, which may hold one.
FOREIGN_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus reply replies respond".split())
LAYOUT_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination toolbar sidebar sidebars side widget widgets footer foot colophon "
    "header masthead banner topbar cookie cookies consent gdpr "
    "notice notices alert popup modal overlay subscribe subscription newsletter signup login search share sharing social related recommended "
    "copyright legal disclaimer complementary contentinfo dialog".split()
)
# Beside these a word says that the element has, lacks or serves something, not what it is.
BEFORE_FEATURE = frozenset("no not non with without has is hide show use".split())
AFTER_FEATURE = frozenset("enabled disabled on off open closed visible hidden page layout results result free less".split())
MAIN_TAGS = frozenset("article main".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"\S+")
FEATURES = ("words", "links", "before_words", "before_links", "after_words", "after_links", "in_main", "mark")
_HEADING = frozenset("header masthead banner".split())


def _mark(tag: str, attributes: str, in_main: bool) -> int:
    """The mark of an element by itself. The header of an article is part of it; any other header is the page's."""
    if tag in ASIDE_TAGS or (tag == "header" and not in_main):
        return 2
    if tag in ("html", "body"):
        return 0
    mark = 0
    for name in " ".join(next((x for x in m.groups() if x), "") for m in _NAMES.finditer(attributes)).split():
        words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
        for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
            if before in BEFORE_FEATURE or after in AFTER_FEATURE:
                continue
            if word in FOREIGN_WORDS:
                mark = 2
            elif word in LAYOUT_WORDS and not (in_main and word in _HEADING) and tag not in MAIN_TAGS:
                mark = max(mark, 1)
    return mark


def flat_blocks(page: str | None) -> list[dict]:
    """The page's blocks in order: text, words, linked words, in_main, mark."""
    blocks: list[dict] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, int]] = []  # open elements: tag, in main, mark
    in_link = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            _, main, mark = stack[-1] if stack else ("", False, 0)
            n = text.count(" ") + 1
            blocks.append({"text": text, "words": n, "linked": min(linked, n), "in_main": main, "mark": mark})
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        text = entities.unescape(raw)
        parts.append(text)
        if in_link:
            linked += len(text.split())

    page, at, in_head = page or "", 0, False
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at and not in_head:
            say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if tag and tag not in HEAD_TAGS or tag == "head":
            in_head = tag == "head" and not m[1]
        if not tag:
            if m[0].startswith("<![CDATA[") and not in_head:
                say(m[0][9:].removesuffix("]]>"))
            continue
        closing = bool(m[1])
        if tag in SKIPPED_TAGS:
            if closing or m[3].rstrip().endswith("/"):
                continue
            if tag in RAW_TAGS:
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page) if tag in ("script", "style") else at
            else:
                at = _skip(page, at, tag)
            parts.append(" ")
        elif tag == "a":
            in_link = max(0, in_link - 1) if closing else 1
        elif tag in ("br", "wbr", "img", "input"):
            parts.append(" " if tag != "wbr" else "")
        elif tag in BLOCK_TAGS:
            flush()
            in_link = 0 if tag not in FLAT_TAGS else in_link
            _, main, mark = stack[-1] if stack else ("", False, 0)
            if tag in FLAT_TAGS and (closing or not _mark(tag, m[3], main)):
                if closing and any(x[0] == tag for x in stack[-1:]):
                    stack.pop()
                continue
            if closing:
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
                if depth is not None:
                    del stack[depth:]
                continue
            if tag in FLAT_TAGS and stack and stack[-1][0] == tag:
                stack.pop()  # a second <p> or <li> closes the first
            _, main, mark = stack[-1] if stack else ("", False, 0)
            own = _mark(tag, m[3], main)
            if tag in MAIN_TAGS and not main and mark < 2:
                stack.append((tag, own < 2, own))
            else:
                stack.append((tag, main, max(mark, own)))
    flush()
    return blocks


def _skip(page: str, at: int, tag: str) -> int:
    """End of a skipped element that may hold elements of its own kind; where it has none, nothing is skipped."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}\b[^>]*(?:>|\Z)", re.I).finditer(page, at):
        depth += -1 if m[1] else (0 if m[0].endswith("/>") else 1)
        if not depth:
            return m.end()
    return at


def features(blocks: list[dict]) -> list[tuple[float, ...]]:
    """The tree's inputs of each block; beyond the page's ends stands an empty block."""
    own = [(b["words"], b["linked"] / b["words"]) for b in blocks]
    padded = [(0, 0.0), *own, (0, 0.0)]
    return [(*own[i], *padded[i], *padded[i + 2], float(b["in_main"]), float(b["mark"])) for i, b in enumerate(blocks)]


# --- the labelled table: pages written for it, one block a line, + for main text and - for the rest

LABELLED = (
    """- <nav><ul><li><a href=/>Home</a></li>
- <li><a href=/news>News</a></li>
- <li><a href=/about>About us</a></li></ul></nav>
- <div class="ad">Buy two pay for one this week only.</div>
+ <article><h1>River levels fall after a dry spring</h1>
+ <p>The river stood at its lowest mark for ten years on Monday, the water board said in its weekly report to the council.</p>
+ <p>Rain is due.</p>
+ <p>Farmers along the lower valley have begun to use <a href=/wells>deep wells</a>, which the board allows only in summer months.</p></article>
- <footer>&copy; Valley Post. All rights reserved.</footer>""",
    """- <header><a href=/>The Daily Sheet</a> Tuesday edition
- <form>Search the site</form></header>
+ <main><h2>A short note</h2>
+ <p>Be.</p>
+ <p>See <a href=/a>the first list</a></p>
- <aside>Most read this week: old bridges</aside>
- <section id="comments">Anna wrote: I have never agreed with any of this and I will not begin to agree with it now.
- <p>Bert wrote: Nor have I.</p></section></main>
- <div id="footer">Contact <a href=/c>the office</a> for paper copies of this page.</div>""",
    """- <div class="cookie-notice">We use cookies to make this site better for every reader who comes here, and you can say no.</div>
- <div class="menu"><a href=/1>One</a> <a href=/2>Two</a> <a href=/3>Three</a></div>
+ <div><h1>How bread was baked before ovens had doors</h1>
+ <p>Loaves were set on warm stones and covered by a pot, on which the baker heaped the embers of the fire for an hour or more.</p>
+ <p>The crust was thick and the crumb was wet, but it kept well, and a household baked no more than once in seven or eight days.</p></div>
- <div><a href=/x>Next page</a> <a href=/y>Previous page</a></div>
- <div class="newsletter">Sign up to get our letters each Friday morning.</div>""",
    """- <a href=/>Start</a> <a href=/all>All pages</a>
+ <p>Snow fell over the hills in the night and the road to the upper farms was closed until the plough had passed at noon on Sunday.</p>
+ <p>School was shut.</p>
+ <p>By the evening the wind had turned and the snow on the lower fields was gone, though drifts stood at the walls for days to come.</p>
- <a href=/p>Print</a>
- <div class="related"><a href=/r>Roads closed again</a></div>
- <a href=#>Top</a>""",
    """- <div class="sidebar">Weather: mild and dry, with some cloud over the coast in the afternoon and light winds from the west.</div>
- <ul><li><a href=/l>Links to friends of this page</a></li>
- <li><a href=/m>More links</a></li></ul>
+ <div><p>The printing house moved to the square in the autumn of that year, and there it stayed until the last press was sold for scrap.</p>
+ <p>Of its books few are left, and those that are stand in three libraries, one of which has never let a reader see them at all.</p></div>
- <p class="advert">Old books bought and sold, best prices paid in the whole of the county, call at the shop or write to us.</p>
- <div><a href=/i>Imprint</a></div>""",
    """+ <article>One line alone.
- <div class="share"><a href=/t>Tell a friend</a></div>
+ <p><a href=/source>The source of this story, in full, on the pages of the archive</a></p>
- <form>Your name and your address</form></article>
- <aside><p>We have a new address, at the end of the long street behind the station, and all who know us are welcome there.</p></aside>""",
    """- <nav>Pages: one, two, three, four, five, six, seven, eight, nine, ten, eleven, twelve, thirteen, fourteen.</nav>
- <header>A page for all who keep bees, in the town and in the country, since the year the society was founded.</header>
+ <main><p>Swarms</p>
+ <ul><li>leave in May</li>
+ <li>rest on a branch</li></ul>
- <div class="notice">This page will close for repair on Sunday night from ten until the early hours of the morning.</div>
+ <p>and are gone.</p></main>
- <footer><p>Written by hand and kept by hand, with thanks to all who sent us pictures of their hives and of their gardens.</p></footer>""",
    """+ <article><h1>Tides</h1>
+ <p>The sea comes in twice a day and goes out twice a day, and those who live by it know the hours without a clock or a table.</p>
+ <p>It ebbs.</p></article>""",
    """- <a href=/>Home</a>
+ <div><h2>Clay</h2>
+ <p>Clay is dug in autumn and left in heaps for the frost to break, and in spring it is cut and trodden until it is of one kind.</p>
+ <p>Then it is moulded by hand, and the moulded bricks are dried under straw for some weeks before they are set in the kiln.</p></div>""",
    """+ <div><p>It was late.</p>
+ <p>The last of the boats had come in, the nets were hung on the wall of the old customs house, and no one was left on the quay.</p></div>""",
    """+ <p>Wood burns.</p>
+ <p>Stone does not, and so a house of stone outlives the people who build it, and theirs, and often the name of the place as well.</p>
+ <p>Straw burns too.</p>""",
    """- <div role="navigation">You are here: the town, the square, the hall, the stairs, the second floor, the last door on the left.</div>
+ <main>Hours
+ <p><a href=/one>Monday to Friday from nine to five</a></p>
+ <p><a href=/two>Saturday from nine to noon</a></p></main>""",
)

# More labelled pages, as layouts: each block has its sign, its tags, and how many words it has (a range for s, m, l and a;
# a number stands for itself). Each layout is filled in DRAWS times; a starred block stands two to four times.
LENGTHS = {"s": (1, 8), "m": (9, 15), "l": (20, 90), "a": (1, 90)}
DRAWS, DRAW_SEED = 16, 20240403
LAYOUTS = (
    # An article, whatever its blocks' sizes; comments, adverts and marked parts in it are not.
    """- <nav><a>s</a></nav> | + <article><h1>s</h1> | *+ <p>a</p> | + <p><a>m</a></p> | - <div class=share>m</div> | + <p>l</p> | - <div class=ad>a</div> | *+ <p>a</p> | - <section id=comments><p>a</p> | *- <p>a</p> | - </section></article><footer>a</footer>""",
    """- <div class=menu><a>s</a></div> | + <main>a | *+ <p>a</p> | - <aside>a</aside> | *+ <li>s</li> | + <p>l</p></main> | - <div class=sidebar>a</div> | - <footer>m</footer>""",
    """- <div class=sidebar>m</div> | + <div class=search><article>l | *+ <p>a</p> | - </article></div><form>a</form>""",
    # Prose outside of articles: long blocks, their headings, and short ones between them.
    """- <p><a>s</a></p> | - <p>s</p> | - <p><a>s</a></p> | + <h1>s</h1> | + <p>l</p> | + <p>s</p> | + <p>l</p> | + <p>m</p> | *+ <p>l</p> | - <p>8</p> | - <p><a>s</a></p>""",
    """- <div><a>m</a></div> | + <p>l</p> | + <h2>s</h2> | *+ <p>l</p> | - <p>7</p>""",
    """- <p>s</p> | *- <p>s</p> | - <p><a>m</a></p> | - <p><a>a</a></p> | - <p>9</p>""",
    # Names of a layout: prose among prose is the article, lone or short blocks are not.
    """- <div class=banner>s</div> | - <div class=menu><a>s</a></div> | + <div class=widget><h1>s</h1> | + <p>l</p> | *+ <p>l</p> | - </div><div class=footer>s</div> | - <div class=copyright>m</div>""",
    """- <div class=notice>l</div> | - <div class=menu><a>s</a></div> | - <div class=sidebar>l</div> | - <div class=share>s</div> | - <div class=newsletter>m</div>""",
    # Parts that are never the article.
    """- <footer>l | *- <p>l</p> | - </footer><form>a | - <p>l</p></form> | - <div class=comments><p>l</p> | *- <p>a</p> | - </div><div class=sponsor>l</div>""",
)


def drawn_pages() -> list[tuple[str, list[bool]]]:
    rng, out = Random(DRAW_SEED), []
    for layout in LAYOUTS * DRAWS:
        page, signs = [], []
        for block in layout.split(" | "):
            times = rng.randint(2, 4) if block.startswith("*") else 1
            sign, markup = block.lstrip("*").split(" ", 1)
            for _ in range(times):
                size = re.compile(r"(?:(?<=>)|^)(\d+|[smla])(?=<|$)")
                n = size.search(markup)[1]
                page.append(size.sub("w " * (int(n) if n.isdigit() else rng.randint(*LENGTHS[n])), markup, count=1))
                signs.append(sign == "+")
        out.append(("\n".join(page), signs))
    return out


def labelled_rows() -> list[tuple[tuple[float, ...], bool]]:
    """(features, main) of every block of the labelled pages."""
    rows = []
    for page in LABELLED:
        signs = [line[0] == "+" for line in page.splitlines()]
        blocks = flat_blocks("\n".join(line[2:] for line in page.splitlines()))
        rows += list(zip(features(blocks), signs, strict=True))
    for page, own in drawn_pages():
        rows += list(zip(features(flat_blocks(page)), own, strict=True))
    return rows


def grow(rows: list[tuple[tuple[float, ...], bool]], depth: int = 8, least: int = 1):
    """A binary tree of (feature, bound, below or equal, above); a leaf is True for main text. Gini impurity."""
    labels = [y for _, y in rows]
    if depth == 0 or len(set(labels)) == 1:
        return sum(labels) * 2 > len(labels)

    def impurity(part: list[bool]) -> float:
        return sum(n * (1 - n / len(part)) for n in Counter(part).values())

    best = None
    for f in range(len(FEATURES)):
        values = sorted({x[f] for x, _ in rows})
        for low, high in zip(values, values[1:], strict=False):
            bound = (low + high) / 2
            left = [y for x, y in rows if x[f] <= bound]
            right = [y for x, y in rows if x[f] > bound]
            if min(len(left), len(right)) >= least:
                cost = impurity(left) + impurity(right)
                if best is None or cost < best[0] - 1e-9:
                    best = (cost, f, bound)
    if best is None:
        return sum(labels) * 2 > len(labels)
    _, f, bound = best
    return f, bound, grow([r for r in rows if r[0][f] <= bound], depth - 1, least), grow([r for r in rows if r[0][f] > bound], depth - 1, least)


def as_column(tree, feature: list[Column]) -> Column:
    """The tree as a Spark expression over the feature columns."""
    if isinstance(tree, bool):
        return F.lit(tree)
    f, bound, below, above = tree
    return F.when(feature[f] <= bound, as_column(below, feature)).otherwise(as_column(above, feature))


_BLOCKS = "array<struct<text:string,words:int,linked:int,in_main:boolean,mark:int>>"


def _cut(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in series:
        yield pd.Series([flat_blocks(p) for p in pages], dtype=object)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks) for every row of (page_id, url, html).

    Python cuts the blocks; the features of neighbours and the tree are Spark expressions.
    """
    tree = grow(labelled_rows())
    cut = pages.select("page_id", "url", F.pandas_udf(_cut, _BLOCKS)("html").alias("blocks"))

    def of(block: Column, name: str) -> Column:
        if name == "words":
            return F.coalesce(block["words"], F.lit(0))
        return F.coalesce(block["linked"] / block["words"], F.lit(0.0))

    def is_main(block: Column, i: Column) -> Column:
        before, after = F.get("blocks", i - 1), F.get("blocks", i + 1)
        near = [of(b, name) for b in (block, before, after) for name in ("words", "links")]
        return as_column(tree, [*near, block["in_main"].cast("int"), block["mark"]])

    kept = F.transform(F.filter("blocks", is_main), lambda b: b["text"])
    text = F.array_join(kept, "\n\n")
    return cut.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.size("blocks").cast("long").alias("n_blocks"))
