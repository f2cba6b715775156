"""Main text of web pages by composite text density.

A page becomes a tree of its block elements; inline markup belongs to the block around it, links are counted in it.
What cannot be text of an article (scripts, styles, form controls, ...) is not read. Every node has a density: its
characters per tag, raised or lowered by how few or many of them are in links, relative to the page. The node with the
greatest sum of its children's densities is the core of the article; the least density on the path from it up to the
body is the threshold, and within every node that reaches it, seen from the body, the subtree of the greatest sum is
content too. Text with nothing below it has no sum and is content only within what is chosen. Prose (headings and
paragraphs, nothing loose, few links) next to what is chosen belongs to it, however short it is.

Kinds (footer, aside, ...), roles, classes and ids only weigh: the density of a node that they mark, and of all below
it, counts MARKED times as much; menus are left to their links. A mark on what holds the title and most of the page's
text tells of the layout and weighs nothing. Within content, a block below the threshold goes if it is marked, or is
nothing but links.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, parts

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object".split())
CUT = RAW | frozenset("button select option optgroup datalist head canvas audio video map annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mmultiscripts mtable mtr mtd mstyle mspace mpadded semantics".split()
)
BESIDE = frozenset("nav header footer aside form fieldset dialog menu".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
#: Words that mark an element as beside the article, if a class or id has no other words than these and SIDE_WORDS.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion sidebar aside menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead banner cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "comment comments disqus recommended recommendations widget toolbar pagination pager".split()
)
#: Words that an article may use as well; they need a word of controls beside them.
WEAK_WORDS = frozenset("alert notice notices related replies reply respond search side skip".split())
CONTROL_WORDS = frozenset("articles bar button buttons form icons items link links posts stories".split())
SIDE_WORDS = CONTROL_WORDS | frozenset("area block bottom box container content global inner left list main page panel primary right secondary section site slot thread top unit wrap wrapper".split())
#: Threads can be longer than the article.
THREAD_WORDS = frozenset("comment comments disqus replies reply respond".split())
#: Elements whose class, id or role says nothing.
UNMARKED = frozenset("html body main article p h1 h2 h3 h4 h5 h6".split())

#: Kinds and roles that name links alone.
MENUS = frozenset("nav menu navigation menubar".split())
#: Elements that text of an article stands in, rather than loose in a container.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption li dt dd td th caption".split())
#: Mark of what a class or id puts in doubt.
DOUBTFUL = "doubtful"
UNWEIGHED = frozenset(("", DOUBTFUL))
_RIGHTS = re.compile(r"\s*(?:©|\(c\)|copyright\b)", re.I)

#: What a mark multiplies a density with.
MARKED = 1 / 1000
#: Links from which a block of nothing but links is a menu.
MENU_LINKS = 3

_TOKEN = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|/([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z0-9]+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}
_TELLING = re.compile(r"class|id|role|hidden", re.I)
#: Elements that end at the next of the same kind, and those that keep an outer one open.
_SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
_HOLDERS = frozenset("ul ol dl table".split())
_P_HOLDERS = frozenset("table td th button object".split())


def is_beside_name(mark: str) -> bool:
    """Whether a class or id names nothing but a part beside the article: "sidebar-left", not "search-results-explained"."""
    words = set(_WORD.findall(mark))
    if not words <= NOISE_WORDS | WEAK_WORDS | SIDE_WORDS:
        return False
    return bool(words & NOISE_WORDS or words & WEAK_WORDS and words & CONTROL_WORDS)


def is_doubtful_name(mark: str) -> bool:
    """Whether a class or id may name such a part, so that what it marks is not article by being prose alone."""
    words = set(_WORD.findall(mark))
    return bool(words & WEAK_WORDS) and words <= WEAK_WORDS | SIDE_WORDS


def marks_of(tag: str, attributes: str) -> list[str]:
    """What marks an element as beside the article: its kind, its role, a class or id, or that it is hidden."""
    found = [tag] if tag in BESIDE else []
    if not attributes or tag in ("html", "body", "main", "article") or not _TELLING.search(attributes):
        return found
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), max(values).lower()
        if name == "hidden":
            found.append(name)
        elif tag in UNMARKED:
            continue
        elif name == "role":
            found += BESIDE_ROLES.intersection(value.split())
        elif name in ("class", "id"):
            names = value.split()
            found += [mark for mark in names if is_beside_name(mark)] or [DOUBTFUL for mark in names if is_doubtful_name(mark)]
    return found


class _Page:
    """Blocks by number, in page order; pieces of text with the block and the run of text they belong to."""

    def __init__(self) -> None:
        self.tag, self.parent, self.mark = ["#page"], [-1], [""]  # mark: "", "thread", "menu", "beside" or "doubtful"
        self.chars, self.link_chars, self.link_tags, self.tags = [0], [0], [0], [0]
        self.pieces: list[tuple[int, int, str]] = []
        self.body = 0

    def add(self, tag: str, parent: int, mark: str) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.mark.append(mark)
        for counts in (self.chars, self.link_chars, self.link_tags, self.tags):
            counts.append(0)
        return len(self.tag) - 1


def parse(page: str) -> _Page:
    tree = _Page()
    stack: list[tuple[str, int, bool]] = [("#page", 0, False)]  # tag, block, within what is cut
    open_tags: Counter[str] = Counter()
    links, run, at, n = 0, 0, 0, len(page)

    def add(text: str) -> None:
        block, cut = stack[-1][1], stack[-1][2]
        if cut or not text:
            return
        if "&" in text:
            text = html.unescape(text)
        tree.pieces.append((block, run, text))
        size = len(text.strip())
        tree.chars[block] += size
        if links:
            tree.link_chars[block] += size

    def close(tags: tuple[str, ...], holders: frozenset[str]) -> None:
        """End the innermost open element of these, unless a holder stands within it."""
        nonlocal links, run
        if not any(open_tags[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                for tag, _, _ in stack[i:]:
                    open_tags[tag] -= 1
                    links -= tag == "a"
                    run += tag not in INLINE
                del stack[i:]
                return
            if stack[i][0] in holders:
                return

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[1]:
            close((m[1].lower(),), frozenset())
            continue
        tag = m[2] or m[4]
        if not tag:
            continue
        tag, attributes = tag.lower(), m[3] or m[5] or ""
        if tag in ("br", "hr"):
            add(" ")
            run += tag == "hr"
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else n
            continue
        if tag in CLOSES_P:
            close(("p",), _P_HOLDERS)
        elif tag in _SIBLINGS:
            close(_SIBLINGS[tag], _HOLDERS)
        block, cut = stack[-1][1], stack[-1][2] or tag in CUT
        marks = [] if cut else marks_of(tag, attributes)
        doubtful = set(marks) == {DOUBTFUL}
        mark = "" if not marks else DOUBTFUL if doubtful else "thread" if any(THREAD_WORDS.intersection(_WORD.findall(x)) for x in marks) else "menu" if MENUS.issuperset(marks) else "beside"
        run += tag not in INLINE
        if not cut and (mark or tag not in INLINE):
            block = tree.add(tag, block, mark)
            if tag == "body":
                tree.body = block
        if tag == "a":
            links += 1
            tree.link_tags[block] += not cut
        open_tags[tag] += 1
        stack.append((tag, block, cut))
    return tree


def weights(tree: _Page) -> list[float]:
    """MARKED for what is marked or within something marked, 1 for the rest.

    A mark weighs nothing on what holds the title, main part or all articles of the page, and most of the unlinked text
    that is not marked elsewhere; on a page without any of these, three quarters of the text will do. Threads, which
    can be longer than the article, need a title or main part. Where all text is marked, marks tell nothing.
    """
    n = len(tree.tag)
    titles, articles = [t in ("h1", "main") for t in tree.tag], [int(t == "article") for t in tree.tag]
    for i in range(n - 1, 0, -1):
        titles[tree.parent[i]] |= titles[i]
        articles[tree.parent[i]] += articles[i]
    titled = titles[0] or articles[0]

    def may_hold(i: int) -> bool:
        return titles[i] or tree.mark[i] != "thread" and (not titled or 0 < articles[i] == articles[0])

    plain = [c - x for c, x in zip(tree.chars, tree.link_chars, strict=True)]
    for i in range(n - 1, 0, -1):
        if tree.mark[i] in UNWEIGHED or may_hold(i):
            plain[tree.parent[i]] += plain[i]
    weight = [1.0] * n
    for i in range(1, n):
        weight[i] = weight[tree.parent[i]]
        if tree.mark[i] not in UNWEIGHED and not (may_hold(i) and (2 * plain[i] > plain[0] if titled else 4 * plain[i] > 3 * plain[0])):
            weight[i] = MARKED
    return weight if any(c and w == 1 for c, w in zip(tree.chars, weight, strict=True)) else [1.0] * n


def chosen_weights(tree: _Page, weight: list[float]) -> list[float]:
    """weight, but 1 within menus: that links are no article is for their density to tell."""
    made = list(weight)
    for i in range(1, len(made)):
        p = tree.parent[i]
        if tree.mark[i] == "menu" or made[p] > weight[p] and tree.mark[i] in UNWEIGHED | {"menu"}:
            made[i] = 1.0
    return made


def densities(tree: _Page, weight: list[float]) -> tuple[list[float], list[float]]:
    """Weighted composite text density of each node, and the sum over its children."""
    n = len(tree.tag)
    chars, link_chars, link_tags, tags = list(tree.chars), list(tree.link_chars), list(tree.link_tags), list(tree.tags)
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        link_tags[p] += link_tags[i]
        tags[p] += tags[i] + 1
    share = link_chars[tree.body] / max(1, chars[tree.body])
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        c, lc, t, lt = chars[i], max(1, link_chars[i]), max(1, tags[i] + link_tags[i]), max(1, link_tags[i])
        if c:
            base = math.log(c * lc / max(1, c - link_chars[i]) + share * c + math.e)
            density[i] = weight[i] * c / t * math.log(max(1.0001, c * t / (lc * lt))) / math.log(base)
    for i in range(1, n):
        total[tree.parent[i]] += density[i]
    return density, total


def subtree(tree: _Page, own: list[int]) -> list[int]:
    """Own counts plus those of everything below."""
    whole = list(own)
    for i in range(len(whole) - 1, 0, -1):
        whole[tree.parent[i]] += whole[i]
    return whole


def prose_blocks(tree: _Page, weight: list[float]) -> list[bool]:
    """Whether a node holds headings and paragraphs and nothing else: no text loose in a container, links in the
    minority, nothing marked, no notice of rights."""
    chars, link_chars = subtree(tree, tree.chars), subtree(tree, tree.link_chars)
    loose = [int(c > 0 and t not in PROSE or m == DOUBTFUL) for t, c, m in zip(tree.tag, tree.chars, tree.mark, strict=True)]
    for block, _, text in tree.pieces:
        if _RIGHTS.match(text):
            loose[block] += 1
    loose = subtree(tree, loose)
    return [c > 0 and not loose[i] and 2 * link_chars[i] < c and weight[i] == 1 for i, c in enumerate(chars)]


def content_blocks(tree: _Page, weight: list[float], density: list[float], total: list[float]) -> list[bool]:
    """Which nodes are content: the core, the greatest sums of what reaches the threshold, and the prose around them.

    A node without a sum (text and nothing below it) is never chosen by itself, only with what holds it. Beside what is
    chosen, and beside what holds that up to the body, prose of any length belongs to the article: a headline and intro
    of their own, a short last paragraph, a second article.
    """
    n, body = len(tree.tag), tree.body
    best = list(range(n))  # within each subtree, the node of the greatest sum; the outermost of equals
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        a, b = best[i], best[p]
        if total[a] > total[b] or total[a] == total[b] and b != p and a < b:
            best[p] = a
    core = best[body]
    threshold, i = density[body], core
    while i > body:
        threshold = min(threshold, density[i])
        i = tree.parent[i]
    content, reached = [False] * n, [False] * n
    content[core] = reached[body] = True
    for i in range(body + 1, n):
        if reached[tree.parent[i]] and density[i] >= threshold - 1e-9:
            reached[i] = True
            content[best[i]] |= total[best[i]] > 0 and (weight[i] == 1 or weight[core] < 1)
    near = [False] * n  # what holds chosen nodes, up to the body
    for i in range(n - 1, body, -1):
        near[tree.parent[i]] |= content[i] or near[i]
    prose = prose_blocks(tree, weight)
    for i in range(body + 1, n):
        content[i] |= near[tree.parent[i]] and prose[i]
    chars, link_chars, link_tags = subtree(tree, tree.chars), subtree(tree, tree.link_chars), subtree(tree, tree.link_tags)
    for i in range(1, n):
        p = tree.parent[i]
        menu = link_chars[i] == chars[i] > 0 and link_tags[i] >= MENU_LINKS
        if content[p] and density[i] < threshold and (menu or weight[i] < weight[p]):
            content[i] = False
        else:
            content[i] = content[i] or content[p]
    return content


def extract_text(page: str | None) -> str:
    """The article's blocks, each with single spaces, one to a line; empty if there are none."""
    if not page:
        return ""
    tree = parse(page)
    if not any(tree.chars):
        return ""
    weight = weights(tree)
    content = content_blocks(tree, weight, *densities(tree, chosen_weights(tree, weight)))
    lines: list[str] = []
    last, parts = None, []
    for block, run, text in tree.pieces:
        if content[block]:
            if run != last:
                lines.append("".join(parts))
                parts = []
            parts.append(text)
            last = run
    lines.append("".join(parts))
    return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, "html"):
        texts = [extract_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without text, have an empty text; markup is read leniently, so nothing in it is an
    error; each row is read by itself, with null ids and urls kept; other columns are not read.
    """
    rows = bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
