"""HTML extraction by tag-path ratios.

A page is read once into blocks: runs of text between borders of block elements. Each block has
the path of block elements (with their classes) from the root to it. For every path the text
length and punctuation of its blocks are added up and divided by their number; text in links
counts against it. Along the page the ratios are smoothed by a Gaussian window and fused with the
unsmoothed ones (geometric mean); a path's score is the mean fused ratio of its blocks. Paths whose
score reaches ``THRESHOLD`` times the deviation of the page's fused ratios are content; if none
does, the page has no main text.

The content region is the lowest element around all content blocks, or the article or main element
around that. A block in the region is main text if its path is content or if it goes with the
content: a block whose elements have no name that speaks against it (headings, list items, cells,
short paragraphs), so that a threshold never cuts a sentence out of an article. Without such an
element (the region is the whole body) what stands between content blocks goes with them, and the
headings before the first one.

What the ratios can't tell is told by tags, roles and names. Elements that HTML itself sets apart
(nav, aside, footer, form, script, headers outside articles, hidden ones ...) have no blocks.
Elements whose class or id is as a whole a usual name of something that isn't the article ("ad",
"cookie-notice", "site-header"; "market-share" or "has-sidebar" aren't) are content only if no
other path is; what readers write ("comments", "replies") never is. Such a name
says nothing on an element that holds an article or main element, on headings and paragraphs, and,
but for readers' comments, on one that holds most of the punctuated text of a page without such elements.

Blocks are joined by a line feed in page order; white space inside a block becomes one space and
character references are decoded. Runs as ``mapInArrow``: each page on its own, nothing is
shuffled.

Defined results: null or empty html gives the empty text; a page without markup is one block;
unclosed or crossed elements end where their parent ends; repeated rows are extracted each; an
empty table gives an empty table; other columns pass through, one that clashes with the text's
name is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- Fixed values: names of the HTML standard and usual class names ---
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
NO_TEXT = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form frame frameset head iframe input label legend map menu meter nav noscript object option output picture progress select style script svg template textarea title video".split()
)
NO_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search searchbox status toolbar".split())
NO_CLASS = frozenset(
    "ad ads adbox advert adverts advertising advertisement adsbygoogle banner breadcrumb breadcrumbs cookie cookies copyright consent dialog disclaimer footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
READERS = frozenset("comment comments commentlist commentary-list disqus replies reply respond".split())
#: Words that leave the meaning of a name beside them as it is.
BESIDE = frozenset("area bar block bottom box button buttons container form global inner item items js left line link links list main message outer page panel policy primary reader readers right secondary section site slot social thread top unit user users wrap wrapper".split())
#: An element that opens closes these if they are open, up to the elements that follow them here.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# --- End of fixed values ---

_APART = r"<!--.*?(?:-->|\Z)|<(script|style|textarea|noscript|template|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)"
_REST = r"|<[!?/a-zA-Z][^>]*>|[^<]+|<"
TOKEN = re.compile(_APART + r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""" + _REST, re.S | re.I)
#: Tags end at their first ">", for pages whose quotes don't match.
UNQUOTED = re.compile(_APART + r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>" + _REST, re.S | re.I)
#: So many tags with a quote that isn't closed make a page one of those; each is searched to the page's end.
UNCLOSED = 20
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
PUNCTUATION = re.compile(r"[.,;:!?。，、！？；：؟،।…]")
WORDS = re.compile(r"[a-z0-9]+")
#: Deviations that the score of a content path reaches; blocks each side of the window.
THRESHOLD, REACH = 0.5, 2
KERNEL = tuple(math.exp(-(d * d) / 2.0) for d in range(-REACH, REACH + 1))
#: What a name says of an element: nothing, that it isn't the article, that readers wrote it.
PLAIN, ASIDE, COMMENT = 0, 1, 2


class _Element:
    """An element and what is handed down to it; what is inside it is added up later."""

    __slots__ = ("tag", "path", "skip", "parent", "depth", "name", "in_article", "in_header", "article", "marks", "chosen", "told", "near")

    def __init__(self, tag: str, parent: _Element | None, path: int, skip: bool = False, name: int = PLAIN):
        self.tag, self.parent, self.path, self.skip, self.name = tag, parent, path, skip, name
        self.depth = parent.depth + 1 if parent else 0
        self.in_article = tag in ("article", "main") or bool(parent and parent.in_article)
        self.in_header = tag == "header" or bool(parent and parent.in_header)
        self.article = False  # holds an article or main element, or is one
        self.marks = self.chosen = 0  # punctuated characters and content blocks inside


class Page:
    """The elements of a page, parents first, and its blocks: (element, text, characters in links) in page order."""

    def __init__(self) -> None:
        self.root = _Element("", None, 0)
        self.elements = [self.root]
        self.blocks: list[tuple[_Element, str, int]] = []
        self.labels: dict[tuple[int, str], int] = {}

    def path(self, parent: _Element, label: str) -> int:
        """A number for each root-to-element path of labels."""
        return self.labels.setdefault((parent.path, label), len(self.labels) + 1)

    def open(self, tag: str, parent: _Element, label: str, skip: bool, name: int) -> _Element:
        e = _Element(tag, parent, self.path(parent, label), skip, name)
        self.elements.append(e)
        if tag in ("article", "main") and not skip:
            above: _Element | None = e
            while above and not above.article:
                above.article, above = True, above.parent
        return e


def named(names: str) -> int:
    """What the classes and the id of an element say."""
    found = PLAIN
    for name in names.lower().split():
        words = set(WORDS.findall(name))
        if words <= READERS | BESIDE and words & READERS or name in READERS:
            return COMMENT
        if words <= NO_CLASS | BESIDE and words & NO_CLASS:
            found = ASIDE
    return found


def _seen(tag: str, attributes: str, parent: _Element) -> tuple[bool, str, int]:
    """Whether an element is set apart by HTML, its label in paths, what its names say."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes.strip(" /") else {}
    label = f"{tag}.{'.'.join(sorted(found['class'].split()))}" if found.get("class") else tag
    if tag in NO_TEXT:
        return True, label, PLAIN
    if tag in ("html", "body", "article", "main"):
        return False, label, PLAIN
    bare = {x.split("=")[0].lower() for x in attributes.split()}
    skip = (
        found.get("role", "").lower() in NO_ROLE
        or "hidden" in bare
        or found.get("aria-hidden", "").lower() == "true"
        or "display:none" in found.get("style", "").replace(" ", "").lower()
        or (tag == "header" and not parent.in_article)
    )
    unnamed = tag in HEADINGS or tag == "p"
    return skip, label, PLAIN if unnamed else named(f"{found.get('class', '')} {found.get('id', '')}")


_TAG = re.compile(r"</?[a-zA-Z]")


def _open_apart(html: str) -> bool:
    """Whether a comment, script or the like that isn't closed is open at the end."""
    last = None
    for last in re.finditer(_APART, html, re.S | re.I):
        pass
    return bool(last) and last.end() == len(html) and not re.search(r"-->\Z" if not last[1] else r"(?i)</" + last[1] + r"\s*>\Z", last[0])


def _tokens(html: str) -> Iterator[re.Match]:
    end, at, pattern, unclosed = html.rfind(">") + 1, 0, TOKEN, 0
    while at < end:
        for m in pattern.finditer(html, at, end):
            yield m
            if m.lastindex is None and m[0][0] == "<" and pattern is TOKEN and _TAG.match(html, m.start()):
                unclosed += 1
                if unclosed >= UNCLOSED:
                    pattern, at = UNQUOTED, m.end()
                    break
        else:
            break
    if end < len(html) and not _open_apart(html[:end]):
        rest = re.match(r"(?s)()()()()(?:(?!<[a-zA-Z/!?]).)+", html[end:])  # a tag that the page's end cuts off is no text
        if rest:
            yield rest


def read(html: str) -> Page:
    """The page without what HTML itself sets apart from its text."""
    page = Page()
    stack: list[_Element] = [page.root]
    open_tags: Counter[str] = Counter()
    buffer: list[str] = []
    owner, linked, in_link = page.root, 0, 0

    def flush() -> None:
        nonlocal buffer, linked
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            if text and (owner.tag in HEADINGS or not owner.in_header):
                page.blocks.append((owner, text, linked))
            buffer, linked = [], 0

    def close_to(depth: int) -> None:
        for e in stack[depth:]:
            open_tags[e.tag] -= 1
        del stack[depth:]

    for m in _tokens(html):
        token = m[0]
        if token[0] != "<" or token == "<" or m[3] == "" == m[1]:
            top = stack[-1]
            if not top.skip:
                if not buffer:
                    owner = top
                buffer.append(token)
                if in_link:
                    linked += len(token)
            continue
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            if buffer:
                buffer.append(" ")
            continue
        if tag not in BLOCK and tag not in NO_TEXT:  # inline elements aren't part of a path
            if tag == "a":
                in_link = 0 if m[2] else 1
            continue
        flush()
        in_link = 0
        if m[2]:
            if open_tags[tag] <= 0:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close_to(i)
                    break
                if stack[i].tag in ("article", "main", "body", "td", "th") and tag not in BLOCK:
                    break
            continue
        if tag in VOID:
            continue
        if tag in CLOSES:
            ends, walls = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in walls:
                    break
                if stack[i].tag in ends:
                    close_to(i)
                    if tag != "tr":
                        break
        if stack[-1].tag in HEADINGS and tag in HEADINGS or stack[-1].tag == "p" and tag in BLOCK:
            close_to(len(stack) - 1)
        parent = stack[-1]
        skip, label, name = (True, tag, PLAIN) if parent.skip else _seen(tag, m[4] or "", parent)
        if not (m[4] or "").endswith("/") or tag in BLOCK:
            stack.append(page.open(tag, parent, label, skip, name))
            open_tags[tag] += 1
    flush()
    return page


def ratios(found: list[tuple[_Element, str, int]]) -> dict[int, float]:
    """The text and punctuation ratio of each path, less for text in links."""
    totals: dict[int, list[float]] = {}
    for e, text, linked in found:
        t = totals.setdefault(e.path, [0, 0, 0, 0])
        t[0] += len(text)
        t[1] += len(PUNCTUATION.findall(text))
        t[2] += linked
        t[3] += 1
    return {p: n / k * (1 + c / k) * max(0.0, 1 - a / n) for p, (n, c, a, k) in totals.items()}


def scores(found: list[tuple[_Element, str, int]], kernel: tuple[float, ...] = KERNEL) -> tuple[dict[int, float], float]:
    """Each path's mean fused ratio, and the deviation of the page's fused ratios."""
    ratio, reach = ratios(found), len(kernel) // 2
    raw = [ratio[e.path] for e, _, _ in found]
    fused = []
    for i, x in enumerate(raw):
        near = [(raw[i + d], kernel[d + reach]) for d in range(-reach, reach + 1) if 0 <= i + d < len(raw)]
        fused.append(math.sqrt(x * sum(r * w for r, w in near) / sum(w for _, w in near)))
    mean = sum(fused) / len(fused)
    by_path: dict[int, list[float]] = {}
    for (e, _, _), x in zip(found, fused):
        by_path.setdefault(e.path, []).append(x)
    return {p: sum(xs) / len(xs) for p, xs in by_path.items()}, math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))


def _told(page: Page) -> list[int]:
    """What the names around each block say, where they say anything."""
    for e, text, _ in page.blocks:
        if PUNCTUATION.search(text):
            e.marks += len(text)
    for e in reversed(page.elements):
        if e.parent:
            e.parent.marks += e.marks
    article = any(e.in_article for e, _, _ in page.blocks)
    for e in page.elements:
        heard = e.name and not e.article and (e.name == COMMENT or article or 2 * e.marks <= page.root.marks)
        e.told = max(e.name if heard else PLAIN, e.parent.told if e.parent else PLAIN)
    return [e.told for e, _, _ in page.blocks]


def _region(page: Page, content: list[bool]) -> list[bool]:
    """Which blocks are in the lowest element around all content blocks, or the outermost article or main element around that."""
    for (e, _, _), c in zip(page.blocks, content):
        e.chosen += c
    for e in reversed(page.elements):
        if e.parent:
            e.parent.chosen += e.chosen
    every = sum(content)
    around = [e for e in page.elements if e.chosen == every]  # one below the other
    region = around[-1]
    if all(e is region for (e, _, _), c in zip(page.blocks, content) if c) and region.parent:
        region = region.parent  # one element's own text: its neighbours may go with it
    region = next((e for e in around if e.tag in ("article", "main")), region)
    if region.tag in ("", "html", "body"):
        first, last = content.index(True), len(content) - 1 - content[::-1].index(True)
        return [first <= i <= last or (e.tag in HEADINGS and i < first) for i, (e, _, _) in enumerate(page.blocks)]
    for e in page.elements:
        e.near = e is region or bool(e.parent and e.parent.near)
    return [e.near for e, _, _ in page.blocks]


def extract(html: str | None, threshold: float = THRESHOLD, kernel: tuple[float, ...] = KERNEL) -> str:
    """The main text of a page."""
    page = read(html or "")
    if not page.blocks:
        return ""
    score, deviation = scores(page.blocks, kernel)
    told = _told(page)
    reached = [score[e.path] > 0 and score[e.path] >= threshold * deviation for e, _, _ in page.blocks]
    content = [r and t == PLAIN for r, t in zip(reached, told)]
    if not any(content):
        content = [r and t == ASIDE for r, t in zip(reached, told)]
    if not any(content):
        return ""
    return "\n".join(text for (_, text, _), c, n, t in zip(page.blocks, content, _region(page, content), told) if c or (n and not t))


def extract_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the html column."""
    kept = [c for c in pages.columns if c.lower() not in (html.lower(), text.lower())]
    schema = T.StructType([*pages.select(kept).schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([extract(x.as_py()) for x in b.column(b.schema.get_field_index(html))], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in kept), texts], names=[*kept, text])

    return pages.mapInArrow(run, schema)
