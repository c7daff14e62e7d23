"""Main text of web pages by tag-path ratios.

Style: free (Arrow batches); every page is independent, so there is no shuffle.

A page becomes a list of text blocks, each with its root-to-leaf path of block tags, classes
included.  For each path:

* text length (links count a tenth) and punctuation are summed and divided by the number of
  the path's blocks: prose paths have long and punctuated blocks, menus and teasers do not;
* both ratios are smoothed over the paths in page order, with Gaussian weights that fall with
  the distance of the paths in the tree: a heading between paragraphs is carried by them, a
  footer beside an article is not;
* the two are fused, log(1 + text) * (1 + log(1 + punctuation)), and weighed by signals: the
  share of text outside links, and what tags, roles, classes and ids of the path's elements say
  (navigation, forms, adverts, comments and the like; inside an article element or not).  A
  signal only lowers a path's value: where all that a page has stands in such elements, it is
  still the page's best and is returned, and a name that holds most of the text of a page
  without an article element is overruled;
* paths are thresholded against the page's best value.

Paths over SEED are sure.  The content element is the deepest container that holds most of
their text (or the article around it).  In it, blocks of paths over WITHIN are content, so
short paragraphs, headings, lists and cells stay; outside of it, those of paths over OUTSIDE.

Character references are decoded, white space inside a block becomes one space, blocks are
joined by one space in page order.  ``br`` counts as white space.  Scripts, styles and other
elements without text of their own never give blocks.

Time and memory are linear in the page, also for tags that never end and elements nested ten
thousands deep: every stretch is scanned once, paths are numbers (parent, tag, classes).

Defined cases: a null page is empty and gives an empty text; unclosed elements end with their
parents, unclosed comments and scripts with the page, a tag without an end is dropped with what
follows it; bytes that are not UTF-8 become U+FFFD; null ids and urls stay; repeated rows each
give their row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressline.llm.common import ship

SEED, WITHIN, OUTSIDE = 0.2, 0.03, 0.5
MAJORITY = 0.8
#: What signals multiply a path's value by.
FURNITURE, MARKED, BESIDE_ARTICLE = 0.005, 0.01, 0.1
LINK_WEIGHT, LINK_LOSS = 0.1, 0.95
RADIUS, FAR = 2, 6

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOPS = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？、¿¡]")

BLOCKS = frozenset([
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
])
VOID = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
])
FOREIGN = frozenset(["svg"])
RAW = frozenset([
    "script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "canvas", "object", "audio",
    "video", "noframes", "noembed", "xmp",
])
FURNITURE_TAGS = frozenset([
    "nav", "aside", "footer", "form", "dialog", "menu", "button", "select", "option", "label", "fieldset", "head",
])
ROLES = frozenset([
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog",
    "menu", "menubar", "toolbar",
])
WHOLE = frozenset([
    "html", "body", "main", "article",
])
HEADINGS = frozenset([
    "h1", "h2", "h3", "h4", "h5", "h6",
])
#: Elements that hold others; the content element is one of them.
CONTAINERS = frozenset([
    "", "html", "body", "main", "article", "section", "div", "center", "td", "details", "form", "aside", "header",
    "footer", "nav", "fieldset", "dialog",
])
#: Words that, first or last in a class or id, mark an element that is rarely part of an article.
MARKS = frozenset([
    "ad", "ads", "adsense", "alert", "announcement", "announcements", "advert", "adverts", "advertisement",
    "advertisements", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager",
    "pagination", "popup", "promo", "promotion", "related", "recommended", "recommendations", "replies", "respond",
    "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe",
    "subscription", "toolbar", "tooltip", "topbar", "widget",
])
NOT_MARKS = frozenset([
    "has", "with", "without", "no",
])
SITE_WORDS = frozenset([
    "header", "site", "page", "global", "top", "main", "nav",
])


def marked(value: str, inside: bool) -> bool:
    """Does one class or id name a part of the page that is rarely article?  inside: it stands in an article or main element."""
    words = [w.lower() for w in _TOKEN.findall(value)]
    if not words or NOT_MARKS.intersection(words):
        return False
    if words[-1] == "header" and (not inside or words[0] in SITE_WORDS):
        return True
    return words[0] in MARKS or words[-1] in MARKS


def signal(tag: str, attributes: str, inside: bool) -> tuple[float, str]:
    """The factor that an element's tag and attributes put on its paths, and its classes as part of the path."""
    factor = FURNITURE if tag in FURNITURE_TAGS or (tag == "header" and not inside) else 1.0
    if not attributes:
        return factor, ""
    classes = ""
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name == "class":
            classes = _DIGITS.sub("0", value)
        if tag in WHOLE:
            continue
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in ROLES) or (name == "style" and _HIDDEN.search(value)):
            factor = min(factor, FURNITURE)
        elif name in ("class", "id") and any(marked(one, inside) for one in value.split()):
            factor = min(factor, MARKED)
    return factor, classes


class Page:
    """Elements (parent, tag, path), text blocks (element, text, characters in links) and paths of a page.

    A path is a number; path_up, path_depth and path_factor are its parent, its depth and its
    last element's signal, path_in whether it stands in an article or main element.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.path = [-1], [""], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self.path_up, self.path_tag, self.path_depth, self.path_factor, self.path_in = [-1], [""], [0], [1.0], [False]
        self._paths: dict[tuple, int] = {}
        self._stack = [0]
        self._open: dict[str, list[int]] = {}  # the depths at which a tag is open
        self._text: list[str] = []
        self._linked = 0
        self._link_depth = 0  # of the element that holds the open link; 0: none is open
        self._read(source)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._stack[-1], text, min(self._linked, len(text))))
            self._text = []
        self._linked = 0

    def _pop_to(self, depth: int) -> None:
        self._flush()
        while len(self._stack) > depth:
            self._open[self.tag[self._stack.pop()]].pop()
        if self._link_depth > depth:
            self._link_depth = 0

    def _close(self, tag: str) -> None:
        """Close the innermost open ``tag`` unless an element that it cannot close over stands between."""
        depths = self._open.get(tag)
        if not depths:
            return
        for stop in _STOP.get(tag, _LOOSE):
            if stop != tag and (other := self._open.get(stop)) and other[-1] > depths[-1]:
                return
        self._pop_to(depths[-1])

    def _push(self, tag: str, factor: float, classes: str) -> None:
        self._flush()
        top = self._stack[-1]
        key = (self.path[top], tag, classes, factor)
        number = self._paths.get(key)
        if number is None:
            number = self._paths[key] = len(self.path_up)
            self.path_up.append(key[0])
            self.path_tag.append(tag)
            self.path_depth.append(self.path_depth[key[0]] + 1)
            self.path_factor.append(factor)
            self.path_in.append(self.path_in[key[0]] or tag in ("article", "main"))
        self.parent.append(top)
        self.tag.append(tag)
        self.path.append(number)
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append(len(self.tag) - 1)

    def _read(self, s: str) -> None:
        at, size, quotes = 0, len(s), True
        endless: set[str] = set()
        ends = {">": -1, '"': -1, "'": -1, "-->": -1}

        def after(mark: str, place: int) -> int:
            """The first place of mark from ``place`` on; size if there is none.  No stretch is searched twice."""
            if ends[mark] < place:
                found = s.find(mark, place)
                ends[mark] = size if found < 0 else found
            return ends[mark]

        while at < size:
            here = s.find("<", at)
            if here < 0:
                self._say(s[at:])
                break
            self._say(s[at:here])
            second = s[here + 1 : here + 2]
            closing = second == "/"
            named = _NAME.match(s, here + 1 + closing)
            if named is None:
                if second in ("!", "?", "/"):
                    at = after("-->", here + 4) + 3 if s.startswith("<!--", here) else after(">", here) + 1
                else:
                    self._say("<")
                    at = here + 1
                continue
            # to the '>' that is in no quoted value
            end = named.end()
            while quotes:
                stop = _STOPS.search(s, end)
                if stop is None:
                    end = size
                    break
                if stop[0] == ">":
                    end = stop.start()
                    break
                before = s[max(named.end(), stop.start() - 64) : stop.start()].rstrip()
                shut = after(stop[0], stop.end()) if before.endswith("=") else -1
                if shut == size:
                    end = size
                    break
                end = stop.end() if shut < 0 else shut + 1
            if end == size or not quotes:
                if end == size:
                    quotes = quotes and size == after(">", here)  # a quote never ends: from here on, quotes mean nothing
                end = after(">", here)
                if end == size:
                    break
            at = end + 1
            tag = named[0].lower()
            if closing:
                if tag == "a":
                    self._link_depth = 0
                self._close(tag)
                continue
            if tag in RAW:
                if s[end - 1 : end] == "/" and tag in FOREIGN:
                    continue
                shut = None if tag in endless else re.compile(rf"</{tag}(?=[\s/>])", re.I).search(s, at)
                if shut is not None:
                    at = shut.start()
                elif tag in ("script", "style"):
                    at = size
                else:
                    endless.add(tag)  # one that never ends is dropped itself, what is behind it is not
                continue
            if tag in VOID:
                if tag == "hr":
                    self._flush()
                elif tag == "br":
                    self._text.append(" ")
                continue
            if tag in BLOCKS:
                if self.tag[self._stack[-1]] == "p":
                    self._pop_to(len(self._stack) - 1)
                for other in _ENDS.get(tag, ()):
                    self._close(other)
            factor, classes = signal(tag, s[named.end() : end], self.path_in[self.path[self._stack[-1]]])
            if tag in BLOCKS:
                self._push(tag, factor, classes)
            elif factor < 1 or self._open.get(tag):  # marked inline elements, and what is nested in one of the same tag
                self._push(tag, factor, classes if factor < 1 else "")
            if tag == "a":
                self._link_depth = len(self._stack)
        self._flush()

    def _say(self, text: str) -> None:
        if text:
            if "&" in text:
                text = html.unescape(text)
            self._text.append(text)
            if self._link_depth:
                self._linked += len(" ".join(text.split()))


_LOOSE = ("table", "td", "th")
_INLINE_STOP = ("article", "main", "section", "div", "table", "td", "th", "body", "ul", "ol")
_STOP = {t: _INLINE_STOP for t in ("p", "a", "span", "label", "button")} | {"li": ("ul", "ol", "menu", "body"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "table": (), "body": (), "html": ()}
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th")}


def distance(page: Page, a: int, b: int) -> int:
    """Steps between two paths in the tree of paths; FAR where they are that many or more."""
    steps = 0
    while a != b and steps < FAR:
        if page.path_depth[a] >= page.path_depth[b]:
            a = page.path_up[a]
        else:
            b = page.path_up[b]
        steps += 1
    return steps if a == b else FAR


def path_factors(page: Page, plain: dict[int, float]) -> list[float]:
    """The product of the signals on each path.

    plain: the characters outside links and headings of each path.  A name (of a class, an id
    or a form) that holds most of a page without article text is overruled.
    """
    held = [0.0] * len(page.path_up)
    for p, n in plain.items():
        held[p] += n
    for p in range(len(held) - 1, 0, -1):
        held[page.path_up[p]] += held[p]
    has_article = any(page.path_in[p] and n for p, n in plain.items())
    out = [1.0] * len(held)
    for p in range(1, len(held)):
        own = page.path_factor[p]
        name_only = own == MARKED or page.path_tag[p] == "form"
        if name_only and not has_article and held[p] >= MAJORITY * held[0]:
            own = 1.0
        out[p] = max(1e-12, out[page.path_up[p]] * own)
    return out


def path_values(page: Page) -> dict[int, float]:
    """The value of each path that has blocks: tag-path ratios, smoothed over the paths in page order, fused and weighed by signals."""
    size: dict[int, int] = {}
    linked: dict[int, int] = {}
    marks: dict[int, int] = {}
    count: dict[int, int] = {}
    for element, text, links in page.blocks:
        p = page.path[element]
        size[p] = size.get(p, 0) + len(text)
        linked[p] = linked.get(p, 0) + links
        marks[p] = marks.get(p, 0) + len(_PUNCTUATION.findall(text))
        count[p] = count.get(p, 0) + 1
    order = list(size)  # as first met on the page
    heading = {p: page.path_tag[p] in HEADINGS for p in order}
    text_ratio = [(size[p] - (0 if heading[p] else (1 - LINK_WEIGHT) * linked[p])) / count[p] for p in order]
    mark_ratio = [marks[p] / count[p] for p in order]
    factor = path_factors(page, {p: size[p] - linked[p] for p in order if not heading[p]})
    has_article = any(page.path_in[p] for p in order)
    out = {}
    for i, p in enumerate(order):
        total = text = mark = 0.0
        for j in range(max(0, i - RADIUS), min(len(order), i + RADIUS + 1)):
            apart = distance(page, p, order[j])
            if apart < FAR:
                w = math.exp(-((i - j) ** 2 + (apart / 2) ** 2) / 2)
                total += w
                text += w * text_ratio[j]
                mark += w * mark_ratio[j]
        value = math.log1p(text / total) * (1 + math.log1p(mark / total)) * factor[p]
        if not heading[p]:
            value *= 1 - LINK_LOSS * linked[p] / size[p]
        out[p] = value * (BESIDE_ARTICLE if has_article and not page.path_in[p] else 1.0)
    return out


def content_element(page: Page, seeds: set[int]) -> int:
    """The deepest container that holds most of the text of the seed paths, or the article or main element around it."""
    held = [0] * len(page.tag)
    for element, text, _ in page.blocks:
        if page.path[element] in seeds:
            held[element] += len(text)
    for e in range(len(held) - 1, 0, -1):  # children have larger numbers
        held[page.parent[e]] += held[e]
    need = MAJORITY * held[0]
    root = max(e for e, n in enumerate(held) if n >= need and page.tag[e] in CONTAINERS)
    around = root
    while around > 0 and page.tag[around] not in ("article", "main"):
        around = page.parent[around]
    return around if around > 0 else root


def extract(source: str) -> str:
    """The main text of a page."""
    page = Page(source)
    if not page.blocks:
        return ""
    values = path_values(page)
    best = max(values.values())
    seeds = {p for p, v in values.items() if v >= SEED * best}
    root = content_element(page, seeds)
    inside = [False] * len(page.tag)
    for e in range(len(inside)):
        inside[e] = e == root or (e > 0 and inside[page.parent[e]])
    # the whole page is no boundary: there, weaker paths have to stand beside a seed
    whole = page.tag[root] in ("", "html", "body")
    beside = {page.path_up[p] for p in seeds if page.path_tag[page.path_up[p]] not in ("", "html")} if whole else set()

    def chosen(element: int) -> bool:
        p = page.path[element]
        v = values[p] / best
        if whole:
            return p in seeds or (v >= WITHIN and page.path_up[p] in beside)
        return v >= (WITHIN if inside[element] else OUTSIDE)

    return " ".join(text for element, text, _ in page.blocks if chosen(element))


def main_text(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text, n_chars (code points) of each page."""
    ship(df.sparkSession)
    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def batches(it):
        for batch in it:
            texts = [extract(raw.as_py().decode("utf-8", "replace")) if raw.is_valid else "" for raw in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return df.select(id_col, url_col, F.col(html_col).cast("binary").alias("__raw")).mapInArrow(batches, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars bigint")
