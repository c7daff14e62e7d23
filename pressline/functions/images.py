"""The figure of an official release that may be shown: directly embedded, credited to the bank alone.

A page is tokenized once into its tags; elements are ranges of that list, so the work is
linear in the page.  It runs in Arrow batches, as balanced elements are beyond built-in
expressions.
"""

from __future__ import annotations

import re
from typing import NamedTuple
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressline.functions.text import python_plain_text

# Bounds of what is looked at, and what credits and addresses must look like.
MAX_PAGE, MAX_TAGS, MAX_FIGURES, MAX_IMAGES, MAX_TITLE, MAX_CAPTION, MAX_LINK = 2_000_000, 20_000, 30, 20, 500, 4000, 2000
RELEASE = re.compile(r"/press/pr/date/(\d\d(\d\d))/html/ecb\.pr(\2\d{4})~[a-f\d]+\.en\.html")
FILE = r"ecb\.pr{date}\.en_img\d{{1,2}}\.(?:png|jpe?g|webp)"
OWN_SOURCE = re.compile(r"Sources?:\s*(?:ECB|European Central Bank)(?:\s*\n|\s*$|[.;]|\s+calculations\b)", re.I)
OTHER_CREDIT = re.compile(r"\b(?:photo(?:graph)?\s+by|image\s+(?:by|credit)|getty|shutterstock|alamy|reuters)\b", re.I)
COPYRIGHT = re.compile(r"(?:©|\bcopyright\b|\(c\))\s*([^©\n]*)", re.I)
OWN_COPYRIGHT = re.compile(r"(?:\d{4}\s+)?(?:ECB|European Central Bank)(?:\s*[,.;]?\s*\d{4})?\s*[.;]?", re.I)
HOST = "www.ecb.europa.eu"

_HIDDEN = re.compile(r"<(script|style|noscript|template|svg|iframe)\b", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "svg", "iframe")}
#: The HTML of a title or caption with more characters than this is none.
MAX_INNER = 40_000
_TAG = re.compile(r"""<(/?)([a-z][a-z0-9:-]*)\b(?:[^"'<>]|"[^"]*"|'[^']*')*>""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_NOTE = re.compile(r"\bNotes?:\s.*$", re.I | re.S)


class Tag(NamedTuple):
    start: int
    end: int
    name: str
    step: int  # 1 opens, -1 closes, 0 does both


class Span(NamedTuple):
    """An element: numbers of its first inner and its closing tag."""

    first: int
    last: int


def _without(text: str, opening: re.Pattern, end_of) -> str:
    """text less what reaches from an opening to its end; end_of(match) is the place behind it, -1 where there is none."""
    kept, at = [], 0
    for m in opening.finditer(text):
        if m.start() < at:
            continue
        end = end_of(m)
        if end >= 0:
            kept.append(text[at : m.start()])
            at = end
    return "".join([*kept, text[at:]])


def visible(html: str) -> str:
    """html without comments and hidden elements; what is not closed stays.  A kind that is not closed once is not searched for again."""
    endless: set[str] = set()

    def behind(name: str, found) -> int:
        if name in endless:
            return -1
        end = found()
        if end < 0:
            endless.add(name)
        return end

    def comment(m):
        return behind("!", lambda: (lambda i: i + 3 if i >= 0 else -1)(html.find("-->", m.end())))

    text = _without(html, re.compile("<!--"), comment)

    def element(m):
        start = behind(">", lambda: text.find(">", m.end()))
        return -1 if start < 0 else behind(m[1].lower(), lambda: (lambda e: e.end() if e else -1)(_ENDS[m[1].lower()].search(text, start + 1)))

    return _without(text, _HIDDEN, element)


class Page:
    def __init__(self, html: str):
        self.text = visible(html)
        self.tags = [Tag(m.start(), m.end(), m[2].lower(), -1 if m[1] else 0 if re.search(r"/\s*>$", m[0]) else 1) for m in _TAG.finditer(self.text)]

    def attribute(self, tag: Tag, name: str) -> str | None:
        inside = self.text[tag.start + 1 + len(tag.name) : tag.end - 1]
        return next((next((v for v in m.groups()[1:] if v is not None), "") for m in _ATTRIBUTE.finditer(inside) if m[1].lower() == name), None)

    def has_class(self, tag: Tag, name: str | None) -> bool:
        return name is None or name in (self.attribute(tag, "class") or "").split()

    def find(self, name: str, css: str | None, within: Span) -> Span | None:
        """The first balanced element of a name and class; None if it is not closed within MAX_TAGS tags."""
        first, depth = None, 0
        for i in range(within.first, min(within.last, within.first + MAX_TAGS)):
            tag = self.tags[i]
            if tag.name != name:
                continue
            if first is None:
                if tag.step == 1 and self.has_class(tag, css):
                    first, depth = i + 1, 1
            else:
                depth += tag.step
                if depth == 0:
                    return Span(first, i)
        return None

    def inner(self, span: Span) -> str:
        return self.text[self.tags[span.first - 1].end : self.tags[span.last].start]

    def plain(self, span: Span | None) -> str:
        inner = self.inner(span) if span else ""
        return python_plain_text(inner) if len(inner) <= MAX_INNER else ""


def release_of(address: str | None) -> tuple[str, str] | None:
    """Year and date (yymmdd) of a canonical release address."""
    try:
        u = urlsplit(address or "")
        plain = u.scheme == "https" and u.netloc.lower() == HOST and not u.query and not u.fragment and "?" not in address and "#" not in address
    except ValueError:
        return None
    found = RELEASE.fullmatch(u.path) if plain else None
    return (found[1], found[3]) if found else None


def image_link(raw: str | None, address: str, year: str, date: str) -> str | None:
    """The absolute link of an image that belongs to the release; None of any other."""
    if not raw or len(raw) > MAX_LINK or re.search(r"[\s\\\x00-\x1f\x7f]", raw):
        return None
    try:
        u = urlsplit(urljoin(address, raw))
    except ValueError:
        return None
    folder = f"/press/pr/date/{year}/html/pr{date}/"
    named = u.path.startswith(folder) and re.fullmatch(FILE.format(date=date), u.path[len(folder) :], re.I)
    fine = u.scheme == "https" and u.netloc.lower() == HOST and "#" not in raw and (not u.query or re.fullmatch(r"[a-f\d]{32}", u.query, re.I))
    return u.geturl() if named and fine else None


def credited(caption: str) -> bool:
    """Is a caption's source the bank, with no other agency's credit and no other owner's copyright?"""
    own = all(OWN_COPYRIGHT.fullmatch(c[1].strip()) for c in COPYRIGHT.finditer(caption))
    return len(caption) <= MAX_CAPTION and bool(OWN_SOURCE.match(caption)) and not OTHER_CREDIT.search(caption) and own


def attribution(title: str, caption: str) -> str:
    """Title and source paragraphs; notes on the method stay with the article."""
    kept = (_NOTE.sub("", p).strip() for p in re.split(r"\n{2,}", caption))
    return f"{title} — " + "\n\n".join(p for p in kept if p)


def release_image_of(provider: str | None, html: str | None, address: str | None) -> tuple[str, str] | None:
    """Link and attribution of the first figure of a release that may be shown."""
    release = release_of(address) if provider == "ecb" and html is not None and len(html) <= MAX_PAGE else None
    if not release:
        return None
    page = Page(html)
    main = page.find("main", None, Span(0, len(page.tags)))
    section = main and page.find("div", "section", main)
    if not section:
        return None
    rest = section
    for _ in range(MAX_FIGURES):
        figure = page.find("div", "figure", rest)
        if not figure:
            return None
        rest = Span(figure.last + 1, section.last)
        caption, title = page.plain(page.find("figcaption", None, figure)), page.plain(page.find("p", "title", figure))
        if not title or len(title) > MAX_TITLE or not credited(caption):
            continue
        images = [t for t in page.tags[figure.first : figure.last] if t.name == "img" and t.step >= 0][:MAX_IMAGES]
        for tag in images:
            link = image_link(page.attribute(tag, "src"), address, *release)
            if link:
                return link, attribution(title, caption)
    return None


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("link", "attribution")]))
def release_image(provider: pd.Series, html: pd.Series, address: pd.Series) -> pd.DataFrame:
    from pressline.functions.images import release_image_of

    found = [release_image_of(p, h, a) or (None, None) for p, h, a in zip(provider, html, address, strict=True)]
    return pd.DataFrame(found, columns=["link", "attribution"])
