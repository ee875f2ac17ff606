"""Pages as text: what patterns cannot tell is parsed in Arrow batches, one page at a time."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SILENT = frozenset(("script", "style", "noscript", "template", "svg"))
_BLOCK = frozenset(("p", "div", "li", "br", "tr", "h1", "h2", "h3", "h4", "section", "article"))


class _Page(HTMLParser):
    """Title, description, headings, text and date of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.silent, self.at, self.title, self.description, self.published = 0, "", "", "", ""
        self.headings: list[str] = []
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        self.silent += tag in _SILENT
        self.at = tag if tag in ("title", "h1", "h2") else self.at
        if tag in ("h1", "h2"):
            self.headings.append("")
        if tag in _BLOCK:
            self.parts.append("\n")
        if tag == "meta":
            name, content = (a.get("name") or a.get("property") or "").lower(), a.get("content") or ""
            if name in ("description", "og:description") and not self.description:
                self.description = content.strip()
            if name in ("article:published_time", "date", "pubdate") and not self.published:
                self.published = content.strip()
        if tag == "time" and a.get("datetime") and not self.published:
            self.published = a["datetime"]

    def handle_endtag(self, tag):
        self.silent = max(0, self.silent - (tag in _SILENT))
        if tag == self.at:
            self.at = ""

    def handle_data(self, data):
        if self.silent:
            return
        if self.at == "title":
            self.title += data
            return
        if self.at in ("h1", "h2"):
            self.headings[-1] += data
        self.parts.append(data)

    def body(self) -> str:
        lines = (" ".join(x.split()) for x in "".join(self.parts).split("\n"))
        return "\n".join(x for x in lines if x)


def parse(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def page_metadata(pages: DataFrame, body: int = 800) -> DataFrame:
    """Title, description, distinct headings, the body's beginning and published_at of each page; null pages give empty values."""

    @F.pandas_udf("title string, description string, headings array<string>, body string, published_at string")
    def read(html: pd.Series) -> pd.DataFrame:
        rows = []
        for h in html:
            p = parse(h)
            heads = list(dict.fromkeys(x for x in (" ".join(y.split()) for y in p.headings) if x))
            rows.append((" ".join(p.title.split()), p.description, heads, p.body()[:body], p.published))
        return pd.DataFrame(rows, columns=["title", "description", "headings", "body", "published_at"])

    return pages.withColumn("_m", read("html")).select(*[c for c in pages.columns if c != "html"], "_m.*")


def page_text(pages: DataFrame) -> DataFrame:
    """Text of each page without scripts, styles and markup."""

    @F.pandas_udf("string")
    def read(html: pd.Series) -> pd.Series:
        return html.map(lambda h: parse(h).body())

    return pages.withColumn("text", read("html")).drop("html")


_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


class _Selected(HTMLParser):
    """Texts of the elements that each of some simple selectors (`tag`, `.class` or `#id`) matches, outermost ones only."""

    def __init__(self, selectors: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.selectors = selectors
        self.open: list[str] = []
        self.inside: dict[str, int] = {}
        self.texts: dict[str, list[list[str]]] = {s: [] for s in selectors}
        self.silent = 0

    def _matches(self, selector: str, tag: str, attributes: dict) -> bool:
        if selector[0] == ".":
            return selector[1:] in (attributes.get("class") or "").split()
        return selector[1:] == attributes.get("id") if selector[0] == "#" else selector == tag

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        self.open.append(tag)
        self.silent += tag in _SILENT
        for s in self.selectors:
            if s not in self.inside and self._matches(s, tag, dict(attrs)):
                self.inside[s] = len(self.open)
                self.texts[s].append([])

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while self.open:  # elements left open end with the one around them
            closed = self.open.pop()
            self.silent -= closed in _SILENT
            self.inside = {s: d for s, d in self.inside.items() if d <= len(self.open)}
            if closed == tag:
                break

    def handle_data(self, data):
        if not self.silent and (clean := " ".join(data.split())):
            for s in self.inside:
                self.texts[s][-1].append(clean)


def selected_text(html: str | None, body: tuple[str, ...], comments: tuple[str, ...], only_meta: str = r"(?!)", tail: str = r"(?!)") -> tuple[str, str]:
    """Text of the first body selector that finds one that isn't mere metadata, and all texts of the first comment selector that finds any.

    Without a body both are empty, so that the caller falls back on the whole page.
    """
    page = _Selected((*body, *comments))
    page.feed(html or "")
    page.close()
    found = next((t for s in body if page.texts[s] and (t := "\n".join(page.texts[s][0])) and not re.match(only_meta, t)), "")
    if not found:
        return "", ""
    said = next((t for s in comments if (t := "\n".join(" ".join(x) for x in page.texts[s] if x))), "")
    return re.sub(tail, "", found).strip(), said


def site_text(pages: DataFrame, selectors: dict[str, tuple[tuple[str, ...], tuple[str, ...]]], only_meta: str = r"(?!)", tail: str = r"(?!)") -> DataFrame:
    """`pages` (site, html and others) with body and comments by the selectors of their site; empty for other sites, null pages and pages without a body."""

    @F.pandas_udf("body string, comments string")
    def read(site: pd.Series, html: pd.Series) -> pd.DataFrame:
        rows = [selected_text(h, *selectors[s], only_meta, tail) if s in selectors else ("", "") for s, h in zip(site, html, strict=True)]
        return pd.DataFrame(rows, columns=["body", "comments"])

    return pages.withColumn("_t", read("site", "html")).select(*[c for c in pages.columns if c != "html"], "_t.*")
