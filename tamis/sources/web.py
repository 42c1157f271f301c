"""Articles from HTML, with the standard library's parser in an Arrow UDF.

An unclosed paragraph ends where the next block begins, as browsers read it, so no text counts
twice."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import normalize

# Tags that hold no article text, and places where an article stands, in order of trust.
NOISE = {"script", "style", "nav", "header", "footer", "aside"}
PLACES = ("article", ".content", ".post-content", ".entry-content", ".news-body")
SHORTEST = 20
UNTITLED = "بدون عنوان"

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"p", "div", "article", "section", "ul", "ol", "li", "table", "h1", "h2", "h3", "h4", "h5", "h6", "nav", "header", "footer", "aside", "main", "form", "blockquote", "pre", "figure"}


class _Reader(HTMLParser):
    """One pass: titles, and every paragraph with the places that contain it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, set[int]]] = []
        self.paragraphs: list[tuple[set[int], list[str]]] = []
        self.open: list[str] | None = None
        self.title: list[str] | None = None
        self.og = ""
        self.taken: set[str] = set()
        self.noise = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and a.get("property") == "og:title" and not self.og:
            self.og = (a.get("content") or "").strip()
        if tag in _VOID:
            return
        if tag in _BLOCK:
            self._end_paragraph()
        if tag == "title" and self.title is None:
            self.title = []
        here: set[int] = set()
        names = {tag, *("." + c for c in (a.get("class") or "").split())}
        for i, place in enumerate(PLACES):
            if place in names and place not in self.taken and not self.noise:  # only the first of each
                self.taken.add(place)
                here.add(i)
        self.stack.append((tag, here))
        self.noise += tag in NOISE
        if tag == "p" and not self.noise:
            self.open = []
            self.paragraphs.append((set().union(*(s for _, s in self.stack)), self.open))

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self._end_paragraph()
        at = next((i for i in reversed(range(len(self.stack))) if self.stack[i][0] == tag), None)
        if at is not None:
            self.noise -= sum(t in NOISE for t, _ in self.stack[at:])
            del self.stack[at:]

    def _end_paragraph(self):
        self.open = None
        if self.stack and any(t == "p" for t, _ in self.stack):
            at = max(i for i, (t, _) in enumerate(self.stack) if t == "p")
            self.noise -= sum(t in NOISE for t, _ in self.stack[at:])
            del self.stack[at:]

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "title" and self.title is not None:
            self.title.append(data)
        elif self.open is not None and not self.noise and data.strip():
            self.open.append(data.strip())


def read_html(html: str | None) -> dict:
    """Title and paragraphs (unnormalized) of a page."""
    r = _Reader()
    r.feed(html or "")
    r.close()
    texts = [(where, " ".join(parts)) for where, parts in r.paragraphs]
    good = [(where, t) for where, t in texts if len(t) > SHORTEST]
    chosen = next((own for i in range(len(PLACES)) if (own := [t for where, t in good if i in where])), None)
    title = r.og or "".join(r.title or []).strip() or UNTITLED
    return {"title": title, "paragraphs": chosen if chosen is not None else [t for _, t in good]}


def parse(html: Column) -> Column:
    """struct(title, paragraphs) of a column of pages."""

    @F.pandas_udf("title string, paragraphs array<string>")
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_html(h) for h in pages], columns=["title", "paragraphs"], index=pages.index)

    return run(html)


def articles(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages to documents (title, content, source_id, kind, notes)."""
    parsed = pages.select(F.col(url).alias("source_id"), parse(F.col(html)).alias("p"))
    content = normalize(F.array_join("p.paragraphs", "\n\n"))
    return parsed.select(normalize(F.col("p.title")).alias("title"), content.alias("content"), "source_id", F.lit("web").alias("kind"), F.array().cast("array<string>").alias("notes"))


Fetcher = Callable[[str], str]


def http_fetch(url: str, timeout: float = 15) -> str:
    """The page at a URL as UTF-8 text."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=timeout) as response:  # noqa: S310
        return response.read().decode("utf-8", errors="replace")


def fetch(urls: DataFrame, fetcher: Fetcher = http_fetch, url: str = "url") -> DataFrame:
    """(url, html, error): each page fetched once; an error is a row, not a failed job."""

    def run(parts):
        for part in parts:
            html, error = [], []
            for u in part["url"]:
                try:
                    html.append(fetcher(u))
                    error.append(None)
                except Exception as e:  # noqa: BLE001  any failure of a fetcher becomes the row's error
                    html.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"url": part["url"], "html": html, "error": error})

    return urls.select(F.col(url).alias("url")).mapInPandas(run, "url string, html string, error string")
