"""Document pages: fields, links, and pages by HTTP."""

from __future__ import annotations

import re
import time
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("title", "date_text", "president", "location", "node_id")]
    + [T.StructField("word_count", T.IntegerType()), T.StructField("has_video_flag", T.BooleanType()), T.StructField("transcript", T.StringType())]
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_DATE = re.compile(r"[A-Za-z]+\s+\d{1,2},\s+\d{4}")


class _Node:
    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []

    def walk(self):
        """Elements and strings below, in document order."""
        todo = list(reversed(self.items))
        while todo:
            x = todo.pop()
            yield x
            if isinstance(x, _Node):
                todo += reversed(x.items)

    def text(self, sep: str = "") -> str:
        return sep.join(x for x in self.walk() if isinstance(x, str))

    def clean(self) -> str:
        return " ".join(" ".join(x.strip() for x in self.walk() if isinstance(x, str) and x.strip()).split())


class _Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.now = _Node("", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, dict(attrs), self.now)
        self.now.items.append(node)
        if tag not in _VOID:
            self.now = node

    def handle_endtag(self, tag):
        at = self.now
        while at is not None and at.tag != tag:
            at = at.parent
        if at is not None and at.parent is not None:
            self.now = at.parent

    def handle_data(self, data):
        self.now.items.append(data)


def parse_page(html: str | None) -> dict:
    """The fields of one page; what it lacks is None."""
    every = list((root := _Tree(html or "").root).walk())
    nodes = [x for x in every if isinstance(x, _Node)]
    first = lambda *tags: next((x for x in nodes if x.tag in tags), None)
    squeeze = lambda s: " ".join(s.split())
    h1, h3, when = first("h1"), first("h3"), first("time")
    date = when.text().strip() if when and when.text().strip() else None
    if not date and h1:
        after = [x for x in every[every.index(h1) :] if isinstance(x, str)][:8]
        date = next((x.strip() for x in after if _DATE.search(x)), None)
    location = None
    for i, x in enumerate(nodes):
        if x.tag in ("h3", "h4") and x.text().strip().lower() == "location":
            location = nodes[i + 1].clean() if i + 1 < len(nodes) else None
            break
    ids = (re.match(r"/node/(\d+)", x.attrs.get("href") or "") for x in nodes if x.tag == "a")
    main = next((x for x in nodes if x.attrs.get("id") == "block-system-main"), None) or first("main") or root
    below = list(main.walk())
    paragraphs = [t for x in below if isinstance(x, _Node) and x.tag == "p" and (t := x.clean())]
    transcript = "\n\n".join(paragraphs) or None
    return {
        "title": squeeze(h1.text()) if h1 else None, "date_text": date, "president": squeeze(h3.text()) if h3 else None, "location": location,
        "node_id": next((m[1] for m in ids if m), None), "word_count": len(transcript.split()) if transcript else None,
        "has_video_flag": any(isinstance(x, str) and "watch video" in x.lower() for x in below), "transcript": transcript,
    }


@F.pandas_udf(FIELDS)
def page_fields(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_page(h) for h in html], columns=FIELDS.names).astype({"word_count": "Int32"})


def parse_pages(pages: DataFrame) -> DataFrame:
    """Rows of documents from url and html, with date_iso."""
    from ..functions.text import guess_date

    p = pages.select("url", page_fields("html").alias("f")).select("url", "f.*")
    return p.withColumn("date_iso", guess_date(F.col("date_text")))


def document_links(html: str | None, base: str) -> list[str]:
    """Addresses of documents that a listing page links, first seen first."""
    from urllib.parse import urljoin

    root = _Tree(html or "").root
    main = next((x for x in root.walk() if isinstance(x, _Node) and x.tag == "main"), root)
    links = (x.attrs.get("href") or "" for x in main.walk() if isinstance(x, _Node) and x.tag == "a")
    return list(dict.fromkeys(urljoin(base, h) for h in links if h.startswith("/documents/")))


def has_next(html: str | None) -> bool:
    for x in _Tree(html or "").root.walk():
        if isinstance(x, _Node) and x.tag == "ul" and "pagination" in (x.attrs.get("class") or "").split():
            return any(isinstance(a, _Node) and a.tag == "a" and "next" in a.text(" ").lower() for a in x.walk())
    return False


def listed_documents(listing: DataFrame, base: str) -> DataFrame:
    """(url, page, pos): each linked document at its first place. listing: page, html."""
    links = F.udf(lambda h: document_links(h, base), "array<string>")
    x = listing.select("page", F.posexplode(links("html")).alias("pos", "url"))
    return x.groupBy("url").agg(F.min(F.struct("page", "pos")).alias("at")).select("url", "at.page", "at.pos")


def unseen(urls: DataFrame, seen: DataFrame) -> DataFrame:
    """urls without those in seen (column value; blank lines do not count)."""
    s = seen.select(F.trim("value").alias("__seen")).where("__seen <> ''").distinct()
    return urls.join(s, F.col("url") == F.col("__seen"), "left_anti")


def with_transcript(rows: DataFrame, min_words: int = 30) -> DataFrame:
    return rows.where(F.col("transcript").isNotNull() & (F.coalesce("word_count", F.lit(0)) >= min_words))


def http_get(url: str, max_retries: int = 5, timeout: float = 30, pause=time.sleep, fetch=None) -> str:
    """The body at url; tries again with growing pauses, then raises RuntimeError."""
    from urllib.request import Request, urlopen

    fetch = fetch or (lambda u: urlopen(Request(u, headers={"User-Agent": "echotrace"}), timeout=timeout).read().decode("utf-8", "replace"))
    for i in range(max_retries):
        try:
            return fetch(url)
        except OSError:
            pause(0.5 + 0.5 * i)
    raise RuntimeError(f"no answer after {max_retries} tries: {url}")


def listing_pages(category: str, items_per_page: int = 60, max_pages: int | None = None, get=http_get):
    """(page, html) of a category's listing until no next link is there or max_pages are read."""
    page = 0
    while True:
        html = get(f"{category}?items_per_page={items_per_page}&page={page}")
        yield page, html
        page += 1
        if (max_pages and page >= max_pages) or not has_next(html):
            return
