"""Main text of web pages by a site style tree.

The DOMs of one host are merged: a style node is a path of tags with their classes and ids. A node
has importance by entropy, from two sides. Content: a node's features are the texts of its blocks; a
feature that n of the node's m pages share has entropy log n / log m, and importance is 1 less the mean
entropy over its blocks: text that every page repeats gives 0, text of one page each gives 1.
Presentation: a node's styles are the sequences of its child blocks, and importance is the entropy of
its pages over them, to the base m. A parent's importance is (1 - GAMMA) of its presentation and GAMMA
of its content; a node seen on few pages tells nothing and counts as important. The tags themselves
say more: navigation, forms, scripts and the like, and classes that name them, have no importance;
``article`` and ``main`` are exempt from such classes, but for those of comments on ``article``. Branches
of low importance are removed from each page, inside its article too, and if a page marks its article,
what lies outside is removed as well. The rest, which may be nothing, is joined block by block.

The tree is summed on the map side from hashes; texts are not shuffled for it. A page then meets only
the low nodes of its host, a list bounded by the host's templates. Pages join these lists by host; a
host with over 1/HOT_SHARE of all pages, of which there are at most HOT_SHARE, is salted into parts of
that many pages, and its list goes to each part.

Edge cases. A null html counts as empty and gives an empty text; a null url is a host of its own. Cut
off or unclosed markup is read as far as it goes. Repeated rows each give a row, and count once per
row as pages of the host. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import small_batches, texts
from .common import table

LOW, LEAST_PAGES, GAMMA = 0.2, 4, 0.9
HOT_SHARE, HOT_LEAST = 1000, 64
NOISE_TAGS = frozenset("head nav footer aside form script style noscript iframe button select option template svg canvas textarea dialog menu object title".split())
MAIN_TAGS = frozenset(("article", "main"))
NOISE_NAMES = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo cookie cookies consent notice popup modal sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs comment comments disqus footer share sharing social related newsletter subscribe login search toolbar pager pagination".split()
)
COMMENT_NAMES = frozenset(("comment", "comments", "disqus"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag closes an open element of these tags that stands directly above.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?>[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)""", re.S)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Element:
    __slots__ = ("tag", "path", "above", "noise", "main", "article")

    def __init__(self, tag: str, names: list[str], above: Element | None):
        self.tag = tag
        self.path = hash_path(above.path if above else 0, tag, names)
        self.above = above.path if above else 0
        inside = above is not None and above.main
        words = {w for n in names for w in re.split(r"[-_\s]+", n)}
        noise = tag in NOISE_TAGS or (tag == "header" and not inside) or bool(words & (COMMENT_NAMES if tag == "article" else NOISE_NAMES) and tag not in ("body", "html", "main"))
        self.noise = noise or (above is not None and above.noise)
        self.main = inside or tag in MAIN_TAGS
        self.article = tag == "article" or (above is not None and above.article)


def hash_path(above: int, tag: str, names: list[str]) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(f"{above} {tag} {' '.join(sorted(names))}", 0)


def blocks(html: str) -> list[tuple[Element, str]]:
    """The page's blocks of text in order, each with the block element that it stands in."""
    out: list[tuple[Element, str]] = []
    stack = [Element("", [], None)]
    text: list[str] = []
    known: dict[tuple[int, str, str], Element] = {}

    def end_block() -> None:
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                out.append((stack[-1], joined))

    def pop_to(depth: int) -> None:
        end_block()
        del stack[depth:]

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            text.append(unescape(html[at:]))
            break
        if m.start() > at:
            text.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag in BLOCK or tag in NOISE_TAGS:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        pop_to(depth)
                        break
            continue
        if tag in _RAW:
            close = _RAW[tag].search(html, at)
            at = close.end() if close else size
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in BLOCK and tag not in NOISE_TAGS:
            continue
        if tag in VOID:
            end_block()
            continue
        end_block()
        if stack[-1].tag == "p" and tag in BLOCK:
            pop_to(len(stack) - 1)
        while stack[-1].tag in CLOSES.get(tag, ()):
            pop_to(len(stack) - 1)
        if stack[-1].tag == "head" and tag in BLOCK:
            pop_to(len(stack) - 1)
        rest = m["rest"] or m["rest2"] or ""
        key = (id(stack[-1]), tag, rest)
        if key not in known:
            names = [w for x in _NAMES.findall(rest) for w in (x[1] or x[2] or x[3]).lower().split()] if "=" in rest else []
            known[key] = Element(tag, names, stack[-1])
        stack.append(known[key])
    end_block()
    return out


def main_text(html: str, low: frozenset[int] = frozenset()) -> str:
    """The page's main text; low: the style nodes of its site that have low importance."""
    rest = [(e, t) for e, t in blocks(html) if not e.noise]
    marked = [x for x in rest if x[0].article] or [x for x in rest if x[0].main]
    return "\n".join(t for e, t in marked or rest if e.path not in low and e.above not in low)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def style_nodes(html: str) -> set[tuple[int, int, int]]:
    """(path, value, kind) of one page: kind 0 is a content feature, 1 the page itself, 2 the presentation."""
    from xxhash import xxh64_intdigest

    out: set[tuple[int, int, int]] = set()
    children: dict[int, list[int]] = {}
    for e, t in blocks(html):
        feature = xxh64_intdigest(t, 1)
        out |= {(e.path, feature, 0), (e.above, feature, 0), (e.path, 0, 1), (e.above, 0, 1)}
        children.setdefault(e.above, []).append(e.path)
    return out | {(path, xxh64_intdigest(str(c), 2), 2) for path, c in children.items()}


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance): the nodes of each host's merged DOM."""
    small_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            rows = [(host, *x) for host, html in zip(b.column(0).to_pylist(), texts(b, "html")) for x in style_nodes(html.decode())]
            if rows:
                host, path, value, kind = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(host), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (path, value, kind))], ["host", "path", "value", "kind"])

    found = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path bigint, value bigint, kind bigint")
    n = found.groupBy("host", "path", "value", "kind").agg(F.count("*").alias("n"))
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    node = n.groupBy("host", "path").agg(
        F.max(of(1, F.col("n"))).alias("pages"), F.sum(of(0, F.col("n"))).alias("blocks"), F.sum(of(0, F.col("n") * F.ln("n"))).alias("shared"),
        F.sum(of(2, F.col("n"))).alias("styled"), F.sum(of(2, F.col("n") * F.ln("n"))).alias("alike"),
    )
    several = F.col("pages") > 1
    content = F.when(several, 1 - F.col("shared") / F.col("blocks") / F.ln("pages")).otherwise(1.0)
    presentation = F.when(several, (F.ln("styled") - F.col("alike") / F.col("styled")) / F.ln("pages")).otherwise(1.0)
    importance = F.when(F.col("styled").isNull(), content).otherwise((1 - GAMMA) * presentation + GAMMA * content)
    return node.select("host", "path", "pages", importance.alias("importance"))


def extract(pages: DataFrame, low: float = LOW, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    nodes = style_tree(pages).where((F.col("pages") >= least_pages) & (F.col("importance") < low))
    lists = nodes.groupBy("host").agg(F.collect_set("path").alias("low"))
    p = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    most = max(math.ceil(pages.count() / HOT_SHARE), HOT_LEAST)
    # At most HOT_SHARE rows, so their broadcast is bounded.
    hot = p.groupBy("host").count().where(F.col("count") > most).select(F.col("host").alias("hot"), F.ceil(F.col("count") / most).alias("parts"))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    lists = lists.join(F.broadcast(hot), F.col("host") == F.col("hot"), "left").select(F.col("host").alias("h"), "low", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("s"))
    p = p.join(F.broadcast(hot), F.col("host") == F.col("hot"), "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), parts))
    p = p.join(lists, (F.col("host") == F.col("h")) & (F.col("salt") == F.col("s")), "left").select("page_id", "url", "html", "low")

    def run(batches):
        for b in batches:
            lows = [frozenset(x & (2**64 - 1) for x in v or ()) for v in b.column(3).to_pylist()]
            out = [main_text(h.decode(), v) for h, v in zip(texts(b, "html"), lows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return p.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
