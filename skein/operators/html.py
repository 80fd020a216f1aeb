"""Pages to titles, descriptions, content blocks and links, with a tree built by the standard library's tokenizer.

Whole pages are mapped a batch at a time; nothing is shuffled. Malformed HTML is taken as browsers do in the cases
that matter here: p ends before a block element, li before li, cells and rows before their like, void elements have no
content, script and style are raw text.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import urls
from skein.sources.tables import reach_workers, small

# What is not content, and what is a block of it.
SKIPPED = {"nav", "script", "style", "form", "header", "footer", "aside", "noscript"}
SKIPPED_WORDS = ("nav", "menu", "sidebar", "footer", "header")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = {"p", "li", "pre", "blockquote", "td", "th"}

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"} | HEADINGS
LIKE = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
WALLS = {"table", "ul", "ol", "dl", "td", "th", "body", "html"}
SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_WORDS = re.compile(f"[^{SPACES}]+")


def words(text: str) -> list[str]:
    # split() takes the white space of SPACES and these four
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return _WORDS.findall(text)
    return text.split()


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Tree(HTMLParser):
    """Builds the tree under ``root``; every element in document order is in ``found``."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open, self.found = [self.root], []
        self.n_open: Counter[str] = Counter()  # by tag, so that nothing is looked for in a deep stack in vain
        self.feed(html)
        self.close()

    def _end(self, tags: set[str], walls: set[str]) -> None:
        if not any(self.n_open[t] for t in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                self._shut(k)
                return
            if self.open[k].tag in walls:
                return

    def _shut(self, k: int) -> None:
        self.n_open.subtract(x.tag for x in self.open[k:])
        del self.open[k:]

    def parse_marked_section(self, i, report=1):
        """A section mark of any name ends at the next >, as a comment that nobody closed does."""
        return self.rawdata.find(">", i) + 1 or -1

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body", "head"):
            if tag == "html":
                return
            if tag == "body":
                self._shut(1)
        if tag in ENDS_P:
            self._end({"p"}, WALLS)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._shut(len(self.open) - 1)
        if tag in LIKE:
            self._end(LIKE[tag], WALLS - LIKE[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(node)
        self.found.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.n_open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in ("html", "body"):
            self._end({tag}, WALLS - {tag} if tag not in ("p", "b", "i", "a", "span", "em", "strong") else WALLS)

    def handle_data(self, data):
        self.open[-1].children.append(data)


def skipped(node: Node) -> bool:
    if node.tag in SKIPPED:
        return True
    return any(w in node.attrs.get(a, "").lower() for a in ("class", "id", "role") for w in SKIPPED_WORDS)


def text_of(node: Node) -> str:
    """All words of the element, skipped elements left out; words of different text nodes never join."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out += words(x)
        elif x is node or not skipped(x):
            todo += reversed(x.children)
    return " ".join(out)


def blocks(root: Node) -> list[tuple[str | None, str]]:
    """(heading, text) of each content block in document order. The heading is the last one met, in whatever container."""
    out, heading, todo = [], None, [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str) or x is not root and skipped(x):
            continue
        if x.tag in HEADINGS:
            heading = text_of(x) or heading
        elif x.tag in BLOCKS:
            if text := text_of(x):
                out.append((heading, text))
        else:
            todo += reversed(x.children)
    return out


def raw_text(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo += reversed(x.children)
    return "".join(out)


def describe(found: list[Node], texts: list[str], least: int = 20, most: int = 247) -> str:
    """The first description, else the first Open Graph description, else words of the blocks."""
    for key, name in (("name", "description"), ("property", "og:description")):
        first = next((n for n in found if n.tag == "meta" and n.attrs.get(key) == name), None)
        if first is not None and (text := " ".join(words(first.attrs.get("content", "")))):
            return text
    cut = " ".join(t for t in (" ".join(words(x)) for x in texts) if len(t) >= least)[:most]
    return cut + "..." if len(cut.encode()) >= most - 1 else cut


def parse(html: str) -> tuple[str, str, list[tuple[str | None, str]], list[str]]:
    """title, description, blocks and raw hrefs of a page."""
    tree = Tree(html)
    title = next((raw_text(n).strip(SPACES) for n in tree.found if n.tag == "title"), "")
    got = blocks(tree.root)
    return title, describe(tree.found, [t for _, t in got]), got, [n.attrs["href"] for n in tree.found if n.tag == "a" and "href" in n.attrs]


_BLOCK = pa.list_(pa.struct([("heading", pa.string()), ("text", pa.string())]))


def extracted(batches):
    """page_id, url, title, description, blocks and hrefs from batches of page_id, url and html, a few pages at a time."""
    for b in small(batches):
        got = [parse(h) for h in b.column(2).to_pylist()]
        parts = [[{"heading": h, "text": t} for h, t in g[2]] for g in got]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array(parts, _BLOCK), pa.array([g[3] for g in got], pa.list_(pa.string()))], ["page_id", "url", "title", "description", "blocks", "hrefs"])


def extract(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """page_id, url, title, description, blocks (array of heading and text) and hrefs of each row of pages.

    Null html is an empty page; an over-long or broken page never fails the task.
    """
    reach_workers(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(extracted, f"page_id {kind}, url string, title string, description string, blocks array<struct<heading:string,text:string>>, hrefs array<string>")


def links(extracted: DataFrame) -> DataFrame:
    """page_id, url, pos and target of each link to a page, in document order, repeats kept."""
    each = extracted.select("page_id", "url", F.posexplode("hrefs").alias("pos", "href")).filter(urls.is_link(F.col("href")))
    target = each.withColumn("target", urls.normalize(urls.resolve(F.col("url"), F.col("href"))))
    return target.filter(F.col("target").isNotNull() & ~urls.is_file(F.col("target"))).select("page_id", "url", F.col("pos").cast("long").alias("pos"), "target")
