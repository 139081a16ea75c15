"""Web pages to ordered blocks, headings, links and metadata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DROPPED = {"script", "style", "nav", "form", "svg", "noscript", "template"}
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "tr", "blockquote"}
VOID = {"br", "img", "hr", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track"}
BLOCK = "array<struct<kind:string,level:int,text:string,path:string>>"
LINK = "array<struct<placeholder:string,href:string,anchor:string,block:int>>"


class Blocks(HTMLParser):
    """Collects blocks outside dropped elements; each block carries the headings above it, each link a placeholder, which with ``marked`` stands in the text behind the anchor."""

    def __init__(self, marked: bool = False):
        super().__init__(convert_charrefs=True)
        self.marked = marked
        self.blocks, self.links, self.title = [], [], ""
        self.dropped, self.kind, self.text, self.stack, self.cells = 0, None, [], [], []
        self.link, self.in_title = None, False

    def close_block(self) -> None:
        if self.kind is None:
            return
        text = " | ".join(filter(None, self.cells)) if self.kind == "tr" else re.sub(r"\s+", " ", "".join(self.text)).strip()
        if text:
            level = int(self.kind[1]) if self.kind[0] == "h" else 0
            if level:
                self.stack = [x for x in self.stack if x[0] < level]
            self.blocks.append({"kind": self.kind, "level": level, "text": text, "path": " > ".join(x[1] for x in self.stack)})
            if level:
                self.stack.append((level, text))
        self.kind, self.text, self.cells = None, [], []

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.dropped += 1
        elif not self.dropped:
            self.in_title = tag == "title"
            if tag in BLOCKS and not (self.kind == "tr"):
                self.close_block()
                self.kind = tag
            elif tag in ("td", "th"):
                self.text = []
            elif tag == "br":
                self.text.append(" ")
            elif tag == "a" and dict(attrs).get("href"):
                self.link = [dict(attrs)["href"], len(self.text)]

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
        elif not self.dropped:
            if tag == "title":
                self.in_title = False
            elif tag in ("td", "th") and self.kind == "tr":
                self.cells.append(re.sub(r"\s+", " ", "".join(self.text)).strip())
                self.text = []
            elif tag == "a" and self.link:
                name = f"[[LINK_{len(self.links) + 1:04d}]]"
                anchor = re.sub(r"\s+", " ", "".join(self.text[self.link[1] :])).strip()
                self.links.append({"placeholder": name, "href": self.link[0], "anchor": anchor, "block": len(self.blocks)})
                if self.marked:
                    self.text.append(f" {name}")
                self.link = None
            elif tag in BLOCKS and tag == self.kind:
                self.close_block()

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.dropped:
            if self.kind is None and data.strip():
                self.kind = "p"
            if self.kind:
                self.text.append(data)


#: What holds a page's content, first rule first: an article, else the main element, else the body, else all.
CONTENT = (r"(?is)<article\b[^>]*>(.*?)</article>", r"(?is)<main\b[^>]*>(.*?)</main>", r"(?is)<body\b[^>]*>(.*?)</body>")
#: Elements that carry no content.
CHROME = r"(?is)<(script|style|nav|form|svg|noscript|template|header|footer|aside)\b[^>]*>.*?</(script|style|nav|form|svg|noscript|template|header|footer|aside)>"


def main_content(html: Column) -> Column:
    """The part of a page that holds its content, without navigation, scripts and the like; null html has none."""
    whole = lambda p: F.when(F.regexp_extract(html, p, 1) != "", F.regexp_extract(html, p, 1))
    return F.regexp_replace(F.coalesce(*map(whole, CONTENT), html), CHROME, "")


def updates(text: Column) -> Column:
    """An update history's entries: ``array<struct<date_text, note>>`` of lines that begin with a date."""
    line = r"(?m)^\s*([0-9]{1,2} [A-Z][a-z]+ [0-9]{4})[:.\s-]+(.*)$"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(line), F.lit(1)).alias("date_text"), F.regexp_extract_all(text, F.lit(line), F.lit(2)).alias("note"))
    return F.transform(pairs, lambda p: F.struct(p["date_text"].alias("date_text"), F.trim(p["note"]).alias("note")))


def parse_pages(pages: DataFrame, id_col: str = "page_id", html: str = "html", marked: bool = False) -> DataFrame:
    """``(id, title, blocks, links)``; null html has neither. With ``marked`` the placeholders of links stand in the blocks' texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column(1).to_pylist():
                p = Blocks(marked)
                p.feed(text or "")
                p.close()
                p.close_block()
                made.append(p)
            block = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("path", pa.string())]))
            link = pa.list_(pa.struct([("placeholder", pa.string()), ("href", pa.string()), ("anchor", pa.string()), ("block", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.title.strip() for p in made]), pa.array([p.blocks for p in made], block), pa.array([p.links for p in made], link)], names=["id", "title", "blocks", "links"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), F.col(html).alias("html")).mapInArrow(work, f"id {kind}, title string, blocks {BLOCK}, links {LINK}").withColumnRenamed("id", id_col)


def structured_text(blocks: Column) -> Column:
    """Blocks as marked text: ``# heading``, ``- item``, ``> quote``."""
    line = lambda b: F.when(b["level"] > 0, F.concat(F.repeat(F.lit("#"), b["level"]), F.lit(" "), b["text"])).when(b["kind"] == "li", F.concat(F.lit("- "), b["text"])).when(b["kind"] == "blockquote", F.concat(F.lit("> "), b["text"])).otherwise(b["text"])
    return F.array_join(F.transform(blocks, line), "\n")


def classify_link(href: Column) -> Column:
    low = F.lower(href)
    return F.when(low.rlike("^(mailto|tel):"), "CONTACT").when(low.rlike(r"^#"), "FRAGMENT").when(low.rlike(r"\.(pdf|docx?|xlsx?|pptx?)([?#]|$)"), "DOCUMENT").when(low.rlike(r"legislation\.[a-z.]+/"), "LEGISLATION").when(low.rlike("^https?://"), "EXTERNAL").otherwise("INTERNAL")


def section_of(blocks: DataFrame, key: str, order: str, heading: str) -> DataFrame:
    """Blocks from a heading with the given text up to the next of the same or a higher level."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    at = F.max(F.when((F.col("level") > 0) & (F.col("text") == heading), F.struct(order, "level"))).over(w)
    b = blocks.withColumn("_at", at)
    ended = F.max(F.when((F.col("level") > 0) & (F.col(order) > F.col(f"_at.{order}")) & (F.col("level") <= F.col("_at.level")), 1)).over(w)
    return b.withColumn("_end", ended).where("_at is not null and _end is null").drop("_at", "_end")
