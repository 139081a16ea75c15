"""Statutory XML of two dialects to rows of nodes."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

# Structural elements of each dialect and the node type they give. Fixed values.
AKN = {x: x for x in ("part", "chapter", "section", "article", "subsection", "paragraph", "subparagraph", "schedule")}
CLML = {"part": "part", "chapter": "chapter", "p1": "section", "p2": "subsection", "p3": "paragraph", "p4": "subparagraph", "schedule": "schedule"}
NUMBER, HEADING = {"num", "pnumber", "number"}, {"heading", "title", "subheading"}
SCHEMA = "document {kind}, dialect string, ordinal long, node_id string, parent_id string, depth long, node_type string, number string, heading string, text string"


def local(tag: object) -> str:
    return tag.rsplit("}", 1)[-1].lower() if isinstance(tag, str) else ""


def squeeze(text: str) -> str:
    return " ".join(text.split())


def dialect(root: ElementTree.Element) -> str | None:
    names = {local(e.tag) for e in root.iter()}
    if local(root.tag) in ("akomantoso", "act"):
        return "AKN"
    if local(root.tag) == "legislation" or names & {"p1", "p1group", "p2", "p3"}:
        return "CLML"
    return "AKN" if names & {"section", "article", "subsection", "paragraph"} else None


def nodes(document: object, xml: str | None) -> list[tuple]:
    """Rows of ``SCHEMA``, in document order. A node's text is all of its text but numbers and headings; nothing where the XML is broken or of neither dialect."""
    try:
        root = ElementTree.fromstring((xml or "").encode())
    except ElementTree.ParseError:
        return []
    kind = dialect(root)
    types = {"AKN": AKN, "CLML": CLML}.get(kind, {})
    rows, found = [], 0
    # element, parent's id, depth, heading of the group around it
    stack = [(root, None, 0, None)]
    while stack:
        e, parent, depth, outer = stack.pop()
        own = {}
        for child in e:
            name = local(child.tag)
            what = "number" if name in NUMBER else "heading" if name in HEADING else None
            if what:
                own.setdefault(what, squeeze("".join(child.itertext())))
        group = own.get("heading") if local(e.tag) == "p1group" else outer
        if local(e.tag) in types:
            found += 1
            number = own.get("number", "").strip("().")
            name = e.get("eId") or e.get("id") or (f"{types[local(e.tag)]}-{number}" if number else f"node-{found}")
            parts, walk = [], [(e, False)]
            while walk:  # text in order, without numbers and headings
                x, after = walk.pop()
                if after:
                    parts.append(x.tail or "")
                    continue
                if local(x.tag) not in NUMBER | HEADING:
                    parts.append(x.text or "")
                    for child in reversed(x):
                        walk += [(child, True), (child, False)]
            node = f"{document}__{name}"
            rows.append((document, kind, found, node, parent, depth, types[local(e.tag)], number or None, own.get("heading") or outer, squeeze(" ".join(parts)) or None))
            parent, depth, group = node, depth + 1, None
        stack += [(child, parent, depth, group) for child in reversed(e)]
    return rows


def parse(docs: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """Nodes of every document; ids are unique within a document as far as its own ids are."""
    schema = SCHEMA.format(kind=docs.schema[id_col].dataType.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([r for i, x in zip(f.iloc[:, 0].tolist(), f.iloc[:, 1].tolist(), strict=True) for r in nodes(i, x)], columns=names)

    return docs.select(id_col, xml_col).mapInPandas(work, schema)
