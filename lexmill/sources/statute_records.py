"""Statutory XML to nested rows in one pass: nodes with paths, references, annotations and effects."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urldefrag, urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from lexmill.functions.batches import pieces
from lexmill.sources.statutes import AKN, CLML, HEADING, NUMBER, dialect, local, squeeze

# Elements that hold notes and effects, and attributes that point elsewhere, without case. Fixed values.
NOTES = {"AKN": {"note", "authorialnote", "editorialnote", "remark"}, "CLML": {"commentary", "commentaryref", "commentaryitem", "margincommentary", "footnote", "note"}}
EFFECTS = {"changes", "change", "effect", "effects", "textualamendment", "commencement", "modification"}
LINKS = {"AKN": ("href", "ref", "refersto", "uri"), "CLML": ("uri", "href", "ref")}
FIELDS = {
    "nodes": "array<struct<node_id string, parent_id string, node_type string, number string, heading string, eid string, depth int, ordinal int, sibling int, path array<int>, text string>>",
    "refs": "array<struct<reference_id string, node_id string, anchor string, href string, url string, page string, fragment string, element string>>",
    "annotations": "array<struct<element string, eid string, text string>>",
    "effects": "array<struct<element string, attributes map<string,string>, text string>>",
}


def attribute(e: ElementTree.Element, names: tuple[str, ...]) -> str | None:
    own = {local(k): v for k, v in e.attrib.items()}
    return next((own[n] for n in names if own.get(n)), None)


def whole(e: ElementTree.Element) -> str:
    return squeeze(" ".join(e.itertext()))


def records(document: object, xml: str | None, base: str | None) -> dict[str, list] | None:
    """The nested rows of one document; None where the XML is broken or of neither dialect.

    A node's path has its place among the structural children of each structural element above it, from 1; its id is made of the document's and its own id, else of its type and number, else of type and path.
    A reference belongs to each structural element around it and is numbered within it.
    """
    try:
        root = ElementTree.fromstring((xml or "").encode())
    except ElementTree.ParseError:
        return None
    kind = dialect(root)
    if kind is None:
        return None
    types, out = {"AKN": AKN, "CLML": CLML}[kind], {k: [] for k in FIELDS}
    held = {"children": 0, "path": []}
    stack = [(root, [])]  # elements in document order, and the open nodes around each
    while stack:
        e, around = stack.pop()
        name = local(e.tag)
        if name in types:
            above = around[-1] if around else held
            above["children"] += 1
            path = [*above["path"], above["children"]]
            own = {}
            for child in e:
                what = "number" if local(child.tag) in NUMBER else "heading" if local(child.tag) in HEADING else None
                if what:
                    own.setdefault(what, whole(child))
            number, eid = own.get("number", "").strip("().") or None, attribute(e, ("eid", "id"))
            safe = lambda x: re.sub("[^A-Za-z0-9_.-]+", "_", x)
            node = f"{document}__{safe(eid) if eid else types[name] + '__' + (safe(number) if number else '_'.join(map(str, path)))}"
            out["nodes"].append((node, above.get("id"), types[name], number, own.get("heading"), eid, len(path) - 1, len(out["nodes"]) + 1, path[-1], path, whole(e)))
            around = [*around, {"id": node, "children": 0, "path": path, "refs": 0}]
        href = attribute(e, LINKS[kind])
        if href and around:
            url = urljoin(base or "", href)
            page, fragment = urldefrag(url)
            for n in around:
                n["refs"] += 1
                out["refs"].append((f"{n['id']}__REF_{n['refs']:04d}", n["id"], whole(e), href, url, page, fragment or None, name))
        if name in NOTES[kind] and whole(e):
            out["annotations"].append((name, attribute(e, ("id", "eid")), whole(e)))
        if kind == "CLML" and name in EFFECTS and (e.attrib or whole(e)):
            out["effects"].append((name, {local(k): v for k, v in e.attrib.items()}, whole(e) or None))
        stack += [(child, around) for child in reversed(e)]
    return out


def parse(docs: DataFrame, id_col: str, xml_col: str, url_col: str | None = None) -> DataFrame:
    """``(id, nodes, refs, annotations, effects)``, a row a document, all arrays null where it can't be read; one pass over each document's XML, some megabyte at a time. ``records_of`` gives one kind as rows."""
    schema = StructType([docs.schema[id_col], *(StructField(k, _parse_datatype_string(v)) for k, v in FIELDS.items())])
    arrow = to_arrow_schema(schema)
    names = {k: [f.name for f in schema[k].dataType.elementType.fields] for k in FIELDS}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in pieces(batch)):
            found = [records(*row) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            rows = {k: [None if x is None else [{n: list(v.items()) if isinstance(v, dict) else v for n, v in zip(names[k], r, strict=True)} for r in x[k]] for x in found] for k in FIELDS}
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field(0).type), *(pa.array(rows[k], arrow.field(k).type) for k in FIELDS)], schema=arrow)

    return docs.select(id_col, xml_col, (F.col(url_col) if url_col else F.lit(None)).cast("string").alias("_url")).mapInArrow(work, schema)


def records_of(parsed: DataFrame, id_col: str, kind: str) -> DataFrame:
    """One kind of the nested rows, ``nodes``, ``refs``, ``annotations`` or ``effects``, as rows in document order (``place``)."""
    return parsed.select(id_col, F.posexplode(kind).alias("place", "x")).select(id_col, (F.col("place") + 1).alias("place"), "x.*")
