"""Markup to rows: blocks, table cells with spans and headers, located text, metadata. Python's own parser, one pass."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Element classes.
SKIP = {"script", "style", "noscript", "template", "svg", "iframe", "form", "button"}
VOID = {"br", "img", "hr", "meta", "link", "input", "col", "area", "base", "source", "wbr"}
BLOCK = {"p", "div", "section", "article", "main", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "figcaption", "td", "th", "tr", "table", "header", "footer", "nav", "aside", "title", "body", "html"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
OMIT = re.compile(r"(^|[\s_-])(ad|ads|advert|banner|related|share|social|promo|copyright|hidden|nav|menu|footer)([\s_-]|$)", re.I)
ROLES = {"header": "header", "footer": "footer", "nav": "navigation", "aside": "aside", "figcaption": "caption", "blockquote": "quote"}
#: Spans and places in a table are 32-bit numbers.
MOST = 2**31 - 1
# An element that a new one ends.
ENDS = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}


class Node:
    __slots__ = ("tag", "attrs", "path", "counts", "omitted", "role")

    def __init__(self, tag: str, attrs: dict, path: str, omitted: str | None, role: str | None):
        self.tag, self.attrs, self.path, self.omitted, self.role = tag, attrs, path, omitted, role
        self.counts: dict[str, int] = {}


class Walker(HTMLParser):
    """Collects text atoms with their path, role and omission, cells with their grid place, images and metadata."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [Node("", {}, "", None, None)]
        self.blocks: list[dict] = []
        self.sections: list[tuple[int, str]] = []
        self.meta: dict[str, list[str]] = {"title": [], "canonical": [], "og_url": [], "published": [], "byline": [], "json_ld": []}
        self.tables: list[dict] = []
        self.open_tables: list[dict] = []
        self.text: list[str] = []
        self.at: Node | None = None
        self.raw: list[str] = []

    def _flush(self) -> None:
        if self.at is None:
            return
        raw = "".join(self.text)
        text = re.sub(r"\s+", " ", raw).strip()
        node, self.at, self.text = self.at, None, []
        if not text:
            return
        kind = "heading" if node.tag in HEADINGS else "cell" if node.tag in ("td", "th") else "list_item" if node.tag == "li" else "title" if node.tag == "title" else "paragraph"
        if node.tag == "title":
            self.meta["title"].append(text)
        if node.tag in HEADINGS and not node.omitted:
            level = int(node.tag[1])
            self.sections = [s for s in self.sections if s[0] < level] + [(level, text)]
        if re.search(r"byline|author", " ".join(str(v) for v in node.attrs.values()), re.I):
            self.meta["byline"].append(text)
        if kind != "cell":
            self._emit(kind, raw, text, node)

    def _emit(self, kind: str, raw: str, text: str, node: Node, **more) -> None:
        self.blocks.append({"block_type": kind, "raw_text": raw, "normalized_text": text, "node_path": node.path, "omitted": node.omitted, "role": node.role or "body", "section_path": " > ".join(s for _, s in self.sections), "table_id": None, "row_index": None, "col_index": None, "rowspan": None, "colspan": None, "header_refs": None, "href": None} | more)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in ENDS:
            while len(self.stack) > 1 and self.stack[-1].tag in ENDS[tag]:
                self._pop()
        parent = self.stack[-1]
        n = parent.counts[tag] = parent.counts.get(tag, 0) + 1
        label = f"{a.get('class', '')} {a.get('id', '')}"
        omitted = parent.omitted or (f"element:{tag}" if tag in SKIP else "attribute" if OMIT.search(label) or "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")) else None)
        node = Node(tag, a, f"{parent.path}/{tag}[{n}]", omitted, ROLES.get(tag, parent.role))
        if tag in BLOCK:
            self._flush()
        if tag == "meta":
            key = (a.get("property") or a.get("name") or "").lower()
            for name, keys in (("og_url", ("og:url",)), ("published", ("article:published_time", "date", "pubdate"))):
                if key in keys:
                    self.meta[name].append(a.get("content", ""))
        elif tag == "link" and a.get("rel") == "canonical":
            self.meta["canonical"].append(a.get("href", ""))
        elif tag == "img" and not omitted:
            self._flush()
            self._emit("image", a.get("alt", ""), re.sub(r"\s+", " ", a.get("alt", "")).strip(), node, href=a.get("src"))
        elif tag == "br" and self.at is not None:
            self.text.append("\n")
        elif tag == "table":
            table = {"id": f"T{len(self.tables) + 1}", "row": -1, "col": 0, "taken": [], "cells": [], "node": node, "context": next((b["normalized_text"] for b in reversed(self.blocks) if b["block_type"] != "cell"), None)}
            self.tables.append(table)
            self.open_tables.append(table)
        elif tag == "tr" and self.open_tables:
            self.open_tables[-1]["row"] += 1
            self.open_tables[-1]["col"] = 0
        elif tag in ("td", "th") and self.open_tables:
            t = self.open_tables[-1]
            t["row"] = max(t["row"], 0)
            # cells that reach down from rows above, as (first row below, first column, first column beyond)
            t["taken"] = [x for x in t["taken"] if x[0] > t["row"]]
            while hit := next((x for x in t["taken"] if x[1] <= t["col"] < x[2]), None):
                t["col"] = hit[2]
            span = [min(MOST, int(m[0])) if (m := re.match(r"\s*\d+", a.get(k, ""))) and int(m[0]) else 1 for k in ("rowspan", "colspan")]
            cell = {"row": t["row"], "col": t["col"], "rowspan": span[0], "colspan": span[1], "head": tag == "th", "parts": [], "node": node}
            if span[0] > 1:
                t["taken"].append((t["row"] + span[0], t["col"], t["col"] + span[1]))
            t["col"] = min(MOST, t["col"] + span[1])
            t["cells"].append(cell)
        if tag not in VOID:
            self.stack.append(node)

    def _pop(self) -> None:
        node = self.stack[-1]
        if node.tag in BLOCK:
            self._flush()
        self.stack.pop()
        if node.tag == "table" and self.open_tables:
            self._close_table(self.open_tables.pop())

    def _close_table(self, t: dict) -> None:
        heads = [c for c in t["cells"] if c["head"] or c["row"] == 0]
        for c in t["cells"]:
            raw = "".join(c["parts"])
            above = [h for h in heads if h["row"] < c["row"] and h["col"] < c["col"] + c["colspan"] and c["col"] < h["col"] + h["colspan"]]
            beside = [h for h in t["cells"] if h["row"] <= c["row"] < h["row"] + h["rowspan"] and h["col"] < c["col"] and (h["head"] or h["col"] == 0)]
            refs = [f"{t['id']}:{h['row']}:{h['col']}" for h in sorted(above + beside[:1], key=lambda h: (h["row"], h["col"]))]
            self._emit("cell", raw, re.sub(r"\s+", " ", raw).strip(), c["node"], table_id=t["id"], row_index=c["row"], col_index=c["col"], rowspan=c["rowspan"], colspan=c["colspan"], header_refs=refs)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not any(n.tag == tag for n in self.stack):
            return
        while self.stack[-1].tag != tag:
            self._pop()
        self._pop()

    def handle_data(self, data: str) -> None:
        node = self.stack[-1]
        if node.tag == "script" and node.attrs.get("type") == "application/ld+json":
            self.meta["json_ld"].append(data)
        if node.omitted and node.omitted.startswith("element:"):
            return
        if self.open_tables and self.open_tables[-1]["cells"] and any(n.tag in ("td", "th") for n in self.stack):
            self.open_tables[-1]["cells"][-1]["parts"].append(data)
            return
        if self.at is None:
            self.at = next(n for n in reversed(self.stack) if n.tag in BLOCK or not n.tag)
        self.text.append(data)

    def finish(self) -> None:
        self.close()
        self._flush()
        while len(self.stack) > 1:
            self._pop()


def walk(html: str | None) -> Walker:
    w = Walker()
    if html:
        w.feed(html)
    w.finish()
    return w


BLOCK_COLUMNS = ["block_type", "raw_text", "normalized_text", "node_path", "omitted", "role", "section_path", "table_id", "row_index", "col_index", "rowspan", "colspan", "header_refs", "href"]
_TYPES = {"row_index": "int", "col_index": "int", "rowspan": "int", "colspan": "int", "header_refs": "array<string>"}


#: Blocks in one frame that goes back to Spark.
FRAME_ROWS = 4096
#: Pages, and characters of markup, whose bodies go back to Spark in one batch.
SLICE_PAGES, SLICE_CHARS = 128, 1 << 20
#: Pages that come to Python in one batch at most: it is held whole, whatever the pages' length.
BATCH_PAGES = 512


def bounded_batches(spark: SparkSession) -> None:
    """A Python worker holds a batch of pages whole, so the session's batches are bounded."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_PAGES:
        spark.conf.set(name, str(BATCH_PAGES))


def spread(pages: DataFrame) -> DataFrame:
    """Pages over all cores, where the scan has fewer partitions than cores: parsing costs more than moving them."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return pages.repartition(cores) if len(pages.inputFiles()) < cores else pages


def blocks(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per block in document order: page id, seq, block_id and the block's columns. Null and empty pages have none."""
    kind = pages.schema[id_col].dataType.simpleString()
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(keys, seq, rows):
            out = pd.DataFrame(rows, columns=BLOCK_COLUMNS)
            out.insert(0, "seq", seq)
            out.insert(0, id_col, keys)
            return out.astype({c: "Int64" for c in ("row_index", "col_index", "rowspan", "colspan")})

        for pdf in batches:
            keys, seq, rows = [], [], []
            for key, html in zip(pdf[id_col], pdf[html_col], strict=True):
                found = walk(html).blocks
                keys += [key] * len(found)
                seq += range(len(found))
                rows += found
                if len(rows) >= FRAME_ROWS:
                    yield frame(keys, seq, rows)
                    keys, seq, rows = [], [], []
            if rows:
                yield frame(keys, seq, rows)

    schema = f"{id_col} {kind}, seq int, " + ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in BLOCK_COLUMNS)
    out = spread(pages.select(id_col, html_col)).mapInPandas(run, schema)
    from ..functions.ids import stable_id

    return out.withColumn("block_id", stable_id("B", F.col(id_col), F.col("node_path"), F.col("seq")))


def body(html: str | None | Walker) -> tuple[str, list[dict], list[dict]]:
    """The readable body as one text, its atoms with code-point offsets, and what was left out with the reason."""
    found = (html if isinstance(html, Walker) else walk(html)).blocks
    inside = [b for b in found if "/article[" in b["node_path"]] or [b for b in found if "/main[" in b["node_path"]] or found
    parts, atoms, left, at = [], [], [], 0
    for b in inside:
        reason = b["omitted"] or (f"role:{b['role']}" if b["role"] in ("navigation", "footer", "aside") else None) or ("image" if b["block_type"] == "image" else None) or ("title" if b["block_type"] == "title" else None)
        if reason:
            left.append({"node_path": b["node_path"], "reason": reason, "chars": len(b["normalized_text"])})
            continue
        if parts:
            parts.append("\n")
            at += 1
        text = b["normalized_text"]
        atoms.append({"node_path": b["node_path"], "start": at, "end": at + len(text), "text": text, "position": {"heading": "heading", "cell": "table"}.get(b["block_type"], "caption" if b["role"] == "caption" else "body")})
        parts.append(text)
        at += len(text)
    return "".join(parts), atoms, left


def bodies(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page id, body, atoms, omissions, title, canonical, og_url, published, byline, quality."""
    kind = pages.schema[id_col].dataType.simpleString()
    bounded_batches(pages.sparkSession)

    def row(key, html):
        seen = walk(html)
        text, atoms, left = body(seen)
        first = {k: (v[0] if v else None) for k, v in seen.meta.items()}
        return {id_col: key, "body": text, "atoms": atoms, "omissions": left, "title": first["title"], "canonical": first["canonical"], "og_url": first["og_url"], "published": first["published"], "byline": first["byline"], "quality": "body_extracted" if len(text) >= 200 else "body_extracted_short" if text else "body_missing"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, chars = [], 0
            for k in range(batch.num_rows):
                html = batch.column(1)[k].as_py()
                out.append(row(batch.column(0)[k].as_py(), html))
                chars += len(html or "")
                if len(out) >= SLICE_PAGES or chars >= SLICE_CHARS:
                    yield pa.RecordBatch.from_pylist(out, layout(batch.schema.field(0).type))
                    out, chars = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, layout(batch.schema.field(0).type))

    def layout(key):
        atom = [("node_path", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("position", pa.string())]
        omission = [("node_path", pa.string()), ("reason", pa.string()), ("chars", pa.int32())]
        return pa.schema([(id_col, key), ("body", pa.string()), ("atoms", pa.list_(pa.struct(atom))), ("omissions", pa.list_(pa.struct(omission))), *[(c, pa.string()) for c in ("title", "canonical", "og_url", "published", "byline", "quality")]])

    schema = f"{id_col} {kind}, body string, atoms array<struct<node_path:string,start:int,end:int,text:string,position:string>>, omissions array<struct<node_path:string,reason:string,chars:int>>, title string, canonical string, og_url string, published string, byline string, quality string"
    return spread(pages.select(id_col, html_col)).mapInArrow(run, schema)


def block_coverage(found: DataFrame, key: str, gate: float = 0.995) -> DataFrame:
    """Per document: blocks, cells, non-white characters kept and left out, the share kept, and whether it passes."""
    n = F.length(F.regexp_replace("normalized_text", r"\s+", ""))
    by = found.groupBy(key).agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("block_type") == "cell").alias("cells"), F.sum(F.when(F.col("omitted").isNull(), n).otherwise(0)).alias("kept"), F.sum(n).alias("total"))
    return by.withColumn("coverage", F.try_divide("kept", "total")).withColumn("passes", F.col("coverage") >= gate)
