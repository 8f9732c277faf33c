"""Bodies of pages chosen by an XPath that comes with each row, with an explicit fallback.

The subset: steps with / (child) or // (descendant), a name or *, and predicates [n], [@a], [@a='v'] and [contains(@a, 'v')],
taken one after another as XPath does. Paths are matched while the page is read: a node keeps the steps that it has reached, so
no tree is built. Names and attribute names are lower case, as the reader gives them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markup import VOID, Walker, body, bounded_batches, spread

_STEP = re.compile(r"(//?)([A-Za-z][\w.-]*|\*)((?:\[[^\]]*\])*)")
_PREDICATE = re.compile(r"\[\s*(?:(?P<n>\d+)|@(?P<has>[\w:-]+)|@(?P<attr>[\w:-]+)\s*=\s*(?P<q>['\"])(?P<value>.*?)(?P=q)|contains\(\s*@(?P<part>[\w:-]+)\s*,\s*(?P<p>['\"])(?P<inside>.*?)(?P=p)\s*\))\s*\]")


def compiled(xpath: str) -> list[tuple[bool, str, list]]:
    """(descendant, name, predicates) of each step; ``ValueError`` for what is outside of the subset."""
    steps, at = [], 0
    while at < len(xpath):
        m = _STEP.match(xpath, at)
        if not m:
            raise ValueError(f"not in the XPath subset: {xpath}")
        predicates, k = [], 0
        while k < len(m[3]):
            p = _PREDICATE.match(m[3], k)
            if not p:
                raise ValueError(f"not in the XPath subset: {xpath}")
            g = p.groupdict()
            predicates.append(int(g["n"]) if g["n"] else (g["has"], None, None) if g["has"] else (g["attr"].lower(), g["value"], None) if g["attr"] else (g["part"].lower(), None, g["inside"]))
            k = p.end()
        steps.append((m[1] == "//", m[2].lower(), predicates))
        at = m.end()
    if not steps:
        raise ValueError("an empty XPath")
    return steps


class _Selector(Walker):
    def __init__(self, steps: list[tuple[bool, str, list]]):
        super().__init__()
        self.steps = steps
        self.reached: dict[str, set[int]] = {self.stack[0].path: {0}}  # steps that are to come below a node
        self.found: list[str] = []
        self.seen: dict[tuple, int] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        super().handle_starttag(tag, attrs)
        if tag in VOID:
            return
        node, parent = self.stack[-1], self.stack[-2]
        below = self.reached[parent.path]
        now: set[int] = set()
        for k in below:
            descendant, name, predicates = self.steps[k]
            if descendant:
                now.add(k)  # still to be found further down
            if name in ("*", tag) and self._holds(parent, k, predicates, node):
                if k + 1 == len(self.steps):
                    self.found.append(node.path)
                else:
                    now.add(k + 1)
        self.reached[node.path] = now

    def _holds(self, parent, step: int, predicates: list, node) -> bool:
        for k, p in enumerate(predicates):
            if isinstance(p, int):
                key = (parent.path, step, k)
                n = self.seen[key] = self.seen.get(key, 0) + 1
                if n != p:
                    return False
            else:
                name, value, inside = p
                own = node.attrs.get(name)
                if own is None or (value is not None and own != value) or (inside is not None and inside not in own):
                    return False
        return True


def select(html: str | None, xpath: str) -> tuple[list[str], Walker]:
    """The paths of the elements that an XPath selects, in order, and the page as ``markup`` reads it."""
    w = _Selector(compiled(xpath))
    if html:
        w.feed(html)
    w.finish()
    return list(dict.fromkeys(w.found)), w


def chosen_bodies(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", xpath_col: str = "body_xpath") -> DataFrame:
    """page id, status, location_status, blocks (node_path, start, end, text: offsets in the body), body.

    With an XPath, exactly one element must be selected (status ``selected``); its blocks are the body. Otherwise the status says
    why there is none: ``body_xpath_must_select_one_element`` or ``unsupported_xpath``. Without one (null or empty) the body is
    the page's own, as text without locations (status ``fallback``, ``text_only_unlocated``). A page without text is
    ``no_text_extracted``."""
    kind = pages.schema[id_col].dataType.simpleString()

    def one(html: str | None, xpath: str | None) -> tuple[str, str, list[dict], str | None]:
        if not xpath:
            text = body(html)[0]
            return ("fallback", "text_only_unlocated", [], text) if text else ("no_text_extracted", "not_available", [], None)
        try:
            paths, page = select(html, xpath)
        except ValueError:
            return "unsupported_xpath", "not_available", [], None
        if len(paths) != 1:
            return "body_xpath_must_select_one_element", "not_available", [], None
        out, at = [], 0
        for b in page.blocks:
            inside = b["node_path"] == paths[0] or b["node_path"].startswith(paths[0] + "/")
            if inside and not b["omitted"] and b["normalized_text"]:
                out.append({"node_path": b["node_path"], "start": at, "end": at + len(b["normalized_text"]), "text": b["normalized_text"]})
                at += len(b["normalized_text"]) + 1
        if not out:
            return "no_text_extracted", "not_available", [], None
        return "selected", "source_xpath_pending_audit", out, "\n".join(x["text"] for x in out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(key, *one(html, xpath)) for key, html, xpath in zip(pdf[id_col], pdf[html_col], pdf[xpath_col], strict=True)]
            yield pd.DataFrame(rows, columns=[id_col, "status", "location_status", "blocks", "body"])

    bounded_batches(pages.sparkSession)
    rows = spread(pages.select(id_col, html_col, F.col(xpath_col).alias(xpath_col)))
    return rows.mapInPandas(run, f"{id_col} {kind}, status string, location_status string, blocks array<struct<node_path:string,start:int,end:int,text:string>>, body string")
