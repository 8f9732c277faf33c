"""XML entries of ZIP files as rows, read piece by piece, with recovery.

An entry is unpacked, decoded and cut into tags and texts in chunks; an element that ends gives its text at once. No tree is
kept: memory holds a chunk, the open elements and one text. What isn't well formed is mended: an end tag that nothing opened is
passed over, one that closes an outer element closes what is open within, a stray < or & is text, undecodable bytes are replaced,
and what is open at the end is closed. The number of faults is a column, so nothing is mended in silence.
"""

from __future__ import annotations

import codecs
import fnmatch
import io
import re
import zipfile
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

CHUNK = 1 << 16
#: Rows in one frame that goes back to Spark.
ROWS = 4096
TAG = re.compile(r"<(?P<end>/?)(?P<tag>[^\W\d][\w:.-]*)(?P<attrs>(?:\s[^<>]*?)?)(?P<empty>/?)>")
#: What goes on to its own end, whatever is inside.
ENCLOSED = {"<!--": "-->", "<![CDATA[": "]]>", "<?": "?>"}
DECLARATION = re.compile(r"<![A-Za-z][^>]*>")
ATTRIBUTE = re.compile(r"([^\W\d][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
STRAY = re.compile(r"<|&(?!#\d+;|#x[0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)")


class Reader:
    """``feed`` bytes, then ``close``; ``done`` gets (path, tag, attributes, own text, text of all below) of elements as they
    end. ``whole``: tags whose text includes that of the elements below."""

    def __init__(self, whole: frozenset[str] = frozenset()):
        self.decoder, self.rest, self.whole = None, "", whole
        self.open: list[tuple[str, str, dict, list[str], dict[str, int]]] = []  # tag, path, attributes, texts, counts of children
        self.top: dict[str, int] = {}
        self.done: list[tuple[str, str, dict, str]] = []
        self.faults = 0

    def feed(self, data: bytes, last: bool = False) -> None:
        if self.decoder is None:
            named = re.match(rb"<\?xml[^>]*encoding\s*=\s*['\"]([\w.-]+)", data.lstrip(b"\xef\xbb\xbf"))
            try:
                self.decoder = codecs.getincrementaldecoder(named[1].decode() if named else "utf-8")("replace")
            except LookupError:
                self.decoder, self.faults = codecs.getincrementaldecoder("utf-8")("replace"), self.faults + 1
        x, at = self.rest + self.decoder.decode(data, last), 0
        while (i := x.find("<", at)) >= 0:
            opener = next((o for o in ENCLOSED if x.startswith(o, i)), None)
            if opener:
                end = x.find(ENCLOSED[opener], i + len(opener))
                if end < 0 and not last:
                    break
                if end >= 0:
                    self._text(x[at:i])
                    if opener == "<![CDATA[":
                        self._add(x[i + len(opener) : end])
                    at = end + len(ENCLOSED[opener])
                    continue
            m = TAG.match(x, i) or DECLARATION.match(x, i)
            if m:
                self._text(x[at:i])
                at = m.end()
                if m.re is TAG and m["end"]:
                    self._end(m["tag"])
                elif m.re is TAG:
                    self._begin(m["tag"], {k: unescape(a or b) for k, a, b in ATTRIBUTE.findall(m["attrs"])})
                    if m["empty"]:
                        self._end(m["tag"])
            elif not last and not re.compile(r"[<>]").search(x, i + 1):
                break  # a tag that the chunk may have cut
            else:
                self._text(x[at : i + 1])
                at = i + 1
        upto = len(x) if i < 0 else i
        if not last and i < 0 and (cut := x.rfind("&", max(at, upto - 12))) >= 0:
            upto = cut  # an entity that the chunk may have cut
        self._text(x[at:upto])
        self.rest = x[upto:]

    def _add(self, text: str) -> None:
        if self.open and text:
            self.open[-1][3].append(text)

    def _text(self, x: str) -> None:
        if x:
            self.faults += len(STRAY.findall(x))
            self._add(unescape(x))

    def _begin(self, tag: str, attrs: dict) -> None:
        above = self.open[-1] if self.open else None
        counts = above[4] if above else self.top
        n = counts[tag] = counts.get(tag, 0) + 1
        self.open.append((tag, f"{above[1] if above else ''}/{tag}[{n}]", attrs, [], {}))

    def _end(self, tag: str) -> None:
        if not any(t == tag for t, *_ in self.open):
            self.faults += 1
            return
        while self.open:
            name, path, attrs, texts, _ = self.open.pop()
            self.faults += name != tag
            text = "".join(texts)
            if self.open and self.open[-1][0] in self.whole:
                self.open[-1][3].append(text)
            if text.strip() or attrs:
                self.done.append((path, name, attrs, text))
            if name == tag:
                return

    def close(self) -> None:
        self.feed(b"", True)
        self.faults += len(self.open)
        while self.open:
            self.faults -= 1
            self._end(self.open[-1][0])
            self.faults += 1


def _entries(spark: SparkSession, path: str, pattern: str, columns: list[str], types: str, rows_of) -> DataFrame:
    """rows_of(reader, flush) for each entry; readers get the entry's bytes chunk by chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if fnmatch.fnmatch(n.lower(), pattern)):
                        held = []
                        with z.open(name) as f:
                            for row in rows_of(f):
                                held.append((p, name, *row))
                                if len(held) >= ROWS:
                                    yield pd.DataFrame(held, columns=["path", "entry", *columns])
                                    held = []
                        if held:
                            yield pd.DataFrame(held, columns=["path", "entry", *columns])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, f"path string, entry string, {types}")


def blocks(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """path, entry, seq, xpath, tag, attributes (map), text of every element with text of its own or attributes, in the order
    in which they end, and faults so far."""

    def rows_of(f):
        reader, seq = Reader(), 0
        while True:
            data = f.read(CHUNK)
            reader.feed(data) if data else reader.close()
            for x, tag, attrs, text in reader.done:
                yield seq, x, tag, attrs, text.strip(), reader.faults
                seq += 1
            reader.done.clear()
            if not data:
                return

    return _entries(spark, path, pattern, ["seq", "xpath", "tag", "attributes", "text", "faults"], "seq long, xpath string, tag string, attributes map<string,string>, text string, faults long", rows_of)


def records(spark: SparkSession, path: str, record: str, fields: list[str], pattern: str = "*.xml") -> DataFrame:
    """path, entry, seq and the texts of the child elements of every ``record`` element (the first of each name; null if it
    has none): a table of entities, say."""

    def rows_of(f):
        reader, seq, found = Reader(), 0, {}
        below = re.compile(rf"^(.*/{re.escape(record)}\[\d+\])/({'|'.join(map(re.escape, fields))})\[1\]$")
        ends = re.compile(rf"/{re.escape(record)}\[\d+\]$")
        now = None
        while True:
            data = f.read(CHUNK)
            reader.feed(data) if data else reader.close()
            for x, _, _, text in reader.done:
                m = below.match(x)
                if m and m[1] != now and now is not None:
                    yield seq, *[found.get(k) for k in fields]
                    seq, found = seq + 1, {}
                if m:
                    now = m[1]
                    found[m[2]] = text.strip()
                elif ends.search(x) and x == now:
                    continue
            reader.done.clear()
            if not data:
                if now is not None:
                    yield seq, *[found.get(k) for k in fields]
                return

    return _entries(spark, path, pattern, ["seq", *fields], "seq long, " + ", ".join(f"`{k}` string" for k in fields), rows_of)
