"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Every neighbouring pair that is a token is queued in the bucket of its merge rank;
a two-level bitmap over the ranks finds the lowest bucket in use by find-first-set, and the bucket gives its leftmost
position. An entry whose pair has changed since is stale and skipped. A merge touches two pairs only, so a pre-token of n
bytes takes n log n steps and not n squared. Many pre-tokens share one queue, which spreads the cost of a look at the
bitmap over all places in a bucket.

Null text counts as empty and gives no ids. Repeated rows each get a row; only id and text are read. A text is encoded in
blocks of pre-tokens and the table of known pre-tokens is bounded in bytes, so memory grows with one text, its ids and its
longest pre-token (about 300 bytes for each byte of it while it is merged), and not with the corpus.
"""

from __future__ import annotations

import base64
import sys
from array import array
from heapq import heappop, heappush
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_maps import mapped, resident, small_batches
from .common import pick

#: Bytes of known pre-tokens and their ids kept per worker (an entry counts ``ENTRY`` bytes and what it holds); the table is
#: emptied when full, and a pre-token of more than ``LONG`` characters is never kept.
KNOWN_BYTES, ENTRY, LONG = 60_000_000, 170, 256
BLOCK = 1 << 16
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


class ByteBPE:
    def __init__(self, path: str, pattern: str, limit: int = KNOWN_BYTES):
        self.limit = limit
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.held = 0

    @classmethod
    def load(cls, path: str, pattern: str, limit: int = KNOWN_BYTES) -> ByteBPE:
        """One per worker process."""
        return resident((path, pattern, limit), lambda: cls(path, pattern, limit))

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens, which share one queue: no pair spans two of them, so none of them sees the others."""
        rank = self.ranks.get
        data = b"".join(pieces)
        n = len(data)
        text = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # rank of the pair that begins at each place, -1 for none
        queued = [rank(data[i : i + 2], -1) for i in range(n)]
        firsts, end = [], 0
        for piece in pieces:
            firsts.append(end)
            before[end] = -1
            end += len(piece)
            after[end - 1] = n
            queued[end - 1] = -1
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        top = 0
        for i, r in enumerate(queued):
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    w = r >> 8
                    words[w] = words.get(w, 0) | 1 << (r & 255)
                    top |= 1 << w
        while top:
            low = top & -top
            w = low.bit_length() - 1
            bits = words[w]
            bit = bits & -bits
            r = w << 8 | bit.bit_length() - 1
            places = buckets[r]
            least = r
            while places and least >= r:
                i = heappop(places)
                if queued[i] != r:  # stale
                    continue
                j = after[i]
                k = after[i] = after[j]
                text[i] = merged = text[i] + text[j]
                queued[j] = queued[i] = -1
                h = before[i]
                if h >= 0:
                    x = queued[h] = rank(text[h] + merged, -1)
                    if x >= 0:
                        if x in buckets:
                            heappush(buckets[x], h)
                        else:
                            buckets[x] = [h]
                            w = x >> 8
                            words[w] = words.get(w, 0) | 1 << (x & 255)
                            top |= 1 << w
                        if x < least:
                            least = x
                if k < n:
                    before[k] = i
                    x = queued[i] = rank(merged + text[k], -1)
                    if x >= 0:
                        if x in buckets:
                            heappush(buckets[x], i)
                        else:
                            buckets[x] = [i]
                            w = x >> 8
                            words[w] = words.get(w, 0) | 1 << (x & 255)
                            top |= 1 << w
                        if x < least:
                            least = x
            if not places:
                del buckets[r]
                w = r >> 8
                words[w] ^= 1 << (r & 255)
                if not words[w]:
                    top ^= 1 << w
        out = []
        for i in firsts:
            ids = []
            while i < n:
                ids.append(rank(text[i]))
                i = after[i]
            out.append(ids)
        return out

    def learn(self, pieces: list[str], into: dict[str, bytes]) -> None:
        """The packed ids of pre-tokens."""
        rank = self.ranks.get
        some, size = [], 0
        for p in pieces:
            b = p.encode()
            if (whole := rank(b)) is not None:
                into[p] = whole.to_bytes(4, "little")
                continue
            some.append((p, b))
            size += len(b)
            if size > BLOCK:
                self._learn(some, into)
                some, size = [], 0
        if some:
            self._learn(some, into)

    def _learn(self, some: list[tuple[str, bytes]], into: dict[str, bytes]) -> None:
        for (p, _), ids in zip(some, self.merge([b for _, b in some]), strict=True):
            into[p] = array("I", ids).tobytes() if _LITTLE else b"".join([i.to_bytes(4, "little") for i in ids])

    def _ready(self, every: set[str]) -> dict[str, bytes]:
        """A table that has all of these: the known ones, or those and what is too long or too much to be kept."""
        known = self.known
        new = [p for p in every if p not in known]
        if not new:
            return known
        short = [p for p in new if len(p) <= LONG]
        size = sum(map(len, short)) * 2 + ENTRY * len(short)
        if self.held + size > self.limit:
            known.clear()
            self.held = 0
            new = list(every)
            short = [p for p in new if len(p) <= LONG]
            size = sum(map(len, short)) * 2 + ENTRY * len(short)
        if size > self.limit:
            found: dict[str, bytes] = {}
            self.learn(new, found)
            return found
        self.learn(short, known)
        self.held += size
        if len(short) == len(new):
            return known
        found = {p: known[p] for p in every if len(p) <= LONG}
        self.learn([p for p in new if len(p) > LONG], found)
        return found

    def pack(self, pieces: list[str]) -> bytes:
        """Ids of pre-tokens as little-endian unsigned 32-bit integers."""
        known = self.known
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            known = self._ready(set(pieces))
        return b"".join([known[p] for p in pieces])

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """As ``encode`` for each text; what is new in all of them goes through one queue."""
        found = [self.pattern.findall(x) if x and len(x) <= 8 * BLOCK else None for x in texts]
        known = self._ready(set().union(*filter(None, found)))
        packed = [None if x is None else b"".join([known[p] for p in x]) for x in found]
        return [self.encode(x) if p is None else p for x, p in zip(texts, packed, strict=True)]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(text) <= 8 * BLOCK:
            return self.pack(self.pattern.findall(text))
        found, out = (m[0] for m in self.pattern.finditer(text)), []
        while block := list(islice(found, BLOCK)):
            out.append(self.pack(block))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def encode(docs: DataFrame, path: str, pattern: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers)."""

    def make():
        bpe = ByteBPE.load(path, pattern)
        return lambda texts: {"ids": bpe.encode_all(texts)}

    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType
    return rows.mapInArrow(mapped(make, "text", _schema(kind, ids=pa.binary()), ["doc_id"]), f"doc_id {kind.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded (binary)."""

    def make():
        bpe = ByteBPE.load(path, pattern)
        return lambda ids: {"decoded": [bpe.decode(x or b"") for x in ids]}

    small_batches(encoded.sparkSession)
    rows = encoded.select("doc_id", "ids")
    kind = rows.schema["doc_id"].dataType
    return rows.mapInArrow(mapped(make, "ids", _schema(kind, ids=pa.binary(), decoded=pa.binary()), ["doc_id", "ids"]), f"doc_id {kind.simpleString()}, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, *, id_col="doc_id", text_col="text", known_bytes: int = KNOWN_BYTES, carry: list[str] | None = None) -> DataFrame:
    """``decode(encode(docs))`` in one pass, for half the worker processes: doc_id, ids, decoded, and the long columns that
    ``carry`` names."""
    carry = carry or []

    def make():
        bpe = ByteBPE.load(path, pattern, known_bytes)

        def f(texts):
            ids = bpe.encode_all(texts)
            return {"ids": ids, "decoded": list(map(bpe.decode, ids))}

        return f

    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col, **{c: c for c in carry})
    kind = rows.schema["doc_id"].dataType
    schema = _schema(kind, ids=pa.binary(), decoded=pa.binary(), **{c: pa.int64() for c in carry})
    return rows.mapInArrow(mapped(make, "text", schema, ["doc_id", *carry]), f"doc_id {kind.simpleString()}, ids binary, decoded binary" + "".join(f", {c} long" for c in carry))


def _schema(kind, **columns: pa.DataType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([("doc_id", to_arrow_type(kind)), *columns.items()])


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and what was carried along."""
    more = [c for c in decoded.columns if c not in ("doc_id", "ids", "decoded")]
    return decoded.select("doc_id", *more, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
