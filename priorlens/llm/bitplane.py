"""Token ids in files of bit planes.

Documents are encoded, put in ascending id order, and written as one file per range of ids. A file holds the ids of its
documents one after another, cut into blocks of ``BLOCK`` ids. A block of n ids is a matrix of n x 32 bits (or n x 4
bytes); its transpose puts the bits (bytes) of equal weight side by side, and each of these planes is compressed with
zstandard on its own. Planes without a set bit take no space: ids of a 49k vocabulary fill 16 of 32.

File: ``BITPLANE`` and a version byte, a byte for the kind of planes (1 bit, 8 byte); the compressed planes of all blocks;
the index (JSON, zstandard): block starts in the file, ids per block and plane lengths, document ids and their token
counts; then the index's length as 8 bytes and the closing mark. A reader seeks to the index and streams the blocks.

Every attempt of a task writes a file of a new name and only then reports it; the manifest of reported files is all that
is read, so lost executors and speculative twins leave no trace in the result. Files are written below the shared folder
through pyarrow's file systems. A writer holds a block and its file's index (an id and a count for each document), a reader
the index, a block and a document; the number of files follows the bytes of text, at about ``FILE_BYTES`` each.

Null texts count as empty: they have the end id alone. Null ids come first. Repeated rows each get a row; rows of one id
are ordered by their ids. Only id and text are read. An empty table writes no file and gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_maps import BATCH_ROWS, resident, slices, small_batches
from .byte_bpe import _schema
from .common import make_folder, open_fs, pick, shared_path, stored, whole_path

BLOCK = 1 << 16
MARK = b"BITPLANE"
#: Bytes of known pieces and their ids kept per worker (an entry counts ``ENTRY`` bytes and what it holds); the table is
#: emptied when full, and a piece of more than ``LONG`` characters is never kept.
KNOWN_BYTES, ENTRY, LONG = 220_000_000, 170, 256
#: Text that a file should hold, the most files, and the ids sampled for each border between them.
FILE_BYTES, MAX_FILES, SAMPLE_IDS = 32 << 20, 100_000, 64


class Encoder:
    """A tokenizers file over whole texts.

    Texts of ASCII signs and plain Latin letters only are lower-cased and cut at the file's own pattern by Arrow; each
    distinct piece goes through the library once, many at a time (a piece ends where a token with the end-of-word mark
    does), and its ids are kept in a bounded table and gathered by index. All other texts go through the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        spec = json.loads(self.model.to_str())
        vocab = self.model.get_vocab()
        mark = spec["model"].get("end_of_word_suffix")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if mark:
            self.ends[[i for t, i in vocab.items() if t.endswith(mark)]] = True
        split = spec.get("pre_tokenizer") or {}
        split = next((x for x in split.get("pretokenizers", [split]) if x.get("type") == "Split"), {})
        # the short cut below is this pattern's; with any other one all texts go through the library whole
        self.cut = bool(mark) and split.get("invert") and split.get("behavior") == "Removed" and split["pattern"].get("Regex") == _PATTERN and "Lowercase" in json.dumps(spec.get("normalizer"))
        signs = "".join(re.escape(c) for c in map(chr, range(0x21, 0x7F)) if c not in {t["content"][:1] for t in spec.get("added_tokens", [])})
        self.plain = f"^[ \\n\\t\\r{signs}{_LATIN}]*$"
        self.pieces: dict[str, bytes] = {}
        self.held = 0

    @classmethod
    def load(cls, path: str) -> Encoder:
        return resident(path, lambda: cls(path))

    def _library(self, some: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch(some, add_special_tokens=False)]

    def _learn(self, new: list[str], into: dict[str, bytes]) -> None:
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            ids = np.array(self.model.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(some):
                raw, at = ids.tobytes(), [0, *(4 * at).tolist()]
                into.update(zip(some, [raw[a:z] for a, z in zip(at, at[1:], strict=False)], strict=True))
            else:
                into.update(zip(some, self._library(some), strict=True))

    def _ids(self, every: list[str]) -> list[bytes]:
        """Packed ids of distinct pieces."""
        pieces = self.pieces
        new = [p for p in every if p not in pieces]
        size = sum(ENTRY + 2 * len(p) for p in new if len(p) <= LONG)
        if self.held + size > KNOWN_BYTES:
            pieces.clear()
            self.held, new = 0, every
            size = sum(ENTRY + 2 * len(p) for p in new if len(p) <= LONG)
        found: dict[str, bytes] = {}
        if size <= KNOWN_BYTES:
            self._learn([p for p in new if len(p) <= LONG], pieces)
            self.held += size
            new = [p for p in new if len(p) > LONG]
        self._learn(new, found)
        return [found[p] if p in found else pieces[p] for p in every] if found else [pieces[p] for p in every]

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        import pyarrow.compute as pc

        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.cut:
            return self._library(column.to_pylist())
        plain = pc.match_substring_regex(column, self.plain)
        words, bounds = _pieces(pc.utf8_lower(pc.if_else(plain, column, "")))
        words = words.dictionary_encode()
        every, index = words.dictionary.to_pylist(), words.indices.to_numpy()
        packed = self._ids(every)
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        start = np.cumsum(size) - size
        n = size[index]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = np.frombuffer(b"".join(packed), "<u4")[np.repeat(start[index] - upto[:-1], n) + np.arange(upto[-1])]
        at = upto[bounds].tolist()
        out = [ids[a:z].tobytes() for a, z in zip(at, at[1:], strict=False)]
        if rest := np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist():
            for i, x in zip(rest, self._library(column.take(pa.array(rest)).to_pylist()), strict=True):
                out[i] = x
        return out


#: Letters that no normal form changes, but for case.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e"
# Fixed value: the pattern that ``_pieces`` follows.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[[*range(97, 123), *range(128, 256)]] = _LETTER  # beyond ASCII, plain texts have letters only
_CLASS[48:58] = _DIGIT


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased plain texts cut at the pattern, all at once: the pieces, and the first piece of each text. A piece is a
    run of letters or of other signs, or one digit; an apostrophe that stands alone takes its ending along."""
    size = texts.offset, texts.offset + len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[size[0] : size[1] + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    starts, n = offsets - offsets[0], len(data)
    if not n:
        return pa.array([], pa.string()), np.zeros(len(starts), np.int64)
    kind = _CLASS[data]
    first = np.ones(n, bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    begins = np.zeros(n + 3, bool)
    begins[starts] = True
    first |= begins[:n]
    if len(q := np.flatnonzero((data == 39) & first)):
        padded = np.concatenate((data, np.zeros(3, np.uint8)))
        a, b = np.where(begins[q + 1], 0, padded[q + 1]), np.where(begins[q + 1] | begins[q + 2], 0, padded[q + 2])
        short = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        ends = np.concatenate((q[short] + 2, q[long] + 3))
        first[q[short | long] + 1] = False
        first[ends[ends < n]] = True
    keep = kind != _SPACE
    at = np.flatnonzero(first & keep)
    place = np.cumsum(keep)
    borders = np.append(place[at] - 1, place[-1]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(borders), pa.py_buffer(data[keep]))
    return words, np.searchsorted(at, starts)


def encode(docs: DataFrame, path: str, end_id: int, *, borders: list | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, ids (binary), the end id included; with ``borders`` (rising ids) also part: how many of them lie below the id."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType
    schema = _schema(kind, ids=pa.binary(), **({} if borders is None else {"part": pa.int32()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.load(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for some in slices(batch, "text", BATCH_ROWS):
                new = [some.column("doc_id"), pa.array([x + end for x in encoder.encode(some.column("text"))], pa.binary())]
                if borders is not None:
                    new.append(pa.array([0 if i is None else bisect_left(borders, i) for i in some.column("doc_id").to_pylist()], pa.int32()))
                yield pa.RecordBatch.from_arrays(new, schema=schema)

    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, ids binary" + ("" if borders is None else ", part int"))


def planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The transpose of a block: 32 bit planes or 4 byte planes; empty where no bit is set."""
    any_bit = int(np.bitwise_or.reduce(ids)) if len(ids) else 0
    if not bits:
        raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [raw[:, k].tobytes() if any_bit >> 8 * k & 255 else b"" for k in range(4)]
    return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & np.uint8(1)).tobytes() if any_bit >> k & 1 else b"" for k in range(32)]


def unplanes(parts: list[bytes], n: int, bits: bool) -> np.ndarray:
    if not bits:
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(parts):
            if p:
                raw[:, k] = np.frombuffer(p, np.uint8)
        return raw.reshape(-1).view("<u4")
    out = np.zeros(n, "<u4")
    for k, p in enumerate(parts):
        if p:
            out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype("<u4") << np.uint32(k)
    return out


class Writer:
    def __init__(self, path: str, bits: bool, block: int, level: int):
        import zstandard

        files, at = open_fs(path)
        self.file, self.out = path, files.open_output_stream(at)
        self.bits, self.block, self.zip = bits, block, zstandard.ZstdCompressor(level=level)
        self.out.write(MARK + bytes([1, 1 if bits else 8]))
        self.at = len(MARK) + 2
        self.pending: list[bytes] = []
        self.waiting = self.total = 0
        self.blocks: list[list] = []
        self.doc_ids: list = []
        self.counts: list[int] = []

    def add(self, doc_id, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.pending.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= self.block:
            every = np.frombuffer(b"".join(self.pending), "<u4")
            whole = len(every) // self.block * self.block
            for i in range(0, whole, self.block):
                self._flush(every[i : i + self.block])
            self.pending, self.waiting = [every[whole:].tobytes()], len(every) - whole

    def _flush(self, ids: np.ndarray) -> None:
        sizes, start = [], self.at
        for p in planes(ids, self.bits):
            z = self.zip.compress(p) if p else b""
            self.out.write(z)
            sizes.append(len(z))
            self.at += len(z)
        self.blocks.append([start, len(ids), sizes])
        self.total += len(ids)

    def close(self) -> int:
        """The number of ids."""
        if self.waiting:
            self._flush(np.frombuffer(b"".join(self.pending), "<u4"))
        index = self.zip.compress(json.dumps({"blocks": self.blocks, "doc_ids": self.doc_ids, "counts": self.counts}).encode())
        self.out.write(index + len(index).to_bytes(8, "little") + MARK)
        self.out.close()
        return self.total


def read_file(path: str) -> Iterator[tuple[object, bytes]]:
    """(document id, its ids) in the order of the file."""
    import zstandard

    unzip = zstandard.ZstdDecompressor()
    files, path = open_fs(path)
    with files.open_input_file(path) as f:
        size = f.size()
        head = f.read(len(MARK) + 2)
        tail = f.read_at(8 + len(MARK), size - 8 - len(MARK))
        if head[: len(MARK)] != MARK or tail[8:] != MARK or head[len(MARK)] != 1:
            raise ValueError(f"{path} is not a whole bit-plane file")
        n = int.from_bytes(tail[:8], "little")
        index = json.loads(unzip.decompress(f.read_at(n, size - 8 - len(MARK) - n)))
        bits = head[-1] == 1

        def blocks():
            for start, count, sizes in index["blocks"]:
                raw, parts, at = f.read_at(sum(sizes), start), [], 0
                for s in sizes:
                    parts.append(unzip.decompress(raw[at : at + s]) if s else b"")
                    at += s
                yield unplanes(parts, count, bits)

        left, source = np.empty(0, "<u4"), blocks()
        for doc_id, count in zip(index["doc_ids"], index["counts"], strict=True):
            got = [left[:count]]
            have = len(got[0])
            left = left[count:]
            while have < count:
                left = next(source)
                got.append(left[: count - have])
                have += len(got[-1])
                left = left[len(got[-1]) :]
            yield doc_id, np.concatenate(got).tobytes()


def write_ids(docs: DataFrame, path: str, end_id: int, folder: str | None = None, *, files: int | None = None, bits: bool = True, block: int = BLOCK, level: int = 3, id_col="doc_id", text_col="text") -> DataFrame:
    """Writes the files; returns the manifest: number, file, start (ids in all files before it), n_ids, n_docs, in order."""
    spark = docs.sparkSession
    folder = whole_path(spark, folder) if folder else shared_path(spark, "bitplanes")
    make_folder(folder)
    rows = pick(docs, doc_id=id_col, text=text_col)
    borders = _borders(rows, files)
    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = encode(rows, path, end_id, borders=borders).repartitionById(len(borders) + 1, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    plain = (lambda v: v) if kind in WHOLE or kind == "string" else (lambda v: None if v is None else str(v))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, now, done = None, None, []

        def finish():
            if writer is not None:
                done.append((now, writer.file, len(writer.doc_ids), writer.close()))

        for batch in batches:
            ids = batch.column("ids")
            for k, (p, d) in enumerate(zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)):
                if p != now:
                    finish()
                    writer, now = Writer(f"{folder}/part-{p:06d}-{uuid.uuid4().hex}.ids", bits, block, level), p
                writer.add(plain(d), ids[k].as_py())
        finish()
        yield pa.RecordBatch.from_pydict({"part": [x[0] for x in done], "file": [x[1] for x in done], "n_docs": [x[2] for x in done], "n_ids": [x[3] for x in done]}, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    written = stored(dealt.mapInArrow(write, "part int, file string, n_docs long, n_ids long"), "manifest")
    rows, start = [], 0
    # one row per file, as many as there are partitions
    for r in written.orderBy("part").collect():
        rows.append((len(rows), r["file"], start, r["n_ids"], r["n_docs"]))
        start += r["n_ids"]
    return spark.createDataFrame(rows, "number long, file string, start long, n_ids long, n_docs long")


#: Types of ids that a file holds as numbers; all others are held as text.
WHOLE = ("tinyint", "smallint", "int", "bigint")


def _borders(rows: DataFrame, files: int | None) -> list:
    """Rising ids between which the files' ranges lie, from a sample of ids by their hash; about SAMPLE_IDS for each file.
    The sample tells where files end and nothing else."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    if files is None:
        most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        files = min(MAX_FILES, max(-(-(total["b"] or 0) // FILE_BYTES), min(most, total["n"])), total["n"])
    if files < 2 or not total["n"]:
        return []
    share = min(1.0, SAMPLE_IDS * files / total["n"])
    some = rows.select("doc_id").where("doc_id is not null").where(F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct()
    ids = sorted(r[0] for r in some.limit(4 * SAMPLE_IDS * files).collect())
    return sorted({ids[len(ids) * k // files] for k in range(1, files)}) if ids else []


def read_ids(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """doc_id (of the type it was written with), start, ids (binary) from the files."""
    n = max(1, manifest.count())
    whole = id_type in (*WHOLE, "long", "short", "byte")
    schema = pa.schema([("doc_id", pa.int64() if whole else pa.string()), ("start", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows, size = [], 0
                for doc_id, ids in read_file(file):
                    rows.append((doc_id, at, ids))
                    at += len(ids) // 4
                    size += len(ids)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    # a file a task: n is at most MAX_FILES
    dealt = manifest.select("file", "start", F.col("number").cast("int").alias("number")).repartitionById(n, "number").select("file", "start")
    return dealt.mapInArrow(read, f"doc_id {'long' if whole else 'string'}, start long, ids binary").select(F.col("doc_id").cast(id_type), "start", "ids")
