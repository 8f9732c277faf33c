"""Packing token sequences: best-fit decreasing, certified by dual-feasible functions, with exchanges where a bound leaves a gap.

1. Texts are encoded and cut into pieces of at most ``capacity`` tokens; only longer texts are cut, and the last piece may be
   shorter. Pieces are written once, with a number each; from then on only (number, length) moves.
2. Pieces are dealt to partitions by a hash of their number, so equal lengths or one source never meet in one task. A
   partition of at most about ``PER_TASK`` pieces is packed by best-fit decreasing, and its number of sequences is held
   against the best of three families of dual-feasible functions (``lower_bound``). Equal means certified: no packing of
   these pieces needs fewer.
3. Partitions with a gap give all their pieces into the exchange. As a sum of bounds is rounded up in every partition, each
   certified one gives the pieces of its emptiest sequence. What is exchanged is dealt anew, to as few partitions as can hold
   it, and packed again; a turn counts only if it takes fewer sequences than its pieces took before. Turns end when the
   exchanged pieces themselves are certified in one partition, when their number reaches their own bound, or after ``TURNS``.

An exchange mends what rounding and an unlucky deal cost. Where best-fit decreasing itself falls short of the optimum in every
mixture (few lengths, all of about a third of the capacity), a gap to the bound stays.

Every turn is a written table, so a lost executor repeats a task and finds the same numbers. The driver sees counts and a
histogram of lengths (``capacity`` rows at most).

Null texts count as empty: one piece that holds the end id alone. Null ids and repeated rows each have pieces of their own.
An empty table gives no rows. Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_maps import BATCH_ROWS, slices, small_batches
from .bitplane import Encoder
from .byte_bpe import _schema
from .common import drop_stored, pick, stored

CAPACITY = 4096
#: Pieces that a task packs at most, about, and the fewest for which another task is worth while.
PER_TASK, LEAST = 200_000, 5_000
TURNS = 6
#: Parameters that the bounds try: the steps of u(k), and the thresholds of the other two families.
STEPS, THRESHOLDS = 24, 512


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """For lengths in descending order: the bin of each, its offset there, and what is left in every bin. The fullest bin
    that takes a piece gets it; bins of equal room are taken last opened first."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, room, bins, offsets = 0, [], [], []  # open_rooms: bit r is set if a bin has room r
    for n in lengths:
        above = open_rooms >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms ^= 1 << r
        else:
            b, r = len(room), capacity
            room.append(0)
        bins.append(b)
        offsets.append(capacity - r)
        r -= n
        room[b] = r
        if r:
            by_room[r].append(b)
            open_rooms |= 1 << r
    return bins, offsets, room


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The fewest bins that pieces can need: counts[n] pieces of length n. The largest sum, rounded up, over
    dual-feasible functions of x = n / capacity (Fekete and Schepers), all in whole numbers:

    * u(k): x where (k + 1) x is whole, else floor((k + 1) x) / k;
    * U(e): 1 above 1 - e, 0 below e, x between; and u(k) applied to it;
    * phi(e): 1 - floor((1 - x) / e) / floor(1 / e) above one half, 1 / floor(1 / e) from e to one half, 0 below."""
    n = np.flatnonzero(counts)
    if not len(n):
        return 0
    c, size = counts[n].astype(object), n.astype(np.int64)
    best = -(-int((c * size).sum()) // capacity)
    half = size[2 * size <= capacity]
    some = half if len(half) <= THRESHOLDS else half[np.linspace(0, len(half) - 1, THRESHOLDS).astype(int)]
    # a threshold just above each length matters as well: it leaves the length out
    thresholds = sorted({int(e) for e in some} | {int(e) + 1 for e in some if 2 * (e + 1) <= capacity} | {1})
    # prefix sums over rising lengths, of every step's value times k * capacity
    upto = lambda v: np.concatenate(([0], np.cumsum(c * v)))
    number = upto(np.ones(len(n), np.int64).astype(object))
    steps = [(1, upto(size.astype(object)))]
    for k in range(1, STEPS + 1):
        whole = (size * (k + 1)) % capacity == 0
        steps.append((k, upto(np.where(whole, size * k, (size * (k + 1) // capacity) * capacity).astype(object))))
    low = np.searchsorted(size, thresholds, "left")
    high = np.searchsorted(size, capacity - np.array(thresholds), "right")
    for k, sums in steps:
        values = (number[-1] - number[high]) * (k * capacity) + sums[high] - sums[low]
        best = max(best, max(-(-int(v) // (k * capacity)) for v in values))
    for e in thresholds:
        q = capacity // e
        value = np.where(2 * size > capacity, q - (capacity - size) // e, np.where(size >= e, 1, 0))
        best = max(best, -(-int((c * value.astype(object)).sum()) // q))
    return best


def cut(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, *, narrow: bool = False, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, piece (from 0), start, length, ids (little-endian unsigned 32-bit integers, the end id included; ``narrow``: 16-bit
    ones if all ids of a slice fit, which the number of bytes tells)."""
    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType
    schema = _schema(kind, piece=pa.int32(), start=pa.int64(), length=pa.int64(), ids=pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, most = Encoder.load(path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for some in slices(batch, "text", BATCH_ROWS):
                row, piece, ids = [], [], []
                for i, x in enumerate(encoder.encode(some.column("text"))):
                    x += end
                    for k, at in enumerate(range(0, len(x), most)):
                        row.append(i)
                        piece.append(k)
                        ids.append(x[at : at + most])
                length = pa.array([len(x) // 4 for x in ids], pa.int64())
                if narrow:
                    every = np.frombuffer(b"".join(ids), "<u4")
                    if every.max(initial=0) < 1 << 16:
                        raw, ends = every.astype("<u2").tobytes(), np.cumsum([len(x) // 2 for x in ids]).tolist()
                        ids = [raw[a:z] for a, z in zip([0, *ends], ends, strict=False)]
                piece = pa.array(piece, pa.int32())
                start = pa.array([p * capacity for p in piece.to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column("doc_id").take(pa.array(row, pa.int32())), piece, start, length, pa.array(ids, pa.binary())], schema=schema)

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids binary")


@dataclass
class Turn:
    """A written packing: number, length, sequence_id, offset, again (the piece goes into the exchange)."""

    rows: DataFrame
    sequences: int
    exchanged: int  # pieces that go into the exchange
    exchanged_sequences: int  # sequences that they take now


def _partitions(n: int, per_task: int, parallel: int) -> int:
    return max(1, -(-n // per_task), min(parallel, n // LEAST))


def _turn(items: DataFrame, n: int, capacity: int, turn: int, per_task: int) -> Turn:
    """Packs n items (number, length), partition by partition."""
    parts = _partitions(n, per_task, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        every = pa.Table.from_batches(held)
        number, length = every["number"].to_numpy(), every["length"].to_numpy()
        if length.min() < 1 or length.max() > capacity:
            raise ValueError(f"lengths must be from 1 to {capacity}")
        order = np.lexsort((number, -length))
        number, length = number[order], length[order]
        bins, offsets, room = best_fit_decreasing(length.tolist(), capacity)
        again = np.ones(len(number), bool)
        if len(room) == lower_bound(np.bincount(length, minlength=capacity + 1), capacity):
            again = np.array(bins) == int(np.argmax(room)) if max(room) else ~again
        base = (turn << 56) | (every["part"][0].as_py() << 32)
        out = [pa.array(number), pa.array(length), pa.array(np.array(bins, np.int64) + base), pa.array(np.array(offsets, np.int64)), pa.array(again)]
        for b in pa.Table.from_arrays(out, names=["number", "length", "sequence_id", "offset", "again"]).to_batches(BATCH_ROWS * 8):
            yield b

    part = F.pmod(F.xxhash64(F.lit(turn), "number"), F.lit(parts)).cast("int")
    dealt = items.select("number", "length", part.alias("part")).repartitionById(parts, "part")
    rows = stored(dealt.mapInArrow(run, "number long, length long, sequence_id long, offset long, again boolean"), f"packed-{turn}")
    first = F.col("offset") == 0
    got = rows.agg(F.count_if(first), F.count_if("again"), F.count_if(first & F.col("again"))).first()
    return Turn(rows, *got)


def place(items: DataFrame, capacity: int = CAPACITY, *, per_task: int = PER_TASK, turns: int = TURNS) -> DataFrame:
    """items: number (long, each once), length (1 to capacity). Returns number, sequence_id, offset."""
    n, now = items.count(), None
    done: list[DataFrame] = []
    before = None  # sequences that the items of this turn took so far
    for k in range(turns + 1):
        new = _turn(items, n, capacity, k, per_task)
        if now is not None and new.sequences >= before:
            drop_stored(new.rows)
            break
        if now is not None:
            done.append(now.rows.where(~F.col("again")))
        now, one = new, _partitions(n, per_task, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))) == 1
        # pieces of one certified partition, or nothing to exchange: nothing can be gained
        if not now.exchanged or (one and now.exchanged_sequences <= 1):
            break
        items, n, before = now.rows.where("again").select("number", "length"), now.exchanged, now.exchanged_sequences
        if before <= certificate(items, capacity):
            break
    out = now.rows
    for rows in done:
        out = out.unionByName(rows)
    return out.select("number", "sequence_id", "offset")


def widened(pieces: DataFrame) -> DataFrame:
    """ids of 16 bits as ids of 32 bits again; the other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "ids", BATCH_ROWS):
                ids, length = some.column("ids").to_pylist(), some.column("length").to_pylist()
                ids = [x if len(x) == 4 * n else np.frombuffer(x, "<u2").astype("<u4").tobytes() for x, n in zip(ids, length, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()) if c == "ids" else some.column(c) for c in some.schema.names], names=some.schema.names)

    return pieces.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema))


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, *, per_task: int = PER_TASK, turns: int = TURNS, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset: each piece of each document and its place."""
    # written and shuffled with 16 bits an id where they fit
    pieces = stored(cut(docs, path, end_id, capacity, narrow=True, id_col=id_col, text_col=text_col).withColumn("number", F.monotonically_increasing_id()), "pieces")
    placed = place(pieces.select("number", "length"), capacity, per_task=per_task, turns=turns)
    return widened(pieces.join(placed, "number").drop("number"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids (binary), parts (the lengths of the pieces in order, for attention masks). A sequence is
    bounded by its capacity."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    out = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), rows.alias("rows"))
    ids = F.aggregate("rows", F.lit(b""), lambda all_ids, r: F.concat(all_ids, r["ids"]))
    return out.select("sequence_id", "length", ids.alias("ids"), F.transform("rows", lambda r: r["length"]).alias("parts"))


def certificate(items: DataFrame, capacity: int = CAPACITY) -> int:
    """The fewest sequences that all items together can need, by ``lower_bound`` of the histogram of their lengths."""
    histogram = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("length").count().collect():  # a row per length
        histogram[r["length"]] = r["count"]
    return lower_bound(histogram, capacity)
