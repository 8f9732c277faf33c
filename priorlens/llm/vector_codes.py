"""Product codes of vectors: Lloyd's rounds over distinct weighted parts, in whole numbers.

1. A component x becomes floor(scale * x); a vector is cut into ``parts`` equal consecutive parts. Equal parts at a position
   are one row with a weight, so copies cost nothing after this first grouping (which combines before it shuffles).
2. The codebook of a position starts as that part of the ``entries`` smallest ids. A round gives each distinct part its
   nearest entry (squared Euclidean distance, ties to the lower index) and each entry the componentwise floor of its parts'
   weighted mean; unused entries stay. Tasks hold the codebooks (at most ``entries`` x components whole numbers for each
   length of vectors) and add up weighted sums and counts per entry before anything is shuffled; the driver gets a sum per entry.
3. The last assignment is joined back to the vectors. Parts that many vectors share are broadcast (at most ``HEAVY`` rows,
   since each has more than a HEAVY-th of all), the others are joined by a shuffle, so no part makes a hot key.

Vectors that are null or hold a null or non-finite component take no part and have no row. Vectors of each length are a group
with codebooks of its own; lengths that ``parts`` doesn't divide are cut so that the first parts are one longer. A component
beyond 2^27 after scaling stops the operator with an error, as squared distances wouldn't fit 64 bits. Null ids come last in
the order of ids, equal ids are ordered by their vectors; repeated rows each get a row. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, pick, stored

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows of a key with more than 1 / HEAVY of all rows are joined by broadcast.
HEAVY = 1000
#: Components beyond this don't fit; below LARGE products of floats are exact whole numbers.
MOST, LARGE = 1 << 27, 1 << 22


def quantised(vectors: DataFrame, scale: float = SCALE, *, id_col="vec_id", vector_col="embedding", label_col="label") -> DataFrame:
    """vec_id, label, v (array of int), number (of the row): written, so that numbers stay."""
    rows = pick(vectors, vec_id=id_col, vector=vector_col, label=label_col)
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    fits = F.forall("v", lambda x: F.abs(x) <= MOST)
    rows = rows.where(F.col("vector").isNotNull() & finite).select("vec_id", "label", whole.alias("v"))
    held = F.when(fits, F.col("v").cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component is beyond {MOST} after scaling")).cast("array<int>"))
    return stored(rows.select("vec_id", "label", held.alias("v"), F.monotonically_increasing_id().alias("number")), "quantised")


def part_of(v: str | Column, k: int, parts: int = PARTS) -> Column:
    """The k-th (from 0) of consecutive parts."""
    v = F.col(v) if isinstance(v, str) else v
    n = F.size(v)
    # sizes differ by one at most; equal ones if parts divides the length
    size, more = F.floor(n / parts), n % parts
    start = size * k + F.least(F.lit(k), more)
    return F.slice(v, (start + 1).cast("int"), (size + (F.lit(k) < more).cast("int")).cast("int"))


def _parts(rows: DataFrame, parts: int, *keep: str) -> DataFrame:
    every = F.array(*[F.struct(F.lit(k).alias("part"), part_of("v", k, parts).alias("value")) for k in range(parts)])
    return rows.select(*keep, F.size("v").alias("dims"), F.explode(every).alias("x")).select(*keep, "dims", "x.part", "x.value")


class Codebooks:
    """Entries by (length of the vectors, position): arrays of whole numbers."""

    def __init__(self, books: dict[tuple[int, int], np.ndarray]):
        self.books = books

    def nearest(self, dims: int, part: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and the squared distance, exact."""
        book = self.books[dims, part]
        n, (m, width) = len(values), book.shape
        code, error = np.empty(n, np.int64), np.empty(n, np.int64)
        big = max(abs(values).max(initial=0), abs(book).max(initial=0)) > LARGE
        step = max(1, (1 << 20) // max(1, m * (width if big else 1)))
        for i in range(0, n, step):
            x = values[i : i + step]
            if big:
                d = ((x[:, None] - book) ** 2).sum(axis=2)
            else:
                a, b = x.astype(np.float64), book.astype(np.float64)
                d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
            c = d.argmin(axis=1)  # the first of equally near ones
            code[i : i + step], error[i : i + step] = c, d[np.arange(len(x)), c]
        return code, error

    def moved(self, sums: list) -> Codebooks:
        """sums: rows of dims, part, entry, count, total (list). Floor of the mean; the others stay."""
        books = {k: b.copy() for k, b in self.books.items()}
        for r in sums:
            books[r["dims"], r["part"]][r["entry"]] = [int(t) // r["count"] for t in r["total"]]
        return Codebooks(books)

    def sha256(self, dims: int) -> str:
        every = [str(int(x)) for (d, _), b in sorted(self.books.items()) if d == dims for x in b.reshape(-1)]
        return hashlib.sha256(",".join(every).encode()).hexdigest()


def _groups(batch: pa.RecordBatch):
    """dims, part, row numbers and values of each (dims, part) of a batch."""
    dims, part = batch.column("dims").to_numpy(), batch.column("part").to_numpy()
    column = batch.column("value")
    for d, p in sorted(set(zip(dims.tolist(), part.tolist(), strict=True))):
        at = np.flatnonzero((dims == d) & (part == p))
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        yield d, p, at, flat.reshape(len(at), -1)


def start(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The parts of the smallest ids of each length: ``entries`` rows of each length reach the driver."""
    books = {}
    for r in rows.select(F.size("v").alias("dims")).distinct().collect():  # a row per length of vectors
        least = rows.where(F.size("v") == r["dims"]).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries)
        vectors = [x["v"] for x in least.select("v").collect()]
        every = np.array(vectors, np.int64).reshape(len(vectors), r["dims"])
        for k, block in enumerate(np.array_split(every, parts, axis=1)):
            books[r["dims"], k] = block
    return Codebooks(books)


def sums(distinct: DataFrame, books: Codebooks) -> DataFrame:
    """dims, part, entry, count, total (array of decimals): weighted over the distinct parts nearest to each entry."""
    cast = "dims int, part int, entry int, count long, total array<long>"
    schema = pa.schema([("dims", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("count", pa.int64()), ("total", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, out = batch.column("weight").to_numpy(), []
            for d, p, at, values in _groups(batch):
                code, _ = books.nearest(d, p, values)
                order = np.argsort(code, kind="stable")
                code, w = code[order], weight[at][order]
                first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
                total = np.add.reduceat(values[order] * w[:, None], first, axis=0) if values.shape[1] else np.empty((len(first), 0), np.int64)
                out += zip([d] * len(first), [p] * len(first), code[first].tolist(), np.add.reduceat(w, first).tolist(), total.tolist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    some = distinct.mapInArrow(run, cast)
    one = some.select("dims", "part", "entry", "count", F.posexplode_outer("total").alias("at", "x"))
    # an entry's components are summed one by one, as decimals: no sum of whole numbers can overflow
    added = one.groupBy("dims", "part", "entry", "at").agg(F.sum("count").alias("count"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("at"), F.col("x"))))
    return added.groupBy("dims", "part", "entry").agg(F.max("count").alias("count"), F.transform(F.filter(rows, lambda r: r["at"].isNotNull()), lambda r: r["x"]).alias("total"))


def assigned(distinct: DataFrame, books: Codebooks) -> DataFrame:
    """dims, part, value, weight, code (from 0), error."""
    schema = pa.schema([("dims", pa.int32()), ("part", pa.int32()), ("value", pa.list_(pa.int32())), ("weight", pa.int64()), ("code", pa.int32()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for d, p, at, values in _groups(batch):
                code[at], error[at] = books.nearest(d, p, values)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(schema.field(c).type) for c in ("dims", "part", "value", "weight")), pa.array(code, pa.int32()), pa.array(error)], schema=schema)

    return distinct.mapInArrow(run, "dims int, part int, value array<int>, weight long, code int, error long")


def joined_by_weight(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key (nulls equal) and its number of rows as ``weight``. Keys
    of more than total / HEAVY rows are broadcast (fewer than HEAVY of them), the others shuffled."""
    hot = F.col("weight") * HEAVY > total
    rename = {c: f"_{c}" for c in keys}
    on = lambda side: [rows[c].eqNullSafe(side[f"_{c}"]) for c in keys]
    heavy, rest = (table.where(x).withColumnsRenamed(rename).drop("weight") for x in (hot, ~hot))
    by_hot = rows.join(F.broadcast(heavy), on(heavy), "inner")
    others = rows.join(F.broadcast(heavy.select(*rename.values())), on(heavy), "left_anti").join(rest, on(rest), "inner")
    return by_hot.unionByName(others).drop(*rename.values())


def learn(rows: DataFrame, distinct: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    books = start(rows, parts, entries)
    for _ in range(rounds):
        books = books.moved(sums(distinct, books).collect())  # at most a row per entry
    return books


def codes(vectors: DataFrame, *, scale: float = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col="vec_id", vector_col="embedding", label_col="label") -> DataFrame:
    """vec_id, label, codes (array of int, a code a part), error, label_error (over equal labels), codebooks_sha256."""
    if entries > 65_536:
        raise ValueError("at most 65,536 entries")
    rows = quantised(vectors, scale, id_col=id_col, vector_col=vector_col, label_col=label_col)
    distinct = stored(_parts(rows, parts).groupBy("dims", "part", "value").agg(F.count(F.lit(1)).alias("weight")), "distinct-parts")
    books = learn(rows, distinct, parts, entries, rounds)
    n = rows.count()
    coded = stored(assigned(distinct, books), "coded-parts")
    drop_stored(distinct)
    found = joined_by_weight(_parts(rows, parts, "number"), coded, ["dims", "part", "value"], n)
    of = F.array_sort(F.collect_list(F.struct("part", "code")))
    each = found.groupBy("number").agg(F.transform(of, lambda r: r["code"]).alias("codes"), F.sum("error").alias("error"))
    each = stored(rows.select("number", "vec_id", "label", F.size("v").alias("dims")).join(each, "number").drop("number"), "codes")
    labels = each.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("weight"))
    sha = {d: books.sha256(d) for d in sorted({d for d, _ in books.books})}
    name = F.lit(None).cast("string")
    for d, x in sha.items():
        name = F.when(F.col("dims") == d, x).otherwise(name)
    return joined_by_weight(each, stored(labels, "label-errors"), ["label"], n).select("vec_id", "label", "codes", "error", "label_error", name.alias("codebooks_sha256"))


def hex_code(codes: str) -> Column:
    """Codes as hexadecimal digits, two each, in lower case."""
    return F.lower(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c), 2, "0")), ""))
