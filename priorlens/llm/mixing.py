"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule: a step function of training time t in [0, 1]. At time t the mix draws words from the
sources in proportion to the weights. Integrating gives each source's cumulative word demand D_s(t); the end value
D_s(1) is its target. Each document stands at an offset in its source's seeded order (repeats of a source follow one
another), and the inverse of D_s at the middle of the document is its training position. Documents are range-sorted by
position. The seeded order is that of an md5 digest of seed, id and text.

A source can't be drawn more than ``max_repeats`` times: targets stop there, and the excess goes to the other sources by
weight until none is above (water filling). With more than one segment, the schedule's integrals are the weights.

Sources are spread over hash buckets for the prefix sums, so a hot source is no single task; only (doc_id, size, source)
are shuffled. Null texts and texts without words have size 0 and are never taken; a null source is a source, last in
order. Equal rows are kept as rows. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, global_rank, pick, stored

#: Rows that a bucket of the prefix sums should hold.
BUCKET_ROWS = 200_000
#: More distinct sources than this are refused: the mixture is a table held by the driver.
MAX_SOURCES = 100_000

#: (start, weight) steps of a schedule, starts rising from 0.
Schedule = Sequence[tuple[float, float]]


def integral(schedule: Schedule) -> float:
    ends = [s for s, _ in schedule[1:]] + [1.0]
    return sum(w * (e - s) for (s, w), e in zip(schedule, ends, strict=True))


def targets(sizes: list[int], weights: list[float], budget: float, max_repeats: int) -> list[float]:
    """Water filling: budget by weight, no target above max_repeats x size, the excess reshared among the rest."""
    out, open_ = [0.0] * len(sizes), [i for i, w in enumerate(weights) if w > 0]
    left = float(budget)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > max_repeats * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(max_repeats * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def demand_curve(schedules: list[Schedule], final: list[float]) -> tuple[list[float], list[list[float]]]:
    """Step starts of all schedules, and each source's cumulative demand at them and at 1, scaled to end at its target."""
    grid = sorted({s for sch in schedules for s, _ in sch} | {0.0, 1.0})
    curves = []
    for sch, end in zip(schedules, final, strict=True):
        at = [0.0]
        for a, b in zip(grid, grid[1:], strict=False):
            w = [w for s, w in sch if s <= a][-1]
            at.append(at[-1] + w * (b - a))
        scale = end / at[-1] if at[-1] else 0.0
        curves.append([x * scale for x in at])
    return grid, curves


def ramps(k: int) -> Schedule:
    """Weights that change half-way and whose integrals are 1, 2, 3, repeating: every other source rises from half its
    weight to one and a half of it, the others fall."""
    w = float(k % 3 + 1)
    return [(0.0, 0.5 * w), (0.5, 1.5 * w)] if k % 2 == 0 else [(0.0, 1.5 * w), (0.5, 0.5 * w)]


def digest_order(seed: int, *columns):
    """A seeded shuffle key that any SQL engine can take as well: an md5 digest in hex; nulls are left out."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def digest_share(digest):
    """The first 32 bits of a digest as a number from 0 to below 1, in the order of the digests."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def bucket_count(n_rows: int) -> int:
    return min(1 << 20, max(1024, n_rows // BUCKET_ROWS))


def curriculum(docs: DataFrame, schedule_of: Callable[[int], Schedule] = ramps, *, max_repeats: int = 3, share: float = 1.0, seed: int = 23, id_col="doc_id", text_col="text", source_col="source", buckets: int | None = None, with_hash: bool = False) -> DataFrame:
    """Every document once: doc_id, size, source, source_size, target, copies, taken, positions (array, one per copy);
    with_hash: also text_hash (xxhash64 of the text, to find rows by).

    A copy is taken if its middle lies below the target, so a source misses its target by half a document at most.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col).select("doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), "source", digest_order(seed, F.col("doc_id"), F.md5("text")).alias("_h"), *[F.xxhash64("text").alias("text_hash")] * with_hash)
    rows = stored(rows, "mix-sizes")
    # one row per source; sources by code point, null last
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).orderBy(F.col("source").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = [r["source_size"] for r in sums]
    schedules = [schedule_of(k) for k in range(len(sums))]
    final = targets(sizes, [integral(s) for s in schedules], share * sum(sizes), max_repeats)
    grid, curves = demand_curve(schedules, final)
    kind = T.StructType([T.StructField("_source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("_curve", T.ArrayType(T.DoubleType()))])
    plan = spark.createDataFrame([(r["source"], r["source_size"], t, c) for r, t, c in zip(sums, final, curves, strict=True)], kind)
    buckets = buckets or bucket_count(sum(r["n"] for r in sums))
    placed = global_rank(rows, "source", ["_h", "doc_id", "size"], F.floor(digest_share(F.col("_h")) * buckets), buckets, F.col("size"))
    # bounded: at most MAX_SOURCES rows, checked above
    placed = placed.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_h")
    middles = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda j: j * F.col("source_size") + F.col("before") + F.col("size") / 2)
    placed = placed.withColumn("_mid", F.when(F.col("size") > 0, F.filter(middles, lambda m: m < F.col("target"))).otherwise(F.array().cast("array<double>")))
    # t with D_s(t) = m: the segment that m falls in, then linear inside it
    g = F.array(*[F.lit(x) for x in grid])

    def position(m):
        k = F.greatest(F.size(F.filter(F.col("_curve"), lambda c: c <= m)), F.lit(1))
        k = F.least(k, F.lit(len(grid) - 1))
        lo, hi = F.element_at("_curve", k), F.element_at("_curve", k + 1)
        return F.element_at(g, k) + (F.element_at(g, k + 1) - F.element_at(g, k)) * (m - lo) / (hi - lo)

    return placed.select("doc_id", *["text_hash"] * with_hash, "size", "source", "source_size", "target", F.size("_mid").alias("copies"), (F.size("_mid") * F.col("size")).cast("long").alias("taken"), F.transform("_mid", position).alias("positions"))


def training_order(mixed: DataFrame, partitions: int) -> DataFrame:
    """One row per copy (doc_id, position), range-sorted by position."""
    copies = mixed.select("doc_id", F.explode("positions").alias("position"))
    return copies.repartitionByRange(partitions, "position", "doc_id").sortWithinPartitions("position", "doc_id")


def training_ranks(mixed: DataFrame, partitions: int, buckets: int | None = None) -> DataFrame:
    """``mixed`` with first_position and first_rank, the place of its first copy among all copies in training order (from 1;
    null if it isn't taken), range-sorted by that order, untaken rows last. Copies of equal position go by id, size, source."""
    columns = mixed.columns
    mixed = stored(mixed, "mixed")  # counted, ranked and sorted below: its own rankings run once
    copies = mixed.select(*columns, F.posexplode_outer("positions").alias("_copy", "_position"))
    if buckets is None:
        buckets = bucket_count(mixed.agg(F.sum("copies")).first()[0] or 0)
    order = ["_position", "doc_id", "size", F.col("source").asc_nulls_last(), "_copy"]
    bucket = F.least(F.floor(F.col("_position") * buckets), F.lit(buckets - 1))
    placed = global_rank(copies.where("_position is not null"), None, order, bucket, buckets).where("_copy = 0").select(*columns, F.col("_position").alias("first_position"), (F.col("before") + 1).alias("first_rank"))
    rest = copies.where("_position is null").select(*columns, F.col("_position").alias("first_position"), F.lit(None).cast("long").alias("first_rank"))
    order = [F.col("first_rank").asc_nulls_last(), "doc_id"]
    return placed.unionByName(rest).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
