"""Sharding by proportional stratified interleaving (law ``rows``).

Rows are shuffled with a seed inside each source (by an md5 digest), each row gets its fractional rank ``(rank + u) / rows
of the source`` with a seeded u from 0 to 1 for each source, so that small sources don't all meet at one half, and all rows
are put in the order of that fraction. Every stretch of that order holds each source in its share of the
whole, so cutting it into equal stretches makes every shard match the mixture; the shard sizes are at most one row apart.

Ranks are not taken by one window over a source: a source is spread over hash buckets, the bucket counts are summed, and
rows are ranked inside a bucket only. The same holds for the final order, by buckets of the fraction. Only DataFrame
functions are used, and the text itself is never shuffled.

Null texts have size 1 and a null checksum; a null source is a stratum of its own. Repeated rows, equal ids and null ids
are kept: ties are broken by id, then by checksum and size, and rows that agree in all of these are interchangeable. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_rank, pick, stored
from .mixing import bucket_count, digest_order, digest_share


def interleave(docs: DataFrame, n_shards: int = 8, seed: int = 17, *, id_col="doc_id", text_col="text", source_col="source", buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, source, fraction, position (global, from 0), shard, slot (in the shard, from 0)."""
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        "source",
    )
    # texts are read once: ids, sizes, checksums and digests are all that the rankings below need
    rows = stored(rows.withColumn("_h", digest_order(seed, F.col("doc_id"), F.col("text_crc32"))), "shard-rows")
    n = max(1, rows.count())
    buckets = buckets or bucket_count(n)
    order = ["_h", "doc_id", "text_crc32", "size"]
    ranked = global_rank(rows, "source", order, F.floor(digest_share(F.col("_h")) * buckets), buckets)
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked.alias("a").join(sizes.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", F.col("b._n"))
    ranked = ranked.withColumn("fraction", (F.col("before") + digest_share(digest_order(seed, F.col("source")))) / F.col("_n")).drop("before", "_n")
    ranked = stored(ranked, "shard-fractions")
    order = ["fraction", F.col("source").asc_nulls_last(), *order]
    placed = global_rank(ranked, None, order, F.floor(F.col("fraction") * buckets), buckets).withColumnRenamed("before", "position")
    placed = placed.withColumn("shard", F.least(F.expr(f"(position * {n_shards}L) div {n}L"), F.lit(n_shards - 1)).cast("int"))
    # shard s begins at the smallest position with position * shards div n = s
    return placed.withColumn("slot", F.expr(f"position - ((shard * {n}L + {n_shards - 1}L) div {n_shards}L)")).drop("_h")
