"""Stable ids and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(*parts: Column) -> Column:
    """A JSON array of the parts with nulls kept, so that parts can't run into each other."""
    return F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"})


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and 24 hex digits of the digest of the parts."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(canonical(*parts), 256), 1, 24))


def row_digest(df: DataFrame, drop: tuple[str, ...] = ()) -> Column:
    """SHA-256 of a row's columns in the order of their names; ``drop`` names run-varying ones."""
    names = sorted(c for c in df.columns if c not in drop)
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}), 256)


def dataset_digest(df: DataFrame, drop: tuple[str, ...] = (), buckets: int = 256) -> DataFrame:
    """One row: rows, digest. Independent of row order and partitioning, and computed in two levels: digests are sorted and
    hashed by bucket of their first byte, then the bucket digests are. No task holds all rows."""
    rows = df.select(row_digest(df, drop).alias("d")).withColumn("b", F.pmod(F.conv(F.substring("d", 1, 6), 16, 10).cast("int"), F.lit(buckets)))
    counted = rows.groupBy("b", "d").agg(F.count(F.lit(1)).alias("n"))
    by = counted.groupBy("b").agg(F.sum("n").alias("n"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(":", "d", F.col("n").cast("string"))))), 256).alias("d"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"])), 256).alias("digest"))
