"""Two versions of a keyed table compared by digests, so that only what differs is joined row by row.

A version is written in buckets by a hash of its key (a folder each), with a tree of digests beside it: a row's digest is two
64-bit hashes of all its columns, a bucket's their number, exclusive or and sum, a branch's (``FAN`` buckets) and the table's
the same of all rows below. Digests don't depend on order or partitions; null, empty and zero differ. Versions are compared
from the root down, and only the folders of differing buckets are read and joined null-safely.

Rows of equal keys are told apart by their number in the order of their digests, so repeats that one side lacks are found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS, FAN = 1024, 32


def _digested(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    # JSON keeps names and nulls apart, whatever the order of columns
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    return df.withColumns({"_bucket": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"), "_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit(1), text)})


def tree(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """level (0 table, 1 branch, 2 bucket), node, rows, digest: at most buckets + buckets / FAN + 1 rows."""
    total = [F.count(F.lit(1)).alias("rows"), F.bit_xor("_h1").alias("x"), F.sum(F.col("_h2").cast("decimal(38,0)")).alias("s")]
    leaf = _digested(df, keys, buckets).groupBy("_bucket").agg(*total)
    up = [F.sum("rows").alias("rows"), F.bit_xor("x").alias("x"), F.sum("s").alias("s")]
    levels = [leaf.groupBy().agg(*up).where("rows is not null").select(F.lit(0).alias("level"), F.lit(0).alias("node"), "rows", "x", "s"), leaf.groupBy(F.floor(F.col("_bucket") / FAN).cast("int").alias("node")).agg(*up).select(F.lit(1).alias("level"), "node", "rows", "x", "s"), leaf.select(F.lit(2).alias("level"), F.col("_bucket").alias("node"), "rows", "x", "s")]
    every = levels[0].unionByName(levels[1]).unionByName(levels[2])
    return every.select("level", "node", "rows", F.concat_ws(":", F.hex("x"), F.col("s").cast("string")).alias("digest"))


def write_version(df: DataFrame, keys: list[str], path: str, buckets: int = BUCKETS) -> None:
    """``path``/rows in a folder for each bucket, ``path``/tree. Refuses a folder that is there."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _digested(df, keys, buckets).drop("_h1", "_h2")
    rows.repartition(n, "_bucket").write.partitionBy("_bucket").parquet(f"{path}/rows")
    tree(df.sparkSession.read.parquet(f"{path}/rows").drop("_bucket").select(*df.columns), keys, buckets).coalesce(1).write.parquet(f"{path}/tree")


def differing_buckets(old: DataFrame, new: DataFrame) -> list[int]:
    """Buckets whose digests differ, from the root down: a level is looked at only below what differs above. Reads trees only."""
    changed: list[int] = [0]
    for level in (0, 1, 2):
        above = F.lit(0) if level < 2 else F.floor(F.col("node") / FAN)
        a, b = (t.where((F.col("level") == level) & above.isin(changed)).select("node", F.col("digest").alias(c)) for t, c in ((old, "a"), (new, "b")))
        changed = [r[0] for r in a.join(b, "node", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("node").orderBy("node").collect()]
        if not changed:
            return []
    return changed


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, change (missing, extra, changed), column, old, new (as text): a row for each differing cell; missing and
    extra rows have a row of their own, without a column."""
    columns = [c for c in old.columns if c not in keys]
    if set(columns) != {c for c in new.columns if c not in keys}:
        raise ValueError("the versions have different columns")

    def side(df: DataFrame, name: str) -> DataFrame:
        h = F.xxhash64(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})) if columns else F.lit(0)
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(h))
        return df.select(*keys, place.alias("place"), F.struct(F.lit(1).alias("there"), *[F.col(c).cast("string").alias(c) for c in columns]).alias(name))

    l, r = side(old, "_a").alias("l"), side(new, "_b").alias("r")
    every = [*keys, "place"]
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in every]
    j = l.join(r, on, "full").select(*[F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in every], "_a", "_b")
    row = lambda kind: F.array(F.struct(F.lit(kind).alias("change"), F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new")))
    cells = F.filter(F.array(*[F.struct(F.lit("changed").alias("change"), F.lit(c).alias("column"), F.col(f"_a.{c}").alias("old"), F.col(f"_b.{c}").alias("new")) for c in columns]), lambda x: ~x["old"].eqNullSafe(x["new"])) if columns else F.filter(row("changed"), lambda _: F.lit(False))
    found = F.when(F.col("_b").isNull(), row("missing")).when(F.col("_a").isNull(), row("extra")).otherwise(cells)
    return j.select(*keys, "place", F.explode(found).alias("x")).select(*keys, "place", "x.*")


def compare_versions(spark: SparkSession, old: str, new: str, keys: list[str]) -> DataFrame:
    """``changes`` of two written versions (of the same number of buckets): only folders of differing buckets are read."""
    buckets = differing_buckets(spark.read.parquet(f"{old}/tree"), spark.read.parquet(f"{new}/tree"))
    a, b = (spark.read.parquet(f"{p}/rows").where(F.col("_bucket").isin(buckets) if buckets else F.lit(False)).drop("_bucket") for p in (old, new))
    return changes(a, b, keys)


def compare(old: DataFrame, new: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``changes`` of two tables that aren't written as versions: their trees are made first, and only rows of differing
    buckets are shuffled and joined."""
    differing = differing_buckets(tree(old, keys, buckets), tree(new, keys, buckets))
    some = lambda df: _digested(df, keys, buckets).where(F.col("_bucket").isin(differing) if differing else F.lit(False)).select(*df.columns)
    return changes(some(old), some(new), keys)
