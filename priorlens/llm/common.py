"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from ..sources.store import ARROW_SCHEMES, group_file, make_folder, open_fs, read_group, remove, shared_dir, whole_path, write_groups  # noqa: F401  (used through here by the operators)

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
NOT_WORD = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under fixed names (``new=old``); other columns can't clash with what an operator adds."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder, removed when the driver ends."""
    return store.shared_path(spark, what, shared_dir(spark))


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._priorlens_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Remove what ``stored`` wrote, once nothing reads it any more."""
    remove(df.sparkSession, df._priorlens_path)


def global_rank(df: DataFrame, group: str | None, order: list[str], bucket, n_buckets: int, weight=None) -> DataFrame:
    """Adds ``before``: the rows (or the sum of ``weight``) that precede a row in its ``group`` by bucket, then ``order``.

    ``bucket`` is an integer expression that is monotone in ``order``. Rows meet in a task only by (group, bucket), so a
    group that holds any share of all rows is spread over ``n_buckets`` tasks; the bucket totals are at most
    groups x buckets rows.
    """
    from pyspark.sql import Window

    keys = ([group] if group else []) + ["_bucket"]
    w = F.lit(1).cast("long") if weight is None else weight
    rows = df.withColumn("_bucket", bucket.cast("int")).withColumn("_w", w)
    totals = rows.groupBy(*keys).agg(F.sum("_w").alias("_total"))
    over = Window.partitionBy(*([group] if group else [F.floor(F.col("_bucket") / F.lit(n_buckets + 1))])).orderBy("_bucket")
    starts = totals.withColumn("_start", F.sum("_total").over(over) - F.col("_total")).drop("_total")
    if group:
        on = (F.col("a._bucket") == F.col("b._bucket")) & F.col(f"a.{group}").eqNullSafe(F.col(f"b.{group}"))
    else:
        on = F.col("a._bucket") == F.col("b._bucket")
    joined = rows.alias("a").join(starts.alias("b"), on).select("a.*", F.col("b._start"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumn("before", F.col("_start") + F.sum("_w").over(inside) - F.col("_w")).drop("_bucket", "_w", "_start")
