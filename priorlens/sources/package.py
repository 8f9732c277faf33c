"""A folder of files held against its manifest: file set, sizes, hashes, row counts and headers, all worked out in tasks.

Text files (``TEXT``) are read by splits: rows are lines with content, the header is the first line of the split at 0, and the
lines' digest (number, exclusive or and sum of 64-bit hashes) tells any change of lines, whatever a file's size. The SHA-256 of
whole files is for those of up to ``WHOLE`` bytes, which a task can hold; for larger ones it is null, and size and lines decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reasons import codes

TEXT = r"(?i)\.(csv|jsonl|ndjson|txt|tsv|md|json)$"
WHOLE = 1 << 30
MEASURES = ["bytes", "sha256", "rows", "header", "lines_digest"]


def _relative(column, root: str):
    """The path below the folder, percent-decoded."""
    path = F.try_url_decode(F.replace(column, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.substring_index(F.coalesce(path, column), f"{root}/", -1), "^/+", "")


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder) and the measures of every file in it, at any depth."""
    folder = folder.rstrip("/")
    root = folder.rpartition("://")[2].rpartition(":")[2].strip("/").rpartition("/")[2]
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    # scans pass over empty files: the names come from the listing that Spark has made
    names = spark.createDataFrame([(f,) for f in binary.inputFiles()], "f string").select(_relative(F.col("f"), root).alias("path"))
    sizes = names.join(binary.select(_relative(F.col("path"), root).alias("path"), F.col("length").alias("bytes")), "path", "left").select("path", F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"))
    # the bound reaches the scan, so larger files aren't loaded
    whole = binary.where(F.col("length") <= WHOLE).select(_relative(F.col("path"), root).alias("path"), F.sha2("content", 256).alias("sha256"))
    lines = spark.read.option("recursiveFileLookup", True).text(folder).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))
    lines = lines.where(F.col("_file").rlike(TEXT))
    h = F.xxhash64("value")
    per = lines.groupBy("_file").agg(
        F.count_if(F.trim("value") != "").alias("rows"), F.first(F.when(F.col("_at") == 0, F.col("value")), ignorenulls=True).alias("header"),
        F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.hex(F.bit_xor(h)), F.sum(h.cast("decimal(38,0)")).cast("string")).alias("lines_digest"),
    )
    per = per.select(_relative(F.col("_file"), root).alias("path"), "rows", "header", "lines_digest")
    every = sizes.join(whole, "path", "left").join(per, "path", "left")
    return every.withColumn("sha256", F.when(F.col("bytes") == 0, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("sha256"))).select("path", *MEASURES)


def verify_package(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """path, status (ok, missing, extra, changed) and reasons (which measures differ). manifest: path and any of the measures;
    a null measure isn't asked for. A path that the manifest names twice is ``ambiguous``."""
    asked = [c for c in MEASURES if c in manifest.columns]
    want = manifest.groupBy(F.col("path").alias("_p")).agg(*[F.min(c).alias(f"_{c}") for c in asked], F.count(F.lit(1)).alias("_n"))
    j = contents(spark, folder).join(want, F.col("path") == F.col("_p"), "full")
    differs = codes(*[(F.col(f"_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")), c) for c in asked])
    status = F.when(F.col("path").isNull(), "missing").when(F.col("_p").isNull(), "extra").when(F.col("_n") > 1, "ambiguous").when(F.size(differs) > 0, "changed").otherwise("ok")
    none = F.expr("cast(array() as array<string>)")
    return j.select(F.coalesce("path", "_p").alias("path"), status.alias("status"), F.when(status == "changed", differs).otherwise(none).alias("reasons"))
