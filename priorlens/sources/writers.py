"""Sinks: create-only writes, run folders with manifests, public and private halves, allow-listed projections."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import dataset_digest


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def create(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Write once: an existing target fails."""
    writer = df.write.mode("errorifexists")
    (writer.option("header", True) if format == "csv" else writer).format(format).save(path)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """A small file through Hadoop's file systems: written beside its place, then renamed over it."""
    fs, at = _fs(spark, path)
    if fs.exists(at) and not overwrite:
        raise FileExistsError(path)
    temp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(temp, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(temp, at):
        raise OSError(f"can't rename to {path}")


def freeze(spark: SparkSession, folder: str, tables: dict[str, DataFrame], *, inputs: dict[str, str], policy: str, run_varying: tuple[str, ...] = ()) -> dict:
    """A new run folder: every table once, then the manifest with the row counts and digests of what was written.
    A folder that has a manifest is refused; one without is the rest of a broken run."""
    fs, at = _fs(spark, f"{folder}/manifest.json")
    if fs.exists(at):
        raise FileExistsError(folder)
    outputs = {}
    for name, df in sorted(tables.items()):
        create(df, f"{folder}/{name}")
        row = dataset_digest(spark.read.parquet(f"{folder}/{name}"), run_varying).first()
        outputs[name] = {"rows": row["rows"], "semantic_sha256": row["digest"]}
    manifest = {"policy": policy, "inputs": inputs, "outputs": outputs, "status": "frozen"}
    write_text(spark, f"{folder}/manifest.json", json.dumps(manifest, sort_keys=True, ensure_ascii=False))
    return manifest


def verify(spark: SparkSession, folder: str, run_varying: tuple[str, ...] = ()) -> list[str]:
    """The names of tables that no longer are what the manifest says."""
    from .readers import json_object

    manifest = json_object(spark, f"{folder}/manifest.json")
    bad = []
    for name, want in manifest["outputs"].items():
        row = dataset_digest(spark.read.parquet(f"{folder}/{name}"), run_varying).first()
        if row["rows"] != want["rows"] or row["digest"] != want["semantic_sha256"]:
            bad.append(name)
    return bad


def split_private(df: DataFrame, text_columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(private, public): the public half has the digest and length of each text in its place."""
    public = df
    for c in text_columns:
        public = public.withColumn(f"{c}_sha256", F.sha2(F.col(c).cast("binary"), 256)).withColumn(f"{c}_length", F.length(c)).drop(c)
    return df, public


#: What may not appear in a published text.
LEAKS = [r"(?i)\b[a-z]:\\\\", r"/home/|/Users/|/root/", r"(?i)api[_-]?key|token\s*=|secret", r"[\w.+-]+@[\w-]+\.[\w.]+"]


def published(df: DataFrame, allowed: list[str], texts: list[str] = ()) -> DataFrame:
    """The allowed columns only; a text that matches a leak pattern fails the job."""
    out = df.select(*allowed)
    for c in texts:
        leak = F.lit(False)
        for p in LEAKS:
            leak = leak | F.coalesce(F.col(c).rlike(p), F.lit(False))
        out = out.withColumn(c, F.when(leak, F.raise_error(F.lit(f"leak in {c}"))).otherwise(F.col(c)))
    return out


def report(results: dict, template: str) -> str:
    """Text from a template with ``{name}`` places; a null is written as ``not evaluated``."""
    return template.format(**{k: "not evaluated" if v is None else v for k, v in results.items()})
