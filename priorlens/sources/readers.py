"""Readers: CSV, JSON lines, JSON, XML in ZIP, HTML, files of a run, paged services."""

from __future__ import annotations

import fnmatch
import hashlib
import io
import json
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def csv(spark: SparkSession, path: str, schema: T.StructType | None = None, strict: bool = False) -> DataFrame:
    """CSV with a header, a byte-order mark tolerated. Without a schema all columns are text. strict: a row with too many
    or too few columns fails the read."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("quote", '"').option("escape", '"').option("multiLine", True)
    reader = reader.option("mode", "FAILFAST").option("enforceSchema", False) if strict else reader
    out = (reader.schema(schema) if schema is not None else reader.option("inferSchema", False)).csv(path)
    return out.toDF(*[c.lstrip("﻿") for c in out.columns])


def json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """One object per line; blank lines are skipped. strict: a line that is no object fails the read."""
    if not strict:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.when(~F.trim("value").startswith("{"), F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80)))).otherwise(F.col("value")).alias("value"))
    return parsed.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def json_object(spark: SparkSession, path: str) -> dict:
    """One JSON object of any Spark-readable path, for the driver: a policy or a manifest."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one file")
    value = json.loads(rows[0][0].lstrip("﻿"))
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no JSON object")
    return value


def zipped_entries(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """path, entry, text of the matching entries of ZIP files; undecodable bytes are replaced."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if fnmatch.fnmatch(name.lower(), pattern):
                            yield pd.DataFrame({"path": [p], "entry": [name], "text": [z.read(name).decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, entry string, text string")


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes, sha256, rows of the files below a folder (rows: lines with content, for text files)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    lines = F.size(F.filter(F.split(F.decode("content", "UTF-8"), "\n"), lambda x: F.trim(x) != ""))
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.when(F.col("path").rlike(r"\.(csv|jsonl|txt)$"), lines).alias("rows"))


def pluggable(spark: SparkSession, path: str, parse: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Binary documents through a parser that the caller brings (PDF text layers, OCR): path and the parser's rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = parse(content)
                if rows:
                    yield pd.DataFrame(rows).assign(path=p)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"{schema}, path string")


class _Key(InputPartition):
    def __init__(self, key: str):
        self.key = key


class PagedReader(DataSourceReader):
    """One partition per key; pages are fetched until the stated total. ``fetch(key, page)`` returns
    {"status", "total_page", "list"}; status 013 is an empty result, any other but 000 an error."""

    def __init__(self, schema: T.StructType, fetch: Callable[[str, int], dict], keys: list[str]):
        self.schema, self.fetch, self.keys = schema, fetch, keys

    def partitions(self):
        return [_Key(k) for k in self.keys]

    def read(self, partition):
        page, total = 1, 1
        while page <= total:
            got = self.fetch(partition.key, page)
            if got["status"] == "013":
                return
            if got["status"] != "000":
                raise RuntimeError(f"{partition.key}: status {got['status']}")
            total = int(got.get("total_page", 1))
            for row in got["list"]:
                yield tuple(row.get(f.name) for f in self.schema.fields)
            page += 1


def paged_source(name: str, schema: T.StructType, fetch: Callable[[str, int], dict]) -> type[DataSource]:
    """A data source class for ``spark.dataSource.register``; the option ``keys`` is a comma-separated list."""

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return PagedReader(schema, fetch, [k for k in self.options.get("keys", "").split(",") if k])

    return Paged


def latest_facts(submissions: DataFrame, facts: DataFrame, tags: dict[str, list[str]], forms: list[str], cutoff: str) -> DataFrame:
    """For each company and form the latest filing at or before the cutoff, and for each metric the first tag with a fact.

    submissions: company_id, form, accession, filed (date text). facts: company_id, accession, tag, value, unit, end."""
    from ..operators.relational import latest

    last = latest(submissions.where(F.col("form").isin(forms)), ["company_id", "form"], ["filed", "accession"], ("filed", cutoff))
    order = F.explode(F.array(*[F.struct(F.lit(m).alias("metric_id"), F.lit(t).alias("tag"), F.lit(i).alias("place")) for m, ts in tags.items() for i, t in enumerate(ts)]))
    wanted = last.select("company_id", "form", "accession", "filed", order.alias("w")).select("company_id", "form", "accession", "filed", "w.*")
    hit = wanted.join(facts, ["company_id", "accession", "tag"])
    return hit.groupBy("company_id", "form", "metric_id").agg(F.min_by(F.struct("tag", "value", "unit", "end", "filed"), F.struct("place", "end")).alias("r")).select("company_id", "form", "metric_id", "r.*")


def source_gate(registry: DataFrame) -> DataFrame:
    """Adds ``refusal``: why a registered source may not be read, or null."""
    from ..functions.reasons import first

    no = lambda c: F.coalesce(~c, F.lit(True))
    return registry.withColumn("refusal", first((no(F.col("status") == "approved"), "source_not_approved"), (no(F.col("robots_allowed")), "robots_not_allowed"), (no(F.col("rights_status") == "confirmed"), "rights_not_confirmed"), (F.col("last_status").isin(403, 429), "host_blocked")))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
