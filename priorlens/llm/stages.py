"""Operators as pipeline stages: documents in, documents out, all columns kept.

A verdict is held against a row by (id, 64-bit hash of the text), so rows that repeat an id with another text have their
own verdict. Verdict tables are broadcast up to a checked number of rows and shuffled beyond it.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_bpe, langid, minhash, mixing, quality
from .common import pick, stored

#: Up to so many rows of (id, hash) are broadcast: 32 MB.
MAX_BROADCAST_ROWS = 1_000_000
#: Per cent of shared 5-word shingles from which two documents are near duplicates in the pipeline (op6 has its own 85).
NEAR = 80
#: Words that the pipeline's quality stage asks of a document (op1 has its own 50).
SHORTEST = 1


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def _key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__id", F.col("doc_id")).withColumn("__hash", F.xxhash64("text"))


def _match(left: DataFrame, right: DataFrame):
    return left["__id"].eqNullSafe(right["__rid"]) & (left["__hash"] == right["__rhash"])


def without(docs: DataFrame, rejects: DataFrame) -> DataFrame:
    """docs but for the rows in ``rejects`` (__rid, __rhash)."""
    rejects = _small(stored(rejects.distinct(), "rejects"))
    left = _key(docs)
    return left.join(rejects, _match(left, rejects), "left_anti").select(*docs.columns)


def identified(docs: DataFrame) -> DataFrame:
    """Drops texts without a letter, and null texts. The others' ``lang`` becomes the predicted language, by which the next
    stages judge them, whatever the label said (it may be null or wrong)."""
    return langid.keep_identified(docs, langid.learn(docs), label_col="lang")


def fit(docs: DataFrame) -> DataFrame:
    """Drops what the quality rules reject: texts without a word, with most words in repeats, or far from their language. A
    short text is no bad text, so it only needs a word here. A verdict depends on the text and the language label."""
    rows = pick(docs, doc_id="doc_id", text="text", lang="lang").withColumn("doc_id", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.col("lang").alias("lang")))
    judged = quality.divergence_rules(rows, base_words=SHORTEST).where(~F.col("kept"))
    rejects = _small(stored(judged.select(F.col("doc_id.id").alias("__rid"), F.col("doc_id.hash").alias("__rhash"), F.col("doc_id.lang").alias("__rlang")).distinct(), "rejects"))
    left = _key(docs)
    return left.join(rejects, _match(left, rejects) & left["lang"].eqNullSafe(rejects["__rlang"]), "left_anti").select(*docs.columns)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates (similarity of 0.80 or more): the one with the smallest id; of its
    repeated rows, one."""
    found = minhash.near_duplicates(docs.select("doc_id", "text"), threshold=NEAR, with_hash=True)
    kept = without(docs, found.where(~F.col("kept")).select(F.col("doc_id").alias("__rid"), F.col("text_hash").alias("__rhash")))
    return _once(kept, found.where("kept").select(F.col("doc_id").alias("__rid"), F.col("text_hash").alias("__rhash")))


def _once(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs with one row for each key that comes several times; only such rows are shuffled."""
    twice = stored(keys.groupBy("__rid", "__rhash").count().where("count > 1").drop("count"), "repeated")
    if twice.isEmpty():
        return docs
    twice = _small(twice)
    left = _key(docs)
    # which of the rows stays is told by their other columns
    again = left.join(twice, _match(left, twice), "left_semi").withColumn("__row", F.struct(*docs.columns))
    again = again.groupBy("__id", "__hash").agg(F.min_by("__row", F.sha2(F.to_json("__row"), 256)).alias("__row")).select("__row.*")
    return left.join(twice, _match(left, twice), "left_anti").select(*docs.columns).unionByName(again)


def mixed(docs: DataFrame) -> DataFrame:
    """Every document as often as the mix takes it, in the order of training positions: partitions, and so the files that
    are written from them, hold ranges of positions, each in order."""
    spark = docs.sparkSession
    plan = stored(mixing.curriculum(docs, with_hash=True).select(F.col("doc_id").alias("__rid"), F.col("text_hash").alias("__rhash"), "positions"), "mix")
    docs = _once(docs, plan)
    # rows that agree in id and text are taken together; a row per copy, so that no value grows with their number
    left, plan = _key(docs), _small(stored(plan.select("__rid", "__rhash", F.explode("positions").alias("__position")), "mix-copies"))
    rows = left.join(plan, _match(left, plan)).select(*docs.columns, "__position", "__id", "__hash")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["__position", "__id", "__hash"]
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*docs.columns)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and training_rank: its place (from 0) in the order of the
    files it was read from, which is the order of training; null for documents that aren't read from files."""
    return byte_bpe.digests(byte_bpe.round_trip(in_order(docs), path, pattern, carry=["training_rank"]))


def file_order(path: str) -> tuple[int, str]:
    """The place of one of Spark's files among its table's: by the number of the partition. Names pad it to five digits only,
    so part-100000 would come before part-99999 as text. Files of other names come first, by name."""
    found = re.match(r"part-(\d+)", path.rpartition("/")[2])
    return int(found[1]) if found else -1, path


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, training_rank: rows of the files before, and the row's index in its own. A row per file is broadcast."""
    columns = [F.col("doc_id"), F.col("text")]
    try:
        at = docs.select(*columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:  # not a scan of files
        return docs.select(*columns, F.lit(None).cast("long").alias("training_rank"))
    files = at.groupBy("__file").agg(F.count(F.lit(1)).alias("__n")).collect()
    starts, upto = [], 0
    for r in sorted(files, key=lambda r: file_order(r["__file"])):
        starts.append((r["__file"], upto))
        upto += r["__n"]
    starts = F.broadcast(docs.sparkSession.createDataFrame(starts, "__file string, __start long"))
    return at.join(starts, "__file").select(*columns, (F.col("__start") + F.col("__row")).alias("training_rank"))
