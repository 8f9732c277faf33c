"""Folders that tasks share, and the order of written files."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from priorlens.llm import bitplane, common, kdtree, minhash, stages


@pytest.fixture
def scheme_less(spark, tmp_path, monkeypatch):
    """The shared folder is named without a scheme, and the default file system isn't the local disk."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    old = conf.get("fs.defaultFS")
    (tmp_path / "cluster").mkdir()
    conf.set("fs.viewfs.mounttable.cluster.link./shared", f"file://{tmp_path}/cluster")
    conf.set("fs.defaultFS", "viewfs://cluster/")
    monkeypatch.setattr(common, "shared_dir", lambda session: "/shared/x")
    yield tmp_path / "cluster/x/priorlens"
    conf.set("fs.defaultFS", old)


def test_folder_without_scheme(spark, scheme_less):
    """op2, op6 and op10 write their own files where Spark writes its tables, and read them back."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four five six "), F.col("id") % 20).alias("text"))
    ids = bitplane.read_ids(bitplane.write_ids(docs, P.path("word_bpe_49k.json"), 2))
    assert ids.count() == 60
    vectors = spark.range(60).select(F.col("id").alias("vec_id"), F.array(F.col("id") * 0.5, F.lit(1.0)).alias("embedding"))
    assert kdtree.top_k(vectors, 5, 64.0, 20).count() == 15
    assert minhash.near_duplicates(docs).where("kept").count() == 20
    assert {p.name.split("-")[0] for p in scheme_less.iterdir()} >= {"bitplanes", "kdtrees"}
    assert common.shared_path(spark, "x").startswith("file:")


def test_folders_that_tasks_cannot_open():
    with pytest.raises(ValueError, match="no scheme"):
        common.make_folder("/user/x")
    with pytest.raises(ValueError, match="can't open files on viewfs"):
        common.make_folder("viewfs://cluster/x")
    assert common.ARROW_SCHEMES["s3a"] == "s3"


def test_order_of_many_files():
    names = [f"hdfs://n/t/part-{k:05d}-abc-c000.snappy.parquet" for k in range(100_001)]
    assert sorted(names, key=stages.file_order) == names != sorted(names)
    assert stages.file_order("file:/t/other.parquet")[0] == -1
