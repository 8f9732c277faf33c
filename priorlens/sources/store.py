"""Written tables between steps, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; in local mode, where none is set, one under /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file:///tmp/priorlens-shared"
    return folder.rstrip("/")


def whole_path(spark: SparkSession, path: str) -> str:
    """The folder ``path`` (made if it isn't there) with its scheme: without one it lies on the default file system, and
    behind a mount table where the link points. So Spark and tasks that open files by themselves mean the same place."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    return files.resolvePath(at).toString()


def shared_path(spark: SparkSession, what: str, folder: str | None = None) -> str:
    """A new folder name below the shared folder, removed when the driver ends."""
    path = f"{whole_path(spark, f'{folder or shared_dir(spark)}/priorlens')}/{what}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of all its sides that one task of a join is meant to hold.
TASK_ROWS = 400_000


def tasks_for(*tables: DataFrame) -> int:
    """So many tasks for a join of the tables that each holds about ``TASK_ROWS`` rows, whatever their number. Rows that
    compress well would otherwise be dealt by their small size in a shuffle to a few tasks that unpack and sort them (or be
    broadcast, so such joins ask for a merge). The tables are counted, so they should be cheap to read."""
    rows = sum(t.count() for t in tables)
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


#: Hadoop's schemes that pyarrow has under another name.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_fs(path: str):
    """The pyarrow file system of a whole path (with its scheme), and the path in it: for files that tasks write and read
    themselves. A path without a scheme is refused, as each machine would take it for its own disk."""
    import pyarrow as pa
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        raise ValueError(f"{path} has no scheme: name the file system, or take a folder from shared_path")
    try:
        return fs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}:{rest}")
    except (pa.ArrowInvalid, OSError) as e:
        raise ValueError(f"tasks can't open files on {scheme} ({path}): set spark.checkpoint.dir to a folder that pyarrow can open (file, hdfs, s3, gs, abfss)") from e


def make_folder(path: str) -> None:
    """Runs on the driver before any job, so a folder that tasks couldn't open stops the operator here."""
    files, at = open_fs(path)
    files.create_dir(at, recursive=True)


def group_file(folder: str, *keys: int) -> str:
    return f"{folder}/{'-'.join(f'{k & (2**64 - 1):x}' for k in keys)}.arrow"


def write_groups(rows: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Writes the rows of each group of ``keys`` (long columns) to a file of its own in the shared folder, without the keys;
    returns the keys of the groups. A group is held by one task, so it must be bounded. A repeated attempt writes the same
    rows under a new name and moves them into place, so a reader never meets half a file."""
    import pyarrow as pa

    rest = [c for c in rows.columns if c not in keys]

    def write(batches):
        now, held, done = None, [], []

        def finish():
            fs, at = open_fs(group_file(folder, *now))
            own = f"{at}.{uuid.uuid4().hex}"
            with fs.open_output_stream(own) as out, pa.ipc.new_stream(out, held[0].schema) as sink:
                for r in held:
                    sink.write_batch(r)
            fs.move(own, at)
            done.append(now)

        for batch in batches:
            at = [batch.column(c).to_pylist() for c in keys]
            start = 0
            for i in range(batch.num_rows):
                key = tuple(k[i] for k in at)
                if key != now:
                    if i > start:
                        held.append(batch.slice(start, i - start).select(rest))
                    if now is not None:
                        finish()
                    now, held, start = key, [], i
            if batch.num_rows > start:
                held.append(batch.slice(start).select(rest))
        if now is not None:
            finish()
        yield pa.RecordBatch.from_pydict({c: pa.array([x[k] for x in done], pa.int64()) for k, c in enumerate(keys)})

    make_folder(folder)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(write, ", ".join(f"{c} long" for c in keys))


def read_group(folder: str, *keys: int, may_lack: bool = False):
    """The table of a group; None if there is no such file and ``may_lack`` is set."""
    import pyarrow as pa

    fs, at = open_fs(group_file(folder, *keys))
    if may_lack and fs.get_file_info(at).type.name == "NotFound":
        return None
    with fs.open_input_stream(at) as f, pa.ipc.open_stream(f) as source:
        return source.read_all()


def stored(df: DataFrame, what: str, compression: str | None = None) -> DataFrame:
    """``df`` written to the shared folder (with the session's compression, if none is named) and read again; removed when the
    driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/priorlens/{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
