"""Row-wise Python over Arrow batches in small slices, so that memory is bounded by a few rows and not by a batch."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

ROWS, BYTES = 256, 4 << 20

#: Rows that Spark puts into one Arrow batch for these operators; its own default would hold 10,000 whole texts at once.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, unless it was set to less already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


_resident: list[tuple[object, object]] = []


def resident(key: object, make: Callable[[], object]) -> object:
    """A model kept in the worker process under a key. Workers outlive tasks and serve any stage, so only the last model is
    kept: the tables of an earlier stage go before those of the next are built."""
    if not _resident or _resident[0][0] != key:
        if _resident:
            _resident.clear()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)
        _resident.append((key, make()))
    return _resident[0][1]


def slices(batch: pa.RecordBatch, column: str, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and, but for single larger rows, about BYTES bytes of ``column``."""
    at, n = 0, batch.num_rows
    if not n:
        return
    offsets = batch.column(column)
    step = max(1, min(rows, int(BYTES / max(1, offsets.nbytes / n))))
    while at < n:
        yield batch.slice(at, step)
        at += step


def mapped(make: Callable[[], Callable[[list], dict]], column: str, schema: pa.Schema, keep: list[str], rows: int = ROWS):
    """A function for mapInArrow. ``make()`` runs once per task and returns values -> new columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, column, rows):
                new = f(part.column(column).to_pylist())
                new |= {k: part.column(k) for k in keep}
                yield pa.RecordBatch.from_arrays([new[x.name] if isinstance(new[x.name], pa.Array) else pa.array(new[x.name], x.type) for x in schema], schema=schema)

    return run
