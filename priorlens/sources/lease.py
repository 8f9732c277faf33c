"""One writer at a time for a folder, on any of Hadoop's file systems that creates files exclusively.

A lease is a file that is created or not, ``lease-<number>``; numbers only rise, and the highest is the fencing number. A new
writer takes the next number if the last lease was given back or is older than its time. Commits are files created in the
same way, numbered one after another, that name their lease and what they publish. A writer whose lease isn't the last one
any more is refused; should it lose the lease in the moment of its commit, readers pass over commits of a lease lower than
one that committed before. So nothing depends on clocks but how long a dead writer is waited for.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


class Held(RuntimeError):
    """Another writer has the lease."""


class Stale(RuntimeError):
    """The lease isn't the last one any more, or was given back."""


@dataclass(frozen=True)
class Lease:
    folder: str
    number: int
    owner: str


def _open(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _create(spark: SparkSession, path: str, what: dict) -> bool:
    """Creates the file with its whole content, or says that it is there. The content is written beside it first and renamed,
    as a rename onto a file that is there fails, so a reader never meets half a file."""
    fs, at = _open(spark, path)
    if fs.exists(at):
        return False
    temp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    claim = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.claim")
    try:  # creation without overwriting is what decides between two writers
        fs.create(claim, False).close()
    except Exception as e:
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps(what).encode()))
    out.close()
    return bool(fs.rename(temp, at))


def _listed(spark: SparkSession, folder: str, kind: str, ending: str = "") -> list[int]:
    fs, at = _open(spark, folder)
    if not fs.exists(at):
        return []
    found = (re.fullmatch(rf"{kind}-(\d+){ending}", s.getPath().getName()) for s in fs.listStatus(at))
    return sorted(int(m[1]) for m in found if m)


def _read(spark: SparkSession, path: str) -> dict | None:
    fs, at = _open(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def acquire(spark: SparkSession, folder: str, owner: str, seconds: float = 600.0, now: float | None = None) -> Lease:
    """The next lease of a folder, or ``Held``. ``seconds``: how long a lease that isn't given back holds others off."""
    now = time.time() if now is None else now
    fs, at = _open(spark, folder)
    fs.mkdirs(at)
    # a claim without its file is a writer that died in between (or is about to go on): its number is never used again
    numbers = _listed(spark, folder, "lease", r"(?:\.claim)?")
    last = numbers[-1] if numbers else 0
    if last:
        held = _read(spark, f"{folder}/lease-{last:012d}")
        given_back = _read(spark, f"{folder}/released-{last:012d}") is not None
        claimed = _open(spark, f"{folder}/lease-{last:012d}.claim")
        since = held["at"] if held else claimed[0].getFileStatus(claimed[1]).getModificationTime() / 1000
        wait = held["seconds"] if held else seconds
        if not given_back and now < since + wait:
            raise Held(f"lease {last} of {folder} is held by {held['owner'] if held else 'a writer that is taking it'}")
    if not _create(spark, f"{folder}/lease-{last + 1:012d}", {"owner": owner, "at": now, "seconds": seconds}):
        raise Held(f"lease {last + 1} of {folder} was taken in the same moment")
    return Lease(folder, last + 1, owner)


def check(spark: SparkSession, lease: Lease) -> None:
    """Raises ``Stale`` unless the lease is the last one and not given back."""
    last = _listed(spark, lease.folder, "lease", r"(?:\.claim)?")[-1]
    if last != lease.number or _read(spark, f"{lease.folder}/released-{lease.number:012d}") is not None:
        raise Stale(f"lease {lease.number} of {lease.folder}: the last one is {last}")


def release(spark: SparkSession, lease: Lease) -> None:
    check(spark, lease)
    _create(spark, f"{lease.folder}/released-{lease.number:012d}", {"owner": lease.owner})


def commit(spark: SparkSession, lease: Lease, published: dict) -> int:
    """Publishes (for instance the path of a written table) as the next commit; returns its number. Raises ``Stale`` if the
    lease was lost."""
    while True:
        check(spark, lease)
        done = _listed(spark, lease.folder, "commit", r"(?:\.claim)?")
        n = done[-1] + 1 if done else 1
        if _create(spark, f"{lease.folder}/commit-{n:012d}", {"lease": lease.number, "owner": lease.owner, "published": published}):
            if n not in {k for k, _ in commits(spark, lease.folder)}:
                raise Stale(f"lease {lease.number} was lost while it committed")
            return n


def commits(spark: SparkSession, folder: str) -> list[tuple[int, dict]]:
    """(number, published) of the commits that count, in order."""
    out, highest = [], 0
    for n in _listed(spark, folder, "commit"):
        c = _read(spark, f"{folder}/commit-{n:012d}")
        if c["lease"] >= highest:
            highest = c["lease"]
            out.append((n, c["published"]))
    return out
