"""Near duplicates by MinHash: universal hash minima, banding, verification, connected components by large and small star.

A document's set is its distinct 5-word shingles (words lower-cased in A-Z; fewer than five words: all of them as one
shingle). ``BANDS`` x ``ROWS`` minima of functions a * x + b mod 2^64 are its signature, kept as 16 bits each; a band is
``ROWS`` of them. A pair at the threshold t shares no band with probability (1 - t^4)^20: 4 in 10 million at 0.85 (the
default, op6), 27 in a million at 0.80 (the pipeline's stage), more below.

1. Documents with equal sets are one class with its smallest id as representative, so copies never meet each other.
2. Representatives that share a band form a bucket. Each is paired with the bucket's smallest id only, so pairs grow as the
   buckets do. Pairs whose signatures agree in fewer than ``agree(t)`` places are dropped, the rest are confirmed on full sets.
3. Confirmed links become components by alternating large-star and small-star until nothing changes.
4. What the stars may have missed: buckets that still hold several components are searched for links between different
   components. In buckets of more than ``SMALL`` members each member is first tested against its neighbour in a random
   order, again and again while that joins many components; a turn makes no more pairs than there are members.
5. The rest is searched exactly. Up to ``SMALL`` members, by pairs. Beyond that, a bucket's members are written once, in
   blocks of about ``BLOCK``, to files in the shared folder; a task for each block reads the other blocks' files, takes all
   intersection sizes of two blocks as a product of 0/1 matrices, and gives only links that join something. No member is
   replicated and no pair is emitted. Then components are taken once more.

So every pair that shares a band is either inside one component or was tested. Null ids: such rows count as members of
their text's class, with a null id they are never its representative; a class of them alone has a null component and is
kept. Null texts, and those without words, have 0 shingles and are linked with nothing. Repeated rows each get a row; each row of a
repeated id takes its own text's component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_maps import mapped, resident, small_batches
from .common import drop_stored, pick, read_group, shared_path, stored, write_groups

WORDS, THRESHOLD = 5, 85
BANDS, ROWS = 20, 4
#: A pair at the threshold may agree in fewer places than asked for with this probability at most.
SHORT = 2e-8
SMALL, BLOCK = 64, 256
#: A block holds about so many bytes of sets; its 0/1 matrices are made for so many shingles at a time.
BLOCK_BYTES, COLUMNS = 16 << 20, 8192
#: Random neighbours are tried again while a turn's links join more than this share of the components that are left.
GAIN = 0.1
#: Up to so many ids (8 bytes each) are broadcast; beyond, the join shuffles.
MAX_BROADCAST_IDS = 2_000_000

_random = np.random.default_rng(20)
A = _random.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
B = _random.integers(0, 2**64, BANDS * ROWS, np.uint64)
STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    from xxhash import xxh3_64_intdigest, xxh3_64_digest

    # bytes.lower() and bytes.split() know A-Z and the six ASCII white-space characters only
    found = text.encode().lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.frombuffer(xxh3_64_digest(b" ".join(found)), ">u8").astype(np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(w) - words + 1
    h = np.zeros(n, np.uint64)
    for k in range(words):
        h = (h ^ (h >> np.uint64(29))) * STEP[k % len(STEP)] + w[k : k + n]
    h ^= h >> np.uint64(32)
    h *= STEP[0]
    h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(x: np.ndarray) -> bytes:
    low = np.full(len(A), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), 2048):
        low = np.minimum(low, (x[i : i + 2048, None] * A + B).min(axis=0))
    return ((low >> np.uint64(16)) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def features(docs: DataFrame, *, words: int = WORDS) -> DataFrame:
    """docs: doc_id, text, text_hash. Returns doc_id, text_hash, n_shingles, key (of the whole set; null if empty), sig."""

    def make():
        from xxhash import xxh3_128_digest

        resident("shingles", object)  # what other stages left in this worker goes

        def f(texts):
            n, key, sig = [], [], []
            for text in texts:
                x = shingles(text, words)
                n.append(len(x))
                key.append(xxh3_128_digest(x.tobytes()) if len(x) else None)
                sig.append(signature(x) if len(x) else None)
            return {"n_shingles": n, "key": key, "sig": sig}

        return f

    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("sig", pa.binary())])
    return docs.mapInArrow(mapped(make, "text", schema, ["doc_id", "text_hash"]), "doc_id long, text_hash long, n_shingles long, key binary, sig binary")


def sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """id, set (binary: sorted 64-bit hashes)."""

    def make():
        resident("shingles", object)
        return lambda texts: {"set": [shingles(x, words).tobytes() for x in texts]}

    schema = pa.schema([("doc_id", pa.int64()), ("set", pa.binary())])
    return docs.mapInArrow(mapped(make, "text", schema, ["doc_id"]), "doc_id long, set binary").withColumnRenamed("doc_id", "id")


def linked(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """100 x intersection >= threshold x union of two sorted arrays of distinct values."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if 100 * len(small) < threshold * len(large) or not len(small):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= threshold * (len(a) + len(b) - both)


def agree(threshold: int) -> int:
    """The most places that a pair at the threshold falls short of with a probability of ``SHORT`` at most."""
    n, t = BANDS * ROWS, threshold / 100
    return sum(p <= SHORT for p in accumulate(comb(n, k) * t**k * (1 - t) ** (n - k) for k in range(n)))


def agreement(a, b):
    """Places in which two signatures agree, as a column: bytes are compared in pairs."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(BANDS * ROWS - 1)), F.lit(0), lambda n, k: n + (F.substring(a, k * 2 + 1, F.lit(2)) == F.substring(b, k * 2 + 1, F.lit(2))).cast("int"))


def confirmed(pairs: DataFrame, reps: DataFrame, full: DataFrame, threshold: int) -> DataFrame:
    """pairs (a, b) whose signatures agree enough and whose full sets are linked."""
    sig = reps.select("id", "sig", "n")
    p = pairs.join(sig.toDF("a", "sa", "na"), "a").join(sig.toDF("b", "sb", "nb"), "b")
    close = (100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb")) & (agreement(F.col("sa"), F.col("sb")) >= agree(threshold))
    p = p.where(close).select("a", "b")
    p = p.join(full.toDF("a", "xa"), "a").join(full.toDF("b", "xb"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), threshold) for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return p.mapInArrow(verify, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) for every id with an edge (a, b)."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
        # large star: larger neighbours go to the smallest of the neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large-star")
        # small star: smaller neighbours and the node itself go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, stored(small, "small-star")
        drop_stored(old)
        drop_stored(large)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _bands(reps: DataFrame, *more: str) -> DataFrame:
    """id, more columns, bucket: one row a band."""
    return reps.select("id", *more, F.explode(F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 2 * ROWS * k + 1, 2 * ROWS)) for k in range(BANDS)])).alias("bucket"))


def _members(reps: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components: bucket, id, component, n, m (members), t (shingles of all)."""
    bands = _bands(reps.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id")), "component", "n")
    mixed = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("t"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket", "m", "t")
    return bands.join(mixed, "bucket").select("bucket", "id", "component", "n", "m", "t")


def _neighbours(many: DataFrame, turn: int) -> DataFrame:
    """Each member of a bucket with the one after it in a random order, if that is of another component. The order is cut
    into ranges, so a bucket of any size is spread; what the cuts lose is left to the search."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, ids, comp = (batch.column(c).to_numpy() for c in ("bucket", "id", "component"))
            if last is not None:
                bucket, ids, comp = np.append(last[0], bucket), np.append(last[1], ids), np.append(last[2], comp)
            new = (bucket[1:] == bucket[:-1]) & (comp[1:] != comp[:-1])
            x, y = ids[:-1][new], ids[1:][new]
            last = bucket[-1:], ids[-1:], comp[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    n = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = many.select("bucket", "id", "component", F.xxhash64(F.lit(turn), "id").alias("h")).repartitionByRange(n, "bucket", "h").sortWithinPartitions("bucket", "h")
    return dealt.select("bucket", "id", "component").mapInArrow(pairs, "a long, b long").distinct()


class _Block:
    """A block's rows; ``ids`` is empty for a number that no member was dealt to. (A block with members is opened by a task
    of its own with ``own``, which fails if the file is lost.)"""

    def __init__(self, folder: str, bucket: int, block: int, blocks: int, own: bool):
        rows = read_group(folder, bucket, block, blocks, may_lack=not own)
        if rows is None:
            self.ids, self.component, self.n, self.sets = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), []
            return
        self.ids, self.component = rows["id"].to_numpy(), rows["component"].to_numpy()
        self.sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["set"]]
        self.n = np.array([len(x) for x in self.sets])


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of a with every set of b: products of 0/1 matrices, some columns at a time."""
    x, y = np.concatenate(a), np.concatenate(b)
    i, j = np.repeat(np.arange(len(a)), [len(v) for v in a]), np.repeat(np.arange(len(b)), [len(v) for v in b])
    columns = np.intersect1d(x, y)
    out = np.zeros((len(a), len(b)), np.float64)

    def placed(values, row):
        at = np.searchsorted(columns, values)
        at[at == len(columns)] = 0
        hit = columns[at] == values
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], row[hit][order]

    if len(columns):
        (cx, i), (cy, j) = placed(x, i), placed(y, j)
        for c in range(0, len(columns), COLUMNS):
            width = min(COLUMNS, len(columns) - c)
            p, q = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
            k, m = slice(*np.searchsorted(cx, [c, c + width])), slice(*np.searchsorted(cy, [c, c + width]))
            p[i[k], cx[k] - c] = 1
            q[j[m], cy[m] - c] = 1
            out += p @ q.T
    return out.astype(np.int64)


def _search_blocks(manifest: DataFrame, folder: str, threshold: int) -> DataFrame:
    """Links between different components of a bucket: every block meets half of the ring of blocks, one file at a time, and
    reports a link only if it joins what the task hasn't joined yet. Exact, on full sets."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, block, blocks in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "blocks")), strict=True):
                parent: dict[int, int] = {}

                def root(c):
                    while (p := parent.get(c, c)) != c:
                        parent[c] = c = parent.get(p, p)
                    return c

                own, out = _Block(folder, bucket, block, blocks, True), []
                for d in range(blocks // 2 + 1):
                    if 2 * d == blocks and 2 * block >= blocks:
                        continue
                    far = _Block(folder, bucket, (block + d) % blocks, blocks, False) if d else own
                    x, y = (np.array([root(c) for c in v.component.tolist()]) for v in (own, far))
                    may = (x[:, None] != y) & (100 * np.minimum(own.n[:, None], far.n) >= threshold * np.maximum(own.n[:, None], far.n))
                    i, j = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
                    if not len(i):
                        continue
                    both = shared_counts([own.sets[k] for k in i], [far.sets[k] for k in j])
                    hit = may[np.ix_(i, j)] & (100 * both >= threshold * (own.n[i][:, None] + far.n[j] - both))
                    for p, q in np.argwhere(hit).tolist():
                        p, q = i[p], j[q]
                        u, v = root(int(own.component[p])), root(int(far.component[q]))
                        if u != v:
                            parent[u] = v
                            out.append(sorted((int(own.ids[p]), int(far.ids[q]))))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "bucket", "block").mapInArrow(search, "a long, b long").distinct()


def _missed(members: DataFrame, tested: DataFrame, named: DataFrame, full: DataFrame, threshold: int) -> DataFrame:
    """Links between different components of a bucket, found exactly: in small buckets by pairs, in others by blocks."""
    few, many = members.where(F.col("m") <= SMALL), members.where(F.col("m") > SMALL)
    l, r = few.select("bucket", F.col("id").alias("a"), F.col("component").alias("ca")), few.select("bucket", F.col("id").alias("b"), F.col("component").alias("cb"))
    pairs = l.join(r, "bucket").where("a < b and ca <> cb").select("a", "b").distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    links = confirmed(pairs, named, full, threshold)
    if many.isEmpty():
        return links
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("t") * 8 / BLOCK_BYTES))
    dealt = many.withColumn("blocks", blocks.cast("long")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    folder = shared_path(named.sparkSession, "blocks")
    held = dealt.select("bucket", "block", "blocks", "id", "component").join(full, "id")
    manifest = stored(write_groups(held, ["bucket", "block", "blocks"], folder), "block-manifest")
    return links.unionByName(_search_blocks(manifest, folder, threshold))


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", threshold: int = THRESHOLD, words: int = WORDS, with_hash: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; with_hash: also text_hash (xxhash64 of the text, to find rows by)."""
    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text_hash", F.xxhash64("text"))
    feats = stored(features(rows, words=words), "features")
    reps = stored(feats.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig")), "classes")
    named = reps.where("id is not null").select("id", "n", "sig")
    bands = _bands(named)
    centers = bands.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("_z")).where("a <> _z").drop("_z")
    pairs = stored(bands.join(centers, "bucket").where("id <> a").select("a", F.col("id").alias("b")).distinct(), "star-pairs")
    # whoever shares a bucket is in a star pair, so these are all the sets that any step below needs
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    own = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    full = stored(sets(rows.join(own, "doc_id", "left_semi").select("doc_id", "text"), words), "sets")
    shared = named.join(own.withColumnRenamed("doc_id", "id"), "id", "left_semi")
    links = stored(confirmed(pairs, named, full, threshold), "links")
    comps = stored(components(links), "components")

    def joined(more: DataFrame) -> DataFrame:
        return stored(components(comps.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)), "components")

    turn = 0
    while True:
        members = stored(_members(shared, comps), "members")
        many = members.where(F.col("m") > SMALL)
        left = many.agg(F.count_distinct("component")).first()[0]
        if not left:
            break
        more = stored(confirmed(_neighbours(many, turn), named, full, threshold), "neighbour-links")
        found = more.count()
        if found:
            comps = joined(more)
        if found <= GAIN * left:
            members = stored(_members(shared, comps), "members") if found else members
            break
        turn += 1
    more = stored(_missed(members, pairs, named, full, threshold), "more-links")
    if not more.isEmpty():
        comps = joined(more)
    of = reps.select("key", "id").join(comps, "id", "left").select("key", F.coalesce("component", "id").alias("component_id"))
    out = feats.join(of, "key", "left").select("doc_id", *["text_hash"] * with_hash, "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
