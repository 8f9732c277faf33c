"""Exact top-k search by inner product with one KD-tree per shard.

Vectors are quantised to integers (floor(scale * x)) and hashed into shards of at most about ``SHARD_ROWS`` rows. A shard's
tree splits at the median of the widest dimension down to leaves of ``LEAF_ROWS`` rows; every node has the tight bounding
box of its rows, and the smallest id below it. A query walks a tree best-first: a heap holds nodes by the upper bound of
the inner product over their boxes, and the walk ends when no node left can beat the kth best, or tie with it by a smaller
id.

The task that builds a tree writes it to the shared folder and searches it for the shard's own queries; their kth best
goes with them as a first bound to every other shard. Queries are written in blocks of at most about ``QUERY_BLOCK`` rows.
Then every (block, shard) is searched, in one job: a task takes a block through some shards and raises the bounds by what
it finds on the way. Nothing is collected or broadcast; tasks hold a tree, a block and k results a query. What the tasks
find is merged by a grouped top-k over at most k rows per query and task.

Null vectors, vectors with a null or non-finite component, and rows without an id take no part; vectors of each length are
searched among themselves. Rows with an equal id are separate candidates; a query never meets a row with its own id.
Scores must fit 64-bit integers: a component that exceeds the root of 2^62 / length after scaling (2^28 for 64 components) is
refused, since no result could hold its scores. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import make_folder, open_fs, pick, read_group, shared_path, stored, write_groups

SHARD_ROWS, LEAF_ROWS, QUERY_BLOCK = 16_384, 256, 8_192
#: Shards are made smaller, down to this, while there are fewer of them than cores.
LEAST_SHARD_ROWS = 2_048


class Tree:
    """Rows in leaf order, and by node: box, smallest id, the row range of leaves, children."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        self.low, self.high, self.least, self.span, self.child = [], [], [], [], []
        places = np.arange(len(ids))
        out: list[np.ndarray] = []
        self._done = 0
        self._split(places, rows, ids, out)
        place = np.concatenate(out)
        # float64 products and sums of these integers are exact below 2^53
        self.ids, self.rows = ids[place], rows[place].astype(np.int32)
        self.low, self.high = np.array(self.low, np.int32), np.array(self.high, np.int32)

    def _split(self, places: np.ndarray, rows: np.ndarray, ids: np.ndarray, out: list[np.ndarray]) -> int:
        node, own = len(self.span), rows[places]
        low, high = own.min(axis=0), own.max(axis=0)
        self.low.append(low), self.high.append(high), self.least.append(int(ids[places].min()))
        self.span.append(None), self.child.append(None)
        if len(places) <= LEAF_ROWS or (low == high).all():
            self.span[node] = (self._done, self._done + len(places))
            out.append(places)
            self._done += len(places)
            return node
        d = int(np.argmax(high.astype(np.int64) - low))
        half = np.argsort(own[:, d], kind="stable")
        mid = len(places) // 2
        self.child[node] = (self._split(np.sort(places[half[:mid]]), rows, ids, out), self._split(np.sort(places[half[mid:]]), rows, ids, out))
        return node

    def search(self, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the k best (query row, id, score) of this shard that can reach ``floor``, its kth best so far."""
        exact = np.abs(q).max(initial=0) * np.abs(self.rows).max(initial=0) * q.shape[1] < 2.0**52
        kind = np.float64 if exact else np.int64
        q, rows = q.astype(kind), self.rows.astype(kind)
        bound = np.maximum(q, 0) @ self.high.T.astype(kind) + np.minimum(q, 0) @ self.low.T.astype(kind)
        own, got_ids, got = [], [], []
        for i in range(len(q)):
            vec, bounds, me = q[i], bound[i].tolist(), q_ids[i]
            best_s, best_i = np.empty(0, kind), np.empty(0, np.int64)
            kth, last = floor[i], None
            heap = [(-bounds[0], self.least[0], 0)]
            while heap:
                b, least, node = heapq.heappop(heap)
                if -b < kth or (-b == kth and last is not None and least > last):
                    if -b < kth:
                        break
                    continue
                if self.child[node] is not None:
                    for c in self.child[node]:
                        if bounds[c] >= kth:
                            heapq.heappush(heap, (-bounds[c], self.least[c], c))
                    continue
                a, z = self.span[node]
                s = rows[a:z] @ vec
                hit = np.flatnonzero(s >= kth)
                if not len(hit):
                    continue
                ids = self.ids[a:z][hit]
                other = ids != me
                best_s, best_i = np.concatenate((best_s, s[hit][other])), np.concatenate((best_i, ids[other]))
                if len(best_s) >= k:
                    order = np.lexsort((best_i, -best_s))[:k]
                    best_s, best_i = best_s[order], best_i[order]
                    if best_s[-1] >= kth:
                        kth, last = best_s[-1], best_i[-1]
            own.append(np.full(len(best_s), i)), got_ids.append(best_i), got.append(best_s)
        if not own:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(own), np.concatenate(got_ids), np.concatenate(got).astype(np.int64)


def quantised(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array of long): the rows that take part."""
    rows = pick(vectors, vec_id=id_col, v=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)))
    most = F.least(F.lit(2.0**31 - 2), F.sqrt(F.lit(2.0**62) / F.size("v")))
    far = F.exists("v", lambda x: F.abs(x * scale) > most)
    v = F.transform("v", lambda x: F.floor(x * scale))
    return rows.select("vec_id", F.when(far, F.raise_error(F.lit("the scores of a vector don't fit 64 bits: a component is too large after scaling"))).otherwise(v).alias("v"))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(n, -1)


def top_k(vectors: DataFrame, k: int = 20, scale: float = 64.0, query_every: int = 20, *, id_col="vec_id", vector_col="embedding", shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the queries (ids divisible by ``query_every``) against all rows."""
    spark = vectors.sparkSession
    cores = spark.sparkContext.defaultParallelism
    rows = stored(quantised(vectors, scale, id_col, vector_col).withColumn("d", F.size("v")), "vectors")
    # a row per length of vectors
    sizes = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % query_every == 0).alias("q")).orderBy("d").collect()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not any(r["q"] for r in sizes):
        return none
    total = sum(r["n"] for r in sizes)
    least = min(shard_rows, max(LEAST_SHARD_ROWS, total // (2 * cores)))
    plan, n_shards, n_blocks = [], 0, 0
    for r in sizes:
        shards, blocks = max(1, -(-r["n"] // least)), -(-r["q"] // query_block)
        plan.append((r["d"], n_shards, shards, n_blocks, blocks))
        n_shards, n_blocks = n_shards + shards, n_blocks + blocks
    plan = F.broadcast(spark.createDataFrame(plan, "d int, first_shard long, shards long, first_block long, blocks long"))
    # equal vectors are spread by their ids
    dealt = rows.join(plan, "d").withColumn("shard", (F.col("first_shard") + F.pmod(F.xxhash64("vec_id", "v"), F.col("shards"))).cast("int"))
    folder = shared_path(spark, "kdtrees")
    make_folder(folder)
    dealt = dealt.repartitionById(n_shards, "shard").sortWithinPartitions("shard").select("shard", "first_block", "blocks", "vec_id", "v")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "shard"):
            shard, first, blocks = (t[c][0].as_py() for c in ("shard", "first_block", "blocks"))
            ids, v = t["vec_id"].to_numpy(), _matrix(t["v"].combine_chunks(), t.num_rows)
            tree = Tree(ids, v)
            file = f"{folder}/tree-{shard}-{uuid.uuid4().hex}"
            fs, at = open_fs(file)
            with fs.open_output_stream(at) as out:
                out.write(pickle.dumps(tree, protocol=5))
            asks = np.flatnonzero(ids % query_every == 0)
            own, found, score = tree.search(ids[asks], v[asks], np.full(len(asks), -(2.0**62)), k)
            cut = np.searchsorted(own, np.arange(len(asks) + 1)).tolist()
            query = [shard << 32 | int(i) for i in asks]
            out = {"file": [file] + [None] * len(asks), "shard": [shard] * (len(asks) + 1), "first_block": [first] * (len(asks) + 1), "blocks": [blocks] * (len(asks) + 1)}
            out["block"] = [None] + [first + int(i) % blocks for i in ids[asks] // query_every] if len(asks) else [None]
            out |= {"query": [None, *query], "query_id": [None, *ids[asks].tolist()], "q": [None, *v[asks].tolist()]}
            out["ids"] = [None] + [found[a:z].tolist() for a, z in zip(cut, cut[1:], strict=False)]
            out["scores"] = [None] + [score[a:z].tolist() for a, z in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_pydict(out, schema=built_schema)

    big, longs = pa.int64(), pa.list_(pa.int64())
    built_schema = pa.schema([("file", pa.string()), ("shard", big), ("first_block", big), ("blocks", big), ("block", big), ("query", big), ("query_id", big), ("q", longs), ("ids", longs), ("scores", longs)])
    built = stored(dealt.mapInArrow(build, "file string, shard long, first_block long, blocks long, block long, query long, query_id long, q array<long>, ids array<long>, scores array<long>"), "trees")
    queries = built.where("file is null")
    blocks = stored(write_groups(queries.select("block", "query", "query_id", "q", "scores"), ["block"], folder), "query-blocks")
    # a unit of work for every tree and block of its length; a task takes one block through every ``ways``-th shard
    ways = max(1, min(n_shards, -(-4 * cores // max(1, n_blocks))))
    units = built.where("file is not null and blocks > 0").select("file", "shard", F.explode(F.sequence("first_block", F.col("first_block") + F.col("blocks") - 1)).alias("block"))
    units = units.join(F.broadcast(blocks) if n_blocks <= 1_000_000 else blocks, "block", "left_semi")
    n_parts = max(1, min(n_blocks * ways, 100_000))
    units = units.withColumn("part", F.pmod(F.col("block") * ways + F.col("shard") % ways, F.lit(n_parts)).cast("int"))
    units = units.repartitionById(n_parts, "part").sortWithinPartitions("block", "shard").select("block", "shard", "file")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "block"):
            asked = read_group(folder, t["block"][0].as_py())
            n = asked.num_rows
            query, q_ids, q = asked["query"].to_numpy(), asked["query_id"].to_numpy(), _matrix(asked["q"].combine_chunks(), n)
            known = asked["scores"].to_pylist()
            floor = np.array([x[-1] if len(x) >= k else -(2.0**62) for x in known])
            own, ids, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
            for shard, file in zip(t["shard"].to_pylist(), t["file"].to_pylist(), strict=True):
                rest = np.flatnonzero(query >> 32 != shard)
                fs, at = open_fs(file)
                with fs.open_input_stream(at) as f:
                    tree = pickle.loads(f.read())
                a, b, c = tree.search(q_ids[rest], q[rest], floor[rest], k)
                own, ids, score = np.concatenate((own, rest[a])), np.concatenate((ids, b)), np.concatenate((score, c))
                # the k best of each query so far, and the bound they give
                order = np.lexsort((ids, -score, own))
                own, ids, score = own[order], ids[order], score[order]
                place = np.arange(len(own)) - np.searchsorted(own, own)
                best = place < k
                own, ids, score, place = own[best], ids[best], score[best], place[best]
                last = place == k - 1
                floor[own[last]] = np.maximum(floor[own[last]], score[last])
            for a in range(0, len(own), 10_000):
                z = slice(a, a + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(query[own[z]]), pa.array(q_ids[own[z]]), pa.array(ids[z]), pa.array(score[z])], names=["query", "query_id", "vec_id", "score"])

    found = units.mapInArrow(search, "query long, query_id long, vec_id long, score long")
    near = queries.select("query", "query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query", "query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.unionByName(near).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of consecutive rows with one value of the key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), batch.num_rows]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if a == z:
                continue
            if held and held[0].column(key)[0].as_py() != values[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)
