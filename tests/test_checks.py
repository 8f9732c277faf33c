"""Recomputation by digests, whole components in splits, one scan for several consumers, corroboration, matching blocks."""

import difflib
import json
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from priorlens.functions import blocks
from priorlens.operators import lineage, recheck, routing, splits
from priorlens.plans import check_queries, record_queries

CHECKS = ["order_rulebook", "order_recheck", "corroborated_taxes", "routed_lines"]


@pytest.mark.parametrize("name", CHECKS)
def test_queries_match_their_sql(spark, name):
    d, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem"):
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    a, b = c.sql(record_queries.SQL[name]).df(), record_queries.QUERIES[name](spark, d).toPandas()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and check_queries is not None
    plain = lambda x: sorted(map(repr, x[cols].astype(object).where(x[cols].notna(), None).itertuples(index=False, name=None)))
    assert plain(a) == plain(b) and len(b)


def test_one_changed_cell_in_a_million(spark, tmp_path):
    old = spark.range(1_000_000).select("id", (F.col("id") % 97).alias("v"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), "id")).alias("t"))
    new = old.withColumn("v", F.when(F.col("id") == 777_777, 5).otherwise(F.col("v")))
    for name, df in (("old", old), ("new", new), ("same", old.orderBy(F.desc("id")))):
        recheck.write_version(df, ["id"], f"file:{tmp_path}/{name}")
    at = lambda name: f"file:{tmp_path}/{name}"
    found = recheck.compare_versions(spark, at("old"), at("new"), ["id"])
    assert [tuple(r) for r in found.collect()] == [(777_777, 1, "changed", "v", str(777_777 % 97), "5")]
    buckets = recheck.differing_buckets(spark.read.parquet(at("old") + "/tree"), spark.read.parquet(at("new") + "/tree"))
    assert len(buckets) == 1 and recheck.compare_versions(spark, at("old"), at("same"), ["id"]).count() == 0
    read = {f.rsplit("/", 2)[1] for f in spark.read.parquet(at("old") + "/rows").where(F.col("_bucket").isin(buckets)).select(F.col("_metadata.file_path")).distinct().toPandas()["file_path"]}
    assert read == {f"_bucket={buckets[0]}"}  # under a hundredth of the folders
    assert spark.read.parquet(at("old") + "/tree").count() == 1 + 1024 // 32 + 1024


def test_changes_of_every_kind(spark):
    ddl = "k long, g string, v double, w string"
    old = [(1, "a", 1.0, None), (2, None, 0.0, "x"), (3, "c", None, "y"), (4, "d", 4.0, "z"), (4, "d", 5.0, "z"), (None, "n", 1.0, "q"), (7, "same", 7.0, "same"), (8, "twice", 1.0, "t")]
    new = [(1, "a", 1.0, ""), (2, None, None, "x"), (4, "d", 4.0, "z"), (None, "n", 1.0, "q"), (7, "same", 7.0, "same"), (9, "e", 9.0, None), (8, "twice", 1.0, "t"), (8, "twice", 1.0, "t")]
    a, b = spark.createDataFrame(old, ddl), spark.createDataFrame(new, ddl).select("w", "v", "k", "g")
    want = [(1, "a", "changed", "w", None, ""), (2, None, "changed", "v", "0.0", None), (3, "c", "missing", None, None, None), (9, "e", "extra", None, None, None), (8, "twice", "extra", None, None, None)]
    for found in (recheck.compare(a, b, ["k", "g"], 64), recheck.changes(a, b, ["k", "g"])):
        got = [tuple(x) for x in found.drop("place").collect()]
        assert [g for g in got if g[0] != 4].__len__() == 5 and sorted(map(repr, (g for g in got if g[0] != 4))) == sorted(map(repr, want))
        assert sum(g[0] == 4 and g[2] == "missing" for g in got) == 1
    assert recheck.compare(a, a.limit(0), ["k", "g"]).where("change = 'missing'").count() == len(old) and recheck.compare(a.limit(0), a.limit(0), ["k", "g"]).count() == 0
    with pytest.raises(ValueError, match="different columns"):
        recheck.changes(a, b.drop("w"), ["k", "g"])


def test_splits_keep_components_whole(spark):
    r = random.Random(4)
    rows = [(f"r{i}", f"d{i // 3}", None, r.choice(["x", "y", None])) for i in range(3000)]
    edges = [(f"r{r.randrange(3000)}", f"r{r.randrange(3000)}", "same_fact") for _ in range(500)]
    manifest = spark.createDataFrame(rows, "row_id string, doc_id string, event_family_id string, stratum string")
    ties = spark.createDataFrame(edges, "from_id string, to_id string, edge_type string")
    hub = manifest.groupBy("doc_id").agg(F.min("row_id").alias("to_id"))
    every = ties.select("from_id", "to_id").unionByName(manifest.join(hub, "doc_id").select(F.col("row_id").alias("from_id"), "to_id"))
    got = splits.manifest(manifest, every, {"train": 0.7, "development": 0.1, "test": 0.2})
    audit = lineage.split_audit(got.select("row_id", "doc_id", "event_family_id", "split", F.lit("none").alias("exposure"), F.lit("2024-01-01").alias("first_seen")), ties)
    assert audit.count() == 3000 and audit.where(F.size("reasons") > 0).count() == 0
    again = splits.manifest(manifest.repartition(7), every.repartition(3), {"train": 0.7, "development": 0.1, "test": 0.2})
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got.collect()))


def smallest_reachable(edges, nodes):
    up = {n: n for e in edges for n in e} | {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            up[n] = n = up[up[n]]
        return n

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        up[high] = low
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("kind", [int, str])
def test_components_read_done_edges_once(spark, monkeypatch, kind):
    r, written = random.Random(17), []
    real = lineage.stored

    def kept(df, what):
        out = real(df, what)
        written.append(out.count())
        return out

    monkeypatch.setattr(lineage, "stored", kept)
    # groups tied to their smallest member, a few links between groups
    groups = [(10 * g + k, 10 * g) for g in range(300) for k in range(1, 10)] + [(r.randrange(3000), r.randrange(3000)) for _ in range(20)]
    # a chain whose ids are in order, one whose ids aren't, a dense part, twins and loops
    far = [*range(4001, 4300)]
    r.shuffle(far)
    other = [(3001 + i, 3000 + i) for i in range(400)] + list(zip(far, far[1:])) + [(r.randrange(5000, 5040), r.randrange(5000, 5040)) for _ in range(300)] + [(6000, 6001), (6001, 6000), (6002, 6002)]
    nodes = [kind(n) for n in [*range(0, 3500), *far, *range(4990, 5050), 6000, 6001, 6002, 7000]]
    for edges, most in ((groups, 4), (groups + other, 8))[kind is str :]:
        edges = [(kind(a), kind(b)) for a, b in edges]
        written.clear()
        t = "long" if kind is int else "string"
        found = lineage.components(spark.createDataFrame([*edges, (None, nodes[0])], f"a {t}, b {t}"), spark.createDataFrame([(n,) for n in [*nodes, *nodes[:5]]], f"node {t}"))
        got = found.collect()
        assert len(got) == len(nodes) and {x.node: x.component for x in got} == smallest_reachable(edges, nodes)
        assert sum(written) <= most * (len(edges) + len(nodes)) / 2, (sum(written), len(edges), len(nodes))


def test_manifest_of_numbers_is_that_of_their_names(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["x", "y", None])) for i in range(8, 900)] + [(20, "x"), (None, "x")]
    # ids below 8 and above 899 have no row: they tie rows and can name what they tie
    edges = [(r.randrange(1000), r.randrange(1000)) for _ in range(400)] + [(3, 700), (1, 2), (None, 9), (950, 960)]
    numbers, ties = spark.createDataFrame(rows, "k long, stratum string"), spark.createDataFrame(edges, "from_id long, to_id long")
    called = lambda k: F.concat(F.lit("o"), k)
    shares = {"train": 0.7, "development": 0.1, "test": 0.2}
    want = splits.manifest(numbers.where("k is not null").select(called(F.col("k")).alias("row_id"), "stratum"), ties.select(*[called(F.col(c)).alias(c) for c in ties.columns]), shares)
    got = splits.manifest(numbers, ties, shares, row="k", name=called).select(called(F.col("k")).alias("row_id"), "stratum", "component", "split")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 893


def test_all_orders_of_a_part_and_supplier_stay_together(spark, tmp_path):
    spark.createDataFrame([(k, k, "1-URGENT") for k in range(1, 9)], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    # part 1 of supplier 1 in four orders and quantities; part 1 or supplier 1 alone ties nothing, nor does one that is unknown
    lines = [(1, 1, 1, 5.0), (2, 1, 1, 5.0), (3, 1, 1, 5.0), (4, 1, 1, 7.0), (5, 1, 2, 5.0), (6, 2, 1, 5.0), (7, None, 1, 5.0), (8, None, 1, 5.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.row_id: r.component for r in record_queries.QUERIES["split_manifest"](spark, str(tmp_path)).collect()}
    assert got == {f"o{k}": "o1" if k <= 4 else f"o{k}" for k in range(1, 9)}


def test_sizes_of_splits_are_within_the_bound(spark):
    r = random.Random(9)
    parts = [(f"c{i}", r.choice(["x", None]), r.choice([0, 1, 2, 3, 40])) for i in range(4000)] + [("big", "x", 3000), ("bigger", "x", 4500), ("only", "z", 10)]
    shares = {"train": 6, "none": 0, "development": 1, "test": 3}
    got = splits.assign(spark.createDataFrame(parts, "component string, stratum string, weight long"), shares).collect()
    assert sorted(x.component for x in got) == sorted(p[0] for p in parts) and not any(x.split == "none" for x in got)
    size, total = defaultdict(float), defaultdict(float)
    for x in got:
        size[x.stratum, x.split] += x.weight
        total[x.stratum] += x.weight
    for s in ("x", None):
        for name, share in shares.items():
            assert abs(size[s, name] - total[s] * share / 10) <= 40, (s, name, size[s, name], total[s])
    with pytest.raises(ValueError, match="shares"):
        splits.assign(spark.createDataFrame(parts, "component string, stratum string, weight long"), {"a": 0})


def test_strata_by_weight(spark):
    nodes = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 3.0), ("c", "x", 1.5), ("d", None, 9.0), ("e", "y", 9.0), ("f", "q", 0.0)], "node string, stratum string, weight double")
    comps = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "2"), ("e", "2"), ("f", "3")], "node string, component string")
    assert sorted(tuple(x) for x in splits.strata(nodes, comps).collect()) == [("1", "y", 5.5), ("2", "y", 18.0), ("3", "q", 0.0)]


def test_one_scan_for_all_consumers(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, i % 5, f"d{i % 3}") for i in range(30)] + [(None, None, None)], "id long, t long, d string").write.parquet(f"file:{tmp_path}/rows")
    rows = spark.read.parquet(f"file:{tmp_path}/rows")
    asked = {"tables": ({"k": "t"}, spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")), "docs": ({"d": "d", "t": "t"}, spark.createDataFrame([("d0", 1), ("d1", 4)], "d string, t long")), "ids": ({"x": "id * 2"}, spark.createDataFrame([(4,), (8,)], "x long"))}
    want = sorted([(i, "tables") for i in range(30) if i % 5 in (1, 2)] + [(i, "docs") for i in range(30) if (i % 3, i % 5) in ((0, 1), (1, 4))] + [(2, "ids"), (4, "ids")])
    for bound in (100, 1):  # broadcast, and shuffled
        monkeypatch.setattr(routing, "MAX_BROADCAST_KEYS", bound)
        got = routing.routed(rows, asked)
        assert sorted((x.id, x.consumer) for x in got.collect()) == want and got.columns == ["id", "t", "d", "consumer"]
        assert got._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_corroboration(spark):
    facts = [("A", "t", "1"), ("B", "t", "1"), ("C", "t", "1"), ("D", "t", "2"), ("A", "u", "1"), ("A", "u", "1"), ("A", "v", "1"), ("B", "v", "2"), ("A", "w", "1"), ("A", "w", "2"), ("B", "w", "1"), (None, None, None), ("E", None, None), ("A", "z", "1"), ("B", "z", "2"), ("C", "z", "3")]
    got = routing.corroborated(spark.createDataFrame([(*f, 1) for f in facts], "doc_id string, k string, v string, others_ long"), ["k"], "v")
    out = sorted({(x.doc_id or "", x.k or "", x.v or "", x.others, x.agreeing, x.corroboration) for x in got.collect()})
    assert out == sorted({
        ("A", "t", "1", 3, 2, "several"), ("B", "t", "1", 3, 2, "several"), ("C", "t", "1", 3, 2, "several"), ("D", "t", "2", 3, 0, "conflict"), ("A", "u", "1", 0, 0, "none"), ("A", "v", "1", 1, 0, "conflict"), ("B", "v", "2", 1, 0, "conflict"),
        ("A", "w", "1", 1, 1, "ambiguous"), ("A", "w", "2", 1, 0, "ambiguous"), ("B", "w", "1", 1, 0, "ambiguous"), ("", "", "", 1, 1, "one"), ("E", "", "", 1, 1, "one"),
        ("A", "z", "1", 2, 0, "ambiguous"), ("B", "z", "2", 2, 0, "ambiguous"), ("C", "z", "3", 2, 0, "ambiguous"),
    })
    assert got.count() == len(facts)


def theirs(a, b):
    return [tuple(x) for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]]


@pytest.mark.parametrize("cells", [0, 50, 1 << 12])
def test_blocks_are_those_of_difflib(monkeypatch, cells):
    monkeypatch.setattr(blocks, "CELLS", cells)
    r = random.Random(cells)
    for k in range(1000):
        letters = ["ab", "abcdef", "가나abcé😀xyz"][k % 3]
        a = [r.choice(letters) for _ in range(r.randint(0, 60))]
        b = list(a) if r.random() < 0.5 else [r.choice(letters) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 6) if b else 0):
            p = r.randrange(len(b) + 1)
            b[p : p + r.randint(0, 4)] = [r.choice(letters) for _ in range(r.randint(0, 3))]
        assert blocks.matching_blocks("".join(a), "".join(b)) == theirs("".join(a), "".join(b))


@pytest.mark.parametrize("passed", [0, 1, 20])
def test_blocks_when_windows_take_too_much_work(monkeypatch, passed):
    monkeypatch.setattr(blocks, "CELLS", 0)
    monkeypatch.setattr(blocks, "PASSED", passed)
    r = random.Random(passed)
    for k in range(300):
        a = "".join(r.choice(["ab", "abcdef"][k % 2]) for _ in range(r.randint(0, 60)))
        b = "".join(a[p : p + r.randint(1, 20)] for p in (r.randint(0, 59) for _ in range(6))) + a[:5]
        assert blocks.matching_blocks(a, b) == theirs(a, b)


def test_paragraphs_are_found_without_hashes(monkeypatch):
    """A body of a page in all of its text: no step hashes all windows of a range."""
    r = random.Random(3)
    said = [" ".join("".join(r.choice("aeinorst") for _ in range(r.randint(2, 9))) for _ in range(r.randint(5, 80))) for _ in range(40)]
    a, b = "\n".join(said), "menu home about " + " ".join(said) + " all rights reserved"
    wanted = theirs(a, b)

    def none(*_):
        raise AssertionError("hashed")

    monkeypatch.setattr(blocks, "_Hashes", none)
    assert blocks.matching_blocks(a, b) == wanted


def test_blocks_of_a_megabyte():
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    w = [r.choice(words) for _ in range(155_000)]
    v = list(w)
    for p in (3, 70_000, 150_000):
        v[p] = "ZZZ"
    a, b = " ".join(w), " ".join(v)
    got = blocks.matching_blocks(a, b)
    assert len(a) > 1_000_000 and all(a[i : i + n] == b[j : j + n] for i, j, n in got) and sum(n for *_, n in got) > len(a) - 40 and 4 <= len(got) <= 12


def test_alignment_frame(spark):
    rows = [(1, "one two three", "one 2 three"), (2, None, "x"), (3, "", "abc"), (4, "same", "same"), (5, "abc", "")]
    got = {x.id: x for x in blocks.with_blocks(spark.createDataFrame(rows, "id long, left string, right string")).collect()}
    assert [(x.a, x.b, x.size) for x in got[1].blocks] == theirs("one two three", "one 2 three") and got[1].longest_unmatched == 1
    assert got[2].blocks is None and got[3].matched == 0 and got[3].left_fraction is None and got[3].longest_unmatched == 3
    assert (got[4].left_fraction, got[4].longest_unmatched, got[5].right_fraction) == (1.0, 0, None)


def test_registry_table_of_rules(spark):
    table = check_queries.ORDER_BOOK.table(spark)
    assert table.count() == 12 and json.loads(table.orderBy("place").toJSON().first())["code"] == "unknown_customer"
