"""Readers, sinks, markup, the staged runner, streams, and the driver's entry."""

import json
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorlens.plans.pipeline import Runner, Stage
from priorlens.sources import markup, readers, writers
from priorlens.streaming import feedback as streams


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿k,v\n1,"x\ny"\n2,\n', encoding="utf-8")
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", "x\ny"), ("2", None)]
    (tmp_path / "b.csv").write_text("k,v\n1,2,3\n")
    with pytest.raises(Exception):
        readers.csv(spark, str(tmp_path / "b.csv"), T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())]), strict=True).collect()
    (tmp_path / "a.jsonl").write_text('{"k":1}\n\n{"k":2}\n[3]\n')
    s = T.StructType([T.StructField("k", T.IntegerType())])
    assert sorted(r.k for r in readers.json_lines(spark, str(tmp_path / "a.jsonl"), s).collect() if r.k) == [1, 2]
    with pytest.raises(Exception, match="not a JSON object"):
        readers.json_lines(spark, str(tmp_path / "a.jsonl"), s, strict=True).collect()
    (tmp_path / "p.json").write_text('{\n "a": [1]\n}')
    assert readers.json_object(spark, str(tmp_path / "p.json")) == {"a": [1]}


def test_zip_inventory_and_pluggable(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("b.xml", "<b>é</b>".encode())
        z.writestr("a.XML", b"<a>\xff</a>")
        z.writestr("n.txt", b"no")
    got = readers.zipped_entries(spark, str(tmp_path / "d.zip")).collect()
    assert [(r.entry, r.text) for r in got] == [("a.XML", "<a>�</a>"), ("b.xml", "<b>é</b>")]
    (tmp_path / "x.csv").write_text("h\n1\n\n2\n")
    inv = {r.path.rsplit("/", 1)[1]: r for r in readers.inventory(spark, str(tmp_path)).collect()}
    assert inv["x.csv"].rows == 3 and inv["x.csv"].sha256 == readers.sha256(b"h\n1\n\n2\n") and inv["d.zip"].rows is None
    p = readers.pluggable(spark, str(tmp_path / "x.csv"), lambda b: [{"n": len(b)}], "n long").first()
    assert p.n == 7


PAGES = {"A": [[{"k": "a1"}, {"k": "a2"}], [{"k": "a3"}]], "B": []}


def fetch(key, page):
    pages = PAGES[key]
    return {"status": "013"} if not pages else {"status": "000", "total_page": len(pages), "list": pages[page - 1]}


def test_paged_source(spark):
    spark.dataSource.register(readers.paged_source("test_pages", T.StructType([T.StructField("k", T.StringType())]), lambda key, page: {"status": "013"} if key == "B" else {"status": "000", "total_page": 2, "list": [{"k": f"{key}{page}"}]}))
    assert sorted(r.k for r in spark.read.format("test_pages").option("keys", "A,B,C").load().collect()) == ["A1", "A2", "C1", "C2"]
    rows = list(readers.PagedReader(T.StructType([T.StructField("k", T.StringType())]), fetch, ["A"]).read(readers._Key("A")))
    assert rows == [("a1",), ("a2",), ("a3",)]
    with pytest.raises(RuntimeError, match="status 020"):
        list(readers.PagedReader(T.StructType([]), lambda k, p: {"status": "020"}, ["A"]).read(readers._Key("A")))


def test_latest_facts(spark):
    sub = spark.createDataFrame([("C", "10-K", "x1", "2023-01-01"), ("C", "10-K", "x2", "2024-01-01"), ("C", "10-K", "x3", "2025-01-01"), ("C", "8-K", "x4", "2024-01-01")], "company_id string, form string, accession string, filed string")
    facts = spark.createDataFrame([("C", "x2", "Revenues2", "5", "USD", "2023-12-31"), ("C", "x2", "Revenues3", "6", "USD", "2023-12-31"), ("C", "x3", "Revenues1", "7", "USD", "2024-12-31")], "company_id string, accession string, tag string, value string, unit string, end string")
    r = readers.latest_facts(sub, facts, {"revenue": ["Revenues1", "Revenues2", "Revenues3"]}, ["10-K"], "2024-06-30").collect()
    assert [(x.metric_id, x.tag, x.value) for x in r] == [("revenue", "Revenues2", "5")]
    gate = spark.createDataFrame([("a", "approved", True, "confirmed", 200), ("b", "approved", True, "confirmed", 429), ("c", "pending", True, "confirmed", 200), ("d", "approved", None, "confirmed", 200)], "id string, status string, robots_allowed boolean, rights_status string, last_status int")
    assert [x.refusal for x in readers.source_gate(gate).orderBy("id").collect()] == [None, "host_blocked", "source_not_approved", "robots_not_allowed"]


def test_freeze_and_verify(spark, tmp_path):
    df = spark.range(10).withColumn("run_id", F.lit("r1"))
    path = f"file://{tmp_path}/run"
    m = writers.freeze(spark, path, {"t": df}, inputs={"i": "x"}, policy="p", run_varying=("run_id",))
    assert m["outputs"]["t"]["rows"] == 10 and writers.verify(spark, path, ("run_id",)) == []
    with pytest.raises(FileExistsError):
        writers.freeze(spark, path, {"t": df}, inputs={}, policy="p")
    with pytest.raises(Exception):
        writers.create(df, f"{path}/t")
    df.where("id > 0").write.mode("overwrite").parquet(f"{path}/t")
    assert writers.verify(spark, path, ("run_id",)) == ["t"]
    _, public = writers.split_private(spark.createDataFrame([("é",)], "text string"), ["text"])
    assert public.columns == ["text_sha256", "text_length"] and public.first().text_length == 1
    with pytest.raises(Exception, match="leak"):
        writers.published(spark.createDataFrame([("mail a@b.com",)], "t string"), ["t"], ["t"]).collect()
    assert writers.report({"a": None, "b": 1}, "{a}/{b}") == "not evaluated/1"


HTML = """<html><head><title>T &amp; U</title><meta property="article:published_time" content="2024-01-02T03:04:05Z"><link rel="canonical" href="https://x/y"></head><body><nav>menu</nav><script>var x="</p>"</script>
<article><h2>Sales</h2><p class="byline">By N<p>First <b>bold</b> line.<div class="ad">buy</div><table><tr><th>Item<th colspan=2>Years<tr><td rowspan=2>Rev<td>1<td>2<tr><td>3<td>4</table><p>Tail 😀<img src="i.png" alt="pic"></article><footer>foot</footer></body></html>"""


def test_markup(spark):
    df = spark.createDataFrame([(1, HTML), (2, ""), (3, None)], "page_id long, html string")
    b = markup.blocks(df).orderBy("seq").collect()
    cells = {(r.row_index, r.col_index): r for r in b if r.block_type == "cell"}
    assert {k: r.normalized_text for k, r in cells.items()} == {(0, 0): "Item", (0, 1): "Years", (1, 0): "Rev", (1, 1): "1", (1, 2): "2", (2, 1): "3", (2, 2): "4"}
    assert cells[2, 2].header_refs == ["T1:0:1", "T1:1:0"] and cells[0, 1].colspan == 2 and cells[1, 0].rowspan == 2
    assert [r.section_path for r in b if r.normalized_text == "Tail 😀"] == ["Sales"] and all(r.omitted for r in b if r.normalized_text == "buy") and all(r.role == "navigation" for r in b if r.normalized_text == "menu")
    assert "var x" not in " ".join(r.normalized_text for r in b) and len({r.block_id for r in b}) == len(b)
    one = {r.page_id: r for r in markup.bodies(df).collect()}
    assert (one[1].title, one[1].canonical, one[1].published, one[1].byline) == ("T & U", "https://x/y", "2024-01-02T03:04:05Z", "By N") and one[2].quality == one[3].quality == "body_missing"
    assert all(one[1].body[a.start : a.end] == a.text for a in one[1].atoms) and "buy" not in one[1].body and "First bold line." in one[1].body
    c = markup.block_coverage(markup.blocks(df), "page_id").first()
    assert c.cells == 7 and 0 < c.coverage < 1 and not c.passes
    deep = markup.blocks(spark.createDataFrame([(1, "<div>" * 3000 + "x")], "page_id long, html string"))
    assert deep.count() == 1


def test_bodies_in_bounded_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        pages = spark.range(0, 1300, 1, 1).selectExpr("id as page_id", "case when id % 3 > 0 then concat('<body><p>page ', id, '</p></body>') end as html")
        got = markup.bodies(pages)
        assert int(spark.conf.get(name)) <= 512
        assert got.where("coalesce(body, '') <> if(page_id % 3 > 0, concat('page ', page_id), '')").count() == 0 and got.select("page_id").distinct().count() == got.count() == 1300
        assert markup.bodies(pages.where("page_id < 0")).count() == 0
    finally:
        spark.conf.set(name, before)


def test_runner_reuses_and_stops(spark, tmp_path):
    calls = []

    def double(df, factor):
        calls.append(factor)
        return df.select((F.col("id") * factor).alias("id"))

    def broken(df):
        raise ValueError("no")

    def stages(f, last=None):
        return [Stage("a", double, ("in",), {"factor": f}), Stage("b", double, ("a",), {"factor": 3}), *([last] if last else [])]

    run = lambda f, last=None, n=5: Runner(spark, f"file://{tmp_path}/p").run(stages(f, last), {"in": spark.range(n)})
    r = run(2)
    assert [s["status"] for s in r["stages"]] == ["succeeded", "succeeded"] and sorted(x.id for x in r["tables"]["b"].collect()) == [0, 6, 12, 18, 24]
    assert [s["status"] for s in run(2)["stages"]] == ["reused", "reused"] and calls == [2, 3]
    assert [s["status"] for s in run(5)["stages"]] == ["succeeded", "succeeded"]
    f = run(5, Stage("c", broken, ("b",)))
    assert f["status"] == "failed" and [s["status"] for s in f["stages"]] == ["reused", "reused", "failed"]
    spark.range(3).write.mode("overwrite").parquet(f"file://{tmp_path}/p/b")
    assert [s["status"] for s in run(5)["stages"]] == ["reused", "succeeded"]
    late = Runner(spark, f"file://{tmp_path}/q", deadline_s=-1).run(stages(2), {"in": spark.range(2)})
    assert [s["status"] for s in late["stages"]] == ["failed", "skipped"] and late["stages"][0]["retryable"]
    with pytest.raises(ValueError, match="unknown settings"):
        Runner(spark, str(tmp_path)).run([], {}, {"x": 1})


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_streams_match_batch(spark, tmp_path):
    rows = [(f"k{i % 7}", f"f{i}", f"p{(i * i) % 3}", i) for i in range(40)]
    df = spark.createDataFrame(rows, "idempotency_key string, feedback_id string, payload string, event_index long")
    for k in range(4):
        df.where(F.col("event_index") % 4 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    got = {r.event_index: r.result for r in drain(streams.idempotent(live), "idem").collect()}
    first = {}
    for k, _, p, _ in rows:
        first.setdefault(k, p)
    seen, want = set(), {}
    for k, _, p, i in rows:
        want[i] = "accepted" if k not in seen else "duplicate" if p == first[k] else "idempotency_payload_conflict"
        seen.add(k)
    assert got == want
    c = df.select(F.col("idempotency_key").alias("card_id"), F.lit("v").alias("card_version"), F.lit("f").alias("field"), F.col("payload").alias("after"), "event_index")
    c.coalesce(1).write.parquet(str(tmp_path / "c"))
    out = drain(streams.conflict_keys(spark.readStream.schema(c.schema).parquet(str(tmp_path / "c"))), "conf")
    assert sorted(r.event_index for r in out.collect()) == sorted(i for k, _, p, i in rows if p != first[k])


def test_windows_drop_late_data(spark, tmp_path):
    s = "ts timestamp, kind string, v double"
    import datetime as dt

    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    for k, rows in enumerate([[(at(1), "a", 1.0), (at(1, 30), "a", 2.0)], [(at(5), "a", 4.0)], [(at(5, 30), "a", 0.0)], [(at(1, 5), "a", 8.0), (at(9), "a", 16.0)]]):
        spark.createDataFrame(rows, s).coalesce(1).write.mode("append").parquet(str(tmp_path / f"w/{k}"))
    live = spark.readStream.schema(s).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "w"))
    got = {r.start.hour: r.total for r in drain(streams.windowed(live, "ts", ["kind"], "v"), "win").collect()}
    assert got[1] == 3.0 and got[5] == 4.0
    batch = streams.windowed(spark.read.schema(s).option("recursiveFileLookup", True).parquet(str(tmp_path / "w")), "ts", ["kind"], "v")
    assert {r.start.hour: r.total for r in batch.collect()} == {1: 11.0, 5: 4.0, 9: 16.0}
    assert streams.sessions(spark.read.schema(s).option("recursiveFileLookup", True).parquet(str(tmp_path / "w")), "ts", ["kind"]).count() == 3


def test_entry(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 45
    df = e.entry(spark)
    assert df.count() > 0 and json.loads(df.schema.json())


def test_queries_match_their_sql(spark):
    """Every base query at the smallest scale against DuckDB."""
    import duckdb

    from priorlens.plans import oracle, queries

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    for name, sql in oracle.SQL.items():
        a = c.sql(sql).df()
        b = queries.QUERIES[name](spark, d).toPandas()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns), name
        key = lambda x: sorted(map(repr, x[cols].astype(object).where(x[cols].notna(), None).map(lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v if v is None or isinstance(v, bool) else float(v) if isinstance(v, Decimal) else str(v)).itertuples(index=False, name=None)))
        assert key(a) == key(b), name
