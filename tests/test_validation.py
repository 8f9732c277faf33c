"""Validators, layout picks and articles: what the queries don't reach, and their twins."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from priorlens.operators import annotate, articles, layout, tables, validation
from priorlens.sources import store

BLOCK = "raw_text string, normalized_text string, offset_mapping struct<unit:string,status:string>, spans array<struct<start:int,end:int,text:string>>, source_xpath string, xpath_texts array<string>, location_status string, evidence_eligible boolean"


def test_blocks_with_nulls(spark):
    rows = [
        (None, None, None, None, None, None, None, None), ("ab", "ab", ("unicode_codepoint", "identity"), [(0, 2, "ab"), (1, 1, "")], "/p", ["ab"], None, True),
        ("a😀b", "a😀b", ("unicode_codepoint", "identity"), [(1, 2, "😀")], "/p", ["a", "a😀b"], None, False), ("ab", "ab", ("unicode_codepoint", "not_available"), [(None, 1, "a")], "", None, "text_only_unlocated", True), ("ab", "ab", ("unicode_codepoint", "identity"), [(-1, 1, "a")], "/p", [], None, False),
    ]
    got = [x.errors for x in validation.block_errors(spark.createDataFrame(rows, BLOCK)).collect()]
    assert got == [
        ["offset_unit_invalid", "missing_source_location"], [], ["source_xpath_round_trip_failed"], ["span_round_trip_failed", "unlocated_or_unmapped_evidence_forbidden"], ["span_round_trip_failed", "source_xpath_round_trip_failed"],
    ]


FACT = "claim_id string, doc_id string, evidence_pointer string, value_span_start int, value_span_end int, value_raw string, sign_policy string, numeric_value string, scale string, numeric_value_base_units string, balance_or_flow string, period_start string, period_end string, period_duration_days int, expected_header string, fiscal_year int, period_header_pointer string, year_header_pointer string, extra int"


def test_facts_repeated_missing_and_negative(spark):
    base = ("c1", "d", "/v", 0, 7, "(1,234)", "preserve", "-1234", "1000", "-1234000", "balance", None, None, None, None, None, None, None, 7)
    rows = [base, base, ("c2", *base[1:]), ("c3", "x", *base[2:]), ("c4", "d", "/w", 0, 1, "-", *base[6:])]
    cells = spark.createDataFrame([("d", "/v", "(1,234)"), ("d", "/v", "(1,234)"), ("d", "/w", "-")], "doc_id string, pointer string, text string")
    out = validation.fact_errors(spark.createDataFrame(rows, FACT), cells)
    assert out.columns[:-1] == [c.split()[0] for c in FACT.split(", ")]
    got = sorted((x.claim_id, x.errors) for x in out.collect())
    assert got == [("c1", ["claim_id_repeated"])] * 2 + [("c2", []), ("c3", ["evidence_cell_missing"]), ("c4", ["value_not_numeric"])]
    assert validation.fact_errors(spark.createDataFrame([], FACT), cells).count() == 0


def test_facts_of_a_crowded_document(spark, monkeypatch):
    """Documents too large for a task are joined by place, all others dealt once: the errors are the same, unknown places too."""
    fact = lambda d, k: (f"{d}-{k % 90}", d, f"/v{k}" if k % 7 else None, 0, 3, f"{100 + k % 5}", "preserve", f"{100 + k % 3}", "1", f"{100 + k % 5}", "balance", None, None, None, "June 30", 2024, f"/h{k % 4}", None if k % 5 else "/y", 1)
    rows = [*[fact("big", k) for k in range(120)], *[fact(f"d{k % 9}", k) for k in range(60)], fact(None, 1), fact("lone", 2), (None, *fact("d1", 3)[1:]), (None, *fact("d1", 4)[1:])]
    texts = [(d, f"/v{k}", f"{100 + k % 4}") for d in ("big", *[f"d{x}" for x in range(9)]) for k in range(110)] + [(d, f"/h{k}", "June 30,") for d in ("big", "d2") for k in range(3)]
    texts += [("big", "/y", "FY 2024"), ("d5", "/y", "2023"), ("d5", None, "FY 2024"), (None, "/v1", "101"), ("big", "/v1", None), ("big", "/v2", "100")]
    facts, cells = spark.createDataFrame(rows, FACT), spark.createDataFrame(texts, "doc_id string, pointer string, text string")
    found = lambda: sorted((repr(tuple(x)) for x in validation.fact_errors(facts, cells).collect()))
    assert not validation._dealt(facts, cells)[1]
    want = found()
    assert len(want) == len(rows)
    monkeypatch.setattr(store, "TASK_ROWS", 10)
    n, crowded = validation._dealt(facts, cells)
    assert n > 100 and 0 < len(crowded) < 13
    monkeypatch.setattr(validation, "_dealt", lambda *_: (8, crowded))
    assert found() == want
    monkeypatch.setattr(validation, "_read_by_document", validation._read_by_place)
    assert found() == want


def test_facts_are_dealt_twice(spark):
    """By document and by claim: before, they went through four shuffles with all that the rules read."""
    texts = spark.range(3000).select(F.concat("id", F.lit("-d")).alias("doc_id"), F.concat_ws("", *[F.sha2(F.concat("id", F.lit(f"-{i}")), 512) for i in range(8)]).alias("text"))
    text = lambda x: F.lit(x).cast("string")
    row = {"claim_id": F.col("doc_id"), "evidence_pointer": text("/v"), "value_span_start": F.lit(0), "value_span_end": F.length("text"), "value_raw": F.col("text"), "period_header_pointer": text("/h"), "year_header_pointer": text("/y"), "fiscal_year": F.lit(2024)}
    facts = texts.select(*[row.get(name, F.lit(None).cast(kind) if name != "doc_id" else F.col("doc_id")).alias(name) for name, kind in (c.split() for c in FACT.split(", "))])
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before = written()
    checked = validation.fact_errors(facts, texts.select("doc_id", F.lit("/v").alias("pointer"), "text")).select("claim_id", "errors").where("array_contains(errors, 'value_not_numeric')")
    assert checked.count() == 3000 and written() - before < 8_500_000  # 3 MB of texts on either side


def test_annotations_without_columns_or_facts(spark):
    contract = {"required_top_level": ["item_id", "facts", "method"], "assessment_file_required_top_level": ["questions"]}
    df = spark.createDataFrame([("i",)], "item_id string")
    assert validation.annotation_errors(df, df, contract).first().errors == ["missing:facts", "missing:method"]
    assert validation.assessment_errors(df, df, contract).first().errors == ["missing:questions"]


def test_probes_and_counts(spark):
    rows = [("a", "429", "0", "2", None, None), ("b", None, None, "0", "", "run_trace_only"), ("c", "200", "9", "9", "2024", None)]
    got = {x.trial_id: x.errors for x in validation.denial_errors(spark.createDataFrame(rows, "trial_id string, http_status string, retry_count string, endpoint_requests_after_failure string, observed_at string, observation_precision string")).collect()}
    assert got == {"a": ["requests_after_host_denial", "missing_timestamp_reason"], "b": ["malformed_count"], "c": []}
    counts = validation.count_mismatches(spark.range(1).select(F.lit(3).alias("x"), F.lit(4).alias("y")), {"x": 3})
    assert [tuple(r) for r in counts.collect()] == [("x", 3, 3, True), ("y", 4, None, False)]


def test_row_values_take_the_nearest(spark):
    words = spark.createDataFrame([("p", 0, 10, 100, "Sales"), ("p", 1, 300, 100, "5.0"), ("p", 2, 340, 105, "(7)"), ("p", 3, 320, 106, "9"), ("p", 4, 10, 200, "Sales"), ("p", 5, 335, 195, "8"), ("q", 0, None, None, None)], "page_id string, ord int, x0 int, y0 int, text string")
    asked = spark.createDataFrame([("r1", "p", "Sales", "left", 1000, 330), ("r2", "p", "Sales", "right", 1000, 330), ("r3", "p", "Sales", "left", 1000, None), ("r4", "p", "Sales", "left", 1000, 340)], "request_id string, page_id string, label string, side string, width int, header_x int")
    got = {r.request_id: (r.value_text, r.distance) for r in layout.row_values(words, asked).collect()}
    assert got == {"r1": ("8", 5), "r2": (None, None), "r3": (None, None), "r4": ("(7)", 0)}


def test_spanned_headers_without_table(spark):
    facts = spark.createDataFrame([("c", "d", "t", "flow", 1), ("e", "d", "u", "flow", 0)], "claim_id string, doc_id string, table_xpath string, balance_or_flow string, table_col_index int")
    cells = spark.createDataFrame([("d", "t", 0, 0, 3, "h"), ("d", "t", 2, 1, None, "y")], "doc_id string, table_xpath string, row int, ord int, colspan int, pointer string")
    got = {r.claim_id: (r.period_header_pointer, r.year_header_pointer, r.error) for r in layout.refined_headers(facts, cells).collect()}
    assert got == {"c": ("h", "y", None), "e": (None, None, "header_not_found")}


def test_prose_needs_length_and_a_sentence(spark):
    long = "가나다라 " * 9
    blocks = spark.createDataFrame([("a", 0, 0, True, long + ".", [0.0]), ("a", 2, 1, True, long + "끝.", [1.0]), ("b", 0, 0, True, "short.", [0.0]), ("b", 0, 1, False, long + ".", [0.0]), ("b", 1, 0, True, None, None)], "doc_id string, page int, ord int, is_text boolean, text string, bbox array<double>")
    wanted = spark.createDataFrame([("a", 2), ("b", 0), ("c", 0)], "doc_id string, page int")
    got = {r.doc_id: (r.page, r.error) for r in layout.prose_blocks(blocks, wanted).collect()}
    assert got == {"a": (3, None), "b": (None, "no_prose_block"), "c": (None, "no_prose_block")}


@pytest.mark.parametrize(("title", "want"), [("[속보] x", (True, False, False)), ("【 사설 】", (False, True, False)), ("(인터뷰) [기고]", (False, True, True)), ("속보", (False, False, False)), (None, (False, False, False))])
def test_title_markers(spark, title, want):
    assert tuple(spark.createDataFrame([(title,)], "t string").select(*articles.title_markers(F.col("t"))).first()) == want


def test_reviewer_slots(spark):
    c = spark.createDataFrame([("C1", "d", "s", "f")], "candidate_id string, doc_id string, source_id string, event_family_id string")
    chosen = spark.createDataFrame([("C1", 101)], "candidate_id string, human_review_rank int")
    assert [r.review_slot_id for r in articles.reviewer_slots(c, chosen, "50%").orderBy("reviewer_slot").collect()] == ["50%-101-R1", "50%-101-R2"]


def test_statement_facts_say_why_not(spark):
    docs = spark.createDataFrame([("d", 2025), ("e", None)], "doc_id string, fiscal_year int")
    named = spark.createDataFrame([("d", "T", "CASH"), ("e", "T", "CASH")], "doc_id string, table_id string, caption string")
    cells = spark.createDataFrame([("d", "T", 0, 0, "Paid"), ("d", "T", 0, 2, "x ($1,000.5) y"), ("d", "T", 1, 0, "Got"), ("d", "T", 1, 2, "7"), ("d", "T", 2, 0, "Dash"), ("d", "T", 2, 2, "-"), ("d", "T", 3, 0, "Bare")], "doc_id string, table_id string, row int, col int, text string").withColumn("pointer", F.lit("p"))
    w = [tables.Wanted("CASH", x, 2, x, "year", "ALL", "outflow_to_positive") for x in ("Paid", "Got", "Dash", "Bare", "None")]
    out = {(r.doc_id, r.metric_id): r for r in tables.statement_facts(docs, named, cells, w).collect()}
    assert len(out) == 10 and {k[1]: r.error for k, r in out.items() if k[0] == "d"} == {"Paid": None, "Got": "outflow_not_negative", "Dash": "no_number", "Bare": "cell_not_found", "None": "row_not_found"}
    r = out["d", "Paid"]
    assert (r.value_raw, r.value_span_start, r.value_span_end, r.numeric_value, r.numeric_value_base_units) == ("($1,000.5)", 2, 12, Decimal("1000.5"), Decimal("1000500000"))
    assert (str(r.period_start), str(r.period_end), r.period_duration_days, r.balance_or_flow) == ("2024-07-01", "2025-06-30", 365, "flow")


def test_best_table_needs_every_part(spark):
    found = spark.createDataFrame([("d", "A", 5, "Sales DRAM", ["Unit: x"]), ("d", "B", 1, "Sales DRAM", None), ("e", "A", 0, "Sales", ["Unit"])], "doc_id string, table_id string, ord int, text string, context array<string>")
    cells = spark.createDataFrame([(d, t, r, c, x) for d in "de" for t in "AB" for r, c, x in ((0, 1, "Sales"), (1, 0, "Memory"), (1, 1, t))], "doc_id string, table_id string, row int, col int, text string")
    args = dict(required=["Sales", "DRAM"], weights={}, header="Sales", not_header="%", label="Mem", unit="Unit")
    assert [(r.doc_id, r.table_id, r.value_raw) for r in tables.best_table(found, cells, **args).collect()] == [("d", "A", "A")]
    assert tables.best_table(found, cells, **args | {"label": "None"}).count() == 0


def test_annotators_read_apart(spark):
    rows = [("1,234.5 ",), (" (7)",), ("12,34",), ("1 2",), ("5 units",), ("(5",), (None,), ("",)]
    d = spark.createDataFrame(rows, "x string").select(annotate.number_a(F.col("x")).alias("a"), annotate.number_b(F.col("x")).alias("b"))
    got = [(r.a.raw, r.a.start, r.a.error, r.b.raw, r.b.start, r.b.error) for r in d.collect()]
    assert got[:2] == [("1,234.5", 0, None, "1,234.5", 0, None), ("(7)", 1, None, "(7)", 1, None)]
    assert [(g[2], g[5]) for g in got[2:]] == [("one_token_expected", "unsupported_token"), ("one_token_expected", "unsupported_token"), ("unparsed_material", "unsupported_token"), ("unbalanced_parentheses", "unbalanced_parentheses"), ("one_token_expected", "unsupported_token"), ("one_token_expected", "unsupported_token")]
    heads = [("Twelve Months Ended June 30,", "2025"), ("June 30, 2024", "June 30, 2024"), ("June 30, 2024", "2024"), ("Six Months Ended June 30,", "2024"), ("Three Months Ended June 31,", "2024"), (None, "2024"), ("June 30,", "2023 2024")]
    p = spark.createDataFrame(heads, "h string, y string").select(annotate.period_a(F.col("h"), F.col("y"), (6, 30)).alias("a"), annotate.period_b(F.col("h"), F.col("y"), (6, 30)).alias("b")).collect()
    assert p[0].a == p[0].b and (p[0].a.period_start, p[0].a.period_end, p[0].a.duration_days) == ("2024-07-01", "2025-06-30", 365)
    assert p[1].a == p[1].b and p[1].a.as_of_date == "2024-06-30" and p[1].a.period_kind == "instant"
    assert [(r.a.error, r.b.error) for r in p[2:]] == [("unsupported_duration", None), ("unsupported_duration", "unsupported_duration"), ("not_a_date", "outside_fiscal_calendar"), ("month_and_day_missing", "outside_fiscal_calendar"), ("one_source_year_expected", "one_source_year_expected")]


def test_boundary_findings(spark):
    from priorlens.sources import markup

    long = "word " * 30
    html = f"<title>{long}</title><header><p>{long}</p></header><div><p>{long}</p></div><article><p>{long}</p><div class='related'><p>{long}</p></div><p>short</p></article><aside><p>{long}</p></aside>"
    pages = spark.createDataFrame([(1, html), (2, f"<p>{long}</p>"), (3, None)], "page_id long, html string")
    got = sorted(r.kind for r in layout.boundary_findings(markup.blocks(pages)).collect())
    assert got == ["header_metadata_candidate", "omitted_region_contains_substantive_structure", "outside_substantive_text_review", "title_metadata_preserved", "widget_or_byline_boundary_candidate"]


def test_record_and_validation_queries_match_their_sql(spark):
    """The queries of records and validators at the smallest scale against DuckDB."""
    import duckdb

    from priorlens.plans import record_queries, validation_queries

    d, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    assert validation_queries.block_rules is record_queries.QUERIES["block_rules"]
    plain = lambda v: v if v is None or isinstance(v, (bool, str)) else str(v) if not isinstance(v, (int, float, Decimal)) else round(float(v), 6)
    for name, sql in record_queries.SQL.items():
        a, b = c.sql(sql).df(), record_queries.QUERIES[name](spark, d).toPandas()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns), name
        key = lambda x: sorted(map(repr, x[cols].astype(object).where(x[cols].notna(), None).map(plain).itertuples(index=False, name=None)))
        assert key(a) == key(b), name


def test_joins_have_tasks_for_their_rows(spark, monkeypatch):
    """Rows that compress well aren't dealt by their small size to a few tasks."""
    monkeypatch.setattr(store, "TASK_ROWS", 100)
    pages = spark.range(1000).select(F.col("id").alias("page_id"))
    words = pages.select("page_id", F.inline(F.expr("array(struct(0 as ord, 10 as x0, 203 as y0, 'Net sales' as text), struct(1 as ord, 110 as x0, 205 as y0, '77' as text))")))
    lines = pages.select("page_id", F.lit(0).alias("ord"), F.lit(100).alias("x0"), F.lit("3Q").alias("text"))
    asked = pages.select(F.col("page_id").alias("request_id"), "page_id", F.lit("3Q").alias("needle"), F.lit("sales").alias("label"), F.lit("left").alias("side"), F.lit(1000).alias("width"))
    found = layout.row_values(words, layout.headers(lines, asked))
    assert found.rdd.getNumPartitions() >= 30 and found.where("value_text = '77' and distance = 10").count() == 1000


def test_facts_are_checked_in_tasks_for_their_rows(spark, monkeypatch):
    monkeypatch.setattr(store, "TASK_ROWS", 100)
    pages = spark.range(1000).select(F.col("id").alias("page_id"))
    facts = pages.selectExpr(
        "cast(page_id as string) as claim_id", "'d' as doc_id", "concat('p', page_id) as evidence_pointer", "cast(null as string) as period_header_pointer", "cast(null as string) as year_header_pointer", "0 as value_span_start", "2 as value_span_end", "'77' as value_raw", "'preserve' as sign_policy", "'77' as numeric_value", "'1' as scale",
        "'77' as numeric_value_base_units", "'balance' as balance_or_flow", "'2024-01-01' as period_start", "'2024-01-01' as period_end", "1 as period_duration_days", "'x' as expected_header", "2024 as fiscal_year",
    )
    cells = pages.selectExpr("'d' as doc_id", "concat('p', page_id) as pointer", "'77' as text").where("page_id > 0")
    checked = validation.fact_errors(facts, cells)
    assert checked.rdd.getNumPartitions() >= 19
    assert checked.where("size(errors) = 0").count() == 999 and checked.where("errors = array('evidence_cell_missing')").count() == 1
