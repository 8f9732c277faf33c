"""Scalar functions: as-of predicates, periods, numbers, text, URLs, ids."""

import os
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from priorlens.functions import asof, ids, numbers, periods, text, urls
from priorlens.functions.reasons import codes, first, merged


def one(spark, expr, **cols):
    kinds = {str: "string", int: "int", bool: "boolean", float: "double"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in cols.items()) or "x int"
    return spark.createDataFrame([tuple(cols.values()) or (1,)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("value, cutoff, strict, reason", [
    (None, "2024-01-01", False, "publication_unknown"), ("", "2024-01-01", False, "publication_unknown"), ("2023-12-31", "2024-01-01", False, None), ("2024-01-01", "2024-01-01", False, None), ("2024-01-01", "2024-01-01", True, "same_day_order_unknown"),
    ("2024-01-02", "2024-01-01", False, "future_information"), ("2024-01-01", "2024-01-01T10:00:00Z", False, "same_day_order_unknown"), ("2023-12-31", "2024-01-01T10:00:00Z", False, None), ("2024-01-01T09:00:00", "2024-01-01T10:00:00Z", False, "timezone_unknown"),
    ("2024-01-01T09:00:00Z", "2024-01-01T10:00:00Z", True, None), ("2024-01-01T10:00:00Z", "2024-01-01T10:00:00Z", True, "future_information"), ("2024-01-01T10:00:00Z", "2024-01-01T10:00:00Z", False, None), ("2024-01-01T19:30:00+09:00", "2024-01-01T10:00:00Z", False, "future_information"),
    ("2024-01-01T09:00:00Z", "2024-01-01T10:00:00", False, "timezone_unknown"), ("2024-13-01", "2024-01-01", False, "invalid_time"), ("nonsense", "2024-01-01", False, "invalid_time"), ("2024-01-01T09:00:00Z", "2024-01-01", False, None),
])
def test_moment_before(spark, value, cutoff, strict, reason):
    got = one(spark, asof.moment_before(F.col("v"), F.col("c"), strict), v=value, c=cutoff)
    assert (got["ok"], got["reason"]) == (reason is None, reason)


CLAIM = "struct<revision_published_at:string,revision_published_date:string,published_at:string,published_date:string,observed_at:string,scope_status_as_of:string,availability_dependencies:array<struct<published_at:string,published_date:string,observed_at:string,use_policy:string>>>"


def available(spark, mode, cutoff="2024-06-01", strict=False, **c):
    deps = [(d.get("published_at"), d.get("published_date"), d.get("observed_at"), d.get("use_policy")) for d in c.get("deps", [])]
    row = (None, c.get("revised"), None, c.get("published"), c.get("observed"), c.get("scope"), deps if "deps" in c else None)
    df = spark.createDataFrame([(row,)], f"c {CLAIM}")
    return df.select(asof.availability(F.col("c"), F.lit(mode), F.lit(cutoff), strict).alias("r")).first()["r"]


def test_availability(spark):
    assert available(spark, "historical_public", published="2024-05-01") == []
    assert available(spark, "current_review", published="2024-05-01") == ["observed:publication_unknown"]
    assert available(spark, "observed_live", published="2024-05-01", observed="2024-06-01") == ["observed:same_day_order_unknown"]
    # a later revision date counts before the first publication
    assert available(spark, "historical_public", published="2024-05-01", revised="2024-07-01") == ["future_information"]
    dep = [{"published_date": "2024-05-01", "observed_at": "2024-07-01", "use_policy": "public"}]
    assert available(spark, "historical_public", published="2024-05-01", deps=dep) == []
    assert available(spark, "observed_live", published="2024-05-01", observed="2024-05-02", deps=dep) == ["dependency:observed:future_information"]
    assert available(spark, "current_review", published="2024-05-01", observed="2024-05-02", deps=dep) == ["dependency:future_information"]
    only = [{"published_date": "2024-05-01", "observed_at": "2024-05-02", "use_policy": "current-only, review"}]
    assert available(spark, "historical_public", published="2024-05-01", deps=only) == ["dependency:current_only_dependency"]
    assert available(spark, "current_review", published="2024-05-01", observed="2024-05-02", deps=only) == []
    assert available(spark, "historical_public", published="2024-05-01", scope="unresolved_retrospective_dependency") == ["scope_unresolved_at_cutoff"]
    assert available(spark, "current_review", published="2024-05-01", observed="2024-05-02", scope="unresolved_retrospective_dependency") == []
    twice = dep * 2
    assert available(spark, "observed_live", published="2024-05-01", observed="2024-05-02", deps=twice) == ["dependency:observed:future_information"]


def period(spark, start, end, days, as_of=None, flow="flow"):
    df = spark.createDataFrame([((start, end, as_of, days), flow)], "p struct<period_start:string,period_end:string,as_of_date:string,duration_days:int>, f string")
    return df.select(periods.period_valid(F.col("p"), F.col("f")).alias("r")).first()["r"]


def test_period_validity(spark):
    assert period(spark, "2024-04-01", "2024-06-30", 91)
    assert not period(spark, "2024-04-01", "2024-06-30", 90)
    assert not period(spark, "2024-06-30", "2024-04-01", -89)
    assert not period(spark, None, "2024-06-30", 91)
    assert period(spark, None, None, None, "2024-06-30", "balance")
    assert not period(spark, None, None, None, "2024-06-31", "balance")
    assert not period(spark, "2024-04-01", "2024-06-30", 91, flow="other")


@pytest.mark.parametrize("a, b, basis, want", [
    (("2024-04-01", "2024-06-30", 91), ("2023-04-01", "2023-06-30", 91), "yoy", True), (("2024-01-01", "2024-12-31", 366), ("2023-01-01", "2023-12-31", 365), "yoy", True), (("2024-01-01", "2024-12-30", 365), ("2023-01-01", "2023-12-31", 365), "yoy", False),
    (("2024-04-01", "2024-06-30", 91), ("2024-04-01", "2024-06-30", 91), "same_period_revision", True), (("2024-04-01", "2024-06-30", 91), ("2024-04-01", "2024-06-29", 90), "same_period_revision", False), (("2024-04-01", "2024-06-30", 90), ("2023-04-01", "2023-06-30", 91), "yoy", None), (("2024-04-01", "2024-06-30", 91), ("2022-04-01", "2022-06-30", 91), "yoy", False),
])
def test_period_alignment(spark, a, b, basis, want):
    s = "struct<period_start:string,period_end:string,as_of_date:string,duration_days:int>"
    df = spark.createDataFrame([((a[0], a[1], None, a[2]), (b[0], b[1], None, b[2]))], f"a {s}, b {s}")
    assert df.select(periods.period_aligned(F.col("a"), F.col("b"), F.lit("flow"), F.lit(basis)).alias("r")).first()["r"] is want


@pytest.mark.parametrize("header, year, want", [
    ("Three Months  Ended June 30,", "2024", ("2024-04-01", "2024-06-30", "quarter", 91, None)), ("Twelve Months Ended June 30", "2024", ("2023-07-01", "2024-06-30", "annual", 366, None)), ("Twelve Months Ended June 30", "2023", ("2022-07-01", "2023-06-30", "annual", 365, None)),
    ("June 30, 2024", "2024", (None, None, "instant", None, None)), ("June 30, 2023", "2024", (None, None, None, None, "unsupported_or_conflicting_period_header")), ("Three Months Ended June 30,", "2023 2024", (None, None, None, None, "missing_or_ambiguous_year_header")), ("Three Months Ended June 30,", "FY 2024", (None, None, None, None, "unsupported_duration_year_header")), ("Six Months Ended", "2024", (None, None, None, None, "unsupported_or_conflicting_period_header")), (None, "2024", (None, None, None, None, "missing_or_ambiguous_year_header")),
])
def test_parse_period(spark, header, year, want):
    got = one(spark, periods.parse_period(F.col("h"), F.col("y")), h=header, y=year)
    assert (got["period_start"], got["period_end"], got["period_kind"], got["duration_days"], got["error"]) == want


def test_dates(spark):
    assert str(one(spark, periods.quarter_bounds(F.lit("2024Q3"))["end"])) == "2024-09-30"
    assert one(spark, periods.quarter_bounds(F.lit("2024Q5"))["start"]) is None
    assert str(one(spark, periods.english_date(F.lit("SEOUL, March 3, 2024 -- text")))) == "2024-03-03"
    got = one(spark, periods.safe_date(F.lit("2024.03.05 오후 3:07")))
    assert (str(got["day"]), got["clock"], got["precision"], got["zone"]) == ("2024-03-05", "15:07:00", "minute", None)
    assert one(spark, periods.safe_date(F.lit("2024년 3월 5일")))["precision"] == "date"
    assert one(spark, periods.safe_date(F.lit("yesterday")))["precision"] == "unknown"
    assert one(spark, periods.utc_if_offset(F.lit("2024-01-01T00:00:00"))) is None


def test_dates_are_read_once(spark):
    """Each pattern stands once in the plan of a date, however many of its fields are read; parts as before."""
    rows = ["2024. 3. 5", "2024년 13월 5일", "2024-02-30 25:10", "2024-1-2 오전 12:05", "2024-1-2 오후 12:05:09Z", "9:61", "2024/12/31T23:59:58+0900", None, "", "2024-01-01 7:08 KST"]
    d = spark.createDataFrame([(x,) for x in rows], "x string").select("x", periods.safe_date(F.col("x")).alias("s")).select("x", "s.day", "s.clock", "s.precision", "s.zone")
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_extract(") <= 4
    assert [(str(r.day), r.clock, r.precision, r.zone) for r in d.collect()] == [
        ("2024-03-05", None, "date", None), ("None", None, "unknown", None), ("None", None, "unknown", None), ("2024-01-02", "00:05:00", "minute", None), ("2024-01-02", "12:05:09", "second", "Z"),
        ("None", None, "unknown", None), ("2024-12-31", "23:59:58", "second", "+0900"), ("None", None, "unknown", None), ("None", None, "unknown", None), ("2024-01-01", "07:08:00", "minute", "KST"),
    ]


@pytest.mark.parametrize("raw, value, error", [
    ("0", "0", None), ("0.000001", "0.000001", None), ("  12  ", "12", None), ("(10)", "-10", None), ("-", None, "dash_not_zero"), ("—", None, "dash_not_zero"), ("unknown", None, "unknown_numeric_value"), ("N/A", None, "unknown_numeric_value"), ("1,23", None, "malformed_numeric_token"), ("(-1)", None, "ambiguous_sign"),
    ("(10", None, "ambiguous_sign"), ("NaN", None, "malformed_numeric_token"), ("", None, "blank_numeric_cell"), ("  ", None, "blank_numeric_cell"), (None, None, "blank_numeric_cell"), ("$1,234.50", "1234.50", None), ("1,234,567", "1234567", None), ("-5", "-5", None),
])
def test_parse_number(spark, raw, value, error):
    got = one(spark, numbers.parse_number(F.col("v")), v=raw)
    assert got["error"] == error and (got["value"] == Decimal(value) if value else got["value"] is None)


def test_exact_numbers(spark):
    f = lambda op, a, b: one(spark, op(F.col("a"), F.col("b")), a=a, b=b)
    assert f(numbers.exact_difference, "11714000001", "1") == "11714000000"
    assert f(numbers.exact_relative, "1", "3") == "-0.6666666666666666666666666667"
    assert f(numbers.exact_relative, "1", "-3") == "1.333333333333333333333333333"
    assert f(numbers.exact_relative, "5", "0") is None and f(numbers.exact_quotient, "5", "0") is None and f(numbers.exact_relative, None, "1") is None
    assert one(spark, numbers.decimal_text(F.lit("10.500").cast("decimal(10,3)"))) == "10.5" and one(spark, numbers.decimal_text(F.lit("-0.0").cast("decimal(10,1)"))) == "0" and one(spark, numbers.decimal_text(F.lit("100").cast("decimal(10,0)"))) == "100"
    assert one(spark, numbers.first_number(F.lit("▲ 1,200.5억"))) == Decimal("-1200.5")
    r = one(spark, numbers.ratio(F.lit(1), F.lit(0)))
    assert (r["value"], r["reason"]) == (None, "zero_denominator")
    s = one(spark, numbers.signed_by_policy(F.lit("5").cast("decimal(10,0)"), F.lit("outflow_to_positive")))
    assert s["error"] == "positive_capex_source_sign_ambiguous"


def test_scaling(spark):
    rules = spark.createDataFrame([("R1", "thousands", "currency=USD", "1000", "USD"), ("R2", "millions", "any_same_currency", "1000000", "base"), ("R3", "millions", "EUR", "1000000", "EUR")], "rule_id string, input_unit string, currency_condition string, multiplier string, output_unit string")
    a = spark.createDataFrame([(1, "1.5", "thousands", "USD"), (2, "1.5", "millions", "EUR"), (3, "1.5", "thousands", "EUR"), (4, None, "thousands", "USD"), (5, "x", "thousands", "USD"), (6, "2", "unknown", "USD"), (7, "2", "millions", "KRW"), (8, "2", "millions", None)], "k int, value string, unit string, currency string")
    got = {r.k: (r.output, r.rule_id, r.calculation_status, r.reasons) for r in numbers.scaled(a, rules).collect()}
    assert got[1] == ("1500", "R1", "computed", []) and got[7] == ("2000000", "R2", "computed", [])
    assert got[2][3] == got[3][3] == ["no_unambiguous_scale_rule"] and got[4][2:] == ("insufficient_inputs", ["value_missing"]) and got[5][2] == "invalid_input" and got[6][3] == got[8][3] == ["currency_or_unit_unknown"]


def test_text(spark):
    assert one(spark, text.compact(F.col("v")), v=" a \r\n b ") == "a b" and one(spark, text.nonwhite_length(F.col("v")), v=" a b ") == 2
    assert one(spark, text.normal_form(F.col("v")), v="ﬁ Ａ-é!") == "fiaé"
    assert one(spark, text.grams(F.col("v")), v="abcab") == ["abc", "bca", "cab"] and one(spark, text.grams(F.col("v")), v="ab") == [] and one(spark, text.grams(F.col("v")), v="") == [] and one(spark, text.grams(F.col("v")), v="a😀b") == ["a😀b"]
    assert one(spark, text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)
    got = one(spark, text.collapse_with_map("v", F.lit(10)), v="  A \r\n B😀  ")
    assert got["text"] == "A B😀" and got["map"] == [[12, 13], [13, 17], [17, 18], [18, 19]]
    x = 'He said "no." Then left! 다음 문장입니다。\n\nLast'
    s = one(spark, text.sentences("v"), v=x)
    assert [r["text"] for r in s] == ['He said "no."', "Then left!", "다음 문장입니다。", "Last"] and all(x[r["start"] : r["end"]] == r["text"] for r in s)
    assert one(spark, text.sentence_texts(F.col("v")), v=x) == [r["text"] for r in s]
    g = one(spark, text.signals("v"), v='"Quote" 3조 원 in 2024, not 7')
    assert [(r["kind"], r["text"].strip()) for r in g] == [("quote", '"Quote"'), ("number_unit", "3조"), ("period", "2024"), ("negation", "not"), ("number", "7")]
    q = one(spark, text.quantity(F.col("v")), v="3조 2,000억 원")
    assert (q["value"], q["unit"], q["compound"]) == (Decimal("3200000000000.0000"), "원", True)
    assert one(spark, text.refs(F.lit("a; b|;c"))) == ["a", "b", "c"]
    assert one(spark, text.similarity(F.lit("abcd"), F.lit("bcde"))) == 0.75


@given(st.text(alphabet="ab .!?\n\t\"é😀", max_size=40))
@settings(max_examples=200, deadline=None)
def test_sentences_cover_all_but_white_space(x):
    spans = text.sentence_spans(x)
    assert all(x[a:z] == t and t.strip() == t and t for a, z, t in spans) and all(p[1] <= q[0] for p, q in zip(spans, spans[1:]))
    covered = {i for a, z, _ in spans for i in range(a, z)}
    assert all(c.isspace() for i, c in enumerate(x) if i not in covered)


@pytest.mark.parametrize("url, want", [
    ("HTTP://Example.COM:80/a/b?utm_source=x&b=2&a=1#top", "http://example.com/a/b?b=2&a=1"), ("https://u:p@x.org:443", "https://x.org/"), ("https://x.org:8443/?ref=1", "https://x.org:8443/"), ("nonsense", None), (None, None),
])
def test_canonical_url(spark, url, want):
    assert one(spark, urls.canonical(F.col("u")), u=url) == want


def test_urls(spark):
    assert one(spark, urls.redacted(F.lit("https://u:p@x.org/a?k=1#f"))) == "https://x.org/a"
    safe = lambda u: one(spark, urls.is_safe(F.lit(u)))
    assert safe("https://news.example.com/a") and not any(map(safe, ["http://example.com", "https://127.0.0.1/", "https://localhost/", "https://a@b.com/", "https://b.com:8443/"]))
    assert one(spark, urls.article_id(F.lit("https://x.org/v.html?a=1&no=77"))) == "77" and one(spark, urls.article_id(F.lit("https://x.org/2024/1234.html"))) == "1234"


def test_reasons_and_ids(spark):
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert one(spark, codes((t, "b"), (f, "x"), (n, "y"), (t, "a"), (t, "b"))) == ["b", "a"]
    assert one(spark, first((f, "x"), (n, "y"), (t, "z"))) == "z" and one(spark, merged(F.array(F.lit("a")), F.lit(None).cast("array<string>"), F.array(F.lit("a"), F.lit("b")))) == ["a", "b"]
    a, b = one(spark, ids.stable_id("Q", F.lit("a"), F.lit("bc"))), one(spark, ids.stable_id("Q", F.lit("ab"), F.lit("c")))
    assert a != b and len(a) == 26
    df = spark.range(50).withColumn("v", F.col("id") % 7)
    d = lambda x: ids.dataset_digest(x).first()
    assert d(df) == d(df.orderBy(F.desc("id")).repartition(7)) and d(df)["rows"] == 50 and d(df) != d(df.unionByName(df.limit(1))) and d(df.select("v", "id")) == d(df)
    assert d(df.where("id < 0"))["rows"] == 0


def test_numbers_beyond_precision_are_said_to_be(spark):
    rows = ["9" * 28, "9" * 29, "0" * 20 + "9" * 28, "(1." + "1" * 11 + ")", "1." + "1" * 10 + "000", "0.00000000001", "1.5"]
    from priorlens.functions import numbers as N

    got = [r.p for r in spark.createDataFrame([(x,) for x in rows], "x string").select(N.parse_number(F.col("x")).alias("p")).collect()]
    assert [p.error for p in got] == [None, "number_beyond_precision", None, "number_beyond_precision", None, "number_beyond_precision", None]
    assert [p.value is None for p in got] == [False, True, False, True, False, True, False]


def test_chunk_bounds_are_those_of_chunks(spark):
    """Without Python in the plan, and with all that Python takes for white space; a long blank run takes no square of time."""
    texts = [None, "", " \n", "a", " a b\n", "\x1c a\x85b　", "a\n\n", "😀 b ", "x" + " " * 200_000 + "y", "​z\x1f"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.chunks("t").alias("c"), text.chunk_bounds(F.col("t")).alias("b"))
    for r in d.collect():
        if not r.c:
            assert r.b is None or r.b.chunks == 0
        else:
            assert (r.b.chunks, r.b.first_start, r.b.last_end) == (len(r.c), r.c[0].start, r.c[-1].end)


def test_chunk_offsets_stay_in_spark(spark):
    from priorlens.plans import record_queries

    assert "Python" not in record_queries.chunk_offsets(spark, f"{os.environ.get('TEST_DATA', '/root/testdata')}/sf0.001")._jdf.queryExecution().executedPlan().toString()
