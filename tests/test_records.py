"""Claim signals, JSON pointers, record rules, joins and windows of the record queries."""

import json

import pytest
from pyspark.sql import functions as F

from priorlens.functions import claim_signals, json_text
from priorlens.operators import evaluate, records, relational
from tests.conftest import DATA


@pytest.fixture
def kinds(spark):
    def of(x):
        found = spark.createDataFrame([(x,)], "x string").select(claim_signals.claim_signals("x").alias("s")).first().s
        return [(s.kind, x[s.start : s.end], json.loads(s.normalized)) for s in found]

    return of


def test_signals_of_a_sentence(kinds):
    x = "삼성전자는 2024년 3분기 HBM3E 매출이 1,200억 원을 기록했다고 밝혔다"
    found = kinds(x)
    by = {k: (s, n) for k, s, n in found if k != "action"}
    assert by["scope"] == ("삼성전자", {"label": "company_samsung_electronics"})
    assert by["period"] == ("2024년 3분기", {"kind": "explicit_year_quarter", "year": 2024, "quarter": 3, "anchored": True})
    assert by["product"][1] == {"label": "HBM3E"} and by["modality"][1] == {"label": "actual_reported"} and by["attribution"][1] == {"label": "reporting_verb"}
    quantities = [(s, n) for k, s, n in found if k == "quantity"]
    assert [s for s, _ in quantities] == ["1,200억 원"]
    assert quantities[0][1] == {"value": "1200", "unit": "KRW", "scale_multiplier": 100000000, "compound_amount_component": False, "base_value": "120000000000", "normalization_status": "simple_explicit_unit"}


def test_quantities_keep_what_they_are_not(kinds):
    status = lambda x: [n["normalization_status"] for k, _, n in kinds(x) if k == "quantity"]
    assert status("3조 2000억 원") == ["compound_requires_review"] * 2
    assert status("모두 12 이다") == ["unit_missing"]
    assert status("용량 16Gb 와 16GB") == ["simple_explicit_unit"] * 2
    units = [n["unit"] for k, _, n in kinds("용량 16Gb 와 16GB") if k == "quantity"]
    assert units == ["gigabit", "gigabyte"]
    assert status("HBM4 양산") == [] and status("v1.5") == []
    assert kinds("") == []
    quote = [s for k, s, _ in kinds('그는 "' + "가" * 1999 + '" 라고') if k == "quote"]
    assert len(quote) == 1 and not [1 for k, *_ in kinds('"' + "가" * 2001 + '"') if k == "quote"]


@pytest.mark.parametrize(("x", "kind", "anchored"), [("2024.02.30", "invalid_explicit_date", False), ("2024-2-3", "explicit_date", True), ("2024Q1", "explicit_year_quarter", True), ("다음 달", "next_month", False), ("3 월", "month_or_day_without_year", False), ("그때", "relative_period", False)])
def test_periods(x, kind, anchored, spark):
    p = spark.createDataFrame([(x,)], "x string").select(claim_signals.period_kind("x").alias("p")).first().p
    assert (p["kind"], p["anchored"]) == (kind, anchored)


def test_signals_far_apart_and_numbers_of_any_form(kinds):
    """No cap on the spaces within an amount; signs, commas and zeros; full-width digits; emoji count as one."""
    part = lambda x: [n["compound_amount_component"] for k, _, n in kinds(x) if k == "quantity"]
    assert part("3조" + " " * 200 + "2000억 원") == [True, True] and part("3조 원, 2000억 원") == [False, False]
    value = lambda x: [(n["value"], n["base_value"]) for k, _, n in kinds(x) if k == "quantity"]
    assert value("😀 +1,234.50억 원") == [("1234.5", "123450000000")] and value("-0.00012만 원") == [("-0.00012", "-1.2")]
    assert value("007 개") == [("7", "7")] and value("0.0%") == [("0", "0")] and value("-0 %") == [("0", "0")] and value("１２ 개") == [("12", "12")]
    assert value("5천 명") == [("5", "5000")] and value("12조") == [("12", None)]
    assert kinds("HBM3E와 hbm 4")[0][1:] == ("HBM3E", {"label": "HBM3E"}) and kinds("HBM3E와 hbm 4")[1][1:] == ("hbm 4", {"label": "HBM4"})
    assert [(k, s) for k, s, _ in kinds("지난해 5월 3일 개발하지 않았다")] == [("period", "지난해"), ("period", "5월 3일"), ("action", "개발"), ("negation_or_uncertainty", "않")]


def test_diagnostic_of_two_sentences(spark):
    a = "메모리 사업 매출은 2024년 3분기 100억 원을 판매했다"
    rows = [(a, a), (a, "최근 GPU 공급이 중단됐다"), ("", ""), (None, a)]
    d = spark.createDataFrame(rows, "l string, r string").select(claim_signals.claim_signals("l").alias("l"), claim_signals.claim_signals("r").alias("r"))
    got = [x.g for x in d.select(claim_signals.diagnostic(F.col("l"), F.col("r")).alias("g")).collect()]
    assert got[0].numeric_surface_prerequisites_present and got[0].review_priority == "contextual_numeric_review" and len(got[0].readiness_blockers) == 4
    assert [(q.base_value, q.unit) for q in got[0].common_quantities] == [("10000000000", "KRW")]
    assert "no_common_explicit_value_unit" in got[1].readiness_blockers and "negation_or_uncertainty_scope_requires_review" in got[1].readiness_blockers
    assert "relative_or_partial_period_requires_resolution" in got[1].readiness_blockers and got[1].review_priority == "context_completion_review"
    assert got[2].common_quantities == []


def test_json_pointers(spark):
    doc = json.dumps({"a": [{"b": "x"}, 2], "0": "key", "m~n": {"o/p": None}, "q": {"datePublished": "d1", "list": [{"datePublished": "d2"}, {"datePublished": 3}]}})
    d = spark.createDataFrame([(doc,), ("no json",), (None,)], "j string")
    at = lambda p: [r[0] for r in d.select(json_text.pointer(F.col("j"), p)).collect()]
    assert at("/a/0/b") == ["x", None, None] and at("/a/1") == ["2", None, None] and at("/0") == ["key", None, None] and at("/zz") == [None, None, None]
    assert at("") == [doc, "no json", None]
    with pytest.raises(ValueError):
        json_text.pointer(F.col("j"), "a/b")
    got = d.select(json_text.walk(F.col("j"), ["datePublished"]).alias("w")).collect()
    assert [(x.path, x.value) for x in got[0].w] == [("$.q.datePublished", "d1"), ("$.q.list[0].datePublished", "d2")] and got[1].w is None and got[2].w is None


def record(spark, **changes):
    temporal = {"time_precision": "date", "published_at": None, "published_date": "2024-04-30", "reference_period": None, "effective_period": None} | changes.pop("temporal", {})
    normalized = {"company_id": "C", "scope_id": "S", "entity_refs": ["C"]} | changes.pop("normalized", {})
    normalized = tuple((tuple(temporal[f.name] for f in records.TEMPORAL.fields) if f.name == "temporal" else normalized.get(f.name)) for f in records.NORMALIZED.fields)
    evidence = [{"doc_id": "D", "revision_id": "r", "start": 0, "end": 4, "location_status": "verified", "location_type": "text", "block_id": "B", "selected_text": "some", "header_refs": None} | changes.pop("evidence", {})]
    base = {"record_id": "1", "example_kind": "source", "record_kind": "event_claim", "raw": (None, None), "normalized": normalized, "provenance": (changes.pop("rights", "approved"), "D", "r", [tuple(e.values()) for e in evidence]), "derived": []} | changes
    schema = f"record_id string, example_kind string, record_kind string, raw struct<claim_text:string,action_raw:string>, normalized {records.NORMALIZED.simpleString()}, provenance struct<rights_check_status:string,doc_id:string,revision_id:string,evidence:array<struct<doc_id:string,revision_id:string,start:int,end:int,location_status:string,location_type:string,block_id:string,selected_text:string,header_refs:array<string>>>>, derived array<struct<calculation_status:string,input_refs:array<string>,missing_inputs:array<string>>>"
    rows = spark.createDataFrame([tuple(base.values())], schema)
    return records.semantic_errors(rows, spark.createDataFrame([("B", "some text"), ("Z", "other")], "block_id string, raw_text string")).first().errors


def test_record_rules_one_by_one(spark):
    assert record(spark) == []
    said = lambda *paths: {"field_missing_reasons": {p: "not_disclosed" for p in paths}}
    late = {"published_at": "2024-04-30T10:00:00"}
    assert record(spark, normalized=said("temporal.published_at", "temporal.reference_period.period_end", "raw.claim_text", "product_id", "no.such.path")) == []
    assert record(spark, temporal=late, normalized=said("temporal.published_at")) == ["temporal.published_at: missing reason attached to a present value"]
    assert record(spark, raw=("text", None), normalized=said("raw.claim_text", "temporal", "entity_refs")) == [f"{p}: missing reason attached to a present value" for p in ("entity_refs", "raw.claim_text", "temporal")]
    assert record(spark, rights="unresolved") == ["evidence.selected_text: excerpt must not be copied with unresolved rights"]
    assert record(spark, evidence={"block_id": "gone"}) == ["verified source span cannot be checked without original block"]
    assert record(spark, evidence={"end": None}) == ["span endpoints must both be null or both be integers"]
    assert record(spark, temporal={"published_at": "2024-05-01T00:00:00+09:00"}) == ["published_at local date disagrees with published_date"]
    assert record(spark, normalized={"value_kind": "range", "lower": "10", "upper": "9.5"}) == ["range lower exceeds upper"]
    assert record(spark, normalized={"prior_state_status": "repeated"}) == ["comparable/repeated requires actual prior claim ID"]
    assert record(spark, normalized={"entity_refs": None}) == ["company_id missing from entity_refs"]
    got = record(spark, record_kind="business_relation", normalized={"relation_type": "supplies_to", "subject_role": "customer", "object_role": "customer", "subject_entity_id": "a", "object_entity_id": "b"})
    assert got == ["supplies_to requires supplier→customer direction and roles"]
    assert record(spark, derived=[("computed", [], None), ("insufficient_inputs", ["x"], [])]) == ["computed requires input refs", "insufficient_inputs requires named missing inputs"]


def test_small_joins_and_windows(spark):
    left = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    direct, related = spark.createDataFrame([(1, "d"), (None, "n")], "k int, v string"), spark.createDataFrame([(1, "r"), (2, "r")], "k int, v string")
    assert sorted(((r.k, r.v, r.basis) for r in relational.crosswalk(left, direct, related, "k", "v").collect()), key=str) == sorted([(1, "d", "direct"), (2, "r", "related"), (3, None, "none"), (None, None, "none")], key=str)
    got = relational.unique_anchor(left, spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, t string"), ["k"], "t").collect()
    assert sorted(((r.k, r.t, r.anchors) for r in got), key=str) == sorted([(1, "a", 1), (2, None, 2), (3, None, 0), (None, None, 0)], key=str)
    with pytest.raises(Exception, match="the key repeats"):
        relational.star(left, "k", {"x": spark.createDataFrame([(1, "a"), (1, "b")], "k int, t string")}).collect()
    old, new = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string"), spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "k int, v string")
    assert sorted((r.k, r.status, r.fields) for r in relational.regression(old, new, "k", ["v"]).collect()) == [(1, "same", []), (2, "differs", ["v"]), (3, "only_old", []), (4, "only_new", [])]


def test_evaluation_notices_a_lost_candidate(spark):
    facts = spark.createDataFrame([("a", True), ("b", False)], "record_id string, ranked boolean")
    one = {r.system: r for r in evaluate.systems(facts, spark.createDataFrame([(["a"],)], "candidate_refs array<string>")).collect()}
    assert not one["S3"].same_universe and not one["S1"].same_universe and one["S0"].same_universe and one["S2"].status == "not_evaluated"
    all_in = {r.system: r for r in evaluate.systems(facts, spark.createDataFrame([(["a", "b"],)], "candidate_refs array<string>")).collect()}
    assert all_in["S3"].same_universe
    extra = {r.system: r for r in evaluate.systems(facts, spark.createDataFrame([(["a", "b", "z"],)], "candidate_refs array<string>")).collect()}
    assert not extra["S3"].same_universe


def test_patterns_are_tried_where_their_needles_are(spark):
    """A needle stands in every text that its pattern matches, letters of another case and of two code points included."""
    texts = ["hbm 4e", "d램", "D-ram", "v 낸드", "ſſd", "s\u212a hyn\u0130x", "samsung electronıcs", "메모리  부문", "반도체(ds)", "돌입한 사장", "lpddr 5x", "", "plain text"]
    rows = [(kind, label, p) for kind, group in claim_signals._DICTIONARIES.items() for label, p in group.items()]
    d = spark.createDataFrame([(x,) for x in texts], "x string")
    has = lambda p: F.exists(F.array(*map(F.lit, claim_signals.needles(p))), lambda n: F.contains(claim_signals.folded(F.col("x")), n))
    missed = [F.when(F.rlike("x", F.lit(f"(?iuU)(?:{p})")) & ~has(p), F.lit(label)) for _, label, p in rows]
    assert d.select(F.explode(F.array_compact(F.array(*missed)))).collect() == []
    found = d.select("x", F.transform(claim_signals.claim_signals("x"), lambda s: s["normalized"]).alias("n")).collect()
    by = {r.x: r.n for r in found}
    assert by["ſſd"] == ['{"label": "SSD"}'] and by["s\u212a hyn\u0130x"] == ['{"label": "company_sk_hynix"}'] and by[""] == []
    assert sum('"DRAM"' in n for x in ("d램", "D-ram") for n in by[x]) == 2


@pytest.mark.parametrize("name", ["quantity_signals", "claim_signal_counts", "date_texts"])
def test_one_file_keeps_all_cores_busy(spark, name):
    from priorlens.plans import record_queries

    plan = record_queries.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    assert f"RoundRobinPartitioning({spark.sparkContext.defaultParallelism})" in plan
