"""Rules as data: the compiler, and every contract rule with a record that passes and one that breaks it."""

import copy
import random

import pytest
from pyspark.sql import functions as F

from priorlens.operators.contracts import Terms, contract_book, contract_errors
from priorlens.operators.rulebook import Elements, Lookup, Rule, Rulebook

TERMS = Terms("C1", "ALL", "-SEG-", "fin-0.1", "seg-fy", "guide-1")
EVIDENCE = "evidence_id string, doc_id string, revision_id string, location string, start int, end int, selected_text string, header_refs array<string>"
PERIOD = "struct<period_start:string,period_end:string,as_of_date:string,period_basis:string,period_kind:string,fiscal_year:int,fiscal_quarter:int,duration_days:int,missing_reason:string>"
NORMALIZED = f"""struct<company_id:string,scope_id:string,definition_version:string,evidence_status:string,field_missing_reasons:map<string,string>,availability_dependencies:array<struct<record_id:string,available_at:string,published_date:string>>,
 temporal:struct<date_conflict_status:string,published_date:string,published_at:string,available_at:string,timezone:string,utc_offset:string,time_precision:string,observed_at:string,reference_period:{PERIOD},effective_period:struct<period_kind:string,period_start:string,period_end:string>>,
 subject_entity_id:string,object_entity_id:string,subject_role:string,object_role:string,relation_type:string,negation:string,modality:string,direction:string,valid_from:string,valid_to:string,
 metric_id:string,consolidation:string,currency:string,canonical_unit:string,scale:string,source_scale:string,source_numeric_value:string,numeric_value:string,sign_policy:string,financial_context:struct<period_duration:int>>"""
STRUCT = lambda ddl: "struct<" + ",".join(f"{c.split()[0]}:{c.split()[1]}" for c in ddl.split(", ")) + ">"
RECORD = f"""record_kind string, claim_id string, relation_id string, event_id string, event_family_id string, annotation_status string, human_gold boolean, exposure_status string, guide_version string, assessment struct<author_kind:string,as_of:string>,
 raw struct<source_evidence_status:string,source_period_start_derivation:string,value_raw:string,source_effective_period:string>, normalized {NORMALIZED.replace(chr(10), "")},
 provenance struct<doc_id:string,revision_id:string,source_sha256:string,source_parser_version:string,source_schema_version:string,source_normalization_revision_id:string,evidence:array<{STRUCT(EVIDENCE)}>>, derived array<struct<output:string,reviewed_by:string>>"""


def ev(i, text, refs=()):
    return {"evidence_id": i, "doc_id": "D1", "revision_id": "r1", "location": f"/x/{i}", "start": 1, "end": 1 + len(text), "selected_text": text, "header_refs": list(refs)}


HEADERS = ["H1", "H2", "H3", "H4"]
CELLS = [ev(h, f"head {h}") for h in HEADERS]


def claim(**changes):
    numeric = ev("V1", "$(1,250)", HEADERS)
    temporal = {
        "date_conflict_status": "not_yet_checked", "published_date": "2024-07-30", "time_precision": "date", "observed_at": "2024-08-01T00:00:00", "effective_period": {"period_kind": "unknown"},
        "reference_period": {"period_start": "2024-04-01", "period_end": "2024-06-30", "period_basis": "fiscal", "period_kind": "quarter", "fiscal_year": 2024, "fiscal_quarter": 4, "duration_days": 91},
    }
    out = {
        "record_kind": "event_claim", "claim_id": "K1", "event_id": "E1", "event_family_id": "F1", "annotation_status": "agent_draft", "human_gold": False, "exposure_status": "adaptation", "guide_version": "guide-1",
        "assessment": {"author_kind": "agent_draft", "as_of": "2024-09-01T00:00:00"}, "raw": {"source_evidence_status": "reported", "source_period_start_derivation": "header", "value_raw": "$(1,250)"},
        "normalized": {
            "company_id": "C1", "scope_id": "ALL", "definition_version": "fin-0.1", "evidence_status": "company_reported", "field_missing_reasons": {"temporal.published_at": "not_disclosed"},
            "availability_dependencies": [{"record_id": "D2", "available_at": "2024-08-02T00:00:00", "published_date": None}], "temporal": temporal, "metric_id": "revenue", "consolidation": "consolidated", "currency": "USD", "canonical_unit": "USD",
            "scale": "1", "source_scale": "1000000", "source_numeric_value": "-1250", "numeric_value": "-1250000000", "sign_policy": "preserve", "financial_context": {"period_duration": 91},
        },
        "provenance": {"doc_id": "D1", "revision_id": "r1", "source_sha256": "aa", "source_parser_version": "p1", "source_schema_version": "s1", "source_normalization_revision_id": "n1", "evidence": [numeric, *copy.deepcopy(CELLS)]},
        "derived": [{"output": "-1250000000", "reviewed_by": None}],
    }
    return changed(out, changes)


def segment(**changes):
    """A claim of a segment: another scope and definition, and no second document."""
    out = claim(claim_id="K2")
    out["normalized"] |= {"scope_id": "C1-SEG-A", "definition_version": "seg-fy2024", "availability_dependencies": [], "consolidation": "segment"}
    return changed(out, changes)


def spending(**changes):
    """A claim whose sign is turned."""
    out = claim(claim_id="K3")
    out["normalized"] |= {"metric_id": "positive_cash_capex", "numeric_value": "1250000000", "sign_policy": "outflow_to_positive"}
    out["derived"][0]["output"] = "1250000000"
    return changed(out, changes)


def relation(**changes):
    out = claim(record_kind="business_relation", relation_id="R1")
    out["raw"] |= {"source_evidence_status": "stated", "source_effective_period": "unknown"}
    out["normalized"] |= {"subject_entity_id": "C1", "object_entity_id": "C2", "subject_role": "supplier", "object_role": "customer", "relation_type": "supplies_to", "negation": "no", "modality": "actual", "direction": "subject_to_object"}
    return changed(out, changes)


def changed(out, changes):
    out = copy.deepcopy(out)
    for path, v in changes.items():
        at, *rest = path.split("__")
        target = out
        while rest:
            target = target[int(at) if at.isdigit() else at]
            at, *rest = rest
        target[int(at) if at.isdigit() else at] = v
    return out


@pytest.fixture(scope="module")
def tables(spark):
    df = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    link = lambda i: (i, "E1", "F1", "D1")
    fact = lambda i, scope, metric: (i, scope, metric, "reported", "header", "s1", "n1", "$(1,250)")
    raw = ("Three  Months Ended\nJune 30,", "2024", " $(1,250)")
    index = [(e["evidence_id"], "D1", "r1", e["location"], e["start"], e["end"], e["selected_text"], e["header_refs"], "numeric_value" if e["evidence_id"] == "V1" else "header") for e in claim()["provenance"]["evidence"]]
    return {
        "facts": df([fact("K1", "ALL", "revenue"), fact("K2", "C1-SEG-A", "revenue"), fact("K3", "ALL", "positive_cash_capex"), fact("K4", "ALL", "revenue")], "claim_id string, scope_id string, metric_id string, evidence_status string, period_start_derivation string, schema_version string, normalization_revision_id string, value_raw string"),
        "links": df([link(i) for i in ("K1", "K2", "K3", "R1")], "item_id string, event_id string, event_family_id string, doc_id string"),
        "documents": df([("D1", "r1", "aa", "2024", "p1", "2024-07-30", "2024-08-01T00:00:00"), ("D2", "r1", "bb", "2024", "p1", None, "2024-08-02T00:00:00")], "doc_id string, revision_id string, sha256 string, fiscal_year string, parser_version string, published_date string, observed_at string"),
        "stored": df([("D1", "aa"), ("D2", "bb")], "doc_id string, sha256 string"),
        "relations": df([("R1", "C1", "C2", "supplier", "customer", "supplies_to", "ALL", "no", "actual", "stated", "unknown")], "relation_id string, subject_entity_id string, object_entity_id string, subject_role string, object_role string, relation_type string, scope_id string, negation string, modality string, evidence_status string, effective_period string"),
        "metrics": df([("revenue",), ("positive_cash_capex",)], "metric_id string"), "entities": df([("C1",), ("C2",)], "entity_id string"),
        "packets": df([(i, "aa", ["V1", *HEADERS], raw) for i in ("K1", "K2", "K3", "R1")], "item_id string, source_sha256 string, evidence_refs array<string>, raw struct<period_header:string,year_header:string,value_cell:string>"),
        "evidence": df(index, EVIDENCE + ", evidence_kind string"),
        "nodes": df([("D1", e["location"], " " + e["selected_text"]) for e in claim()["provenance"]["evidence"]] + [("D1", "/x/twice", " $(1,250)")] * 2, "doc_id string, location string, text string"),
    }


P, N, T = "provenance__", "normalized__", "normalized__temporal__"
#: code: the record that breaks it (all its other broken rules are told where they follow from the same change).
BROKEN = {
    "unknown_claim_id": (claim(claim_id="K9"), []), "unknown_item_id": (claim(claim_id="K4"), []), "unknown_doc_id": (claim(provenance__doc_id="D9"), []),
    "event_family_link": (claim(event_family_id="F2"), []), "source_revision": (claim(provenance__revision_id="r2"), ["evidence_source_revision"]), "source_hash": (claim(provenance__source_sha256="zz"), ["packet_linkage"]),
    "company_id": (claim(normalized__company_id="C2"), []), "scope_source_mismatch": (segment(normalized__scope_id="C1-SEG-B"), []), "definition_version": (segment(normalized__definition_version="seg-fy2023"), []),
    "false_human_gold": (claim(human_gold=True), []), "exposure_change": (claim(exposure_status="test"), []), "guide_version_alignment": (claim(guide_version=None), []), "false_human_assessment": (claim(assessment__author_kind="human"), []),
    "evidence_overclaim": (claim(normalized__evidence_status="audited"), []), "source_evidence_status_preservation": (relation(raw__source_evidence_status="reported"), []), "period_derivation_preservation": (claim(raw__source_period_start_derivation=None), []),
    "source_extractor_versions": (claim(provenance__source_schema_version="s2"), []), "missing_reason_paths": (claim(normalized__field_missing_reasons={"temporal.published_at": "not_disclosed", "published_at": "x"}), []),
    "full_date_audit_not_claimed": (claim(**{T + "date_conflict_status": "none"}), []), "date_only_precision": (claim(**{T + "timezone": "UTC"}), []), "observation_date": (claim(**{T + "observed_at": None}), []),
    "unknown_evidence_id": (claim(provenance__evidence__1__evidence_id="H9"), ["header_ref_resolution", "packet_linkage"]), "evidence_index_mismatch": (claim(provenance__evidence__0__header_refs=["H1", "H2", "H3", "H3"]), []),
    "evidence_source_revision": (claim(provenance__evidence__2__revision_id="r0"), ["evidence_index_mismatch"]), "source_xpath": (claim(provenance__evidence__0__location="/x/twice"), ["evidence_index_mismatch"]),
    "source_span_roundtrip": (claim(provenance__evidence__3__end=99), ["evidence_index_mismatch"]), "header_ref_resolution": (claim(provenance__evidence__0__header_refs=["H1", "H2", "H3", "H8"]), ["evidence_index_mismatch"]),
    "packet_linkage": (claim(provenance__evidence=[*claim()["provenance"]["evidence"][:4], claim()["provenance"]["evidence"][0]]), ["header_ref_resolution", "numeric_header_binding"]),
    "scope_dependency_missing": (claim(normalized__availability_dependencies=[]), []), "unknown_dependency": (claim(normalized__availability_dependencies__0__record_id="D7"), []),
    "scope_dependency_time": (claim(normalized__availability_dependencies__0__published_date="2024-08-02"), []), "future_scope_in_assessment": (claim(assessment__as_of="2024-08-01T00:00:00"), []),
    "unexpected_scope_dependency": (segment(normalized__availability_dependencies=claim()["normalized"]["availability_dependencies"]), []), "period_header_mapping": (claim(**{T + "reference_period__fiscal_quarter": 3}), []),
    "relation_direction_roles": (relation(normalized__subject_role="customer"), []), "relation_entity_refs": (relation(normalized__object_entity_id="C9"), ["relation_direction_roles"]),
    "report_period_not_effective_period": (relation(normalized__valid_from="2024-01-01"), []), "relation_source_sidecar": (relation(raw__source_effective_period="2024"), []),
    "unknown_metric_id": (claim(normalized__metric_id="other"), ["metric_source_mismatch"]), "metric_source_mismatch": (spending(claim_id="K1"), []), "consolidation_scope": (segment(normalized__consolidation="consolidated"), []),
    "unit_scale": (claim(normalized__currency="EUR"), []), "raw_value_preserved": (claim(raw__value_raw="(1,250)"), []), "source_numeric_sign": (claim(normalized__source_numeric_value="1250"), []),
    "value_scaling_sign": (spending(normalized__numeric_value="-1250000000", derived=[{"output": "-1250000000", "reviewed_by": None}]), []), "sign_policy": (spending(normalized__sign_policy="preserve"), []),
    "balance_duration": (claim(normalized__financial_context__period_duration=90), []), "numeric_header_binding": (claim(provenance__evidence__0__header_refs=HEADERS[:3]), ["evidence_index_mismatch"]),
    "derived_lineage": (claim(derived=[]), []),
}


def test_every_contract_rule(spark, tables):
    good = [claim(), segment(), spending(), relation(), claim()]
    cases = [*good, *[r for r, _ in BROKEN.values()]]
    full = lambda r: {"relation_id": None, "raw": {}, **r}
    df = spark.createDataFrame([full(r) for r in cases], RECORD).withColumn("place", F.monotonically_increasing_id())
    got = [r.errors for r in contract_errors(df.coalesce(1), tables, TERMS).orderBy("place").select("errors").collect()]
    assert got[: len(good)] == [[]] * len(good)
    for (code, (_, more)), errors in zip(BROKEN.items(), got[len(good) :], strict=True):
        assert errors == sorted([code, *more]), code


def test_headers_of_packets(spark, tables):
    """Two years in a header, an instant, a whole year: the period follows the packet's headers."""
    change = lambda **k: tables | {"packets": tables["packets"].withColumn("raw", F.struct(*[(F.lit(k[c]) if c in k else F.col(f"raw.{c}")).alias(c) for c in ("period_header", "year_header", "value_cell")]))}
    errors = lambda r, t: contract_errors(spark.createDataFrame([{"relation_id": None, **r}], RECORD), t, TERMS).first().errors
    assert errors(claim(), change(year_header="2023 2024")) == ["period_header_mapping", "year_header_ambiguous"]
    assert errors(claim(), change(value_cell="1,250")) == ["packet_original_cell"]
    instant = {"as_of_date": "2024-06-30", "period_basis": "fiscal", "period_kind": "instant", "fiscal_year": 2024}
    assert errors(claim(**{T + "reference_period": instant, N + "financial_context__period_duration": None}), change(period_header="June 30,")) == []
    year = {"period_start": "2023-07-01", "period_end": "2024-06-30", "period_basis": "fiscal", "period_kind": "annual", "fiscal_year": 2024, "duration_days": 366}
    assert errors(claim(**{T + "reference_period": year, N + "financial_context__period_duration": 366}), change(period_header="Twelve Months Ended")) == []


def test_codes_have_cases():
    assert {r.code for r in contract_book(TERMS).rules} - set(BROKEN) == {"year_header_ambiguous", "packet_original_cell"}


def test_compiler(spark):
    """Only lookups in use are joined, once; rules from a table do the same; unknown is broken; stops and repeats."""
    records = spark.createDataFrame([(1, 5, ["a", "b"]), (1, 5, ["a", "b"]), (2, None, ["z"]), (3, 7, []), (None, 5, None)], "id long, v long, parts array<string>")
    tables = {"t": spark.createDataFrame([(1, "x"), (1, "w"), (3, "y")], "k long, name string"), "u": spark.createDataFrame([("a", 1), ("b", 2)], "p string, q long")}
    rules = [Rule("no_row", "t.n is not null", stops=True), Rule("name", "t.name = 'w'"), Rule("small", "v > {low}"), Rule("part", "u.q > 0", part="p"), Rule("sum", "aggregate(qs, 0L, (a, x) -> a + x) = 3", "size(parts) > 0")]
    book = Rulebook(rules, [Lookup("t", "t", {"k": "id"}), Lookup("never", "missing", {"k": "id"}), Lookup("u", "u", {"p": "p"}, "p")], {"low": "5 + {one}", "one": "1"}, [Elements("p", "parts", {"qs": "u.q"})])
    got = book.check(records, tables)
    assert got.columns == ["id", "v", "parts", "errors"]
    assert sorted([(r.id or 0, r.errors) for r in got.collect()]) == [(0, ["no_row"]), (1, ["small"]), (1, ["small"]), (2, ["no_row"]), (3, ["name"])]
    again = book.with_rules(book.table(spark))
    assert again == book
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "missing" not in plan and plan.count("LocalRelation") + plan.count("LogicalRDD") <= 4
    assert book.check(records.limit(0), tables).collect() == []


def test_records_that_come_in_another_order(spark):
    """An array that is put together anew each time it is computed, as collected rows are, loses no rule of its elements."""
    mixed = F.udf(lambda x: random.sample(x, len(x)), "array<int>").asNondeterministic()
    rows = spark.createDataFrame([(i, list(range(12))) for i in range(40)], "k int, a array<int>").select("k", mixed("a").alias("a"))
    found = Rulebook([Rule("big", "e < 11", part="e"), Rule("few", "size(a) > 20")], elements=[Elements("e", "a")]).check(rows, {}).collect()
    assert len(found) == 40 and all(x.errors == ["big", "few"] for x in found)


def test_records_are_not_shuffled_for_their_elements(spark):
    """What a rule over the record reads stays where it is: before, it was shuffled to meet what the elements had given."""
    rows = spark.range(3000).select("id", F.concat_ws("", *[F.sha2(F.concat("id", F.lit(f"-{i}")), 512) for i in range(16)]).alias("note"), F.expr("sequence(1, 5)").alias("parts"))
    book = Rulebook([Rule("short", "length(note) > 3000"), Rule("odd", "u.q > 0", part="p")], [Lookup("u", "u", {"p": "p"}, "p")], {}, [Elements("p", "parts")])
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before, limit = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with larger tables
    try:
        got = book.check(rows, {"u": spark.range(4).select(F.col("id").alias("p"), F.lit(1).alias("q"))}, keep=["id"]).where("size(errors) = 2").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == 3000 and written() - before < 2_000_000  # 6 MB of notes


def test_many_rules_and_stops_over_elements(spark):
    """More rules than bits of one number; a stop waits for its lookup, and rules after it wait too."""
    many = [Rule(f"r{i:03}", f"p <> {i}", part="p") for i in range(130)]
    stop = [Rule("unknown", "u.n is not null", part="p", stops=True), Rule("last", "p < 0", part="p"), Rule("q", "u.q = 1", part="p")]
    rows = spark.createDataFrame([(1, [0, 59, 60, 129]), (2, [200]), (3, [7, 7])], "id int, parts array<int>")
    tables = {"u": spark.createDataFrame([(0, 1), (7, 2)], "p int, q int")}
    book = Rulebook([*many, *stop], [Lookup("u", "u", {"p": "p"}, "p")], {}, [Elements("p", "parts")])
    got = {r.id: r.errors for r in book.check(rows, tables).collect()}
    assert got == {1: ["last", "r000", "r059", "r060", "r129", "unknown"], 2: ["unknown"], 3: ["last", "q", "r007"]}
