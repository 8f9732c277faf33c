"""Projections of contracts, annotations and predictions to comparable fields, and inputs without answers."""

import pytest
from pyspark.sql import functions as F

from priorlens.operators import agreement, projections

PERIOD = "struct<period_start:string,period_end:string,as_of_date:string,period_kind:string,duration_days:int,fiscal_year:int,fiscal_quarter:int>"
NORMALIZED = f"""struct<company_id:string,scope_id:string,modality:string,metric_id:string,definition_version:string,source_scale:string,numeric_value:string,currency:string,canonical_unit:string,sign_policy:string,accounting_basis:string,financial_context:struct<balance_or_flow:string>,
 temporal:struct<published_date:string,published_at:string,time_precision:string,reference_period:{PERIOD},effective_period:struct<period_start:string,period_end:string>>,subject_entity_id:string,object_entity_id:string,subject_role:string,object_role:string,relation_type:string,direction:string,negation:string>"""
SCHEMA = f"""claim_id string, relation_id string, record_kind string, event_id string, event_family_id string, raw struct<value_raw:string,source_evidence_status:string,source_period_start_derivation:string,source_qualifier:string,value_span_start:int,value_span_end:int>,
 normalized {NORMALIZED.replace(chr(10), "")}, provenance struct<doc_id:string,revision_id:string,evidence:array<struct<evidence_id:string,start:int,end:int>>>"""


def record(i, kind="event_claim", value="1250000000", scale="1000000", period_kind="quarter", quarter=4, scope="ALL", evidence=("H", "V", "V2")):
    return {
        "claim_id": i, "relation_id": f"R{i}" if kind == "business_relation" else None, "record_kind": kind, "event_id": "E", "event_family_id": "F", "raw": {"value_raw": "1,250", "source_evidence_status": "reported", "source_qualifier": "q", "value_span_start": 3, "value_span_end": 8},
        "normalized": {
            "company_id": "C", "scope_id": scope, "modality": "actual", "metric_id": "revenue", "definition_version": "1", "source_scale": scale, "numeric_value": value, "currency": "USD", "canonical_unit": "USD", "sign_policy": "preserve", "accounting_basis": "GAAP",
            "financial_context": {"balance_or_flow": "flow"}, "temporal": {"published_date": "2024-07-30", "published_at": "x", "time_precision": "minute", "reference_period": {"period_start": "2024-04-01", "period_end": "2024-06-30", "period_kind": period_kind, "duration_days": 91, "fiscal_year": 2024, "fiscal_quarter": quarter}, "effective_period": {"period_start": "2020-01-01"}},
            "subject_entity_id": "C", "object_entity_id": "D", "relation_type": "supplies_to", "direction": "subject_to_object", "negation": "no",
        },
        "provenance": {"doc_id": "D1", "revision_id": "r", "evidence": [{"evidence_id": e, "start": k, "end": k + 5} for k, e in enumerate(evidence)]},
    }


def test_contract_to_reference(spark):
    rows = [record("a"), record("b", value="-1234567.8", scale="1000", period_kind="annual", quarter=None), record("c", period_kind="instant", scope="SEG"), record("d", kind="business_relation"), record("e", value="many"), record("f", evidence=("H",)), record("g", scale="0")]
    evidence = spark.createDataFrame([("V", "numeric_value"), ("V2", "numeric_value"), ("H", "header"), ("V", "numeric_value")], "evidence_id string, evidence_kind string")
    a = projections.annotations(spark.createDataFrame(rows, SCHEMA), evidence, "ALL")
    got = {x.source_claim_id: x for x in a.collect()}
    assert (got["a"].numeric_value, got["a"].numeric_value_base_units, got["a"].scale, got["a"].period_kind, got["a"].value_span_start, got["a"].value_span_end) == ("1250", "1250000000", "1000000", "duration", 1, 6)
    assert (got["b"].numeric_value, got["c"].scope_status_as_of, got["c"].period_kind, got["f"].value_span_start) == ("-1234.5678", "reported_segment_in_selected_table", "instant", None)
    assert got["a"].published_at is None and got["a"].time_precision == "date" and got["a"].relation_type is None and got["a"].scope_status_as_of == "unresolved_retrospective_dependency"
    d = got["d"]
    assert (d.record_kind, d.source_relation_id, d.numeric_value, d.metric_id, d.relation_type, d.reference_period_end, d.effective_period_start) == ("reporting_relation", "Rd", None, None, "supplies_to", "2024-06-30", None)
    r = {x.source_claim_id: x for x in projections.reference_fields(a, ["source_claim_id"]).collect()}
    assert {k: x.error for k, x in r.items()} == {k: "base_scale_mismatch" if k in "eg" else None for k in "abcdefg"}
    assert [(r[k].numeric_value, r[k].scale, r[k].source_scale, r[k].period_kind) for k in "abcd"] == [("1250000000", "1", "1000000", "quarter"), ("-1234567.8", "1", "1000", "annual"), ("1250000000", "1", "1000000", "instant"), (None, None, None, None)]
    assert r["a"].source_qualifier == "reported" and r["d"].object_entity_id == "D" and r["a"].object_entity_id is None
    wrong = projections.reference_fields(a.withColumn("numeric_value_base_units", F.lit("1")), ["source_claim_id"])
    assert wrong.where("error is null").count() == 1  # the relation


def test_prediction_fields(spark):
    rows = spark.createDataFrame([record("a"), record("d", kind="business_relation")], SCHEMA).withColumn("record_kind", F.replace("record_kind", F.lit("business_relation"), F.lit("reporting_relation")))
    got = {x.claim_id: x for x in projections.prediction_fields(rows, ["claim_id"]).collect()}
    a, d = got["a"], got["d"]
    assert (a.published_at, a.time_precision, a.source_qualifier, a.period_kind, a.fiscal_year, a.value_span_start, a.balance_or_flow, a.reference_period_end) == ("x", "minute", "q", "quarter", 2024, 3, None, None)
    assert (d.reference_period_start, d.effective_period_start, d.effective_period_end, d.relation_type, d.metric_id) == ("2024-04-01", "2020-01-01", None, "supplies_to", None)
    assert set(rows.columns) >= {"raw"} and set(got["a"].asDict()) == {"claim_id", "record_kind", *projections.COMMON, *projections.CLAIM, *projections.RELATION}


def test_inputs_without_answers(spark):
    packets = spark.createDataFrame([("K1", "R1", "1,250", "Revenue"), ("K2", None, "7", "see K2 here"), ("K3", None, "K3", "plain"), ("K4", None, None, None)], "source_claim_id string, source_relation_id string, value_cell string, row_label string")
    inputs, links = projections.blind_inputs(packets, ["value_cell", "row_label"], ["source_claim_id", "source_relation_id"])
    assert inputs.columns == ["input_id", "value_cell", "row_label"] and inputs.join(links, "input_id").count() == 4
    assert not any(k in str(x) for x in inputs.select("input_id").collect() for k in ("K1", "K2"))
    bad = links.where("source_claim_id = 'K3'").first().input_id
    assert [(x.input_id, x.reasons) for x in projections.leaks(inputs, links, ["metric_id", "source_claim_id"]).collect()] == [(bad, ["value:source_claim_id"])]
    named = inputs.withColumn("more", F.struct(F.struct(F.lit(1).alias("metric_id")).alias("deep")))
    assert projections.leaks(named, links, ["metric_id"]).where(F.array_contains("reasons", "field:metric_id")).count() == 4


def test_references_are_made_once(spark):
    refs = spark.range(50).selectExpr("id as item_id", "if(id = 7, null, concat('k', id)) as location_key", "'x' as f")
    preds = spark.createDataFrame([("p1", "k1", "x"), ("p2", "k2", "x"), ("p3", "k2", "x")], "prediction_id string, location_key string, f string")
    out, _ = agreement.matched(refs, preds, ["f"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    got = {r.item_id: r.match_status for r in out.collect()}
    assert len(got) == 49 and got[1] == "matched" and got[2] == "tie_conflict" and got[3] == "missing"
    with pytest.raises(Exception, match="duplicate reference"):
        agreement.matched(refs.unionByName(refs), preds, ["f"])[0].collect()
