"""Rule extraction: located cells and their headers become numeric claims or relations, or abstain with the first reason.

Rules are small dimension tables held as literals: every input gives exactly one result row, and a claim if it is predicted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, periods, text
from ..functions.ids import stable_id
from ..functions.reasons import codes, first


@dataclass
class Rules:
    company_id: str
    company_name: str
    company_scope_id: str
    #: label -> (metric_id, balance_or_flow, statement_type, sign_policy)
    metrics: dict[str, tuple[str, str, str, str]]
    #: label -> scope_id
    segments: dict[str, str]
    #: unit header -> multiplier text
    units: dict[str, str]
    #: doc_id -> (revision_id, source_sha256, published_date, observed_at, segment_definition or None)
    documents: dict[str, tuple[str, str, str, str, str | None]] = field(default_factory=dict)
    currency: str = "USD"
    accounting_basis: str = "GAAP"


def _lookup(table: dict, key: Column, names: list[str]) -> Column:
    kind = "struct<" + ",".join(f"{n}:string" for n in names) + ">"
    if not table:
        return F.lit(None).cast(kind)
    rows = [x for k, v in table.items() for x in (F.lit(k), F.struct(*[F.lit(a).cast("string").alias(n) for n, a in zip(names, v if isinstance(v, tuple) else (v,), strict=True)]))]
    return F.element_at(F.create_map(*rows), key)


def input_errors(c) -> Column:
    """Structural faults of an input, before any rule is tried."""
    return F.array_sort(codes(
        (F.col("input_id").isNull(), "input_id_missing"), (F.col("doc_id").isNull() | F.col("revision_id").isNull(), "document_identity_missing"),
        (~F.coalesce(F.col("input_kind").isin("numeric_cell", "relation_context"), F.lit(False)), "input_kind_unknown"),
        (F.coalesce(F.size("evidence_refs"), F.lit(0)) <= 0, "evidence_missing"), (F.size(F.array_distinct("evidence_refs")) < F.size("evidence_refs"), "evidence_repeated"),
        ((F.col("input_kind") == "numeric_cell") & F.col("value_cell").isNull(), "value_cell_missing"), ((F.col("input_kind") == "relation_context") & F.col("value_cell").isNotNull(), "relation_with_value"),
        (F.col("row_label").isNull(), "row_label_missing"),
    ))


def extract(inputs: DataFrame, rules: Rules, run_id: str) -> DataFrame:
    """One row per input: status (predicted, abstained, quarantined), failure_stage, reasons, and the claim's fields."""
    d = inputs.withColumn("_errors", input_errors(inputs)).withColumn("_label", text.compact(F.col("row_label")))
    d = d.withColumn("_doc", _lookup(rules.documents, F.col("doc_id"), ["revision_id", "source_sha256", "published_date", "observed_at", "segment_definition"]))
    d = d.withColumn("_metric", _lookup(rules.metrics, F.col("_label"), ["metric_id", "balance_or_flow", "statement_type", "sign_policy"]))
    d = d.withColumn("_segment", _lookup(rules.segments, F.col("_label"), ["scope_id"])).withColumn("_unit", _lookup(rules.units, F.trim("unit_header"), ["multiplier"]))
    d = d.withColumn("_period", periods.parse_period(F.col("period_header"), F.col("year_header"))).withColumn("_number", numbers.parse_number(F.col("value_cell")))
    segment, relation = F.col("table_purpose") == "segment_revenue", F.col("input_kind") == "relation_context"
    flow = F.when(segment, F.lit("flow")).otherwise(F.col("_metric.balance_or_flow"))
    policy = F.when(segment, F.lit("preserve")).otherwise(F.col("_metric.sign_policy"))
    d = d.withColumn("_signed", numbers.signed_by_policy(F.col("_number.value"), policy))
    no = lambda c: F.coalesce(~c, F.lit(True))
    fault = first((F.size("_errors") > 0, "input_contract"), (F.col("_doc").isNotNull() & (no(F.col("revision_id") == F.col("_doc.revision_id")) | no(F.col("source_sha256") == F.col("_doc.source_sha256"))), "source_identity"), (F.col("_doc").isNotNull() & (no(F.col("published_date") == F.col("_doc.published_date")) | no(F.col("observed_at") == F.col("_doc.observed_at"))), "publication"))
    kind = F.col("_period.period_kind")
    reason = first(
        (F.col("_doc").isNull(), "document_not_allowlisted"), (no((F.col("company_id") == rules.company_id) & (F.col("company_name") == rules.company_name)), "company_context_mismatch"),
        (segment & (F.col("_segment").isNull() | no(F.col("scope_label") == F.col("_label"))), "ambiguous_segment_alias_or_scope"), (segment & F.col("_doc.segment_definition").isNull(), "missing_presentation_definition"),
        (no(segment) & relation, "relation_requires_segment_reporting_table"), (no(segment) & no(F.col("scope_label") == "company financial statement total"), "ambiguous_company_scope"),
        (no(segment) & F.col("_metric").isNull(), "unknown_or_ambiguous_metric_alias"), (F.col("_period.error").isNotNull(), F.col("_period.error")),
        ((kind == "instant") != (flow == "balance"), "balance_flow_period_conflict"), (segment & (kind != "annual"), "unsupported_segment_table_period"),
        (no(F.col("source_qualifier") == F.when(relation, "company_reported_table").otherwise("company_reported_unaudited")), "unsupported_source_qualifier"),
        (~relation & no((F.col("currency") == rules.currency) & (F.col("accounting_basis") == rules.accounting_basis)), "unsupported_currency_or_accounting"),
        (~relation & F.col("_unit").isNull(), "missing_or_unsupported_unit"), (~relation & F.col("_number.error").isNotNull(), F.col("_number.error")), (~relation & F.col("_signed.error").isNotNull(), F.col("_signed.error")),
    )
    d = d.withColumn("failure_stage", fault).withColumn("_reason", F.when(fault.isNull(), reason))
    status = F.when(F.col("failure_stage").isNotNull(), "quarantined").when(F.col("_reason").isNotNull(), "abstained").otherwise("predicted")
    d = d.withColumn("status", status)
    good = lambda c: F.when(F.col("status") == "predicted", c)
    numeric = lambda c: good(F.when(~relation, c))
    related = lambda c: good(F.when(relation, c))
    scale = F.col("_unit.multiplier").try_cast("decimal(20,6)")
    reasons = F.when(F.col("failure_stage") == "input_contract", F.col("_errors")).when(F.col("failure_stage") == "source_identity", F.array(F.lit("revision_or_hash_mismatch"))).when(F.col("failure_stage") == "publication", F.array(F.lit("publication_metadata_mismatch"))).otherwise(F.array_compact(F.array("_reason")))
    return d.select(
        "input_id", F.lit(run_id).alias("run_id"), "status", "failure_stage", reasons.alias("reasons"),
        good(stable_id("PRED", F.lit(run_id), F.col("input_id"), F.col("input_kind"))).alias("prediction_id"), good(F.when(relation, "reporting_relation").otherwise("numeric_claim")).alias("record_kind"),
        "doc_id", "revision_id", good(F.col("company_id")).alias("company_id"), good(F.when(segment, F.col("_segment.scope_id")).otherwise(F.lit(rules.company_scope_id))).alias("scope_id"),
        numeric(F.when(segment, "revenue").otherwise(F.col("_metric.metric_id"))).alias("metric_id"), numeric(flow).alias("balance_or_flow"),
        numeric(numbers.decimal_text(F.col("_signed.value") * scale)).alias("numeric_value"), numeric(numbers.decimal_text(F.col("_number.value"))).alias("source_numeric_value"), numeric(F.col("_unit.multiplier")).alias("source_scale"), numeric(F.lit("1")).alias("scale"),
        numeric(F.col("currency")).alias("currency"), related(F.lit("reports_segment")).alias("relation_type"), related(F.lit(rules.company_id)).alias("subject_entity_id"), related(F.col("_segment.scope_id")).alias("object_entity_id"),
        good(F.col("_period")).alias("reference_period"), good(F.when(segment, "reported_segment_in_selected_table").otherwise("unresolved_retrospective_dependency")).alias("scope_status_as_of"), "evidence_refs",
    )


def batch_checks(results: DataFrame, inputs: DataFrame) -> DataFrame:
    """One row of booleans: every input has one terminal row, only predicted ones have a claim, the rest a reason."""
    n = results.groupBy("input_id").agg(F.count(F.lit(1)).alias("n"))
    j = inputs.select("input_id").distinct().withColumn("_in", F.lit(True)).join(n, "input_id", "full_outer")
    conserved = j.agg(F.bool_and(F.col("_in").isNotNull() & F.coalesce(F.col("n") == 1, F.lit(False))).alias("one_terminal_row_per_input"))
    own = results.agg(F.bool_and((F.col("status") == "predicted") == F.col("prediction_id").isNotNull()).alias("claims_only_if_predicted"), F.bool_and((F.col("status") == "predicted") == (F.size("reasons") == 0)).alias("reasons_if_not_predicted"), (F.count("prediction_id") == F.count_distinct("prediction_id")).alias("prediction_ids_unique"))
    return own.join(F.broadcast(conserved), F.lit(True))


def prediction_errors(predictions: DataFrame, inputs: DataFrame, rules: Rules) -> DataFrame:
    """Adds ``errors`` to claims (the layout of ``extract``): every value is derived again from the claim's input, one an
    input_id, and held against what the claim says. Codes are fixed values."""
    j = predictions.join(inputs.select("input_id", F.struct(*inputs.columns).alias("_in")), "input_id", "left")
    i = F.col("_in")
    relation, segment, label = i["input_kind"] == "relation_context", F.coalesce(i["table_purpose"] == "segment_revenue", F.lit(False)), text.compact(i["row_label"])
    j = j.withColumn("_metric", _lookup(rules.metrics, label, ["metric_id", "balance_or_flow", "statement_type", "sign_policy"])).withColumn("_unit", _lookup(rules.units, F.trim(i["unit_header"]), ["multiplier"])["multiplier"])
    j = j.withColumn("_scope", F.when(segment, _lookup(rules.segments, label, ["scope_id"])["scope_id"]).otherwise(F.lit(rules.company_scope_id)))
    j = j.withColumn("_period", periods.parse_period(i["period_header"], i["year_header"])).withColumn("_number", numbers.parse_number(i["value_cell"]))
    policy = F.when(segment, "preserve").otherwise(F.col("_metric.sign_policy"))
    signed = numbers.signed_by_policy(F.col("_number.value"), policy)["value"] * F.col("_unit").try_cast("decimal(20,6)")
    differs = lambda a, b: ~a.eqNullSafe(b)
    numeric = ~F.coalesce(relation, F.lit(False))
    p = lambda f: F.col("reference_period")[f]
    spans = [p(f.name).eqNullSafe(F.col("_period")[f.name]) for f in predictions.schema["reference_period"].dataType.fields if f.name != "error"]
    same_period = F.forall(F.array(*spans), lambda x: x)
    found = codes(
        (differs(F.col("status"), F.lit("predicted")), "candidate_not_predicted"), (differs(F.col("record_kind"), F.when(relation, "reporting_relation").otherwise("numeric_claim")), "record_kind"),
        (differs(F.col("doc_id"), i["doc_id"]) | differs(F.col("revision_id"), i["revision_id"]), "prediction_source_identity"), (differs(F.col("evidence_refs"), i["evidence_refs"]), "prediction_evidence_refs"),
        (differs(F.col("company_id"), F.lit(rules.company_id)), "company_id"), (differs(F.col("scope_id"), F.col("_scope")), "scope_mapping"),
        (differs(F.col("scope_status_as_of"), F.when(segment, "reported_segment_in_selected_table").otherwise("unresolved_retrospective_dependency")), "scope_cutoff_status"), (~same_period, "reporting_period"),
        (relation & (differs(F.col("relation_type"), F.lit("reports_segment")) | differs(F.col("subject_entity_id"), F.lit(rules.company_id)) | differs(F.col("object_entity_id"), F.col("_scope"))), "relation_endpoints"),
        (relation & (F.col("numeric_value").isNotNull() | F.col("metric_id").isNotNull()), "relation_not_numeric_claim"),
        (numeric & (differs(F.col("metric_id"), F.when(segment, "revenue").otherwise(F.col("_metric.metric_id"))) | differs(F.col("balance_or_flow"), F.when(segment, "flow").otherwise(F.col("_metric.balance_or_flow")))), "metric_rules"),
        (numeric & differs(F.col("numeric_value").try_cast("decimal(38,6)"), signed.cast("decimal(38,6)")), "numeric_value"), (numeric & (differs(F.col("scale"), F.lit("1")) | differs(F.col("source_scale"), F.col("_unit"))), "unit_scale"),
        (numeric & differs(F.col("source_numeric_value").try_cast("decimal(38,6)"), F.col("_number.value").cast("decimal(38,6)")), "source_sign"), (numeric & differs(F.col("currency"), F.lit(rules.currency)), "currency_accounting"),
        (F.col("prediction_id").isNull(), "candidate_identity_kind"),
    )
    return j.withColumn("errors", F.when(i.isNull(), F.array(F.lit("unknown_input_id"))).otherwise(found)).select(*predictions.columns, "errors")
