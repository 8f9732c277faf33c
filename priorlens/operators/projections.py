"""Records made comparable: from contracts to annotations, from annotations to reference fields, from predictions to the same
fields, and inputs without answers. Mappings are data: a target column and a Spark SQL expression over the record.

Fields of the other kind of record are null. Amounts are decimal texts; nothing is rounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.numbers import decimal_text

# Columns that projections have in common, and those of claims and relations.
COMMON = ["company_id", "scope_id", "modality", "published_date", "published_at", "time_precision", "scope_status_as_of", "source_qualifier"]
CLAIM = ["metric_id", "definition_version", "currency", "canonical_unit", "sign_policy", "balance_or_flow", "accounting_basis", "period_start", "period_end", "as_of_date", "duration_days", "fiscal_year", "fiscal_quarter", "value_span_start", "value_span_end", "numeric_value", "source_scale", "scale", "period_kind"]
RELATION = ["relation_type", "subject_entity_id", "object_entity_id", "subject_role", "object_role", "direction", "negation", "reference_period_start", "reference_period_end", "effective_period_start", "effective_period_end", "valid_from", "valid_to"]

_N, _T = "normalized", "normalized.temporal"
_P = f"{_T}.reference_period"

#: Contract record -> annotation.
ANNOTATION = {
    "source_claim_id": "claim_id", "doc_id": "provenance.doc_id", "revision_id": "provenance.revision_id", "event_id": "event_id", "event_family_id": "event_family_id", "record_kind": "if({relation}, 'reporting_relation', 'event_claim')",
    "company_id": f"{_N}.company_id", "scope_id": f"{_N}.scope_id", "modality": f"{_N}.modality", "published_date": f"{_T}.published_date", "published_at": "cast(null as string)", "time_precision": "'date'", "evidence_status": "raw.source_evidence_status",
    "scope_status_as_of": "if({consolidated}, 'unresolved_retrospective_dependency', 'reported_segment_in_selected_table')",
}
ANNOTATION_CLAIM = {
    "metric_id": f"{_N}.metric_id", "definition_version": f"{_N}.definition_version", "value_raw": "raw.value_raw", "scale": f"{_N}.source_scale", "numeric_value_base_units": f"{_N}.numeric_value", "currency": f"{_N}.currency", "canonical_unit": f"{_N}.canonical_unit",
    "sign_policy": f"{_N}.sign_policy", "period_start": f"{_P}.period_start", "period_end": f"{_P}.period_end", "as_of_date": f"{_P}.as_of_date", "period_kind": f"if({_P}.period_kind = 'instant', 'instant', 'duration')", "duration_days": f"{_P}.duration_days",
    "fiscal_year": f"{_P}.fiscal_year", "fiscal_quarter": f"{_P}.fiscal_quarter", "balance_or_flow": f"{_N}.financial_context.balance_or_flow", "value_span_start": "_value.start", "value_span_end": "_value.end", "accounting_basis": f"{_N}.accounting_basis",
    "period_start_derivation": "raw.source_period_start_derivation",
}
ANNOTATION_RELATION = {
    "source_relation_id": "relation_id", "relation_type": f"{_N}.relation_type", "subject_entity_id": f"{_N}.subject_entity_id", "object_entity_id": f"{_N}.object_entity_id", "subject_role": f"{_N}.subject_role", "object_role": f"{_N}.object_role",
    "direction": f"{_N}.direction", "negation": f"{_N}.negation", "reference_period_start": f"{_P}.period_start", "reference_period_end": f"{_P}.period_end",
    **{k: "cast(null as string)" for k in ("effective_period_start", "effective_period_end", "valid_from", "valid_to")},
}


def _quotient(value: str, by: str):
    """Decimal text over a power-of-ten scale, exact to 12 places; null if a side is no number or the scale is 0."""
    return decimal_text(F.try_divide(F.col(value).try_cast("decimal(26,6)"), F.col(by).try_cast("decimal(12,0)")).cast("decimal(38,12)"))


def annotations(records: DataFrame, evidence: DataFrame, consolidated_scope: str) -> DataFrame:
    """Contract records (see ``contracts``) as flat annotations. evidence: evidence_id, evidence_kind: the first evidence of a
    claim that the index has as ``numeric_value`` gives the value's span; a claim without one has none. Only ids and kinds of
    numeric evidence are joined. The span is the same for all records with the same list of evidence, so that is their key."""
    numeric = evidence.where("evidence_kind = 'numeric_value'").select(F.col("evidence_id").alias("_e")).distinct()
    each = records.select(F.col("provenance.evidence").alias("_key")).select("_key", F.posexplode("_key").alias("_at", "e")).select("_key", "_at", F.col("e.evidence_id").alias("_e"), F.struct("e.start", "e.end").alias("_span"))
    value = each.join(numeric, "_e", "left_semi").groupBy("_key").agg(F.min_by("_span", "_at").alias("_value"))
    r = records.withColumn("_key", F.col("provenance.evidence")).join(value, "_key", "left")
    put = {"{relation}": "record_kind = 'business_relation'", "{consolidated}": f"{_N}.scope_id = '{consolidated_scope}'"}

    def column(x: str, when: str | None = None):
        for k, v in put.items():
            x = x.replace(k, f"({v})")
        return F.expr(x) if when is None else F.when(F.expr(when), F.expr(x))

    claim, relation = "record_kind <> 'business_relation'", "record_kind = 'business_relation'"
    out = r.select(
        *[column(x).alias(k) for k, x in ANNOTATION.items()], *[column(x, claim).alias(k) for k, x in ANNOTATION_CLAIM.items()], *[column(x, relation).alias(k) for k, x in ANNOTATION_RELATION.items()],
        F.transform("provenance.evidence", lambda e: e["evidence_id"]).alias("evidence_refs"),
    )
    return out.withColumn("numeric_value", F.when(F.col("record_kind") == "event_claim", _quotient("numeric_value_base_units", "scale")))


def reference_fields(annotated: DataFrame, keep: list[str] = ()) -> DataFrame:
    """keep, record_kind, the fields of references, and ``error``: base_scale_mismatch if value x scale isn't the base amount
    (of a claim; also if one is missing). Amounts are in base units, scale 1, with the source's scale beside it."""
    claim = F.col("record_kind") == "event_claim"
    base = F.col("numeric_value").try_cast("decimal(26,12)") * F.col("scale").try_cast("decimal(11,0)")
    wrong = claim & ~F.coalesce(base == F.col("numeric_value_base_units").try_cast("decimal(38,12)"), F.lit(False))
    kind = F.when(F.col("period_kind") == "instant", "instant").when(F.coalesce(F.col("fiscal_quarter"), F.lit(0)) != 0, "quarter").otherwise("annual")
    made = {"source_qualifier": F.col("evidence_status"), "numeric_value": F.when(claim, decimal_text(base)), "source_scale": F.when(claim, F.col("scale")), "scale": F.when(claim, F.lit("1")), "period_kind": F.when(claim, kind)}
    own = lambda k, wanted: made[k] if k in made else F.when(wanted, F.col(k)) if wanted is not None else F.col(k)
    columns = [*[own(k, None).alias(k) for k in COMMON], *[own(k, claim).alias(k) for k in CLAIM], *[own(k, ~claim).alias(k) for k in RELATION]]
    return annotated.select(*keep, "record_kind", *columns, F.when(wrong, "base_scale_mismatch").alias("error"))


def prediction_fields(predictions: DataFrame, keep: list[str] = ()) -> DataFrame:
    """keep, record_kind and the same fields from layered predictions (raw, normalized with temporal and its periods); a field
    that a prediction's schema doesn't have is null."""
    n = {f.name: f.dataType for f in predictions.schema["normalized"].dataType.fields}
    inner = lambda kind, k: k in kind.fieldNames()
    temporal = n["temporal"]
    period = temporal["reference_period"].dataType if inner(temporal, "reference_period") else None
    effective = temporal["effective_period"].dataType if inner(temporal, "effective_period") else None
    raw = predictions.schema["raw"].dataType
    claim = F.col("record_kind") != "reporting_relation"
    none = F.lit(None).cast("string")

    def find(k: str):
        if k in ("published_date", "published_at", "time_precision"):
            return F.col(f"{_T}.{k}") if inner(temporal, k) else none
        if k == "source_qualifier" or k.startswith("value_span_"):
            return F.col(f"raw.{k}") if inner(raw, k) else none
        for before, kind, at in (("reference_", period, _P), ("effective_", effective, f"{_T}.effective_period")):
            if k in (f"{before}period_start", f"{before}period_end"):
                name = k.removeprefix(before)
                return F.col(f"{at}.{name}") if kind is not None and inner(kind, name) else none
        # the period's own columns come after those of the record, as they are the nearer ones
        if k in CLAIM and period is not None and inner(period, k):
            return F.col(f"{_P}.{k}")
        return F.col(f"{_N}.{k}") if k in n else none

    columns = [*[find(k).alias(k) for k in COMMON], *[F.when(claim, find(k)).alias(k) for k in CLAIM], *[F.when(~claim, find(k)).alias(k) for k in RELATION]]
    return predictions.select(*keep, "record_kind", *columns)


def blind_inputs(packets: DataFrame, observed: list[str], reference: list[str], namespace: str = "IN") -> tuple[DataFrame, DataFrame]:
    """(inputs, links): inputs have an opaque ``input_id`` and the observed columns only; links tie it to the reference columns.
    The id is a digest of the reference columns, so it can't be read, and repeated packets share it."""
    key = stable_id(namespace, *[F.col(c) for c in reference])
    return packets.select(key.alias("input_id"), *observed), packets.select(key.alias("input_id"), *reference).distinct()


def leaks(inputs: DataFrame, links: DataFrame, names: list[str]) -> DataFrame:
    """input_id and reasons of the inputs that tell an answer: a field of one of these names at any depth, or a text that is one
    of the input's own reference values. Empty if none does."""
    text = F.to_json(F.struct(*[c for c in inputs.columns if c != "input_id"]))
    named = F.array_compact(F.array(*[F.when(text.contains(f'"{n}"'), F.lit(f"field:{n}")) for n in names]))
    values = [c for c in links.columns if c != "input_id"]
    j = inputs.select("input_id", text.alias("_text"), named.alias("_named")).join(links, "input_id", "left")
    # as a whole JSON text, so that an id that is part of a longer word is none
    told = F.array_compact(F.array(*[F.when(F.col("_text").contains(F.to_json(F.struct(F.col(c).cast("string").alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).cast("string").alias("v")))) - 6)) & F.col(c).isNotNull(), F.lit(f"value:{c}")) for c in values]))
    return j.select("input_id", F.array_sort(F.array_distinct(F.concat("_named", told))).alias("reasons")).where(F.size("reasons") > 0)
