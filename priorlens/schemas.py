"""Record layouts as Spark types."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType | str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "b": T.BooleanType()}
    return T.StructType([T.StructField(k, kinds[v] if isinstance(v, str) else v) for k, v in fields.items()])


STRINGS = T.ArrayType(T.StringType())
PERIOD = _struct(period_start="s", period_end="s", as_of_date="s", period_kind="s", period_basis="s", fiscal_year="i", fiscal_quarter="i", duration_days="i")
DEPENDENCY = _struct(record_id="s", published_at="s", published_date="s", observed_at="s", use_policy="s", availability_basis="s")
#: A numeric claim or a business relation; what doesn't apply is null.
CLAIM = _struct(
    record_id="s", record_kind="s", event_family_id="s", doc_id="s", revision_id="s",
    company_id="s", scope_id="s", scope_level="s", definition_version="s", modality="s", evidence_status="s", scope_status_as_of="s",
    metric_id="s", numeric_value="s", missing_reason="s", currency="s", canonical_unit="s", scale="s", sign_policy="s", value_kind="s", denominator="s", sign_convention="s", product_id="s", product_id_missing_reason="s",
    balance_or_flow="s", statement_type="s", accounting_basis="s", adjustment_definition="s", consolidation="s", aggregation_behavior="s",
    relation_type="s", subject_entity_id="s", object_entity_id="s", direction="s", subject_role="s", object_role="s", valid_from="s", valid_to="s", negation="b", conditions=STRINGS,
    published_at="s", published_date="s", revision_published_at="s", revision_published_date="s", observed_at="s", available_at="s", time_precision="s",
    reference_period=PERIOD, availability_dependencies=T.ArrayType(DEPENDENCY), evidence_refs=STRINGS, field_missing_reasons=T.MapType(T.StringType(), T.StringType()),
)
FEEDBACK = _struct(feedback_id="s", idempotency_key="s", source_run="s", card_id="s", card_version="s", actor_id="s", action="s", field="s", before="s", after="s", evidence_refs=STRINGS, reason_code="s", created_at="s")
BLOCK = _struct(block_id="s", doc_id="s", block_type="s", seq="i", section_path="s", raw_text="s", normalized_text="s", table_id="s", row_index="i", col_index="i", rowspan="i", colspan="i", header_refs=STRINGS, node_path="s")
INPUT = _struct(
    input_id="s", input_kind="s", doc_id="s", revision_id="s", source_sha256="s", published_date="s", observed_at="s",
    value_cell="s", row_label="s", period_header="s", year_header="s", unit_header="s",
    company_id="s", company_name="s", scope_label="s", table_purpose="s", currency="s", accounting_basis="s", source_qualifier="s", evidence_refs=STRINGS,
)
