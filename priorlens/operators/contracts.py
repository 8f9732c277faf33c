"""Contract records held against everything they were made from: source facts, links, documents, indexed evidence, located
text, packets and registries. The rules are data for ``rulebook``; their codes are fixed values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .rulebook import Elements, Lookup, Rule, Rulebook


@dataclass(frozen=True)
class Terms:
    """What a contract is about: its company, scopes, versions and year's end."""

    company_id: str
    consolidated_scope: str
    segment_mark: str
    definition: str
    segment_definition: str  # followed by the fiscal year
    guide_version: str
    currency: str = "USD"
    source_scale: str = "1000000"
    negated_metric: str = "positive_cash_capex"
    year_end: tuple[int, int] = (6, 30)
    quarter_start: tuple[int, int] = (4, 1)
    year_start: tuple[int, int] = (7, 1)


def _values(t: Terms) -> dict[str, str]:
    n = "normalized"
    same = lambda a, b, names: " and ".join(f"{a}.{k} <=> {b}.{k}" for k in names)
    period = {
        "period_start": "if({instant}, null, cast({start} as string))", "period_end": "if({instant}, null, cast({end} as string))", "as_of_date": "if({instant}, cast({end} as string), null)", "period_basis": "'fiscal'",
        "period_kind": "if({instant}, 'instant', if({quarter}, 'quarter', 'annual'))", "fiscal_year": "{year}", "fiscal_quarter": "if({quarter}, 4, null)", "duration_days": "{days}", "missing_reason": "null",
    }
    return {
        "relation": "record_kind = 'business_relation'",
        "item": "if({relation}, relation_id, claim_id)",
        "segment": f"contains({n}.scope_id, '{t.segment_mark}')",
        "refs": "transform(provenance.evidence, x -> x.evidence_id)",
        "header": r"regexp_replace(trim(packet.raw.period_header), '\\s+', ' ')",
        "years": r"regexp_extract_all(packet.raw.year_header, '20[0-9]{2,2}', 0)",
        "year": "try_cast(get({years}, 0) as int)",
        "instant": "not contains({header}, 'Months Ended')",
        "quarter": "contains({header}, 'Three Months Ended')",
        "end": f"make_date({{year}}, {t.year_end[0]}, {t.year_end[1]})",
        "start": f"if({{quarter}}, make_date({{year}}, {t.quarter_start[0]}, {t.quarter_start[1]}), make_date({{year}} - 1, {t.year_start[0]}, {t.year_start[1]}))",
        "days": "if({instant}, null, datediff({end}, {start}) + 1)",
        "period": " and ".join(f"{n}.temporal.reference_period.{k} <=> {v}" for k, v in period.items()),
        "signed": "try_cast(replace(translate(raw.value_raw, ',$)', ''), '(', '-') as decimal(30,6))",
        "negated": f"{n}.metric_id <=> '{t.negated_metric}'",
        "target": "if({negated}, -{signed}, {signed}) * 1000000",
        "dependency": f"get({n}.availability_dependencies, 0)",
        "consolidated": f"source.scope_id = '{t.consolidated_scope}'",
        "direction": same(n, "rel", ("subject_entity_id", "object_entity_id", "subject_role", "object_role", "relation_type", "scope_id", "negation", "modality")),
        "indexed": same("e", "idx", ("doc_id", "revision_id", "location", "start", "end", "selected_text", "header_refs")),
    }


def _rules(t: Terms) -> list[Rule]:
    n, p, time = "normalized", "provenance", "normalized.temporal"
    claim, relation = "not {relation}", "{relation}"
    scoped, free = "{consolidated}", "not ({consolidated})"
    every = lambda *rows: [Rule(*r) for r in rows]
    return [
        Rule("unknown_claim_id", "source.n is not null", stops=True),
        Rule("unknown_item_id", "link.n is not null", stops=True),
        Rule("unknown_doc_id", "doc.n is not null", stops=True),
        *every(
            # where it comes from
            ("event_family_link", "event_id <=> link.event_id and event_family_id <=> link.event_family_id"),
            ("source_revision", f"{p}.doc_id = link.doc_id and {p}.revision_id = doc.revision_id"),
            ("source_hash", f"{p}.source_sha256 = doc.sha256 and doc.sha256 = stored.sha256"),
            ("company_id", f"{n}.company_id = '{t.company_id}' and company.n is not null"),
            ("scope_source_mismatch", f"{n}.scope_id = source.scope_id"),
            ("definition_version", f"{n}.definition_version = if({{segment}}, concat('{t.segment_definition}', doc.fiscal_year), '{t.definition}')"),
            # what it claims to be
            ("false_human_gold", "annotation_status = 'agent_draft' and not human_gold"),
            ("exposure_change", "exposure_status = 'adaptation'"),
            ("guide_version_alignment", f"guide_version = '{t.guide_version}'"),
            ("false_human_assessment", "assessment.author_kind = 'agent_draft'"),
            ("evidence_overclaim", f"{n}.evidence_status = 'company_reported'"),
            ("source_evidence_status_preservation", "raw.source_evidence_status <=> if({relation}, rel.evidence_status, source.evidence_status)"),
            ("period_derivation_preservation", "raw.source_period_start_derivation <=> source.period_start_derivation"),
            ("source_extractor_versions", f"{p}.source_parser_version <=> doc.parser_version and {p}.source_schema_version <=> source.schema_version and {p}.source_normalization_revision_id <=> source.normalization_revision_id"),
            # when
            ("missing_reason_paths", f"{n}.field_missing_reasons['temporal.published_at'] <=> 'not_disclosed' and not map_contains_key({n}.field_missing_reasons, 'published_at')"),
            ("full_date_audit_not_claimed", f"{time}.date_conflict_status = 'not_yet_checked'"),
            ("date_only_precision", f"{time}.published_date <=> doc.published_date and {time}.time_precision = 'date' and coalesce({time}.published_at, {time}.available_at, {time}.timezone, {time}.utc_offset) is null"),
            ("observation_date", f"{time}.observed_at <=> doc.observed_at"),
            ("header_ref_resolution", f"forall({p}.evidence, x -> forall(coalesce(x.header_refs, array()), h -> array_contains(known, h)))", f"size({p}.evidence) > 0"),
            ("packet_linkage", f"packet.source_sha256 = {p}.source_sha256 and packet.evidence_refs <=> {{refs}}"),
            # the second document that a consolidated scope depends on
            ("scope_dependency_missing", f"size({n}.availability_dependencies) = 1", scoped),
            ("unknown_dependency", "support.n is not null", f"{scoped} and {{dependency}} is not null"),
            ("scope_dependency_time", "{dependency}.available_at <=> support.observed_at and {dependency}.published_date is null", f"{scoped} and support.n is not null"),
            ("future_scope_in_assessment", "try_cast(assessment.as_of as timestamp) >= try_cast({dependency}.available_at as timestamp)", f"{scoped} and support.n is not null"),
            ("unexpected_scope_dependency", f"size({n}.availability_dependencies) = 0", free),
            # the period, from the packet's headers
            ("year_header_ambiguous", "size({years}) = 1"),
            ("period_header_mapping", "{period}"),
        ),
        *[
            Rule(code, test, relation)
            for code, test in (
                ("relation_direction_roles", f"{{direction}} and {n}.direction = 'subject_to_object'"),
                ("relation_entity_refs", "subject.n is not null and object.n is not null"),
                ("report_period_not_effective_period", f"{n}.valid_from is null and {n}.valid_to is null and {time}.effective_period.period_kind = 'unknown' and {time}.effective_period.period_start is null and {time}.effective_period.period_end is null"),
                ("relation_source_sidecar", "raw.source_effective_period <=> rel.effective_period"),
            )
        ],
        *[
            Rule(code, test, claim)
            for code, test in (
                ("unknown_metric_id", "metric.n is not null"),
                ("metric_source_mismatch", f"{n}.metric_id = source.metric_id"),
                ("consolidation_scope", f"{n}.consolidation = if({{segment}}, 'segment', 'consolidated')"),
                ("unit_scale", f"{n}.currency = '{t.currency}' and {n}.canonical_unit = '{t.currency}' and {n}.scale = '1' and {n}.source_scale = '{t.source_scale}'"),
                ("raw_value_preserved", "raw.value_raw = source.value_raw"),
                ("source_numeric_sign", f"try_cast({n}.source_numeric_value as decimal(30,6)) = {{signed}}"),
                ("value_scaling_sign", f"try_cast({n}.numeric_value as decimal(38,6)) = {{target}}"),
                ("sign_policy", f"{n}.sign_policy = if({{negated}}, 'outflow_to_positive', 'preserve')"),
                ("balance_duration", f"{n}.financial_context.period_duration <=> {{days}}"),
                ("numeric_header_binding", "size(numeric) = 1 and size(numeric[0].header_refs) = 4"),
                ("packet_original_cell", "packet.raw.value_cell = numeric[0].cell"),
                ("derived_lineage", f"size(derived) = 1 and derived[0].output = {n}.numeric_value and derived[0].reviewed_by is null"),
            )
        ],
        *[
            Rule(code, test, applies, part="e")
            for code, test, applies in (
                ("unknown_evidence_id", "idx.n is not null", "true"),
                ("evidence_index_mismatch", "{indexed}", "idx.n is not null"),
                ("evidence_source_revision", f"e.doc_id = {p}.doc_id and e.revision_id = {p}.revision_id", "true"),
                ("source_xpath", "node.n = 1", "true"),
                ("source_span_roundtrip", "0 <= e.start and e.start < e.end and e.end <= length(node.text) and substring(node.text, e.start + 1, e.end - e.start) = e.selected_text", "node.n = 1"),
            )
        ],
    ]


def contract_book(terms: Terms) -> Rulebook:
    """Tables: facts (claim_id), links (item_id), documents (doc_id), stored (doc_id, sha256 of the kept file), relations
    (relation_id), metrics (metric_id), entities (entity_id), packets (item_id), evidence (evidence_id), nodes (doc_id, location,
    text: located text of the documents)."""
    n = "normalized"
    lookups = [
        Lookup("idx", "evidence", {"evidence_id": "e.evidence_id"}, "e"),
        Lookup("node", "nodes", {"doc_id": "provenance.doc_id", "location": "e.location"}, "e"),
        Lookup("source", "facts", {"claim_id": "claim_id"}),
        Lookup("link", "links", {"item_id": "{item}"}),
        Lookup("rel", "relations", {"relation_id": "relation_id"}),
        Lookup("packet", "packets", {"item_id": "{item}"}),
        Lookup("doc", "documents", {"doc_id": "provenance.doc_id"}),
        Lookup("stored", "stored", {"doc_id": "provenance.doc_id"}),
        Lookup("support", "documents", {"doc_id": "{dependency}.record_id"}),
        Lookup("company", "entities", {"entity_id": f"{n}.company_id"}),
        Lookup("subject", "entities", {"entity_id": f"{n}.subject_entity_id"}),
        Lookup("object", "entities", {"entity_id": f"{n}.object_entity_id"}),
        Lookup("metric", "metrics", {"metric_id": f"{n}.metric_id"}),
    ]
    numeric = "if(idx.evidence_kind = 'numeric_value', struct(e.header_refs as header_refs, node.text as cell), null)"
    elements = [Elements("e", "provenance.evidence", {"known": "if(idx.n is not null, e.evidence_id, null)", "numeric": numeric})]
    return Rulebook(_rules(terms), lookups, _values(terms), elements)


def contract_errors(records: DataFrame, tables: dict[str, DataFrame], terms: Terms) -> DataFrame:
    """records with ``errors``."""
    return contract_book(terms).check(records, tables)
