"""Layered records: the flat layout that comparisons read, and rules over records as columns of error texts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import STRINGS, _struct

PERIOD = _struct(period_start="s", period_end="s", as_of_date="s", period_kind="s", duration_days="i")
TEMPORAL = _struct(time_precision="s", published_at="s", published_date="s", reference_period=PERIOD, effective_period=PERIOD)
NORMALIZED = _struct(
    company_id="s", scope_id="s", product_id="s", entity_refs=STRINGS, event_type="s", value_kind="s", lower="s", upper="s", prior_state_status="s", prior_claim_id="s", definition_version="s", metric_definition_version="s",
    subject_entity_id="s", object_entity_id="s", subject_role="s", object_role="s", relation_type="s", direction="s", financial_context=_struct(statement_type="s", balance_or_flow="s"), temporal=TEMPORAL, field_missing_reasons=T.MapType(T.StringType(), T.StringType()),
)


def flattened(records: DataFrame) -> DataFrame:
    """The columns of ``normalized`` side by side, with period, publication and context taken out of their layers; what the
    flat place lacks comes from the layer."""
    n, t = F.col("normalized"), F.col("normalized.temporal")
    p, c = t["reference_period"], n["financial_context"]
    own = [f.name for f in records.schema["normalized"].dataType.fields if f.name not in ("temporal", "financial_context", "definition_version")]
    return records.select(
        "record_id", *[n[k].alias(k) for k in own], F.coalesce(n["definition_version"], n["metric_definition_version"]).alias("definition_version"), p["period_start"].alias("period_start"), p["period_end"].alias("period_end"),
        p["as_of_date"].alias("as_of_date"), p["period_kind"].alias("period_kind"), p["duration_days"].alias("period_duration_days"), t["published_at"].alias("published_at"), t["published_date"].alias("published_date"), c["balance_or_flow"].alias("balance_or_flow"), c["statement_type"].alias("statement_type"),
    )


def _paths(c: Column, kind: T.StructType, before: str = "") -> Iterator[tuple[str, Column, T.DataType]]:
    """Every dotted path below a struct, with its column and type."""
    for f in kind.fields:
        yield before + f.name, c[f.name], f.dataType
        if isinstance(f.dataType, T.StructType):
            yield from _paths(c[f.name], f.dataType, f"{before}{f.name}.")


def semantic_errors(records: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds ``errors``: the sorted texts of the rules that a record breaks. records: record_id, example_kind, record_kind, raw,
    normalized, provenance, derived; blocks: block_id, raw_text. Only the blocks that a record's evidence names are brought
    to it. The texts are fixed values."""
    used = records.select("record_id", F.explode("provenance.evidence.block_id").alias("block_id")).distinct().join(blocks.select("block_id", "raw_text"), "block_id")
    texts = used.groupBy("record_id").agg(F.map_from_entries(F.collect_set(F.struct("block_id", "raw_text"))).alias("_texts"))
    r = records.join(texts, "record_id", "left")
    n, p, raw, t = F.col("normalized"), F.col("provenance"), F.col("raw"), F.col("normalized.temporal")
    synthetic = F.col("example_kind").eqNullSafe(F.lit("synthetic"))
    reasons = F.coalesce(n["field_missing_reasons"], F.expr("map()").cast("map<string,string>"))
    said = lambda k: F.map_contains_key(reasons, F.lit(k))
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    unresolved = p["rights_check_status"].eqNullSafe(F.lit("unresolved"))
    is_ = lambda c, *v: F.coalesce(c.isin(*v), F.lit(False))
    rules: list[tuple] = []
    for path, c, kind in [*_paths(n, records.schema["normalized"].dataType), *_paths(raw, records.schema["raw"].dataType, "raw.")]:
        present = c.isNotNull() & ~c.isin("unknown", "not_applicable") if isinstance(kind, T.StringType) else c.isNotNull()
        rules.append((said(path) & present, f"{path}: missing reason attached to a present value"))
    for k in ("company_id", "scope_id"):
        rules.append((n[k].isNull() & ~said(k), f"{k}: null without explicit missing reason"))
    rules += [
        (unresolved & filled(raw["claim_text"]), "raw.claim_text: body must not be copied with unresolved rights"),
        (unresolved & F.exists(p["evidence"], lambda e: filled(e["selected_text"])), "evidence.selected_text: excerpt must not be copied with unresolved rights"),
        (unresolved & filled(raw["action_raw"]), "raw.action_raw: body-derived expression must not be copied with unresolved rights"),
    ]

    def surface(e):
        return F.when(synthetic, raw["claim_text"]).otherwise(F.try_element_at(F.coalesce(F.col("_texts"), F.expr("map()").cast("map<string,string>")), e["block_id"]))

    def mismatch(e):
        s = surface(e)
        cut = F.substring(s, e["start"] + 1, F.greatest(e["end"] - e["start"], F.lit(0)))
        return e["start"].isNotNull() & e["end"].isNotNull() & s.isNotNull() & ((e["end"] > F.length(s)) | ~cut.eqNullSafe(e["selected_text"]))

    every = lambda test: F.exists(p["evidence"], lambda e: F.coalesce(test(e), F.lit(False)))
    rules += [
        (every(lambda e: ~e["doc_id"].eqNullSafe(p["doc_id"]) | ~e["revision_id"].eqNullSafe(p["revision_id"])), "evidence document/revision mismatch"),
        (every(lambda e: e["start"].isNull() != e["end"].isNull()), "span endpoints must both be null or both be integers"),
        (every(lambda e: e["location_status"].isin("unlocated", "unverified") & e["start"].isNotNull()), "unverified/unlocated evidence cannot assert verified offsets"),
        (every(lambda e: e["start"] > e["end"]), "span end before start"),
        (every(mismatch), "Unicode code-point span round-trip mismatch"),
        (every(lambda e: e["start"].isNotNull() & surface(e).isNull() & (e["location_status"] == "verified")), "verified source span cannot be checked without original block"),
        (every(lambda e: (e["location_type"] == "table_cell") & (F.coalesce(F.size(e["header_refs"]), F.lit(0)) <= 0)), "table evidence lacks unit/period/scope header refs"),
        (~synthetic & every(lambda e: e["location_status"] == "synthetic"), "source-supported record has synthetic location"),
        ((t["time_precision"] == "date") & t["published_date"].isNull(), "date precision requires published_date"),
        (filled(t["published_at"]) & filled(t["published_date"]) & (F.substring(t["published_at"], 1, 10) != t["published_date"]), "published_at local date disagrees with published_date"),
    ]
    for k in ("reference_period", "effective_period"):
        q = t[k]
        days = F.datediff(q["period_end"].try_cast("date"), q["period_start"].try_cast("date")) + 1
        rules += [
            (q["period_start"] > q["period_end"], f"{k}: period ends before start"),
            ((q["period_kind"] == "instant") & ~filled(q["as_of_date"]), f"{k}: instant balance requires as_of_date"),
            ((q["duration_days"] != 0) & (q["duration_days"] != days), f"{k}: duration_days inconsistent with dates"),
        ]
    claim, relation = F.col("record_kind") == "event_claim", F.col("record_kind") == "business_relation"
    refs = F.coalesce(n["entity_refs"], F.expr("cast(array() as array<string>)"))
    for k in ("product_id", "company_id"):
        rules.append((claim & filled(n[k]) & ~F.array_contains(refs, n[k]), f"{k} missing from entity_refs"))
    context = n["financial_context"]
    rules += [
        (claim & (n["event_type"] == "financial_result") & (is_(context["statement_type"], "not_applicable") | is_(context["balance_or_flow"], "not_applicable")), "financial_result cannot have nonfinancial context"),
        (claim & synthetic & filled(raw["action_raw"]) & filled(raw["claim_text"]) & ~raw["claim_text"].contains(raw["action_raw"]), "synthetic action_raw is not supported by claim_text"),
        (claim & (n["value_kind"] == "range") & (n["lower"].try_cast("decimal(38,12)") > n["upper"].try_cast("decimal(38,12)")), "range lower exceeds upper"),
        (claim & is_(n["prior_state_status"], "comparable_prior", "repeated") & n["prior_claim_id"].isNull(), "comparable/repeated requires actual prior claim ID"),
        (claim & is_(n["prior_state_status"], "prior_not_found", "not_applicable", "not_yet_checked") & filled(n["prior_claim_id"]), "prior status conflicts with populated prior claim ID"),
    ]
    for k in ("subject_entity_id", "object_entity_id", "subject_role", "object_role"):
        rules.append((relation & n[k].isNull() & ~said(k), f"{k}: null without explicit missing reason"))
    supplies = n["subject_role"].eqNullSafe(F.lit("supplier")) & n["object_role"].eqNullSafe(F.lit("customer")) & n["direction"].eqNullSafe(F.lit("subject_to_object"))
    some = lambda test: F.exists("derived", lambda d: F.coalesce(test(d), F.lit(False)))
    rules += [
        (relation & (n["relation_type"] == "supplies_to") & ~supplies, "supplies_to requires supplier→customer direction and roles"),
        (some(lambda d: (d["calculation_status"] == "computed") & (F.coalesce(F.size(d["input_refs"]), F.lit(0)) <= 0)), "computed requires input refs"),
        (some(lambda d: (d["calculation_status"] == "insufficient_inputs") & (F.coalesce(F.size(d["missing_inputs"]), F.lit(0)) <= 0)), "insufficient_inputs requires named missing inputs"),
        (~synthetic & is_(p["rights_check_status"], "synthetic"), "source-supported record cannot have synthetic rights basis"),
    ]
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(e)) for c, e in rules]))))
    return r.withColumn("errors", found).drop("_texts")


def handoff_errors(facts: DataFrame, contracts: DataFrame) -> DataFrame:
    """Adds ``errors`` to handed-over numeric facts: their own representation (value x scale = base units), the contract's
    target, the sign of the raw token, unit, evidence and status must agree. An item without a contract has that error only."""
    r = facts.join(contracts, "item_id", "left")
    known = F.col("target_value").isNotNull()
    num = lambda c: F.col(c).try_cast("decimal(30,6)")
    value, scale, base, target = map(num, ("numeric_value", "scale", "numeric_value_base_units", "target_value"))
    raw = F.regexp_replace(F.regexp_replace(F.regexp_replace("value_raw", r"[,$)\s]", ""), r"\(", "-"), "^--", "-").try_cast("decimal(30,6)")
    parsed = value.isNotNull() & scale.isNotNull() & base.isNotNull() & target.isNotNull() & raw.isNotNull()
    same = ((value.cast("decimal(18,6)") * scale.cast("decimal(18,4)")) == base) & (base == target) & (scale == num("source_scale")) & (num("target_scale") == 1)
    signed = F.when(F.col("sign_policy") == "outflow_to_positive", F.abs(raw)).otherwise(raw)
    rules = {
        "human_gold_overclaim": ~F.col("human_gold").eqNullSafe(F.lit(False)) | ~F.col("status").eqNullSafe(F.lit("reviewed_agent_draft")),
        "evidence_link": ~F.array_sort(F.array_distinct("evidence_refs")).eqNullSafe(F.array_sort(F.array_distinct("contract_evidence"))),
        "numeric_parse": ~parsed, "numeric_representation": parsed & ~same, "raw_sign_policy": parsed & (value != signed),
        "unit_currency": ~F.col("currency").eqNullSafe(F.lit("USD")) | ~F.col("canonical_unit").eqNullSafe(F.lit("USD")),
    }
    found = F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()])))
    return r.withColumn("errors", F.when(known, found).otherwise(F.array(F.lit("unknown_item")))).drop(*[c for c in contracts.columns if c != "item_id"])
