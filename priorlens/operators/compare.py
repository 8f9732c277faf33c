"""Are two claims comparable, and what changed? Two policies that differ by design: the change engine and claim comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import asof, numbers, periods
from ..functions.ids import stable_id
from ..functions.reasons import codes, merged

# The keys that two records must share, in the order in which reasons are given.
SHARED = ["company_id", "scope_id", "definition_version", "modality"]
NUMERIC = SHARED + ["metric_id", "accounting_basis", "currency", "canonical_unit", "scale", "balance_or_flow", "statement_type", "consolidation", "sign_policy"]
RELATION = SHARED + ["relation_type", "subject_entity_id", "object_entity_id", "direction", "subject_role", "object_role", "negation", "conditions"]
CLAIM_KEYS = ["company_id", "scope_id", "metric_id", "definition_version", "accounting_basis", "consolidation", "canonical_unit", "currency", "value_kind", "balance_or_flow", "period_basis", "period_kind", "modality", "scale"]
POLICY = "prior-change-0.1.0"

_NONE = "cast(array() as array<string>)"


def is_relation(c: Column) -> Column:
    return c["record_kind"] == "business_relation"


def compatible(n: Column, o: Column, basis: Column) -> Column:
    """struct(decision, checks map, reasons): mismatches make two records not comparable; else unknowns call for review."""

    def keyed(keys: list[str]) -> tuple[Column, Column, Column]:
        check = {k: (n[k] == o[k]) for k in keys}
        return (
            codes(*[(F.coalesce(~check[k], F.lit(False)), f"{k}_mismatch") for k in keys]),
            codes(*[(check[k].isNull(), f"{k}_unknown") for k in keys]),
            F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), check[k].alias("value")) for k in keys])),
        )

    a, b, flow = n["reference_period"], o["reference_period"], n["balance_or_flow"]
    bad, unknown, checks = keyed(NUMERIC)
    aligned = periods.period_aligned(a, b, flow, basis)
    labels = {k: F.coalesce(a[k] == b[k], F.lit(False)) for k in ("period_kind", "period_basis")}
    quarter = a["fiscal_quarter"].eqNullSafe(b["fiscal_quarter"])
    invalid = lambda c: c["numeric_value"].isNotNull() & c["numeric_value"].try_cast("double").isNull()
    infinite = lambda c: c["numeric_value"].rlike(r"(?i)^[+-]?(inf(inity)?|nan)$")
    bad = merged(bad, codes(
        (~labels["period_kind"], "period_kind_mismatch"), (~labels["period_basis"], "period_basis_mismatch"),
        (F.coalesce(~aligned, F.lit(False)), "actual_period_mismatch"), (~quarter, "fiscal_quarter_mismatch"),
        (~n["scale"].eqNullSafe(F.lit("1")) | ~o["scale"].eqNullSafe(F.lit("1")), "base_unit_required"),
        (~n["modality"].eqNullSafe(F.lit("actual_reported")) | ~o["modality"].eqNullSafe(F.lit("actual_reported")), "nonactual_numeric_comparison_not_supported"),
        (F.coalesce(infinite(n) | infinite(o), F.lit(False)), "nonfinite_numeric_value"),
        (F.coalesce(invalid(n) & ~infinite(n), F.lit(False)) | F.coalesce(invalid(o) & ~infinite(o), F.lit(False)), "invalid_numeric_value"),
    ))
    adjusted = lambda c: (c["accounting_basis"] == "non_GAAP") & F.coalesce(c["adjustment_definition"] == "", F.lit(True))
    unknown = merged(unknown, codes(
        (aligned.isNull(), "actual_period_unknown_or_invalid"),
        (F.coalesce(adjusted(n), F.lit(False)) | F.coalesce(adjusted(o), F.lit(False)), "adjustment_definition_unknown"),
        (n["numeric_value"].isNull() | o["numeric_value"].isNull(), "numeric_value_missing"),
    ))
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in {**labels, "actual_period_alignment": aligned, "fiscal_quarter": quarter}.items()])
    checks = F.map_concat(checks, F.map_from_entries(entries))

    r_bad, r_unknown, r_checks = keyed(RELATION)
    valid = F.coalesce((n["valid_from"] != "") & (o["valid_from"] != ""), F.lit(False))
    span = (n["valid_from"] == o["valid_from"]) & n["valid_to"].eqNullSafe(o["valid_to"])
    r_bad = merged(r_bad, codes((valid & ~span, "relation_valid_period_mismatch")))
    r_unknown = merged(r_unknown, codes((~valid, "actual_relation_validity_unknown")))
    r_checks = F.map_concat(r_checks, F.map_from_entries(F.array(F.struct(F.lit("actual_validity_known").alias("key"), valid.alias("value")))))

    rel = is_relation(n)
    no, maybe = F.when(rel, r_bad).otherwise(bad), F.when(rel, r_unknown).otherwise(unknown)
    decision = F.when(F.size(no) > 0, "not_comparable").when(F.size(maybe) > 0, "needs_review").otherwise("comparable")
    return F.struct(decision.alias("decision"), F.when(rel, r_checks).otherwise(checks).alias("checks"), merged(no, maybe).alias("reasons"))


def basis_of(n: Column, o: Column) -> Column:
    """How two records are to be compared, from their periods."""
    return F.when(is_relation(n), "relation_state").when(n["reference_period"].eqNullSafe(o["reference_period"]), "same_period_revision").otherwise("yoy")


def changes(pairs: DataFrame) -> DataFrame:
    """pairs: structs ``new`` and ``old`` (claims), comparison_basis, cutoff_mode, cutoff. One change record per pair.

    Amounts are decimal texts; the difference and the relative change have 28 significant digits, half-even."""
    n, o = F.col("new"), F.col("old")
    p = pairs.withColumn("compatibility", compatible(n, o, F.col("comparison_basis")))
    p = p.withColumn("_na", asof.availability(n, F.col("cutoff_mode"), F.col("cutoff"))).withColumn("_oa", asof.availability(o, F.col("cutoff_mode"), F.col("cutoff")))
    decision, rel = F.col("compatibility.decision"), is_relation(n)
    computed = ~rel & (decision == "comparable") & (F.size("_na") == 0) & (F.size("_oa") == 0)
    public, day = F.lit("historical_public"), n["published_date"]
    strict_old = F.when(F.col("comparison_basis") == "within_release_comparison", F.size(asof.availability(o, public, day)) == 0).otherwise(F.size(asof.availability(o, public, day, True)) == 0)
    historical = day.isNotNull() & (F.size(asof.availability(n, public, day)) == 0) & strict_old & (decision == "comparable")
    zero = o["numeric_value"].try_cast("double") == 0
    p = p.withColumn("_computed", computed)
    text = lambda c: F.when(F.col("_computed"), c)
    return p.select(
        stable_id("CH", n["record_id"], o["record_id"], F.col("comparison_basis"), F.col("cutoff_mode"), F.lit(POLICY)).alias("change_id"),
        n["record_id"].alias("new_record_id"), o["record_id"].alias("prior_record_id"), "comparison_basis", "cutoff_mode", "cutoff",
        n["doc_id"].alias("new_doc_id"), o["doc_id"].alias("prior_doc_id"), n["revision_id"].alias("new_revision_id"), o["revision_id"].alias("prior_revision_id"),
        "compatibility", F.when(computed, "computed").otherwise("withheld").alias("status"), merged(F.col("compatibility.reasons"), F.col("_na"), F.col("_oa")).alias("reasons"),
        o["numeric_value"].alias("old_value"), n["numeric_value"].alias("new_value"),
        numbers.exact_difference(text(n["numeric_value"]), text(o["numeric_value"])).alias("delta"),
        numbers.exact_relative(text(n["numeric_value"]), text(o["numeric_value"])).alias("relative_delta"),
        F.when(computed & zero, "zero_denominator").alias("relative_delta_missing_reason"),
        F.array(F.when(rel, "relation_state_unresolved").when(decision == "not_comparable", "not_comparable").when(~computed, "comparison_unresolved").when(F.col("comparison_basis") == "same_period_revision", "same_period_difference_unconfirmed_revision").otherwise(F.col("comparison_basis"))).alias("change_types"),
        F.when(computed, numbers.change_interpretation(n["numeric_value"].try_cast("double"), o["numeric_value"].try_cast("double"))).alias("interpretation"),
        F.when(n["canonical_unit"] == "percent", "percent_point").otherwise(n["canonical_unit"]).alias("unit"),
        F.array_sort(F.array_distinct(F.concat(F.coalesce(n["evidence_refs"], F.expr(_NONE)), F.coalesce(o["evidence_refs"], F.expr(_NONE))))).alias("evidence_refs"),
        F.coalesce(historical, F.lit(False)).alias("historical_eligible"), F.lit(POLICY).alias("policy_version"),
    )


def _known(x: Column) -> Column:
    return x.isNotNull() & ~F.lower(x.cast("string")).isin("unknown", "ambiguous", "not_yet_checked", "not_found", "")


def _field(c: Column, k: str) -> Column:
    return c["reference_period"][k] if k in ("period_basis", "period_kind", "fiscal_year", "fiscal_quarter") else c[k]


def _flat_period(c: Column) -> Column:
    p = c["reference_period"]
    return F.struct(c["balance_or_flow"].alias("balance_or_flow"), p["period_start"].alias("period_start"), p["period_end"].alias("period_end"), p["as_of_date"].alias("as_of_date"), p["duration_days"].alias("period_duration_days"))


def _base(n: Column, o: Column) -> tuple[Column, Column]:
    """Failures and unknowns that claim comparison and year-to-date differences share."""
    fail, unknown = [], []
    for k in CLAIM_KEYS:
        a, b = _field(n, k), _field(o, k)
        both = _known(a) & _known(b)
        unknown.append((~both, f"{k}_unknown"))
        fail.append((both & (a != b), f"{k}_mismatch"))
    either = lambda f: F.coalesce(f(n), F.lit(False)) | F.coalesce(f(o), F.lit(False))
    fail.append((either(lambda c: _known(c["scale"]) & (c["scale"] != "1")), "explicit_base_unit_normalization_required"))
    company = lambda c: c["scope_level"].isin("company", "consolidated") | c["scope_id"].endswith("-CONSOLIDATED")
    no_product = (F.coalesce(company(n), F.lit(False)) & F.coalesce(company(o), F.lit(False))) | ((n["product_id_missing_reason"] == "not_applicable") & (o["product_id_missing_reason"] == "not_applicable"))
    both = _known(n["product_id"]) & _known(o["product_id"])
    fail.append((both & (n["product_id"] != o["product_id"]), "product_mismatch"))
    unknown.append((~both & ~(n["product_id"].isNull() & o["product_id"].isNull() & F.coalesce(no_product, F.lit(False))), "product_unknown_for_noncompany_scope"))
    for k in ("adjustment_definition", "denominator", "sign_convention"):
        fail.append((~n[k].eqNullSafe(o[k]), f"{k}_mismatch"))
    unknown.append((either(lambda c: F.lower(c["accounting_basis"]).rlike("^non[-_]gaap") & ~_known(c["adjustment_definition"])), "non_gaap_definition_missing"))
    unknown.append((either(lambda c: c["value_kind"].isin("share", "rate", "relative_change") & ~_known(c["denominator"])), "ratio_denominator_unknown"))
    return codes(*fail), codes(*unknown)


def _amounts(n: Column, o: Column) -> tuple[Column, Column]:
    missing = lambda c: F.concat(F.lit("numeric_value_missing:"), F.coalesce(c["missing_reason"], F.lit("reason_not_recorded")))
    bad = lambda c: c["numeric_value"].isNotNull() & ~numbers.is_numeric_text(c["numeric_value"])
    return codes((bad(n) | bad(o), "numeric_value_invalid")), codes((n["numeric_value"].isNull(), missing(n)), (o["numeric_value"].isNull(), missing(o)))


def compare_claims(pairs: DataFrame) -> DataFrame:
    """pairs: structs ``new`` and ``old``, comparison_kind (same_period or yoy), as_of (date, date-time or null)."""
    n, o, kind = F.col("new"), F.col("old"), F.col("comparison_kind")
    fail, unknown = _base(n, o)
    p = pairs.withColumn("_np", periods.period_data(_flat_period(n))).withColumn("_op", periods.period_data(_flat_period(o)))
    a, b = F.col("_np"), F.col("_op")
    ok = a["error"].isNull() & b["error"].isNull()
    same, yoy = ok & (kind == "same_period"), ok & (kind == "yoy")
    year_on = lambda k: (F.year(a[k]) == F.year(b[k]) + 1) & (F.month(a[k]) == F.month(b[k])) & (F.day(a[k]) == F.day(b[k]))
    matched = F.when(n["balance_or_flow"] == "balance", year_on("end")).otherwise(year_on("start") & year_on("end"))
    length = a["days"].eqNullSafe(b["days"]) | F.coalesce(matched & (F.abs(a["days"] - b["days"]) <= 1), F.lit(False))
    fy, fq = (lambda c: c["reference_period"]["fiscal_year"]), (lambda c: c["reference_period"]["fiscal_quarter"])
    bad_value, no_value = _amounts(n, o)
    fail = merged(fail, codes(
        (same & ~(a["start"].eqNullSafe(b["start"]) & a["end"].eqNullSafe(b["end"]) & a["days"].eqNullSafe(b["days"])), "reference_period_mismatch"),
        (same & (fy(n) != fy(o)), "fiscal_year_conflicts_with_same_period"), (same & (fq(n) != fq(o)), "fiscal_quarter_conflicts_with_same_period"),
        (yoy & ~F.coalesce(matched & length, F.lit(False)), "yoy_actual_period_not_aligned"), (yoy & (fy(n) != fy(o) + 1), "fiscal_year_labels_not_yoy"), (yoy & (fq(n) != fq(o)), "fiscal_quarter_labels_not_yoy"),
        (ok & ~kind.isin("same_period", "yoy"), "unsupported_comparison_kind"),
    ), bad_value)
    unknown = merged(unknown, asof.publication_errors(n, F.col("as_of")), asof.publication_errors(o, F.col("as_of")), F.array_compact(F.array(a["error"], b["error"])), no_value)
    p = p.withColumn("_f", fail).withColumn("_u", unknown).withColumn("decision", F.when(F.size("_f") > 0, "not_comparable").when(F.size("_u") > 0, "unknown").otherwise("comparable"))
    good = lambda c: F.when(F.col("decision") == "comparable", c["numeric_value"])
    return p.select(
        n["record_id"].alias("new_claim_id"), o["record_id"].alias("prior_claim_id"), kind.alias("comparison_basis"), "decision", merged(F.col("_f"), F.col("_u")).alias("reasons"),
        numbers.exact_difference(good(n), good(o)).alias("delta"), numbers.exact_relative(good(n), good(o)).alias("relative_delta"),
        F.when((F.col("decision") == "comparable") & (o["numeric_value"].try_cast("double") == 0), "zero_prior_denominator").alias("relative_delta_missing_reason"),
        F.when(n["canonical_unit"] == "percent", "percent_point").otherwise(n["canonical_unit"]).alias("delta_unit"),
    )


def difference_ytd(pairs: DataFrame) -> DataFrame:
    """pairs: structs ``longer`` and ``shorter``, both year-to-date flows of one start: what the time between them adds."""
    l, s = F.col("longer"), F.col("shorter")
    fail, unknown = _base(l, s)
    p = pairs.withColumn("_l", periods.period_data(_flat_period(l))).withColumn("_s", periods.period_data(_flat_period(s)))
    a, b = F.col("_l"), F.col("_s")
    ok = a["error"].isNull() & b["error"].isNull()
    each = lambda f: ~(F.coalesce(f(l), F.lit(False)) & F.coalesce(f(s), F.lit(False)))
    fail = merged(fail, codes(
        (each(lambda c: c["balance_or_flow"] == "flow"), "ytd_difference_requires_flows"),
        (each(lambda c: c["reference_period"]["period_kind"] == "ytd"), "explicit_ytd_period_kind_required"),
        (each(lambda c: (c["value_kind"] == "point") & ~c["canonical_unit"].isin("percent", "percent_point", "percentage_point", "fraction", "ratio")), "ytd_difference_requires_additive_point_amounts"),
        (each(lambda c: c["aggregation_behavior"] == "additive_flow"), "additive_flow_registry_definition_required"),
        (l["reference_period"]["fiscal_year"] != s["reference_period"]["fiscal_year"], "fiscal_year_mismatch"),
        (ok & ~((a["start"] == b["start"]) & (b["end"] < a["end"]) & (a["start"] <= b["end"])), "shorter_ytd_not_prefix_of_longer"),
    ))
    unknown = merged(unknown, codes((l["record_id"].isNull() | s["record_id"].isNull(), "input_record_identity_missing")), F.array_compact(F.array(a["error"], b["error"])))
    numeric = numbers.is_numeric_text(l["numeric_value"]) & numbers.is_numeric_text(s["numeric_value"])
    p = p.withColumn("_f", fail).withColumn("_u", unknown)
    clear = (F.size("_f") == 0) & (F.size("_u") == 0)
    status = F.when(F.size("_f") > 0, "incompatible_inputs").when((F.size("_u") > 0) | ~numeric, "insufficient_inputs").otherwise("computed")
    p = p.withColumn("calculation_status", status)
    good = lambda c: F.when(F.col("calculation_status") == "computed", c)
    return p.select(
        l["record_id"].alias("longer_id"), s["record_id"].alias("shorter_id"), "calculation_status",
        F.when(clear & ~numeric, F.array(F.lit("numeric_input_missing_or_invalid"))).otherwise(merged(F.col("_f"), F.col("_u"))).alias("reasons"),
        numbers.exact_difference(good(l["numeric_value"]), good(s["numeric_value"])).alias("output"), good(l["canonical_unit"]).alias("output_unit"),
        good(F.date_add(b["end"], 1)).alias("period_start"), good(a["end"]).alias("period_end"), good(F.datediff(a["end"], b["end"])).alias("period_duration_days"),
    )
