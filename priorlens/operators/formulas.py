"""Registered formulas over claims of one document and period, scenarios, and reconciliation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import asof, numbers, periods
from ..functions.ids import stable_id
from ..functions.reasons import codes, merged

# Formulas and the metrics in their roles; keys that inputs must share.
ROLES = {"operating_margin": ("operating_income", "revenue"), "project_fcf": ("cfo", "positive_cash_capex")}
KEYS = ["company_id", "scope_id", "definition_version", "accounting_basis", "currency", "canonical_unit", "scale", "balance_or_flow", "modality"]


def calculate(groups: DataFrame, formula: str, scope_id: str, currency: str = "USD") -> DataFrame:
    """groups: group_id, a and b (claim structs in the formula's roles, null if missing), cutoff_mode, cutoff."""
    if formula not in ROLES:
        return groups.select("group_id", "cutoff_mode", F.lit(formula).alias("formula_id"), F.lit("invalid_formula").alias("status"), F.lit(None).cast("string").alias("output"), F.expr("cast(array() as array<string>)").alias("missing_inputs"), F.array(F.lit("formula_not_registered")).alias("reasons"))
    a, b = F.col("a"), F.col("b")
    missing = codes((a.isNull(), ROLES[formula][0]), (b.isNull(), ROLES[formula][1]))
    valid = numbers.is_numeric_text(a["numeric_value"]) & numbers.is_numeric_text(b["numeric_value"])
    amount = b["numeric_value"].try_cast("double")
    off = lambda c: ~F.coalesce(c, F.lit(False))
    reasons = merged(
        codes(*[(off(a[k] == b[k]), f"{k}_mismatch_or_unknown") for k in KEYS], (~a["reference_period"].eqNullSafe(b["reference_period"]), "actual_period_mismatch"),
              (off((a["scope_id"] == scope_id) & (a["currency"] == currency) & (a["scale"] == "1") & (a["modality"] == "actual_reported") & (a["balance_or_flow"] == "flow")), "formula_domain_mismatch"),
              (~periods.period_valid(a["reference_period"], F.lit("flow")), "invalid_period")),
        asof.availability(a, F.col("cutoff_mode"), F.col("cutoff")), asof.availability(b, F.col("cutoff_mode"), F.col("cutoff")),
        codes((F.lit(formula == "project_fcf") & valid & ((amount < 0) | off(b["sign_policy"] == "outflow_to_positive")), "positive_cash_capex_sign_required"),
              (F.lit(formula == "operating_margin") & valid & (amount == 0), "zero_denominator")),
    )
    g = groups.withColumn("missing_inputs", missing).withColumn("reasons", F.when(F.size("missing_inputs") > 0, F.expr("cast(array() as array<string>)")).when(~valid, F.array_append(reasons, "numeric_input_missing_or_invalid")).otherwise(reasons))
    status = F.when((F.size("missing_inputs") > 0) | ~valid, "insufficient_inputs").when(F.size("reasons") > 0, "incompatible_inputs").otherwise("computed")
    g = g.withColumn("status", status)
    x, y = (F.when(F.col("status") == "computed", c["numeric_value"]) for c in (a, b))
    output = numbers.exact_quotient(x, y) if formula == "operating_margin" else numbers.exact_difference(x, y)
    return g.select("group_id", "cutoff_mode", F.lit(formula).alias("formula_id"), "status", output.alias("output"), "missing_inputs", "reasons")


def formula_groups(claims: DataFrame, formula: str, modes=asof.MODES, review_cutoff: str | None = None) -> DataFrame:
    """The inputs of a formula by document and period, in each mode."""
    c = F.struct(*claims.columns)
    first = lambda m: F.max_by(F.when(F.col("metric_id") == m, c), F.when(F.col("metric_id") == m, F.col("record_id")))
    flows = claims.where((F.col("record_kind") == "event_claim") & (F.col("balance_or_flow") == "flow"))
    by = flows.groupBy("doc_id", "scope_id", "reference_period").agg(first(ROLES[formula][0]).alias("a"), first(ROLES[formula][1]).alias("b"), F.min("published_date").alias("_p"))
    by = by.withColumn("cutoff_mode", F.explode(F.array(*map(F.lit, modes))))
    cutoff = F.when(F.col("cutoff_mode") == "current_review", F.coalesce(F.lit(review_cutoff), F.lit("2026-10-06"))).otherwise(F.coalesce(F.lit(review_cutoff), F.col("_p")))
    return by.select(stable_id("CALC", F.col("doc_id"), F.col("scope_id"), F.to_json("reference_period"), F.lit(formula)).alias("group_id"), "a", "b", "cutoff_mode", cutoff.alias("cutoff"))


def scenario(inputs: DataFrame) -> DataFrame:
    """inputs: units, asp (texts), target_period, scope_id, currency, assumption_refs. Units times price, if all is known and reviewed."""
    need = ["units", "asp", "target_period", "scope_id", "currency"]
    missing = codes(*[(F.col(k).isNull(), k) for k in need])
    unreviewed = F.coalesce(F.size("assumption_refs"), F.lit(0)) <= 0
    negative = (F.col("units").try_cast("double") < 0) | (F.col("asp").try_cast("double") < 0)
    valid = numbers.is_numeric_text(F.col("units")) & numbers.is_numeric_text(F.col("asp"))
    d = inputs.withColumn("missing_inputs", F.when(F.size(missing) > 0, missing).when(unreviewed, F.array(F.lit("reviewed_assumption_refs"))).otherwise(F.expr("cast(array() as array<string>)")))
    d = d.withColumn("status", F.when(F.size("missing_inputs") > 0, "insufficient_inputs").when(~valid, "error").when(negative, "incompatible_inputs").otherwise("computed"))
    good = lambda c: F.when(F.col("status") == "computed", F.col(c))
    return d.withColumn("output", numbers.exact_product(good("units"), good("asp"))).withColumn("output_unit", good("currency"))


def reconciliations(claims: DataFrame) -> DataFrame:
    """Net income to operating cash flow, by document and period: always incomplete, with what is missing."""
    c = claims.where((F.col("record_kind") == "event_claim") & (F.col("balance_or_flow") == "flow"))
    refs = F.array_sort(F.array_compact(F.collect_set(F.when(F.col("metric_id").isin("net_income", "cfo"), F.col("record_id")))))
    by = c.groupBy("doc_id", "company_id", "scope_id", "reference_period").agg(refs.alias("input_refs"))
    return by.select(stable_id("REC", F.col("doc_id"), F.col("scope_id"), F.to_json("reference_period")).alias("reconciliation_id"), "doc_id", "company_id", "scope_id", "reference_period", "input_refs", F.lit("incomplete").alias("reconciliation_status"), F.array(*map(F.lit, ("noncash_adjustments", "working_capital_adjustments", "reconciliation_target_audit"))).alias("missing_inputs"))
