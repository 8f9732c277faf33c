"""Feedback on cards: validation in a fixed order of reasons, idempotent import, conflicts, resolutions, snapshots.

A journal is an append-only table of accepted events; conflicts and snapshots are derived from it and can be rebuilt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.reasons import first

# Allowed actions with their fields, and reason codes.
FIELDS_OF = {"confirm": ["review_status"], "irrelevant": ["review_status"], "investigate": ["review_status"], "correct_fact": ["numeric_value", "scope_id", "reference_period"], "update_assumption": ["assumption_status"]}
EXPECTED = {"confirm": "confirmed_candidate", "irrelevant": "irrelevant_candidate", "investigate": "investigate_candidate"}
REASON_CODES = ["source_checked", "value_mismatch", "scope_or_period_mismatch", "needs_more_evidence", "not_relevant", "assumption_changed"]
ASSUMPTION = ["proposed", "withheld", "needs_review"]
IDENTITY = r"^[A-Za-z0-9_.:-]{1,100}$"
PAYLOAD = ["feedback_id", "idempotency_key", "source_run", "card_id", "card_version", "actor_id", "action", "field", "before", "after", "evidence_refs", "reason_code", "created_at"]
MAX_EVENTS, MAX_BYTES = 200, 512_000


def validated(events: DataFrame, cards: DataFrame, run_id: str, scopes: list[str]) -> DataFrame:
    """Adds ``rejection``, the first rule that an event breaks, or null. cards: card_id, card_version, numeric_value, scope_id,
    reference_period (JSON text), evidence_ids."""
    c = cards.select("card_id", F.col("card_version").alias("_v"), F.col("numeric_value").alias("_nv"), F.col("scope_id").alias("_sc"), F.col("reference_period").alias("_rp"), F.col("evidence_ids").alias("_ev"))
    e = events.join(c, "card_id", "left")
    field, action, after = F.col("field"), F.col("action"), F.col("after")
    base = F.when(field == "review_status", "needs_review").when(field == "numeric_value", F.col("_nv")).when(field == "scope_id", F.col("_sc")).when(field == "reference_period", F.col("_rp"))
    allowed = F.coalesce(*[F.when(action == a, field.isin(f)) for a, f in FIELDS_OF.items()], F.lit(False))
    fixed = F.coalesce(*[F.when(action == a, ~after.eqNullSafe(F.lit(v))) for a, v in EXPECTED.items()], F.lit(False))
    cited = F.size(F.array_intersect("evidence_refs", "_ev")) > 0
    p = F.from_json(after, "period_start string, period_end string, as_of_date string, period_kind string, period_basis string")
    bad_day = lambda x: x.isNotNull() & x.try_cast("date").isNull()
    no = lambda x: F.coalesce(~x, F.lit(True))
    rule = first(
        (F.col("_v").isNull(), "unknown_card"), (no(F.col("source_run") == run_id), "wrong_source_run"), (no(F.col("card_version") == F.col("_v")), "stale_card_version"),
        (no(action.isin(list(FIELDS_OF))) | no(field.isin(sorted({f for v in FIELDS_OF.values() for f in v}))), "unsupported_action_or_field"),
        (~F.col("before").eqNullSafe(base), "forged_before"),
        (no(F.col("actor_id").rlike(IDENTITY) & F.col("feedback_id").rlike(IDENTITY) & F.col("idempotency_key").rlike(IDENTITY)), "invalid_identity"),
        (no(F.col("created_at").rlike(r"(Z|[+-]\d{2}:?\d{2})$")), "time_offset_required"),
        (F.try_to_timestamp(F.regexp_replace("created_at", "Z$", "+00:00")).isNull(), "invalid_time"),
        (F.col("evidence_refs").isNull() | (F.size(F.array_except("evidence_refs", F.coalesce("_ev", F.expr("cast(array() as array<string>)")))) > 0), "unknown_evidence"),
        (no(F.col("reason_code").isin(REASON_CODES)), "reason_not_allowlisted"), (~allowed, "action_field_mismatch"), (fixed, "invalid_review_value"),
        ((field == "numeric_value") & no(after.rlike(r"^-?\d{1,30}(\.\d{1,28})?$")), "invalid_decimal"), ((field == "numeric_value") & no(cited), "correction_evidence_required"),
        ((field == "scope_id") & no(after.isin(scopes)), "unknown_scope"),
        ((field == "reference_period") & (p.isNull() | bad_day(p["period_start"]) | bad_day(p["period_end"]) | bad_day(p["as_of_date"])), "period_fields"),
        ((field == "reference_period") & no(p["period_kind"].isin("quarter", "annual", "instant") & (p["period_basis"] == "fiscal")), "period_type"),
        ((field == "reference_period") & (p["period_start"] > p["period_end"]), "period_order"), ((field == "reference_period") & no(cited), "correction_evidence_required"),
        ((field == "assumption_status") & no(after.isin(ASSUMPTION)), "assumption_value"), (after.eqNullSafe(F.col("before")), "no_change"),
    )
    return e.withColumn("rejection", rule).drop("_v", "_nv", "_sc", "_rp", "_ev")


def imported(events: DataFrame, journal: DataFrame, order: str = "event_index") -> DataFrame:
    """Adds ``result`` to validated events: accepted, duplicate, or rejected with the reason in ``rejection``. The first valid
    event of an idempotency key in the order counts; the same payload again is a duplicate, another one an error."""
    payload = F.sha2(F.to_json(F.struct(*PAYLOAD), {"ignoreNullFields": "false"}), 256)
    e = events.withColumn("_p", payload).withColumn("_valid", F.col("rejection").isNull())
    old = journal.select("idempotency_key", payload.alias("_old"))
    ids = journal.select("feedback_id").distinct().withColumn("_taken", F.lit(True))
    e = e.join(old, "idempotency_key", "left").join(ids, "feedback_id", "left")
    w = Window.partitionBy("idempotency_key").orderBy(F.desc("_valid"), order)
    e = e.withColumn("_first", F.coalesce("_old", F.first("_p").over(w))).withColumn("_again", F.col("_old").isNotNull() | (F.row_number().over(w) > 1))
    fresh = F.col("_valid") & ~F.col("_again")
    w = Window.partitionBy("feedback_id").orderBy(F.desc("_f"), order)
    e = e.withColumn("_f", fresh).withColumn("_rn", F.row_number().over(w))
    reason = F.when(~F.col("_valid"), F.col("rejection")).when(F.col("_again") & (F.col("_p") != F.col("_first")), "idempotency_payload_conflict").when(~F.col("_again") & (F.col("_taken").isNotNull() | (F.col("_rn") > 1)), "feedback_id_collision")
    e = e.withColumn("rejection", reason)
    return e.withColumn("result", F.when(F.col("rejection").isNotNull(), "rejected").when(F.col("_again"), "duplicate").otherwise("accepted")).drop("_p", "_valid", "_old", "_taken", "_first", "_again", "_f", "_rn")


def conflicts(journal: DataFrame) -> DataFrame:
    """Card versions and fields for which accepted events name different values; one row each with the event ids."""
    by = journal.groupBy("card_id", "card_version", "field").agg(F.count_distinct(F.coalesce("after", F.lit("\u0000null"))).alias("values"), F.array_sort(F.collect_set("feedback_id")).alias("feedback_ids")).where("values > 1")
    return by.select(stable_id("CONFLICT", F.col("card_id"), F.col("card_version"), F.col("field")).alias("conflict_id"), "card_id", "card_version", "field", "values", "feedback_ids", F.lit("unresolved").alias("status"))


def marked(journal: DataFrame) -> DataFrame:
    """Adds review_status: an event whose value differs from an earlier one of its card version and field is a conflict candidate."""
    w = Window.partitionBy("card_id", "card_version", "field").orderBy("event_index").rowsBetween(Window.unboundedPreceding, -1)
    a = F.coalesce("after", F.lit("\u0000null"))
    return journal.withColumn("review_status", F.when((F.min(a).over(w) != a) | (F.max(a).over(w) != a), "conflict_candidate").otherwise("candidate"))


def resolved(found: DataFrame, journal: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions: conflict_id, decision (adopt, merge, defer), selected (array of feedback ids), owner. Adds ``rejection``."""
    values = found.select("conflict_id", F.explode("feedback_ids").alias("feedback_id")).join(journal.select("feedback_id", "after"), "feedback_id").groupBy("conflict_id").agg(F.map_from_entries(F.collect_set(F.struct("feedback_id", "after"))).alias("_after"))
    d = decisions.join(found.select("conflict_id", "feedback_ids"), "conflict_id", "left").join(values, "conflict_id", "left")
    chosen = F.array_distinct(F.transform("selected", lambda s: F.coalesce(F.element_at("_after", s), F.lit("\u0000null"))))
    rule = first((~F.col("decision").isin("adopt", "merge", "defer") | ~F.coalesce(F.col("owner").rlike(IDENTITY), F.lit(False)), "invalid_resolution"), (F.col("feedback_ids").isNull() | (F.size(F.array_except("selected", "feedback_ids")) > 0), "unknown_conflict_or_feedback"), ((F.col("decision") == "adopt") & (F.size("selected") != 1), "select_one_feedback"), ((F.col("decision") == "merge") & (F.size("selected") < 2), "merge_requires_multiple"), ((F.col("decision") == "merge") & (F.size(chosen) > 1), "merge_requires_equal_values_submit_new_revision_for_other_values"))
    return d.withColumn("rejection", rule).drop("_after", "feedback_ids")


def snapshot(journal: DataFrame, cards: DataFrame) -> DataFrame:
    """Events whose card still has the version they were made for."""
    return journal.join(cards.select("card_id", "card_version"), ["card_id", "card_version"], "left_semi")
