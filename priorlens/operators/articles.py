"""Provisional article classification: title markers, rule signals, event links and the queue for human reviewers.

Signals are candidates, never labels: what a person has to decide stays unknown or pending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .review import diverse_queue

# Patterns of title markers and the kinds of spans that are counted.
MARKERS = {
    "breaking_title_marker": r"[\[【(]\s*속보\s*[\]】)]",
    "opinion_title_marker": r"[\[【(][^\]】)]*(?:칼럼|사설|기고)[^\]】)]*[\]】)]",
    "interview_title_marker": r"[\[【(][^\]】)]*인터뷰[^\]】)]*[\]】)]",
}
COUNTED = {
    "quote_candidates": "quote_candidate",
    "number_unit_candidates": "number_unit_candidate",
    "period_candidates": "period_candidate",
    "attribution_cue_candidates": "attribution_cue_candidate",
}
SHORT = "short_body_manual_review"
ELIGIBLE = "local_diagnostics_pending_human"


def title_markers(title: Column) -> list[Column]:
    """A boolean column for each marker; a null title has none."""
    return [F.coalesce(title.rlike(p), F.lit(False)).alias(k) for k, p in MARKERS.items()]


def rule_signals(candidates: DataFrame, audits: DataFrame, sentences: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per candidate. candidates: candidate_id, doc_id, source_id, event_family_id, title; audits: candidate_id,
    revision_id, body_available, diagnostics, body_chars, missing_reason; sentences (doc_id, revision_id) and spans (doc_id,
    revision_id, kind_candidate). Without a body every count is null and a reason is given."""
    key = ["doc_id", "revision_id"]
    both = sentences.select(*key, F.lit("sentence").alias("kind_candidate")).unionByName(spans.select(*key, "kind_candidate"))
    n = both.groupBy(*key).agg(F.count_if(F.col("kind_candidate") == "sentence").alias("sentence_candidates"), *[F.count_if(F.col("kind_candidate") == v).alias(k) for k, v in COUNTED.items()])
    j = candidates.join(audits, "candidate_id", "left").join(n, key, "left").withColumn("body_available", F.coalesce("body_available", F.lit(False)))
    body = lambda c: F.when(F.col("body_available"), c)
    short = F.coalesce(F.col("diagnostics").contains(SHORT), F.lit(False))
    return j.select(
        "candidate_id", *key, "source_id", "event_family_id", *title_markers(F.col("title")), F.sha2(F.coalesce("title", F.lit("")), 256).alias("title_sha256"), "body_available", body(F.col("body_chars")).alias("body_chars"), body(short).alias("short_body_signal"),
        *[body(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("sentence_candidates", *COUNTED)], F.when(~F.col("body_available"), F.coalesce("missing_reason", F.lit("body_not_available"))).alias("missing_reason"), F.lit("rule_candidates_not_assessments").alias("signal_status"),
    )


def selected(candidates: DataFrame, audits: DataFrame, k: int = 20) -> DataFrame:
    """(candidate_id, human_review_rank) of the k candidates with an audited body that go to people: short bodies first, new
    families, then sources taken least often. candidates has ``input_order`` as well."""
    ok = F.coalesce("body_available", F.lit(False)) & (F.col("audit_status") == ELIGIBLE)
    rows = candidates.join(audits.select("candidate_id", "body_available", "audit_status", "diagnostics"), "candidate_id").where(ok)
    rows = rows.withColumn("short", F.coalesce(F.col("diagnostics").contains(SHORT), F.lit(False)))
    return diverse_queue(rows, k, key="candidate_id", family="event_family_id", source="source_id", order="input_order").select("candidate_id", F.col("position").alias("human_review_rank"))


def classification(candidates: DataFrame, audits: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row per candidate: what is known of access, and everything else as unknown until a person decides."""
    j = candidates.join(audits, "candidate_id", "left").join(chosen, "candidate_id", "left")
    body, picked = F.coalesce("body_available", F.lit(False)), F.col("human_review_rank").isNotNull()
    either = lambda a, b: F.when(body, a).otherwise(b)
    lack = F.coalesce("missing_reason", F.lit("body_not_available"))
    return j.select(
        "candidate_id", "doc_id", "revision_id", "source_id", "event_family_id", either("local_body_acquired", "body_not_acquired").alias("access_status"), either("unknown", "access_unusable").alias("eligibility"),
        either(F.lit("body_complete_scope_and_rights_review_pending"), lack).alias("eligibility_reason"), *[F.lit("unknown").alias(c) for c in ("editorial_genre", "urgency_format", "article_scope_assessment")], F.lit("unclear").alias("production_origin"),
        either("human_review_pending_rule_signals_only", "not_assessable_without_body").alias("assessment_status"), either("pending_human_review", "not_available").alias("body_completeness"),
        picked.alias("human_review_selected"), "human_review_rank", F.when(picked, "pending").otherwise(either("not_selected_this_batch", "not_available")).alias("human_review_status"),
    )


def event_links(candidates: DataFrame, audits: DataFrame) -> DataFrame:
    """One provisional link per candidate to its family; nothing about the claim is asserted."""
    j = candidates.join(audits.select("candidate_id", "body_available"), "candidate_id", "left")
    body = F.coalesce("body_available", F.lit(False))
    reason = F.when(body, "anchor_claim_and_article_span_alignment_pending").otherwise("body_not_available")
    return j.select("candidate_id", "doc_id", "event_family_id", F.lit("provisional_discovery_link_body_match_unverified").alias("link_status"), F.lit("uncertain").alias("article_event_role"), F.lit("uncertain").alias("claim_relation"), body.alias("body_available"), reason.alias("missing_reason"))


def reviewer_slots(candidates: DataFrame, chosen: DataFrame, prefix: str, reviewers: int = 2) -> DataFrame:
    """A pending slot for each chosen candidate and reviewer."""
    j = chosen.join(candidates, "candidate_id").withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(reviewers))))
    rank = F.col("human_review_rank")
    return j.select(F.format_string(prefix.replace("%", "%%") + "-%02d-R%d", rank, F.col("_r")).alias("review_slot_id"), "candidate_id", "doc_id", "source_id", "event_family_id", rank.alias("selection_rank"), F.concat(F.lit("human_reviewer_"), F.col("_r").cast("string")).alias("reviewer_slot"), F.lit("unassigned").alias("reviewer_name"), F.lit("pending").alias("review_status"))
