"""Evaluation of one run: what each system shows, counts by mode, failures, and what the retrieval methods select."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The systems that have a result, and why others have none.
NOT_EVALUATED = {"S2": "independent_train_dev_human_labels_absent", "S4": "ai_external_transfer_rights_and_budget_not_established", "S5": "ai_external_transfer_rights_and_budget_not_established"}


def systems(facts: DataFrame, cards: DataFrame) -> DataFrame:
    """A row per system: records shown, candidates covered, and whether these are all the facts. S0 shows facts by date, S1 the
    ranked candidates, S3 the cards; the others aren't evaluated. facts: record_id, ranked (boolean); cards: candidate_refs."""
    f = facts.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("ids"), F.count_if("ranked").alias("r"), F.count_distinct(F.when(F.col("ranked"), F.col("record_id"))).alias("rids"))
    held = cards.select(F.explode("candidate_refs").alias("record_id")).distinct()
    c = cards.agg(F.count(F.lit(1)).alias("cards")).crossJoin(held.join(facts.select("record_id").distinct(), "record_id", "left_semi").agg(F.count(F.lit(1)).alias("covered"))).crossJoin(held.agg(F.count(F.lit(1)).alias("held")))
    one = f.crossJoin(c)  # each side is one row
    row = lambda s, n, k, unit, ok: F.struct(F.lit(s).alias("system"), F.lit("executed_development").alias("status"), n.alias("records"), k.alias("covered_candidates"), F.lit(unit).alias("unit"), ok.alias("same_universe"), F.lit("exposed_development_not_independent").alias("reason"))
    none = lambda s, why: F.struct(F.lit(s).alias("system"), F.lit("not_evaluated").alias("status"), F.lit(None).cast("long").alias("records"), F.lit(None).cast("long").alias("covered_candidates"), F.lit("not_applicable").alias("unit"), F.lit(None).cast("boolean").alias("same_universe"), F.lit(why).alias("reason"))
    rows = [row("S0", F.col("n"), F.col("ids"), "candidate", F.lit(True)), row("S1", F.col("r"), F.col("rids"), "candidate", F.col("rids") == F.col("ids")), row("S3", F.col("cards"), F.col("covered"), "card", (F.col("covered") == F.col("ids")) & (F.col("held") == F.col("ids")))]
    return one.select(F.explode(F.array(*rows, *[none(s, w) for s, w in NOT_EVALUATED.items()])).alias("x")).select("x.*")


def failure_cases(changes: DataFrame, calculations: DataFrame | None = None) -> DataFrame:
    """Everything that wasn't computed: changes by compatibility or time, calculations by their inputs."""
    out = changes.where("status <> 'computed'").select(F.col("change_id").alias("case_id"), F.lit("compatibility_or_time").alias("stage"), F.lit("change_result").alias("unit"), "cutoff_mode", "status", "reasons", "comparison_basis")
    if calculations is not None:
        c = calculations.where("status <> 'computed'")
        out = out.unionByName(c.select(F.col("calculation_id").alias("case_id"), F.lit("calculation").alias("stage"), F.lit("formula_attempt").alias("unit"), "cutoff_mode", "status", F.concat("reasons", "missing_inputs").alias("reasons"), F.lit(None).cast("string").alias("comparison_basis")))
    return out


def retrieval_ablation(results: DataFrame, first: str = "exact_key", second: str = "local_label_tfidf") -> DataFrame:
    """Per query and mode what the two methods select and whether it is the same; no recall, since nothing is judged."""
    p = results.groupBy("new_record_id", "cutoff_mode").pivot("method", [first, second]).agg(F.first("selected_record_id"))
    a, b = F.col(f"`{first}`"), F.col(f"`{second}`")
    return p.select(F.col("new_record_id").alias("record_id"), "cutoff_mode", a.alias("exact_selected"), b.alias("sparse_selected"), a.eqNullSafe(b).alias("selection_equal"), F.lit(False).alias("independent_qrels"), F.lit("empty_qrels_not_true_no_answer").alias("metric_reason"))
