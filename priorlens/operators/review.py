"""Review features, orderings, cards, diverse queues and samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.reasons import codes, merged
from ..sources.store import stored

# Review groups in their order; reasons that every candidate has.
GROUP_ORDER = ["scope_availability", "segment_definition", "relation_validity", "evidence_review"]
ALWAYS = ["human_review_missing", "selected_evidence_only", "publication_time_unknown", "date_conflict_not_audited"]
NOT_MISSING = ["not_applicable", "not_applicable_to_numeric_claim", "not_applicable_to_reporting_relation"]


def review_items(claims: DataFrame, links: DataFrame, changes: DataFrame | None = None, segment_prefix: str = "segment") -> DataFrame:
    """One item per claim: group, reasons, counts. links: candidate_relation_id, candidate_claim_id (a relation shares its
    claim's group). changes: change records, by new_record_id. Scores stay null: position is no materiality."""
    retrospective = (F.coalesce(F.size("availability_dependencies"), F.lit(0)) > 0) | F.coalesce(F.col("scope_status_as_of") == "unresolved_retrospective_dependency", F.lit(False))
    segment = F.coalesce(F.col("definition_version").startswith(segment_prefix), F.lit(False))
    relation = F.col("record_kind") == "business_relation"
    d = claims.join(links.select(F.col("candidate_relation_id").alias("record_id"), "candidate_claim_id"), "record_id", "left")
    if changes is not None:
        by = changes.groupBy(F.col("new_record_id").alias("record_id")).agg(F.array_sort(F.collect_set("change_id")).alias("change_ids"), F.count_if(F.col("status") == "computed").alias("computed"), F.bool_and(F.when(F.col("status") == "computed", F.col("historical_eligible"))).alias("_hist"))
        d = d.join(by, "record_id", "left")
    else:
        d = d.withColumn("change_ids", F.lit(None).cast("array<string>")).withColumn("computed", F.lit(None).cast("long")).withColumn("_hist", F.lit(None).cast("boolean"))
    connected = F.coalesce(F.size("change_ids"), F.lit(0)) > 0
    reasons = merged(F.array(*map(F.lit, ALWAYS)), codes((retrospective, "retrospective_scope_dependency"), (~retrospective & segment, "presentation_definition_requires_review"), (relation, "relation_validity_unknown"), (relation, "shared_numeric_evidence"), (connected, "comparison_conditions_checked")))
    return d.select(
        "record_id", "record_kind", "event_family_id", "doc_id", "published_date", stable_id("RI", F.col("record_id")).alias("review_item_id"), stable_id("RG", F.coalesce("candidate_claim_id", "record_id")).alias("review_group_id"),
        F.when(retrospective, "scope_availability").when(segment, "segment_definition").otherwise("evidence_review").alias("reason_group"), reasons.alias("review_reasons"),
        (~retrospective).alias("historical_eligible"), (F.coalesce(F.size("evidence_refs"), F.lit(0)) > 0).alias("evidence_linked"),
        F.size(F.filter(F.coalesce(F.map_values("field_missing_reasons"), F.expr("cast(array() as array<string>)")), lambda v: ~v.isin(NOT_MISSING))).alias("missing_field_count"),
        F.coalesce("change_ids", F.expr("cast(array() as array<string>)")).alias("change_source_refs"), F.coalesce(F.col("_hist") & (F.col("computed") > 0), F.lit(False)).alias("change_historical_eligible"),
        F.when(F.lit(changes is None), "not_yet_checked").when(~connected, "no_change_record_in_limited_corpus").alias("change_missing_reason"), F.lit("needs_review").alias("review_readiness"), F.lit(None).cast("double").alias("materiality_score"),
    )


def positions(items: DataFrame, order: list[str] = GROUP_ORDER, *, group="reason_group", date="published_date", key="record_id") -> DataFrame:
    """Adds chronological_position and grouped_position: dates ascending, unknown last, ties by key; groups by their place
    in ``order``. Both are total orders of the table, so ranks come from range-partitioned sorts (see ``ranked``)."""
    out = ranked(items, [F.col(date).asc_nulls_last(), F.col(key)], "chronological_position")
    place = F.array_position(F.array(*map(F.lit, order)), F.col(group))
    return ranked(out.withColumn("_place", place), [F.col("_place"), F.col(date).asc_nulls_last(), F.col(key)], "grouped_position").drop("_place")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """A row number over the whole table without a one-task window: rows are range-partitioned and written once with the
    number of their partition, counted by it, and numbered from its start. Counting and numbering must read the same dealing:
    two exchanges of one table may draw their borders from different samples. The number of partitions bounds the starts."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    w = Window.partitionBy("_part").orderBy(*order)
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # a row per partition
    starts = counts.withColumn("_start", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_start", F.lit(0)).alias("_start"))
    return parts.withColumn("_rn", F.row_number().over(w)).join(F.broadcast(starts), "_part").withColumn(name, (F.col("_rn") + F.col("_start")).cast("long")).drop("_part", "_rn", "_start")


def cards(items: DataFrame, claims: DataFrame, changes: DataFrame) -> DataFrame:
    """One card per review group: candidates, families, changes, priors, reasons; sets sorted."""
    by_item = items.groupBy("review_group_id").agg(F.array_sort(F.collect_set("record_id")).alias("candidate_refs"), F.array_sort(F.collect_set("event_family_id")).alias("event_family_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("review_reasons")))).alias("review_reasons"), F.array_sort(F.collect_set(F.when(F.col("record_kind") == "business_relation", F.col("record_id")))).alias("business_relation_refs"))
    of = items.select("record_id", "review_group_id")
    ch = changes.join(of, changes["new_record_id"] == of["record_id"]).groupBy("review_group_id").agg(F.array_sort(F.collect_set("change_id")).alias("change_refs"), F.array_sort(F.collect_set("prior_record_id")).alias("prior_fact_refs"), F.bool_or(F.col("compatibility.decision") == "not_comparable").alias("_nc"))
    facts = claims.join(of, "record_id").groupBy("review_group_id").agg(F.array_sort(F.collect_list(F.struct((F.col("record_kind") != "event_claim").alias("rank"), "record_id", "numeric_value", "scope_id"))).alias("facts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("evidence_refs", F.expr("cast(array() as array<string>)")))))).alias("evidence_ids"))
    out = by_item.join(ch, "review_group_id", "left").join(facts, "review_group_id", "left")
    none = F.expr("cast(array() as array<string>)")
    out = out.select(stable_id("CARD", F.col("review_group_id")).alias("card_id"), "review_group_id", "candidate_refs", "event_family_ids", "facts", "evidence_ids", F.coalesce("change_refs", none).alias("change_refs"), F.coalesce("prior_fact_refs", none).alias("prior_fact_refs"), "business_relation_refs", "review_reasons", F.when(F.col("_nc"), "not_comparable").otherwise("needs_review").alias("comparison_readiness"), F.lit("needs_review").alias("review_readiness"), F.lit(None).cast("double").alias("materiality_score"))
    return out.withColumn("card_version", F.sha2(F.to_json(F.struct(*sorted(out.columns)), {"ignoreNullFields": "false"}), 256))


def card_checks(built: DataFrame, ids: DataFrame) -> DataFrame:
    """One row of booleans: cards unique, every candidate in one card, readiness kept, versions intact."""
    exploded = built.select("card_id", F.explode("candidate_refs").alias("record_id"))
    placed = exploded.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))
    joined = placed.join(ids.select("record_id").distinct().withColumn("_in", F.lit(True)), "record_id", "full_outer")
    once = joined.agg(F.coalesce(F.bool_and(F.coalesce(F.col("n") == 1, F.lit(False)) & F.col("_in").isNotNull()), F.lit(True)).alias("every_candidate_once"))
    columns = sorted(c for c in built.columns if c != "card_version")
    own = built.agg((F.count(F.lit(1)) == F.count_distinct("card_id")).alias("unique_cards"), F.coalesce(F.bool_and((F.col("review_readiness") == "needs_review") & F.col("materiality_score").isNull()), F.lit(True)).alias("candidate_status_preserved"), F.coalesce(F.bool_and(F.col("card_version") == F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)), F.lit(True)).alias("version_integrity"))
    return own.join(F.broadcast(once), F.lit(True))


def diverse_queue(items: DataFrame, k: int = 20, *, key="record_id", family="family", source="source", short="short", order="ord") -> DataFrame:
    """The greedy queue of at most k: short ones first, then new families, then the source taken least often, then order.

    Only rows that can win a step are looked at: of every (source, short) the first k rows that begin a family and the first
    k others. If these are few, one task chooses; with very many sources each step is an aggregate over them instead."""
    w = Window.partitionBy(source, short, family).orderBy(order, key)
    best = items.withColumn("_r", F.row_number().over(w) == 1)
    w = Window.partitionBy(source, short, "_r").orderBy(order, key)
    best = best.withColumn("_q", F.row_number().over(w)).where(F.col("_q") <= k).select(key, family, source, short, order)
    best = stored(best, "queue")
    kind = items.schema[key].dataType.simpleString()
    if best.limit(ONE_TASK + 1).count() > ONE_TASK:
        return best.sparkSession.createDataFrame([(x, i) for i, x in enumerate(_stepwise(best, k, key, family, source, short, order), 1)], f"{key} {kind}, position int")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.sort_values([order, key]).to_dict("records")
        families, taken, out = set(), {}, []
        while left and len(out) < k:
            x = min(left, key=lambda r: (not r[short], r[family] in families, taken.get(r[source], 0), r[order], r[key]))
            left.remove(x)
            families.add(x[family])
            taken[x[source]] = taken.get(x[source], 0) + 1
            out.append({key: x[key], "position": len(out) + 1})
        return pd.DataFrame(out, columns=[key, "position"])

    return best.groupBy().applyInPandas(choose, f"{key} {kind}, position int")


#: Rows from which one task chooses a diverse queue.
ONE_TASK = 50_000


def _stepwise(rows: DataFrame, k: int, key: str, family: str, source: str, short: str, order: str) -> list:
    families, taken, out = [], {}, []
    while len(out) < k:
        seen = F.coalesce(F.col(family).isin([x for x in families if x is not None]), F.lit(None in families)) if families else F.lit(False)
        times = F.lit(0)
        for s, n in taken.items():
            times = F.when(F.col(source).eqNullSafe(F.lit(s)), n).otherwise(times)
        left = rows.where(~F.col(key).isin(out)) if out else rows
        x = left.agg(F.min(F.struct((~F.col(short)).alias("a"), seen.alias("b"), times.alias("c"), F.col(order).alias("d"), F.col(key).alias("e"), F.col(family).alias("f"), F.col(source).alias("s"))).alias("x")).first()["x"]
        if x is None:
            break
        out.append(x["e"])
        families.append(x["f"])
        taken[x["s"]] = taken.get(x["s"], 0) + 1
    return out


def round_robin(df: DataFrame, group: str, order: list[Column | str], limit: int) -> DataFrame:
    """The first of every group, then the second of every group, and so on, up to a limit."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit).orderBy("turn", group).limit(limit)
