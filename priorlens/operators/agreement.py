"""Scoring and agreement: matches by location, field rates, bundles, confusion, span overlap, evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import ratio

# States that count as missing.
MISSING = ["", "unknown", "not_applicable", "not_assessed", "unable_to_judge"]


def observed(x: Column) -> Column:
    """Is a JSON-typed answer an observation? Zero, false and an empty list are; null and unknown states aren't."""
    plain = F.lower(F.regexp_replace(x, '^"|"$', ""))
    return F.coalesce(~((x == "null") | plain.isin(MISSING) | plain.startswith("unknown_") | plain.startswith("unresolved")), F.lit(False))


def typed_equal(a: Column, b: Column) -> Column:
    """Equality of JSON texts, so that 0 isn't false and 1.0 isn't 1.00; nulls are equal."""
    return a.eqNullSafe(b)


def pair_summary(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Agreement over all pairs, over observed ones, and where the two differ about missingness."""
    oa, ob = observed(F.col(a)), observed(F.col(b))
    same = typed_equal(F.col(a), F.col(b))
    g = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("all_pairs"), F.count_if(same).alias("exact"), F.count_if(oa & ob).alias("observed_pairs"), F.count_if(oa & ob & same).alias("observed_exact"),
        F.count_if(~oa & ~ob).alias("excluded_state_pairs"), F.count_if(oa != ob).alias("missingness_disagreements"),
        F.count_if(F.col(a).isNull() & F.col(b).isNull()).alias("both_null"), F.count_if(F.col(a).isNull() != F.col(b).isNull()).alias("one_null"),
    )
    return g.withColumn("exact_rate", ratio(F.col("exact"), F.col("all_pairs"))["value"]).withColumn("observed_rate", ratio(F.col("observed_exact"), F.col("observed_pairs"))["value"])


def confusion(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    return pairs.groupBy(*by, F.coalesce(a, F.lit("null")).alias("a"), F.coalesce(b, F.lit("null")).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def tuple_agreement(pairs: DataFrame, item: str, a: str = "a", b: str = "b") -> DataFrame:
    """Per item: are all fields equal, all observed ones equal, and all fields observed and equal?"""
    both, same = observed(F.col(a)) & observed(F.col(b)), typed_equal(F.col(a), F.col(b))
    by = pairs.groupBy(item).agg(F.bool_and(same).alias("w"), F.bool_and(F.when(both, same)).alias("p"), F.bool_and(both & same).alias("f"))
    return by.agg(F.count(F.lit(1)).alias("items"), F.count_if("w").alias("whole"), F.count_if("p").alias("observed_projection"), F.count_if("f").alias("fully_observed"))


def dual(rows: DataFrame, item: str, annotator: str, value: str, first: str, second: str) -> DataFrame:
    """One row per item and field with both annotators' answers; an item without both is left out."""
    keys = [c for c in rows.columns if c not in (annotator, value)]
    return rows.groupBy(*keys).pivot(annotator, [first, second]).agg(F.first(value)).withColumnRenamed(first, "a").withColumnRenamed(second, "b").join(rows.groupBy(item).agg(F.count_distinct(F.when(F.col(annotator).isin(first, second), F.col(annotator))).alias("_n")).where("_n = 2").select(item), item, "left_semi")


def adjudicated(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adds outcome and value: equal answers are taken, one missing side yields to the other, a conflict stays open."""
    oa, ob = observed(F.col(a)), observed(F.col(b))
    return pairs.withColumn("outcome", F.when(typed_equal(F.col(a), F.col(b)), "agreed").when(oa & ~ob, "first_only").when(ob & ~oa, "second_only").when(~oa & ~ob, "both_missing").otherwise("conflict")).withColumn("value", F.when(F.col("outcome").isin("agreed", "first_only"), F.col(a)).when(F.col("outcome") == "second_only", F.col(b)))


def located(rows: DataFrame, evidence: str = "evidence", *keys: str) -> DataFrame:
    """Adds location_key: the keys and the sorted evidence (kind, location, start, end)."""
    e = F.array_sort(F.transform(evidence, lambda x: F.struct(x["kind"].alias("kind"), x["location"].alias("location"), x["start"].alias("start"), x["end"].alias("end"))))
    return rows.withColumn("location_key", F.sha2(F.to_json(F.struct(*[F.col(k) for k in keys], e.alias("e")), {"ignoreNullFields": "false"}), 256))


def matched(references: DataFrame, predictions: DataFrame, fields: list[str], *, item="item_id", prediction="prediction_id", valid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """One-to-one matches by location_key. Returns (matches by reference with status, unmatched predictions). A key with
    several predictions is a tie and matches none; a reference key that comes twice is refused."""
    # counted where they are sorted for the join, so references are made once
    alike = references.where(F.col("location_key").isNotNull()).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("location_key")))
    refs = alike.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit("duplicate reference location key"))).otherwise(F.lit(True)))
    p = predictions.withColumn("_valid", F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True))
    one = p.groupBy("location_key").agg(F.count(F.lit(1)).alias("_c"), F.min_by(F.struct(prediction, "_valid", *fields), prediction).alias("_p"))
    m = refs.join(one, "location_key", "left").where("_ok")
    status = F.when(F.col("_c").isNull(), "missing").when(F.col("_c") > 1, "tie_conflict").otherwise("matched")
    hit = F.col("_c") == 1
    out = m.select(item, "location_key", status.alias("match_status"), F.when(hit, F.col(f"_p.{prediction}")).alias(prediction), F.coalesce(F.when(hit, F.col("_p._valid")), F.lit(False)).alias("prediction_valid"), *[F.col(f).alias(f"expected_{f}") for f in fields], *[F.when(hit, F.col(f"_p.{f}")).alias(f"predicted_{f}") for f in fields])
    extra = predictions.join(out.where(F.col(prediction).isNotNull()).select(prediction), prediction, "left_anti")
    return out, extra


def field_rates(matches: DataFrame, fields: list[str], by: list[str] = ()) -> DataFrame:
    """field, numerator, denominator, missing, invalid, value (null over no reference)."""
    cells = ", ".join(f"'{f}', cast(expected_{f} as string), cast(predicted_{f} as string)" for f in fields)
    long = matches.select(*by, "match_status", "prediction_valid", F.expr(f"stack({len(fields)}, {cells}) as (field, expected, predicted)"))
    same = F.col("prediction_valid") & F.col("expected").eqNullSafe(F.col("predicted"))
    g = long.groupBy(*by, "field").agg(F.count_if(same).alias("numerator"), F.count(F.lit(1)).alias("denominator"), F.count_if(F.col("match_status") != "matched").alias("missing_prediction"), F.count_if((F.col("match_status") == "matched") & ~F.col("prediction_valid")).alias("invalid_prediction"))
    return g.withColumn("value", ratio(F.col("numerator"), F.col("denominator"))["value"])


def bundle_rate(matches: DataFrame, fields: list[str]) -> DataFrame:
    """Items whose known fields are all equal."""
    known = [F.when(F.col(f"expected_{f}").isNotNull(), F.col(f"expected_{f}").eqNullSafe(F.col(f"predicted_{f}"))) for f in fields]
    every = F.forall(F.array_compact(F.array(*known)), lambda x: x) & (F.size(F.array_compact(F.array(*known))) > 0) & F.col("prediction_valid")
    return matches.agg(F.count_if(every).alias("numerator"), F.count(F.lit(1)).alias("denominator")).withColumn("value", ratio(F.col("numerator"), F.col("denominator"))["value"])


def span_overlap(pairs: DataFrame, by: list[str] = (), rs="ref_start", re_="ref_end", ps="pred_start", pe="pred_end") -> DataFrame:
    """Micro (over characters) and macro (mean over pairs) overlap F1 of spans; a null prediction overlaps nothing."""
    inter = F.coalesce(F.greatest(F.lit(0), F.least(re_, pe) - F.greatest(rs, ps)), F.lit(0))
    inter = F.when(F.col(ps).isNull() | F.col(pe).isNull(), F.lit(0)).otherwise(inter)
    size = (F.col(re_) - F.col(rs)) + F.coalesce(F.col(pe) - F.col(ps), F.lit(0))
    g = pairs.groupBy(*by).agg(F.sum(inter).alias("intersection"), F.sum(F.col(re_) - F.col(rs)).alias("reference_chars"), F.coalesce(F.sum(F.col(pe) - F.col(ps)), F.lit(0)).alias("predicted_chars"), F.count_if((F.col(rs) == F.col(ps)) & (F.col(re_) == F.col(pe))).alias("span_exact"), F.count(F.lit(1)).alias("spans"), F.avg(F.try_divide(2 * inter, size)).alias("macro_f1"))
    return g.withColumn("micro_f1", F.try_divide(2 * F.col("intersection"), F.col("reference_chars") + F.col("predicted_chars")))


def readiness(gold: int, independent: int, rights: bool) -> dict[str, object]:
    """May an independent metric be stated at all?"""
    reasons = [r for bad, r in ((not gold, "no_human_gold"), (not independent, "no_independent_documents"), (not rights, "rights_not_confirmed")) if bad]
    return {"ready": not reasons, "reasons": reasons}


def method_agreement(results: DataFrame, key: list[str], method: str, value: str, first: str, second: str) -> DataFrame:
    """Do two methods select the same? One row of counts."""
    p = results.groupBy(*key).pivot(method, [first, second]).agg(F.first(value))
    a, b = F.col(f"`{first}`"), F.col(f"`{second}`")
    return p.agg(F.count(F.lit(1)).alias("queries"), F.count_if(a.eqNullSafe(b)).alias("same"), F.count_if(a.isNotNull() & b.isNotNull() & (a == b)).alias("same_selected"))
