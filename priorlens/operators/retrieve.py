"""Prior retrieval as of a cutoff: candidates by key, eligibility, sparse scores, ranks, and a choice only if it is unique.

Candidates meet by an equi-join on (company, record kind, metric or relation, and for the exact method the scope), so the
work follows the sizes of the keys and not of the table; scores, ranks and the choice are aggregates and windows by query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import asof, text
from ..functions.ids import stable_id
from ..functions.reasons import codes, merged
from ..sources.store import stored
from .compare import POLICY, basis_of, changes, compatible, is_relation

METHODS = ("exact_key", "local_label_tfidf")
REVIEW_CUTOFF = "2026-10-06"


def _claims(claims: DataFrame, name: str) -> DataFrame:
    return claims.select(F.struct(*[F.col(c) for c in claims.columns]).alias(name)).select(
        name, F.col(f"{name}.company_id").alias("k1"), F.col(f"{name}.record_kind").alias("k2"), F.coalesce(F.nullif(F.col(f"{name}.metric_id"), F.lit("")), F.col(f"{name}.relation_type")).alias("k3"), F.col(f"{name}.scope_id").alias("k4")
    )


def _tokens(c):
    return F.array_distinct(text.tokens(c["company_id"], c["scope_id"], c["metric_id"], c["relation_type"], c["definition_version"]))


def queries(claims: DataFrame, modes=asof.MODES, review_cutoff: str | None = None) -> DataFrame:
    """Each claim as a query in each mode, with its cutoffs."""
    q = _claims(claims, "new").withColumn("cutoff_mode", F.explode(F.array(*map(F.lit, modes))))
    prior = F.coalesce(F.nullif(F.col("new.published_at"), F.lit("")), F.col("new.published_date"))
    review = F.lit(review_cutoff or REVIEW_CUTOFF)
    q = q.withColumn("prior_cutoff", prior).withColumn("cutoff", F.when(F.col("cutoff_mode") == "current_review", review).otherwise(F.coalesce(F.lit(review_cutoff), prior)))
    return q.withColumn("query_reasons", asof.availability(F.col("new"), F.col("cutoff_mode"), F.col("cutoff")))


def candidates(claims: DataFrame, method: str = "exact_key", modes=asof.MODES, review_cutoff: str | None = None) -> DataFrame:
    """One row per query and candidate: new, old, cutoff_mode, cutoff, exclusions, comparison_basis, compatibility, score, rank."""
    q, old = queries(claims, modes, review_cutoff), _claims(claims, "old")
    keys = ["k1", "k2", "k3", "k4"] if method == "exact_key" else ["k1", "k2", "k3"]
    c = q.join(old.drop(*({"k4"} - set(keys))), keys).where(F.col("new.record_id") != F.col("old.record_id"))
    n, o = F.col("new"), F.col("old")
    published = F.coalesce(*[F.nullif(o[k], F.lit("")) for k in ("revision_published_at", "revision_published_date", "published_at", "published_date")])
    earlier = F.when(F.col("prior_cutoff").isNull(), F.lit("query_publication_unknown")).otherwise(asof.moment_before(published, F.col("prior_cutoff"), True)["reason"])
    exclusions = merged(codes((n["doc_id"].eqNullSafe(o["doc_id"]), "same_release_not_independent_prior")), F.array_compact(F.array(earlier)), asof.availability(o, F.col("cutoff_mode"), F.col("cutoff")))
    c = c.withColumn("exclusions", exclusions).withColumn("query_id", stable_id("Q", n["record_id"], F.col("cutoff_mode"), F.lit(method)))
    c = c.withColumn("comparison_basis", basis_of(n, o)).withColumn("compatibility", compatible(n, o, F.col("comparison_basis")))
    eligible = F.size("exclusions") == 0
    if method == "exact_key":
        c = c.withColumn("score", F.when(eligible, F.lit(1.0)))
    else:
        words = c.where(eligible).select("query_id", o["record_id"].alias("rid"), _tokens(n).alias("qt"), F.explode(_tokens(o)).alias("t"))
        df = words.groupBy("query_id", "t").agg(F.count(F.lit(1)).alias("df"))
        total = c.where(eligible).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        hits = words.where(F.array_contains("qt", F.col("t"))).join(df, ["query_id", "t"]).join(total, "query_id")
        scores = hits.groupBy("query_id", "rid").agg(F.sum(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("score"))
        c = c.join(scores, (c["query_id"] == scores["query_id"]) & (F.col("old.record_id") == scores["rid"]), "left").select(c["*"], F.when(eligible, F.coalesce("score", F.lit(0.0))).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), F.col("old.record_id"))
    return c.withColumn("rank", F.when(eligible, F.row_number().over(w))).withColumn("method", F.lit(method))


def retrieve(claims: DataFrame, method: str = "exact_key", modes=asof.MODES, review_cutoff: str | None = None, found: DataFrame | None = None) -> DataFrame:
    """One row per query: counts, status, selected_record_id, review_comparator_id."""
    q = queries(claims, modes, review_cutoff).withColumn("query_id", stable_id("Q", F.col("new.record_id"), F.col("cutoff_mode"), F.lit(method)))
    c = found if found is not None else candidates(claims, method, modes, review_cutoff)
    eligible, good = F.size("exclusions") == 0, (F.size("exclusions") == 0) & (F.col("compatibility.decision") == "comparable")
    same_kind = F.col("old.reference_period.period_kind").eqNullSafe(F.col("new.reference_period.period_kind"))
    by = c.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("universe"), F.count_if(eligible).alias("candidate_count"), F.count_if(~eligible).alias("excluded_count"), F.count_if(good).alias("comparable_count"),
        F.min_by(F.when(good, F.col("old.record_id")), F.when(good, F.col("rank"))).alias("_good"),
        F.min_by("old.record_id", F.when(eligible & same_kind, F.col("rank"))).alias("_aligned"), F.min_by("old.record_id", "rank").alias("_first"),
    )
    out = q.join(by, "query_id", "left").fillna(0, ["universe", "candidate_count", "excluded_count", "comparable_count"])
    ready = F.size("query_reasons") == 0
    selected = F.when((F.col("comparable_count") == 1) & ready, F.col("_good"))
    status = F.when(F.col("comparable_count") > 1, "ambiguous_compatible_priors").when(selected.isNotNull(), "selected").when(~ready, "query_unavailable").when(F.col("candidate_count") > 0, "all_candidates_incompatible").when(F.col("universe") > 0, "all_candidates_time_excluded").otherwise("no_hit_in_limited_corpus")
    return out.select("query_id", F.col("new.record_id").alias("new_record_id"), "cutoff_mode", "cutoff", F.lit(method).alias("method"), "universe", "candidate_count", "excluded_count", "comparable_count", status.alias("status"), selected.alias("selected_record_id"), F.coalesce(selected, F.when(F.col("candidate_count") > 0, F.coalesce("_aligned", "_first"))).alias("review_comparator_id"), "query_reasons")


def no_prior_changes(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Change records of queries without any comparator."""
    n = claims.select(F.struct(*claims.columns).alias("new"))
    q = results.where(F.col("review_comparator_id").isNull()).join(n, F.col("new_record_id") == F.col("new.record_id"))
    new = F.col("new")
    return q.select(
        stable_id("CH", new["record_id"], F.col("cutoff_mode"), F.lit("no-prior"), F.lit(POLICY)).alias("change_id"), "new_record_id", F.lit(None).cast("string").alias("prior_record_id"),
        F.when(is_relation(new), "relation_state").otherwise("prior_search").alias("comparison_basis"), "cutoff_mode", "cutoff", F.lit("withheld").alias("status"),
        merged(F.array("status"), F.col("query_reasons")).alias("reasons"), new["numeric_value"].alias("new_value"), F.lit(None).cast("string").alias("delta"), F.lit(None).cast("string").alias("relative_delta"),
        F.lit("prior_not_available").alias("relative_delta_missing_reason"), F.array(F.lit("prior_not_found_in_limited_corpus")).alias("change_types"), F.lit(False).alias("historical_eligible"),
    )


def all_changes(claims: DataFrame, modes=asof.MODES, review_cutoff: str | None = None, segment_scope: str | None = None) -> DataFrame:
    """Changes against the selected prior or the comparator kept for review, changes without any prior, and comparisons
    between the columns of one release (scopes that begin with ``segment_scope``)."""
    results = retrieve(claims, "exact_key", modes, review_cutoff)
    new, old = claims.select(F.struct(*claims.columns).alias("new")), claims.select(F.struct(*claims.columns).alias("old"))
    pairs = results.where(F.col("review_comparator_id").isNotNull()).join(new, F.col("new_record_id") == F.col("new.record_id")).join(old, F.col("review_comparator_id") == F.col("old.record_id"))
    pairs = pairs.select("new", "old", basis_of(F.col("new"), F.col("old")).alias("comparison_basis"), "cutoff_mode", "cutoff")
    out = changes(pairs)
    if segment_scope is not None:
        seg = _claims(claims.where((F.col("record_kind") == "event_claim") & F.col("scope_id").startswith(segment_scope)), "new")
        prev = seg.select(F.col("new").alias("old"), "k1", "k2", "k3", "k4", F.col("new.doc_id").alias("doc"), (F.col("new.reference_period.fiscal_year") + 1).alias("fy"))
        within = seg.withColumn("doc", F.col("new.doc_id")).withColumn("fy", F.col("new.reference_period.fiscal_year")).join(prev, ["k1", "k2", "k3", "k4", "doc", "fy"])
        within = within.withColumn("cutoff_mode", F.explode(F.array(*map(F.lit, modes))))
        cutoff = F.when(F.col("cutoff_mode") == "current_review", F.lit(review_cutoff or REVIEW_CUTOFF)).otherwise(F.coalesce(F.lit(review_cutoff), F.col("new.published_date")))
        out = out.unionByName(changes(within.select("new", "old", F.lit("within_release_comparison").alias("comparison_basis"), "cutoff_mode", cutoff.alias("cutoff"))))
    return out.unionByName(no_prior_changes(claims, results), allowMissingColumns=True)


def mode_summary(changed: DataFrame) -> DataFrame:
    """Attempted, computed and withheld changes by mode."""
    return changed.groupBy("cutoff_mode").agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("status") == "computed").alias("computed"), F.count_if(F.col("status") != "computed").alias("withheld"), F.count_if("historical_eligible").alias("historical_eligible"))


#: The share of an item's possible score that its most common tokens may make up to be left out of the first join, and how
#: many documents for each wanted one are scored in full to find the score to beat.
COMMON_SHARE, TRIALS = 0.3, 5


def top_by_tokens(asked: DataFrame, words: DataFrame, n_docs: int, k: int, *, item="item_id", doc="doc_id", token="t", common_share: float = COMMON_SHARE, trials: int = TRIALS) -> DataFrame:
    """item, doc, score, rank (from 1): the k documents with the highest sum of ln((N + 1) / (df + 1)) + 1 over the distinct
    tokens they share with an item, rounded to 4 places, ties to the smaller document. asked: item, token; words: doc, token;
    both without repeats.

    Exact, without bringing every document of a common token to every item that has it: an item's most common tokens, as far
    as they make up ``common_share`` of what it can score, are left out at first. The best ``trials`` x k documents by the
    other tokens are scored in full, and the k-th of these scores is to be beaten. Documents whose score so far and all left
    out tokens together don't reach it are dropped; those without any of the other tokens are out if the left out tokens alone
    don't reach it. Items for which they do are scored over all their tokens."""
    a, w = asked.select(F.col(item).alias("_i"), F.col(token).alias("_t")), stored(words.select(F.col(doc).alias("_d"), F.col(token).alias("_t")), "retrieve-words")
    df = w.join(a.select("_t").distinct(), "_t", "left_semi").groupBy("_t").agg(F.count(F.lit(1)).alias("_df"))
    per_item = Window.partitionBy("_i")
    x = a.join(df, "_t").withColumn("_idf", F.log((F.lit(n_docs) + 1) / (F.col("_df") + 1)) + 1)
    upto = F.sum("_idf").over(per_item.orderBy(F.desc("_df"), "_t").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = stored(x.withColumn("_rare", upto > common_share * F.sum("_idf").over(per_item)).drop("_df"), "retrieve-tokens")
    left_out = x.where("not _rare").groupBy("_i").agg(F.sum("_idf").alias("_rest"))
    partial = stored(x.where("_rare").join(w, "_t").groupBy("_i", "_d").agg(F.sum("_idf").alias("_s")), "retrieve-partial")

    def full(pairs: DataFrame) -> DataFrame:
        own = w.join(pairs.select("_d").distinct(), "_d", "left_semi")
        return pairs.select("_i", "_d").join(x.select("_i", "_t", "_idf"), "_i").join(own, ["_d", "_t"]).groupBy("_i", "_d").agg(F.sum("_idf").alias("_s"))

    nth = lambda n: F.row_number().over(per_item.orderBy(F.desc("_s"), "_d")) <= n
    tried = full(stored(partial.withColumn("_best", nth(trials * k)).where("_best").drop("_best"), "retrieve-trials"))
    beat = tried.withColumn("_r", F.row_number().over(per_item.orderBy(F.desc("_s"), "_d"))).where(F.col("_r") == k).select("_i", F.col("_s").alias("_beat"))
    # rounding can lift a score by half of the last place, so a whole one is given away
    bounds = stored(x.select("_i").distinct().join(left_out, "_i", "left").join(beat, "_i", "left").select("_i", F.coalesce("_rest", F.lit(0.0)).alias("_rest"), (F.col("_beat") - 1e-4).alias("_beat")), "retrieve-bounds")
    sure = F.coalesce(F.col("_rest") < F.col("_beat"), F.lit(False))
    some = full(partial.join(bounds.where(sure), "_i").where(F.col("_s") + F.col("_rest") >= F.col("_beat")))
    every = x.join(bounds.where(~sure).select("_i"), "_i", "left_semi").join(w, "_t").groupBy("_i", "_d").agg(F.sum("_idf").alias("_s"))
    score = some.unionByName(every).select(F.col("_i").alias(item), F.col("_d").alias(doc), F.round("_s", 4).alias("score"))
    return score.withColumn("rank", F.row_number().over(Window.partitionBy(item).orderBy(F.desc("score"), doc))).where(F.col("rank") <= k)
