"""The operators over the driver's tables: one query each, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import asof, numbers, periods, text, urls
from ..operators import agreement, align, compare, constraints, extraction, feedback, formulas, lineage, relational, retrieve, review
from ..schemas import CLAIM, INPUT
from ..sources import markup
from ..sources.store import stored
from ..streaming import feedback as streams

CUTOFF = "2026-10-06"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _claim(df: DataFrame) -> DataFrame:
    """The claim layout: columns that ``df`` has, nulls of the right type for the rest."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in CLAIM.fields])


def _money(c: str):
    return F.col(c).cast("decimal(18,2)")


def nation_year_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals by nation and calendar year as claims. The last year ends with the last order, so it is a partial one."""
    orders, cust, nation = (_t(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    last = orders.agg(F.max(F.to_date("o_orderdate")).alias("_last"))
    by = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", F.year("o_orderdate").alias("y")).agg(F.sum(_money("o_totalprice")).cast("decimal(28,2)").alias("v"))
    # a row per nation and year, which the comparisons read many times
    by = stored(by.join(F.broadcast(last), F.lit(True)), "nation-years")
    start, end = F.make_date("y", F.lit(1), F.lit(1)), F.least(F.make_date("y", F.lit(12), F.lit(31)), F.col("_last"))
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    period = F.struct(iso(start).alias("period_start"), iso(end).alias("period_end"), F.lit(None).cast("string").alias("as_of_date"), F.lit("annual").alias("period_kind"), F.lit("calendar").alias("period_basis"), F.col("y").alias("fiscal_year"), F.lit(None).cast("int").alias("fiscal_quarter"), periods.inclusive_days(start, end).alias("duration_days"))
    return _claim(by.select(
        F.concat_ws("-", "n_name", F.col("y").cast("string")).alias("record_id"), F.lit("event_claim").alias("record_kind"), F.concat(F.lit("D"), F.col("y").cast("string")).alias("doc_id"), F.lit("r1").alias("revision_id"),
        F.col("n_name").alias("company_id"), F.lit("ALL").alias("scope_id"), F.lit("company").alias("scope_level"), F.lit("orders-1").alias("definition_version"), F.lit("actual_reported").alias("modality"), F.lit("company_reported").alias("evidence_status"),
        F.lit("order_total").alias("metric_id"), F.col("v").cast("string").alias("numeric_value"), F.lit("USD").alias("currency"), F.lit("USD").alias("canonical_unit"), F.lit("1").alias("scale"), F.lit("preserve").alias("sign_policy"), F.lit("point").alias("value_kind"),
        F.lit("flow").alias("balance_or_flow"), F.lit("sales").alias("statement_type"), F.lit("GAAP").alias("accounting_basis"), F.lit("consolidated").alias("consolidation"), F.lit("additive_flow").alias("aggregation_behavior"),
        iso(F.date_add(end, 30)).alias("published_date"), iso(F.date_add(end, 31)).alias("observed_at"), period.alias("reference_period"), F.expr("cast(array() as array<struct<record_id:string,published_at:string,published_date:string,observed_at:string,use_policy:string,availability_basis:string>>)").alias("availability_dependencies"), F.array(F.concat(F.lit("E"), F.col("y").cast("string"))).alias("evidence_refs"),
    ))


def _as_struct(claims: DataFrame, name: str) -> DataFrame:
    return claims.select(F.struct(*claims.columns).alias(name), F.col("company_id").alias("_k"), F.col("reference_period.fiscal_year").alias("_y"))


def yoy_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = nation_year_claims(spark, sf_dir)
    pairs = _as_struct(c, "new").join(_as_struct(c, "old").withColumn("_y", F.col("_y") + 1), ["_k", "_y"]).select("new", "old", F.lit("yoy").alias("comparison_basis"), F.lit("current_review").alias("cutoff_mode"), F.lit(CUTOFF).alias("cutoff"))
    out = compare.changes(pairs)
    return out.select("new_record_id", "prior_record_id", F.col("compatibility.decision").alias("decision"), "status", F.concat_ws("|", "reasons").alias("reasons"), "old_value", "new_value", "delta", F.round(F.col("relative_delta").cast("double"), 6).alias("relative_delta"), F.get("change_types", F.lit(0)).alias("change_type"), "historical_eligible")


def prior_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = retrieve.retrieve(nation_year_claims(spark, sf_dir), "exact_key")
    return r.select("new_record_id", "cutoff_mode", "universe", "candidate_count", "excluded_count", "comparable_count", "status", "selected_record_id", "review_comparator_id")


def no_prior_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = nation_year_claims(spark, sf_dir)
    out = retrieve.no_prior_changes(c, retrieve.retrieve(c, "exact_key"))
    return out.select("new_record_id", "cutoff_mode", "comparison_basis", "status", F.concat_ws("|", "reasons").alias("reasons"), "new_value", "relative_delta_missing_reason")


def label_retrieval_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do the exact and the sparse method select the same?"""
    c = nation_year_claims(spark, sf_dir)
    both = retrieve.retrieve(c, "exact_key").unionByName(retrieve.retrieve(c, "local_label_tfidf"))
    return agreement.method_agreement(both, ["new_record_id", "cutoff_mode"], "method", "selected_record_id", "exact_key", "local_label_tfidf")


def change_mode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.mode_summary(retrieve.all_changes(nation_year_claims(spark, sf_dir)))


def same_period_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim against two others of its period: one of the same definition and a changed amount, one of another definition."""
    c = nation_year_claims(spark, sf_dir)
    v = (F.col("numeric_value").cast("decimal(28,2)") * F.lit("1.10").cast("decimal(3,2)")).cast("decimal(28,2)").cast("string")
    same = c.withColumn("numeric_value", v).withColumn("record_id", F.concat("record_id", F.lit("-rev")))
    other = c.withColumn("definition_version", F.lit("orders-2")).withColumn("record_id", F.concat("record_id", F.lit("-def")))
    pairs = _as_struct(c, "old").join(_as_struct(same.unionByName(other), "new"), ["_k", "_y"]).select("new", "old", F.lit("same_period").alias("comparison_kind"), F.lit(None).cast("string").alias("as_of"))
    out = compare.compare_claims(pairs)
    return out.select("new_claim_id", "prior_claim_id", "decision", F.concat_ws("|", "reasons").alias("reasons"), "delta", F.round(F.col("relative_delta").cast("double"), 6).alias("relative_delta"), "relative_delta_missing_reason")


def within_group_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by market segment and year against the year before, joined on (segment, year - 1)."""
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    by = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("orders"))
    old = by.select("segment", (F.col("year") + 1).alias("year"), F.col("orders").alias("prior_orders"))
    return by.join(old, ["segment", "year"]).withColumn("delta", F.col("orders") - F.col("prior_orders"))


def _quarter_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (_t(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(F.sum(_money("o_totalprice")).cast("decimal(28,2)").alias("amount"))


def ytd_to_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative amounts of a year, and the quarters got back from them."""
    from pyspark.sql import Window

    w = Window.partitionBy("n_name", "year").orderBy("quarter")
    ytd = _quarter_sums(spark, sf_dir).withColumn("ytd", F.sum("amount").over(w).cast("decimal(28,2)")).drop("amount")
    return relational.from_cumulative(ytd, ["n_name", "year"], "quarter", "ytd").withColumn("period_value", F.col("period_value").cast("decimal(28,2)"))


def reconcile_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals against the sums of their lines, and against a copy that is off by little or much."""
    o, l = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    totals = o.select("o_orderkey", _money("o_totalprice").alias("total"))
    lines = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(_money("l_extendedprice")).cast("decimal(28,2)").alias("lines"))
    copy = totals.select("o_orderkey", (F.col("total") + (F.col("o_orderkey") % 4).cast("decimal(18,2)") * F.lit("0.10").cast("decimal(3,2)")).cast("decimal(18,2)").alias("copy"))
    one = lambda d, c, lane: relational.reconciled(totals, d, ["o_orderkey"], "total", c, F.lit("0.15").cast("decimal(3,2)")).select("o_orderkey", F.lit(lane).alias("lane"), F.col("difference").cast("decimal(28,2)").alias("difference"), "status")
    return one(lines, "lines", "lines").unionByName(one(copy, "copy", "copy"))


def margin_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered ratio: discounted over full price by nation and year, as a 28-digit quotient rounded at the edge."""
    l, o, c, n = (_t(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    by = j.groupBy("n_name", F.year("o_orderdate").alias("y")).agg(F.sum(_money("l_extendedprice")).cast("decimal(28,2)").alias("full"), F.sum((_money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(24,4)")).cast("decimal(28,4)").alias("net"))
    by = stored(by, "nation-years")
    day = lambda m, d: F.format_string(f"%04d-{m}-{d}", "y")
    period = F.struct(day("01", "01").alias("period_start"), day("12", "31").alias("period_end"), F.lit(None).cast("string").alias("as_of_date"), F.lit("annual").alias("period_kind"), F.lit("calendar").alias("period_basis"), F.col("y").alias("fiscal_year"), F.lit(None).cast("int").alias("fiscal_quarter"), periods.inclusive_days(F.make_date("y", F.lit(1), F.lit(1)), F.make_date("y", F.lit(12), F.lit(31))).alias("duration_days"))
    common = [F.lit("event_claim").alias("record_kind"), F.col("n_name").alias("company_id"), F.lit("ALL").alias("scope_id"), F.lit("1").alias("definition_version"), F.lit("GAAP").alias("accounting_basis"), F.lit("USD").alias("currency"), F.lit("USD").alias("canonical_unit"), F.lit("1").alias("scale"), F.lit("flow").alias("balance_or_flow"), F.lit("actual_reported").alias("modality"), day("12", "31").alias("published_date"), day("12", "31").alias("observed_at"), F.concat_ws("-", "n_name", F.col("y").cast("string")).alias("doc_id"), period.alias("reference_period")]
    claims = _claim(by.select(*common, F.lit("operating_income").alias("metric_id"), F.col("net").cast("string").alias("numeric_value"), F.concat_ws("-", "n_name", F.col("y").cast("string"), F.lit("i")).alias("record_id")).unionByName(by.select(*common, F.lit("revenue").alias("metric_id"), F.col("full").cast("string").alias("numeric_value"), F.concat_ws("-", "n_name", F.col("y").cast("string"), F.lit("r")).alias("record_id"))))
    groups = formulas.formula_groups(claims, "operating_margin", ("current_review",), CUTOFF)
    names = groups.select("group_id", F.col("a.company_id").alias("n_name"), F.col("a.reference_period.fiscal_year").alias("year"))
    out = formulas.calculate(groups, "operating_margin", "ALL").join(names, "group_id")
    return out.select("n_name", "year", "status", F.concat_ws("|", "reasons").alias("reasons"), F.round(F.col("output").cast("double"), 6).alias("margin"))


def asof_prior_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    out = relational.asof_prior(e.select("event_id", "user_id", "ts", "event_type", "value"), ["user_id"], "ts", "event_id", ["event_type", "value"])
    return out.select("event_id", "user_id", "prior_event_id", "prior_event_type", F.round("prior_value", 6).alias("prior_value"), "prior_candidates")


def ambiguous_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day before with events of the user and type: a choice only if it has one event."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    out = relational.asof_prior(e, ["user_id", "event_type"], "day", "event_id", [])
    status = F.when(F.col("prior_candidates").isNull(), "no_prior").when(F.col("prior_candidates") > 1, "ambiguous_compatible_priors").otherwise("selected")
    return out.select("event_id", "user_id", "event_type", "prior_candidates", status.alias("status"), F.when(status == "selected", F.col("prior_event_id")).alias("selected_event_id"))


def _event_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    day = F.to_date("ts")
    dep = F.struct(F.lit(None).cast("string").alias("published_at"), iso(F.date_add(day, (F.col("event_id") % 5 - 2).cast("int"))).alias("published_date"), iso(F.date_add(day, (F.col("event_id") % 3).cast("int"))).alias("observed_at"), F.when(F.col("event_id") % 7 == 0, "current-only review").otherwise("public").alias("use_policy"))
    c = e.select("event_id", F.struct(F.lit(None).cast("string").alias("revision_published_at"), F.lit(None).cast("string").alias("revision_published_date"), F.lit(None).cast("string").alias("published_at"), F.when(F.col("event_id") % 11 != 0, iso(day)).alias("published_date"), iso(F.date_add(day, 1)).alias("observed_at"), F.when(F.col("event_id") % 13 == 0, "unresolved_retrospective_dependency").alias("scope_status_as_of"), F.array(dep).alias("availability_dependencies")).alias("c"))
    c = c.withColumn("cutoff_mode", F.explode(F.array(*map(F.lit, asof.MODES))))
    return c.select("event_id", "cutoff_mode", asof.availability(F.col("c"), F.col("cutoff_mode"), F.lit("2024-01-15")).alias("reasons"))


def dependency_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_modes(spark, sf_dir).select("event_id", "cutoff_mode", (F.size("reasons") == 0).alias("eligible"), F.concat_ws("|", "reasons").alias("reasons"))


def mode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_modes(spark, sf_dir).groupBy("cutoff_mode").agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.size("reasons") == 0).alias("eligible"), F.count_if(F.size("reasons") > 1).alias("several_reasons"))


def tfidf_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark item the five documents with the highest sum of ln((N + 1) / (df + 1)) + 1 over shared tokens."""
    d, b = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark")
    n = d.count()
    words = d.select("doc_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("t"))
    asked = b.select("item_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("t"))
    return retrieve.top_by_tokens(asked, words, n, 5).select("item_id", "rank", "doc_id", "score")


def _trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", "lang", "source", text.grams(F.lower("text")).alias("g"))


def trigram_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of equal trigram sets of one language (null is one too), over all sources."""
    links, _ = align.similar_classes(_trigrams(spark, sf_dir), ["lang"], "g", 0.8, id_col="doc_id")
    return links.select("lang", "left_id", "right_id", F.round("jaccard", 6).alias("jaccard"))


def trigram_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document by its set of trigrams, and how many classes that one is similar to."""
    links, member = align.similar_classes(_trigrams(spark, sf_dir), ["lang"], "g", 0.8, id_col="doc_id")
    n = links.select(F.explode(F.array("left_id", "right_id")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    return member.join(n, "class", "left").select("doc_id", F.col("class").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def greedy_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pairs of each language over all sources, every document used once on a side, eight at most."""
    return align.greedy_one_to_one(align.best_candidates(_trigrams(spark, sf_dir), "lang", "g", 0.8, 8, id_col="doc_id"), "lang", 8)


def exact_sentence_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that several documents share word for word."""
    d = _t(spark, sf_dir, "documents")
    s = d.select("doc_id", F.explode(F.array_distinct(text.sentence_texts(F.col("text")))).alias("sentence")).where(F.length("sentence") >= 30)
    return s.groupBy("sentence").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("documents > 1")


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return _t(spark, sf_dir, "pages").select("page_id", urls.canonical(u).alias("canonical"), urls.redacted(u).alias("redacted"), urls.host(u).alias("host"), urls.is_safe(u).alias("is_safe"))


def url_alias_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "pages").withColumn("canonical", urls.canonical(F.col("url")))
    return relational.alias_groups(p, urls.section(F.col("url")), "canonical")


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.blocks(_t(spark, sf_dir, "pages")).select("page_id", "seq", "block_id", "block_type", "node_path", "role", "omitted", "section_path", "normalized_text")


def html_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = markup.bodies(_t(spark, sf_dir, "pages"))
    return b.select("page_id", "title", "quality", F.length("body").alias("body_chars"), F.size("atoms").alias("atoms"), F.size("omissions").alias("omissions"))


def block_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.block_coverage(markup.blocks(_t(spark, sf_dir, "pages")), "page_id")


def signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", *[c.cast("long").alias(k) for k, c in zip(text.SIGNALS, text.signal_counts(F.col("text")), strict=True)])


def signal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    text.small_batches(spark)
    s = _t(spark, sf_dir, "documents").select("doc_id", F.explode(text.signals("text")).alias("s"))
    return s.groupBy("s.kind").agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("doc_id").alias("documents"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), _t(spark, sf_dir, "labels")
    group = F.when(F.col("toxic") == 1, "scope_availability").when(F.col("quality") == 0, "segment_definition").otherwise("evidence_review")
    date = F.when(F.col("quality").isNotNull(), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd"))
    return d.join(l, "doc_id", "left").select("doc_id", "lang", "source", "n_chars", group.alias("reason_group"), date.alias("published_date"))


def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = review.positions(_labelled(spark, sf_dir), key="doc_id")
    return out.select("doc_id", "reason_group", "published_date", "chronological_position", "grouped_position")


def review_queue_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _labelled(spark, sf_dir).select("doc_id", F.col("lang").alias("family"), "source", (F.col("n_chars") < 400).alias("short"), F.col("doc_id").alias("ord"))
    return review.diverse_queue(items, 20, key="doc_id")


def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", "source")
    return review.round_robin(d, "source", ["doc_id"], 200).select("source", "turn", "doc_id")


def review_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card per conversation: sets in order, a version that is the digest of its facts."""
    c = _t(spark, sf_dir, "conversations")
    by = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.concat_ws("|", F.array_sort(F.collect_set("role"))).alias("roles"), F.sum(F.length("text")).alias("chars"), F.array_sort(F.collect_list(F.struct("turn", F.sha2(F.col("text"), 256).alias("d")))).alias("f"))
    return by.select("conv_id", "turns", "roles", "chars", F.sha2(F.concat_ws("\n", F.transform("f", lambda x: x["d"])), 256).alias("card_version"))


def _label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = _t(spark, sf_dir, "documents").select("doc_id", "lang"), _t(spark, sf_dir, "labels")
    return d.join(l, "doc_id", "left").select("doc_id", "lang", F.col("quality").cast("string").alias("a"), F.when(F.col("toxic") == 1, F.lit("unknown")).otherwise(F.col("toxic").cast("string")).alias("b"))


def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agreement.pair_summary(_label_pairs(spark, sf_dir), ["lang"])
    return out.select("lang", "all_pairs", "exact", "observed_pairs", "observed_exact", "excluded_state_pairs", "missingness_disagreements", F.round("observed_rate", 6).alias("observed_rate"))


def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.confusion(_label_pairs(spark, sf_dir), ["lang"])


def span_overlap_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sentences as reference spans, shifted ones as predictions, every third one missing."""
    p = F.locate(".", F.col("text")).cast("int")
    d = _t(spark, sf_dir, "documents").where(F.locate(".", F.col("text")) > 0)
    d = d.select("lang", F.lit(0).alias("ref_start"), p.alias("ref_end"), F.when(F.col("doc_id") % 3 != 0, F.least(F.lit(3), p)).alias("pred_start"), F.when(F.col("doc_id") % 3 != 0, p + 2).alias("pred_end"))
    out = agreement.span_overlap(d, ["lang"])
    return out.select("lang", "intersection", "reference_chars", "predicted_chars", "span_exact", "spans", F.round("macro_f1", 6).alias("macro_f1"), F.round("micro_f1", 6).alias("micro_f1"))


FIELDS = ["p_name", "p_brand", "p_size"]


def _part_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").withColumn("location_key", F.col("p_partkey").cast("string"))
    refs = p.select(F.col("p_partkey").alias("item_id"), "location_key", *FIELDS)
    preds = p.where("p_partkey % 17 <> 0").select(F.concat(F.lit("P"), "location_key").alias("prediction_id"), "location_key", "p_name", F.when(F.col("p_partkey") % 9 != 0, F.col("p_brand")).alias("p_brand"), F.when(F.col("p_partkey") % 10 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))
    twice = preds.where("cast(location_key as long) % 23 = 0").withColumn("prediction_id", F.concat("prediction_id", F.lit("b")))
    return agreement.matched(refs, preds.unionByName(twice), FIELDS)[0]


def field_match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agreement.field_rates(_part_matches(spark, sf_dir), FIELDS)
    return out.select("field", "numerator", "denominator", "missing_prediction", F.round("value", 6).alias("value"))


def bundle_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.bundle_rate(_part_matches(spark, sf_dir), FIELDS).withColumn("value", F.round("value", 6))


def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    r = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    j = o.join(r, "o_orderkey", "left")
    return relational.funnel(j, "o_orderkey", {"attempted": F.lit(True), "with_lines": F.col("lines") > 0, "returned": F.col("returned") > 0, "open": F.col("o_orderstatus") == "O", "large": F.col("o_totalprice") > 100000})


def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (_t(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.year("o_orderdate").alias("year"))
    # one row: the years from the first order to a year after the last
    years = o.agg(F.min(F.year("o_orderdate")).alias("a"), (F.max(F.year("o_orderdate")) + 1).alias("z"))
    grid = n.crossJoin(F.broadcast(years)).select("n_name", F.explode(F.sequence("a", "z")).alias("year"))
    return relational.coverage(rows, grid, ["n_name", "year"])


def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.orphans(_t(spark, sf_dir, "documents").select("doc_id", "lang", "source"), _t(spark, sf_dir, "labels"), "doc_id", "doc_id")


def missing_reason_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with some amounts taken away and some reasons given: nulls need one, values forbid one."""
    c = _t(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    d = c.select("c_custkey", F.when(k % 5 != 0, F.col("c_acctbal")).alias("balance"), F.when(k % 7 != 0, F.col("c_mktsegment")).alias("segment"), F.when(k % 10 == 0, "not_disclosed").when(k % 11 == 0, "guess").alias("balance_reason"), F.when(k % 7 == 0, "not_applicable").alias("segment_reason"))
    rules = constraints.missing_reason_rules(["balance", "segment"], {"balance": "balance_reason", "segment": "segment_reason"}, ["not_disclosed", "not_applicable"])
    return constraints.checked(d, rules).select("c_custkey", F.concat_ws("|", "errors").alias("errors"))


def lineage_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is tied to its customer's order before it: long chains, one component per customer."""
    from pyspark.sql import Window

    o = _t(spark, sf_dir, "orders")
    e = o.select("o_orderkey", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("before")).where("before is not null")
    return lineage.components(e.select(F.col("o_orderkey").alias("a"), F.col("before").alias("b")), o.select(F.col("o_orderkey").alias("node")))


def _event_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    s = lambda *x: F.concat_ws("-", *x)
    user, day = F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")
    return e.select(
        F.col("event_id").alias("event_index"), F.concat(F.lit("F"), F.col("event_id").cast("string")).alias("feedback_id"), s(user, F.col("event_type"), day).alias("idempotency_key"), F.lit("run").alias("source_run"), s(user, day).alias("card_id"), F.lit("v1").alias("card_version"), user.alias("actor_id"),
        F.lit("correct_fact").alias("action"), F.col("event_type").alias("field"), F.lit(None).cast("string").alias("before"), F.floor(F.col("value") / 10).cast("string").alias("after"), F.array(F.lit("E")).alias("evidence_refs"), F.lit("value_mismatch").alias("reason_code"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.when(F.col("value") < 0, "invalid_decimal").alias("rejection"),
    )


def feedback_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.conflicts(_event_feedback(spark, sf_dir)).select("card_id", "field", "values", F.size("feedback_ids").cast("long").alias("events"), F.array_min("feedback_ids").alias("first_feedback"))


def feedback_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an import into an empty journal: the first of a key counts; others repeat it or contradict it."""
    e = _event_feedback(spark, sf_dir).drop("feedback_id").withColumn("feedback_id", F.col("idempotency_key"))
    out = feedback.imported(e, e.where(F.lit(False)))
    return out.select(F.col("event_index").alias("event_id"), "result", "rejection")


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), _money("o_totalprice").alias("total"))
    out = relational.latest(o, ["o_custkey"], ["day", "o_orderkey"], ("day", "2000-12-31"))
    return out.select("o_custkey", "o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"), "total")


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("k"))
    return relational.first_copies(d, ["k"], ["doc_id"]).select("doc_id", "dedup_status")


def unit_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _t(spark, sf_dir, "lineitem")
    a = l.select("l_orderkey", "l_linenumber", _money("l_quantity").cast("string").alias("value"), F.when(F.col("l_returnflag") == "A", "thousands").when(F.col("l_returnflag") == "N", "millions").otherwise("unknown").alias("unit"), F.when(F.col("l_linestatus") == "O", "USD").otherwise("EUR").alias("currency"))
    rules = spark.createDataFrame([("R1", "thousands", "currency=USD", "1000", "USD"), ("R2", "millions", "any_same_currency", "1000000", "base"), ("R3", "millions", "EUR", "1000000", "EUR")], "rule_id string, input_unit string, currency_condition string, multiplier string, output_unit string")
    return numbers.scaled(a, rules).select("l_orderkey", "l_linenumber", "calculation_status", "output", "output_unit", "rule_id", F.concat_ws("|", "reasons").alias("reasons"))


def number_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounting tokens made from balances: grouped, in parentheses, dashed, blank, malformed."""
    c = _t(spark, sf_dir, "customer")
    k, amount = F.col("c_custkey") % 6, F.abs(_money("c_acctbal"))
    token = F.when(k == 0, F.concat(F.lit("("), F.format_number(amount, 2), F.lit(")"))).when(k == 1, F.format_number(amount, 2)).when(k == 2, F.lit("—")).when(k == 3, F.lit("  ")).when(k == 4, F.concat(F.lit("("), amount.cast("string"))).otherwise(F.concat(F.lit("1,2"), amount.cast("string")))
    d = c.select("c_custkey", numbers.parse_number(token).alias("p"))
    return d.select("c_custkey", F.col("p.value").cast("decimal(18,2)").alias("value"), F.col("p.error").alias("error"))


def period_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    y, k = F.year("o_orderdate").cast("string"), F.col("o_orderkey") % 4
    head = F.when(k == 0, "Three Months Ended June 30,").when(k == 1, "Twelve  Months Ended June 30").when(k == 2, F.concat(F.lit("June 30, "), y)).otherwise("Six Months Ended June 30,")
    d = o.select("o_orderkey", periods.parse_period(head, y).alias("p"))
    return d.select("o_orderkey", "p.period_start", "p.period_end", "p.as_of_date", "p.period_kind", "p.fiscal_year", "p.duration_days", "p.error")


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as minute intervals of the month: those of different types that overlap, the smaller type on the left."""
    e = _t(spark, sf_dir, "events")
    minute = ((F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) / 60).cast("int")
    i = e.select("event_id", "user_id", "event_type", minute.alias("start"), (minute + 30 + F.col("event_id") % 60).cast("int").alias("end"))
    out = align.interval_overlap(i, i, "user_id", bin_size=60).where("l.event_type < r.event_type")
    return out.select(F.col("l.event_id").alias("left_event"), F.col("r.event_id").alias("right_event"), "overlap_start", "overlap_end")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.windowed(e, "ts", ["event_type"], "value", "1 hour")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def part_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, extraction.Rules]:
    """Cells made from parts, and the rules that read them."""
    p = _t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    have = {
        "input_id": F.concat(F.lit("I"), k.cast("string")), "input_kind": F.lit("numeric_cell"), "doc_id": F.when(k % 50 == 0, "D9").otherwise("D1"), "revision_id": F.lit("r1"), "source_sha256": F.when(k % 41 == 0, "bad").otherwise("h"), "published_date": F.lit("2024-07-30"), "observed_at": F.lit("2024-07-31"),
        "value_cell": F.when(k % 13 == 0, "-").otherwise(F.format_number(_money("p_retailprice"), 2)), "row_label": F.when(k % 7 == 0, "Unheard of").otherwise("Revenue"), "period_header": F.lit("Three Months Ended June 30,"), "year_header": F.when(k % 11 == 0, "2023 2024").otherwise("2024"), "unit_header": F.lit("In millions"),
        "company_id": F.lit("C"), "company_name": F.lit("Company"), "scope_label": F.lit("company financial statement total"), "table_purpose": F.lit("income_statement"), "currency": F.lit("USD"), "accounting_basis": F.lit("GAAP"), "source_qualifier": F.lit("company_reported_unaudited"), "evidence_refs": F.array(F.lit("E1")),
    }
    rules = extraction.Rules("C", "Company", "C-ALL", {"Revenue": ("revenue", "flow", "income_statement", "preserve")}, {}, {"In millions": "1000000"}, {"D1": ("r1", "h", "2024-07-30", "2024-07-31", None)})
    return p.select(*[have[f.name].cast(f.dataType).alias(f.name) for f in INPUT.fields]), rules


def cell_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located cells made from parts go through the extraction rules: claims, or the first reason against one."""
    out = extraction.extract(*part_inputs(spark, sf_dir), "run")
    return out.select("input_id", "status", "failure_stage", F.concat_ws("|", "reasons").alias("reasons"), "metric_id", "numeric_value")


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with equal texts in different splits."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("row_id"), F.sha2("text", 256).alias("event_family_id"), F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train").alias("split"), F.lit("none").alias("exposure"))
    m = d.withColumn("doc_id", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "from_id string, to_id string, edge_type string")
    out = lineage.split_audit(m, none)
    return out.select("row_id", "split", F.concat_ws("|", "reasons").alias("reasons"))


QUERIES = {f.__name__: f for f in (
    yoy_change, prior_retrieval, no_prior_changes, label_retrieval_methods, change_mode_summary, same_period_revision, within_group_prior, ytd_to_quarter, reconcile_tolerance, margin_formula, asof_prior_event, ambiguous_priors,
    dependency_availability, mode_summary, tfidf_retrieval, trigram_pairs, trigram_classes, greedy_alignment, exact_sentence_overlap, url_canonical, url_alias_groups, html_blocks, html_bodies, block_coverage, signal_counts, signal_spans, review_order,
    review_queue_diverse, round_robin_sample, review_cards, label_agreement, label_confusion, span_overlap_f1, field_match_rates, bundle_match_rate, funnel, coverage_matrix, fk_violations, missing_reason_audit, lineage_components,
    feedback_conflicts, feedback_import, latest_per_key, dedup_first, unit_scaling, number_parsing, period_parsing, interval_overlap, event_windows, cell_extraction, split_leakage,
)}
