"""Operators: comparability, retrieval, formulas, review, alignment, agreement, lineage, feedback, constraints, extraction."""

import random

import pytest
from pyspark.sql import functions as F

from priorlens.functions import text
from priorlens.operators import agreement, align, compare, constraints, extraction, feedback, formulas, lineage, relational, retrieve, review
from priorlens.schemas import CLAIM, FEEDBACK, INPUT

PERIOD = dict(period_start="2024-04-01", period_end="2024-06-30", as_of_date=None, period_kind="quarter", period_basis="fiscal", fiscal_year=2024, fiscal_quarter=4, duration_days=91)
BASE = dict(
    record_id="n", record_kind="event_claim", event_family_id="f", doc_id="D2", revision_id="r", company_id="C", scope_id="C-CONSOLIDATED", scope_level="company", definition_version="0.1", modality="actual_reported", metric_id="revenue", numeric_value="105", currency="USD", canonical_unit="USD", scale="1", sign_policy="preserve",
    value_kind="point", sign_convention="source", balance_or_flow="flow", statement_type="income", accounting_basis="GAAP", consolidation="consolidated", aggregation_behavior="additive_flow", published_date="2024-07-30", observed_at="2024-07-31", reference_period=PERIOD, availability_dependencies=[], evidence_refs=["e2"], negation=False, conditions=[],
)
OLD_PERIOD = PERIOD | dict(period_start="2023-04-01", period_end="2023-06-30", fiscal_year=2023)
OLD = BASE | dict(record_id="o", doc_id="D1", numeric_value="100", published_date="2023-07-30", observed_at="2023-07-31", reference_period=OLD_PERIOD, evidence_refs=["e1"])


def claims(spark, *rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in CLAIM.fields) for r in rows], CLAIM)


def pair(spark, new, old, names=("new", "old")):
    s = lambda r, n: claims(spark, r).select(F.struct(*[f.name for f in CLAIM.fields]).alias(n), F.lit(1).alias("k"))
    return s(new, names[0]).join(s(old, names[1]), "k")


def change(spark, new, old, basis="yoy", mode="current_review", cutoff="2026-10-06"):
    return compare.changes(pair(spark, new, old).select("new", "old", F.lit(basis).alias("comparison_basis"), F.lit(mode).alias("cutoff_mode"), F.lit(cutoff).alias("cutoff"))).first()


def test_change_computed(spark):
    c = change(spark, BASE, OLD)
    assert (c.status, c.delta, c.relative_delta, c.change_types, c.interpretation, c.historical_eligible) == ("computed", "5", "0.05", ["yoy"], "arithmetic_change", True)
    assert c.evidence_refs == ["e1", "e2"] and c.compatibility.decision == "comparable" and c.compatibility.checks["metric_id"] is True
    z = change(spark, BASE, OLD | dict(numeric_value="0"))
    assert (z.delta, z.relative_delta, z.relative_delta_missing_reason) == ("105", None, "zero_denominator")
    m = change(spark, BASE | dict(numeric_value="-3"), OLD | dict(numeric_value="-4"))
    assert (m.delta, m.relative_delta, m.interpretation) == ("1", "0.25", "negative_base_or_loss_transition")
    assert change(spark, BASE | dict(canonical_unit="percent"), OLD | dict(canonical_unit="percent")).unit == "percent_point"
    s = change(spark, BASE, OLD | dict(reference_period=PERIOD), "same_period_revision")
    assert s.change_types == ["same_period_difference_unconfirmed_revision"] and s.status == "computed"


@pytest.mark.parametrize("field", ["company_id", "scope_id", "definition_version", "metric_id", "accounting_basis", "currency", "canonical_unit", "balance_or_flow", "statement_type", "consolidation", "sign_policy"])
def test_change_guards(spark, field):
    bad = change(spark, BASE | {field: "other"}, OLD)
    assert bad.status == "withheld" and bad.compatibility.decision == "not_comparable" and f"{field}_mismatch" in bad.reasons and bad.delta is None and bad.change_types == ["not_comparable"]
    unknown = change(spark, BASE | {field: None}, OLD)
    assert unknown.status == "withheld" and f"{field}_unknown" in unknown.reasons


def test_change_more_guards(spark):
    r = lambda **k: change(spark, BASE | k, OLD)
    assert r(numeric_value=None).compatibility.decision == "needs_review" and "numeric_value_missing" in r(numeric_value=None).reasons
    assert "invalid_numeric_value" in r(numeric_value="x").reasons and "nonfinite_numeric_value" in r(numeric_value="NaN").reasons and "base_unit_required" in r(scale="1000").reasons
    assert "nonactual_numeric_comparison_not_supported" in r(modality="guidance").reasons
    assert "adjustment_definition_unknown" in change(spark, BASE | dict(accounting_basis="non_GAAP"), OLD | dict(accounting_basis="non_GAAP")).reasons
    assert "fiscal_quarter_mismatch" in r(reference_period=PERIOD | dict(fiscal_quarter=3)).reasons and "actual_period_mismatch" in r(reference_period=PERIOD | dict(period_end="2024-06-29", duration_days=90)).reasons
    late = r(published_date="2026-12-01", observed_at="2026-12-02")
    assert late.status == "withheld" and late.change_types == ["comparison_unresolved"] and "future_information" in late.reasons
    rel = dict(record_kind="business_relation", relation_type="reports_segment", subject_entity_id="C", object_entity_id="S", direction="out", subject_role="a", object_role="b", valid_from="2020-01-01")
    c = change(spark, BASE | rel, OLD | rel, "relation_state")
    assert c.change_types == ["relation_state_unresolved"] and c.compatibility.decision == "comparable" and c.delta is None
    c = change(spark, BASE | rel | dict(valid_from=None), OLD | rel, "relation_state")
    assert c.compatibility.decision == "needs_review" and c.reasons == ["actual_relation_validity_unknown"]


def compare_one(spark, new=BASE, old=OLD, kind="yoy", as_of=None):
    return compare.compare_claims(pair(spark, new, old).select("new", "old", F.lit(kind).alias("comparison_kind"), F.lit(as_of).cast("string").alias("as_of"))).first()


def test_compare_claims(spark):
    c = compare_one(spark)
    assert (c.decision, c.delta, c.relative_delta, c.reasons) == ("comparable", "5", "0.05", [])
    assert compare_one(spark, OLD, OLD, "same_period").delta == "0" and compare_one(spark, BASE, OLD, "same_period").reasons == ["reference_period_mismatch", "fiscal_year_conflicts_with_same_period"]
    assert compare_one(spark, BASE | dict(metric_id="ambiguous")).decision == "unknown" and compare_one(spark, BASE | dict(value_kind="share")).reasons == ["value_kind_mismatch", "ratio_denominator_unknown"]
    assert "explicit_base_unit_normalization_required" in compare_one(spark, BASE | dict(scale="1000")).reasons and compare_one(spark, BASE | dict(numeric_value=None, missing_reason="not_disclosed")).reasons == ["numeric_value_missing:not_disclosed"]
    assert compare_one(spark, BASE, OLD | dict(numeric_value="0")).relative_delta_missing_reason == "zero_prior_denominator"
    assert compare_one(spark, as_of="2024-07-30").decision == "comparable" and compare_one(spark, as_of="2024-07-30T12:00:00Z").reasons == ["date_only_intraday_availability_unresolved"] and compare_one(spark, as_of="2024-07-01").reasons == ["future_information_after_cutoff"]
    leap = compare_one(spark, BASE | dict(reference_period=PERIOD | dict(period_start="2024-01-01", period_end="2024-12-31", duration_days=366)), OLD | dict(reference_period=OLD_PERIOD | dict(period_start="2023-01-01", period_end="2023-12-31", duration_days=365)))
    assert leap.decision == "comparable"
    assert "non_gaap_definition_missing" in compare_one(spark, BASE | dict(accounting_basis="non-GAAP"), OLD | dict(accounting_basis="non-GAAP")).reasons
    segment = dict(scope_id="SEG", scope_level="segment")
    assert compare_one(spark, BASE | segment, OLD | segment).reasons == ["product_unknown_for_noncompany_scope"] and compare_one(spark, BASE | segment | dict(product_id="p"), OLD | segment | dict(product_id="q")).reasons == ["product_mismatch"]


def test_ytd_difference(spark):
    ytd = PERIOD | dict(period_kind="ytd", period_start="2024-01-01", fiscal_quarter=None)
    long, short = BASE | dict(reference_period=ytd | dict(duration_days=182)), BASE | dict(record_id="s", numeric_value="40", reference_period=ytd | dict(period_end="2024-03-31", duration_days=91))
    f = lambda a, b: compare.difference_ytd(pair(spark, a, b, ("longer", "shorter"))).first()
    r = f(long, short)
    assert (r.calculation_status, r.output, str(r.period_start), str(r.period_end), r.period_duration_days) == ("computed", "65", "2024-04-01", "2024-06-30", 91)
    assert f(short, long).reasons == ["shorter_ytd_not_prefix_of_longer"] and f(long | dict(aggregation_behavior="average"), short).reasons == ["additive_flow_registry_definition_required"]
    assert "ytd_difference_requires_flows" in f(long | dict(balance_or_flow="balance"), short).reasons and f(long | dict(numeric_value=None), short).calculation_status == "insufficient_inputs"
    assert "ytd_difference_requires_additive_point_amounts" in f(long | dict(canonical_unit="percent"), short | dict(canonical_unit="percent")).reasons


def test_retrieval(spark):
    older = OLD | dict(record_id="p", doc_id="D0", published_date="2022-07-30", observed_at="2022-07-31", reference_period=OLD_PERIOD | dict(period_start="2022-04-01", period_end="2022-06-30", fiscal_year=2022))
    get = lambda *rows, **k: {r.new_record_id: r for r in retrieve.retrieve(claims(spark, *rows), modes=("current_review",), **k).collect()}
    r = get(BASE, OLD, older)
    assert (r["n"].status, r["n"].selected_record_id, r["n"].candidate_count, r["n"].excluded_count) == ("selected", "o", 2, 0)
    assert r["p"].status == "all_candidates_time_excluded" and r["p"].review_comparator_id is None and r["p"].excluded_count == 2
    assert get(BASE)["n"].status == "no_hit_in_limited_corpus"
    twin = OLD | dict(record_id="o2", doc_id="D3")
    assert get(BASE, OLD, twin)["n"].status == "ambiguous_compatible_priors" and get(BASE, OLD, twin)["n"].selected_record_id is None
    assert get(BASE, OLD | dict(currency="EUR"))["n"].status == "all_candidates_incompatible" and get(BASE, OLD | dict(currency="EUR"))["n"].review_comparator_id == "o"
    assert get(BASE | dict(observed_at=None), OLD)["n"].status == "query_unavailable"
    # a later revision of the prior must not change what was chosen
    future = OLD | dict(record_id="z", doc_id="D9", published_date="2025-07-30", observed_at="2025-07-31")
    assert get(BASE, OLD, older, future)["n"].selected_record_id == "o"
    same_doc = OLD | dict(record_id="w", doc_id="D2")
    c = {x.old.record_id: x.exclusions for x in retrieve.candidates(claims(spark, BASE, same_doc), modes=("current_review",)).where("new.record_id = 'n'").collect()}
    assert c["w"] == ["same_release_not_independent_prior"]
    other = OLD | dict(record_id="x", scope_id="SEG")
    t = {x.old.record_id: (x.rank, x.score) for x in retrieve.candidates(claims(spark, BASE, OLD, other), "local_label_tfidf", ("current_review",)).where("new.record_id = 'n'").collect()}
    assert t["o"][0] == 1 and t["x"][0] == 2 and t["o"][1] > t["x"][1]
    all_ = {x.new_record_id: x for x in retrieve.all_changes(claims(spark, BASE, OLD, older), ("current_review",), segment_scope="C").collect()}
    assert all_["n"].status == "computed" and all_["p"].change_types == ["prior_not_found_in_limited_corpus"]
    assert retrieve.mode_summary(retrieve.all_changes(claims(spark, BASE, OLD), ("current_review",))).first().attempted == 2


def test_formulas(spark):
    rev, inc = BASE | dict(numeric_value="30"), BASE | dict(record_id="i", metric_id="operating_income", numeric_value="10")
    def run(formula, *rows):
        g = formulas.formula_groups(claims(spark, *rows), formula, ("current_review",))
        return formulas.calculate(g, formula, "C-CONSOLIDATED").first()
    assert (run("operating_margin", rev, inc).status, run("operating_margin", rev, inc).output) == ("computed", "0.3333333333333333333333333333")
    assert run("operating_margin", rev).missing_inputs == ["operating_income"] and run("operating_margin", rev | dict(numeric_value="0"), inc).reasons == ["zero_denominator"]
    assert run("operating_margin", rev | dict(currency="EUR"), inc).reasons == ["currency_mismatch_or_unknown"] and run("operating_margin", rev | dict(numeric_value="x"), inc).status == "insufficient_inputs"
    cfo, capex = BASE | dict(metric_id="cfo", numeric_value="37282000000"), BASE | dict(record_id="x", metric_id="positive_cash_capex", numeric_value="11714000000", sign_policy="outflow_to_positive")
    assert run("project_fcf", cfo, capex).output == "25568000000" and run("project_fcf", cfo, capex | dict(sign_policy="preserve")).reasons == ["positive_cash_capex_sign_required"]
    assert formulas.calculate(formulas.formula_groups(claims(spark, rev), "operating_margin"), "other", "x").first().status == "invalid_formula"
    s = spark.createDataFrame([("3", "2.5", "2025", "C", "USD", ["a"]), ("3", None, "2025", "C", "USD", ["a"]), ("3", "2", "2025", "C", "USD", []), ("-3", "2", "2025", "C", "USD", ["a"])], "units string, asp string, target_period string, scope_id string, currency string, assumption_refs array<string>")
    assert [(r.status, r.output, r.missing_inputs) for r in formulas.scenario(s).collect()] == [("computed", "7.5", []), ("insufficient_inputs", None, ["asp"]), ("insufficient_inputs", None, ["reviewed_assumption_refs"]), ("incompatible_inputs", None, [])]
    assert formulas.reconciliations(claims(spark, rev, inc)).first().reconciliation_status == "incomplete"


def test_review(spark):
    dep = [dict(record_id="d", published_at=None, published_date="2020-01-01", observed_at="2026-01-01", use_policy="public", availability_basis=None)]
    rows = [BASE, BASE | dict(record_id="a", availability_dependencies=dep), BASE | dict(record_id="b", definition_version="segment-2", published_date=None), BASE | dict(record_id="r", record_kind="business_relation")]
    rows = [r | dict(field_missing_reasons={"x": "not_disclosed", "y": "not_applicable"}) for r in rows]
    df, links = claims(spark, *rows), spark.createDataFrame([("r", "n")], "candidate_relation_id string, candidate_claim_id string")
    items = review.review_items(df, links)
    got = {r.record_id: r for r in items.collect()}
    assert [got[k].reason_group for k in "anbr"] == ["scope_availability", "evidence_review", "segment_definition", "evidence_review"] and got["r"].review_group_id == got["n"].review_group_id and got["n"].missing_field_count == 1 and got["n"].materiality_score is None
    assert got["r"].review_reasons[-2:] == ["relation_validity_unknown", "shared_numeric_evidence"] and not got["a"].historical_eligible
    pos = {r.record_id: (r.chronological_position, r.grouped_position) for r in review.positions(items).collect()}
    assert pos == {r.record_id: (r.chronological_position, r.grouped_position) for r in review.positions(items.repartition(7)).collect()}
    assert pos["b"][0] == 4 and [k for k, _ in sorted(pos.items(), key=lambda x: x[1][1])] == ["a", "b", "n", "r"]
    ch = compare.changes(pair(spark, BASE, OLD).select("new", "old", F.lit("yoy").alias("comparison_basis"), F.lit("current_review").alias("cutoff_mode"), F.lit("2026-10-06").alias("cutoff")))
    built = review.cards(items, df, ch)
    assert built.count() == 3 and review.card_checks(built, df).first().asDict() == {"unique_cards": True, "candidate_status_preserved": True, "version_integrity": True, "every_candidate_once": True}
    assert not review.card_checks(built, claims(spark, *rows, BASE | dict(record_id="zz"))).first().every_candidate_once
    assert not review.card_checks(built.withColumn("review_readiness", F.lit("ready")), df).first().candidate_status_preserved


def test_diverse_queue_is_the_greedy_choice(spark):
    r = random.Random(1)
    rows = [(i, f"f{r.randint(0, 9)}", f"s{r.randint(0, 3)}", r.random() < 0.2, r.randint(0, 50)) for i in range(200)]
    got = [(x.position, x.record_id) for x in review.diverse_queue(spark.createDataFrame(rows, "record_id int, family string, source string, short boolean, ord int"), 12).orderBy("position").collect()]
    left, fam, taken, want = list(rows), set(), {}, []
    while len(want) < 12:
        x = min(left, key=lambda t: (not t[3], t[1] in fam, taken.get(t[2], 0), t[4], t[0]))
        left.remove(x)
        fam.add(x[1])
        taken[x[2]] = taken.get(x[2], 0) + 1
        want.append((len(want) + 1, x[0]))
    assert got == want


def test_interval_overlap(spark):
    r = random.Random(3)
    iv = lambda n: [(f"k{r.randint(0, 2)}", s := r.randint(0, 900), s + r.randint(0, 300), i) for i in range(n)]
    a, b = iv(60), iv(60)
    s = "k string, start int, end int, i int"
    got = sorted((x.l.i, x.r.i, x.overlap_start, x.overlap_end) for x in align.interval_overlap(spark.createDataFrame(a, s), spark.createDataFrame(b, s), "k", bin_size=64).collect())
    assert got == sorted((x[3], y[3], max(x[1], y[1]), min(x[2], y[2])) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and x[2] > y[1])


@pytest.mark.parametrize("t", [0.12, 0.5, 0.8])
def test_similar_pairs(spark, t):
    r = random.Random(5)
    rows = [(i, "xy"[i % 2], f"s{i % 3}", [f"g{r.randint(0, 25)}" for _ in range(r.randint(0, 14))]) for i in range(60)]
    got = sorted((x.left_id, x.right_id) for x in align.similar_pairs(spark.createDataFrame(rows, "id int, b string, s string, g array<string>"), ["b"], "g", t, id_col="id", other="s").collect())
    j = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] != b[2] and j(a[3], b[3]) >= t)


def test_greedy_alignment_crosses_sources(spark, tmp_path):
    from priorlens.plans import queries

    r = random.Random(3)
    base = {lang: "".join(r.choice("abcdefgh") for _ in range(60)) for lang in ("en", "de", None)}
    rows = [(i, (lang := [*base][i % 3]), f"s{i}" if i % 5 else None, base[lang][: 60 - r.choice([0, 0, 0, 1, 2, 4, 9])]) for i in range(72)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    g = {i: {t[k : k + 3] for k in range(len(t) - 2)} for i, _, _, t in rows}
    want = []
    for lang in base:
        ids = [i for i, x, _, _ in rows if x == lang]
        pairs = sorted((-len(g[a] & g[b]) / len(g[a] | g[b]), a, b) for a in ids for b in ids if a < b and len(g[a] & g[b]) >= 0.8 * len(g[a] | g[b]))
        left, right = set(), set()
        for j, a, b in pairs:
            if len(left) < 8 and a not in left and b not in right:
                left.add(a), right.add(b), want.append((str(lang), len(left), a, b))
    got = [(str(x.lang), x.position, x.left_id, x.right_id) for x in queries.greedy_alignment(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(want) == 24


def test_alignment(spark):
    s = spark.createDataFrame([("A", "a1", "body", False, "the price of rice rose"), ("A", "a2", "body", False, "sales fell in june"), ("B", "b1", "body", False, "the price of rice rose sharply"), ("B", "b2", "body", True, "sales fell in june"), ("B", "b3", "body", False, "the price of rice fell")], "doc_id string, sentence_id string, position string, speech boolean, t string").withColumn("grams", text.grams(F.col("t")))
    p = align.article_pairs(spark.createDataFrame([("A", "f", "x"), ("B", "f", "y"), ("C", "f", "y")], "doc_id string, family string, source string"))
    assert sorted((r.left_doc, r.right_doc) for r in p.collect()) == [("A", "B"), ("A", "C")]
    got = align.sentence_alignment(s, p.withColumn("pair_id", F.concat("left_doc", "right_doc"))).collect()
    assert [(r.left_id, r.right_id, r.position) for r in got] == [("a1", "b1", 1)]
    e = spark.createDataFrame([("short", 5), ("▲ photo of a thing that is long enough", 40), ("All rights reserved by the publisher here", 40), ("A sentence that is long enough to compare", 40)], "x string, n int")
    assert [r[0] for r in e.select(align.eligibility(F.col("x"), F.col("n"))).collect()] == ["short_sentence", "caption", "footer", None]
    d = align.pair_diagnostic(spark.createDataFrame([(1, ["2024", "Q1"], ["5"])], "k int, period array<string>, quantity array<string>"), spark.createDataFrame([(1, ["2024"], ["5"])], "k int, period array<string>, quantity array<string>"), "k", ["period", "quantity"]).first()
    assert d.blockers == ["period_differs"] and d.period_left == ["Q1"] and d.quantity_both == ["5"]
    seg = lambda *x: spark.createDataFrame([(1, *v) for v in x], "k int, start int, end int")
    c = align.segmentation_comparison(seg((0, 5), (5, 9)), seg((0, 5), (5, 8), (8, 9)), "k").first()
    assert (c.shared, c.old_only, c.new_only, c.exact_segments) == (3, 0, 1, 1)
    u = align.uncovered(spark.createDataFrame([(1, "0123456789")], "k int, text string"), seg((0, 4), (2, 6)), "k").first()
    assert (u.uncovered, u.multiple) == (4, 2)


def test_agreement(spark):
    v = [("null", "null"), ('"unknown"', '"unknown"'), ('"unresolved_scope"', '"unresolved_scope"'), ("0", "0"), ("false", "false"), ('"1"', '"2"'), ("null", '"known"')]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(v)], "i int, a string, b string")
    s = agreement.pair_summary(p, []).first()
    assert (s.all_pairs, s.exact, s.observed_pairs, s.observed_exact, s.missingness_disagreements) == (7, 5, 3, 2, 1)
    assert spark.range(1).select(agreement.typed_equal(F.lit("0"), F.lit("false"))).first()[0] is False
    c = {(r.a, r.b): r.n for r in agreement.confusion(p, []).collect()}
    assert c['"1"', '"2"'] == 1 and sum(c.values()) == 7
    t = agreement.tuple_agreement(p.withColumn("item", F.col("i") % 2), "item").first()
    assert (t["items"], t.whole) == (2, 0)
    sp = spark.createDataFrame([(0, 4, 2, 6), (0, 4, 10, 12), (0, 4, None, None)], "ref_start int, ref_end int, pred_start int, pred_end int")
    r = agreement.span_overlap(sp).first()
    assert (r.intersection, r.reference_chars, r.predicted_chars, r.span_exact) == (2, 12, 6, 0) and r.micro_f1 == pytest.approx(4 / 18)
    rows = spark.createDataFrame([("i1", "f", "A", "1"), ("i1", "f", "B", "2"), ("i2", "f", "A", "1")], "item string, field string, who string, v string")
    d = agreement.adjudicated(agreement.dual(rows, "item", "who", "v", "A", "B")).collect()
    assert [(x.item, x.outcome, x["value"]) for x in d] == [("i1", "conflict", None)]
    ev = "array<struct<kind:string,location:string,start:int,end:int>>"
    refs = agreement.located(spark.createDataFrame([("r1", "d", [("n", "x", 0, 1), ("l", "y", 0, 1)], "5"), ("r2", "d", [("n", "z", 0, 1)], "6"), ("r3", "d", [("n", "q", 0, 1)], "7")], f"item_id string, doc string, evidence {ev}, v string"), "evidence", "doc")
    pred = agreement.located(spark.createDataFrame([("p1", "d", [("l", "y", 0, 1), ("n", "x", 0, 1)], "5"), ("p2", "d", [("n", "z", 0, 1)], "6"), ("p3", "d", [("n", "z", 0, 1)], "6"), ("p4", "d", [("n", "w", 0, 1)], "1")], f"prediction_id string, doc string, evidence {ev}, v string"), "evidence", "doc")
    m, extra = agreement.matched(refs, pred, ["v"])
    assert {x.item_id: x.match_status for x in m.collect()} == {"r1": "matched", "r2": "tie_conflict", "r3": "missing"} and sorted(x.prediction_id for x in extra.collect()) == ["p2", "p3", "p4"]
    f = agreement.field_rates(m, ["v"]).first()
    assert (f.numerator, f.denominator, f.missing_prediction) == (1, 3, 2) and agreement.bundle_rate(m, ["v"]).first().numerator == 1
    with pytest.raises(Exception, match="duplicate reference"):
        agreement.matched(refs.unionByName(refs), pred, ["v"])[0].collect()
    assert agreement.readiness(0, 1, True) == {"ready": False, "reasons": ["no_human_gold"]}


def test_lineage(spark):
    m = [("1", "D1", "f1", "train", "none"), ("2", "D1", None, "train", "none"), ("3", "D2", "f1", "test", "none"), ("4", "D3", None, "test", "seen"), ("4", "D3", None, "test", "seen"), ("5", "D4", None, "other", "none")]
    man = spark.createDataFrame(m, "row_id string, doc_id string, event_family_id string, split string, exposure string")
    e = spark.createDataFrame([("5", "9", "x")], "from_id string, to_id string, edge_type string")
    got = {r.row_id: r.reasons for r in lineage.split_audit(man, e).collect()}
    assert got["1"] == got["3"] == ["component_crosses_splits"] and got["4"] == ["duplicate_row_id", "exposed_test_row"] and got["5"] == ["unknown_split", "edge_to_unknown_row"]
    c = claims(spark, BASE, BASE | dict(record_id="b", doc_id="D9", definition_version="2"), BASE | dict(record_id="c", doc_id="D2", definition_version="3"), BASE | dict(record_id="d", numeric_value="7"))
    flat = c.select("record_id", "doc_id", "definition_version", "company_id", "metric_id", "scope_id", "numeric_value", "reference_period.*")
    assert sorted((r.from_id, r.to_id) for r in lineage.representation_overlaps(flat).collect()) == [("b", "c"), ("b", "n")]
    found = lineage.components(spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a int, b int"), spark.createDataFrame([(7,), (1,), (2,), (3,), (5,), (6,)], "node int"))
    assert {r.node: r.component for r in found.collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 7} and [r.size for r in lineage.component_sizes(found).collect()] == [3, 2, 1]
    v = lineage.split_violations(found, spark.createDataFrame([(1, "a", "g"), (2, "b", "g")], "node int, split string, group string"))
    assert v.first().reasons == ["component_in_several_splits"]


CARD = ("c1", "v1", "100", "S1", "{}", ["e1"])
EVENT = dict(feedback_id="f1", idempotency_key="k1", source_run="run", card_id="c1", card_version="v1", actor_id="a", action="correct_fact", field="numeric_value", before="100", after="101", evidence_refs=["e1"], reason_code="value_mismatch", created_at="2024-01-01T00:00:00Z")


def events(spark, *rows):
    return spark.createDataFrame([(i, *[r[f.name] for f in FEEDBACK.fields]) for i, r in enumerate(rows)], "event_index int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FEEDBACK.fields))


def validated(spark, *rows):
    cards = spark.createDataFrame([CARD], "card_id string, card_version string, numeric_value string, scope_id string, reference_period string, evidence_ids array<string>")
    return feedback.validated(events(spark, *rows), cards, "run", ["S1", "S2"])


@pytest.mark.parametrize("change, reason", [
    ({}, None), ({"card_id": "x"}, "unknown_card"), ({"source_run": "x"}, "wrong_source_run"), ({"card_version": "v0"}, "stale_card_version"), ({"action": "delete"}, "unsupported_action_or_field"), ({"before": "99"}, "forged_before"), ({"actor_id": "a b"}, "invalid_identity"), ({"created_at": "2024-01-01T00:00:00"}, "time_offset_required"),
    ({"evidence_refs": ["e9"]}, "unknown_evidence"), ({"reason_code": "x"}, "reason_not_allowlisted"), ({"action": "confirm"}, "action_field_mismatch"), ({"action": "confirm", "field": "review_status", "before": "needs_review", "after": "x"}, "invalid_review_value"), ({"action": "confirm", "field": "review_status", "before": "needs_review", "after": "confirmed_candidate"}, None),
    ({"after": "1e5"}, "invalid_decimal"), ({"evidence_refs": []}, "correction_evidence_required"), ({"field": "scope_id", "before": "S1", "after": "S9"}, "unknown_scope"), ({"field": "scope_id", "before": "S1", "after": "S2"}, None), ({"field": "reference_period", "before": "{}", "after": '{"period_start":"2024-02-01","period_end":"2024-01-01","period_kind":"annual","period_basis":"fiscal"}'}, "period_order"),
    ({"action": "update_assumption", "field": "assumption_status", "before": None, "after": "done"}, "assumption_value"), ({"after": "100"}, "no_change"),
])
def test_feedback_rules(spark, change, reason):
    assert validated(spark, EVENT | change).first().rejection == reason


def test_feedback_import(spark):
    rows = [EVENT, EVENT, EVENT | dict(after="102"), EVENT | dict(idempotency_key="k2", feedback_id="f2", after="103"), EVENT | dict(idempotency_key="k3"), EVENT | dict(idempotency_key="k4", feedback_id="f4", source_run="x")]
    v = validated(spark, *rows)
    got = [(r.result, r.rejection) for r in feedback.imported(v, v.where("false")).orderBy("event_index").collect()]
    assert got == [("accepted", None), ("duplicate", None), ("rejected", "idempotency_payload_conflict"), ("accepted", None), ("rejected", "feedback_id_collision"), ("rejected", "wrong_source_run")]
    journal = feedback.imported(v, v.where("false")).where("result = 'accepted'")
    again = [r.result for r in feedback.imported(validated(spark, EVENT, EVENT | dict(after="105")), journal).orderBy("event_index").collect()]
    assert again == ["duplicate", "rejected"]
    c = feedback.conflicts(journal)
    assert c.first().feedback_ids == ["f1", "f2"] and [r.review_status for r in feedback.marked(journal).orderBy("event_index").collect()] == ["candidate", "conflict_candidate"]
    cid = c.first().conflict_id
    d = spark.createDataFrame([(cid, "adopt", ["f1"], "o"), (cid, "adopt", ["f1", "f2"], "o"), (cid, "merge", ["f1"], "o"), (cid, "merge", ["f1", "f2"], "o"), (cid, "defer", [], "o"), ("x", "defer", [], "o"), (cid, "keep", [], "o")], "conflict_id string, decision string, selected array<string>, owner string")
    assert [r.rejection for r in feedback.resolved(c, journal, d).orderBy("decision", F.size("selected"), "conflict_id").collect()] == [None, "select_one_feedback", None, "unknown_conflict_or_feedback", "invalid_resolution", "merge_requires_multiple", "merge_requires_equal_values_submit_new_revision_for_other_values"]
    assert feedback.snapshot(journal, spark.createDataFrame([("c1", "v2")], "card_id string, card_version string")).count() == 0


def test_constraints(spark):
    df = spark.createDataFrame([(1, "a", 5, ("x",)), (2, "z", -1, (None,)), (3, None, None, None)], "id int, k string, n int, s struct<t:string>")
    rules = constraints.schema_rules({"required": ["k"], "properties": {"k": {"enum": ["a", "b"]}, "n": {"minimum": 0, "type": "integer"}, "s": {"properties": {"t": {"const": "x"}}, "required": ["t"]}}})
    got = {r.id: r.errors for r in constraints.checked(df, rules).collect()}
    assert got == {1: [], 2: ["k:enum", "n:minimum", "s.t:required"], 3: ["k:required", "s.t:required"]}
    with pytest.raises(ValueError, match="unsupported"):
        constraints.schema_rules({"oneOf": []})
    m = spark.createDataFrame([(None, {"v": "why"}), (None, {}), ("1", {"v": "why"}), ("1", {})], "v string, field_missing_reasons map<string,string>")
    assert [r.errors for r in constraints.checked(m, constraints.missing_reason_rules(["v"], allowed=["why"])).collect()] == [[], ["v:missing_without_reason"], ["v:stale_reason"], []]
    assert constraints.orphans(df, spark.createDataFrame([("a",)], "p string"), "k", "p").first().id == 2 and constraints.duplicates(df.unionByName(df), ["id"]).count() == 3
    assert constraints.same_rows(df.select("id"), df.select("id")) and not constraints.same_rows(df.select("id"), df.select("id").limit(2))
    sp = spark.createDataFrame([("d", 0, 2, "a😀"), ("d", 0, 2, "ab"), ("d", 2, 9, "b"), ("x", 0, 1, "a")], "k string, start int, end int, text string")
    bad = constraints.round_trip(sp, spark.createDataFrame([("d", "a😀b")], "k string, source string"), "k").collect()
    assert sorted(r.errors[0] for r in bad) == ["span_out_of_range", "text_mismatch", "unknown_source"]
    e = constraints.layer_violations(spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "q")], "from_id string, to_id string"), spark.createDataFrame([("a", "driver"), ("b", "metric")], "id string, layer string"), ["driver", "metric"])
    assert {(r.from_id, r.to_id): r.errors for r in e.collect()} == {("b", "a"): ["layer_order"], ("a", "q"): ["unknown_node"]}
    reg = spark.createDataFrame([("s", "d", "/news", "approved", "2020-01-01", "2030-01-01", "none", True, True, True, True), ("s", "d", "/blog", "approved", "2020-01-01", "2021-01-01", "none", True, True, True, True)], "source_id string, domain string, url_path_prefix string, rights_status string, available_from string, available_to string, authentication string, collect boolean, store boolean, analyze boolean, display_excerpt boolean")
    req = spark.createDataFrame([(1, "s", "d", "/news/1", "2024-01-01"), (2, "s", "d", "/blog/1", "2024-01-01"), (3, "s", "d", "/x", "2024-01-01")], "request_id int, source_id string, domain string, path string, on string")
    assert {r.request_id: r.refusal for r in constraints.rights_gate(req, reg).collect()} == {1: None, 2: "after_availability", 3: "no_rights_row"}


RULES = extraction.Rules("C", "Co", "C-ALL", {"Revenue": ("revenue", "flow", "income", "preserve"), "Capex": ("positive_cash_capex", "flow", "cash", "outflow_to_positive"), "Cash": ("cash", "balance", "balance", "preserve")}, {"Cloud": "SEG-1"}, {"In millions": "1000000"}, {"D": ("r", "h", "2024-07-30", "2024-07-31", "seg-1")})
CELL = dict(input_id="i", input_kind="numeric_cell", doc_id="D", revision_id="r", source_sha256="h", published_date="2024-07-30", observed_at="2024-07-31", value_cell="1,234.5", row_label=" Revenue ", period_header="Three Months Ended June 30,", year_header="2024", unit_header="In millions", company_id="C", company_name="Co", scope_label="company financial statement total", table_purpose="income", currency="USD", accounting_basis="GAAP", source_qualifier="company_reported_unaudited", evidence_refs=["e"])


@pytest.mark.parametrize("change, status, reason", [
    ({}, "predicted", None), ({"evidence_refs": []}, "quarantined", "evidence_missing"), ({"doc_id": "X"}, "abstained", "document_not_allowlisted"), ({"source_sha256": "x"}, "quarantined", "revision_or_hash_mismatch"), ({"published_date": "2024-01-01"}, "quarantined", "publication_metadata_mismatch"), ({"company_name": "Other"}, "abstained", "company_context_mismatch"),
    ({"scope_label": "Cloud"}, "abstained", "ambiguous_company_scope"), ({"row_label": "Sales"}, "abstained", "unknown_or_ambiguous_metric_alias"), ({"year_header": ""}, "abstained", "missing_or_ambiguous_year_header"), ({"row_label": "Cash"}, "abstained", "balance_flow_period_conflict"), ({"row_label": "Cash", "period_header": "June 30, 2024"}, "predicted", None),
    ({"source_qualifier": "audited"}, "abstained", "unsupported_source_qualifier"), ({"currency": "EUR"}, "abstained", "unsupported_currency_or_accounting"), ({"unit_header": ""}, "abstained", "missing_or_unsupported_unit"), ({"value_cell": "-"}, "abstained", "dash_not_zero"), ({"row_label": "Capex", "value_cell": "5"}, "abstained", "positive_capex_source_sign_ambiguous"), ({"row_label": "Capex", "value_cell": "(5)"}, "predicted", None),
    ({"table_purpose": "segment_revenue", "row_label": "Cloud", "scope_label": "Cloud"}, "abstained", "unsupported_segment_table_period"), ({"table_purpose": "segment_revenue", "row_label": "Cloud", "scope_label": "Cloud", "period_header": "Twelve Months Ended June 30,"}, "predicted", None), ({"input_kind": "relation_context", "value_cell": None, "table_purpose": "segment_revenue", "row_label": "Cloud", "scope_label": "Cloud", "period_header": "Twelve Months Ended June 30,", "source_qualifier": "company_reported_table"}, "predicted", None), ({"input_kind": "relation_context", "value_cell": None}, "abstained", "relation_requires_segment_reporting_table"),
])
def test_extraction(spark, change, status, reason):
    row = CELL | change
    inputs = spark.createDataFrame([tuple(row[f.name] for f in INPUT.fields)], INPUT)
    out = extraction.extract(inputs, RULES, "run")
    r = out.first()
    assert (r.status, r.reasons) == (status, [reason] if reason else [])
    if not change:
        assert (r.numeric_value, r.metric_id, r.reference_period.duration_days) == ("1234500000", "revenue", 91)
    if change.get("value_cell") == "(5)":
        assert (r.numeric_value, r.source_numeric_value) == ("5000000", "-5")
    if change.get("input_kind") and status == "predicted":
        assert (r.record_kind, r.object_entity_id, r.numeric_value) == ("reporting_relation", "SEG-1", None)
    assert all(extraction.batch_checks(out, inputs).first().asDict().values())


def test_relational(spark):
    o = spark.createDataFrame([(1, "2024-01-01", 5), (1, "2024-02-01", 6), (1, "2024-02-01", 7), (2, "2025-01-01", 8)], "k int, d string, id int")
    assert sorted(map(tuple, relational.latest(o, ["k"], ["d", "id"], ("d", "2024-12-31")).collect())) == [(1, "2024-02-01", 7)]
    assert [r.dedup_status for r in relational.first_copies(spark.createDataFrame([(1, None), (2, None), (3, "x")], "id int, k string"), ["k"], ["id"]).orderBy("id").collect()] == ["first", "duplicate", "first"]
    n = relational.nearest(spark.createDataFrame([("p", 10)], "k string, x int"), spark.createDataFrame([("p", 7, "a"), ("p", 13, "b"), ("q", 10, "c")], "k string, y int, n string"), "k", "x", "y").first()
    assert n.nearest.n == "a"
    c = relational.column_spans(spark.createDataFrame([(1, 0, 2), (1, 1, 3)], "row int, i int, colspan int"), ["row"], "i").orderBy("i").collect()
    assert [(r.col_start, r.col_end) for r in c] == [(0, 2), (2, 5)]
    t = relational.top_scored(spark.createDataFrame([(1, 3, "b"), (1, 3, "a"), (1, 1, "c")], "k int, s int, n string"), ["k"], F.col("s"), "n").first()
    assert t.n == "a"


def test_ranked_over_many_rows(spark):
    """A million wide rows, whose keys sample unevenly: positions equal those of one sort."""
    n = 1_000_000
    d = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("record_id"), F.when(F.col("id") % 7 != 0, F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * F.col("id") % 900).cast("int")), "yyyy-MM-dd")).alias("published_date"), F.when(F.col("id") % 3 == 0, "scope_availability").when(F.col("id") % 5 == 0, "segment_definition").otherwise("evidence_review").alias("reason_group"), F.repeat(F.col("id").cast("string"), 10).alias("wide"))
    out = review.positions(d)
    assert out.columns == [*d.columns, "chronological_position", "grouped_position"]
    pdf = out.select("record_id", "published_date", "reason_group", "chronological_position", "grouped_position").toPandas()
    assert len(pdf) == n
    pdf["none"] = pdf.published_date.isna()
    by = pdf.sort_values(["none", "published_date", "record_id"], kind="stable")
    assert by.chronological_position.tolist() == list(range(1, n + 1))
    pdf["place"] = pdf.reason_group.map({g: i for i, g in enumerate(review.GROUP_ORDER)})
    by = pdf.sort_values(["place", "none", "published_date", "record_id"], kind="stable")
    assert by.grouped_position.tolist() == list(range(1, n + 1))


def test_first_copies_keep_one_of_equal_rows(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 1, "x"), ("a", 2, "z"), ("b", 1, "q"), ("b", 1, "q"), (None, 1, "n"), (None, 1, "n"), ("c", None, "m")]
    got = relational.first_copies(spark.createDataFrame(rows, "k string, o int, v string"), ["k"], ["o"]).collect()
    assert len(got) == len(rows)
    firsts = [(r.k, r.o) for r in got if r.dedup_status == "first"]
    assert sorted(firsts, key=str) == sorted([("a", 1), ("b", 1), (None, 1), ("c", None)], key=str)


def test_stepwise_queue_equals_the_one_task_one(spark, monkeypatch):
    import random

    r = random.Random(2)
    rows = [(i, r.choice("abcdefg") if r.random() < 0.9 else None, f"s{r.randint(0, 30)}", r.random() < 0.1, r.randint(0, 99)) for i in range(500)]
    d = spark.createDataFrame(rows, "record_id int, family string, source string, short boolean, ord int")
    one = sorted((x.position, x.record_id) for x in review.diverse_queue(d, 12).collect())
    monkeypatch.setattr(review, "ONE_TASK", 10)
    assert sorted((x.position, x.record_id) for x in review.diverse_queue(d, 12).collect()) == one


def test_similar_classes(spark):
    rows = [(1, "x", ["a", "b", "c"]), (2, "x", ["c", "b", "a"]), (3, "x", ["a", "b"]), (4, "y", ["a", "b", "c"]), (5, None, ["a"]), (6, None, ["a"]), (7, "x", []), (None, "x", ["a"])]
    links, member = align.similar_classes(spark.createDataFrame(rows, "id int, b string, g array<string>"), ["b"], "g", 0.6, id_col="id")
    assert [(x.b, x.left_id, x.right_id) for x in links.collect()] == [("x", 1, 3)]
    assert sorted((x.id, x["class"]) for x in member.collect()) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 5)]


def test_wide_intervals_fill_few_bins(spark):
    a = spark.createDataFrame([("k", 0, 10_000_000), ("k", 5, 6)], "k string, start int, end int")
    b = spark.createDataFrame([("k", 3, 9), ("k", 9_999_999, 10_000_005)], "k string, start int, end int")
    got = sorted((x.l.start, x.r.start, x.overlap_start, x.overlap_end) for x in align.interval_overlap(a, b, "k").collect())
    assert got == [(0, 3, 3, 9), (0, 9_999_999, 9_999_999, 10_000_000), (5, 3, 5, 6)]


@pytest.mark.parametrize("first", [4, 1024])
def test_similar_pairs_over_blocks(spark, monkeypatch, first):
    """Sets in many blocks, several keys in one block, common sizes, and a first product that doesn't hold all members."""
    monkeypatch.setattr(align, "BLOCK_WEIGHT", 3000)
    monkeypatch.setattr(align, "FIRST_MEMBERS", first)
    r = random.Random(8)
    seeds = [[f"g{r.randint(0, 40)}" for _ in range(r.choice([5, 12, 12, 25]))] for _ in range(12)]
    rows = [(i, r.choice(["x", "y", None]), [g for g in r.choice(seeds) if r.random() < 0.93] + ["z"] * r.randint(0, 1)) for i in range(150)]
    got = sorted((x.left_id, x.right_id, x.b, round(x.jaccard, 9)) for x in align.similar_pairs(spark.createDataFrame(rows, "id int, b string, g array<string>"), ["b"], "g", 0.8, id_col="id").collect())
    j = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0
    want = sorted((a[0], b[0], a[1], round(j(a[2], b[2]), 9)) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and j(a[2], b[2]) >= 0.8)
    key = lambda x: (x[0], x[1])
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 100


def test_equal_sets_need_no_comparison(spark, monkeypatch):
    """A group whose equal sets give all pairs of the choice compares no classes."""
    monkeypatch.setattr(align, "similar_pairs", None)
    rows = [(i, "x", ["a", "b", f"c{i // 4}"]) for i in range(12)]
    found = align.greedy_one_to_one(align.best_candidates(spark.createDataFrame(rows, "id int, b string, g array<string>"), "b", "g", 0.3, 8, id_col="id"), "b", 8)
    assert sorted((x.left_id, x.right_id) for x in found.collect()) == [(0, 1), (1, 2), (2, 3), (4, 5), (5, 6), (6, 7), (8, 9), (9, 10)]


def test_grams_of_long_code_points(spark):
    assert spark.createDataFrame([("a😀b\nc",), ("ab",), (None,)], "t string").select(text.grams(F.col("t")).alias("g")).collect() == [(sorted(["a😀b", "😀b\n", "b\nc"]),), ([],), (None,)]


def test_nearest_keeps_rows_where_the_join_has_them(spark):
    rows = spark.range(40).selectExpr("id % 5 as k", "cast(id as int) as x")
    out = relational.nearest(rows, rows.select("k", F.col("x").alias("y")), "k", "x", "y")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = out.select("k", "x", "nearest.y")._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[-1].count("Exchange") == 2 and all(r.x == r.y for r in out.select("x", "nearest.y").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_facts_meet_without_digests(spark):
    from priorlens.operators import routing

    rows = spark.createDataFrame([(1, None, 0.5), (2, None, 0.5), (3, "a", None), (4, "a", None), (5, "a", 0.1)], "d int, k string, v double")
    out = routing.corroborated(rows, ["k"], "v", "d")
    assert "sha2" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.d, r.others, r.agreeing, r.corroboration) for r in out.collect()) == [(1, 1, 1, "one"), (2, 1, 1, "one"), (3, 2, 1, "one"), (4, 2, 1, "one"), (5, 2, 0, "conflict")]


def test_cube_takes_rows_summed_by_part(spark):
    import os

    from priorlens.plans import record_queries

    plan = record_queries.cube_totals(spark, f"{os.environ.get('TEST_DATA', '/root/testdata')}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Expand")[-1]
