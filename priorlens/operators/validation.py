"""Validators of located text, annotations, evidence, facts and run summaries, each as a column of error codes.

The codes are fixed values. A rule over an unknown value counts as broken only where the value is required."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.reasons import codes
from ..sources import store

NO_TEXTS = "cast(array() as array<string>)"


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def _absent(fields: Sequence[str], have: Sequence[str], label: str) -> list[tuple[Column, str]]:
    """Rules for fields that a table lacks altogether."""
    return [(F.lit(True), f"{label}:{f}") for f in fields if f not in have]


def _fields(df: DataFrame, column: str) -> list[str]:
    return [f.name for f in df.schema[column].dataType.fields] if column in df.columns else []


def _number(c: Column) -> Column:
    """The decimal behind a printed amount: currency and grouping marks go, brackets mean minus."""
    return F.replace(F.translate(c, "$,)", ""), F.lit("("), F.lit("-")).try_cast("decimal(38,10)")


def block_errors(blocks: DataFrame) -> DataFrame:
    """Adds ``errors``. blocks: raw_text, normalized_text, offset_mapping (unit, status), spans (start, end, text),
    source_xpath, xpath_texts (what the locator selects; null if it can't be read), location_status, evidence_eligible.
    Offsets are code points. A block without text is an empty one, without spans it has none."""
    raw, mapping, located = F.coalesce("raw_text", F.lit("")), F.col("offset_mapping"), F.coalesce(F.col("source_xpath") != "", F.lit(False))

    def broken(s: Column) -> Column:
        inside = F.coalesce((s["start"] >= 0) & (s["start"] <= s["end"]) & (s["end"] <= F.length(raw)), F.lit(False))
        return ~inside | _differs(F.substring(raw, s["start"] + 1, s["end"] - s["start"]), s["text"])

    selected = F.col("xpath_texts")
    one = (F.size(selected) == 1) & F.get(selected, F.lit(0)).eqNullSafe(raw)
    return blocks.withColumn("errors", codes(
        (_differs(mapping["unit"], F.lit("unicode_codepoint")), "offset_unit_invalid"),
        ((mapping["status"] == "identity") & (raw != F.coalesce("normalized_text", F.lit(""))), "identity_round_trip_failed"),
        (F.exists("spans", broken), "span_round_trip_failed"),
        (located & selected.isNotNull() & ~one, "source_xpath_round_trip_failed"), (located & selected.isNull(), "source_xpath_invalid"),
        (~located & _differs(F.col("location_status"), F.lit("text_only_unlocated")), "missing_source_location"),
        (F.col("evidence_eligible") & (~located | (mapping["status"] == "not_available")), "unlocated_or_unmapped_evidence_forbidden"),
    ))


def evidence_errors(packets: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds ``errors`` to packets: their index rows must name the same document, use identity offsets and hold the texts of
    the packet's headers. packets: item_id, doc_id, revision_id, source_sha256, evidence_refs, raw (row_label,
    period_header, year_header, unit_header); evidence: evidence_id, doc_id, revision_id, source_sha256, offset_unit,
    offset_mapping, evidence_kind, selected_text. A date that serves as period and year needs one header only."""
    row = F.struct("doc_id", "revision_id", "source_sha256", "offset_unit", "offset_mapping", "evidence_kind", "selected_text").alias("_row")
    refs = packets.select("item_id", F.explode(F.array_distinct("evidence_refs")).alias("evidence_id"))
    by = refs.join(evidence.select("evidence_id", row), "evidence_id").groupBy("item_id").agg(F.collect_list("_row").alias("_rows"))
    j = packets.join(by, "item_id", "left").withColumn("_rows", F.coalesce("_rows", F.expr("cast(array() as " + by.schema["_rows"].dataType.simpleString() + ")")))
    some = lambda test: F.exists("_rows", lambda e: F.coalesce(test(e), F.lit(False)))
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    kinds = {"row_label": "row_label", "period_header": "period_header", "year_header": "year_header", "unit_header": "unit"}

    def unmatched(field: str, kind: str) -> Column:
        of = lambda k: some(lambda e: (e["evidence_kind"] == k) & (squeezed(e["selected_text"]) == squeezed(F.col(f"raw.{field}"))))
        if field != "period_header":
            return ~of(kind)
        shared = ~some(lambda e: e["evidence_kind"] == kind) & (F.col("raw.period_header") == F.col("raw.year_header"))
        return ~of(kind) & ~(F.coalesce(shared, F.lit(False)) & of("year_header"))

    found = codes(
        (F.size("_rows") < F.size(F.array_distinct("evidence_refs")), "unknown_evidence"),
        *[(some(lambda e, k=k: _differs(e[k], F.col(k))), f"Evidence identity mismatch: {k}") for k in ("doc_id", "revision_id", "source_sha256")],
        (some(lambda e: _differs(e["offset_unit"], F.lit("unicode_code_point")) | _differs(e["offset_mapping"], F.lit("identity"))), "Unsupported evidence offsets"),
        *[(unmatched(f, k), f"Source header/label reference mismatch: {f}") for f, k in kinds.items()],
    )
    return j.withColumn("errors", found).drop("_rows")


PLACES = ["evidence_pointer", "period_header_pointer", "year_header_pointer"]
#: Documents are counted in so many parts by hash, to find those that are too large for one task.
PARTS = 65_536


def _part() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))


def _dealt(facts: DataFrame, cells: DataFrame) -> tuple[int, list[int]]:
    """The number of tasks for facts and cells, and the parts of documents that would crowd one of them."""
    rows = facts.select(_part().alias("p")).unionAll(cells.select(_part().alias("p"))).groupBy("p").count().collect()
    every = sum(r["count"] for r in rows)
    n = max(facts.sparkSession.sparkContext.defaultParallelism, -(-every // store.TASK_ROWS))
    return n, [r["p"] for r in rows if r["count"] > max(store.TASK_ROWS, 4 * every // n)]


def _read_by_document(facts: DataFrame, cells: DataFrame, n: int) -> DataFrame:
    """facts with the text of each place as ``_<place>``. Facts and cells are dealt once, by document; places then meet in
    windows inside the task, which take no other shuffle and hold one place at a time."""
    rows = facts.withColumns({"_at": F.lit(None).cast("string"), "_text": F.lit(None).cast("string")})
    rows = rows.unionByName(cells.select("doc_id", F.col("pointer").alias("_at"), F.col("text").alias("_text")), allowMissingColumns=True).repartition(n, "doc_id")
    for p in PLACES:
        rows = rows.withColumn(f"_{p}", F.min("_text").over(Window.partitionBy("doc_id", F.coalesce("_at", p))))
    return rows.where("_at is null").drop("_at", "_text")


def _read_by_place(facts: DataFrame, cells: DataFrame, n: int) -> DataFrame:
    """The same for documents of any size: every place is a keyed join, which shuffles the facts again."""
    once = cells.repartition(n, "doc_id", "pointer").groupBy("doc_id", "pointer").agg(F.min("text").alias("_text"))
    for p in PLACES:
        facts = facts.repartition(n, "doc_id", p).join(once.select("doc_id", F.col("pointer").alias(p), F.col("_text").alias(f"_{p}")).hint("merge"), ["doc_id", p], "left")
    return facts


def fact_errors(facts: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds ``errors``: every number is read again at its place. facts: claim_id, doc_id, evidence_pointer,
    value_span_start, value_span_end, value_raw, sign_policy, numeric_value, scale, numeric_value_base_units,
    balance_or_flow, period_start, period_end, period_duration_days, expected_header, fiscal_year,
    period_header_pointer, year_header_pointer; cells: doc_id, pointer, text; of several texts of a place the smallest counts.
    Facts without header pointers aren't held against headers. Nothing is gathered. Facts and cells go through one shuffle by
    document, but those of crowded documents, and what was found goes through one by claim, as bits."""
    n, crowded = _dealt(facts, cells)
    dec = lambda c: F.col(c).try_cast("decimal(38,10)")
    days = F.datediff(F.col("period_end").try_cast("date"), F.col("period_start").try_cast("date")) + 1
    # what needs no cell is known before rows are dealt
    known = facts.withColumns({"_days": (F.col("balance_or_flow") == "flow") & _differs(days, F.col("period_duration_days")), "_flip": F.col("sign_policy") == "outflow_to_positive"})
    placed = cells.select("doc_id", "pointer", "text").where("doc_id is not null and pointer is not null")
    if crowded:
        some = _part().isin(crowded)
        j = _read_by_document(known.where(~some), placed.where(~some), n).unionByName(_read_by_place(known.where(some), placed.where(some), n))
    else:
        j = _read_by_document(known, placed, n)
    at = lambda p: F.col(f"_{p}")
    tight = lambda c: F.regexp_replace(c, r"\s+", "")
    cell, start, end = at(PLACES[0]), F.col("value_span_start"), F.col("value_span_end")
    read = F.substring(cell, start + 1, end - start)
    value = _number(read)
    signed = F.when(F.col("_flip"), -value).otherwise(value)
    base = signed.cast("decimal(24,6)") * dec("scale").cast("decimal(14,4)")
    rules = [
        (cell.isNull(), "evidence_cell_missing"), (cell.isNotNull() & _differs(read, F.col("value_raw")), "value_span_mismatch"), (cell.isNotNull() & value.isNull(), "value_not_numeric"),
        (value.isNotNull() & _differs(signed, dec("numeric_value")), "signed_value_mismatch"), (value.isNotNull() & _differs(base, dec("numeric_value_base_units")), "base_units_mismatch"), (F.col("_days"), "period_length_mismatch"),
        (F.col(PLACES[1]).isNotNull() & ~F.coalesce(tight(at(PLACES[1])).contains(tight(F.col("expected_header"))), F.lit(False)), "period_header_mismatch"),
        (F.col(PLACES[2]).isNotNull() & ~F.coalesce(at(PLACES[2]).contains(F.col("fiscal_year").cast("string")), F.lit(False)), "year_header_mismatch"),
    ]
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(broken, 1 << k).otherwise(0) for k, (broken, _) in enumerate(rules)])
    j = j.select(*facts.columns, bits.alias("_bits")).repartition(n, "claim_id").withColumn("_n", F.count("claim_id").over(Window.partitionBy("claim_id")))
    found = codes((F.col("_n") > 1, "claim_id_repeated"), *[(F.col("_bits").bitwiseAND(F.lit(1 << k)) != 0, code) for k, (_, code) in enumerate(rules)])
    return j.withColumn("errors", found).select(*facts.columns, "errors")


def annotation_errors(annotations: DataFrame, packets: DataFrame, contract: Mapping[str, object]) -> DataFrame:
    """Adds ``errors`` to drafts of annotations: against the contract, their packet (one an item) and their own numbers.
    A draft that lacks a required column, whose item is unknown, or that lacks facts has the errors found until then.
    contract: required_top_level, method, guide_version, numeric_fact_fields, relation_fact_fields,
    provenance_required_fields, offset_basis, exposure_flags_required, relation (field -> value), retrospective_scopes."""
    top = _absent(contract["required_top_level"], annotations.columns, "missing")
    if top:
        return annotations.withColumn("errors", codes(*top))
    have, known = _fields(annotations, "facts"), _fields(annotations, "provenance")
    j = annotations.join(packets.select("item_id", F.struct(*packets.columns).alias("_p")), "item_id", "left")
    f, p, v = F.col("facts"), F.col("_p"), F.col("provenance")
    numeric = F.col("item_type") == "numeric_claim"
    head = codes(
        (_differs(F.col("annotator_kind"), F.lit("agent")) | _differs(F.col("status"), F.lit("agent_draft")), "agent_output_must_not_claim_human_or_gold"),
        (_differs(F.col("method"), F.lit(contract["method"])), "undisclosed_annotation_method"), (_differs(F.col("guide_version"), F.lit(contract["guide_version"])), "wrong_guide_version"),
        (p.isNull(), "unknown_item_id"), (p.isNotNull() & _differs(F.col("item_type"), p["item_type"]), "wrong_item_type"),
        *[(p.isNotNull() & numeric, f"missing_fact:{k}") for k in contract["numeric_fact_fields"] if k not in have],
        *[(p.isNotNull() & ~F.coalesce(numeric, F.lit(False)), f"missing_fact:{k}") for k in contract["relation_fact_fields"] if k not in have],
    )
    same = lambda fields, other, label: [(_differs(f[k], other[k]), f"{label}:{k}") for k in fields if k in have]
    sets = lambda a, b: _differs(F.array_sort(F.array_distinct(a)), F.array_sort(F.array_distinct(b)))
    flags = F.coalesce(F.col("exposure_flags"), F.expr(NO_TEXTS))
    fact = lambda k: f[k] if k in have else F.lit(None)
    said = F.coalesce(F.map_keys("field_missing_reasons"), F.expr(NO_TEXTS))
    rules = [
        *same(["doc_id", "revision_id", "event_id", "event_family_id", "source_claim_id"], p, "packet_identity_mismatch"),
        *same(["published_at", "published_date", "time_precision"], p["publication"], "publication_mismatch"),
        (fact("published_at").isNotNull(), "invented_exact_publication_time"), (sets(F.col("evidence_refs"), p["evidence_refs"]), "evidence_reference_set_changed"),
        *_absent(contract["provenance_required_fields"], known, "missing_provenance"),
        (_differs(v["doc_sha256"], p["source_sha256"]), "source_hash_mismatch"), (_differs(v["source_record_ref"], p["source_record_ref"]), "source_record_ref_mismatch"),
        (_differs(v["availability_dependency_refs"], p["scope_dependency_refs"]), "scope_dependency_dropped_or_added"), (_differs(v["offset_basis"], F.lit(contract["offset_basis"])), "offset_basis_not_original_unicode_cell"),
        (~reduce(lambda a, b: a & b, [F.array_contains(flags, x) for x in contract["exposure_flags_required"]], F.lit(True)), "missing_exposure_flags"),
        *[(f[k].isNull() & ~F.array_contains(said, f"facts.{k}"), f"null_without_reason:facts.{k}") for k in have],
    ]
    raw, start, end = p["raw"]["value_cell"], fact("value_span_start").cast("int"), fact("value_span_end").cast("int")
    bounds = F.coalesce((start >= 0) & (end >= start), F.lit(False))
    parsed = _number(fact("value_raw").cast("string"))
    dec = lambda k: fact(k).cast("string").try_cast("decimal(38,10)")
    value = F.when(fact("sign_policy") == "outflow_to_positive", -parsed).otherwise(parsed)
    unread = parsed.isNull() | dec("numeric_value").isNull() | dec("scale").isNull() | dec("numeric_value_base_units").isNull()
    day = lambda k: fact(k).cast("string").try_cast("date")
    days = F.datediff(day("period_end"), day("period_start")) + 1
    instant, span = fact("period_kind") == "instant", fact("period_kind") == "duration"
    numbers = [
        (~bounds | _differs(F.substring(raw, start + 1, end - start), fact("value_raw")), "source_span_roundtrip_failed"), (unread, "invalid_decimal"), (~unread & (value != dec("numeric_value")), "source_sign_or_value_mismatch"),
        (~unread & (value.cast("decimal(24,6)") * dec("scale").cast("decimal(14,4)") != dec("numeric_value_base_units")), "scale_conversion_mismatch"),
        (instant & (fact("period_start").isNotNull() | fact("period_end").isNotNull() | fact("duration_days").isNotNull()), "instant_is_not_duration"), (instant & (F.coalesce(fact("as_of_date").cast("string"), F.lit("")) == ""), "instant_missing_asof"),
        (span & fact("as_of_date").isNotNull(), "flow_has_asof"), (span & days.isNull(), "invalid_period_date"), (span & ((days <= 0) | (days != fact("duration_days"))), "period_length_mismatch"),
        (~F.coalesce(instant | span, F.lit(False)), "unknown_period_kind"),
        (fact("scope_id").isin(list(contract["retrospective_scopes"])) & _differs(fact("scope_status_as_of"), F.lit("unresolved_retrospective_dependency")), "historical_scope_support_overclaimed"),
    ]
    relations = [
        *[(_differs(fact(k), F.lit(x)), f"reporting_relation_semantics:{k}") for k, x in contract["relation"].items()], (_differs(fact("scope_id"), fact("object_entity_id")), "reporting_scope_mismatch"),
        (reduce(lambda a, b: a | b, [fact(k).isNotNull() for k in ("effective_period_start", "effective_period_end", "valid_from", "valid_to")]), "reporting_period_is_not_business_validity"),
    ]
    rest = codes(*rules, *[(numeric & c, k) for c, k in numbers], *[(~F.coalesce(numeric, F.lit(False)) & c, k) for c, k in relations])
    stop = p.isNull() | F.exists("_head", lambda e: e.startswith("missing_fact:"))
    return j.withColumn("_head", head).withColumn("errors", F.when(stop, F.col("_head")).otherwise(F.array_distinct(F.concat("_head", rest)))).drop("_p", "_head")


#: The questions of an assessment, and those that history alone can't answer.
QUESTIONS = ["MQ01", "MQ02", "MQ03", "MQ04", "MQ05", "MQ06", "MQ07", "MQ08"]
UNANSWERABLE = ["MQ01", "MQ02", "MQ03", "MQ04", "MQ05", "MQ07"]


def assessment_errors(assessments: DataFrame, annotations: DataFrame, contract: Mapping[str, object]) -> DataFrame:
    """Adds ``errors`` to assessments. assessments: annotation_id, annotator_kind, purpose, as_of_precision,
    review_readiness, guide_version, exposure_flags, questions (question_id, response, reason); contract:
    assessment_file_required_top_level, exposure_flags_required, guide_version, assessment_response_enums."""
    top = _absent(contract["assessment_file_required_top_level"], assessments.columns, "missing")
    if top:
        return assessments.withColumn("errors", codes(*top))
    j = assessments.join(annotations.select("annotation_id").distinct().withColumn("_in", F.lit(True)), "annotation_id", "left")
    enums = F.create_map(*[x for k, v in contract["assessment_response_enums"].items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    flags = F.coalesce(F.col("exposure_flags"), F.expr(NO_TEXTS))
    tagged = lambda label, test: F.transform(F.filter("questions", lambda q: F.coalesce(test(q), F.lit(False))), lambda q: F.concat(F.lit(label), F.coalesce(q["question_id"], F.lit("None"))))
    open_ = ["unknown", "not_assessed", "not_applicable"]
    own = codes(
        (F.col("_in").isNull(), "unknown_annotation_id"), (_differs(F.col("annotator_kind"), F.lit("agent")), "assessment_must_be_agent"),
        (_differs(F.col("purpose"), F.lit("historical_comparison")) | _differs(F.col("as_of_precision"), F.lit("date")), "assessment_purpose_or_precision"),
        (_differs(F.col("review_readiness"), F.lit("needs_review")), "historical_comparison_missing_prior"),
        (_differs(F.array_sort(F.array_distinct(F.transform("questions", lambda q: q["question_id"]))), F.array(*map(F.lit, QUESTIONS))), "question_coverage_mismatch"),
        (~reduce(lambda a, b: a & b, [F.array_contains(flags, x) for x in contract["exposure_flags_required"]], F.lit(True)), "assessment_exposure_omitted"),
        (_differs(F.col("guide_version"), F.lit(contract["guide_version"])), "wrong_assessment_guide_version"),
    )
    each = [
        tagged("assessment_missing_reason:", lambda q: F.coalesce(q["reason"], F.lit("")) == ""),
        tagged("unsupported_materiality_or_prior_answer:", lambda q: q["question_id"].isin(UNANSWERABLE) & ~F.coalesce(q["response"].isin(open_), F.lit(False))),
        tagged("invalid_assessment_response:", lambda q: ~F.coalesce(F.array_contains(F.try_element_at(enums, q["question_id"]), q["response"]), F.lit(False))),
    ]
    return j.withColumn("errors", F.array_distinct(F.concat(own, *[F.coalesce(e, F.expr(NO_TEXTS)) for e in each]))).drop("_in")


def pair_errors(annotations: DataFrame, assessments: DataFrame, contract: Mapping[str, object], authors: Sequence[str]) -> DataFrame:
    """One row per distinct ``error`` of two authors' annotations and assessments as sets: identities, repeats, missing
    peers and parents. annotations: annotation_id, annotator_id, item_id, item_type, guide_version, registry_version,
    annotator_kind, facts (source_claim_id, source_relation_id, doc_id), provenance (source_record_ref); assessments:
    assessment_id, annotation_id, annotator_id, item_id, annotator_kind, guide_version, questions (question_id, response).
    Everything is a keyed aggregate or join; no author's set is gathered."""
    text = lambda *parts: F.concat_ws(":", *[F.coalesce(x, F.lit("None")) if isinstance(x, Column) else F.lit(x) for x in parts])
    known = lambda c: F.coalesce(c.isin(list(authors)), F.lit(False))
    who, item, tag = F.col("annotator_id"), F.col("item_id"), F.col("annotation_id")
    guide, f = contract["guide_version"], F.col("facts")
    named = F.coalesce(item != "", F.lit(False))
    typed = F.coalesce(F.col("item_type").isin("numeric_claim", "reporting_relation"), F.lit(False)) & f.isNotNull()
    own = F.when(F.col("item_type") == "numeric_claim", f["source_claim_id"]).otherwise(f["source_relation_id"])
    ok = known(who) & named
    row = codes(
        (~known(who), text("unexpected_author", tag, who)), (known(who) & ~named, text("invalid_item_id", tag)),
        (ok & _differs(F.col("annotator_kind"), F.lit("agent")), text("nonagent_record", tag)), (ok & _differs(F.col("guide_version"), F.lit(guide)), text("guide_mismatch", tag)),
        (ok & ~typed, text("invalid_item_type_or_facts", tag)), (ok & typed & _differs(own, item), text("item_source_identity_mismatch", tag)),
        (ok & typed & ~item.startswith(F.concat(f["doc_id"], F.lit("-"))), text("item_document_identity_mismatch", tag)),
        (ok & typed & ~F.coalesce(F.col("provenance.source_record_ref").endswith(F.concat(F.lit("#"), item)), F.lit(False)), text("provenance_identity_mismatch", tag)),
    )
    # named before they are unfolded: unfolding expressions over structs breaks the pruning of nested columns in a union
    unfolded = lambda df, errors: df.select(errors.alias("errors")).select(F.explode("errors").alias("error"))
    out = [unfolded(annotations, row)]
    good = annotations.where(ok)
    repeated = lambda df, keys, label: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(text(label, *[F.col(k) for k in keys]).alias("error"))
    out += [repeated(good, ["annotator_id", "item_id"], "duplicate_item"), repeated(good, ["annotation_id"], "duplicate_annotation_id")]
    fields = ["item_type", "guide_version", "registry_version"]
    of = lambda a: F.max_by(F.when(who == a, F.struct(*fields)), F.when(who == a, tag))
    pairs = good.groupBy("item_id").agg(*[of(a).alias(f"_{i}") for i, a in enumerate(authors)])
    lacks = [F.col(f"_{i}").isNull() for i in range(len(authors))]
    peers = codes(
        *[(c, t) for i, a in enumerate(authors) for c, t in ((lacks[i], text("missing_peer", a, item)), (lacks[i], text("unequal_item_sets")))],
        *[(~(lacks[0] | lacks[1]) & _differs(F.col("_0")[k], F.col("_1")[k]), text("pair_identity_mismatch", item, k)) for k in fields],
    )
    out.append(unfolded(pairs, peers))

    a_tag, q = F.col("assessment_id"), F.col("questions")
    parents = good.groupBy("annotation_id").agg(F.max_by(F.struct("annotator_id", "item_id"), F.struct("annotator_id", "item_id")).alias("_parent"))
    j = assessments.join(parents, "annotation_id", "left")
    enums = F.create_map(*[x for k, v in contract["assessment_response_enums"].items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    ids = F.transform(q, lambda x: x["question_id"])
    wanted = F.array(*map(F.lit, sorted(contract["assessment_response_enums"])))
    fine = known(who)
    said = codes(
        (~fine, text("unexpected_assessment_author", a_tag)), (fine & F.col("_parent").isNull(), text("missing_annotation_parent", a_tag)),
        (fine & (_differs(F.col("_parent")["annotator_id"], who) | _differs(F.col("_parent")["item_id"], item)) & F.col("_parent").isNotNull(), text("assessment_parent_identity_mismatch", a_tag)),
        (fine & _differs(F.col("annotator_kind"), F.lit("agent")), text("nonagent_assessment", a_tag)), (fine & _differs(F.col("guide_version"), F.lit(guide)), text("assessment_guide_mismatch", a_tag)),
        (fine & q.isNull(), text("invalid_questions", a_tag)), (fine & q.isNotNull() & _differs(F.array_sort(ids), wanted), text("missing_or_duplicate_questions", a_tag)),
    )
    wrong = F.filter(q, lambda x: ~F.coalesce(F.array_contains(F.try_element_at(enums, x["question_id"]), x["response"]), F.lit(False)))
    label = lambda x: F.concat_ws(":", F.when(x["response"].isNull(), "missing_question_response").otherwise("invalid_question_response"), F.coalesce(a_tag, F.lit("None")), F.coalesce(x["question_id"], F.lit("None")))
    answers = F.when(fine & q.isNotNull(), F.transform(wrong, label)).otherwise(F.expr(NO_TEXTS))
    out.append(unfolded(j, F.concat(said, answers)))
    fair = assessments.where(fine)
    out += [repeated(assessments, ["assessment_id"], "duplicate_assessment_id"), repeated(fair, ["annotator_id", "item_id"], "duplicate_assessment_item")]
    sides = good.select("annotator_id", "item_id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(fair.select("annotator_id", "item_id", F.lit(0).alias("a"), F.lit(1).alias("b")))
    out.append(sides.groupBy("annotator_id", "item_id").agg(F.max("a").alias("a"), F.max("b").alias("b")).where("a <> b").select(text("assessment_item_set_mismatch", who).alias("error")))
    return reduce(DataFrame.unionByName, out).distinct()


def count_mismatches(actual: DataFrame, reported: Mapping[str, int | None]) -> DataFrame:
    """(field, expected, reported, equal) of a one-row table of recomputed counts against a summary; a field that the
    summary lacks is unequal."""
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("long").alias("expected"), F.lit(reported.get(c)).cast("long").alias("reported")) for c in actual.columns])
    return actual.select(F.inline(rows)).withColumn("equal", F.col("expected").eqNullSafe(F.col("reported")))


def denial_errors(probes: DataFrame) -> DataFrame:
    """Adds ``errors`` to probes (trial_id, http_status, retry_count, endpoint_requests_after_failure, observed_at,
    observation_precision): nothing is asked of a host after it refused, and a time is given or its lack explained."""
    counts = [F.col(c).try_cast("int") for c in ("retry_count", "endpoint_requests_after_failure")]
    denied = F.col("http_status").cast("string").isin("403", "429")
    return probes.withColumn("errors", codes(
        (counts[0].isNull() | counts[1].isNull(), "malformed_count"), (denied & ((counts[0] != 0) | (counts[1] != 0)), "requests_after_host_denial"),
        ((F.coalesce(F.col("observed_at").cast("string"), F.lit("")) == "") & _differs(F.col("observation_precision"), F.lit("run_trace_only")), "missing_timestamp_reason"),
    ))


def legacy_errors(rows: DataFrame, storage_prefix: str, id_prefix: str) -> DataFrame:
    """Adds ``errors`` to rows (storage_uri, company_id) that refer to inputs outside their own store or universe."""
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return rows.withColumn("errors", codes((filled("storage_uri") & ~F.replace("storage_uri", F.lit("\\"), F.lit("/")).startswith(storage_prefix), "legacy_artifact"), (filled("company_id") & ~F.col("company_id").startswith(id_prefix), "foreign_company_id")))
