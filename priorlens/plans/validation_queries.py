"""Validators, layout picks and article classification over the driver's tables. Each row breaks the rules that its number is
divisible by, so that the twin in SQL can say which codes must come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotate, articles, extraction, layout, tables, validation
from ..sources import markup
from ..sources.store import stored
from .queries import _money, _t, part_inputs
from .record_queries import query


def _none() -> Column:
    return F.lit(None).cast("string")


def _errors(*rules: str) -> str:
    """SQL for the codes, joined, of ``condition: code`` in order."""
    cases = ", ".join("case when {} then '{}' end".format(*r.split(" => ")) for r in rules)
    return f"array_to_string(list_filter([{cases}], lambda x: x is not null), '|')"


def _joined(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.concat_ws("|", "errors").alias("errors"))


@query(f"""with d as (select doc_id as k, coalesce(text, '') as t from documents)
select k as doc_id, {_errors("k % 3 = 0 => offset_unit_invalid", "k % 5 = 0 => identity_round_trip_failed", "k % 7 = 0 => span_round_trip_failed", "k % 2 = 0 and k % 11 = 0 and k % 13 <> 0 => source_xpath_round_trip_failed", "k % 2 = 0 and k % 13 = 0 => source_xpath_invalid", "k % 2 = 1 and k % 17 = 0 => missing_source_location", "k % 2 = 1 and k % 19 = 0 => unlocated_or_unmapped_evidence_forbidden")} as errors from d""")
def block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located blocks against their raw text: offsets, spans and the place they were taken from."""
    d, k = _t(spark, sf_dir, "documents"), F.col("doc_id")
    raw = F.coalesce("text", F.lit(""))
    end = F.least(F.lit(9), F.length(raw))
    span = F.struct(F.lit(0).alias("start"), F.when(k % 7 == 0, F.length(raw) + 1).otherwise(end).alias("end"), F.substring(raw, F.lit(1), end).alias("text"))
    b = d.select(
        "doc_id", raw.alias("raw_text"), F.when(k % 5 == 0, F.concat(raw, F.lit("."))).otherwise(raw).alias("normalized_text"), F.struct(F.when(k % 3 == 0, "byte").otherwise("unicode_codepoint").alias("unit"), F.lit("identity").alias("status")).alias("offset_mapping"), F.array(span).alias("spans"),
        F.when(k % 2 == 0, "/html/body/p[1]").alias("source_xpath"), F.when(k % 13 != 0, F.array(F.when(k % 11 == 0, F.concat(F.lit("!"), raw)).otherwise(raw))).alias("xpath_texts"), F.when(k % 17 != 0, "text_only_unlocated").alias("location_status"), ((k % 19 == 0) & (k % 2 == 1)).alias("evidence_eligible"),
    )
    return _joined(validation.block_errors(b), "doc_id")


@query(f"""select cast(p_partkey as varchar) as item_id, {_errors("p_partkey % 7 = 0 => unknown_evidence", "p_partkey % 3 = 0 => Evidence identity mismatch: revision_id", "p_partkey % 5 = 0 => Unsupported evidence offsets", "p_partkey % 11 = 0 => Source header/label reference mismatch: row_label", "p_partkey % 2 = 1 or p_partkey % 7 = 0 => Source header/label reference mismatch: period_header", "p_partkey % 7 = 0 => Source header/label reference mismatch: year_header")} as errors from part""")
def evidence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets against the rows of the evidence index that they name: odd ones lack a header for the period."""
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    key = k.cast("string")
    eid = lambda kind: F.concat(key, F.lit(f"-{kind}"))
    raw = F.struct(F.col("p_name").alias("row_label"), F.when(k % 2 == 0, "FY 2024").otherwise("Q2").alias("period_header"), F.lit("FY 2024").alias("year_header"), F.lit("(In millions)").alias("unit_header"))
    packets = p.select(key.alias("item_id"), key.alias("doc_id"), F.lit("r1").alias("revision_id"), F.lit("h").alias("source_sha256"), F.array(*[eid(x) for x in ("row_label", "year_header", "unit")]).alias("evidence_refs"), raw.alias("raw"))
    kinds = {"row_label": F.when(k % 11 == 0, "?").otherwise(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  ")))), "year_header": F.lit("FY\n2024"), "unit": F.lit("(In  millions)")}
    one = lambda x, text: F.struct(eid(x).alias("evidence_id"), F.when((F.lit(x) == "unit") & (k % 3 == 0), "r2").otherwise("r1").alias("revision_id"), F.when((F.lit(x) == "unit") & (k % 5 == 0), "byte").otherwise("unicode_code_point").alias("offset_unit"), F.lit(x).alias("evidence_kind"), text.alias("selected_text"))
    evidence = p.select(key.alias("doc_id"), F.lit("h").alias("source_sha256"), F.lit("identity").alias("offset_mapping"), k.alias("_k"), F.inline(F.array(*[one(x, t) for x, t in kinds.items()])))
    return _joined(validation.evidence_errors(packets, evidence.where((F.col("_k") % 7 != 0) | (F.col("evidence_kind") != "year_header")).drop("_k")), "item_id")


@query(f"""with f as (select distinct l_orderkey as o, l_linenumber as n, l_orderkey * 8 + l_linenumber as k from lineitem)
select o as l_orderkey, n as l_linenumber, {_errors("k % 13 = 0 => evidence_cell_missing", "k % 13 <> 0 and k % 3 = 0 => value_span_mismatch", "k % 13 <> 0 and k % 5 = 0 => signed_value_mismatch", "k % 13 <> 0 and k % 7 = 0 => base_units_mismatch", "k % 11 = 0 => period_length_mismatch", "k % 17 = 0 => period_header_mismatch", "k % 19 = 0 => year_header_mismatch")} as errors from f""")
def fact_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amounts of all order lines as facts, read again in the cells that they came from."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _money("l_extendedprice").alias("v")).repartition("l_orderkey")
    li = li.groupBy("l_orderkey", "l_linenumber").agg(F.sum("v").cast("decimal(18,2)").alias("v")).sortWithinPartitions("l_orderkey", "l_linenumber")
    li = stored(li, "order-amounts", compression="zstd")  # facts and cells are made from it, and rows of a document that follow each other take less
    k, amount = F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("v")
    printed = F.concat(F.lit("$("), amount.cast("string"), F.lit(")"))
    cell = F.concat(F.lit(" "), printed, F.lit(" "))
    doc = F.concat(F.lit("D"), F.col("l_orderkey").cast("string"))
    place = lambda x: F.concat(F.lit(f"/{x}/"), F.col("l_linenumber").cast("string"))
    facts = li.select(
        "l_orderkey", "l_linenumber", k.cast("string").alias("claim_id"), doc.alias("doc_id"), place("cell").alias("evidence_pointer"), place("period").alias("period_header_pointer"), place("year").alias("year_header_pointer"), F.lit(1).alias("value_span_start"), (F.length(printed) + 1).alias("value_span_end"),
        F.when(k % 3 == 0, amount.cast("string")).otherwise(printed).alias("value_raw"), F.lit("outflow_to_positive").alias("sign_policy"), F.when(k % 5 == 0, -amount).otherwise(amount).cast("string").alias("numeric_value"), F.lit("1000").alias("scale"), (amount * F.when(k % 7 == 0, 1).otherwise(1000)).cast("string").alias("numeric_value_base_units"),
        F.lit("flow").alias("balance_or_flow"), F.lit("2024-04-01").alias("period_start"), F.lit("2024-06-30").alias("period_end"), F.when(k % 11 == 0, 90).otherwise(91).alias("period_duration_days"), F.lit("Three Months Ended June 30").alias("expected_header"), F.lit(2024).alias("fiscal_year"),
    )
    texts = F.array(F.struct(place("cell").alias("pointer"), F.when(k % 13 != 0, cell).alias("text")), F.struct(place("period").alias("pointer"), F.when(k % 17 == 0, "June 30").otherwise("Three Months\nEnded June 30,").alias("text")), F.struct(place("year").alias("pointer"), F.when(k % 19 == 0, "2023").otherwise("FY 2024").alias("text")))
    cells = li.select(doc.alias("doc_id"), F.inline(texts)).where(F.col("text").isNotNull())
    return _joined(validation.fact_errors(facts, cells), "l_orderkey", "l_linenumber")


ENUMS = {q: ["unknown", "not_assessed", "not_applicable"] + (["yes"] if q in ("MQ06", "MQ08") else []) for q in validation.QUESTIONS}
FACTS = ["doc_id", "revision_id", "event_id", "event_family_id", "source_claim_id", "published_at", "published_date", "time_precision", "value_span_start", "value_span_end", "value_raw", "sign_policy", "numeric_value", "scale", "numeric_value_base_units", "period_kind", "period_start", "period_end", "duration_days", "as_of_date", "scope_id", "scope_status_as_of"]
CONTRACT = {
    "required_top_level": ["item_id", "item_type", "annotator_kind", "status", "facts", "provenance"], "method": "rules", "guide_version": "g1", "numeric_fact_fields": FACTS, "relation_fact_fields": ["relation_type"], "provenance_required_fields": ["doc_sha256"], "offset_basis": "original_cell",
    "exposure_flags_required": ["seen"], "relation": {}, "retrospective_scopes": ["ALL"], "assessment_file_required_top_level": ["annotation_id", "questions"], "assessment_response_enums": ENUMS,
}


@query(f"""with o as (select o_orderkey as k from orders)
select k as o_orderkey, case when k % 29 = 0 then 'unknown_item_id' else {_errors("k % 3 = 0 => agent_output_must_not_claim_human_or_gold", "k % 5 = 0 => packet_identity_mismatch:revision_id", "k % 7 = 0 => evidence_reference_set_changed", "k % 11 = 0 => source_hash_mismatch", "k % 13 = 0 => missing_exposure_flags", "k % 17 = 0 => null_without_reason:facts.published_at", "k % 19 = 0 => source_span_roundtrip_failed", "k % 23 = 0 => scale_conversion_mismatch", "k % 31 = 0 => period_length_mismatch", "k % 37 = 0 => historical_scope_support_overclaimed")} end as errors from o where k % 29 <> 0 or k % 3 <> 0""")
def annotation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of the order totals against the contract and their packets."""
    o, k = _t(spark, sf_dir, "orders").where("o_orderkey % 29 <> 0 or o_orderkey % 3 <> 0"), F.col("o_orderkey")
    key, amount = k.cast("string"), _money("o_totalprice")
    cell = F.concat(F.lit("$"), amount.cast("string"))
    own = {
        "doc_id": key, "revision_id": F.when(k % 5 == 0, "r2").otherwise("r1"), "event_id": key, "event_family_id": key, "source_claim_id": key, "published_at": _none(), "published_date": F.lit("2024-07-30"), "time_precision": F.lit("date"), "value_span_start": F.lit(0), "value_span_end": F.length(cell) - F.when(k % 19 == 0, 1).otherwise(0), "value_raw": cell, "sign_policy": F.lit("preserve"),
        "numeric_value": amount.cast("string"), "scale": F.lit("1"), "numeric_value_base_units": (amount + F.when(k % 23 == 0, 1).otherwise(0)).cast("string"), "period_kind": F.lit("duration"), "period_start": F.lit("2024-04-01"), "period_end": F.lit("2024-06-30"), "duration_days": F.when(k % 31 == 0, 92).otherwise(91), "as_of_date": _none(), "scope_id": F.lit("ALL"), "scope_status_as_of": F.when(k % 37 == 0, "supported").otherwise("unresolved_retrospective_dependency"),
    }
    said = F.create_map(F.lit("facts.as_of_date"), F.lit("flow"), F.when(k % 17 == 0, "other").otherwise("facts.published_at"), F.lit("date only"))
    refs = F.array(F.lit("E1"), F.lit("E2"))
    drafts = o.select(
        k, key.alias("item_id"), F.lit("numeric_claim").alias("item_type"), F.lit("agent").alias("annotator_kind"), F.when(k % 3 == 0, "gold").otherwise("agent_draft").alias("status"), F.lit("rules").alias("method"), F.lit("g1").alias("guide_version"), F.struct(*[own[f].alias(f) for f in FACTS]).alias("facts"),
        F.struct(F.when(k % 11 == 0, "x").otherwise("h").alias("doc_sha256"), key.alias("source_record_ref"), F.array(F.lit("S")).alias("availability_dependency_refs"), F.lit("original_cell").alias("offset_basis")).alias("provenance"), F.when(k % 7 == 0, F.array(F.lit("E1"))).otherwise(F.array(F.lit("E2"), F.lit("E1"))).alias("evidence_refs"), F.when(k % 13 != 0, F.array(F.lit("seen"))).alias("exposure_flags"), said.alias("field_missing_reasons"),
    )
    packets = o.where(k % 29 != 0).select(
        key.alias("item_id"), F.lit("numeric_claim").alias("item_type"), *[key.alias(c) for c in ("doc_id", "event_id", "event_family_id", "source_claim_id", "source_record_ref")], F.lit("r1").alias("revision_id"), F.struct(_none().alias("published_at"), F.lit("2024-07-30").alias("published_date"), F.lit("date").alias("time_precision")).alias("publication"),
        refs.alias("evidence_refs"), F.lit("h").alias("source_sha256"), F.array(F.lit("S")).alias("scope_dependency_refs"), F.struct(cell.alias("value_cell")).alias("raw"),
    )
    return _joined(validation.annotation_errors(drafts, packets, CONTRACT), "o_orderkey")


def _assessments(o: DataFrame, k: Column) -> DataFrame:
    """Eight answers; the sixth and the second vary."""
    answer = lambda q: F.struct(F.lit(q).alias("question_id"), (F.when(k % 5 == 0, "yes") if q == "MQ02" else F.when(k % 7 == 0, "maybe") if q == "MQ06" else F.when(F.lit(False), "")).otherwise("unknown").alias("response"), F.when(~((k % 11 == 0) & (F.lit(q) == "MQ08")), "open").alias("reason"))
    asked = F.array(*[answer(q) for q in validation.QUESTIONS])
    return o.withColumn("questions", F.when(k % 13 == 0, F.slice(asked, 1, 7)).otherwise(asked))


@query(f"""with o as (select o_orderkey as k from orders)
select k as o_orderkey, {_errors("k % 3 = 0 => unknown_annotation_id", "k % 13 = 0 => question_coverage_mismatch", "k % 17 = 0 => wrong_assessment_guide_version", "k % 11 = 0 and k % 13 <> 0 => assessment_missing_reason:MQ08", "k % 5 = 0 => unsupported_materiality_or_prior_answer:MQ02", "k % 5 = 0 => invalid_assessment_response:MQ02", "k % 7 = 0 => invalid_assessment_response:MQ06")} as errors from o""")
def assessment_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to the eight questions of an assessment against the allowed ones."""
    o, k = _t(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey")
    a = _assessments(o, k).select(k, k.cast("string").alias("annotation_id"), F.lit("agent").alias("annotator_kind"), F.lit("historical_comparison").alias("purpose"), F.lit("date").alias("as_of_precision"), F.lit("needs_review").alias("review_readiness"), F.when(k % 17 == 0, "g0").otherwise("g1").alias("guide_version"), F.array(F.lit("seen")).alias("exposure_flags"), "questions")
    return _joined(validation.assessment_errors(a, o.where(k % 3 != 0).select(k.cast("string").alias("annotation_id")), CONTRACT), "o_orderkey")


@query("""with c as (select c_custkey as k from customer)
select distinct error from (
select 'guide_mismatch:A' || k as error from c where k % 3 = 0 union all select 'missing_peer:B:' || k || '-1' from c where k % 7 = 0 union all select 'unequal_item_sets' from c where k % 7 = 0
union all select 'pair_identity_mismatch:' || k || '-1:guide_version' from c where k % 3 = 0 and k % 7 <> 0
union all select 'item_source_identity_mismatch:B' || k from c where k % 5 = 0 and k % 7 <> 0 union all select 'duplicate_item:A:' || k || '-1' from c where k % 11 = 0 union all select 'duplicate_annotation_id:A' || k from c where k % 11 = 0
union all select 'missing_annotation_parent:SB' || k from c where k % 7 = 0 union all select 'assessment_item_set_mismatch:B' from c where k % 7 = 0
union all select 'missing_or_duplicate_questions:S' || a || k from c, (values ('A'), ('B')) as v(a) where k % 13 = 0
union all select 'invalid_question_response:S' || a || k || ':MQ02' from c, (values ('A'), ('B')) as v(a) where k % 5 = 0 union all select 'invalid_question_response:S' || a || k || ':MQ06' from c, (values ('A'), ('B')) as v(a) where k % 7 = 0)""")
def annotation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two authors' annotations of all customers as sets: one lacks peers, some repeat or don't match."""
    c, k = _t(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey")
    both = c.withColumn("annotator_id", F.explode(F.array(F.lit("A"), F.lit("B"))))
    who, key = F.col("annotator_id"), k.cast("string")
    item = F.concat(key, F.lit("-1"))
    own = F.when((k % 5 == 0) & (who == "B"), "other").otherwise(item)
    rows = both.where(~((k % 7 == 0) & (who == "B"))).withColumn("_twice", F.explode(F.sequence(F.lit(1), F.when((k % 11 == 0) & (who == "A"), 2).otherwise(1))))
    rows = rows.select(F.concat(who, key).alias("annotation_id"), who, item.alias("item_id"), F.lit("numeric_claim").alias("item_type"), F.when((k % 3 == 0) & (who == "A"), "g0").otherwise("g1").alias("guide_version"), F.lit("v1").alias("registry_version"), F.lit("agent").alias("annotator_kind"), F.struct(own.alias("source_claim_id"), _none().alias("source_relation_id"), key.alias("doc_id")).alias("facts"), F.struct(F.concat(F.lit("f#"), item).alias("source_record_ref")).alias("provenance"))
    said = _assessments(both, k).select(F.concat(F.lit("S"), who, key).alias("assessment_id"), F.concat(who, key).alias("annotation_id"), who, item.alias("item_id"), F.lit("agent").alias("annotator_kind"), F.lit("g1").alias("guide_version"), "questions")
    return validation.pair_errors(rows, said, CONTRACT, ["A", "B"])


@query("""with a as (select (select count(*) from region) as regions, (select count(*) from nation) as nations, (select count(*) from events) as events)
select v.field, v.expected, v.reported, v.expected is not distinct from v.reported as equal from a, lateral (values ('regions', a.regions, 5), ('nations', a.nations, 24), ('events', a.events, cast(null as bigint))) as v(field, expected, reported)""")
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts made again from the tables against those that a summary reports."""
    n = lambda t: _t(spark, sf_dir, t).agg(F.count(F.lit(1)).alias(t + "s" if t != "events" else t))
    actual = n("region").join(n("nation"), F.lit(True)).join(n("events"), F.lit(True))
    return validation.count_mismatches(actual, {"regions": 5, "nations": 24})


@query(f"""select event_id, {_errors("event_id % 11 = 0 => malformed_count", "event_id % 3 = 0 and event_id % 5 = 0 and event_id % 11 <> 0 => requests_after_host_denial", "event_id % 7 = 0 and event_id % 2 = 0 => missing_timestamp_reason")} as errors from events""")
def denial_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes: none may go on after a refusal."""
    e, k = _t(spark, sf_dir, "events"), F.col("event_id")
    p = e.select(k, F.when(k % 3 == 0, 403).otherwise(200).alias("http_status"), F.when(k % 11 == 0, "many").when(k % 5 == 0, "1").otherwise("0").alias("retry_count"), F.lit("0").alias("endpoint_requests_after_failure"), F.when(k % 7 != 0, F.col("ts").cast("string")).alias("observed_at"), F.when(k % 2 == 1, "run_trace_only").alias("observation_precision"))
    return _joined(validation.denial_errors(p), "event_id")


@query("""with s as (select s_suppkey as k from supplier) select k as s_suppkey, array_to_string(list_filter([case when k % 3 = 0 then 'legacy_artifact' end, case when k % 5 = 0 then 'foreign_company_id' end], lambda x: x is not null), '|') as errors from s""")
def legacy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = _t(spark, sf_dir, "supplier"), F.col("s_suppkey")
    rows = s.select(k, F.when(k % 3 == 0, "old/x").when(k % 2 == 0, "store\\x").otherwise("store/x").alias("storage_uri"), F.when(k % 5 == 0, "KR-1").when(k % 7 != 0, "US-1").alias("company_id"))
    return _joined(validation.legacy_errors(rows, "store/", "US-"), "s_suppkey")


@query("""with o as (select o_orderkey as k, cast(count(*) as bigint) as n, max_by(l_extendedprice, l_linenumber) as v from orders join lineitem on l_orderkey = o_orderkey group by 1)
select k as o_orderkey, case when k % 5 <> 0 then cast(100 as bigint) end as header_x, case when k % 5 <> 0 and k % 3 <> 0 then 'Net sales' end as label_text, case when k % 5 <> 0 and k % 3 <> 0 then cast(n as varchar) end as value_text, case when k % 5 <> 0 and k % 3 <> 0 then cast(10 as bigint) end as distance from o""")
def laid_out_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per order: the number in the line of a label, nearest to its header. Every fifth page has no header, every third
    has its numbers a line lower."""
    counted = lambda table, key, n: _t(spark, sf_dir, table).groupBy(F.col(key).alias("page_id")).agg(F.count(F.lit(1)).alias(n))
    p = counted("lineitem", "l_orderkey", "lines").join(counted("orders", "o_orderkey", "orders"), "page_id").select("page_id", (F.col("lines") * F.col("orders")).alias("n"))
    p = stored(p, "order-pages")  # words, lines and requests are made from it
    k = F.col("page_id")
    word = lambda i, x, y, t: F.struct(F.lit(i).alias("ord"), F.lit(x).cast("long").alias("x0"), y.cast("long").alias("y0"), t.alias("text"))
    y = F.lit(203) + F.when(k % 3 == 0, 6).otherwise(5)
    words = p.select(k, F.inline(F.array(word(0, 10, F.lit(203), F.lit("Net sales")), word(1, 130, y, F.lit("999")), word(2, 110, y, F.col("n").cast("string")), word(3, 105, y, F.lit("n/a")), word(4, 200, F.lit(203), F.lit("77")), word(5, 700, F.lit(203), F.lit("Net sales")))))
    lines = p.where(k % 5 != 0).select(k, F.lit(0).alias("ord"), F.lit(100).cast("long").alias("x0"), F.lit("3Q '24 2Q '24").alias("text"))
    asked = p.select(k.alias("request_id"), k, F.lit("3Q '24").alias("needle"), F.lit("sales").alias("label"), F.lit("left").alias("side"), F.lit(1000).alias("width"))
    asked = stored(layout.headers(lines, asked), "order-headers")
    return layout.row_values(words, asked).select(k.alias("o_orderkey"), "header_x", "label_text", "value_text", "distance")


@query("""with t as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn = 1 desc, turn) as r from conversations where role = 'assistant' and contains(text, '.') and length(regexp_replace(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '^ | $', '', 'g')) >= 35)
select c.conv_id, t.turn + 1 as page, substring(t.text, 1, 200) as excerpt, case when t.conv_id is null then 'no_prose_block' end as error from (select distinct conv_id from conversations) c left join t on t.conv_id = c.conv_id and t.r = 1""")
def prose_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first prose of every conversation's replies, the second turn before the others."""
    c = _t(spark, sf_dir, "conversations")
    blocks = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.lit(0).alias("ord"), (F.col("role") == "assistant").alias("is_text"), "text", F.array(F.lit(0.0)).alias("bbox"))
    wanted = c.select(F.col("conv_id").alias("doc_id")).distinct().withColumn("page", F.lit(1))
    return layout.prose_blocks(blocks, wanted).select(F.col("doc_id").alias("conv_id"), "page", "excerpt", "error")


@query("""select l_orderkey, l_linenumber, case when l_linenumber % 2 = 1 then case when l_linenumber < 5 then 'r0c' || (l_linenumber // 2) end when l_linenumber < 3 then 'r0c' || l_linenumber end as period_header_pointer, case when l_linenumber % 2 = 1 then 'r2c' || l_linenumber when l_linenumber < 3 then 'r0c' || l_linenumber end as year_header_pointer,
  case when l_linenumber >= 4 then 'header_not_found' end as error from lineitem""")
def spanned_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers over the column of each order line: three cells, the first two of two columns, over a row of years."""
    li = _t(spark, sf_dir, "lineitem")
    doc = F.col("l_orderkey").cast("string")
    cell = lambda r, i, span: F.struct(F.lit(r).alias("row"), F.lit(i).alias("ord"), F.lit(span).alias("colspan"), F.lit(f"r{r}c{i}").alias("pointer"))
    table = F.array(cell(0, 0, 2), cell(0, 1, 2), cell(0, 2, 1), cell(1, 0, 9), *[cell(2, i, 1) for i in range(8)])
    cells = li.select(doc.alias("doc_id"), F.lit("t").alias("table_xpath")).distinct().select("*", F.inline(table))
    n = F.col("l_linenumber")
    facts = li.select("l_orderkey", "l_linenumber", F.concat_ws("-", doc, n.cast("string")).alias("claim_id"), doc.alias("doc_id"), F.lit("t").alias("table_xpath"), F.when(n % 2 == 1, "flow").otherwise("balance").alias("balance_or_flow"), n.alias("table_col_index"))
    out = layout.refined_headers(facts, cells)
    return out.select("l_orderkey", "l_linenumber", "period_header_pointer", "year_header_pointer", "error")


def _articles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as candidates with marked titles; every third has no body."""
    d, k = _t(spark, sf_dir, "documents"), F.col("doc_id")
    title = F.get(F.array(*map(F.lit, ["[속보] 실적", "【기자 칼럼】 반도체", "(단독 인터뷰) 대표", "속보 없는 제목", "[ 속보 ] [사설]"])), (k % 5).cast("int"))
    cid = F.concat(F.lit("C"), k.cast("string"))
    candidates = d.select(cid.alias("candidate_id"), k.cast("string").alias("doc_id"), F.col("source").alias("source_id"), F.col("lang").alias("event_family_id"), title.alias("title"), k.alias("input_order"))
    audits = d.select(cid.alias("candidate_id"), F.lit("r1").alias("revision_id"), (k % 3 != 0).alias("body_available"), F.when(k % 3 != 0, articles.ELIGIBLE).alias("audit_status"), F.when(F.col("n_chars") < 400, articles.SHORT).otherwise("").alias("diagnostics"), F.col("n_chars").alias("body_chars"), F.when(k % 6 == 0, "fetch_failed").alias("missing_reason"))
    return candidates, audits


@query("""with d as (select doc_id as k, n_chars as n, lang, source from documents)
select 'C' || k as candidate_id, k % 5 in (0, 4) as breaking_title_marker, k % 5 in (1, 4) as opinion_title_marker, k % 5 = 2 as interview_title_marker, k % 3 <> 0 as body_available, case when k % 3 <> 0 then n < 400 end as short_body_signal,
  case when k % 3 <> 0 then k % 4 end as sentence_candidates, case when k % 3 <> 0 then cast(k % 2 as bigint) end as quote_candidates, case when k % 6 = 0 then 'fetch_failed' when k % 3 = 0 then 'body_not_available' end as missing_reason from d""")
def article_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule signals of every candidate; without a body counts are unknown, not zero."""
    candidates, audits = _articles(spark, sf_dir)
    k = F.col("doc_id").cast("long")
    many = candidates.where(k % 4 > 0).select("doc_id", F.lit("r1").alias("revision_id"), F.explode(F.sequence(F.lit(1), (k % 4).cast("int"))).alias("_i"))
    spans = candidates.where(k % 2 == 1).select("doc_id", F.lit("r1").alias("revision_id"), F.lit("quote_candidate").alias("kind_candidate"))
    s = articles.rule_signals(candidates, audits, many, spans)
    return s.select("candidate_id", *articles.MARKERS, "body_available", "short_body_signal", "sentence_candidates", "quote_candidates", "missing_reason")


@query()
def article_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pending slots for each of the twenty articles that go to people."""
    candidates, audits = _articles(spark, sf_dir)
    return articles.reviewer_slots(candidates, articles.selected(candidates, audits), "ART")


@query("""with d as (select doc_id as k, lang from documents)
select 'C' || k as candidate_id, case when k % 3 <> 0 then 'local_body_acquired' else 'body_not_acquired' end as access_status, case when k % 3 <> 0 then 'unknown' else 'access_unusable' end as eligibility,
  case when k % 3 <> 0 then 'body_complete_scope_and_rights_review_pending' when k % 6 = 0 then 'fetch_failed' else 'body_not_available' end as eligibility_reason, lang as event_family_id, case when k % 3 <> 0 then 'anchor_claim_and_article_span_alignment_pending' else 'body_not_available' end as link_reason from d""")
def article_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of every candidate before a person has read it, with its provisional link."""
    candidates, audits = _articles(spark, sf_dir)
    of = articles.classification(candidates, audits, articles.selected(candidates, audits))
    links = articles.event_links(candidates, audits).select("candidate_id", F.col("missing_reason").alias("link_reason"))
    return of.join(links, "candidate_id").select("candidate_id", "access_status", "eligibility", "eligibility_reason", "event_family_id", "link_reason")


@query(f"""with p as (select p_partkey as k from part where p_partkey % 50 <> 0 and p_partkey % 41 <> 0 and p_partkey % 13 <> 0 and p_partkey % 7 <> 0 and p_partkey % 11 <> 0)
select 'I' || k as input_id, case when k % 23 = 0 then 'unknown_input_id' else {_errors("k % 17 = 0 => prediction_evidence_refs", "k % 19 = 0 => reporting_period", "k % 3 = 0 => numeric_value", "k % 5 = 0 => unit_scale")} end as errors from p""")
def prediction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of all parts, some altered, derived again from their inputs."""
    inputs, rules = part_inputs(spark, sf_dir)
    found, k = extraction.extract(inputs, rules, "run").where("status = 'predicted'"), F.substring("input_id", 2, 20).cast("long")
    found = found.withColumn("numeric_value", F.when(k % 3 == 0, "1").otherwise(F.col("numeric_value"))).withColumn("source_scale", F.when(k % 5 == 0, "1000").otherwise(F.col("source_scale"))).withColumn("evidence_refs", F.when(k % 17 == 0, F.array(F.lit("E9"))).otherwise(F.col("evidence_refs")))
    found = found.withColumn("reference_period", F.col("reference_period").withField("fiscal_year", F.when(k % 19 == 0, 1999).otherwise(F.col("reference_period.fiscal_year"))))
    return _joined(extraction.prediction_errors(found, inputs.where(F.substring("input_id", 2, 20).cast("long") % 23 != 0), rules), "input_id")


@query("""with d as (select distinct l_orderkey as k from lineitem), w as (select * from d, (values ('Line 1', 'first', 'quarter'), ('Line 3', 'third', 'instant')) as v(label, metric_id, period)),
r as (select l_orderkey as k, 'Line ' || l_linenumber as label, count(*) as n, min(cast(l_extendedprice as decimal(18,2))) as v from lineitem group by 1, 2),
e as (select w.*, r.v, case when w.k % 11 = 0 then 'table_not_found' when w.k % 7 = 0 then 'table_ambiguous' when r.n is null then 'row_not_found' when r.n > 1 then 'row_ambiguous' end as error from w left join r on r.k = w.k and r.label = w.label)
select k as l_orderkey, metric_id, case when error is null then cast(v as varchar) end as numeric_value, case when error is null then cast(cast(v * 1000 as decimal(18,2)) as varchar) end as base, case when error is null then 2 end as value_span_start,
  case when error is null then case period when 'quarter' then '2024-04-01' else '2024-06-30' end end as period_start, case when error is null then case period when 'quarter' then 91 else 0 end end as days, error from e""")
def statement_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a statement: two of its lines, by caption, label and column. Lines that a table has twice are ambiguous,
    as are every seventh order's tables; every eleventh has another caption."""
    li = _t(spark, sf_dir, "lineitem")
    k, n, v = F.col("l_orderkey"), F.col("l_linenumber"), _money("l_extendedprice")
    docs = li.select(k).distinct()
    found = docs.select(k.alias("doc_id"), F.explode(F.when(k % 7 == 0, F.array(F.lit("T1"), F.lit("T2"))).otherwise(F.array(F.lit("T1")))).alias("table_id"), F.when(k % 11 == 0, "OTHER").otherwise("INCOME STATEMENTS").alias("caption"))
    printed = F.concat(F.lit("  ($"), F.format_number(v, 2), F.lit(") "))
    cell = lambda c, x: F.struct(F.lit(c).alias("col"), x.alias("text"), F.concat_ws("/", n.cast("string"), F.lit(str(c))).alias("pointer"))
    cells = li.select(k.alias("doc_id"), F.lit("T1").alias("table_id"), n.alias("row"), F.inline(F.array(cell(0, F.concat(F.lit(" Line\n "), n.cast("string"))), cell(1, printed))))
    asked = [tables.Wanted("INCOME STATEMENTS", "Line 1", 1, "first", "quarter", "ALL", "outflow_to_positive"), tables.Wanted("INCOME STATEMENTS", "Line 3", 1, "third", "instant", "ALL", "outflow_to_positive")]
    out = tables.statement_facts(docs.select(k.alias("doc_id"), F.lit(2024).alias("fiscal_year")), found, cells, asked, scale="1000")
    text = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    return out.select(F.col("doc_id").alias("l_orderkey"), "metric_id", text("numeric_value").alias("numeric_value"), text("numeric_value_base_units").alias("base"), "value_span_start", F.col("period_start").cast("string").alias("period_start"), F.col("period_duration_days").alias("days"), "error")


@query("""with t as (select l_orderkey as k, l_linenumber as n, min(cast(l_extendedprice as decimal(18,2))) as v, max(l_linestatus) as s from lineitem group by 1, 2),
r as (select *, row_number() over (partition by k order by s = 'O' desc, n) as r from t where n % 2 = 1 and n <> 3)
select k as l_orderkey, 'T' || n as table_id, cast(v as varchar) as value_raw, cast(case when s = 'O' then 10000 else 0 end - n as bigint) as points from r where r = 1""")
def best_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every order's tables, one a line, the best scored that has the words, header, label and unit."""
    t = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(_money("l_extendedprice")).alias("v"), F.max("l_linestatus").alias("s"))
    t = stored(t, "order-tables")
    n, tid = F.col("l_linenumber"), F.concat(F.lit("T"), F.col("l_linenumber").cast("string"))
    words = F.concat(F.lit("Sales "), F.when(n % 2 == 1, "DRAM ").otherwise("NAND "), F.when(F.col("s") == "O", "Share").otherwise(""))
    found = t.select(F.col("l_orderkey").alias("doc_id"), tid.alias("table_id"), n.alias("ord"), words.alias("text"), F.array(F.lit("Note"), F.when(n == 3, "none").otherwise("Unit: million")).alias("context"))
    cell = lambda r, c, x: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), x.alias("text"))
    cells = t.select(F.col("l_orderkey").alias("doc_id"), tid.alias("table_id"), F.inline(F.array(cell(0, 0, F.lit("Division")), cell(0, 1, F.lit("Sales Share")), cell(0, 2, F.lit("Sales")), cell(1, 0, F.lit("Total")), cell(1, 2, F.lit("0")), cell(2, 0, F.lit("Memory division")), cell(2, 1, F.lit("9")), cell(2, 2, F.col("v").cast("string")))))
    out = tables.best_table(found, cells, required=["Sales", "DRAM"], weights={"Share": 10}, header="Sales", not_header="Share", label="^Memory", unit="million")
    return out.select(F.col("doc_id").alias("l_orderkey"), "table_id", "value_raw", (F.col("score") * 1000).cast("long").alias("points"))


@query("""with o as (select o_orderkey as k, cast(o_totalprice as decimal(18,2)) as v from orders)
select k as o_orderkey, case when k % 7 = 0 then 'outside_fiscal_calendar' when k % 5 = 0 then 'one_token_expected' when k % 3 = 0 then 'unbalanced_parentheses' end as a_error,
  case when k % 7 = 0 then 'outside_fiscal_calendar' when k % 5 = 0 then 'unsupported_token' when k % 3 = 0 then 'unbalanced_parentheses' end as b_error,
  case when k % 7 <> 0 and k % 5 <> 0 and k % 3 <> 0 and k % 2 = 0 then '2024-04-01' end as period_start, k % 7 <> 0 and k % 3 <> 0 and k % 5 <> 0 as same, '' as errors from o""")
def two_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two annotators' drafts of all orders side by side: where each abstains, whether the facts agree, and what the validator
    says of the first one's drafts."""
    o, k = _t(spark, sf_dir, "orders"), F.col("o_orderkey")
    key = k.cast("string")
    amount = F.concat(F.when(k % 3 == 0, "(").otherwise(""), F.when(k % 5 == 0, "1,2").otherwise(""), _money("o_totalprice").cast("string"))
    raw = F.struct(F.concat(F.lit(" "), amount, F.lit("\n")).alias("value_cell"), F.lit("Total  sales").alias("row_label"), F.concat(F.when(k % 2 == 0, "Three Months Ended ").otherwise(""), F.when(k % 7 == 0, "May 30,").otherwise("June 30,"), F.when(k % 2 == 1, " 2024").otherwise("")).alias("period_header"), F.when(k % 2 == 1, "June 30, 2024").otherwise("2024").alias("year_header"), F.lit("In millions").alias("unit_header"))
    packets = o.select(key.alias("item_id"), F.lit("numeric_claim").alias("item_type"), *[key.alias(c) for c in ("doc_id", "event_id", "event_family_id", "source_claim_id", "source_record_ref")], F.lit("r1").alias("revision_id"), F.struct(_none().alias("published_at"), F.lit("2024-07-30").alias("published_date"), F.lit("date").alias("time_precision")).alias("publication"), F.array(F.lit("E1")).alias("evidence_refs"), F.lit("h").alias("source_sha256"), F.array(F.lit("S")).alias("scope_dependency_refs"), raw.alias("raw"))
    guide = annotate.Guide("g1", "v1", {"Total sales": ("sales", "preserve")}, {"In millions": "1000000"}, "ALL", flags=("seen",))
    a, b = annotate.annotations(packets, guide, "A", annotate.period_a, annotate.number_a), annotate.annotations(packets, guide, "B", annotate.period_b, annotate.number_b)
    contract = CONTRACT | {"method": "agent_authored_deterministic_annotation"}
    checked = validation.annotation_errors(a, packets, contract).select("item_id", F.col("error").alias("a_error"), F.col("facts").alias("_a"), F.when(F.col("error").isNull(), F.concat_ws("|", "errors")).otherwise("").alias("errors"))
    j = checked.join(b.select("item_id", F.col("error").alias("b_error"), F.col("facts").alias("_b")), "item_id")
    both = F.col("a_error").isNull() & F.col("b_error").isNull()
    return j.select(F.col("item_id").cast("long").alias("o_orderkey"), "a_error", "b_error", F.when(F.col("a_error").isNull(), F.col("_a.period_start")).alias("period_start"), (both & F.col("_a").eqNullSafe(F.col("_b"))).alias("same"), "errors")


@query()
def boundary_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text at the edge of the pages' bodies, counted by kind."""
    found = layout.boundary_findings(markup.blocks(_t(spark, sf_dir, "pages")))
    return found.groupBy("kind", "action").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("page_id").alias("pages"), F.sum("chars").alias("chars"))
