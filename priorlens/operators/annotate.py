"""Two annotators that read a packet independently of each other: their own period and number readers, one layout of drafts.

Agreement of the two says that the guide can be followed twice, not that the draft is true: both are agents."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.reasons import first

# The number tokens that each annotator takes.
TOKEN_A = r"\(?\$?-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\)?"
TOKEN_B = r"^(?:\(?\$?-?\d{1,3}(?:,\d{3})*(?:\.\d+)?\)?|\(?\$?-?\d+(?:\.\d+)?\)?)$"


@dataclass(frozen=True)
class Guide:
    version: str
    registry: str
    #: label -> (metric_id, sign_policy)
    metrics: Mapping[str, tuple[str, str]]
    #: unit header -> scale text
    units: Mapping[str, str]
    scope_id: str
    scope_status: str = "unresolved_retrospective_dependency"
    year_end: tuple[int, int] = (6, 30)
    flags: tuple[str, ...] = ()
    offset_basis: str = "original_cell"


def _period(end: Column, months: Column, instant: Column, error: Column) -> Column:
    """The struct that both readers give."""
    start = F.trunc(F.add_months(end, 1 - months), "MM")
    ok, flow = error.isNull(), error.isNull() & ~instant
    iso = lambda c, x: F.when(c, F.date_format(x, "yyyy-MM-dd"))
    return F.struct(
        iso(flow, start).alias("period_start"), iso(flow, end).alias("period_end"), iso(ok & instant, end).alias("as_of_date"), F.when(ok, F.when(instant, "instant").otherwise("duration")).alias("period_kind"), F.when(flow, F.datediff(end, start) + 1).alias("duration_days"),
        F.when(ok, F.year(end)).alias("fiscal_year"), F.when(flow & (months == 3), 4).alias("fiscal_quarter"), error.alias("error"),
    )


def period_a(header: Column, years: Column, year_end: tuple[int, int]) -> Column:
    """Reads month and day off the header and holds them against the fiscal calendar; a header without a duration must be the
    year header itself."""
    h, y = text.compact(header), text.compact(years)
    found = F.regexp_extract_all(y, F.lit(r"(?<!\d)(\d{4})(?!\d)"), F.lit(1))
    day = lambda k: F.nullif(F.regexp_extract(h, r"([A-Za-z]+)\s+(\d{1,2}),", k), F.lit(""))
    end = F.try_to_timestamp(F.concat_ws(" ", day(1), day(2), F.get(found, F.lit(0))), F.lit("MMMM d yyyy")).cast("date")
    quarter, year = h.startswith("Three Months Ended "), h.startswith("Twelve Months Ended ")
    error = first(
        (F.coalesce(F.size(found), F.lit(0)) != 1, "one_source_year_expected"), (day(1).isNull(), "month_and_day_missing"), (end.isNull(), "not_a_date"),
        ((F.month(end) != year_end[0]) | (F.dayofmonth(end) != year_end[1]), "outside_fiscal_calendar"), (~(quarter | year) & (h != y), "unsupported_duration"),
    )
    return _period(end, F.when(quarter, 3).otherwise(12), ~(quarter | year), error)


def period_b(header: Column, years: Column, year_end: tuple[int, int]) -> Column:
    """Looks for the fiscal year's last day in the header; a header that begins with it is an instant and has the year."""
    h = text.compact(header)
    one = lambda x: F.regexp_extract_all(text.compact(x), F.lit(r"(?<!\d)(20\d{2})(?!\d)"), F.lit(1))
    found = one(years)
    end = F.make_date(F.get(found, F.lit(0)).cast("int"), F.lit(year_end[0]), F.lit(year_end[1]))
    last = f"{['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'][year_end[0] - 1]} {year_end[1]},"
    quarter, year, instant = h.startswith("Three Months Ended"), h.startswith("Twelve Months Ended"), h.startswith(last)
    error = first(
        (F.coalesce(F.size(found), F.lit(0)) != 1, "one_source_year_expected"), (~F.coalesce(h.contains(last), F.lit(False)), "outside_fiscal_calendar"),
        (instant & (~(F.size(one(header)) == 1) | ~F.get(one(header), F.lit(0)).eqNullSafe(F.get(found, F.lit(0)))), "instant_and_year_disagree"), (~(quarter | year | instant), "unsupported_duration"),
    )
    return _period(end, F.when(quarter, 3).otherwise(12), instant, error)


def _amount(token: Column, start: Column, error: Column) -> Column:
    value = F.replace(F.translate(token, "$,)", ""), F.lit("("), F.lit("-")).try_cast("decimal(28,6)")
    fault = F.coalesce(error, first((token.startswith("(") != token.endswith(")"), "unbalanced_parentheses"), (value.isNull(), "not_a_number")))
    ok = lambda c: F.when(fault.isNull(), c)
    return F.struct(ok(token).alias("raw"), ok(start).alias("start"), ok(start + F.length(token)).alias("end"), ok(value).alias("value"), fault.alias("error"))


def number_a(cell: Column) -> Column:
    """Finds tokens in the cell: there must be one, and nothing else but white space."""
    found = F.regexp_extract_all(cell, F.lit(TOKEN_A), F.lit(0))
    start = F.length(F.regexp_extract(cell, f"(?s)^(.*?){TOKEN_A}", 1))
    rest = F.trim(F.regexp_replace(F.regexp_replace(cell, TOKEN_A, ""), r"\s+", ""))
    return _amount(F.get(found, F.lit(0)), start, first((F.coalesce(F.size(found), F.lit(0)) != 1, "one_token_expected"), (rest != "", "unparsed_material")))


def number_b(cell: Column) -> Column:
    """Cuts white space off both ends; what is left must be a number as a whole, with thousands in threes."""
    token = F.regexp_replace(cell, r"^\s+|\s+$", "")
    start = F.length(cell) - F.length(F.regexp_replace(cell, r"^\s+", ""))
    return _amount(token, start, first((~F.coalesce(token.rlike(TOKEN_B), F.lit(False)), "unsupported_token")))


def annotations(packets: DataFrame, guide: Guide, author: str, period: Callable, number: Callable) -> DataFrame:
    """One draft per packet of a numeric claim, or its ``error``. packets: item_id, item_type, doc_id, revision_id, event_id,
    event_family_id, source_claim_id, publication, evidence_refs, source_sha256, source_record_ref, scope_dependency_refs
    and raw (value_cell, row_label, period_header, year_header, unit_header)."""
    look = lambda table, key: F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), v)]), key)
    j = packets.withColumn("_p", period(F.col("raw.period_header"), F.col("raw.year_header"), guide.year_end)).withColumn("_n", number(F.col("raw.value_cell")))
    j = j.withColumn("_m", look({k: F.struct(F.lit(m).alias("metric_id"), F.lit(s).alias("sign_policy")) for k, (m, s) in guide.metrics.items()}, text.compact(F.col("raw.row_label"))))
    j = j.withColumn("_u", look({k: F.lit(v) for k, v in guide.units.items()}, text.compact(F.col("raw.unit_header"))))
    value = F.when(F.col("_m.sign_policy") == "outflow_to_positive", -F.col("_n.value")).otherwise(F.col("_n.value"))
    base = value.cast("decimal(24,6)") * F.col("_u").cast("decimal(14,4)")
    pub = F.col("publication")
    fields = {
        "doc_id": F.col("doc_id"), "revision_id": F.col("revision_id"), "event_id": F.col("event_id"), "event_family_id": F.col("event_family_id"), "source_claim_id": F.col("source_claim_id"), "source_relation_id": F.lit(None).cast("string"), "published_at": pub["published_at"], "published_date": pub["published_date"], "time_precision": pub["time_precision"],
        "metric_id": F.col("_m.metric_id"), "value_raw": F.col("_n.raw"), "value_span_start": F.col("_n.start"), "value_span_end": F.col("_n.end"), "sign_policy": F.col("_m.sign_policy"), "numeric_value": value.cast("string"), "scale": F.col("_u"), "numeric_value_base_units": base.cast("string"),
        **{k: F.col(f"_p.{k}") for k in ("period_kind", "period_start", "period_end", "duration_days", "as_of_date", "fiscal_year", "fiscal_quarter")}, "scope_id": F.lit(guide.scope_id), "scope_status_as_of": F.lit(guide.scope_status),
    }
    # Why a field has no value.
    why = {"published_at": "unknown: source provides date precision only", "as_of_date": "not_applicable: flow has a reporting duration", "fiscal_quarter": "not_applicable: annual flow or fiscal-year-end balance is not a quarter duration", "source_relation_id": "not_applicable: numeric fact"}
    why |= dict.fromkeys(("period_start", "period_end", "duration_days"), "not_applicable: instant balance has no duration interval")
    missing = F.map_from_entries(F.array_compact(F.array(*[F.when(fields[k].isNull(), F.struct(F.lit(f"facts.{k}").alias("key"), F.lit(v).alias("value"))) for k, v in why.items()])))
    error = first((F.col("_p.error").isNotNull(), F.col("_p.error")), (F.col("_n.error").isNotNull(), F.col("_n.error")), (F.col("_m").isNull(), "unknown_metric"), (F.col("_u").isNull(), "unknown_unit"))
    return j.select(
        F.concat_ws("-", F.lit(author), F.lit(guide.version), F.col("item_id")).alias("annotation_id"), F.lit(author).alias("annotator_id"), F.lit("agent").alias("annotator_kind"), F.lit("agent_authored_deterministic_annotation").alias("method"), "item_id", "item_type", F.lit(guide.version).alias("guide_version"), F.lit(guide.registry).alias("registry_version"),
        F.struct(*[c.alias(k) for k, c in fields.items()]).alias("facts"), "evidence_refs", F.lit("agent_draft").alias("status"), F.array(*map(F.lit, guide.flags)).cast("array<string>").alias("exposure_flags"), missing.alias("field_missing_reasons"),
        F.struct(F.col("source_sha256").alias("doc_sha256"), "source_record_ref", F.col("scope_dependency_refs").alias("availability_dependency_refs"), F.lit(guide.offset_basis).alias("offset_basis")).alias("provenance"), error.alias("error"),
    )


def assessments(drafts: DataFrame) -> DataFrame:
    """One assessment per draft without an error: what history alone can't answer stays unknown."""
    corporate = F.col("facts.scope_status_as_of") == "unresolved_retrospective_dependency"
    answer = lambda i, response, reason: F.struct(F.lit(f"MQ{i:02d}").alias("question_id"), response.alias("response"), F.lit(reason).alias("reason"))
    questions = [*[answer(i, F.lit("unknown"), "no prior assumptions, outlook or decision context in a single fact") for i in range(1, 6)], answer(6, F.when(corporate, "insufficient").otherwise("sufficient"), "narrow fact check of the selected place"), answer(7, F.lit("unknown"), "prior_not_provided"), answer(8, F.lit("investigate"), "scope and prior have to be obtained first")]
    return drafts.where("error is null").select(F.concat("annotation_id", F.lit("-assessment")).alias("assessment_id"), "annotation_id", "item_id", "annotator_id", "annotator_kind", "guide_version", F.lit("historical_comparison").alias("purpose"), F.lit("date").alias("as_of_precision"), F.lit("needs_review").alias("review_readiness"), F.array(*questions).alias("questions"), "exposure_flags")
