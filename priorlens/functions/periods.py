"""Fiscal periods: validity, alignment, parsing of header text, calendar bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .reasons import first, let


def _d(x: Column) -> Column:
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), x).try_cast("date")


def inclusive_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def period_valid(p: Column, flow: Column) -> Column:
    """A balance needs a date; a flow needs ordered ends whose inclusive length is the stated one."""
    start, end = _d(p["period_start"]), _d(p["period_end"])
    return F.coalesce(F.when(flow == "balance", _d(p["as_of_date"]).isNotNull()).when(flow == "flow", (end >= start) & (inclusive_days(start, end) == p["duration_days"])), F.lit(False))


def _anniversary(a: Column, b: Column) -> Column:
    return (F.year(a) == F.year(b) + 1) & (F.month(a) == F.month(b)) & (F.day(a) == F.day(b))


def period_aligned(a: Column, b: Column, flow: Column, basis: Column) -> Column:
    """Null if either period is invalid. Revisions need the same period, yearly comparisons the calendar anniversary with at
    most a leap day between their lengths."""
    balance = flow == "balance"
    same = F.when(balance, a["as_of_date"].eqNullSafe(b["as_of_date"])).otherwise(a["period_start"].eqNullSafe(b["period_start"]) & a["period_end"].eqNullSafe(b["period_end"])) & a["duration_days"].eqNullSafe(b["duration_days"])
    yearly = F.when(balance, _anniversary(_d(a["as_of_date"]), _d(b["as_of_date"]))).otherwise(_anniversary(_d(a["period_start"]), _d(b["period_start"])) & _anniversary(_d(a["period_end"]), _d(b["period_end"])) & (F.abs(a["duration_days"] - b["duration_days"]) <= 1))
    out = F.when(basis == "same_period_revision", same).when(basis.isin("yoy", "within_release_comparison"), yearly).otherwise(F.lit(False))
    return F.when(period_valid(a, flow) & period_valid(b, flow), F.coalesce(out, F.lit(False)))


def period_data(c: Column) -> Column:
    """struct(start, end, days, error) of a claim struct with balance_or_flow, period_start, period_end, as_of_date, period_duration_days."""
    flow, start, end = c["balance_or_flow"], _d(c["period_start"]), _d(c["period_end"])
    instant = F.coalesce(c["as_of_date"], c["period_end"])
    days = inclusive_days(start, end)
    error = first(
        ((flow == "balance") & instant.isNull(), "balance_date_missing"),
        ((flow == "balance") & _d(instant).isNull(), "invalid_balance_date"),
        (flow == "balance", F.lit(None).cast("string")),
        (~F.coalesce(flow == "flow", F.lit(False)) & ~F.coalesce(flow == "balance", F.lit(False)), "flow_period_missing"),
        ((flow == "flow") & (c["period_start"].isNull() | c["period_end"].isNull()), "flow_period_missing"),
        ((flow == "flow") & (start.isNull() | end.isNull()), "invalid_period"),
        ((flow == "flow") & (days <= 0), "period_reversed"),
        ((flow == "flow") & ~days.eqNullSafe(c["period_duration_days"].cast("int")), "period_duration_missing_or_inconsistent"),
    )
    return F.struct(F.when(error.isNull() & (flow == "flow"), start).alias("start"), F.when(error.isNull(), F.when(flow == "balance", _d(instant)).otherwise(end)).alias("end"), F.when(error.isNull() & (flow == "flow"), days).alias("days"), error.alias("error"))


# The header patterns and the error codes below are fixed values.
def parse_period(period_header: Column, year_header: Column) -> Column:
    """Header text of a fiscal year that ends on June 30 -> struct(period_start, period_end, as_of_date, period_kind,
    fiscal_year, fiscal_quarter, duration_days, error)."""
    squash = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    ph, yh = squash(period_header), squash(year_header)
    years = F.regexp_extract_all(yh, F.lit(r"(?<!\d)(20\d{2})(?!\d)"), F.lit(1))
    year = F.get(years, F.lit(0)).cast("int")
    span = F.nullif(F.regexp_extract(ph, r"^(Three|Twelve) Months Ended June 30,?$", 1), F.lit(""))
    instant = F.nullif(F.regexp_extract(ph, r"^June 30,\s*(20\d{2})$", 1), F.lit("")).cast("int")
    error = first(
        (period_header.isNull() | year_header.isNull() | (F.size(years) != 1), "missing_or_ambiguous_year_header"),
        (span.isNotNull() & ~yh.rlike(r"^20\d{2}$"), "unsupported_duration_year_header"),
        (span.isNull() & (instant.isNull() | (instant != year)), "unsupported_or_conflicting_period_header"),
    )
    ok = error.isNull()
    quarter = span == "Three"
    end = F.make_date(year, F.lit(6), F.lit(30))
    start = F.make_date(F.when(quarter, year).otherwise(year - 1), F.when(quarter, F.lit(4)).otherwise(F.lit(7)), F.lit(1))
    flow = ok & span.isNotNull()
    text = lambda c, x: F.when(c, F.date_format(x, "yyyy-MM-dd"))
    return F.struct(
        text(flow, start).alias("period_start"), text(flow, end).alias("period_end"), text(ok & span.isNull(), end).alias("as_of_date"),
        F.when(ok, F.when(span.isNull(), "instant").when(quarter, "quarter").otherwise("annual")).alias("period_kind"),
        F.when(ok, year).alias("fiscal_year"), F.when(flow & quarter, F.lit(4)).alias("fiscal_quarter"), F.when(flow, inclusive_days(start, end)).alias("duration_days"), error.alias("error"),
    )


def quarter_bounds(quarter_id: Column) -> Column:
    """``2024Q3`` -> struct(start, end); null for anything else."""
    digits = F.regexp_replace(F.regexp_extract(quarter_id, r"^(\d{4})-?Q([1-4])$", 0), "[-Q]", "")
    start = let(digits, lambda d: F.when(d != "", F.make_date(F.substring(d, 1, 4).try_cast("int"), (F.substring(d, 5, 1).try_cast("int") - 1) * 3 + 1, F.lit(1))))
    return let(start, lambda d: F.struct(d.alias("start"), F.last_day(F.add_months(d, 2)).alias("end")))


def english_date(text: Column) -> Column:
    """The first ``Month d, yyyy`` in a text as a date."""
    return F.try_to_timestamp(F.regexp_extract(text, r"((?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4})", 1), F.lit("MMMM d, yyyy")).cast("date")


def safe_date(text: Column) -> Column:
    """struct(day, clock, precision, zone): midnight and zone are never inferred; Korean half-days are read. Each pattern is
    looked for once, and its parts are split."""

    def found(x):
        day = F.regexp_extract(x, r"(\d{4})[-./년]\s*(\d{1,2})[-./월]\s*(\d{1,2})", 0)
        clock = F.regexp_extract(x, r"(\d{1,2}):(\d{2})(?::(\d{2}))?", 0)
        zone = F.regexp_extract(x, r"\d(Z|[+-]\d{2}:?\d{2}|\s?KST)$", 1)
        return F.struct(F.split(day, r"\D+").alias("day"), F.split(clock, ":").alias("clock"), F.regexp_extract(x, r"(오전|오후)\s*\d{1,2}:\d{2}", 1).alias("half"), zone.alias("zone"))

    def numbers(p):
        part = lambda c, k: F.get(p[c], F.lit(k)).try_cast("int")
        hour, date = part("clock", 0), F.try_make_timestamp(*[part("day", k) for k in range(3)], F.lit(0), F.lit(0), F.lit(0)).cast("date")
        hour = F.when(p["half"] == "오후", hour % 12 + 12).when(p["half"] == "오전", hour % 12).otherwise(hour)
        return F.struct(date.alias("day"), hour.alias("hour"), part("clock", 1).alias("minute"), part("clock", 2).alias("second"), F.trim(F.nullif(p["zone"], F.lit(""))).alias("zone"))

    def fields(n):
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        told = n["hour"].between(0, 23) & n["minute"].between(0, 59)
        clock = F.when(told, F.concat_ws(":", two(n["hour"]), two(n["minute"]), two(F.coalesce(n["second"], F.lit(0)))))
        precision = F.when(n["day"].isNull(), "unknown").when(~F.coalesce(told, F.lit(False)), "date").when(n["second"].isNull(), "minute").otherwise("second")
        return F.struct(n["day"].alias("day"), clock.alias("clock"), precision.alias("precision"), n["zone"].alias("zone"))

    return let(let(let(text, found), numbers), fields)


def utc_if_offset(text: Column) -> Column:
    """A UTC timestamp only where the text has an explicit offset."""
    return F.when(text.rlike(r"\d(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")))


def dates_conflict(a: Column, b: Column) -> Column:
    """Two safe_date structs at the precision they share: true, false, or null if either day is unknown."""
    clocks = a["clock"].isNotNull() & b["clock"].isNotNull() & a["zone"].eqNullSafe(b["zone"])
    return (a["day"] != b["day"]) | (clocks & (a["clock"] != b["clock"]))
