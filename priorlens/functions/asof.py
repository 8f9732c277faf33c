"""Point-in-time predicates: was a fact knowable at a cutoff?

Times are ISO strings: a date, or a date-time that needs an offset. Every predicate gives struct(ok, reason) or an array of
reason codes; unknown is never true.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .reasons import first, merged

MODES = ("current_review", "historical_public", "observed_live")
_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def _day(x: Column) -> Column:
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(x, 1, 10)).try_cast("date")


def _instant(x: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(x, "Z$", "+00:00"))


def moment_before(value: Column, cutoff: Column, strict: bool | Column = False) -> Column:
    """struct(ok boolean, reason string): does ``value`` lie before (or, unless strict, at) the cutoff?

    Codes: publication_unknown, timezone_unknown, same_day_order_unknown, future_information, invalid_time."""
    strict = F.lit(strict) if isinstance(strict, bool) else strict
    by_day = (F.length(value) == 10) | (F.length(cutoff) == 10)
    a, b = _day(value), _day(cutoff)
    x, y = _instant(value), _instant(cutoff)
    late = F.when(by_day, F.when(strict, a >= b).otherwise(a > b)).otherwise(F.when(strict, x >= y).otherwise(x > y))
    reason = first(
        (value.isNull() | (value == ""), "publication_unknown"),
        (cutoff.isNull() | a.isNull() | b.isNull() | ((F.length(value) > 10) & x.isNull()), "invalid_time"),
        ((F.length(value) > 10) & ~value.rlike(_OFFSET), "timezone_unknown"),
        (by_day & (a == b) & (((F.length(value) == 10) & (F.length(cutoff) > 10)) | strict), "same_day_order_unknown"),
        (~by_day & ~cutoff.rlike(_OFFSET), "timezone_unknown"),
        (~by_day & y.isNull(), "invalid_time"),
        (late, "future_information"),
    )
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def availability(c: Column, mode: Column, cutoff: Column, strict: bool = False) -> Column:
    """Array of codes that keep the claim struct ``c`` from being used at the cutoff in a mode; empty if it may be.

    Fields read: revision_published_at, revision_published_date, published_at, published_date, observed_at,
    scope_status_as_of, availability_dependencies (array of published_at, published_date, observed_at, use_policy)."""
    date_only = F.length(cutoff) == 10
    review, live = mode == "current_review", mode == "observed_live"
    some = lambda *names: F.coalesce(*[F.when(c[n] != "", c[n]) for n in names])
    published = moment_before(some("revision_published_at", "revision_published_date", "published_at", "published_date"), cutoff, strict)["reason"]
    observed = F.when(review | live, F.concat(F.lit("observed:"), moment_before(c["observed_at"], cutoff, date_only)["reason"]))

    def dependency(d: Column) -> Column:
        seen = moment_before(d["observed_at"], cutoff, date_only)["reason"]
        seen_strictly = moment_before(d["observed_at"], cutoff, True)["reason"]
        public = moment_before(F.coalesce(d["published_at"], d["published_date"]), cutoff, True)["reason"]
        public = F.when(F.coalesce(d["use_policy"].startswith("current-only"), F.lit(False)), F.lit("current_only_dependency")).otherwise(public)
        public = F.when(live & seen_strictly.isNotNull(), F.concat(F.lit("observed:"), seen_strictly)).otherwise(public)
        return F.concat(F.lit("dependency:"), F.when(review, seen).otherwise(public))

    scope = F.when(~review & (c["scope_status_as_of"] == "unresolved_retrospective_dependency"), F.lit("scope_unresolved_at_cutoff"))
    return merged(F.array_compact(F.array(published, observed)), F.array_compact(F.transform(c["availability_dependencies"], dependency)), F.array_compact(F.array(scope)))


def publication_errors(c: Column, as_of: Column) -> Column:
    """The stricter twin for claim comparison: a date can't establish availability within that day. Array of codes."""

    def single(available: Column) -> Column:
        x, y = _instant(available), _instant(as_of)
        timed = (F.length(as_of) > 10) & (F.length(available) > 10)
        return first(
            (as_of.isNull(), F.lit(None).cast("string")),
            (as_of.isNotNull() & (available.isNull() | (available == "")), "publication_availability_unknown"),
            (_day(available).isNull() | _day(as_of).isNull() | (timed & (x.isNull() | y.isNull())), "invalid_publication_or_cutoff"),
            ((F.length(as_of) == 10) & (_day(available) > _day(as_of)), "future_information_after_cutoff"),
            ((F.length(as_of) > 10) & (F.length(available) == 10) & (_day(available) >= _day(as_of)), "date_only_intraday_availability_unresolved"),
            (timed & (~available.rlike(_OFFSET) | ~as_of.rlike(_OFFSET)), "timezone_missing"),
            (timed & (x > y), "future_information_after_cutoff"),
        )

    own = single(F.coalesce(c["available_at"], c["published_at"], c["published_date"]))

    def dependency(d: Column) -> Column:
        when = F.coalesce(d["published_at"], d["published_date"], F.when(d["availability_basis"] == "observed_conservative", d["observed_at"]))
        return F.concat(F.lit("dependency:"), single(when))

    none = F.expr("cast(array() as array<string>)")
    return F.when(as_of.isNull(), none).otherwise(F.concat(F.array_compact(F.array(own)), F.coalesce(F.array_compact(F.transform(c["availability_dependencies"], dependency)), none)))
