"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|from|source)(=|$)"


def _parts(url: Column) -> tuple[Column, ...]:
    take = lambda k: F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^?#]*)(\?[^#]*)?", k)
    return F.lower(take(1)), F.lower(take(2)), take(3), take(4), take(5)


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment, user or tracking parameter; the order of the rest is kept."""
    scheme, host, port, path, query = _parts(url)
    port = F.when(((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443")), F.lit("")).otherwise(port)
    kept = F.array_join(F.filter(F.split(F.substring(query, 2, 1 << 20), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)), "&")
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, port, F.when(path == "", F.lit("/")).otherwise(path), F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept))))


def redacted(url: Column) -> Column:
    """Scheme, host and path only."""
    scheme, host, _, path, _ = _parts(url)
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, path))


def is_safe(url: Column) -> Column:
    """An https URL of a public name: no user part, no address or local host, no other port."""
    scheme, host, port, _, _ = _parts(url)
    return F.coalesce((scheme == "https") & host.rlike(r"^([a-z0-9-]+\.)+[a-z]{2,}$") & port.isin("", ":443") & ~F.trim(url).rlike(r"^[^/]*//[^/?#]*@") & ~host.rlike(r"\.(local|internal|localhost)$"), F.lit(False))


def host(url: Column) -> Column:
    return F.nullif(_parts(url)[1], F.lit(""))


def section(url: Column) -> Column:
    """Host and first path segment."""
    _, h, _, path, _ = _parts(url)
    return F.when(h != "", F.concat(h, F.lit("/"), F.coalesce(F.get(F.split(path, "/"), F.lit(1)), F.lit(""))))


def article_id(url: Column, parameter: str = "no") -> Column:
    """The id from a query parameter, or the last number in the path."""
    _, _, _, path, query = _parts(url)
    named = F.regexp_extract(query, rf"[?&]{parameter}=([A-Za-z0-9_-]+)", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(F.regexp_extract(path, r"(\d+)(?:\.[a-z]+)?/?$", 1), F.lit("")))
