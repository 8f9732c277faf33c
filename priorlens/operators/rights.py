"""Which registered right covers a URL: prefixes of its path as keys, and the first reason to refuse it.

A registry row covers a host's paths that begin with its prefix. The prefixes of a (source, host) have few distinct lengths, so
a path is cut at those lengths and looked up by equality: hash joins, no range join, and a request meets only rows that
cover it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.reasons import first

# Permissions of a registry row, those that a local collection needs, and names of secrets in a query.
PERMISSIONS = ["automated_access", "metadata_storage", "raw_storage", "internal_analysis", "ai_input", "ai_training", "external_transfer", "embedding_storage", "derived_chunk_storage", "sharing", "redistribution"]
LOCAL_PERMISSIONS = ["automated_access", "metadata_storage", "raw_storage", "internal_analysis", "derived_chunk_storage"]
SECRET_QUERY = r"(?i)key|token|secret|password|auth|credential|signature|session"


def url_parts(url: Column) -> dict[str, Column]:
    """scheme, user, host, port, path (percent-decoded, ``/`` if empty), query: null for a text that is no absolute URL."""
    form = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#]*)@)?(\[[^\]/?#]*\]|[^/?#:@]*)(?::([0-9]*))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"
    part = lambda k: F.when(url.rlike(form), F.regexp_extract(url, form, k))
    raw = part(5)
    # + is no space in a path
    path = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    return {"scheme": F.lower(part(1)), "user": part(2), "host": F.lower(part(3)), "port": part(4), "path": F.when(path == "", "/").otherwise(path), "query": part(6)}


def is_valid(url: Column) -> Column:
    """An http(s) URL with a host, without user, odd port, control characters, dot segments, doubly encoded paths or secrets
    in its query. False for null."""
    p = url_parts(url)
    names = F.transform(F.split(p["query"], "&"), lambda x: F.substring_index(x, "=", 1))
    return F.coalesce(
        p["scheme"].isin("http", "https") & (p["host"] != "") & (p["user"] == "") & p["port"].isin("", "80", "443") & ~url.rlike(r"[\x00-\x1f]") & ~F.exists(F.split(p["path"], "/"), lambda s: s.isin(".", ".."))
        & ~p["path"].contains("\\") & ~p["path"].contains("%") & ~F.exists(names, lambda n: n.rlike(SECRET_QUERY)),
        F.lit(False),
    )


def covering(requests: DataFrame, registry: DataFrame, *, request="request_id", source="source_id", host="host", path="path", domain="domain", prefix="url_path_prefix") -> DataFrame:
    """A row for each request and registry row that covers it: the request's id, ``right`` (struct of the registry's columns) and
    ``prefix_length``. Prefixes that don't begin with / cover nothing; registry rows of one prefix all count."""
    rows = registry.where(F.col(prefix).startswith("/")).select(F.struct(*registry.columns).alias("right"))
    rows = rows.withColumns({"_s": F.col(f"right.{source}"), "_h": F.lower(f"right.{domain}"), "_p": F.col(f"right.{prefix}")})
    lengths = rows.groupBy("_s", "_h").agg(F.collect_set(F.length("_p")).alias("_n"))
    asked = requests.select(F.col(request), F.col(source).alias("_rs"), F.lower(host).alias("_rh"), F.col(path).alias("_path"))
    cut = asked.join(lengths, (F.col("_rs") == F.col("_s")) & (F.col("_rh") == F.col("_h"))).drop("_s", "_h")
    cut = cut.withColumn("_n", F.explode(F.filter("_n", lambda n: n <= F.length("_path")))).withColumn("_key", F.substring(F.col("_path"), F.lit(1), F.col("_n")))
    found = cut.join(rows, (F.col("_rs") == F.col("_s")) & (F.col("_rh") == F.col("_h")) & (F.col("_key") == F.col("_p")))
    return found.select(request, "right", F.length("_p").alias("prefix_length"))


def longest(requests: DataFrame, registry: DataFrame, **columns: str) -> DataFrame:
    """The registry row with the longest covering prefix of each request that has one (ties to the least row)."""
    request = columns.get("request", "request_id")
    found = covering(requests, registry, **columns)
    return found.groupBy(request).agg(F.min_by("right", F.struct(-F.col("prefix_length"), F.col("right"))).alias("right"), F.max("prefix_length").alias("prefix_length"))


def decisions(requests: DataFrame, registry: DataFrame, today: str) -> DataFrame:
    """requests (request_id, source_id, url, published: text of a date or time) with ``allowed``, ``reason`` and ``right``.

    registry: source_id, domain, url_path_prefix, rights_status, authorization_kind, authorization_evidence_ref, source_type,
    contract_confirmation_status, contract_evidence_ref, authorization_valid_from, authorization_valid_to, terms_url,
    terms_checked_at, authentication, available_from, available_to (texts) and the permission columns. Exactly one row must
    cover the URL; the first rule that it breaks is the reason. Evidence is a valid URL; of other evidence nothing is known here."""
    p = url_parts(F.col("url"))
    r = requests.withColumns({"_valid": is_valid(F.col("url")), "host": p["host"], "path": p["path"]})
    found = covering(r.where("_valid"), registry).groupBy("request_id").agg(F.count(F.lit(1)).alias("_n"), F.min("right").alias("right"))
    j = r.join(found, "request_id", "left")
    row, none = F.col("right"), F.lit("")
    text = lambda c: F.coalesce(row[c], none)
    day = lambda c: F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    licensed, contract = text("source_type").startswith("licensed"), text("authorization_kind") == "contract"
    start, end = day(text("authorization_valid_from")), F.when(text("authorization_valid_to") == "unlimited", F.lit("9999-12-31").cast("date")).otherwise(day(text("authorization_valid_to")))
    now = F.lit(today).cast("date")
    said = F.when(F.col("published").rlike(r"^\d{4}-\d{2}-\d{2}($|T| )"), day(F.substring("published", 1, 10)))
    since, until = day(text("available_from")), day(text("available_to"))
    reason = first(
        (~F.col("_valid"), "invalid_or_credentialed_url"),
        (F.coalesce("_n", F.lit(0)) != 1, "missing_or_ambiguous_domain_path_rights"),
        (text("rights_status") != "verified", "rights_not_verified"),
        (~text("authorization_kind").isin("contract", "public_permission"), "authorization_kind_unverified"),
        (~is_valid(row["authorization_evidence_ref"]), "authorization_evidence_missing"),
        (licensed & ~contract, "licensed_source_requires_contract"),
        (contract & ((text("contract_confirmation_status") != "verified") | ~is_valid(row["contract_evidence_ref"])), "contract_not_verified"),
        (start.isNull() | end.isNull(), "authorization_validity_unknown"),
        ((now < start) | (now > end), "authorization_not_currently_valid"),
        (~is_valid(row["terms_url"]), "missing_terms_basis"),
        (day(F.substring(text("terms_checked_at"), 1, 10)).isNull(), "missing_terms_check_date"),
        *[(~text(k).isin("allowed", "denied", "unresolved"), f"unrecorded_permission_{k}") for k in PERMISSIONS],
        *[(text(k) != "allowed", f"permission_not_allowed_{k}") for k in LOCAL_PERMISSIONS],
        (text("authentication") != "none", "authentication_requires_provider_adapter"),
        (said.isNull(), "publisher_date_unknown_for_coverage"),
        (since.isNull() | until.isNull(), "publication_coverage_unknown"),
        ((said < since) | (said > until), "publication_outside_verified_coverage"),
    )
    shown = F.when(F.col("_n") == 1, row)
    return j.select(*requests.columns, reason.isNull().alias("allowed"), F.coalesce(reason, F.lit("verified_local_collection_only")).alias("reason"), shown.alias("right"))
