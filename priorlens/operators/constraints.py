"""Constraints as error arrays: typed schemas, rule lists, keys and references."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reasons import codes


def checked(df: DataFrame, rules: Mapping[str, Column], name: str = "errors") -> DataFrame:
    """Adds the sorted codes of the rules that hold (a rule is true where it is broken; unknown is not broken)."""
    return df.withColumn(name, F.array_sort(codes(*[(F.coalesce(c, F.lit(False)), k) for k, c in rules.items()])))


def schema_rules(schema: Mapping[str, object], at: str = "") -> dict[str, Column]:
    """Rules from a subset of JSON Schema over columns: required, enum, const, pattern, minimum, maximum, minItems, and
    properties of structs. An unknown keyword is refused rather than skipped."""
    known = {"type", "properties", "required", "additionalProperties", "enum", "const", "pattern", "minimum", "maximum", "minItems", "description"}
    if extra := set(schema) - known:
        raise ValueError(f"unsupported schema keywords: {sorted(extra)}")
    out: dict[str, Column] = {}
    col = lambda p: F.col(p)
    for k in schema.get("required", ()):
        out[f"{at}{k}:required"] = col(f"{at}{k}").isNull()
    for k, s in schema.get("properties", {}).items():
        p = f"{at}{k}"
        c = col(p)
        if "enum" in s:
            out[f"{p}:enum"] = ~c.isin([v for v in s["enum"] if v is not None])
        if "const" in s:
            out[f"{p}:const"] = c != F.lit(s["const"])
        if "pattern" in s:
            out[f"{p}:pattern"] = ~c.rlike(s["pattern"])
        if "minimum" in s:
            out[f"{p}:minimum"] = c < s["minimum"]
        if "maximum" in s:
            out[f"{p}:maximum"] = c > s["maximum"]
        if "minItems" in s:
            out[f"{p}:minItems"] = F.size(c) < s["minItems"]
        if "properties" in s:
            out |= schema_rules({k: v for k, v in s.items() if k in known - {"type"}}, f"{p}.")
    return out


def missing_reason_rules(fields: Sequence[str], reasons: str = "field_missing_reasons", allowed: Sequence[str] = ()) -> dict[str, Column]:
    """A null field needs a reason, a present one forbids it; reasons come from a closed list."""
    out: dict[str, Column] = {}
    for f in fields:
        r = F.element_at(reasons, f) if not isinstance(reasons, Mapping) else F.col(reasons[f])
        out[f"{f}:missing_without_reason"] = F.col(f).isNull() & r.isNull()
        out[f"{f}:stale_reason"] = F.col(f).isNotNull() & r.isNotNull()
        if allowed:
            out[f"{f}:unknown_reason"] = ~r.isin(list(allowed))
    return out


def null_reasons(fields: Mapping[str, str]) -> Column:
    """A map from each null field to its reason."""
    entries = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.struct(F.lit(f).alias("key"), F.lit(r).alias("value"))) for f, r in fields.items()]))
    return F.map_from_entries(entries)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def list_orphans(child: DataFrame, parent: DataFrame, refs: str, pk: str, key: str) -> DataFrame:
    """(key, ref) for references in a list column that have no parent."""
    r = child.select(key, F.explode(refs).alias("ref"))
    return r.join(parent.select(F.col(pk).alias("ref")).distinct(), "ref", "left_anti")


def ambiguous(df: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Keys (an alias in its context) that name more than one target."""
    return df.groupBy(*keys).agg(F.count_distinct(target).alias("targets")).where("targets > 1")


def layer_violations(edges: DataFrame, nodes: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Driver edges with an unknown end or against the order of layers."""
    place = F.array_position(F.array(*map(F.lit, layers)), F.col("layer"))
    n = nodes.select("id", place.alias("p"))
    e = edges.join(n.toDF("from_id", "pf"), "from_id", "left").join(n.toDF("to_id", "pt"), "to_id", "left")
    return e.withColumn("errors", codes((F.col("pf").isNull() | F.col("pt").isNull(), "unknown_node"), (F.col("pf") >= F.col("pt"), "layer_order"))).where(F.size("errors") > 0).drop("pf", "pt")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Do two tables hold the same rows, as often?"""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def round_trip(spans: DataFrame, texts: DataFrame, key: str, *, start="start", end="end", text="text", source="source") -> DataFrame:
    """Spans whose text isn't what the source has at [start, end), in code points."""
    j = spans.join(texts.select(key, F.col(source).alias("_s")), key, "left")
    got = F.substring(F.col("_s"), F.col(start) + 1, F.col(end) - F.col(start))
    return j.withColumn("errors", codes((F.col("_s").isNull(), "unknown_source"), ((F.col(start) < 0) | (F.col(end) <= F.col(start)) | (F.col(end) > F.length("_s")), "span_out_of_range"), (~got.eqNullSafe(F.col(text)), "text_mismatch"))).where(F.size("errors") > 0).drop("_s")


def monotonic_violations(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows whose value is below the one before."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_prev", F.lag(value).over(w)).where(F.col(value) < F.col("_prev")).drop("_prev")


# The permission columns of a rights row, in the order in which refusals are given.
RIGHTS = ["collect", "store", "analyze", "display_excerpt"]


def rights_gate(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """requests: request_id, source_id, domain, path, on (date). registry: source_id, domain, url_path_prefix, rights_status,
    available_from, available_to, authentication and the permission columns. Exactly one row of the source and domain with
    a prefix of the path must allow it; ``refusal`` names the first rule that fails."""
    j = requests.join(registry, ["source_id", "domain"], "left")
    hit = F.coalesce(F.col("path").startswith(F.col("url_path_prefix")), F.lit(False))
    keep = ["rights_status", "available_from", "available_to", "authentication", *RIGHTS]
    by = j.groupBy("request_id", "source_id", "domain", "path", "on").agg(F.count_if(hit).alias("_n"), F.max_by(F.when(hit, F.struct(*keep)), F.when(hit, F.length("url_path_prefix"))).alias("_r"))
    r = F.col("_r")
    from ..functions.reasons import first

    return by.withColumn("refusal", first((F.col("_n") == 0, "no_rights_row"), (F.col("_n") > 1, "ambiguous_rights_rows"), (~r["rights_status"].eqNullSafe(F.lit("approved")), "rights_not_approved"), (r["authentication"].isNotNull() & (r["authentication"] != "none"), "authentication_required"), (F.col("on") < r["available_from"], "before_availability"), (F.col("on") > r["available_to"], "after_availability"), *[(~F.coalesce(r[p], F.lit(False)), f"{p}_not_permitted") for p in RIGHTS])).drop("_n", "_r")
