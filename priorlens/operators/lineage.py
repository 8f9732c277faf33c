"""Lineage graphs: connected components, split constraints, leakage audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.reasons import codes
from ..sources.store import stored


def components(edges: DataFrame, nodes: DataFrame | None = None, *, a="a", b="b", node="node") -> DataFrame:
    """node, component: the smallest node reachable over undirected edges. Nodes without edges stand alone; with ``nodes``,
    only these are returned."""
    out = labelled(edges, nodes, a=a, b=b, node=node)
    return out.drop("given") if nodes is None else out.where("given").drop("given")


def labelled(edges: DataFrame, nodes: DataFrame | None = None, *, a="a", b="b", node="node") -> DataFrame:
    """node, component (the smallest node reachable), given (is it one of ``nodes``): all nodes, those of edges too.

    A node whose only neighbour is smaller takes that one's component, so its edges are done after one pass (all of them,
    where groups are tied to their smallest member). What is left is contracted until no edge is left; names play no part
    in that, and each component is named by its smallest node at the end."""
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"), "edges")
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("given", F.lit(nodes is None))
    if nodes is not None:
        both = both.unionByName(nodes.select(F.col(node).alias("u"), F.lit(None).alias("v"), F.lit(True).alias("given")))
    near = stored(both.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("given").alias("given")), "neighbours")
    rest = stored(e.join(near.where("lo < hi").select("u"), "u", "left_semi"), "rest")
    out = near.select(F.col("u").alias(node), F.expr("case when lo = hi and lo < u then lo else u end").alias("at"), "given")
    met = _contracted(rest)
    if met is None:
        return out.select(node, F.col("at").alias("component"), "given")
    named = met.join(met.groupBy("m").agg(F.min("u").alias("component")), "m").select(F.col("u").alias("at"), "component")
    return out.join(named, "at", "left").select(node, F.coalesce("component", "at").alias("component"), "given")


def _contracted(e: DataFrame) -> DataFrame | None:
    """u, m: every node of the edges (u, v) and one node that stands for its component; None without edges.

    In each round a node goes to that one of itself and its neighbours which a hash of the round puts first, and edges are
    drawn between where their ends went. So long chains and large groups lose a part of their nodes in every round, and all
    rounds together read a few times the edges. Each round's tables are written: lost executors cost one round."""
    rounds = []
    while e.count():
        turn = F.lit(len(rounds))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min(F.xxhash64(turn, "v")).alias("h"), F.min_by("v", F.xxhash64(turn, "v")).alias("m"))
        rounds.append(stored(first.select("u", F.when(F.col("h") < F.xxhash64(turn, "u"), F.col("m")).otherwise(F.col("u")).alias("m")), "went"))
        ends = e.join(rounds[-1].toDF("u", "um"), "u").join(rounds[-1].toDF("v", "vm"), "v").where("um <> vm")
        e = stored(ends.select(F.greatest("um", "vm").alias("u"), F.least("um", "vm").alias("v")).distinct(), "edges")
    out = None
    for went in reversed(rounds):
        out = went if out is None else went.join(out.toDF("m", "on"), "m", "left").select("u", F.coalesce("on", "m").alias("m"))
    return None if out is None else stored(out, "met")


def component_sizes(found: DataFrame, node: str = "node") -> DataFrame:
    """component, size; largest first, ties by name."""
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "component")


def split_violations(found: DataFrame, assigned: DataFrame, *, node="node", split="split", group="group") -> DataFrame:
    """Components whose nodes lie in more than one split or group."""
    j = found.join(assigned.select(node, split, group), node)
    by = j.groupBy("component").agg(F.count_distinct(split).alias("splits"), F.count_distinct(group).alias("groups"), F.count(F.lit(1)).alias("size"))
    return by.withColumn("reasons", codes((F.col("splits") > 1, "component_in_several_splits"), (F.col("groups") > 1, "component_in_several_groups"))).where(F.size("reasons") > 0)


# What two claims share when they tell the same fact twice.
OVERLAP_KEYS = ["company_id", "metric_id", "scope_id", "period_start", "period_end", "as_of_date", "numeric_value"]


def representation_overlaps(claims: DataFrame, keys: list[str] = OVERLAP_KEYS) -> DataFrame:
    """Edges between claims of different documents and definitions that share all keys (null equals null). Instead of all
    pairs of a group, each claim is tied to the group's smallest claim of another document and definition, which connects
    the same claims."""
    k = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    c = claims.select(F.col("record_id"), "doc_id", "definition_version", k.alias("k"))
    low = c.groupBy("k").agg(F.min(F.struct("record_id", "doc_id", "definition_version")).alias("lo"), F.count(F.lit(1)).alias("n")).where("n > 1")
    other = c.join(low, "k").where((F.col("doc_id") != F.col("lo.doc_id")) & ~F.col("definition_version").eqNullSafe(F.col("lo.definition_version")))
    # claims of the smallest one's own document hang to the smallest claim outside of it
    second = other.groupBy("k").agg(F.min("record_id").alias("second"))
    own = c.join(low, "k").where((F.col("doc_id") == F.col("lo.doc_id")) & (F.col("record_id") != F.col("lo.record_id"))).join(second, "k")
    return other.select(F.col("lo.record_id").alias("from_id"), F.col("record_id").alias("to_id")).unionByName(own.select(F.col("record_id").alias("from_id"), F.col("second").alias("to_id"))).withColumn("edge_type", F.lit("representation_overlap"))


def split_audit(manifest: DataFrame, edges: DataFrame) -> DataFrame:
    """manifest: row_id, doc_id, event_family_id, split, exposure, first_seen (date text). edges: from_id, to_id, edge_type over row ids.
    One row per manifest row with its component and the array of its violations."""
    ties = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    hub = lambda c: manifest.where(F.col(c).isNotNull()).select(F.col("row_id").alias("a"), F.concat(F.lit(f"~{c}:"), F.col(c)).alias("b"))
    found = components(ties.unionByName(hub("doc_id")).unionByName(hub("event_family_id")), manifest.select(F.col("row_id").alias("node")))
    j = manifest.join(found, F.col("row_id") == F.col("node"), "left").drop("node")
    by = j.groupBy("component").agg(F.count_distinct("split").alias("_splits"))
    dup = manifest.groupBy("row_id").agg(F.count(F.lit(1)).alias("_n"))
    known = manifest.select(F.col("row_id").alias("to_id"), F.lit(True).alias("_t"))
    loose = edges.join(known, "to_id", "left").where("_t is null").select(F.col("from_id").alias("row_id")).distinct().withColumn("_loose", F.lit(True))
    j = j.join(by, "component").join(dup, "row_id").join(loose, "row_id", "left")
    reasons = codes((F.col("_splits") > 1, "component_crosses_splits"), (F.col("_n") > 1, "duplicate_row_id"), (F.col("split").isNull() | ~F.col("split").isin("train", "development", "test"), "unknown_split"), ((F.col("split") == "test") & (F.col("exposure") != "none"), "exposed_test_row"), (F.col("_loose").isNotNull(), "edge_to_unknown_row"))
    return j.select(*manifest.columns, "component", reasons.alias("reasons"))
