"""Whole lineage components dealt to splits in given shares, balanced by weight in every stratum."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import stored

#: Components with more than a LARGE-th of their stratum's weight are dealt one by one: fewer than LARGE a stratum.
LARGE, BUCKETS = 200, 256


def strata(nodes: DataFrame, components: DataFrame, *, node="node", stratum="stratum", weight="weight") -> DataFrame:
    """component, stratum (the one with most of its weight, ties to the smallest, null last), weight. nodes: node, stratum, weight."""
    j = nodes.select(node, stratum, weight).join(components.select(node, "component"), node)
    by = j.groupBy("component", stratum).agg(F.sum(weight).alias("w"))
    return by.groupBy("component").agg(F.min_by(stratum, _heaviest(stratum)).alias("stratum"), F.sum("w").alias("weight"))


def _heaviest(stratum: str) -> Column:
    """Order of the strata of a component by their weight ``w``, ties to the smallest, null last."""
    return F.struct(-F.col("w"), F.col(stratum).isNull().alias("none"), F.col(stratum))


def assign(components: DataFrame, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """component, stratum, weight, split, and what other columns there are. components: component, stratum, weight (0 or more).

    In each stratum, components of more than a LARGE-th of its weight go one by one, largest first, to the split that lacks
    most of its target (ties to the first split); there are fewer than LARGE of them. All
    others stand in a seeded order on the line of what the splits still lack, and each goes to the split that its middle falls
    into. So a split misses its target by at most half of the largest small component at each of its two borders, as long as
    no large component is larger than what every split lacks; what is overfilled is taken from the others in proportion."""
    total = sum(shares.values())
    if not shares or total <= 0 or min(shares.values()) < 0:
        raise ValueError("shares must be 0 or more, and not all 0")
    names, part = list(shares), [s / total for s in shares.values()]
    h = F.xxhash64(F.lit(seed), F.col("component").cast("string"))
    more = [x for x in components.columns if x not in ("component", "stratum", "weight")]
    c = stored(components.select("component", *more, "stratum", F.col("weight").cast("double").alias("weight"), h.alias("h"), F.pmod(h, F.lit(BUCKETS)).alias("b")), "split-components")
    sizes = c.groupBy("stratum").agg(F.sum("weight").alias("all"))
    c = c.join(F.broadcast(sizes) if sizes.limit(100_001).count() <= 100_000 else sizes, c["stratum"].eqNullSafe(sizes["stratum"])).drop(sizes["stratum"])
    big = F.col("weight") * LARGE > F.col("all")

    # large ones: at most LARGE a stratum come together
    rows = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "h", "component", *more)))
    given = F.struct(F.array(*[F.lit(0.0) for _ in names]).alias("filled"), F.expr("cast(array() as array<int>)").alias("to"))

    def step(acc, r):
        lack = lambda k: F.lit(None).cast("double") if not part[k] else F.col("all") * part[k] - acc["filled"][k]
        best = F.array_position(F.array(*map(lack, range(len(names)))), F.greatest(*map(lack, range(len(names))), F.lit(float("-inf")))).cast("int") - 1
        filled = F.transform(acc["filled"], lambda x, i: F.when(i == best, x - r["w"]).otherwise(x))
        return F.struct(filled.alias("filled"), F.array_append(acc["to"], best).alias("to"))

    large = c.where(big).groupBy("stratum", "all").agg(rows.alias("rows")).withColumn("done", F.aggregate("rows", given, step))
    large = stored(large, "split-large")
    placed = large.select("stratum", F.explode(F.arrays_zip(F.col("rows"), F.col("done.to").alias("to"))).alias("x")).select("x.rows.component", *[f"x.rows.{k}" for k in more], "stratum", (-F.col("x.rows.w")).alias("weight"), F.col("x.to").alias("at"))

    # borders of what is left to fill, in parts of the small components' weight
    small = c.where(~big)
    filled = [F.coalesce(F.element_at("done.filled", k + 1), F.lit(0.0)) for k in range(len(names))]
    s = small.groupBy("stratum", "all").agg(F.sum("weight").alias("rest")).join(large.select(F.col("stratum").alias("ls"), "done"), F.col("stratum").eqNullSafe(F.col("ls")), "left")
    lack = [F.greatest(F.col("all") * part[k] - filled[k], F.lit(0.0)) for k in range(len(names))]
    s = s.select("stratum", "rest", F.array(*lack).alias("lack")).withColumn("sum", F.aggregate("lack", F.lit(0.0), lambda a, x: a + x))
    even = F.array(*[F.lit(p) for p in part])
    s = s.select(F.col("stratum").alias("st"), F.when(F.col("sum") > 0, F.transform("lack", lambda x: x / F.col("sum") * F.col("rest"))).otherwise(F.transform(even, lambda x: x * F.col("rest"))).alias("want"))

    # places on the line, bucket by bucket of the seeded order: no window holds a whole stratum
    per = small.groupBy("stratum", "b").agg(F.sum("weight").alias("bw"))
    before = per.withColumn("base", F.sum("bw").over(Window.partitionBy("stratum").orderBy("b")) - F.col("bw")).select(F.col("stratum").alias("bs"), F.col("b").alias("bb"), "base")
    inside = Window.partitionBy("stratum", "b").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = small.withColumn("upto", F.sum("weight").over(inside)).join(before, F.col("stratum").eqNullSafe(F.col("bs")) & (F.col("b") == F.col("bb")))
    line = line.join(F.broadcast(s) if s.limit(100_001).count() <= 100_000 else s, F.col("stratum").eqNullSafe(F.col("st")))
    middle = F.col("base") + F.col("upto") - F.col("weight") / 2
    ends = [F.aggregate(F.slice("want", 1, k + 1), F.lit(0.0), lambda a, x: a + x) for k in range(len(names))]
    last = max(k for k, p in enumerate(part) if p)
    at = F.coalesce(*[F.when((middle < ends[k]) & (F.get("want", F.lit(k)) > 0), k) for k in range(len(names))], F.lit(last))
    out = placed.unionByName(line.select("component", *more, "stratum", "weight", at.alias("at")))
    return out.select("component", *more, "stratum", "weight", F.get(F.array(*map(F.lit, names)), F.col("at")).alias("split"))


def manifest(rows: DataFrame, edges: DataFrame, shares: dict[str, float], *, row="row_id", stratum="stratum", weight: str | None = None, seed: int = 0, name: Callable[[Column], Column] | None = None) -> DataFrame:
    """rows with component and split: what edges (from_id, to_id) tie together is never split. A component is called by the
    smallest name(id) of all ids in it (the smallest id without ``name``), so ids can be numbers, which are compared and
    shuffled at less cost than their names."""
    from .lineage import labelled

    found = labelled(edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")), rows.select(F.col(row).alias("node")))
    w = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    # ids without a row take part in names only
    j = found.where("node is not null").select(F.col("node").alias("_n"), F.col("component").alias("_c"), F.col("given").alias("_g")).join(rows, F.col("_n") == F.col(row), "left")
    j = stored(j, "split-lineage")
    by = j.groupBy("_c", stratum).agg(F.sum(F.when(F.col("_g"), w)).alias("w"), F.min("_c" if name is None else name(F.col("_n"))).alias("component"))
    order = F.when(F.col("w").isNotNull(), _heaviest(stratum))
    parts = by.groupBy("_c").agg(F.min("component").alias("component"), F.min_by(stratum, order).alias("stratum"), F.sum("w").alias("weight")).where("weight is not null")
    dealt = assign(parts, shares, seed).select("_c", "component", "split")
    return j.where(F.col("_n") == F.col(row)).join(dealt, "_c").select(*rows.columns, "component", "split")
