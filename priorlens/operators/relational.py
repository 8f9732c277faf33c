"""Windows, grids and reconciliations that recur: latest rows, first copies, differences of cumulative values, funnels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import within


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], cutoff: tuple[str, object] | None = None) -> DataFrame:
    """The last row of each key by an order, at or before a cutoff: an aggregate, which combines before it shuffles."""
    d = df if cutoff is None else df.where(F.col(cutoff[0]) <= F.lit(cutoff[1]))
    rest = [c for c in df.columns if c not in keys]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def first_copies(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds dedup_status: ``first`` for exactly one row of equal keys, the first by ``order`` (among equals by the other
    columns, and among equal rows any one), ``duplicate`` for the rest. The least row of a key is found by an aggregate and
    joined; only rows that tie with it are numbered."""
    row = F.struct(*order, F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), 256).alias("_digest"))
    d = df.withColumn("_row", row)
    low = d.groupBy(*keys).agg(F.min("_row").alias("_lo"))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    j = d.alias("l").join(low.alias("r"), on).select("l.*", "_lo")
    same = j.where(F.col("_row") == F.col("_lo")).withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_row").orderBy(F.lit(0))))
    first = same.withColumn("dedup_status", F.when(F.col("_n") == 1, "first").otherwise("duplicate")).drop("_n", "_row", "_lo")
    rest = j.where(F.col("_row") != F.col("_lo")).withColumn("dedup_status", F.lit("duplicate")).drop("_row", "_lo")
    return first.unionByName(rest)


def alias_groups(df: DataFrame, group: Column, member: str, size: int = 2) -> DataFrame:
    """Groups that at least ``size`` distinct members share."""
    return df.groupBy(group.alias("alias")).agg(F.count_distinct(member).alias("members"), F.min(member).alias("first_member")).where(F.col("members") >= size)


def from_cumulative(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str = "period_value") -> DataFrame:
    """The difference to the value before within the keys (which hold the year, so it resets there)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def reconciled(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, tolerance: Column) -> DataFrame:
    """Full outer pairing of two tables with the difference and its status."""
    j = left.select(*keys, F.col(a).alias("left_value")).join(right.select(*keys, F.col(b).alias("right_value")), list(keys), "full_outer")
    return j.withColumn("difference", F.col("left_value") - F.col("right_value")).withColumn("status", within(F.col("left_value"), F.col("right_value"), tolerance))


def coverage(rows: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A dense grid with the number of rows in each cell and its status; the grid is the caller's, and small."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    return grid.join(n, list(keys), "left").fillna(0, ["found"]).withColumn("status", F.when(F.col("found") == 0, "missing").when(F.col("found") == 1, "covered").otherwise("several"))


def funnel(df: DataFrame, key: str, stages: Mapping[str, Column]) -> DataFrame:
    """Distinct keys that reach each stage; a stage counts only what reached those before it."""
    reached, out, names = F.lit(True), [], list(stages)
    for k in names:
        reached = reached & F.coalesce(stages[k], F.lit(False))
        out.append(F.count_distinct(F.when(reached, F.col(key))).alias(k))
    one = df.agg(*out)
    cells = ", ".join(f"{i}, '{k}', `{k}`" for i, k in enumerate(names, 1))
    return one.select(F.expr(f"stack({len(names)}, {cells}) as (step, stage, n)"))


def unpivoted(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "field", value: str = "value") -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(list(keys), list(columns), name, value)


def nearest(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """For each left row the right row of its key that lies nearest, ties to the smaller place."""
    r = right.select(key, F.struct(*right.columns).alias("nearest"), F.col(b).alias("_b"))
    j = left.withColumn("_row", F.struct(*left.columns)).join(r, key, "left")
    # rows of a key stay where the join has them: grouping by the row alone would shuffle every pair
    return j.groupBy(key, "_row").agg(F.min_by("nearest", F.struct(F.abs(F.col(a) - F.col("_b")), F.col("_b"))).alias("nearest")).select("_row.*", "nearest")


def column_spans(cells: DataFrame, keys: Sequence[str], order: str, span: str = "colspan") -> DataFrame:
    """Start and end columns of cells whose spans add up along a row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(span).over(w), F.lit(0))
    return cells.withColumn("col_start", start).withColumn("col_end", start + F.col(span))


def top_scored(df: DataFrame, keys: Sequence[str], score: Column, tie: str) -> DataFrame:
    """The best row of each key by score, ties to the smaller tie column."""
    rest = [c for c in df.columns if c not in keys]
    d = df.withColumn("_s", score)
    return d.groupBy(*keys).agg(F.min_by(F.struct(*rest, F.col("_s").alias("score")), F.struct(-F.col("_s"), F.col(tie))).alias("_r")).select(*keys, "_r.*")


def asof_prior(events: DataFrame, keys: Sequence[str], time: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """Each row with the last row of its key at a strictly earlier time: columns under ``prior_``, and how many rows share
    that earlier time. A window over the distinct times of a key; rows of one time get the same prior."""
    at = events.groupBy(*keys, time).agg(F.max_by(F.struct(*columns, tie), F.col(tie)).alias("_last"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(time)
    prior = at.select(*keys, time, F.lag("_last").over(w).alias("_p"), F.lag(time).over(w).alias(f"prior_{time}"), F.lag("_n").over(w).alias("prior_candidates"))
    return events.join(prior, [*keys, time]).select(*events.columns, f"prior_{time}", "prior_candidates", *[F.col(f"_p.{c}").alias(f"prior_{c}") for c in columns if c != tie], F.col(f"_p.{tie}").alias(f"prior_{tie}"))


def crosswalk(left: DataFrame, direct: DataFrame, related: DataFrame, key: str, value: str) -> DataFrame:
    """``value`` from the direct table, else from the related one, else null, and which of them it is from (``basis``)."""
    d = direct.select(key, F.col(value).alias("_direct")).dropDuplicates([key])
    r = related.select(key, F.col(value).alias("_related")).dropDuplicates([key])
    j = left.join(d, key, "left").join(r, key, "left")
    return j.withColumn(value, F.coalesce("_direct", "_related")).withColumn("basis", F.when(F.col("_direct").isNotNull(), "direct").when(F.col("_related").isNotNull(), "related").otherwise("none")).drop("_direct", "_related")


def unique_anchor(left: DataFrame, right: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """The one row of ``right`` that shares the keys, as ``target``: null if there is none or more than one; ``anchors`` counts."""
    by = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("anchors"), F.min(target).alias("_t"))
    return left.join(by, list(keys), "left").withColumn("anchors", F.coalesce("anchors", F.lit(0))).withColumn(target, F.when(F.col("anchors") == 1, F.col("_t"))).drop("_t")


def star(centre: DataFrame, key: str, arms: Mapping[str, DataFrame]) -> DataFrame:
    """Left joins of a document index with its arms: each arm's columns as a struct under its name, and ``has`` (array of the
    arms that have the document). An arm must have the key once; rows that repeat it are refused."""
    out = centre
    for name, arm in arms.items():
        rest = [c for c in arm.columns if c != key]
        one = arm.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias(name))
        one = one.select(key, F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{name}: the key repeats"))).otherwise(F.col(name)).alias(name))
        out = out.join(one, key, "left")
    return out.withColumn("has", F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in arms])))


def leading(df: DataFrame, keys: Sequence[str], order: Sequence[str], eligible: Column, n: int = 2) -> DataFrame:
    """Adds ``lead``: is the row among the first ``n`` eligible ones of its key?"""
    w = Window.partitionBy(*keys, "_e").orderBy(*order)
    d = df.withColumn("_e", F.coalesce(eligible, F.lit(False)))
    return d.withColumn("lead", F.col("_e") & (F.row_number().over(w) <= n)).drop("_e")


def attempts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``attempt``: the how-many-eth of its key the row is."""
    return df.withColumn("attempt", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def overlapping(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Adds ``overlap``: does the span begin before the furthest end of those before it in its key?"""
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("overlap", F.coalesce(F.col(start) < F.max(end).over(w), F.lit(False)))


def rollup_families(df: DataFrame, family: str, doc: str, company: str, date: str) -> DataFrame:
    """Per event family: documents, companies, first and last date, and whether it spans several companies."""
    by = df.groupBy(family).agg(F.count_distinct(doc).alias("documents"), F.count_distinct(company).alias("companies"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))
    return by.withColumn("cross_company", F.col("companies") > 1)


def most_common(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Counts of a column's values in falling order, ties by value, with the place of each."""
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    out = n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), column)))  # a row per distinct value
    return out if limit is None else out.where(F.col("place") <= limit)


def capped(errors: Column, limit: int = 100) -> Column:
    """The first errors of a list, as reports show them."""
    return F.slice(errors, 1, limit)


def regression(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Two results of one table by key: missing on a side, and the fields in which they differ; rows that agree have none."""
    o, n = old.select(key, F.struct(*fields).alias("_o")), new.select(key, F.struct(*fields).alias("_n"))
    j = o.join(n, key, "full_outer")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"_o.{f}").eqNullSafe(F.col(f"_n.{f}")), F.lit(f)) for f in fields]))
    none = F.expr("cast(array() as array<string>)")
    status = F.when(F.col("_o").isNull(), "only_new").when(F.col("_n").isNull(), "only_old").when(F.size(differs) > 0, "differs").otherwise("same")
    return j.select(key, status.alias("status"), F.when(F.col("_o").isNull() | F.col("_n").isNull(), none).otherwise(differs).alias("fields"))
