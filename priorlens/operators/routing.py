"""One scan for several consumers, and facts confirmed by a second document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many keys of a consumer are broadcast; beyond, the join shuffles.
MAX_BROADCAST_KEYS = 1_000_000


def routed(rows: DataFrame, consumers: dict[str, tuple[dict[str, str], DataFrame]]) -> DataFrame:
    """rows with ``consumer``: once for every consumer that asks for them. consumers: name -> ({column of its table: SQL
    expression over the row}, table). The rows are read once: each consumer's distinct keys mark the rows it wants, by
    broadcast up to a checked number, and marked rows are given out once a mark. Null keys match nothing."""
    df, marks = rows, []
    for i, (name, (on, keys)) in enumerate(consumers.items()):
        one = keys.select(*[F.col(c).alias(f"_k{i}_{j}") for j, c in enumerate(on)]).distinct().withColumn(f"_m{i}", F.lit(name))
        # a count of at most one more than the bound decides, not of the whole table
        small = one.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS
        df = df.withColumns({f"_l{i}_{j}": F.expr(e) for j, e in enumerate(on.values())})
        match = [F.col(f"_l{i}_{j}") == F.col(f"_k{i}_{j}") for j in range(len(on))]
        df = df.join(F.broadcast(one) if small else one, match, "left")
        marks.append(F.col(f"_m{i}"))
    return df.select(*rows.columns, F.explode(F.array_compact(F.array(*marks))).alias("consumer"))


def corroborated(facts: DataFrame, identity: list[str], value: str, doc: str = "doc_id") -> DataFrame:
    """facts with ``others`` (other documents that have a fact of the same identity), ``agreeing`` (those of them with the same
    value) and ``corroboration``: none, one or several documents agree, ``conflict`` if one document states one other value
    only and none agrees, ``ambiguous`` if the fact's own document, or all others, state more than one value for the identity.

    Documents are counted once however often they repeat a fact: what meets by identity are a document's set of values, and
    only totals for each (identity, value) and identity, so an identity that all documents share makes no pairs. Null parts of
    an identity are equal; a null value is a value."""
    # structs are equal where both have null, and take less of a shuffle than digests, which don't compress
    k, v = F.struct(*identity), F.struct(F.col(value).alias("v"))
    f = facts.withColumns({"_k": k, "_v": v})
    by_doc = f.groupBy("_k", doc).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # a document with several values for an identity supports none of them
    clear = by_doc.where(F.col("_lo") == F.col("_hi"))
    with_value = clear.groupBy("_k", F.col("_lo").alias("_v")).agg(F.count(F.lit(1)).alias("_same"))
    every = by_doc.groupBy("_k").agg(F.count(F.lit(1)).alias("_docs"), F.count_if(F.col("_lo") == F.col("_hi")).alias("_clear"), F.count_if(F.col("_lo") != F.col("_hi")).alias("_unclear"))
    own = by_doc.select("_k", F.col(doc).alias("_doc"), (F.col("_lo") != F.col("_hi")).alias("_several"))
    j = f.join(every, "_k").join(own, (f["_k"] == own["_k"]) & f[doc].eqNullSafe(own["_doc"])).drop(own["_k"]).join(with_value, ["_k", "_v"], "left")
    mine = (~F.col("_several")).cast("long")
    same = F.coalesce("_same", F.lit(0))
    j = j.withColumns({"others": F.col("_docs") - 1, "agreeing": same - mine, "_differing": F.col("_clear") - same})
    kinds = with_value.groupBy("_k").agg(F.count(F.lit(1)).alias("_values"))
    j = j.join(kinds, "_k", "left")
    other_values = F.coalesce("_values", F.lit(0)) - (same > 0).cast("long")
    verdict = (
        F.when(F.col("_several"), "ambiguous").when(F.col("agreeing") > 1, "several").when(F.col("agreeing") == 1, "one").when(F.col("others") == 0, "none")
        .when((other_values > 1) | (F.col("_unclear") > 0), "ambiguous").when(other_values == 1, "conflict").otherwise("none")
    )
    return j.select(*facts.columns, "others", "agreeing", verdict.alias("corroboration"))
