"""Facts out of statement tables: by caption, row and column, or from the best scored table of a document."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.reasons import first

# Fixed value: a printed amount in a cell.
AMOUNT = r"\(?\$?-?\d[\d,]*(?:\.\d+)?\)?"


@dataclass(frozen=True)
class Wanted:
    """A fact to look for: the table's caption, the row's label, the column, and what it stands for."""

    caption: str
    label: str
    col: int
    metric_id: str
    #: quarter (the last of the year), year or instant
    period: str
    scope_id: str
    sign_policy: str = "preserve"


def statement_facts(docs: DataFrame, tables: DataFrame, cells: DataFrame, wanted: Sequence[Wanted], *, year_end: tuple[int, int] = (6, 30), scale: str = "1000000") -> DataFrame:
    """One row per document and wanted fact: the value at its place with its period, or the first ``error``. docs: doc_id,
    fiscal_year; tables: doc_id, table_id, caption; cells: doc_id, table_id, row, col, text, pointer. A caption or a label
    that a document has twice is ambiguous. The wanted facts are a short list, so they unfold each document; the cells are
    reduced to label and amount before they meet it."""
    rules = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in w.__dict__.items()]) for w in wanted])
    asked = docs.select("doc_id", "fiscal_year", F.inline(rules))
    named = tables.where(F.col("caption").isin(sorted({w.caption for w in wanted}))).groupBy("doc_id", "caption").agg(F.count(F.lit(1)).alias("_tables"), F.min("table_id").alias("table_id"))
    rows = cells.where(F.col("col") == 0).withColumn("label", text.compact(F.col("text"))).where(F.col("label").isin(sorted({w.label for w in wanted})))
    rows = rows.groupBy("doc_id", "table_id", "label").agg(F.count(F.lit(1)).alias("_rows"), F.min("row").alias("row"))
    places = cells.where(F.col("col").isin(sorted({w.col for w in wanted}))).groupBy("doc_id", "table_id", "row", "col").agg(F.min(F.struct("text", "pointer")).alias("_c"))
    j = asked.join(named, ["doc_id", "caption"], "left").join(rows, ["doc_id", "table_id", "label"], "left").join(places, ["doc_id", "table_id", "row", "col"], "left")
    x = F.col("_c.text")
    raw = F.nullif(F.regexp_extract(x, AMOUNT, 0), F.lit(""))
    start = F.length(F.regexp_extract(x, f"(?s)^(.*?){AMOUNT}", 1))
    number = F.replace(F.translate(raw, "$,)", ""), F.lit("("), F.lit("-")).try_cast("decimal(24,6)")
    outflow = F.col("sign_policy") == "outflow_to_positive"
    signed = F.when(outflow, -number).otherwise(number)
    end = F.make_date(F.col("fiscal_year"), F.lit(year_end[0]), F.lit(year_end[1]))
    instant = F.col("period") == "instant"
    begin = F.when(instant, end).otherwise(F.trunc(F.add_months(end, F.when(F.col("period") == "quarter", -2).otherwise(-11)), "MM"))
    error = first((F.col("_tables").isNull(), "table_not_found"), (F.col("_tables") > 1, "table_ambiguous"), (F.col("_rows").isNull(), "row_not_found"), (F.col("_rows") > 1, "row_ambiguous"), (F.col("_c").isNull(), "cell_not_found"), (number.isNull(), "no_number"), (outflow & (number >= 0), "outflow_not_negative"))
    j = j.withColumn("error", error)
    good = lambda c: F.when(F.col("error").isNull(), c)
    return j.select(
        "doc_id", "metric_id", "scope_id", "period", good(F.col("table_id")).alias("table_id"), good(F.col("row")).alias("row"), "col", good(F.col("_c.pointer")).alias("evidence_pointer"), good(raw).alias("value_raw"), good(start).alias("value_span_start"), good(start + F.length(raw)).alias("value_span_end"),
        good(signed).alias("numeric_value"), good(signed.cast("decimal(24,6)") * F.lit(scale).cast("decimal(14,4)")).alias("numeric_value_base_units"), good(begin).alias("period_start"), good(end).alias("period_end"), good(F.when(instant, 0).otherwise(F.datediff(end, begin) + 1)).alias("period_duration_days"), F.when(instant, "balance").otherwise("flow").alias("balance_or_flow"), "error",
    )


def best_table(tables: DataFrame, cells: DataFrame, *, required: Sequence[str], weights: Mapping[str, int], header: str, not_header: str, label: str, unit: str) -> DataFrame:
    """Per document the value of its best scored table: (doc_id, table_id, score, header, label, value_raw, unit). tables: doc_id,
    table_id, ord, text, context (the captions before it, nearest first); cells: doc_id, table_id, row, col, text. A table
    counts if its text has all required words, its first row has the header (and not the other word), a later row's first
    cell matches the label's pattern, both meet in a cell, and a caption matches the unit's pattern. The score sums the
    weights of the words it has, less a thousandth of its place; documents without such a table have no row."""
    score = sum((F.when(F.col("text").contains(w), n).otherwise(0) for w, n in weights.items()), F.lit(0)).cast("decimal(18,3)") - (F.col("ord") / F.lit(1000)).cast("decimal(18,3)")
    units = F.get(F.filter("context", lambda c: c.rlike(unit)), F.lit(0))
    ok = tables.where(sum((F.col("text").contains(w).cast("int") for w in required), F.lit(0)) == len(required)).select("doc_id", "table_id", "ord", score.alias("score"), units.alias("unit")).where(F.col("unit").isNotNull())
    key = ["doc_id", "table_id"]
    x = F.col("text")
    is_head, is_label = (F.col("row") == 0) & x.contains(header) & ~x.contains(not_header), (F.col("row") > 0) & (F.col("col") == 0) & x.rlike(label)
    spots = cells.where(is_head | is_label).groupBy(*key).agg(F.min(F.when(is_head, F.struct("col", "text"))).alias("_h"), F.min(F.when(is_label, F.struct("row", "text"))).alias("_l"))
    j = ok.join(spots.where(F.col("_h").isNotNull() & F.col("_l").isNotNull()), key).withColumn("row", F.col("_l.row")).withColumn("col", F.col("_h.col"))
    v = j.join(cells.select(*key, "row", "col", F.col("text").alias("value_raw")), [*key, "row", "col"])
    best = v.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("ord")).alias("_o"), "table_id", F.col("_h.text").alias("header"), F.col("_l.text").alias("label"), "value_raw", "unit")).alias("_b"))
    return best.select("doc_id", "_b.table_id", "_b.score", "_b.header", "_b.label", "_b.value_raw", "_b.unit")
