"""Picks from laid-out pages and tables: headers, the number in a label's row, prose blocks, headers under column spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import tasks_for

# How far a number may be from its label's line and its header, and how much text makes prose.
LINE, REACH, PROSE, EXCERPT = 6, 95, 35, 200
NUMBER = r"^\(?\d[\d,.]*\)?$"


def _on_side(x: Column, share: float) -> Column:
    """Is ``x`` on the requested side of the given share of the page's width?"""
    return F.when(F.col("side") == "left", x < F.col("width") * share).otherwise(x > F.col("width") * share)


def headers(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (request_id, page_id, needle, side, width) with ``header_x``, the place of the first line (page_id, ord, x0,
    text) on that side that holds the needle, or null."""
    n = tasks_for(requests, lines)
    hit = requests.repartition(n, "page_id").join(lines.repartition(n, "page_id").hint("merge"), "page_id").where(F.col("text").contains(F.col("needle")) & _on_side(F.col("x0"), 0.6))
    found = hit.select("request_id", "ord", "x0").repartition(n, "request_id").groupBy("request_id").agg(F.min_by("x0", F.struct("ord", "x0")).alias("header_x"))
    return requests.repartition(n, "request_id").join(found.hint("merge"), "request_id", "left")


def row_values(words: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (request_id, page_id, label, side, width, header_x) with the number that stands in the line of a word with the
    label, nearest to the header: ``label_text``, ``value_text``, ``distance``; null if there is none. words: page_id, ord,
    x0, y0, text. Of equal distances the first label's first number is taken. Lines are compared by bins of height, so a
    page's words never meet all others. Tasks are as many as the words ask for."""
    n = tasks_for(requests.select("request_id"), words)
    w = words.select("page_id", "ord", "x0", "y0", "text")
    bin_ = F.floor(F.col("y0") / LINE)
    asked = requests.where(F.col("header_x").isNotNull()).select("request_id", "page_id", "label", "side", "width", "header_x").repartition(n, "page_id")
    at = asked.join(w.repartition(n, "page_id").hint("merge"), "page_id").where(F.col("text").contains(F.col("label")) & _on_side(F.col("x0"), 0.5))
    at = at.select("request_id", "page_id", "header_x", F.col("ord").alias("_lo"), F.col("y0").alias("_ly"), F.col("text").alias("label_text"), F.explode(F.array(bin_ - 1, bin_, bin_ + 1)).alias("_b"))
    numbers = w.where(F.col("text").rlike(NUMBER)).withColumn("_b", bin_)
    distance = F.abs(F.col("x0") - F.col("header_x"))
    j = at.repartition(n, "page_id", "_b").join(numbers.repartition(n, "page_id", "_b").hint("merge"), ["page_id", "_b"]).where((F.abs(F.col("y0") - F.col("_ly")) < LINE) & (distance < REACH))
    near = j.select("request_id", F.struct(distance.alias("distance"), "_lo", "ord", "label_text", F.col("text").alias("value_text")).alias("_m"))
    best = near.repartition(n, "request_id").groupBy("request_id").agg(F.min("_m").alias("_m"))
    return requests.repartition(n, "request_id").join(best.hint("merge"), "request_id", "left").select(*requests.columns, "_m.label_text", "_m.value_text", F.col("_m.distance").alias("distance"))


def prose_blocks(blocks: DataFrame, preferred: DataFrame) -> DataFrame:
    """For every document of ``preferred`` (doc_id, page from 0) its first text block with prose, the preferred page before
    the others: ``page`` from 1, ``excerpt``, ``bbox``; ``error`` if there is none. blocks: doc_id, page, ord, is_text,
    text, bbox."""
    x = F.trim(F.regexp_replace("text", r"\s+", " "))
    prose = blocks.where(F.col("is_text") & (F.length(x) >= PROSE) & F.col("text").contains("."))
    j = prose.join(preferred.select("doc_id", F.col("page").alias("_wanted")), "doc_id")
    first = j.groupBy("doc_id").agg(F.min_by(F.struct((F.col("page") + 1).alias("page"), F.substring("text", 1, EXCERPT).alias("excerpt"), "bbox"), F.struct(F.col("page") != F.col("_wanted"), "page", "ord")).alias("_f"))
    return preferred.select("doc_id").join(first, "doc_id", "left").select("doc_id", "_f.page", "_f.excerpt", "_f.bbox", F.when(F.col("_f").isNull(), "no_prose_block").alias("error"))


def refined_headers(facts: DataFrame, cells: DataFrame) -> DataFrame:
    """facts (claim_id, doc_id, table_xpath, balance_or_flow, table_col_index) with the pointers of the headers that stand over
    the fact's own column. A flow's period header is the cell of the first row whose columns cover the index, and its year
    stands in the third row; a balance has both at the index in the first row. cells: doc_id, table_xpath, row, ord (both
    from 0), colspan, pointer. Only header rows are gathered, one value per table."""
    rows = cells.where(F.col("row").isin(0, 2)).groupBy("doc_id", "table_xpath").agg(F.array_sort(F.collect_list(F.struct("row", "ord", F.coalesce("colspan", F.lit(1)).alias("span"), "pointer"))).alias("_h"))
    j = facts.join(rows, ["doc_id", "table_xpath"], "left")
    i, flow = F.col("table_col_index"), F.col("balance_or_flow") == "flow"
    of = lambda n: F.filter("_h", lambda c: c["row"] == n)
    placed = F.aggregate(
        of(0), F.struct(F.lit(0).cast("long").alias("end"), F.lit(None).cast("string").alias("pointer")),
        lambda a, c: F.struct((a["end"] + c["span"]).cast("long").alias("end"), F.when((a["end"] <= i) & (i < a["end"] + c["span"]), c["pointer"]).otherwise(a["pointer"]).alias("pointer")),
    )
    at = lambda n: F.get(F.filter(of(n), lambda c: c["ord"] == i), F.lit(0))["pointer"]
    period, year = F.when(flow, placed["pointer"]).otherwise(at(0)), F.when(flow, at(2)).otherwise(at(0))
    return j.select(*facts.columns, period.alias("period_header_pointer"), year.alias("year_header_pointer"), F.when(period.isNull() | year.isNull(), "header_not_found").alias("error"))


def boundary_findings(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """Blocks at the edge of a page's body that a person should look at: (key, seq, kind, node_path, chars, action). blocks: the
    layout of ``markup.blocks``. The body is the page's article, else its main part, else all of it. Long text that was left
    out of the body, or stands outside it, is a finding; metadata and widgets are named as such."""
    part = lambda tag: F.col("node_path").contains(f"/{tag}[")
    has = blocks.groupBy(key).agg(F.max(part("article")).alias("_a"), F.max(part("main")).alias("_m"))
    j = blocks.join(has, key)
    inside = F.when(F.col("_a"), part("article")).when(F.col("_m"), part("main")).otherwise(True)
    n, gone = F.length("normalized_text"), F.col("omitted").isNotNull()
    # Kinds, actions and the lengths from which text counts.
    kind = F.when(gone & ~F.col("omitted").startswith("element:") & (n >= 80) & F.col("block_type").isin("paragraph", "cell", "list_item"), "omitted_region_contains_substantive_structure").when(
        ~gone & ~inside & (n >= 30),
        F.when(F.col("block_type") == "title", "title_metadata_preserved").when(F.col("role") == "header", "header_metadata_candidate").when(F.col("role").isin("navigation", "footer", "aside"), "widget_or_byline_boundary_candidate").otherwise("outside_substantive_text_review"),
    )
    action = F.when(F.col("kind") == "omitted_region_contains_substantive_structure", "inspect_excluded_related_or_attachment_region_locally").when(F.col("kind") == "outside_substantive_text_review", "review_as_missing_body_candidate").otherwise("keep_separate_from_body_or_widget")
    return j.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(key, "seq", "kind", "node_path", n.alias("chars"), action.alias("action"))
