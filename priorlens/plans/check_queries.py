"""Cross-checks, recomputation, splits, routing and text alignment over the driver's tables, each beside its twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks
from ..operators import recheck, rights, routing, splits
from ..operators.rulebook import Elements, Lookup, Rule, Rulebook
from .queries import _t
from .record_queries import query

#: Orders held against their lines, customers, parts and suppliers: rules as rows of a registry table.
ORDER_BOOK = Rulebook(
    rules=[
        Rule("unknown_customer", "customer.n = 1", stops=True),
        Rule("overdrawn_customer", "customer.c_acctbal >= 0"),
        Rule("no_lines", "size(lines) > 0", stops=True),
        Rule("total_below_lines", "o_totalprice >= {lines_total}"),
        Rule("urgent_order_waits", "exists(lines, x -> x.shipdate < o_orderdate + interval 60 days)", "o_orderpriority = '1-URGENT'"),
        Rule("part_twice", "size(array_distinct({part_keys})) = size(lines)"),
        Rule("one_brand", "size(array_distinct(brands)) = size(brands)", "size(lines) > 1"),
        Rule("unknown_part", "part.n = 1", part="e"),
        Rule("shipped_before_order", "e.shipdate > o_orderdate", part="e"),
        Rule("price_below_retail", "e.price >= part.p_retailprice * e.quantity", part="e"),
        Rule("supplier_in_debt", "supplier.s_acctbal >= 0", part="e"),
        Rule("domestic_supplier", "supplier.s_nationkey <> buyer.c_nationkey", "buyer.c_mktsegment = 'MACHINERY'", part="e"),
    ],
    lookups=[
        Lookup("part", "part", {"p_partkey": "e.partkey"}, "e"), Lookup("supplier", "supplier", {"s_suppkey": "e.suppkey"}, "e"), Lookup("buyer", "customer", {"c_custkey": "o_custkey"}, "e"),
        Lookup("customer", "customer", {"c_custkey": "o_custkey"}),
    ],
    values={"part_keys": "transform(lines, x -> x.partkey)", "lines_total": "aggregate(lines, cast(0 as double), (a, x) -> a + x.price)"},
    elements=[Elements("e", "lines", {"brands": "part.p_brand"})],
)


def _with_lines(orders: DataFrame, lines: DataFrame) -> DataFrame:
    line = F.struct(F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("shipdate"))
    # rows are dealt as they are, which are smaller than half-filled arrays
    lines = lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").repartition("l_orderkey")
    lines = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


@query("""
with l as (
  select o_orderkey as k, l_partkey, l_extendedprice, p_brand, l_shipdate < o_orderdate + interval 60 day as soon, p_partkey is null as b1, not (l_shipdate > o_orderdate) as b2,
    not coalesce(l_extendedprice >= p_retailprice * l_quantity, false) as b3, not coalesce(s_acctbal >= 0, false) as b4, c_mktsegment = 'MACHINERY' and not coalesce(s_nationkey <> c_nationkey, false) as b5
  from orders join lineitem on o_orderkey = l_orderkey left join part on p_partkey = l_partkey left join supplier on s_suppkey = l_suppkey left join customer on c_custkey = o_custkey
), a as (select k, count(*) as n, count(distinct l_partkey) as parts, count(p_brand) as brands, count(distinct p_brand) as distinct_brands, sum(l_extendedprice) as total, bool_or(soon) as soon,
    bool_or(b1) as b1, bool_or(b2) as b2, bool_or(b3) as b3, bool_or(b4) as b4, bool_or(b5) as b5 from l group by k)
select o_orderkey, array_to_string(list_sort(list_filter(case when c_custkey is null then ['unknown_customer'] else [
    case when c_acctbal < 0 then 'overdrawn_customer' end, case when n is null then 'no_lines' end, case when o_totalprice < total then 'total_below_lines' end,
    case when n > 0 and o_orderpriority = '1-URGENT' and not soon then 'urgent_order_waits' end, case when parts < n then 'part_twice' end, case when n > 1 and distinct_brands < brands then 'one_brand' end,
    case when b1 then 'unknown_part' end, case when b2 then 'shipped_before_order' end, case when b3 then 'price_below_retail' end, case when b4 then 'supplier_in_debt' end, case when b5 then 'domestic_supplier' end] end,
  lambda x: x is not null)), '|') as errors
from orders left join customer on c_custkey = o_custkey left join a on k = o_orderkey""")
def order_rulebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order against rules about it and its lines, read from their registry table."""
    book = ORDER_BOOK.with_rules(ORDER_BOOK.table(spark))
    tables = {t: _t(spark, sf_dir, t) for t in ("customer", "part", "supplier")}
    orders = book.looked_up(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"), tables)
    found = book.check(_with_lines(orders, _t(spark, sf_dir, "lineitem")), tables, have=("customer", "buyer"), keep=["o_orderkey"])
    return found.select("o_orderkey", F.concat_ws("|", "errors").alias("errors"))


_LINES = "cast(sum(l_quantity) as bigint) as quantity, count(*) as lines, max(l_returnflag) as last_flag"


@query(f"""
with a as (select l_orderkey, {_LINES} from lineitem group by l_orderkey), b as (select l_orderkey, {_LINES} from lineitem where l_returnflag <> 'R' group by l_orderkey),
j as (select coalesce(a.l_orderkey, b.l_orderkey) as l_orderkey, a.l_orderkey is null as added, b.l_orderkey is null as gone, a.quantity as q1, b.quantity as q2, a.lines as n1, b.lines as n2, a.last_flag as f1, b.last_flag as f2 from a full join b using (l_orderkey)),
c as (select l_orderkey, unnest(case when gone then [{{'c': 'missing', 'k': null, 'o': null, 'n': null}}] when added then [{{'c': 'extra', 'k': null, 'o': null, 'n': null}}]
  else [{{'c': 'changed', 'k': 'quantity', 'o': cast(q1 as varchar), 'n': cast(q2 as varchar)}}, {{'c': 'changed', 'k': 'lines', 'o': cast(n1 as varchar), 'n': cast(n2 as varchar)}}, {{'c': 'changed', 'k': 'last_flag', 'o': f1, 'n': f2}}] end) as x from j)
select l_orderkey, x.c as change, x.k as "column", x.o as old, x.n as new from c where x.c <> 'changed' or x.o is distinct from x.n""")
def order_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders summed up from all lines, against the sums without returned lines: cell by cell, found by digests."""
    lines = _t(spark, sf_dir, "lineitem")
    added = [F.sum("l_quantity").cast("long").alias("quantity"), F.count(F.lit(1)).alias("lines"), F.max("l_returnflag").alias("last_flag")]
    a, b = (x.groupBy("l_orderkey").agg(*added) for x in (lines, lines.where("l_returnflag <> 'R'")))
    return recheck.compare(a, b, ["l_orderkey"]).drop("place")


@query("""
with f as (select l_orderkey as doc, l_linenumber, l_partkey as p, l_returnflag as r, l_tax as v from lineitem),
d as (select p, r, doc, min(v) as lo, max(v) as hi from f group by all),
c as (select p, r, list({'doc': doc, 'v': lo, 'clear': lo = hi}) as docs from d group by all),
j as (select f.doc, l_linenumber, d.lo < d.hi as several, list_filter(c.docs, lambda x: x.doc <> f.doc) as others, f.v from f join d using (p, r, doc) join c using (p, r)),
k as (select *, len(others) as n, len(list_filter(others, lambda x: x.clear and x.v = j.v)) as same, len(list_distinct(list_transform(list_filter(others, lambda x: x.clear and x.v <> j.v), lambda x: x.v))) as differ, len(list_filter(others, lambda x: not x.clear)) as unclear from j)
select doc as l_orderkey, l_linenumber, cast(n as bigint) as others, cast(same as bigint) as agreeing,
  case when several then 'ambiguous' when same > 1 then 'several' when same = 1 then 'one' when n = 0 then 'none' when differ > 1 or unclear > 0 then 'ambiguous' when differ = 1 then 'conflict' else 'none' end as corroboration from k""")
def corroborated_taxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxes of order lines, confirmed or contradicted by other orders that have the same part under the same flag."""
    lines = _t(spark, sf_dir, "lineitem")
    found = routing.corroborated(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_tax"), ["l_partkey", "l_returnflag"], "l_tax", "l_orderkey")
    return found.select("l_orderkey", "l_linenumber", "others", "agreeing", "corroboration")


@query("""
with r as (
  select *, 'small_parts' as consumer from lineitem where l_partkey in (select p_partkey from part where p_size <= 5)
  union all select *, 'urgent_orders' from lineitem where l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT')
  union all select *, 'home_deliveries' from lineitem l where exists (select 1 from supplier s where s.s_suppkey = l.l_suppkey and s.s_nationkey < 5 and s.s_acctbal > 0))
select consumer, l_returnflag, count(*) as lines, cast(sum(l_quantity) as bigint) as quantity from r group by all""")
def routed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines read once for three consumers with keys of their own."""
    asked = {
        "small_parts": ({"p_partkey": "l_partkey"}, _t(spark, sf_dir, "part").where("p_size <= 5")),
        "urgent_orders": ({"o_orderkey": "l_orderkey"}, _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")),
        "home_deliveries": ({"s_suppkey": "l_suppkey"}, _t(spark, sf_dir, "supplier").where("s_nationkey < 5 and s_acctbal > 0")),
    }
    found = routing.routed(_t(spark, sf_dir, "lineitem"), asked)
    return found.groupBy("consumer", "l_returnflag").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").cast("long").alias("quantity"))


@query()
def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders dealt to three splits: what shares a customer or a part and supplier stays together, priorities are balanced."""
    orders, lines = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    own = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("to_id"))
    ties = orders.join(own, "o_custkey").where("o_orderkey > to_id").select(F.col("o_orderkey").alias("from_id"), "to_id")
    first = lines.groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("to_id"), F.max("l_orderkey").alias("last")).where("to_id < last").drop("last")
    bought = lines.join(first, ["l_partkey", "l_suppkey"]).where("l_orderkey > to_id").select(F.col("l_orderkey").alias("from_id"), "to_id")
    called = lambda k: F.concat(F.lit("o"), k)
    rows = orders.select("o_orderkey", F.col("o_orderpriority").alias("stratum"))
    found = splits.manifest(rows, ties.unionByName(bought), {"train": 0.8, "development": 0.1, "test": 0.1}, row="o_orderkey", name=called)
    return found.select(called(F.col("o_orderkey")).alias("row_id"), "stratum", "component", "split")


@query()
def extraction_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located page bodies against all text of the page outside of tags: what of either the other has."""
    from ..sources import markup

    pages = _t(spark, sf_dir, "pages")
    body = markup.bodies(pages).select("page_id", F.col("body").alias("left"))
    plain = F.regexp_replace(F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</\\1>", " "), "<[^>]*>", " ")
    other = pages.select("page_id", F.regexp_replace(F.trim(plain), r"\s+", " ").alias("right"))
    found = blocks.with_blocks(body.join(other, "page_id"))
    return found.select("page_id", F.size("blocks").cast("long").alias("blocks"), F.col("matched").cast("long").alias("matched"), F.round("left_fraction", 6).alias("left_fraction"), F.round("right_fraction", 6).alias("right_fraction"), F.col("longest_unmatched").cast("long").alias("longest_unmatched"))


@query("""
with u as (select page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:@]*)', 1)) as host, coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]*(/[^?#]*)', 1), ''), '/') as path, url from pages where regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#@]*([/?#]|$)')),
s as (select host, '/' || split_part(path, '/', 2) as prefix, count(*) as n from u group by all),
g as (select distinct host, prefix from s where n > 1 union select host, '/' from s group by host having sum(n) > 2 union select distinct host, path from u where length(path) > 8)
select u.page_id, count(*) as rights, cast(max(length(prefix)) as integer) as longest from u join g on g.host = u.host and starts_with(u.path, g.prefix) group by u.page_id""")
def page_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under a registry of overlapping path prefixes taken from their own addresses: how many rows cover each, and the
    length of the longest prefix."""
    pages = _t(spark, sf_dir, "pages")
    p = rights.url_parts(F.col("url"))
    u = pages.select("page_id", F.lit("web").alias("source_id"), p["host"].alias("host"), p["path"].alias("path")).where("host is not null")
    first = u.groupBy("host", F.concat(F.lit("/"), F.get(F.split("path", "/"), F.lit(1))).alias("url_path_prefix")).agg(F.count(F.lit(1)).alias("n"))
    rows = first.where("n > 1").select("host", "url_path_prefix").unionByName(first.groupBy("host").agg(F.sum("n").alias("n")).where("n > 2").select("host", F.lit("/").alias("url_path_prefix")))
    rows = rows.unionByName(u.where(F.length("path") > 8).select("host", F.col("path").alias("url_path_prefix"))).distinct()
    found = rights.covering(u, rows.select(F.lit("web").alias("source_id"), F.col("host").alias("domain"), "url_path_prefix"), request="page_id")
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("rights"), F.max("prefix_length").alias("longest"))


@query("""
with p as (select page_id, cast(len(regexp_extract_all(html, '<p[ >]')) as integer) as k, len(regexp_extract_all(html, '<li[ >]')) as n from pages)
select page_id, '//ul/li[' || k || ']' as body_xpath, case when k between 1 and n then 'selected' else 'body_xpath_must_select_one_element' end as status from p""")
def chosen_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list item that each page's number of paragraphs points at, and what became of the choice."""
    from ..sources import xpath

    pages = _t(spark, sf_dir, "pages")
    rows = pages.select("page_id", "html", F.concat(F.lit("//ul/li["), F.regexp_count("html", F.lit("<p[ >]")), F.lit("]")).alias("body_xpath"))
    found = xpath.chosen_bodies(rows).select("page_id", "status")
    # navigation is left out of bodies, so an item of it is found and has no text
    status = F.when(F.col("status") == "no_text_extracted", "selected").otherwise(F.col("status"))
    return rows.select("page_id", "body_xpath").join(found, "page_id").select("page_id", "body_xpath", status.alias("status"))

_SCORED = ["metric_id", "currency", "fiscal_year", "period_kind", "numeric_value", "source_scale", "modality", "source_qualifier"]


@query("""
with r as (
  select l_orderkey, l_linenumber, p_type as metric, cast(l_extendedprice as decimal(18,2)) as v, cast(year(l_shipdate) as varchar) as y, cast(year(l_shipdate + interval 31 day) as varchar) as py, l_discount >= 0.095 as missing, l_returnflag as f,
    cast(floor(cast(l_extendedprice as decimal(18,2)) * 10) as decimal(18,0)) / 10 as pv from lineitem join part on p_partkey = l_partkey),
e as (select 'metric_id' as field, not missing as ok, missing from r union all select 'currency', not missing, missing from r union all select 'fiscal_year', not missing and y = py, missing from r union all select 'period_kind', not missing, missing from r
  union all select 'numeric_value', not missing and v * 10 = floor(v * 10), missing from r union all select 'source_scale', not missing, missing from r union all select 'modality', not missing and f <> 'R', missing from r union all select 'source_qualifier', not missing, missing from r)
select field, count(*) filter (ok) as numerator, count(*) as denominator, count(*) filter (missing) as missing_prediction from e group by field""")
def projected_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as contract records, projected to reference fields, against predictions that read amounts to one place, late
    shipments into the next year and returns as plans, and leave out lines of the highest discount."""
    from ..operators import agreement, projections

    line = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    none, amount, year = F.lit(None).cast("string"), F.col("l_extendedprice").cast("decimal(18,2)"), lambda d: F.year(d).cast("string")
    period = lambda y: F.struct(none.alias("period_start"), none.alias("period_end"), none.alias("as_of_date"), F.lit("annual").alias("period_kind"), F.lit(None).cast("int").alias("duration_days"), y.alias("fiscal_year"), F.lit(None).cast("int").alias("fiscal_quarter"))
    item = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.date_format("l_shipdate", "yyyyMMdd"))
    temporal = lambda y: F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("published_date"), none.alias("published_at"), F.lit("date").alias("time_precision"), period(y).alias("reference_period"), F.struct(none.alias("period_start"), none.alias("period_end")).alias("effective_period"))
    names = ["subject_entity_id", "object_entity_id", "subject_role", "object_role", "relation_type", "direction", "negation"]
    place = F.array(F.struct(F.lit("cell").alias("kind"), item.alias("location"), F.lit(0).alias("start"), F.length(amount.cast("string")).alias("end"), F.concat(F.lit("V"), item).alias("evidence_id")))
    normalized = F.struct(
        F.lit("C").alias("company_id"), F.lit("ALL").alias("scope_id"), F.lit("actual").alias("modality"), F.col("p_type").alias("metric_id"), F.lit("1").alias("definition_version"), F.lit("1000").alias("source_scale"), (amount * 1000).cast("decimal(22,2)").cast("string").alias("numeric_value"), F.lit("USD").alias("currency"),
        F.lit("USD").alias("canonical_unit"), F.lit("preserve").alias("sign_policy"), F.lit("GAAP").alias("accounting_basis"), F.struct(F.lit("flow").alias("balance_or_flow")).alias("financial_context"), temporal(year("l_shipdate")).alias("temporal"), *[none.alias(k) for k in names],
    )
    records = line.select(
        item.alias("claim_id"), none.alias("relation_id"), F.lit("event_claim").alias("record_kind"), F.col("l_orderkey").cast("string").alias("event_id"), none.alias("event_family_id"), F.struct(amount.cast("string").alias("value_raw"), F.lit("reported").alias("source_evidence_status"), none.alias("source_period_start_derivation")).alias("raw"),
        normalized.alias("normalized"), F.struct(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit("r1").alias("revision_id"), place.alias("evidence")).alias("provenance"),
    )
    annotated = projections.annotations(records, line.select(F.concat(F.lit("V"), item).alias("evidence_id"), F.lit("numeric_value").alias("evidence_kind")), "ALL")
    reference = projections.reference_fields(annotated, ["source_claim_id"]).where("error is null").withColumnRenamed("source_claim_id", "item_id")
    late = F.date_add(F.to_date("l_shipdate"), 31)
    guess = F.struct(
        F.lit("C").alias("company_id"), F.lit("ALL").alias("scope_id"), F.when(F.col("l_returnflag") == "R", "planned").otherwise("actual").alias("modality"), F.col("p_type").alias("metric_id"), F.lit("USD").alias("currency"), F.lit("1000").alias("source_scale"),
        (F.floor(amount * 10) * 100).cast("decimal(22,0)").cast("string").alias("numeric_value"), temporal(year(late)).alias("temporal"),
    )
    predicted = line.where("l_discount < 0.095").select(F.concat(F.lit("p"), item).alias("prediction_id"), item.alias("of"), F.lit("event_claim").alias("record_kind"), F.struct(F.lit("reported").alias("source_qualifier")).alias("raw"), guess.alias("normalized"))
    guessed = projections.prediction_fields(predicted, ["prediction_id", "of"])
    refs, preds = reference.withColumn("location_key", F.col("item_id")), guessed.withColumn("location_key", F.col("of"))
    matches, _ = agreement.matched(refs, preds, _SCORED)
    return agreement.field_rates(matches, _SCORED).select("field", "numerator", "denominator", "missing_prediction")
