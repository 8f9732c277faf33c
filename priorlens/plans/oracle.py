"""The queries in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

import re

from ..functions import text

_CLAIMS = """
with last as (select max(cast(o_orderdate as date)) as d from orders),
c as (select n_name, cast(year(o_orderdate) as integer) as y, cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(28,2)) as v
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all),
k as (select n_name, y, v, n_name || '-' || y as id, least(make_date(y, 12, 31), d) as e, make_date(y, 12, 31) <= d as whole from c, last),
p as (select a.id, a.n_name, a.y, a.v, b.id as old_id, b.v as old_v, a.whole and b.whole as ok from k a join k b on a.n_name = b.n_name and a.y = b.y + 1)
"""
_RETRIEVAL = _CLAIMS + """, m as (select unnest(['current_review', 'historical_public', 'observed_live']) as cutoff_mode),
r as (
  select k.id, k.y, k.v, cutoff_mode, (select count(*) from k o where o.n_name = k.n_name and o.id <> k.id) as universe,
    (select count(*) from k o where o.n_name = k.n_name and o.y < k.y) as candidate_count,
    (select min(o.id) from k o where o.n_name = k.n_name and o.y < k.y) as oldest,
    (select count(*) from p where p.id = k.id and p.ok) as comparable_count, (select min(old_id) from p where p.id = k.id and p.ok) as good
  from k, m
), s as (
  select *, case when comparable_count > 1 then 'ambiguous_compatible_priors' when comparable_count = 1 and cutoff_mode <> 'observed_live' then 'selected' when cutoff_mode = 'observed_live' then 'query_unavailable'
    when candidate_count > 0 then 'all_candidates_incompatible' when universe > 0 then 'all_candidates_time_excluded' else 'no_hit_in_limited_corpus' end as status from r
), t as (select *, case when status = 'selected' then good end as selected_record_id, coalesce(case when status = 'selected' then good end, oldest) as review_comparator_id from s)
"""
_TOKENS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"
_URL = r"'^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^?#]*)(\?[^#]*)?'"
_PARTS = f"""
with u as (select page_id, trim(url) as url, lower(regexp_extract(trim(url), {_URL}, 1)) as scheme, lower(regexp_extract(trim(url), {_URL}, 2)) as host,
  regexp_extract(trim(url), {_URL}, 3) as port, regexp_extract(trim(url), {_URL}, 4) as path, regexp_extract(trim(url), {_URL}, 5) as query from pages),
q as (select *, array_to_string(list_filter(string_split(substr(query, 2), '&'), lambda x: x <> '' and not regexp_matches(lower(x), '^(utm_[a-z]+|ref|fbclid|gclid|from|source)(=|$)')), '&') as kept,
  case when (scheme = 'http' and port = ':80') or (scheme = 'https' and port = ':443') then '' else port end as pt from u),
w as (select *, case when host <> '' then scheme || '://' || host || pt || (case when path = '' then '/' else path end) || (case when kept = '' then '' else '?' || kept end) end as canonical from q)
"""
_LABELLED = """
with l as (select doc_id, lang, source, n_chars, quality, toxic, case when toxic = 1 then 'scope_availability' when quality = 0 then 'segment_definition' else 'evidence_review' end as reason_group,
  case when quality is not null then strftime(date '2024-01-01' + cast(doc_id % 365 as integer), '%Y-%m-%d') end as published_date from documents left join labels using (doc_id))
"""
_PAIRS = """
with p as (select doc_id, lang, cast(quality as varchar) as a, case when toxic = 1 then 'unknown' else cast(toxic as varchar) end as b from documents left join labels using (doc_id)),
o as (select *, a is not null and a <> 'unknown' as oa, b is not null and b <> 'unknown' as ob, a is not distinct from b as same from p)
"""
_PART = """
with m as (select p_partkey, p_name, p_brand, p_size, case when p_partkey % 17 = 0 then 'missing' when p_partkey % 23 = 0 then 'tie' else 'matched' end as st,
  case when p_partkey % 9 <> 0 then p_brand end as pb, case when p_partkey % 10 = 0 then p_size + 1 else p_size end as ps from part)
"""
_MODES = """
with m as (select unnest(['current_review', 'historical_public', 'observed_live']) as cutoff_mode), e as (select event_id, cast(ts as date) as day, date '2024-01-15' as c from events),
x as (select event_id, cutoff_mode, c, cutoff_mode = 'current_review' as review, cutoff_mode = 'observed_live' as live, case when event_id % 11 <> 0 then day end as pub, day + 1 as obs,
  day + cast(event_id % 5 - 2 as integer) as dpub, day + cast(event_id % 3 as integer) as dobs from e, m),
y as (select *, case when pub is null then 'publication_unknown' when pub > c then 'future_information' end as r1,
  case when (review or live) and obs = c then 'observed:same_day_order_unknown' when (review or live) and obs > c then 'observed:future_information' end as r2,
  case when dobs = c then 'same_day_order_unknown' when dobs > c then 'future_information' end as so, case when dpub = c then 'same_day_order_unknown' when dpub > c then 'future_information' end as sp from x),
z as (select event_id, cutoff_mode, list_filter([r1, r2,
  case when review then 'dependency:' || so when live and so is not null then 'dependency:observed:' || so when event_id % 7 = 0 then 'dependency:current_only_dependency' else 'dependency:' || sp end,
  case when not review and event_id % 13 = 0 then 'scope_unresolved_at_cutoff' end], lambda r: r is not null) as reasons from y)
"""
_FEEDBACK = """
with f as (select event_id, user_id || '-' || event_type || '-' || strftime(ts, '%Y-%m-%d') as key, user_id || '-' || strftime(ts, '%Y-%m-%d') as card_id, event_type as field,
  cast(cast(floor(value / 10) as bigint) as varchar) as after, value >= 0 as valid, 'F' || event_id as fid from events)
"""
_TRIGRAMS = """
with c as (select doc_id, lang, string_split(lower(text), '') as c from documents),
g as (select doc_id, lang, list_sort(list_distinct(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))) as g from c),
m as (select doc_id, lang, g, min(doc_id) over (partition by lang, g) as class from g where len(g) > 0),
k as (select * from m where doc_id = class), x as (select class, lang, len(g) as n, unnest(g) as t from k),
i as (select a.lang, a.class as l, b.class as r, any_value(a.n) as ln, any_value(b.n) as rn, count(*) as k from x a join x b on a.lang is not distinct from b.lang and a.t = b.t and a.class < b.class group by a.lang, a.class, b.class),
j as (select lang, l, r, k / (ln + rn - k) as j from i where k / (ln + rn - k) >= 0.8)
"""
# DuckDB's expressions repeat a thousand times at most
_re2 = lambda p: re.sub(r"(\[[^\]]+\])\{1,2000\}", r"\1{1,1000}\1{0,1000}", p)
_Q = lambda s: s.replace("'", "''")
_NUMBER = r"^\(?-?\$?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\)?$"

SQL: dict[str, str] = {
    "yoy_change": _CLAIMS + """select id as new_record_id, old_id as prior_record_id, case when ok then 'comparable' else 'not_comparable' end as decision, case when ok then 'computed' else 'withheld' end as status,
  case when ok then '' else 'actual_period_mismatch' end as reasons, cast(old_v as varchar) as old_value, cast(v as varchar) as new_value, case when ok then cast(v - old_v as varchar) end as delta,
  case when ok then round(cast(v - old_v as double) / abs(cast(old_v as double)), 6) end as relative_delta, case when ok then 'yoy' else 'not_comparable' end as change_type, ok as historical_eligible from p""",
    "prior_retrieval": _RETRIEVAL + """select id as new_record_id, cutoff_mode, universe, candidate_count, universe - candidate_count as excluded_count, comparable_count, status, selected_record_id, review_comparator_id from t""",
    "no_prior_changes": _RETRIEVAL + """select id as new_record_id, cutoff_mode, 'prior_search' as comparison_basis, 'withheld' as status, status || (case when cutoff_mode = 'observed_live' then '|observed:future_information' else '' end) as reasons,
  cast(v as varchar) as new_value, 'prior_not_available' as relative_delta_missing_reason from t where review_comparator_id is null""",
    "label_retrieval_methods": _RETRIEVAL + "select count(*) as queries, count(*) as same, count(selected_record_id) as same_selected from t",
    "change_mode_summary": _RETRIEVAL + """, h as (select t.*, coalesce((select ok from p where p.id = t.id and p.old_id = t.review_comparator_id), false) as ok from t)
select cutoff_mode, count(*) as attempted, count(*) filter (where ok and cutoff_mode <> 'observed_live') as computed, count(*) filter (where not (ok and cutoff_mode <> 'observed_live')) as withheld, count(*) filter (where ok) as historical_eligible from h group by cutoff_mode""",
    "same_period_revision": _CLAIMS + """, n as (select *, cast(v * 1.10 as decimal(28,2)) as nv from k)
select id || '-rev' as new_claim_id, id as prior_claim_id, 'comparable' as decision, '' as reasons, cast(nv - v as varchar) as delta, round(cast(nv - v as double) / abs(cast(v as double)), 6) as relative_delta, cast(null as varchar) as relative_delta_missing_reason from n
union all select id || '-def', id, 'not_comparable', 'definition_version_mismatch', null, null, null from n""",
    "within_group_prior": """with b as (select c_mktsegment as segment, cast(year(o_orderdate) as integer) as year, count(*) as orders from orders join customer on o_custkey = c_custkey group by all)
select a.segment, a.year, a.orders, b.orders as prior_orders, a.orders - b.orders as delta from b a join b on a.segment = b.segment and a.year = b.year + 1""",
    "ytd_to_quarter": """with q as (select n_name, cast(year(o_orderdate) as integer) as year, cast(quarter(o_orderdate) as integer) as quarter, sum(cast(o_totalprice as decimal(18,2))) as amount
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all)
select n_name, year, quarter, cast(sum(amount) over (partition by n_name, year order by quarter) as decimal(28,2)) as ytd, cast(amount as decimal(28,2)) as period_value from q""",
    "reconcile_tolerance": """with o as (select o_orderkey, cast(o_totalprice as decimal(18,2)) as total from orders), l as (select l_orderkey, cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(28,2)) as lines from lineitem group by 1),
j as (select coalesce(o_orderkey, l_orderkey) as o_orderkey, 'lines' as lane, total, lines as other from o full join l on o_orderkey = l_orderkey
  union all select o_orderkey, 'copy', total, cast(total + cast(o_orderkey % 4 as decimal(18,2)) * 0.10 as decimal(18,2)) from o)
select o_orderkey, lane, cast(total - other as decimal(28,2)) as difference, case when total is null or other is null then 'missing_pair' when abs(total - other) <= 0.15 then 'reconciled' else 'difference' end as status from j""",
    "margin_formula": """with b as (select n_name, cast(year(o_orderdate) as integer) as year, sum(cast(l_extendedprice as decimal(18,2))) as f, sum(cast(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))) as decimal(24,4))) as n
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all)
select n_name, year, 'computed' as status, '' as reasons, round(cast(n as double) / cast(f as double), 6) as margin from b""",
    "asof_prior_event": """with a as (select user_id, ts, max_by({'id': event_id, 't': event_type, 'v': value}, event_id) as last, count(*) as n from events group by all),
p as (select user_id, ts, lag(last) over w as p, lag(n) over w as n from a window w as (partition by user_id order by ts))
select event_id, user_id, p.id as prior_event_id, p.t as prior_event_type, round(p.v, 6) as prior_value, n as prior_candidates from events join p using (user_id, ts)""",
    "ambiguous_priors": """with e as (select event_id, user_id, event_type, cast(ts as date) as day from events), a as (select user_id, event_type, day, max(event_id) as last, count(*) as n from e group by all),
p as (select user_id, event_type, day, lag(last) over w as last, lag(n) over w as n from a window w as (partition by user_id, event_type order by day))
select event_id, user_id, event_type, n as prior_candidates, case when n is null then 'no_prior' when n > 1 then 'ambiguous_compatible_priors' else 'selected' end as status, case when n = 1 then last end as selected_event_id from e join p using (user_id, event_type, day)""",
    "dependency_availability": _MODES + "select event_id, cutoff_mode, len(reasons) = 0 as eligible, coalesce(array_to_string(reasons, '|'), '') as reasons from z",
    "mode_summary": _MODES + "select cutoff_mode, count(*) as attempted, count(*) filter (where len(reasons) = 0) as eligible, count(*) filter (where len(reasons) > 1) as several_reasons from z group by cutoff_mode",
    "tfidf_retrieval": f"""with d as (select doc_id, unnest({_TOKENS}) as t from documents), b as (select item_id, unnest({_TOKENS}) as t from benchmark), n as (select count(*) as n from documents),
df as (select t, count(*) as df from d group by t), s as (select item_id, doc_id, round(sum(ln((n + 1) / (df + 1)) + 1), 4) as score from b join df using (t) join d using (t), n group by all),
r as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank from s)
select item_id, rank, doc_id, score from r where rank <= 5""",
    "trigram_pairs": _TRIGRAMS + "select lang, l as left_id, r as right_id, round(j, 6) as jaccard from j",
    "trigram_classes": _TRIGRAMS + """, n as (select class, count(*) as links from (select l as class from j union all select r from j) group by class)
select doc_id, m.class as class_id, coalesce(links, 0) as links from m left join n using (class)""",
    "exact_sentence_overlap": f"""with m as (select doc_id, regexp_replace(text, '({text.SENTENCE_END}+[{_Q(text.CLOSERS)}]*)(\\s|$)|\\n+', '\\1' || chr(1), 'g') as m from documents),
s as (select doc_id, unnest(list_distinct(list_transform(string_split(m, chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')))) as sentence from m)
select sentence, count(*) as documents, min(doc_id) as first_doc, max(doc_id) as last_doc from s where length(sentence) >= 30 group by sentence having count(*) > 1""",
    "url_canonical": _PARTS + """select page_id, canonical, case when host <> '' then scheme || '://' || host || path end as redacted, nullif(host, '') as host,
  scheme = 'https' and regexp_matches(host, '^([a-z0-9-]+\\.)+[a-z]{2,}$') and port in ('', ':443') and not regexp_matches(url, '^[^/]*//[^/?#]*@') and not regexp_matches(host, '\\.(local|internal|localhost)$') as is_safe from w""",
    "url_alias_groups": _PARTS + "select host || '/' || coalesce(string_split(path, '/')[2], '') as alias, count(distinct canonical) as members, min(canonical) as first_member from w where host <> '' group by 1 having count(distinct canonical) >= 2",
    "signal_counts": "select doc_id, " + ", ".join(f"cast(len(regexp_extract_all(text, '{_Q(_re2(p))}')) as bigint) as {k}" for k, p in text.SIGNALS.items()) + " from documents",
    "review_order": _LABELLED + """select doc_id, reason_group, published_date, row_number() over (order by published_date nulls last, doc_id) as chronological_position,
  row_number() over (order by case reason_group when 'scope_availability' then 1 when 'segment_definition' then 2 else 4 end, published_date nulls last, doc_id) as grouped_position from l""",
    "round_robin_sample": "with r as (select source, cast(row_number() over (partition by source order by doc_id) as integer) as turn, doc_id from documents) select source, turn, doc_id from r order by turn, source limit 200",
    "review_cards": "select conv_id, count(*) as turns, array_to_string(list_sort(list_distinct(list(role))), '|') as roles, cast(sum(length(text)) as bigint) as chars, sha256(string_agg(sha256(text), chr(10) order by turn, sha256(text))) as card_version from conversations group by conv_id",
    "label_agreement": _PAIRS + """select lang, count(*) as all_pairs, count(*) filter (where same) as exact, count(*) filter (where oa and ob) as observed_pairs, count(*) filter (where oa and ob and same) as observed_exact,
  count(*) filter (where not oa and not ob) as excluded_state_pairs, count(*) filter (where oa <> ob) as missingness_disagreements, round(count(*) filter (where oa and ob and same) / nullif(count(*) filter (where oa and ob), 0), 6) as observed_rate from o group by lang""",
    "label_confusion": _PAIRS + "select lang, coalesce(a, 'null') as a, coalesce(b, 'null') as b, count(*) as n from o group by all",
    "span_overlap_f1": """with s as (select lang, instr(text, '.') as p, doc_id % 3 <> 0 as has from documents where instr(text, '.') > 0), x as (select *, 0 as rs, p as re, case when has then least(3, p) end as ps, case when has then p + 2 end as pe from s),
y as (select *, case when has then greatest(0, least(re, pe) - greatest(rs, ps)) else 0 end as i from x)
select lang, cast(sum(i) as bigint) as intersection, cast(sum(re - rs) as bigint) as reference_chars, cast(coalesce(sum(pe - ps), 0) as bigint) as predicted_chars, count(*) filter (where rs = ps and re = pe) as span_exact, count(*) as spans,
  round(avg(2 * i / (re - rs + coalesce(pe - ps, 0))), 6) as macro_f1, round(2 * sum(i) / (sum(re - rs) + coalesce(sum(pe - ps), 0)), 6) as micro_f1 from y group by lang""",
    "field_match_rates": _PART + """, f as (select 'p_name' as field, st, p_name is not distinct from p_name as same from m union all select 'p_brand', st, p_brand is not distinct from pb from m union all select 'p_size', st, p_size is not distinct from ps from m)
select field, count(*) filter (where st = 'matched' and same) as numerator, count(*) as denominator, count(*) filter (where st <> 'matched') as missing_prediction, round(count(*) filter (where st = 'matched' and same) / count(*), 6) as value from f group by field""",
    "bundle_match_rate": _PART + """, b as (select st = 'matched' and coalesce(p_brand = pb, false) and p_size = ps as ok from m) select count(*) filter (where ok) as numerator, count(*) as denominator, round(count(*) filter (where ok) / count(*), 6) as value from b""",
    "funnel": """with r as (select l_orderkey, count(*) as lines, count(*) filter (where l_returnflag = 'R') as returned from lineitem group by 1), j as (select * from orders left join r on o_orderkey = l_orderkey),
s as (select *, coalesce(lines > 0, false) as a, coalesce(lines > 0 and returned > 0, false) as b, coalesce(lines > 0 and returned > 0 and o_orderstatus = 'O', false) as c, coalesce(lines > 0 and returned > 0 and o_orderstatus = 'O' and o_totalprice > 100000, false) as d from j)
select 1 as step, 'attempted' as stage, count(distinct o_orderkey) as n from s union all select 2, 'with_lines', count(distinct o_orderkey) from s where a union all select 3, 'returned', count(distinct o_orderkey) from s where b
union all select 4, 'open', count(distinct o_orderkey) from s where c union all select 5, 'large', count(distinct o_orderkey) from s where d""",
    "coverage_matrix": """with y as (select min(year(o_orderdate)) as a, max(year(o_orderdate)) + 1 as z from orders), g as (select n_name, cast(unnest(range(y.a, y.z + 1)) as integer) as year from nation, y), f as (select n_name, cast(year(o_orderdate) as integer) as year, count(*) as found from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all)
select n_name, year, coalesce(found, 0) as found, case when coalesce(found, 0) = 0 then 'missing' when found = 1 then 'covered' else 'several' end as status from g left join f using (n_name, year)""",
    "fk_violations": "select doc_id, lang, source from documents where doc_id not in (select doc_id from labels)",
    "missing_reason_audit": """with d as (select c_custkey as k, case when c_custkey % 5 <> 0 then c_acctbal end as b, case when c_custkey % 7 <> 0 then c_mktsegment end as s, case when c_custkey % 10 = 0 then 'not_disclosed' when c_custkey % 11 = 0 then 'guess' end as br, case when c_custkey % 7 = 0 then 'not_applicable' end as sr from customer)
select k as c_custkey, coalesce(array_to_string(list_sort(list_filter([case when b is null and br is null then 'balance:missing_without_reason' end, case when b is not null and br is not null then 'balance:stale_reason' end, case when br not in ('not_disclosed', 'not_applicable') then 'balance:unknown_reason' end,
  case when s is null and sr is null then 'segment:missing_without_reason' end, case when s is not null and sr is not null then 'segment:stale_reason' end, case when sr not in ('not_disclosed', 'not_applicable') then 'segment:unknown_reason' end], lambda x: x is not null)), '|'), '') as errors from d""",
    "lineage_components": "select o_orderkey as node, min(o_orderkey) over (partition by o_custkey) as component from orders",
    "feedback_conflicts": _FEEDBACK + """select card_id, field, count(distinct after) as "values", count(distinct fid) as events, min(fid) as first_feedback from f group by card_id, field having count(distinct after) > 1""",
    "feedback_import": _FEEDBACK + """, w as (select *, row_number() over o as rn, first_value(after) over o as first, first_value(valid) over o as any_valid from f window o as (partition by key order by valid desc, event_id))
, x as (select event_id, case when not valid then 'invalid_decimal' when rn > 1 and after <> first then 'idempotency_payload_conflict' end as rejection, rn from w)
select event_id, case when rejection is not null then 'rejected' when rn > 1 then 'duplicate' else 'accepted' end as result, rejection from x""",
    "latest_per_key": """with r as (select *, row_number() over (partition by o_custkey order by cast(o_orderdate as date) desc, o_orderkey desc) as rn from orders where cast(o_orderdate as date) <= date '2000-12-31')
select o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, cast(o_totalprice as decimal(18,2)) as total from r where rn = 1""",
    "dedup_first": "select doc_id, case when doc_id = min(doc_id) over (partition by text) then 'first' else 'duplicate' end as dedup_status from documents",
    "unit_scaling": """with a as (select l_orderkey, l_linenumber, cast(l_quantity as decimal(18,2)) as q, case l_returnflag when 'A' then 'thousands' when 'N' then 'millions' else 'unknown' end as unit, case when l_linestatus = 'O' then 'USD' else 'EUR' end as cur from lineitem),
b as (select *, case when unit = 'thousands' and cur = 'USD' then 'R1' when unit = 'millions' and cur = 'USD' then 'R2' end as rule_id from a)
select l_orderkey, l_linenumber, case when rule_id is null then 'incompatible_inputs' else 'computed' end as calculation_status,
  case rule_id when 'R1' then cast(cast(q * 1000 as bigint) as varchar) when 'R2' then cast(cast(q * 1000000 as bigint) as varchar) end as output, case rule_id when 'R1' then 'USD' when 'R2' then 'base' end as output_unit, rule_id,
  case when rule_id is not null then '' when unit = 'unknown' then 'currency_or_unit_unknown' else 'no_unambiguous_scale_rule' end as reasons from b""",
    "number_parsing": f"""with t as (select c_custkey, c_custkey % 6 as k, abs(cast(c_acctbal as decimal(18,2))) as v from customer), g as (select *, format('{{:,.2f}}', cast(v as double)) as f from t),
x as (select c_custkey, k, v, trim(case k when 0 then '(' || f || ')' when 1 then f when 2 then '—' when 3 then '  ' when 4 then '(' || v else '1,2' || v end) as s from g),
y as (select *, case when s = '' then 'blank_numeric_cell' when s = '—' then 'dash_not_zero' when not regexp_matches(s, '{_NUMBER}') then 'malformed_numeric_token' when starts_with(s, '(') <> ends_with(s, ')') then 'ambiguous_sign' end as error from x)
select c_custkey, case when error is null then cast(cast(replace(replace(replace(s, '(', ''), ')', ''), ',', '') as decimal(18,2)) * (case when starts_with(s, '(') then -1 else 1 end) as decimal(18,2)) end as value, error from y""",
    "period_parsing": """with o as (select o_orderkey, o_orderkey % 4 as k, cast(year(o_orderdate) as integer) as y from orders), x as (select *, case when y < 2000 then 'missing_or_ambiguous_year_header' when k = 3 then 'unsupported_or_conflicting_period_header' end as error from o)
select o_orderkey, case when error is null and k = 0 then y || '-04-01' when error is null and k = 1 then (y - 1) || '-07-01' end as period_start, case when error is null and k in (0, 1) then y || '-06-30' end as period_end, case when error is null and k = 2 then y || '-06-30' end as as_of_date,
  case when error is null then case k when 0 then 'quarter' when 1 then 'annual' else 'instant' end end as period_kind, case when error is null then y end as fiscal_year,
  cast(case when error is null and k = 0 then 91 when error is null and k = 1 then date_diff('day', make_date(y - 1, 7, 1), make_date(y, 6, 30)) + 1 end as integer) as duration_days, error from x""",
    "interval_overlap": """with e as (select event_id, user_id, event_type, cast(floor(epoch(ts - timestamp '2024-01-01') / 60) as integer) as s from events), i as (select *, cast(s + 30 + event_id % 60 as integer) as e from e)
select a.event_id as left_event, b.event_id as right_event, greatest(a.s, b.s) as overlap_start, least(a.e, b.e) as overlap_end from i a join i b on a.user_id = b.user_id and a.event_type < b.event_type and a.s < b.e and a.e > b.s""",
    "event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "cell_extraction": """with p as (select p_partkey as k, cast(p_retailprice as decimal(18,2)) as v from part), x as (select *, case when k % 50 <> 0 and k % 41 = 0 then 'source_identity' end as failure_stage,
  case when k % 50 <> 0 and k % 41 = 0 then 'revision_or_hash_mismatch' when k % 50 = 0 then 'document_not_allowlisted' when k % 7 = 0 then 'unknown_or_ambiguous_metric_alias' when k % 11 = 0 then 'missing_or_ambiguous_year_header' when k % 13 = 0 then 'dash_not_zero' else '' end as reasons from p)
select 'I' || k as input_id, case when failure_stage is not null then 'quarantined' when reasons <> '' then 'abstained' else 'predicted' end as status, failure_stage, reasons, case when reasons = '' then 'revenue' end as metric_id, case when reasons = '' then cast(cast(v * 1000000 as bigint) as varchar) end as numeric_value from x""",
    "split_leakage": """with d as (select doc_id, text, case when doc_id % 10 = 0 then 'test' else 'train' end as split from documents), c as (select text, count(distinct split) as n from d group by text)
select cast(doc_id as varchar) as row_id, split, case when n > 1 then 'component_crosses_splits' else '' end as reasons from d join c using (text)""",
}
