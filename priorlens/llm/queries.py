"""One query per operator over its whole table, and their SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplane, byte_bpe, kdtree, langid, minhash, mixing, packing, preference, quality, runs, sharding, token_counts, vector_codes
from .common import table


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.divergence_rules(table(spark, sf_dir, "documents"), sample_docs=quality.SAMPLE_DOCS).drop("class_distance", "word_distance")


def op2_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), 20, 64.0, 20)


def op3_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.learn(docs))
    return out.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op4_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op5_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.digests(byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, pattern, known_bytes=300_000_000))


def op6_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.curriculum(table(spark, sf_dir, "documents"))
    ordered = mixing.training_ranks(mix, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ordered.select("doc_id", "size", "source_size", "target", "taken", "copies", "first_position", "first_rank")


def op8_stratified_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preference.preference_format(preference.swapped_replies(table(spark, sf_dir, "conversations")))
    return out.select("pair_id", "prefix_turns", "prompt", "chosen", "rejected", preference.mask("chosen_segments").alias("chosen_mask"), preference.mask("rejected_segments").alias("rejected_mask"), "identical")


def op10_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = bitplane.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    out = bitplane.read_ids(manifest)
    return out.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op11_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(runs.looped(table(spark, sf_dir, "documents")))
    best, line = runs.best("runs"), lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    thousand = 1000 * best["length"]
    exponent = ((thousand - thousand % best["period"]) / best["period"]).cast("long")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), exponent.alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.codes(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", vector_codes.hex_code("codes").alias("code"), "error", "label_error", "codebooks_sha256")


QUERIES = {f.__name__: f for f in (op1_distribution_divergence, op2_kdtree_topk, op3_cross_parsing, op4_transducer_counts, op5_rank_queue_bpe, op6_minhash_components, op7_curriculum_mix, op8_stratified_interleave, op9_preference_format, op10_bitplane_ids, op11_certified_packing, op12_periodic_runs, op13_vector_codes)}


def _class_counts() -> str:
    """The character classes, one after the other, as SQL columns l0, l1 ... of the lengths that are left."""
    rest, out = "t", ["length(t) as l0"]
    for k, pattern in enumerate(quality.CLASSES):
        rest = f"regexp_replace({rest}, '{pattern.replace("'", "''")}', '', 'g')"
        out.append(f"length({rest}) as l{k + 1}")
    return ", ".join(out)


def _distance(p: str, q: str) -> str:
    term = lambda a, b: f"(case when {a} > 0 then {a} * log2({a} / (({a} + {b}) / 2)) else 0 end)"
    x, y = f"({p}[i] / list_sum({p}))", f"({q}[i] / list_sum({q}))"
    return f"sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {term(x, y)} + {term(y, x)})) / 2))"


def _rendered(turns: str) -> str:
    return f"coalesce(array_to_string(list_transform({turns}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10)), ''), '')"


def _masked(turns: str) -> str:
    return f"coalesce(array_to_string(list_transform({turns}, lambda t: '0:' || (length(t.role) + 5) || ',' || (case when t.role = 'assistant' then '1:' else '0:' end) || (length(t.text) + 9)), ','), '')"


def _lloyd(rounds: int = vector_codes.ROUNDS) -> str:
    """Codebooks b0, b1 ... and assignments a0, a1 ... as common table expressions."""
    out = []
    for k in range(rounds + 1):
        near = f"select x.number, x.part, x.v, b.entry, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))) as d from x join b{k} b using (part)"
        out.append(f"a{k} as materialized (select number, part, any_value(v) as v, arg_min(entry, (d, entry)) as entry, min(d) as d from ({near}) group by number, part)")
        if k < rounds:
            means = f"select part, entry, i, sum(v[i]) as s, count(*) as n from a{k}, unnest(range(1, len(v) + 1)) as u(i) group by all"
            moved = f"select part, entry, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as v from ({means}) group by part, entry"
            out.append(f"b{k + 1} as materialized (select b.part, b.entry, coalesce(m.v, b.v) as v from b{k} b left join ({moved}) m using (part, entry))")
    return ",\n".join(out)


N_CLASSES = len(quality.CLASSES) + 1

SQL: dict[str, str] = {
    "op1_distribution_divergence": f"""
with d as (select doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from g) where n > 1),
covered as (select doc_id, count(distinct i + k) as n from twice, (values (0), (1), (2)) as v(k) group by doc_id),
h as (
  select d.*, len(w) as n_words, {_class_counts()},
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
    list_transform(w, lambda x: lower(x)) as lw from d
), base as (
  select h.*, coalesce(covered.n, 0) as n_repeat, (n_words < 50 or 100 * coalesce(covered.n, 0) > 50 * n_words) as failed,
    [{", ".join(f"cast(l{k} - l{k + 1} as double)" for k in range(N_CLASSES - 1))}, cast(l{N_CLASSES - 1} as double)] as classes from h left join covered using (doc_id)
), drawn as (
  select distinct doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by md5(concat_ws(':', '11', cast(doc_id as varchar))), doc_id) as r from documents where length(text) >= {quality.MIN_CHARS} and lang is not null) where r <= {quality.SAMPLE_DOCS}
), w1 as (select lang, lower(x) as w, count(*) as n from (select base.lang, unnest(base.w) as x from base semi join drawn on base.doc_id = drawn.doc_id and base.lang = drawn.lang where length(base.t) >= {quality.MIN_CHARS}) group by all),
w2 as (select lang, w, n from w1 union all select null, w, sum(n) from w1 group by w),
w3 as (select *, sum(n) over (partition by lang) as total, row_number() over (partition by lang order by n desc, w) as k from w2),
v as (
  select lang, list(w order by k) as vocabulary, list_append(list(cast(n as double) / total order by k), cast(any_value(total) - sum(n) as double) / any_value(total)) as share
  from w3 where k <= {quality.COMMON} and (lang is null or total >= {quality.MIN_REFERENCE_WORDS}) group by lang
), p as (select vocabulary as pooled, share as pooled_share from v where lang is null),
c as (
  select base.*, v.lang is not null as own, list_transform(coalesce(v.vocabulary, pooled), lambda y: cast(len(list_filter(lw, lambda x: x = y)) as double)) as bins, pooled_share
  from base cross join p left join v on v.lang = base.lang
), f as (select *, list_append(bins, n_words - coalesce(list_sum(bins), 0)) as commons from c),
rc as (select lang, list(x order by i) as rc from (select lang, i, sum(classes[i]) as x from f, unnest(range(1, {N_CLASSES + 1})) as u(i) where not failed group by all) group by lang),
rw as (select lang, list(x order by i) as rw from (select lang, i, sum(commons[i]) as x from f, unnest(range(1, len(f.commons) + 1)) as u(i) where not failed and own group by all) group by lang),
ec as (select list(x order by i) as ec from (select i, sum(rc[i]) as x from rc, unnest(range(1, {N_CLASSES + 1})) as u(i) group by i)),
j as (select f.*, case when own and rc.rc is not null then rc.rc else ec end as qc, case when own then rw.rw else pooled_share end as qw from f cross join ec left join rc on f.lang = rc.lang left join rw on f.lang = rw.lang),
z as (select *, case when length(t) > 0 then {_distance("classes", "qc")} end as dc, case when n_words > 0 then {_distance("commons", "qw")} end as dw from j)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(n_repeat as bigint) as n_repeat_words, failed as base_failed,
  not failed and not coalesce((length(t) >= {quality.MIN_CHARS} and dc > {quality.MAX_CLASS_DISTANCE}) or (n_words >= {quality.MIN_WORDS} and dw > {quality.MAX_WORD_DISTANCE}), false) as kept
from z""",
    "op2_kdtree_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20""",
    "op6_minhash_components": """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as g from w),
n as (select doc_id, len(g) as n from g), s as (select doc_id, unnest(g) as t from g),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.t = b.t and a.doc_id < b.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as id, doc_id as m from documents union select e.b, r.m from r join e on e.a = r.id and r.m < e.b)
select doc_id, cast(n as bigint) as n_shingles, min(m) as component_id, doc_id = min(m) as kept from n join r on id = doc_id group by doc_id, n""",
    "op7_curriculum_mix": """
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
    md5(concat_ws(':', '23', cast(doc_id as varchar), md5(text))) as h from documents
), s as (
  select source, cast(sum(size) as bigint) as n, row_number() over (order by source nulls last) - 1 as k from d group by source
), w as (select *, cast(k % 3 + 1 as double) as w, cast(k % 2 = 0 as boolean) as rising from s),
-- the sources that stop at three times their size are the first by size over weight
o as (
  select *, sum(n) over () - coalesce(sum(3 * n) over (order by n / w, k rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(w) over () - coalesce(sum(w) over (order by n / w, k rows between unbounded preceding and 1 preceding), 0) as weights,
    row_number() over (order by n / w, k) as place from w
), c as (select *, cast(rest as double) * w / weights > 3 * n as stops from o),
f as (select sum(n) - coalesce(sum(3 * n) filter (stops), 0) as rest, sum(w) - coalesce(sum(w) filter (stops), 0) as weights from c),
t as (select c.source, c.n, c.w, c.rising, case when stops then cast(3 * c.n as double) else cast(f.rest as double) * c.w / f.weights end as target from c cross join f),
u as (select *, (case when rising then 0.5 * w else 1.5 * w end) * 0.5 as at1 from t),
v as (select *, at1 + (case when rising then 1.5 * w else 0.5 * w end) * 0.5 as at2 from u),
x as (select source, n, target, at1 * (target / at2) as c1, at2 * (target / at2) as c2 from v),
b as (select d.*, cast(sum(size) over (partition by source order by h, doc_id, size rows between unbounded preceding and current row) as bigint) - size as before from d),
m as (select b.*, x.n, x.target, x.c1, x.c2, j, j * x.n + b.before + b.size / 2.0 as mid from b join x on b.source is not distinct from x.source, (values (0), (1), (2)) as copies(j)),
p as (select *, size > 0 and mid < target as took,
    case when c1 <= mid then 0.5 + 0.5 * (mid - c1) / (c2 - c1) else 0.0 + 0.5 * mid / c1 end as position from m),
r as (select doc_id, h, source, j, position, row_number() over (order by position, doc_id, size, source nulls last, j) as rank from p where took)
select p.doc_id, p.size, cast(p.n as bigint) as source_size, p.target, cast(count(*) filter (p.took) * p.size as bigint) as taken, cast(count(*) filter (p.took) as integer) as copies,
  min(r.position) as first_position, min(r.rank) as first_rank
from p left join r on p.took and p.j = 0 and r.j = 0 and r.h = p.h and r.source is not distinct from p.source
group by p.doc_id, p.h, p.size, p.source, p.n, p.target""",
    "op8_stratified_interleave": """
with tab as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(cast(i as bigint), list_transform(range(8), lambda k: cast(k as bigint))),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab
), b as (
  select doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 as size, text is null as none,
    list_transform(range(octet_length(encode(coalesce(text, '')))), lambda i: cast(('0x' || substr(hex(encode(text)), 2 * i + 1, 2)) as bigint)) as bytes from documents
), d as (
  select doc_id, source, size, case when not none then xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]))) end as crc from b cross join tab
), h as (select *, md5(concat_ws(':', '17', cast(doc_id as varchar), cast(crc as varchar))) as h,
    cast(('0x' || substr(md5(concat_ws(':', '17', source)), 1, 8)) as bigint) / 4294967296.0::double as u from d),
f as (select *, ((row_number() over (partition by source order by h, doc_id, crc, size) - 1) + u) / count(*) over (partition by source) as fraction, count(*) over () as n from h),
p as (select *, row_number() over (order by fraction, source nulls last, h, doc_id, crc, size) - 1 as position from f),
s as (select *, (position * 8) // n as shard from p)
select doc_id, cast(size as bigint) as size, cast(crc as bigint) as text_crc32, 'rows' as law, cast(shard as integer) as shard,
  cast(row_number() over (partition by shard order by position) - 1 as bigint) as slot, cast(null as integer) as grown_shard from s""",
    "op9_preference_format": """
with t as (
  select conv_id, list_sort(list({'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')})) as turns
  from conversations where conv_id is not null group by conv_id
), a as (
  select conv_id, turns, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') as places from t
), o as (
  select *, places[len(places)] as n, turns[places[len(places)]] as reply, row_number() over (order by md5(concat_ws(':', '41', cast(conv_id as varchar))), conv_id) - 1 as rank, count(*) over () as every,
    cast(floor(cast(('0x' || substr(md5(concat_ws(':', '41', 'at', cast(conv_id as varchar))), 1, 8)) as bigint) / 4294967296.0::double * len(places)) as bigint) as k
  from a where len(places) > 0
), p as (
  select o.conv_id as pair_id, [{'role': x.role, 'text': x.text} for x in o.turns[1:o.n]] as c,
    list_concat([{'role': x.role, 'text': x.text} for x in o.turns[1:o.places[o.k + 1] - 1]], case when r.conv_id <> o.conv_id then [{'role': r.reply.role, 'text': r.reply.text}] else [] end) as r
  from o join o r on r.rank = (o.rank + 1) % o.every
), s as (
  select *, coalesce(list_position(list_transform(range(1, greatest(len(c), len(r)) + 1), lambda i: i <= len(c) and i <= len(r) and c[i].role = r[i].role and c[i].text = r[i].text), false), greatest(len(c), len(r)) + 1) - 1 as k from p
), x as (select pair_id, k, c[1:k] as p, c[k + 1:len(c)] as c, r[k + 1:len(r)] as r from s),
y as (select *, (len(c) = 0 and len(r) = 0) as identical from x)
select pair_id, cast(k as integer) as prefix_turns, """ + _rendered("p") + """ as prompt, """ + _rendered("c") + """ as chosen, """ + _rendered("r") + """ as rejected, """ + _masked("c") + """ as chosen_mask, """ + _masked("r") + """ as rejected_mask, identical
from y""",
    "op13_vector_codes": f"""
with q as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v, row_number() over (order by vec_id nulls last, embedding) as number from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), x as materialized (select number, p as part, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] as v from q, unnest(range(4)) as u(p)),
b0 as materialized (select part, number - 1 as entry, v from x where number <= 256),
{_lloyd()},
e as (select number, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from a{vector_codes.ROUNDS} group by number),
r as (select q.vec_id, q.label, e.code, e.error from q join e using (number)),
s as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as sha from b{vector_codes.ROUNDS})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, sha as codebooks_sha256 from r cross join s""",
}
