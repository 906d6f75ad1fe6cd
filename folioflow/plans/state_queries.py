"""Queries over chunks, manifests and their translations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.context import read
from folioflow.operators import align as L
from folioflow.operators import audit as U
from folioflow.operators import state as S
from folioflow.plans.structure_queries import B, _S
from folioflow.plans.term_queries import _OCC, C
from folioflow.sources import tables


def _manifests(spark, d):
    return tables.manifest(spark, d, "chunk_count", "source_hash", "split_complete", "chunks")


def chunk_actions(spark, d):
    state = tables.run_state(spark, d, "source_hash", "output_hash", "entity_ids_used", "provenance")
    return S.plan(tables.chunks(spark, d), _manifests(spark, d), state, glossary=read(spark, d, "glossary"))


def action_summary(spark, d):
    return S.plan_summary(chunk_actions(spark, d))


def merge_gate(spark, d):
    return S.merge_gate(tables.chunks(spark, d), _manifests(spark, d))


def manifest_errors(spark, d):
    return S.manifest_errors(_manifests(spark, d))


def block_coverage(spark, d):
    return S.block_coverage(_manifests(spark, d), tables.blocks(spark, d, "ord"))


def source_cache(spark, d):
    """The newest manifest's source against the oldest one's as the cache."""
    m = read(spark, d, "manifest")
    now = m.groupBy(F.col("doc_id").alias("key")).agg(F.max_by("source_hash", F.struct("revision", "created_at")).alias("checksum"), F.max_by("chunk_count", F.struct("revision", "created_at")).alias("size"))
    old = m.groupBy(F.col("doc_id").alias("key")).agg(F.min_by("source_hash", F.struct("revision", "created_at")).alias("checksum"), F.min_by("chunk_count", F.struct("revision", "created_at")).alias("size"))
    return S.source_cache(now, old)


def block_pairs(spark, d):
    return L.pairs(tables.chunks(spark, d)).select("doc_id", "chunk_id", "pos", F.coalesce("id", F.lit("")).alias("id"), F.length("source_body").alias("n_source"), F.length("output_body").alias("n_output"))


def translation_errors(spark, d):
    return L.translation_errors(L.pairs(tables.chunks(spark, d)), tables.blocks(spark, d, "kind", "translatable"))


def image_diff(spark, d):
    return L.image_diff(tables.chunks(spark, d))


def neighbor_context(spark, d):
    return L.neighbours(tables.chunks(spark, d), 120)


def merged_order(spark, d):
    return L.merged_order(tables.chunks(spark, d))


def bilingual_text(spark, d):
    return L.bilingual(L.pairs(tables.chunks(spark, d))).select("doc_id", "chunk_id", "n_pairs", F.sha2("text", 256).alias("hash"))


def untranslated_blocks(spark, d):
    p = L.pairs(tables.chunks(spark, d)).select("doc_id", "chunk_id", "pos", F.col("output_body").alias("text"))
    return U.untranslated(p, ["doc_id", "chunk_id", "pos"])


def alias_leaks(spark, d):
    """Dropped names in texts; aliases here are in the language of the sources."""
    t = tables.chunks(spark, d, "source").select("doc_id", "chunk_id", F.col("source").alias("text"))
    return U.alias_leaks(t, read(spark, d, "glossary"))


def reference_numbers(spark, d):
    return U.reference_numbers(tables.blocks(spark, d, "ord", "text", "is_reference"))


def crowded_sections(spark, d):
    return U.crowded_sections(tables.blocks(spark, d, "ord", "kind", "level"), 2)


def reference_chunks(spark, d):
    """Chunks of references only; blocks that begin like one count as references."""
    b = tables.blocks(spark, d, "kind", "text", "is_reference").withColumn("is_reference", F.coalesce("is_reference", F.lit(False)) | ~F.col("kind").isin("text", "footnote"))
    return S.reference_chunks(tables.chunks(spark, d, "source"), b)


def term_drift(spark, d):
    return S.term_drift(tables.chunks(spark, d, "source"), read(spark, d, "glossary"), tables.run_state(spark, d, "entity_ids_used"))


def audit_status(spark, d):
    """Each book's worst finding of the merge gate."""
    g = merge_gate(spark, d)
    return U.status(g.select("doc_id", F.when(F.col("error") != "", "error").otherwise("warning").alias("severity")), ["doc_id"])


QUERIES = {f.__name__: f for f in (chunk_actions, action_summary, merge_gate, manifest_errors, block_coverage, source_cache, block_pairs, translation_errors, image_diff, neighbor_context, merged_order, bilingual_text, untranslated_blocks, alias_leaks, reference_numbers, crowded_sections, reference_chunks, term_drift, audit_status)}

_HASH = lambda x: f"regexp_replace(lower(trim({x})), '^(sha-?256\\s*[:=-]?|0x)\\s*', '')"
MF = "mf as (select * exclude (rn) from (select *, row_number() over (partition by doc_id order by revision desc, created_at desc) as rn from manifest) where rn = 1)"
_MC = f"{MF}, mc as (select doc_id, c.id as chunk_id, max({_HASH('c.source_hash')}) as mh, 1 as inm from (select doc_id, unnest(chunks) as c from mf) group by 1, 2)"
_RS = f"rs as (select doc_id, chunk_id, {_HASH('source_hash')} as sh, {_HASH('output_hash')} as oh from (select *, row_number() over (partition by doc_id, chunk_id order by run_no desc, updated_at desc) as rn from run_state where status = 'committed') where rn = 1)"
_BLANK = "regexp_matches(output, '^[\\s\\p{Z}]*$')"
_PLAN = f"""{_OCC}, {_MC}, {_RS},
tn as (select o.doc_id, o.chunk_id, g.source as name, row_number() over (partition by o.doc_id, o.chunk_id order by coalesce(g.frequency, 0) desc, g.source, g.term_key) as rn from o join glossary g on g.term_key = o.term_key where g.source is not null and g.source <> ''),
us as (select doc_id, chunk_id, coalesce(entity_ids_used, []) as ids, provenance from (select *, row_number() over (partition by doc_id, chunk_id order by run_no desc, updated_at desc) as rn from run_state where status = 'committed') where rn = 1),
dr as (select distinct tn.doc_id, tn.chunk_id, true as dr from tn join us on us.doc_id = tn.doc_id and us.chunk_id = tn.chunk_id where tn.rn <= 50 and coalesce(us.provenance, '') <> 'bypassed_reference' and not list_contains(us.ids, tn.name)),
pl as (select c.doc_id, c.chunk_id, case when output is null then 'missing_output' when output = '' then 'empty_output' when {_BLANK} then 'blank_output' when mc.mh <> sha256(source) then 'manifest_source_hash_changed'
  when rs.doc_id is null then 'untracked_existing_output' when rs.sh is distinct from sha256(source) then 'source_hash_changed_since_record' when dr.dr and rs.oh is distinct from sha256(output) then 'glossary_term_selection_changed_ignored,output_hash_changed_since_record'
  when dr.dr then 'glossary_term_selection_changed_ignored' when rs.oh is distinct from sha256(output) then 'output_hash_changed_since_record' else '' end as reason
  from c left join mc using (doc_id, chunk_id) left join rs using (doc_id, chunk_id) left join dr using (doc_id, chunk_id)),
pa as (select doc_id, chunk_id, case when reason in ('', 'glossary_term_selection_changed_ignored') then 'unchanged' when reason = 'untracked_existing_output' or suffix(reason, 'output_hash_changed_since_record') then 'record' else 'translate' end as action, reason from pl)"""
_GATE = f"""{C}, {_MC}, cc as (select c.*, 1 as has from c where doc_id in (select doc_id from mf where chunks is not null)),
g as (select coalesce(cc.doc_id, mc.doc_id) as doc_id, coalesce(cc.chunk_id, mc.chunk_id) as chunk_id, case when inm is null then 'orphan' when has is null then 'missing_source' when mh <> sha256(source) then 'stale_source' when output is null then 'missing_output' when output = '' then 'empty_output' when {_BLANK} then 'blank_output' else '' end as error,
  coalesce(octet_length(encode(source)) > 0 and octet_length(encode(output)) < octet_length(encode(source)) * 0.1, false) as short from mc full outer join cc on cc.doc_id = mc.doc_id and cc.chunk_id = mc.chunk_id),
gt as (select doc_id, chunk_id, error, case when error = '' and short then 'suspiciously_short' else '' end as warning from g where error <> '' or short)"""
_MK = "'(?m)^<!--\\s*tb:(b[0-9]+)\\s*-->[ \\t]*$'"
_PAIRS = f"""{C}, q as (select doc_id, chunk_id, source, output, regexp_extract_all(source, {_MK}, 1) as si, regexp_extract_all(output, {_MK}, 1) as oi, regexp_split_to_array(source, {_MK}) as sp, regexp_split_to_array(output, {_MK}) as op from c where output is not null),
q1 as (select *, len(si) > 0 and {_S('sp[1]')} = '' and len(list_distinct(si)) = len(si) and si = oi and {_S('op[1]')} = '' as ok from q),
pz as (select doc_id, chunk_id, i - 1 as pos, si[i] as id, {_S('sp[i + 1]')} as s, {_S('op[i + 1]')} as o from (select *, unnest(generate_series(1, len(si))) as i from q1 where ok)
  union all select doc_id, chunk_id, 0, '', {_S('source')}, {_S('output')} from q1 where not ok)"""
_IMG = lambda x: f"list_concat(list_transform(regexp_extract_all({x}, '!\\[[^\\]]*\\]\\(([^)\\s]+)[^)]*\\)', 1), lambda r: 'md:' || r), list_transform(regexp_extract_all({x}, '(?i)<img\\b(?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*?\\bsrc\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1), lambda r: 'html:' || r))"
ORACLE = {
    "chunk_actions": f"with {_PLAN} select * from pa",
    "action_summary": f"with {_PLAN}, r as (select *, row_number() over (partition by doc_id, action order by chunk_id) as rn from pa) select doc_id, action, count(*) as n_chunks, string_agg(chunk_id, ',' order by chunk_id) filter (where rn <= 10) as sample from r group by 1, 2",
    "merge_gate": f"with {_GATE} select * from gt",
    "audit_status": f"with {_GATE} select doc_id, case when max(case when error <> '' then 2 else 1 end) = 2 then 'failed' else 'warning' end as status from gt group by 1",
    "manifest_errors": f"""with {MF}, x as (select doc_id, array_to_string(list_sort(list_filter([case when chunks is null then 'no_chunks' end, case when coalesce(chunk_count <> len(coalesce(chunks, [])), true) then 'chunk_count' end,
  case when len(list_distinct(list_transform(chunks, lambda x: x.id))) <> len(chunks) then 'duplicate_id' end, case when len(chunks) > 0 and list_sort(list_transform(chunks, lambda x: x.ord)) is distinct from list_transform(generate_series(1, len(chunks)), lambda x: cast(x as int)) then 'order' end,
  case when len(list_filter(chunks, lambda x: x.id is null or x.source_hash is null or x.output_file is null)) > 0 then 'null_field' end, case when not coalesce(split_complete, false) then 'incomplete' end, case when source_hash is null then 'no_source_hash' end], lambda x: x is not null)), ',') as errors from mf)
select * from x where errors <> ''""",
    "block_coverage": f"""with {MF}, {B}, k as (select doc_id, id, count(*) as k from (select doc_id, unnest(c.block_ids) as id from (select doc_id, unnest(chunks) as c from mf)) group by 1, 2),
bb as (select doc_id, id, 1 as b from b where doc_id in (select doc_id from mf where chunks is not null))
select doc_id, count(*) filter (where k is null) as n_missing, count(*) filter (where b is null) as n_unknown, count(*) filter (where k > 1) as n_repeated from k full outer join bb using (doc_id, id) group by 1""",
    "source_cache": """with r as (select *, row_number() over (partition by doc_id order by revision, created_at) as a, row_number() over (partition by doc_id order by revision desc, created_at desc) as z from manifest)
select n.doc_id as key, case when o.source_hash is null or o.chunk_count is null then 'adopt' when n.source_hash = o.source_hash and n.chunk_count = o.chunk_count then 'reuse' else 'mismatch' end as verdict from (select * from r where z = 1) n join (select * from r where a = 1) o using (doc_id)""",
    "block_pairs": f"with {_PAIRS} select doc_id, chunk_id, pos, id, length(s) as n_source, length(o) as n_output from pz",
    "image_diff": f"""with {C}, x as (select doc_id, chunk_id, unnest({_IMG('source')}) as ref, 1 as v from c where output is not null union all select doc_id, chunk_id, unnest({_IMG('output')}), -1 from c where output is not null)
select doc_id, chunk_id, ref, greatest(cast(sum(v) as bigint), 0) as n_missing, greatest(-cast(sum(v) as bigint), 0) as n_extra from x group by 1, 2, 3 having sum(v) <> 0""",
    "neighbor_context": f"""with {C}, x as (select doc_id, chunk_id, cast(regexp_extract(chunk_id, '[0-9]+') as bigint) as n, source from c)
select x.doc_id, x.chunk_id, coalesce({_S('right(p.source, 120)')}, '') as prev_excerpt, coalesce({_S('left(q.source, 120)')}, '') as next_excerpt from x left join x p on p.doc_id = x.doc_id and p.n = x.n - 1 left join x q on q.doc_id = x.doc_id and q.n = x.n + 1""",
    "merged_order": f"with {C}, x as (select doc_id, chunk_id, ord, length({_S(chr(99) + 'oalesce(output, ' + chr(39) * 2 + ')')}) as n from c) select doc_id, chunk_id, ord, min(n) over (partition by doc_id) > 0 as ready, cast(coalesce(sum(n + 2) over (partition by doc_id order by ord, chunk_id rows between unbounded preceding and 1 preceding), 0) as bigint) as char_from from x",
    "untranslated_blocks": f"""with {_PAIRS}, x as (select doc_id, chunk_id, pos, o as t, length(o) as n_chars, length(regexp_replace(o, '[^\\x00-\\x7F]', '', 'g')) as n_ascii from pz)
select doc_id, chunk_id, pos, n_chars, n_ascii from x where n_chars > 100 and n_ascii / n_chars > 0.85 and not (t like '$$%' or t like '\\[%' or regexp_matches(t, '^[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*\\s*\\d+(?:,\\d+)*') or regexp_matches(t, '(?i)^\\d*\\s*(?:Department|School|Cent(?:er|re)|Institute|University|Faculty|Laborat|Hospital)') or regexp_matches(t, '(?i)https?://|doi\\.org|doi:') or regexp_matches(t, '^[A-Z][^(\\n]+\\(\\d{{4}}\\)\\.'))""",
    "alias_leaks": f"with {_OCC.replace('select doc_id, term_key, source as surface from glossary union all select doc_id, term_key, unnest(aliases) from glossary', 'select doc_id, term_key, ' + _S('a') + ' as surface from (select doc_id, term_key, target, unnest(aliases) as a from glossary where trim(target) <> ' + chr(39) * 2 + ') where ' + _S('a') + ' <> ' + _S('target'))} select * from o",
    "reference_numbers": f"""with {B}, x as (select doc_id, ord, id, cast(nullif(regexp_extract(text, '^\\[?(\\d{{1,9}})(?:\\]|\\.)', 1), '') as int) as num from b where coalesce(is_reference, false)), y as (select *, lag(num) over (partition by doc_id order by ord, id) as pv from x where num is not null)
select doc_id, count(*) as n, min(num) as lowest, max(num) as highest, max(num) - min(num) + 1 - count(distinct num) as n_gaps, count(*) - count(distinct num) as n_repeats, count(*) filter (where num < pv) as n_disorder from y group by 1""",
    "reference_chunks": f"""with {B}, {C}, r as (select doc_id, id, coalesce(is_reference, false) or kind not in ('text', 'footnote') or (kind = 'heading' and coalesce(regexp_matches(lower(text), 'references|参考文献|bibliography'), false)) as ref from b),
i as (select distinct doc_id, chunk_id, unnest(regexp_extract_all(source, '(?m)^<!--\\s*tb:(b[0-9]+)\\s*-->', 1)) as id from c), p as (select i.doc_id, i.chunk_id, count(*) as n_blocks from i left join r using (doc_id, id) group by 1, 2 having min(coalesce(r.ref, false)))
select p.* from p join c using (doc_id, chunk_id) where not regexp_matches(lower(c.source), '{'|'.join(S.MORE_THAN_REFERENCES)}')""",
    "term_drift": f"""with {_OCC}, {_RS.replace("select doc_id, chunk_id, ", "select doc_id, chunk_id, entity_ids_used, ", 1)}, n as (select distinct o.doc_id, o.chunk_id, g.source as name, 1 as n from o join glossary g using (term_key) join rs on rs.doc_id = o.doc_id and rs.chunk_id = o.chunk_id),
t as (select distinct doc_id, chunk_id, unnest(entity_ids_used) as name, 1 as t from rs)
select doc_id, chunk_id, count(n) as n_now, count(t) as n_then, count(*) filter (where t is null) as n_added, count(*) filter (where n is null) as n_dropped from n full outer join t using (doc_id, chunk_id, name) group by 1, 2""",
    "crowded_sections": f"with {B}, h as (select doc_id, coalesce(level, 1) as level, cast(sum(cast(coalesce(level, 1) = 1 as int)) over (partition by doc_id order by ord, id) as int) as section from b where kind = 'heading') select doc_id, section, count(*) as n_below from h where section > 0 and level > 1 group by 1, 2 having count(*) > 2",
}
