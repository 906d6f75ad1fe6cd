"""Queries over glossaries and observations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.context import read
from folioflow.operators import observations as O
from folioflow.operators import terms as T
from folioflow.operators.graph import reachable
from folioflow.plans.structure_queries import B
from folioflow.sources import tables


def _texts(spark, d):
    return tables.chunks(spark, d, "source").select("doc_id", "chunk_id", F.col("source").alias("text"))


def term_frequency(spark, d):
    return T.frequencies(_texts(spark, d), read(spark, d, "glossary"))


def terms_in_chunks(spark, d):
    return T.occurrences(_texts(spark, d), read(spark, d, "glossary"))


def selected_terms(spark, d):
    return T.selected(_texts(spark, d), read(spark, d, "glossary"), 5, 12)


def term_tables(spark, d):
    g = read(spark, d, "glossary")
    return T.term_table(T.selected(_texts(spark, d), g, 5, 12), g).select("doc_id", "chunk_id", F.length("table").alias("n_chars"), F.sha2("table", 256).alias("hash"))


def candidate_terms(spark, d):
    return T.candidates(tables.blocks(spark, d, "text", "is_reference"))


def seed_terms(spark, d):
    return T.seeds(T.candidates(tables.blocks(spark, d, "text", "is_reference")), read(spark, d, "glossary")).select("doc_id", "source", "kind", "frequency")


def glossary_errors(spark, d):
    return T.glossary_errors(read(spark, d, "glossary"))


def term_hashes(spark, d):
    c = F.col
    return read(spark, d, "glossary").select("term_key", T.term_hash(c("source"), c("target"), c("category"), c("aliases"), c("gender"), c("gender_conflict")).alias("hash"))


def meta_errors(spark, d):
    return O.errors(read(spark, d, "meta_obs"))


def merge_routing(spark, d):
    return O.routed(read(spark, d, "meta_obs"), read(spark, d, "glossary"))


def alias_chain(spark, d):
    return O.alias_chain(read(spark, d, "meta_obs"), read(spark, d, "glossary"))


def alias_reach(spark, d):
    """Names that lead to a name of the glossary, over any number of hypotheses."""
    m, g = read(spark, d, "meta_obs"), read(spark, d, "glossary")
    links = O.alias_candidates(m).select("doc_id", F.col("variant").alias("node"), F.col("candidate").alias("via"))
    return reachable(links, O.surface_index(g).select("doc_id", F.col("surface").alias("node")), ["doc_id"])


def applied_decisions(spark, d):
    """All proposals, with their greatest target, and all aliases, with their least owner."""
    m, g = read(spark, d, "meta_obs"), read(spark, d, "glossary")
    null = F.lit(None).cast("string")
    create = O.proposals(m).groupBy("doc_id", F.lit("create").alias("kind"), F.col("source").alias("name")).agg(F.max("target").alias("target"), F.max("category").alias("category")).withColumn("alias_of", null)
    alias = O.alias_candidates(m).groupBy("doc_id", F.lit("alias").alias("kind"), F.col("variant").alias("name")).agg(F.min("candidate").alias("alias_of")).select("doc_id", "kind", "name", null.alias("target"), null.alias("category"), "alias_of")
    return O.applied(create.unionByName(alias), g)


def evidence_refs(spark, d):
    return O.evidence(read(spark, d, "meta_obs"))


def gender_fold(spark, d):
    return O.genders(read(spark, d, "meta_obs"))


def field_conflicts(spark, d):
    return O.field_conflicts(read(spark, d, "meta_obs"), read(spark, d, "glossary"))


QUERIES = {f.__name__: f for f in (term_frequency, terms_in_chunks, selected_terms, term_tables, candidate_terms, seed_terms, glossary_errors, term_hashes, meta_errors, merge_routing, alias_chain, alias_reach, applied_decisions, evidence_refs, gender_fold, field_conflicts)}

C = "c as (select * exclude (rn) from (select *, row_number() over (partition by doc_id, chunk_id order by revision desc, arrived_at desc) as rn from chunks) where rn = 1)"
_CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
_DOUBLE = lambda x: f"regexp_replace({x}, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')"
_OCC = f"""{C},
sf as (select distinct doc_id, term_key, surface from (select doc_id, term_key, source as surface from glossary union all select doc_id, term_key, unnest(aliases) from glossary)
  where surface is not null and surface <> '' and not (regexp_matches(surface, '{_CJK}') and length(surface) <= 1) and doc_id is not null),
oc as (select c.doc_id, c.chunk_id, sf.term_key, case when regexp_matches(surface, '^[\\x00-\\x7F]*$')
    then len(regexp_extract_all({_DOUBLE('source')}, '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape({_DOUBLE('surface')}) || '($|[^\\p{{L}}\\p{{N}}_])'))
    else cast((length(source) - length(replace(source, surface, ''))) / length(surface) as bigint) end as n
  from c join sf on sf.doc_id = c.doc_id where contains(c.source, sf.surface)),
o as (select doc_id, chunk_id, term_key, cast(sum(n) as bigint) as n from oc where n > 0 group by 1, 2, 3)"""
_SEL = f"""{_OCC},
k as (select doc_id, term_key, coalesce(source, '') as source, coalesce(frequency, 0) as fq from glossary),
e as (select c.doc_id, c.chunk_id, k.term_key, k.source, k.fq, o.n is not null and k.source <> '' as local from c join k on k.doc_id = c.doc_id left join o on o.doc_id = c.doc_id and o.chunk_id = c.chunk_id and o.term_key = k.term_key),
e1 as (select *, row_number() over (partition by doc_id, chunk_id, local order by fq desc, source, term_key) as own from e),
e2 as (select *, row_number() over (partition by doc_id, chunk_id order by local desc, fq desc, source, term_key) as rank from e1 where local or own <= 5),
sel as (select doc_id, chunk_id, term_key, local, rank from e2 where rank <= 12)"""
_CAND = f"""{B}, t as (select doc_id, {_DOUBLE('text')} as x from b where text is not null and not coalesce(is_reference, false)),
ca as (select doc_id, replace(unnest(regexp_extract_all(x, '(^|[^\\p{{L}}\\p{{N}}_])([A-Z0-9]{{2,}}(//[A-Z0-9]{{2,}})*)($|[^\\p{{L}}\\p{{N}}_])', 2)), '//', '/') as source, 'acronym' as kind from t
  union all select doc_id, lower(replace(unnest(regexp_extract_all(x, '(^|[^\\p{{L}}\\p{{N}}_])([a-zA-Z]{{2,}}(--[a-zA-Z]{{2,}})+)($|[^\\p{{L}}\\p{{N}}_])', 2)), '--', '-')), 'compound' from t),
cb as (select doc_id, source, kind, count(*) as frequency from ca where not regexp_matches(source, '^[0-9]+$') and source not in ({', '.join(f"'{x}'" for x in (*T.STOP_CAPITALS, *T.STOP_COMPOUNDS))}) group by 1, 2, 3),
cd as (select * from (select *, row_number() over (partition by doc_id order by frequency desc, kind, source) as rank from cb) where rank <= 30)"""
_M = """m0 as (select * exclude (rn) from (select *, row_number() over (partition by doc_id, chunk_id order by arrived_at desc, schema_version desc nulls last) as rn from meta_obs) where rn = 1),
me as (select doc_id, chunk_id, list_filter([
  case when schema_version is null then 'no_version' end, case when schema_version <> 1 then 'version' end,
  case when len(list_filter(new_entities, lambda x: coalesce(length(x.evidence) > 200, true))) > 0 then 'evidence:new_entities' end, case when len(list_filter(alias_hypotheses, lambda x: coalesce(length(x.evidence) > 200, true))) > 0 then 'evidence:alias_hypotheses' end,
  case when len(list_filter(attribute_hypotheses, lambda x: coalesce(length(x.evidence) > 200, true))) > 0 then 'evidence:attribute_hypotheses' end, case when len(list_filter(conflicts, lambda x: coalesce(length(x.evidence) > 200, true))) > 0 then 'evidence:conflicts' end,
  case when len(list_filter(new_entities, lambda x: coalesce(trim(x.source) = '', true))) > 0 then 'blank:source' end, case when len(list_filter(new_entities, lambda x: coalesce(trim(x.target_proposal) = '', true))) > 0 then 'blank:target' end,
  case when len(list_filter(alias_hypotheses, lambda x: coalesce(trim(x.variant) = '', true))) > 0 then 'blank:variant' end, case when len(list_filter(alias_hypotheses, lambda x: coalesce(trim(x.may_be_alias_of_source) = '', true))) > 0 then 'blank:alias_of' end
  ], lambda x: x is not null) as e from m0),
m as (select m0.* from m0 join me using (doc_id, chunk_id) where len(me.e) = 0)"""
_R = _M + """,
ix as (select doc_id, surface, term_key as owner, role, target, category from (select *, row_number() over (partition by doc_id, surface order by term_key desc, case when role = 'alias' then 1 else 0 end desc) as rn from
  (select doc_id, source as surface, term_key, 'source' as role, target, category from glossary union all select doc_id, unnest(aliases), term_key, 'alias', target, category from glossary) where surface is not null and doc_id is not null) where rn = 1),
ne as (select doc_id, chunk_id, unnest(new_entities) as e from m),
pr as (select doc_id, e.source as name, e.target_proposal as target, coalesce(e.category, '') as category, count(distinct chunk_id) as n_chunks from ne group by 1, 2, 3, 4),
p1 as (select pr.doc_id, pr.name, count(*) as n_variants, count(*) filter (where not (pr.target is not distinct from ix.target and pr.category = coalesce(ix.category, ''))) as df, any_value(ix.role) as role from pr left join ix on ix.doc_id = pr.doc_id and ix.surface = pr.name group by 1, 2),
ah as (select doc_id, chunk_id, unnest(alias_hypotheses) as a from m),
al as (select doc_id, a.variant as variant, a.may_be_alias_of_source as candidate from ah group by 1, 2, 3),
a1 as (select doc_id, variant as name, count(*) as n_candidates from al where not exists (select 1 from ix where ix.doc_id = al.doc_id and ix.surface = al.variant) group by 1, 2),
rt as (select doc_id, name, case when n_variants is null then (case when n_candidates >= 2 then 'alias_or_new_entity' end) when n_candidates is not null then 'alias_or_new_entity'
    when role = 'source' then (case when df > 0 then 'existing_entity_conflict' else 'no_change' end) when role = 'alias' then 'new_entity_existing_alias' when n_variants = 1 then 'auto_apply' else 'conflicting_new_entity_proposals' end as kind,
    coalesce(n_variants, 0) as n_variants, coalesce(n_candidates, 0) as n_candidates from p1 full outer join a1 using (doc_id, name))"""
ORACLE = {
    "term_frequency": f"with {_OCC} select g.doc_id, g.term_key, cast(coalesce(sum(o.n), 0) as bigint) as frequency from (select distinct doc_id, term_key from glossary where doc_id is not null) g left join o using (doc_id, term_key) group by 1, 2",
    "terms_in_chunks": f"with {_OCC} select * from o",
    "selected_terms": f"with {_SEL} select * from sel",
    "term_tables": f"""with {_SEL}, x as (select sel.doc_id, sel.chunk_id, sel.rank, '| ' || replace(coalesce(g.source, ''), '|', '\\|') || ' | ' || replace(coalesce(array_to_string(g.aliases, ', '), ''), '|', '\\|') || ' | ' || replace(coalesce(g.target, ''), '|', '\\|') || ' |' as r,
  case when coalesce(gender_conflict, false) then '- ' || replace(coalesce(g.source, ''), chr(10), ' ') || ': gender unresolved (conflicting evidence); do not infer gender.' when coalesce(gender, 'unknown') <> 'unknown' then '- ' || replace(coalesce(g.source, ''), chr(10), ' ') || ': gender=' || gender end as note
  from sel join glossary g on g.term_key = sel.term_key),
y as (select doc_id, chunk_id, '| 原文 | 别名 | 译文 |' || chr(10) || '|------|------|------|' || chr(10) || string_agg(r, chr(10) order by rank) || coalesce(chr(10) || chr(10) || 'Entity attributes:' || chr(10) || string_agg(note, chr(10) order by rank) filter (where note is not null), '') as t from x group by 1, 2)
select doc_id, chunk_id, length(t) as n_chars, sha256(t) as hash from y""",
    "candidate_terms": f"with {_CAND} select * from cd",
    "seed_terms": f"with {_CAND} select doc_id, source, kind, frequency from cd where not exists (select 1 from glossary g where g.doc_id = cd.doc_id and lower(g.source) = lower(cd.source))",
    "glossary_errors": """with sf as (select distinct doc_id, term_key, surface from (select doc_id, term_key, source as surface from glossary union all select doc_id, term_key, unnest(aliases) from glossary) where surface is not null and surface <> '' and doc_id is not null),
cl as (select distinct term_key from sf join (select doc_id, surface from sf group by 1, 2 having min(term_key) <> max(term_key)) using (doc_id, surface)),
x as (select term_key, array_to_string(list_sort(list_filter([case when coalesce(trim(source) = '', true) then 'no_source' end, case when coalesce(trim(target) = '', true) then 'no_target' end, case when aliases is null then 'null_aliases' end, case when list_contains(coalesce(aliases, []), source) then 'alias_is_source' end,
  case when coalesce(gender, '') not in ('male', 'female', 'nonbinary', 'unknown') then 'gender' end, case when coalesce(confidence, '') not in ('low', 'medium', 'high') then 'confidence' end, case when coalesce(frequency, -1) < 0 then 'frequency' end, case when term_key in (select term_key from cl) then 'surface_not_unique' end], lambda x: x is not null)), ',') as errors from glossary)
select * from x where errors <> ''""",
    "term_hashes": """select term_key, sha256(coalesce(source, '') || '→' || coalesce(target, '') || '|' || coalesce(category, '') || case when len(coalesce(aliases, [])) > 0 then '|aliases=["' || array_to_string(list_sort(aliases), '", "') || '"]' else '' end
  || case when coalesce(gender, 'unknown') <> 'unknown' then '|gender=' || gender else '' end || case when coalesce(gender_conflict, false) then '|gender_conflict=true' else '' end) as hash from glossary""",
    "meta_errors": f"with {_M} select doc_id, chunk_id, array_to_string(list_sort(e), ',') as errors from me where len(e) > 0",
    "merge_routing": f"with {_R} select * from rt where kind is not null",
    "alias_chain": f"""with recursive {_R},
st as (select doc_id, name as node from rt where kind is not null and kind <> 'no_change' union select doc_id, surface from ix),
fr as (select doc_id, variant as node, min(candidate) as via from al where not exists (select 1 from st where st.doc_id = al.doc_id and st.node = al.variant) group by 1, 2 having count(*) = 1),
rc as (select fr.doc_id, fr.node from fr join st on st.doc_id = fr.doc_id and st.node = fr.via union select fr.doc_id, fr.node from fr join rc on rc.doc_id = fr.doc_id and rc.node = fr.via)
select doc_id, node as variant from rc""",
    "alias_reach": f"""with recursive {_R}, rc as (select al.doc_id, al.variant as node from al join ix on ix.doc_id = al.doc_id and ix.surface = al.candidate union select al.doc_id, al.variant from al join rc on rc.doc_id = al.doc_id and rc.node = al.candidate) select * from rc""",
    "applied_decisions": f"""with recursive {_R}, de as (select distinct doc_id, 'create' as kind, name, cast(null as varchar) as via from pr union all select doc_id, 'alias', variant, min(candidate) from al group by 1, 3),
st as (select doc_id, surface as node from ix union select doc_id, name from de where kind = 'create'),
rc as (select de.doc_id, de.name as node from de join st on st.doc_id = de.doc_id and st.node = de.via where kind = 'alias' union select de.doc_id, de.name from de join rc on rc.doc_id = de.doc_id and rc.node = de.via where kind = 'alias'),
x as (select de.doc_id, de.name, kind, case when ix.owner is not null then 'exists' when count(*) over (partition by de.doc_id, de.name) > 1 then 'twice' when kind = 'alias' and rc.node is null then 'unreached' else '' end as error
  from de left join ix on ix.doc_id = de.doc_id and ix.surface = de.name left join rc on rc.doc_id = de.doc_id and rc.node = de.name)
select doc_id, name, kind, max(error) over (partition by doc_id) = '' as ok, error from x""",
    "evidence_refs": f"""with {_M}, x as (select distinct doc_id, chunk_id, arrived_at, e.source as source from (select doc_id, chunk_id, arrived_at, unnest(new_entities) as e from m)),
y as (select *, row_number() over (partition by doc_id, source order by arrived_at desc, chunk_id desc) as rn from x)
select doc_id, source, string_agg(chunk_id, ',' order by rn desc) as refs, count(*) as n_refs, case when count(*) >= 3 then 'high' when count(*) = 2 then 'medium' else 'low' end as confidence from y where rn <= 5 group by 1, 2""",
    "gender_fold": f"""with recursive {_M}, x as (select doc_id, chunk_id, arrived_at, unnest(attribute_hypotheses) as a, generate_subscripts(attribute_hypotheses, 1) as i from m),
y as (select doc_id, a.entity_source as entity, a.value as v, row_number() over (partition by doc_id, a.entity_source order by arrived_at, chunk_id, i) as rn from x where a.attribute = 'gender'),
f as (select doc_id, entity, rn, v as gender, false as conflict from y where rn = 1
  union all select y.doc_id, y.entity, y.rn, case when f.conflict then 'unknown' when f.gender = 'unknown' then y.v when y.v <> f.gender then 'unknown' else f.gender end, f.conflict or (f.gender <> 'unknown' and y.v <> f.gender) from f join y on y.doc_id = f.doc_id and y.entity = f.entity and y.rn = f.rn + 1)
select doc_id, entity, gender, conflict from (select *, row_number() over (partition by doc_id, entity order by rn desc) as l from f) where l = 1""",
    "field_conflicts": f"""with {_R}, x as (select distinct doc_id, c.entity_source as entity, c.field as field, c.observed_better as proposed from (select doc_id, unnest(conflicts) as c from m))
select x.doc_id, x.entity, x.field, case field when 'target' then ix.target when 'category' then ix.category end as current, x.proposed from x join ix on ix.doc_id = x.doc_id and ix.surface = x.entity""",
}
