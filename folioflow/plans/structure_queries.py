"""Queries over the structure of books, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.context import read
from folioflow.functions import text as T
from folioflow.operators import chunking as C
from folioflow.operators import structure as S
from folioflow.sources import tables

B = "b as (select * exclude (rn) from (select *, row_number() over (partition by doc_id, id order by ingested_at desc) as rn from blocks) where rn = 1)"
STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_S = lambda x: STRIP.format(x)
TARGET, DOC_TARGET = 3_000, 4_000


def _blocks(spark, d, *cols):
    return tables.blocks(spark, d, *(cols or ("ord", "kind", "level", "text", "style_id", "caption_of", "is_reference", "is_running_header", "source_refs")))


def kind_counts(spark, d):
    return _blocks(spark, d, "kind", "text").groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("n_chars"))


def chunk_plan(spark, d):
    return C.block_boundary_chunks(_blocks(spark, d), TARGET).select("doc_id", "id", "size", "chunk_no")


def chunk_manifest(spark, d):
    b = _blocks(spark, d)
    return C.chunk_texts(b, C.block_boundary_chunks(b, TARGET)).select("doc_id", "chunk_no", "n_blocks", "n_chars", "source_hash")


def heading_cuts(spark, d):
    b = _blocks(spark, d)
    return C.cut_chunks(b, b.where("kind = 'heading' and level = 1")).select("doc_id", "id", "chunk_no")


def plan_split(spark, d):
    return C.suggested_cuts(C.landmarks(_blocks(spark, d)), TARGET).select("doc_id", "id", "kind", "char_offset", "cut")


def book_packing(spark, d):
    docs = read(spark, d, "documents").select(F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("doc_id"), F.col("doc_id").alias("ord"), F.length("text").alias("size"), F.col("text").startswith("#").alias("heading"))
    return C.structural_chunks(docs, DOC_TARGET).select(F.col("doc_id").alias("book"), F.col("ord").alias("doc_id"), "chunk_no")


def forced_pieces(spark, d):
    return C.force_split(read(spark, d, "documents"), 2_000).select("doc_id", "piece_no", F.sha2("piece", 256).alias("piece_hash"))


def outline(spark, d):
    return S.outline(_blocks(spark, d)).select("doc_id", "id", "level", "page", "title", "suspect")


def sections(spark, d):
    return S.sections(_blocks(spark, d)).select("doc_id", "id", "section", "in_section")


def reference_state(spark, d):
    return S.reference_state(_blocks(spark, d)).groupBy("doc_id").agg(F.count_if("in_references").alias("n_references"), F.count("*").alias("n"))


def heading_numbers(spark, d):
    return S.heading_numbers(_blocks(spark, d)).select("doc_id", "id", "n1", "n2", "n3", "label")


def continuations(spark, d):
    return S.continuation_groups(_blocks(spark, d)).where("not starts").select("doc_id", "id")


def block_numbers(spark, d):
    return S.block_numbers(_blocks(spark, d))


def caption_targets(spark, d):
    return S.captions_of(_blocks(spark, d))


def caption_order(spark, d):
    return S.hoisted_captions(_blocks(spark, d))


def text_functions(spark, d):
    """All scalar text functions on all blocks."""
    b = _blocks(spark, d).where("text is not null")
    t = F.col("text")
    return b.select(
        "doc_id", "id", T.contains_cjk(t).alias("cjk"), T.normalized(t).alias("normalized"), T.heading_text(t).alias("heading"), T.slug(t).alias("slug"), T.natural_key(F.col("id")).alias("sort_key"), T.cn_ordinal(F.coalesce("level", F.lit(31))).alias("ordinal"),
        T.looks_like_continuation(t).alias("goes_on"), T.caption_parts(t)["label"].alias("label"), T.file_stem(F.lit(None).cast("string"), t, F.col("id")).alias("stem"), T.is_safe_path(t).alias("safe"), T.number_between(t, 1800, 2000).alias("year"),
    )


def joined_lines(spark, d):
    b = _blocks(spark, d, "text").where("text is not null")
    return b.select("doc_id", "id", T.join_lines(F.split("text", r"\r?\n")).alias("joined"))


def slug_ids(spark, d):
    """Heading anchors, unique in their book by a suffix."""
    from pyspark.sql import Window

    h = _blocks(spark, d).where("kind = 'heading'").select("doc_id", "id", "ord", T.slug(F.col("text")).alias("slug"))
    n = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("ord", "id"))
    return h.select("doc_id", "id", F.when(n == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), (n - 1).cast("string"))).alias("anchor"))


QUERIES = {f.__name__: f for f in (kind_counts, chunk_plan, chunk_manifest, heading_cuts, plan_split, book_packing, forced_pieces, outline, sections, reference_state, heading_numbers, continuations, block_numbers, caption_targets, caption_order, text_functions, joined_lines, slug_ids)}

_WIDE = r"[\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{3000}-\x{30FF}]"
_CN = "[" + ", ".join(f"'{c}'" for c in T.CN_ORDINALS) + "]"
_TEXT = _S("coalesce(text, '')")
_MARK = f"'<!-- tb:' || id || ' -->' || chr(10) || {_TEXT} || chr(10)"
_FOLD = f"""with recursive {B},
r as (select doc_id, id, ord, {_MARK} as m, length({_MARK}) as size, coalesce(is_reference, false) as ref, kind = 'heading' and coalesce(level, 3) <= 2 as major,
  row_number() over (partition by doc_id order by ord, id) as rn from b),
f as (
  select doc_id, id, rn, size, size as total, ref, 1 as chunk_no from r where rn = 1
  union all
  select r.doc_id, r.id, r.rn, r.size, case when s.cut then r.size else f.total + r.size end, r.ref, f.chunk_no + cast(s.cut as int)
  from f join r on r.doc_id = f.doc_id and r.rn = f.rn + 1,
  lateral (select r.ref <> f.ref or f.total + r.size > {TARGET} or (r.major and f.total >= {int(TARGET * 0.6)}) as cut) s)
"""
_SLUGGED = "regexp_replace(regexp_replace(regexp_replace(lower(" + _S("regexp_replace(text, '<[^>]*>', '', 'g')") + r"), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g')"
_SLUG = f"case when {_SLUGGED} = '' then 'section' else {_SLUGGED} end"
_NORM = "replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
ORACLE = {
    "kind_counts": f"with {B} select doc_id, kind, count(*) as n, cast(sum(length(text)) as bigint) as n_chars from b group by 1, 2",
    "chunk_plan": _FOLD + "select doc_id, id, size, chunk_no from f",
    "chunk_manifest": _FOLD + r""", g as (select f.doc_id, f.chunk_no, count(*) as n_blocks, regexp_replace(string_agg(r.m, chr(10) order by r.rn), '[\s\p{Z}]+$', '') || chr(10) as t
  from f join r using (doc_id, id) group by 1, 2) select doc_id, chunk_no, n_blocks, length(t) as n_chars, sha256(t) as source_hash from g""",
    "heading_cuts": f"with {B} select doc_id, id, sum(case when rn = 1 then 1 when kind = 'heading' and level = 1 then 1 else 0 end) over (partition by doc_id order by rn) as chunk_no from (select *, row_number() over (partition by doc_id order by ord, id) as rn from b)",
    "plan_split": f"""with recursive {B},
x as (select doc_id, id, ord, kind, {_TEXT} as t, coalesce(is_reference, false) or (kind = 'heading' and regexp_matches(lower({_TEXT}), '^(references?|bibliography|参考文献)($|[^\\p{{L}}\\p{{N}}_])')) as ref, coalesce(is_running_header, false) as run, coalesce(style_id, '') as style from b),
y as (select *, coalesce(sum(length(t)) over (partition by doc_id order by ord, id rows between unbounded preceding and 1 preceding), 0) as off, sum(cast(ref as int)) over (partition by doc_id order by ord, id) as nth from x),
l as (select doc_id, id, case when ref and nth = 1 then 'references' else 'heading' end as kind, cast(off as bigint) as off, row_number() over (partition by doc_id order by ord, id) as rn from y where (ref and nth = 1) or (kind = 'heading' and not run and style <> 'running-header')),
f as (
  select doc_id, id, kind, off, rn, c as cut, case when c then off else 0 end as last from (select *, off >= case when kind = 'references' then 500 else {int(TARGET * 0.7)} end as c from l where rn = 1)
  union all
  select l.doc_id, l.id, l.kind, l.off, l.rn, s.c, case when s.c then l.off else f.last end from f join l on l.doc_id = f.doc_id and l.rn = f.rn + 1, lateral (select l.off - f.last >= case when l.kind = 'references' then 500 else {int(TARGET * 0.7)} end as c) s)
select doc_id, id, kind, off as char_offset, cut from f""",
    "book_packing": f"""with recursive r as (select coalesce(lower(trim(source)), '') as book, doc_id, length(text) as size, text like '#%' as heading, row_number() over (partition by coalesce(lower(trim(source)), '') order by doc_id) as rn from documents),
f as (
  select book, doc_id, rn, 1 as chunk_no, case when size > {2 * DOC_TARGET} then 2 else 1 end as no, case when size > {2 * DOC_TARGET} then 0 else size end as total, size <= {2 * DOC_TARGET} as used from r where rn = 1
  union all
  select r.book, r.doc_id, r.rn, s.at, case when s.big then s.at + 1 else s.at end, case when s.big then 0 when s.cut then r.size else f.total + r.size end, not s.big
  from f join r on r.book = f.book and r.rn = f.rn + 1,
  lateral (select big, cut, f.no + case when big then cast(f.used as int) when cut then 1 else 0 end as at from (select r.size > {2 * DOC_TARGET} as big, (r.heading and f.total > 0) or (f.used and f.total + r.size > {DOC_TARGET}) as cut)) s)
select book, doc_id, chunk_no from f""",
    "outline": f"with {B} select doc_id, id, coalesce(level, 1) as level, source_refs[1].page as page, {_S('text')} as title, coalesce(lower({_S(chr(114) + 'egexp_replace(' + _S('text') + ', ' + chr(39) + '^[一二三四五六七八九十0-9.\\s、]+' + chr(39) + ', ' + chr(39) * 2 + ')')}) in ({', '.join(repr(x) for x in T.RUNNING_HEADERS)}), false) as suspect from b where kind = 'heading'",
    "sections": f"with {B}, s as (select *, cast(sum(cast(kind = 'heading' as int)) over (partition by doc_id order by ord, id) as int) as section from b) select doc_id, id, section, row_number() over (partition by doc_id, section order by ord, id) as in_section from s",
    "reference_state": f"""with {B}, e as (select *, case when kind = 'heading' and lower({_S('text')}) in ({', '.join(repr(x) for x in S.REFERENCE_HEADINGS)}) then 1 when kind = 'heading' and lower({_S('text')}) in ({', '.join(repr(x) for x in S.END_MATTER)}) then 0 end as ev from b),
s as (select *, coalesce(last_value(ev ignore nulls) over (partition by doc_id order by ord, id rows between unbounded preceding and current row), 0) as st from e)
select doc_id, count(*) filter (where st = 1 and kind <> 'heading') as n_references, count(*) as n from s group by 1""",
    "heading_numbers": f"""with {B}, h as (select doc_id, id, ord, least(greatest(coalesce(level, 1), 1), 3) as level from b where kind = 'heading'),
a as (select *, count(*) filter (where level = 1) over (partition by doc_id order by ord, id) as n1 from h), c as (select *, count(*) filter (where level = 2) over (partition by doc_id, n1 order by ord, id) as n2 from a),
d as (select *, count(*) filter (where level = 3) over (partition by doc_id, n1, n2 order by ord, id) as n3 from c)
select doc_id, id, n1, n2, n3, case level when 1 then (case when n1 <= 30 then {_CN}[n1 + 1] else cast(n1 as varchar) end) || '、' when 2 then '（' || (case when n2 <= 30 then {_CN}[n2 + 1] else cast(n2 as varchar) end) || '）' else cast(n3 as varchar) || '.' end as label from d""",
    "continuations": f"""with {B}, t as (select doc_id, id, ord, kind, text, lag(kind = 'text' and not regexp_matches({_S('text')}, '[.!?。！？…:：;；]["''”’)）\\]]*$')) over (partition by doc_id order by ord, id) as open from b where kind in ('text', 'heading'))
select doc_id, id from t where kind = 'text' and open and regexp_matches(text, '^\\s*[\\p{{Ll}}\\p{{Nd}}]')""",
    "block_numbers": f"with {B} select doc_id, id, 'b' || lpad(cast(row_number() over (partition by doc_id order by ord, id) as varchar), 6, '0') as number from b",
    "caption_targets": f"""with {B}, x as (select *, source_refs[1].page as page, case when kind in ('figure', 'table') then id end as f from b),
y as (select *, case when page is not null then last_value(f ignore nulls) over (partition by doc_id, page order by ord, id rows between unbounded preceding and 1 preceding) end as p, last_value(f ignore nulls) over (partition by doc_id order by ord, id rows between unbounded preceding and 1 preceding) as q from x)
select doc_id, id, coalesce(caption_of, p, q) as target, case when caption_of is not null then 'named' when p is not null then 'page' when q is not null then 'before' else 'none' end as way from y where kind = 'caption'""",
    "caption_order": f"""with {B}, x as (select doc_id, id, ord, coalesce(lag(kind) over w = 'table' and kind = 'caption' and regexp_matches(text, '^(表|附表|[Tt][Aa][Bb][Ll][Ee])'), false) as h, lag(ord) over w as po from b window w as (partition by doc_id order by ord, id))
select doc_id, id, row_number() over (partition by doc_id order by case when h then po else ord end, case when h then 0 else 1 end, ord, id) as place from x""",
    "joined_lines": f"""with {B}, l as (select doc_id, id, list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: {_S("x")}), lambda x: x <> '') as l from b where text is not null),
u as (select doc_id, id, l, unnest(generate_series(1, len(l))) as i from l), p as (select doc_id, id, i, case when i = len(l) then l[i] when regexp_matches(l[i], '\\p{{L}}-$') and regexp_matches(l[i + 1], '^\\p{{Ll}}') then regexp_replace(l[i], '-$', '')
  when regexp_matches(l[i], '{_WIDE}$') and regexp_matches(l[i + 1], '^{_WIDE}') then l[i] else l[i] || ' ' end as x from u),
j as (select doc_id, id, string_agg(x, '' order by i) as joined from p group by 1, 2) select l.doc_id, l.id, coalesce(joined, '') as joined from l left join j using (doc_id, id)""",
    "slug_ids": f"with {B}, h as (select doc_id, id, ord, {_SLUG} as slug from b where kind = 'heading'), n as (select *, row_number() over (partition by doc_id, slug order by ord, id) as n from h) select doc_id, id, case when n = 1 then slug else slug || '-' || cast(n - 1 as varchar) end as anchor from n",
    "text_functions": f"""with {B} select doc_id, id, regexp_matches(text, '[\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{3040}}-\\x{{30FF}}\\x{{AC00}}-\\x{{D7AF}}]') as cjk, lower(regexp_replace({_NORM}, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) as normalized,
regexp_replace(regexp_replace({_S('text')}, '^(?:[0-9]+(?:\\.[0-9]+)*[.、)]?\\s+|[一二三四五六七八九十]+、\\s*|[(（](?:[0-9]+|[一二三四五六七八九十]+)[)）]\\s*)', ''), '[.。]$', '') as heading,
{_SLUG} as slug, 'b' || lpad(regexp_extract(id, '[0-9]+'), 20, '0') as sort_key, case when coalesce(level, 31) between 0 and 30 then {_CN}[coalesce(level, 31) + 1] else cast(coalesce(level, 31) as varchar) end as ordinal,
regexp_matches(text, '^\\s*[\\p{{Ll}}\\p{{Nd}}]') as goes_on, regexp_extract(text, '^((?i:fig(?:ure)?|table|图|表)\\.?\\s*[0-9]+)\\s*[.:：。]?\\s*', 1) as label,
trim(substring(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(nullif({_S('text')}, ''), id), 'https?://\\S+|(?i:doi:\\s*)?10\\.[0-9]{{4,9}}/\\S+', '', 'g'), '[\\\\/:*?"<>|]', '', 'g'), '\\s+', ' ', 'g')), 1, 50)) as stem,
trim(text) <> '' and not regexp_matches(text, '^[A-Za-z][A-Za-z0-9+.-]*:|^[/\\\\]|(^|[/\\\\])\\.\\.([/\\\\]|$)') as safe, case when try_cast(text as double) between 1800 and 2000 then try_cast(text as double) end as year
from b where text is not null""",
}
ORACLE = {k: v for k, v in ORACLE.items() if v}
