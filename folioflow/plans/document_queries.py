"""Queries over documents as a whole, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.context import read
from folioflow.functions import detect as D
from folioflow.functions import text as T
from folioflow.operators import align as L
from folioflow.operators import documents as O
from folioflow.operators import geometry as G
from folioflow.operators import render as R
from folioflow.operators import structure as S
from folioflow.operators.terms import relevant_hashes
from folioflow.plans import page_queries as P
from folioflow.plans import state_queries, structure_queries, term_queries
from folioflow.plans.structure_queries import B, TARGET
from folioflow.plans.term_queries import C
from folioflow.sources import tables


def structure_hashes(spark, d):
    return O.structure_hashes(tables.blocks(spark, d, "ord", "kind", "text", "level", "caption_of", "translatable", "is_running_header", "is_reference", "source_refs"))


def _first_ids(spark, d):
    """The first blocks of the chunks that manifests name."""
    m = tables.manifest(spark, d, "chunks").select("doc_id", F.explode("chunks").alias("c"))
    return m.select("doc_id", F.try_element_at("c.block_ids", F.lit(1)).alias("id")).where("id is not null")


def split_runs(spark, d):
    return O.split_run(structure_queries._blocks(spark, d), _first_ids(spark, d), TARGET)


def chunk_term_hashes(spark, d):
    t = tables.chunks(spark, d, "source").select("doc_id", "chunk_id", F.col("source").alias("text"))
    r = relevant_hashes(t, read(spark, d, "glossary"))
    return r.select("doc_id", "chunk_id", F.explode("terms").alias("name", "hash"))


def book_identifiers(spark, d):
    return O.book_identifiers(tables.blocks(spark, d, "ord", "text"))


#: What documents are about, by the first word that they carry.
SUBJECTS = [(1, "(?i)committee|council|ordinance", "administration"), (2, "(?i)standard deviation|control group|specimen", "science"), (3, "(?iu)chapter|kapitel|chapitre|capítulo", "book"), (4, "(?iu)translat|übersetz|tradu", "translation"), (5, r"\p{IsHan}", "chinese")]


def document_subjects(spark, d):
    rules = spark.createDataFrame(SUBJECTS, "priority int, pattern string, name string")
    return D.first_match(read(spark, d, "documents").select("doc_id", "text"), "text", rules, "doc_id")


def merged_texts(spark, d):
    m = O.merged_text(tables.chunks(spark, d, "ord", "output"))
    return m.select("doc_id", "part", "n_chunks", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("hash"))


def continued_texts(spark, d):
    b = structure_queries._blocks(spark, d, "ord", "kind", "text")
    return O.continued_texts(S.continuation_groups(b), b).select("doc_id", "id", "n_blocks", F.sha2("text", 256).alias("hash"))


def reference_order(spark, d):
    return O.reference_order(tables.blocks(spark, d, "ord", "text", "is_reference"))


def glossary_upgrade(spark, d):
    """Books whose glossary can be upgraded, with their terms, and those that are rejected."""
    up, rejected = O.glossary_upgrade(read(spark, d, "glossary").drop("frequency"))
    ok = up.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("frequency").alias("frequency")).withColumn("state", F.lit("upgraded"))
    return ok.unionByName(rejected.groupBy("doc_id").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("frequency")).withColumn("state", F.lit("rejected")))


def blocking_issues(spark, d):
    """Of the findings on merged chunks those that stop a book: outputs that are missing are errors."""
    c = tables.chunks(spark, d, "output")
    issues = c.select("doc_id", "chunk_id", F.when(F.col("output").isNull(), "error").when(T.strip(F.col("output")) == "", "error").when(F.length("output") < 20, "warning").alias("severity")).where("severity is not null")
    return O.blocking(issues).groupBy("doc_id").agg(F.count("*").alias("n"))


def text_layers(spark, d):
    p = P._boxes(spark, d).groupBy("doc_id", "page").agg(F.coalesce(F.sum(F.length(F.trim("text"))), F.lit(0)).alias("n_chars"))
    return O.text_layer(p)


def largest_sources(spark, d):
    return O.largest(tables.chunks(spark, d, "source").select("doc_id", "chunk_id", F.length("source").alias("n_chars")), "doc_id", "chunk_id", "n_chars")


def opf_fields(spark, d):
    """What is read back from a package file made of each document's source and language."""
    t = R.escaped(F.coalesce("source", F.lit("")))
    xml = F.concat(F.lit("<package><metadata><dc:title>"), F.col("doc_id").cast("string"), F.lit("</dc:title><dc:publisher>"), t, F.lit("</dc:publisher><dc:language>"), F.coalesce("lang", F.lit("")), F.lit("</dc:language></metadata></package>"))
    m = O.opf_metadata(F.regexp_replace(xml, "dc:", ""))
    return read(spark, d, "documents").select("doc_id", m.alias("m")).select("doc_id", "m.*")


def tidied_texts(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(O.tidy(F.col("text")), 256).alias("hash"))


def normalised_pages(spark, d):
    """Nested pages made of blocks and read back."""
    b = tables.blocks(spark, d, "ord", "kind", "text", "source_refs").select("doc_id", "id", "ord", "kind", "text", F.try_element_at("source_refs", F.lit(1))["page"].alias("page")).where("page is not null")
    kinds = {v: k for k, v in reversed(O.TYPES.items())}
    type_ = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.col("kind")), F.lit("other"))
    table = F.col("kind") == "table"
    span = F.struct(F.when(~table, F.col("text")).alias("content"), F.when(table, F.concat(F.lit("<table>"), "text", F.lit("</table>"))).alias("html"))
    para = F.struct("ord", "id", type_.alias("type"), F.array(F.struct(F.array(span).alias("spans"))).alias("lines"))
    pages = b.groupBy("doc_id", F.col("page").alias("page_idx")).agg(F.transform(F.array_sort(F.collect_list(para)), lambda x: F.struct(x["type"].alias("type"), x["lines"].alias("lines"))).alias("para_blocks"))
    return O.normalised_pages(pages).select("doc_id", "page", "pos", "kind", F.sha2("markdown", 256).alias("hash"))


def translation_coverage(spark, d):
    """Blocks of books against their translations, from both sides."""
    p = L.pairs(tables.chunks(spark, d, "source", "output"))
    return L.coverage(p, tables.blocks(spark, d, "translatable", "kind")).groupBy("doc_id", "state").agg(F.count("*").alias("n"))


def bilingual_edition(spark, d):
    t = L.pairs(tables.chunks(spark, d, "source", "output")).where("id is not null").groupBy("doc_id", "id").agg(F.min("output_body").alias("body"))
    return R.bilingual_edition(tables.blocks(spark, d, "ord", "kind", "text"), t).select("doc_id", "id", F.sha2("html", 256).alias("hash"))


def edition_sheets(spark, d):
    return R.edition_css(G.page_style(P._boxes(spark, d)))


def ebook_pages(spark, d):
    """Pages made of documents, as e-book makers want them."""
    page = F.concat(F.lit('<html lang="en"><body><p style="text-decoration: underline;">'), R.escaped(F.col("text")), F.lit("</p></body></html>"))
    return read(spark, d, "documents").select("doc_id", F.sha2(R.ebook_html(page, F.lit("a { color: inherit; }\n")), 256).alias("hash"))


def heading_sizes(spark, d):
    """Headings' boxes are as high as others here, so that those above half the usual height count."""
    return G.heading_sizes(P._boxes(spark, d), 0.3)


def column_modes(spark, d):
    return G.column_mode(G.page_columns(P._boxes(spark, d)))


def routed_pages(spark, d):
    return G.routed_pages(P._boxes(spark, d))


def embedded_labels(spark, d):
    """Short texts in figures' boxes or at most 20 points from them."""
    return G.embedded_labels(P._boxes(spark, d), pad=20.0)


def caption_records(spark, d):
    return G.caption_records(P._boxes(spark, d)).select("doc_id", "page", "record", "n_parts", F.sha2("text", 256).alias("hash"))


def image_boxes(spark, d):
    return G.image_boxes(P._boxes(spark, d).where("kind in ('figure', 'table')")).select("doc_id", "page", "n", *(F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")))


def figure_runs(spark, d):
    return G.figure_runs(P._boxes(spark, d).where("kind = 'figure'"))


QUERIES = {f.__name__: f for f in (structure_hashes, split_runs, chunk_term_hashes, book_identifiers, document_subjects, merged_texts, continued_texts, reference_order, glossary_upgrade, blocking_issues, text_layers, largest_sources, opf_fields, tidied_texts, normalised_pages, translation_coverage, bilingual_edition, edition_sheets, ebook_pages, heading_sizes, column_modes, routed_pages, embedded_labels, caption_records, image_boxes, figure_runs)}

_BX, _S = P._BX, structure_queries._S
_NTH = "row_number() over (partition by doc_id order by ord, id)"
_ESC = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_STATE, _STRUCT, _PAGE = state_queries.ORACLE, structure_queries.ORACLE, P.ORACLE
_WIDE = r"[\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{3000}-\x{30FF}]"
ORACLE = {
    "structure_hashes": f"""with {B}, h as (select doc_id, {_NTH} as n, sha256(concat_ws(chr(31), coalesce(id, ''), coalesce(kind, ''), coalesce(text, ''), coalesce(cast(source_refs[1].page as varchar), ''), coalesce(cast(level as varchar), ''), coalesce(caption_of, ''),
  coalesce(cast(translatable as varchar), ''), coalesce(cast(is_running_header as varchar), ''), coalesce(cast(is_reference as varchar), ''))) as h from b),
s as (select doc_id, (n - 1) // 4096 as s, count(*) as k, sha256(string_agg(h, '' order by n)) as h from h group by 1, 2)
select doc_id, cast(sum(k) as bigint) as n_blocks, sha256(string_agg(h, '' order by s)) as structure_hash from s group by 1""",
    "split_runs": f"""with recursive fo as ({_STRUCT['chunk_plan']}), su as ({_STRUCT['plan_split']}), {B},
m as (select doc_id, unnest(chunks) as c from (select *, row_number() over (partition by doc_id order by revision desc, created_at desc) as rn from manifest where doc_id is not null) where rn = 1),
cu as (select distinct m.doc_id, c.block_ids[1] as id from m join b on b.doc_id = m.doc_id and b.id = c.block_ids[1]),
ct as (select doc_id, id, 'custom' as method from cu union all select doc_id, id, 'suggested' from su where cut and doc_id not in (select doc_id from cu)),
o as (select b.doc_id, b.id, ct.id is not null as cut, row_number() over (partition by b.doc_id order by b.ord, b.id) as rn, me.method, b.ord from b join (select distinct doc_id, method from ct) me using (doc_id) left join ct on ct.doc_id = b.doc_id and ct.id = b.id)
select doc_id, id, cast(sum(case when rn = 1 or cut then 1 else 0 end) over (partition by doc_id order by rn) as int) as chunk_no, method from o
union all select doc_id, id, cast(chunk_no as int), 'boundary' from fo where doc_id not in (select doc_id from ct)""",
    "chunk_term_hashes": f"""with {term_queries._OCC}, hs as (select term_key, hash from ({term_queries.ORACLE['term_hashes']})),
r as (select o.doc_id, o.chunk_id, g.source as name, h.hash, g.term_key, row_number() over (partition by o.doc_id, o.chunk_id order by coalesce(g.frequency, 0) desc, g.source, g.term_key) as rn from o join glossary g on g.term_key = o.term_key join hs h on h.term_key = g.term_key where g.source is not null and g.source <> '')
select doc_id, chunk_id, name, arg_max(hash, term_key) as hash from r where rn <= 50 group by 1, 2, 3""",
    "book_identifiers": f"""with {B}, n as (select doc_id, text, {_NTH} as n from b),
x as (select doc_id, min_by(regexp_extract(text, '10\\.[0-9]{{4,9}}/[-._;()/:A-Za-z0-9]+'), n) filter (where n <= 15 and regexp_matches(text, '10\\.[0-9]{{4,9}}/[-._;()/:A-Za-z0-9]+')) as front,
  min_by(regexp_extract(text, '(?i)(?:available at|this paper at|article at)\\s*https?://doi\\.org/(10\\.[0-9]{{4,9}}/[^\\s,;)\\]>]+)', 1), n) filter (where regexp_matches(text, '(?i)(?:available at|this paper at|article at)\\s*https?://doi\\.org/(10\\.[0-9]{{4,9}}/[^\\s,;)\\]>]+)')) as named,
  min_by(regexp_extract(text, '(?i)(?:published(?:\\s*online)?|accepted):\\s*.*?(20[0-9][0-9])', 1), n) filter (where n <= 20 and regexp_matches(text, '(?i)(?:published(?:\\s*online)?|accepted):\\s*.*?(20[0-9][0-9])')) as published,
  min_by(regexp_extract(text, '(?i)(?:received|©):\\s*.*?(20[0-9][0-9])', 1), n) filter (where n <= 20 and regexp_matches(text, '(?i)(?:received|©):\\s*.*?(20[0-9][0-9])')) as received from n group by 1),
f as (select doc_id, rtrim(unnest(regexp_extract_all(text, '10\\.[0-9]{{4,9}}/[-._;()/:A-Za-z0-9]+')), '.') as x, n from n),
g as (select doc_id, arg_max(x, (k, -f, x)) as often from (select doc_id, x, count(*) as k, min(n) as f from f group by 1, 2) where k > 1 group by 1),
y as (select doc_id, published, received, coalesce(rtrim(front, '.'), rtrim(named, '.'), rtrim(often, '.')) as doi, case when front is not null then 'front' when named is not null then 'named' when often is not null then 'often' end as doi_from from x left join g using (doc_id)),
z as (select *, nullif(regexp_extract(coalesce(doi, ''), '-0?([0-9]{{2,4}})-', 1), '') as i from y)
select doc_id, doi, doi_from, cast(coalesce(published, received, case when length(i) = 2 then '20' || i else i end, '2024') as int) as year, case when published is not null then 'published' when received is not null then 'received' when i is not null then 'doi' else 'default' end as year_from from z""",
    "document_subjects": r"""select * from (select doc_id, case when regexp_matches(text, '(?i)committee|council|ordinance') then 'administration' when regexp_matches(text, '(?i)standard deviation|control group|specimen') then 'science'
when regexp_matches(text, '(?i)chapter|kapitel|chapitre|capítulo') then 'book' when regexp_matches(text, '(?i)translat|übersetz|tradu') then 'translation' when regexp_matches(text, '\p{Han}') then 'chinese' end as name from documents) where name is not null""",
    "merged_texts": f"""with {C}, x as (select doc_id, chunk_id, ord, {_S("coalesce(output, '')")} as t from c), y as (select *, row_number() over (partition by doc_id order by ord, chunk_id) as n from x where doc_id not in (select doc_id from x where t = '')),
z as (select doc_id, cast((n - 1) // 1000 as int) as part, count(*) as n_chunks, string_agg(t, chr(10) || chr(10) order by n) as t from y group by 1, 2) select doc_id, part, n_chunks, length(t) as n_chars, sha256(t) as hash from z""",
    "continued_texts": f"""with co as ({_STRUCT['continuations']}), {B}, t as (select b.doc_id, b.id, b.ord, {_S("coalesce(b.text, '')")} as t, co.id is null as starts from b left join co using (doc_id, id) where b.kind in ('text', 'heading')),
g as (select *, sum(cast(starts as int)) over (partition by doc_id order by ord, id) as g from t), l as (select *, lead(t) over (partition by doc_id, g order by ord, id) as nx, row_number() over (partition by doc_id, g order by ord, id) as rn from g),
p as (select doc_id, g, id, ord, rn, case when nx is null then t when regexp_matches(t, '\\p{{L}}-$') and regexp_matches(nx, '^\\p{{Ll}}') then regexp_replace(t, '-$', '') when regexp_matches(t, '{_WIDE}$') and regexp_matches(nx, '^{_WIDE}') then t else t || ' ' end as x from l)
select doc_id, min(id) filter (where rn = 1) as id, cast(count(*) as int) as n_blocks, sha256(string_agg(x, '' order by rn)) as hash from p group by doc_id, g""",
    "reference_order": f"with {B}, r as (select doc_id, id, ord, try_cast(regexp_extract(text, '^\\[?([0-9]{{1,6}})(?:\\]|\\.)', 1) as int) as num from b where coalesce(is_reference, false)) select doc_id, id, num, row_number() over (partition by doc_id order by coalesce(cast(num as bigint), 1099511627776 + ord), ord, id) as place from r",
    "glossary_upgrade": f"""with n as (select doc_id, {_S("coalesce(source, '')")} as s, count(*) as n from glossary where doc_id is not null group by 1, 2), r as (select doc_id, count(*) as n from n where n > 1 or s = '' group by 1)
select doc_id, count(*) as n, cast(0 as bigint) as frequency, 'upgraded' as state from glossary where doc_id is not null and doc_id not in (select doc_id from r) group by 1 union all select doc_id, n, 0, 'rejected' from r""",
    "blocking_issues": f"with {C} select doc_id, count(*) as n from c where output is null or {_S('output')} = '' group by 1",
    "text_layers": f"""with {_BX}, p as (select doc_id, page, coalesce(sum(length(trim(text))), 0) as k from x group by 1, 2), i as (select *, row_number() over (partition by doc_id order by page) - 1 as i, greatest(1, count(*) over (partition by doc_id) // 8) as step from p)
select doc_id, count(*) as n_sampled, round(sum(k) / count(*), 4) as mean_chars, sum(k) / count(*) >= 32 as has_text from i where i % step = 0 and i / step < 8 group by 1""",
    "largest_sources": f"with {C} select doc_id, chunk_id, n_chars from (select doc_id, chunk_id, length(source) as n_chars, row_number() over (partition by doc_id order by coalesce(length(source), -1) desc, chunk_id) as rn from c) where rn = 1",
    "opf_fields": r"""select doc_id, cast(doc_id as varchar) as title, cast(null as varchar) as creator, nullif(regexp_replace(coalesce(source, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') as publisher, nullif(coalesce(lang, ''), '') as language from documents""",
    "tidied_texts": "select doc_id, sha256(replace(replace(text, chr(65279), ''), chr(160), ' ')) as hash from documents",
    "normalised_pages": f"""with {B}, p as (select doc_id, ord, id, kind, text, source_refs[1].page as page from b where source_refs[1].page is not null), q as (select *, cast(row_number() over (partition by doc_id, page order by ord, id) - 1 as int) as pos, {_S("coalesce(text, '')")} as t from p)
select doc_id, page, pos, case when kind in ('heading', 'formula', 'figure', 'table', 'caption') then kind else 'text' end as kind, sha256(case kind when 'heading' then '# ' || t when 'formula' then '$$' || chr(10) || t || chr(10) || '$$' when 'table' then '<table>' || text || '</table>' else t end) as hash
from q where (kind <> 'table' and t <> '') or (kind = 'table' and text is not null)""",
    "translation_coverage": f"""with p as (select distinct doc_id, id from ({_STATE['block_pairs']}) where id is not null and id <> ''), {B}
select doc_id, case when b.id is null then 'unknown' when p.id is not null then 'translated' when coalesce(b.translatable, true) then 'missing' else 'fixed' end as state, count(*) as n from b full outer join p using (doc_id, id) group by 1, 2""",
    "edition_sheets": f"""select doc_id, printf('@page {{ margin: %.1fpt %.1fpt; }}', top, "left") || chr(10) || printf('body {{ font-family: Georgia; font-size: %.1fpt; line-height: 1.5; }}', greatest(8.0, least(16.0, round(height / 1.5, 1)))) || chr(10) as css from ({_PAGE['page_style']})""",
    "ebook_pages": f"""select doc_id, sha256('<html lang="en"><head><style>' || chr(10) || 'a {{ color: inherit; }}' || chr(10) || '</style></head><body><p>' || regexp_replace({_ESC('text')}, '(?i)text-decoration\\s*:\\s*underline\\s*;?', '', 'g') || '</p></body></html>') as hash from documents""",
    "heading_sizes": f"""with {_BX}, st as ({_PAGE['page_style']}), h as (select distinct x.doc_id, round(y1 - y0, 1) as size from x where kind = 'heading'), r as (select h.doc_id, size, row_number() over (partition by h.doc_id order by size desc) as place from h join st using (doc_id) where size >= 0.3 * st.height)
select doc_id, size, cast(place as int) as place from r where place <= 6""",
    "column_modes": f"with pc as ({_PAGE['page_columns']}), n as (select doc_id, columns, count(*) as k from pc group by 1, 2) select doc_id, columns from (select *, row_number() over (partition by doc_id order by k desc, columns) as rn from n) where rn = 1",
    "routed_pages": f"""with {_BX}, pc as ({_PAGE['page_columns']}), pr as ({_PAGE['page_route']}), p as (select doc_id, page, coalesce(sum(length(text)), 0) as k, count(*) filter (where kind = 'formula') as f from x group by 1, 2)
select p.doc_id, p.page, case when pr.scan_like and k < 20 then 'scan' when f > 0 or pc.columns = 2 then 'layout' else 'text' end as route from p left join pc on pc.doc_id = p.doc_id and pc.page = p.page join pr on pr.doc_id = p.doc_id""",
    "embedded_labels": f"""with {_BX}, f as (select doc_id, page, id as figure, x0, y0, x1, y1 from x where kind = 'figure'), t as (select * from x where kind = 'text' and length(trim(text)) between 1 and 120 and not regexp_matches(text, '^\\s*(?i:fig(?:ure)?|table|图|表)\\.?\\s*[0-9]'))
select t.doc_id, t.page, f.figure, t.id from t join f on f.doc_id = t.doc_id and f.page = t.page where least(t.x1, f.x1) - greatest(t.x0, f.x0) > 0 and least(t.y1, f.y1) - greatest(t.y0, f.y0) > -20""",
    "caption_records": f"""with {_BX}, c as (select *, cast(regexp_matches(text, '^\\s*(?i:fig(?:ure)?|table|图|表)\\.?\\s*[0-9]') as int) as st from x where kind = 'caption' and trim(text) <> ''),
r as (select *, cast(sum(st) over (partition by doc_id, page order by x0, y0, id) as int) as record, max(st) over (partition by doc_id, page) as a from c)
select doc_id, page, record, count(*) as n_parts, sha256(string_agg(trim(text), ' ' order by x0, y0, id)) as hash from r where record > 0 or a = 0 group by 1, 2, 3""",
    "figure_runs": f"""with {_BX}, f as (select *, lag(x0) over w as a0, lag(y0) over w as b0, lag(x1) over w as a1, lag(y1) over w as b1 from x where kind = 'figure' window w as (partition by doc_id, page order by y0, x0, id)),
o as (select *, least(x1, a1) - greatest(x0, a0) as h, least(y1, b1) - greatest(y0, b0) as v from f), n as (select *, case when coalesce((v >= 0.5 * least(y1 - y0, b1 - b0) and -h <= 90) or (h >= 0.5 * least(x1 - x0, a1 - a0) and -v <= 36), false) then 0 else 1 end as nw from o),
r as (select *, cast(sum(nw) over (partition by doc_id, page order by y0, x0, id) as int) as run from n) select doc_id, page, run, count(*) as n from r group by 1, 2, 3""",
}
_SHOWN = f"""case when kind in ('figure', 'formula') then coalesce(b.text, '') when tr.body is not null then '<div class="orig">' || {_ESC("coalesce(b.text, '')")} || '</div><div class="trans">' || {_ESC("tr.body")} || '</div>' else {_ESC("coalesce(b.text, '')")} end"""
ORACLE["bilingual_edition"] = f"""with {state_queries._PAIRS}, tr as (select doc_id, id, min(o) as body from pz where id is not null and id <> '' group by 1, 2), {B}
select b.doc_id, b.id, sha256('<section class="block ' || coalesce(b.kind, 'text') || '">' || {_SHOWN} || '</section>') as hash from b left join tr using (doc_id, id)"""
