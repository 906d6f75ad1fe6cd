"""Queries over pages, Markdown, HTML and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.context import read
from folioflow.functions import detect as D
from folioflow.operators import geometry as G
from folioflow.operators import html_audit as A
from folioflow.operators import markdown as M
from folioflow.operators import render as R
from folioflow.plans.structure_queries import B
from folioflow.plans.term_queries import C
from folioflow.sources import tables
from folioflow.streaming import merge as S


def _boxes(spark, d):
    return G.boxes(tables.blocks(spark, d, "kind", "text", "source_refs"), "kind", "text")


def reading_order(spark, d):
    return G.reading_order(_boxes(spark, d).drop("kind", "text"))


def covered_text(spark, d):
    """Figures and tables within the box around their page's text."""
    b = _boxes(spark, d)
    body = b.where("kind = 'text'").groupBy("doc_id", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).withColumn("id", F.lit("page"))
    return G.covered(b.where("kind in ('figure', 'table')").drop("kind", "text"), body).select("doc_id", "id")


def figure_groups(spark, d):
    return G.figure_groups(_boxes(spark, d).where("kind = 'figure'").drop("kind", "text")).select("doc_id", "page", "figure", "n", *(F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")))


def page_style(spark, d):
    return G.page_style(_boxes(spark, d))


def page_columns(spark, d):
    return G.page_columns(_boxes(spark, d))


def page_route(spark, d):
    return G.page_route(_boxes(spark, d))


def nearest_level(spark, d):
    """Each heading's nearest of three heights."""
    b = _boxes(spark, d).where("kind = 'heading'").withColumn("h", F.col("y1") - F.col("y0"))
    return b.select("doc_id", "id", G.nearest(b, "h", [12.0, 25.0, 38.0]).alias("level"))


def page_number_lines(spark, d):
    """Lines of digits in a rising sequence, over all lines of a book."""
    return M.book_page_lines(tables.blocks(spark, d, "ord", "text"))


def cleaned_exports(spark, d):
    """Every block that cleaning changes, as it is then."""
    b = tables.blocks(spark, d, "text").select("doc_id", "id", "text", M.cleaned(F.col("text")).alias("clean"))
    return b.where("not clean <=> text").select("doc_id", "id", F.col("clean").alias("text"))


def structural_blocks(spark, d):
    r = M.block_rows(read(spark, d, "documents"), ["doc_id"])
    return r.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def blank_line_parts(spark, d):
    return M.part_rows(read(spark, d, "documents"), ["doc_id"]).select("doc_id", "pos", F.length("part").alias("n_chars"))


def rendered_html(spark, d):
    docs = read(spark, d, "documents").select("doc_id", M.html_of(F.col("text")).alias("html"))
    return docs.select("doc_id", F.length("html").alias("n_chars"), F.sha2("html", 256).alias("hash"))


def document_toc(spark, d):
    docs = read(spark, d, "documents").where("text rlike '(?m)^#{1,6} '").select("doc_id", M.html_of(F.col("text")).alias("html"))
    return M.toc(docs, ["doc_id"])


def patched_outputs(spark, d):
    """Term patching on sources, whose books' aliases occur in them."""
    t = tables.chunks(spark, d, "source").select("doc_id", "chunk_id", F.col("source").alias("text"))
    return M.patch_terms(t, read(spark, d, "glossary")).select("doc_id", "chunk_id", "n", F.sha2("text", 256).alias("hash"))


def edition_blocks(spark, d):
    return R.edition(tables.blocks(spark, d, "ord", "kind", "level", "text", "caption_of")).select("doc_id", "id", F.sha2("html", 256).alias("hash"))


def language_settings(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang")
    return docs.join(F.broadcast(R.languages(spark)), F.lower("lang") == F.col("code"), "left").select("doc_id", F.coalesce("code", F.lit("default")).alias("code"), F.coalesce("html_lang", F.lit("en")).alias("html_lang"))


def html_metadata(spark, d):
    """Title and author of a page made of each document."""
    page = F.concat(F.lit('<html><head><meta name="author" content="'), F.coalesce("source", F.lit("")), F.lit('"></head><body>'), F.regexp_replace("text", r"(?m)^# ([^\n]*)$", "<h1>$1</h1>"), F.lit("</body></html>"))
    return read(spark, d, "documents").select("doc_id", page.alias("html")).select("doc_id", R.html_title(F.col("html"), F.col("doc_id").cast("string")).alias("title"), R.html_author(F.col("html")).alias("author"))


def audited_pages(spark, d):
    """Findings in pages made of the documents of each kind."""
    page = F.concat(F.lit("<html><body>"), M.html_of(F.col("text")), F.lit("</body></html>"))
    docs = read(spark, d, "documents").select("doc_id", page.alias("html"))
    return A.audited(docs, "doc_id").select("doc_id", "pos", "severity", "code")


def caption_pages(spark, d):
    """Each caption's page, or the one after it, by which page's text resembles it more."""
    b = _boxes(spark, d)
    return G.likely_page(b.where("kind = 'caption'").select("doc_id", "id", "page", "text"), b.where("kind <> 'caption'").select("doc_id", "page", "text"))


def book_years(spark, d):
    return D.book_years(tables.blocks(spark, d, "ord", "text", "is_reference"))


def book_progress(spark, d):
    return S.progress(read(spark, d, "run_state"), read(spark, d, "chunks"))


def event_windows(spark, d):
    return S.event_windows(read(spark, d, "events"))


QUERIES = {f.__name__: f for f in (reading_order, covered_text, figure_groups, page_style, page_columns, page_route, nearest_level, page_number_lines, cleaned_exports, structural_blocks, blank_line_parts, audited_pages, caption_pages, rendered_html, document_toc, patched_outputs, edition_blocks, language_settings, html_metadata, book_years, book_progress, event_windows)}

_BX = f"{B}, x as (select doc_id, id, kind, text, source_refs[1].page as page, source_refs[1].bbox[1] as x0, source_refs[1].bbox[2] as y0, source_refs[1].bbox[3] as x1, source_refs[1].bbox[4] as y1 from b where source_refs[1].page is not null and source_refs[1].bbox[4] is not null)"
ORACLE = {
    "reading_order": f"""with {_BX}, w as (select *, max(x1) over (partition by doc_id, page) + min(x0) over (partition by doc_id, page) as w, max(y1) over (partition by doc_id, page order by y0, x0, id rows between unbounded preceding and 1 preceding) as top from x),
n as (select *, sum(cast(coalesce(y0 > top + 20, false) as int)) over (partition by doc_id, page order by y0, x0, id) as band, x1 - x0 > w * 0.55 or (x0 < w / 2 - 30 and x1 > w / 2 + 30) as span from w),
m as (select *, min(case when not span then y0 end) over (partition by doc_id, page, band) as low, max(case when not span then y1 end) over (partition by doc_id, page, band) as high from n)
select doc_id, id, page, row_number() over (partition by doc_id, page order by band, case when span then (case when low is null or y1 <= low + 10 then 0 when y0 >= high - 10 then 4 else 3 end) when (x0 + x1) / 2 < w / 2 then 1 else 2 end, y0, x0, id) as place from m""",
    "covered_text": f"""with {_BX}, c as (select doc_id, page, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from x where kind = 'text' group by 1, 2)
select distinct a.doc_id, a.id from x a join c on a.doc_id = c.doc_id and a.page = c.page where a.kind in ('figure', 'table') and (a.x1 - a.x0) * (a.y1 - a.y0) > 0
  and greatest(least(a.x1, c.x1 + 3) - greatest(a.x0, c.x0 - 3), 0) * greatest(least(a.y1, c.y1 + 3) - greatest(a.y0, c.y0 - 3), 0) >= 0.8 * ((a.x1 - a.x0) * (a.y1 - a.y0))""",
    "figure_groups": f"""with recursive {_BX}, f as (select * from x where kind = 'figure'),
o as (select a.doc_id, a.id as ia, c.id as ic, least(a.x1, c.x1) - greatest(a.x0, c.x0) as h, least(a.y1, c.y1) - greatest(a.y0, c.y0) as v, a.x1 - a.x0 as wa, a.y1 - a.y0 as ha, c.x1 - c.x0 as wc, c.y1 - c.y0 as hc from f a join f c on a.doc_id = c.doc_id and a.page = c.page and a.id <> c.id),
e as (select doc_id, ia, ic from o where (least(wa * ha, wc * hc) > 0 and greatest(h, 0) * greatest(v, 0) >= 0.85 * least(wa * ha, wc * hc)) or (v >= 0.5 * least(ha, hc) and -h <= 90) or (h >= 0.5 * least(wa, wc) and -v <= 36)),
r as (select doc_id, id, id as root from f union select e.doc_id, e.ic, r.root from r join e on e.doc_id = r.doc_id and e.ia = r.id),
t as (select doc_id, id, min(root) as figure from r group by 1, 2)
select f.doc_id, f.page, t.figure, count(*) as n, round(min(x0), 3) as x0, round(min(y0), 3) as y0, round(max(x1), 3) as x1, round(max(y1), 3) as y1 from f join t using (doc_id, id) group by 1, 2, 3""",
    "page_style": f"""with {_BX}, h as (select doc_id, round(y1 - y0, 1) as height, sum(least(300, length(text))) as k from x group by 1, 2), g as (select doc_id, height from (select *, row_number() over (partition by doc_id order by k desc nulls last, height) as rn from h) where rn = 1)
select x.doc_id, count(distinct page) as n_pages, min(x0) as "left", min(y0) as top, max(x1) as "right", max(y1) as bottom, any_value(g.height) as height from x join g using (doc_id) group by 1""",
    "page_columns": f"""with {_BX}, w as (select *, max(x1) over (partition by doc_id, page) + min(x0) over (partition by doc_id, page) as w from x where length(text) >= 35),
g as (select doc_id, page, count(*) filter (where x1 <= w * 0.54) as nl, count(*) filter (where x0 >= w * 0.45) as nr, median(x1) filter (where x1 <= w * 0.54) as l, median(x0) filter (where x0 >= w * 0.45) as r from w group by 1, 2)
select doc_id, page, case when nl >= 3 and nr >= 3 and r - l > 2 then 2 else 1 end as columns from g""",
    "page_route": f"""with {_BX}, p as (select doc_id, page, coalesce(sum(length(text)), 0) as k from x group by 1, 2), g as (select doc_id, count(*) as n_pages, count(*) filter (where k < 20) as n_thin, cast(sum(k) as bigint) as n_chars from p group by 1)
select *, n_thin >= 0.35 * n_pages or n_chars < greatest(80, 12 * n_pages) as scan_like from g""",
    "nearest_level": f"with {_BX} select doc_id, id, case when abs(y1 - y0 - 12) <= abs(y1 - y0 - 25) and abs(y1 - y0 - 12) <= abs(y1 - y0 - 38) then 1 when abs(y1 - y0 - 25) <= abs(y1 - y0 - 38) then 2 else 3 end as level from x where kind = 'heading'",
    "language_settings": "select doc_id, case when lower(lang) in ('zh', 'en', 'ja', 'ko', 'fr', 'de', 'es') then lower(lang) else 'default' end as code, case when lower(lang) = 'zh' then 'zh-CN' when lower(lang) in ('ja', 'ko', 'fr', 'de', 'es') then lower(lang) else 'en' end as html_lang from documents",
    "html_metadata": r"""select doc_id, coalesce(nullif(trim(regexp_extract(text, '(?m)^# ([^\n]*)$', 1)), ''), cast(doc_id as varchar)) as title, coalesce(source, '') as author from documents""",
    "book_years": f"""with {B}, y as (select doc_id, ord, cast(unnest(regexp_extract_all(text, '(?:^|[^0-9])((?:1[5-9]|20)[0-9][0-9])(?:$|[^0-9])', 1)) as int) as year from b where text is not null), c as (select doc_id, year, count(*) as n, min(ord) as f from y group by 1, 2)
select doc_id, year, n from (select *, row_number() over (partition by doc_id order by n desc, f, year) as rn from c) where rn = 1""",
    "book_progress": "with d as (select distinct doc_id, chunk_id, 1 as d from run_state where status = 'committed'), g as (select c.doc_id, count(*) as n_chunks, count(d.d) as n_done from (select distinct doc_id, chunk_id from chunks) c left join d using (doc_id, chunk_id) group by 1) select *, cast(floor(25 + 50 * n_done / greatest(n_chunks, 1)) as int) as percent from g",
    "event_windows": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2",
}
_ESC = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_T = "coalesce(text, '')"
ORACLE["edition_blocks"] = f"""with {B}, l as (select *, cast(least(greatest(coalesce(level, 1), 1), 6) as varchar) as h from b)
select doc_id, id, sha256(case kind when 'heading' then '<h' || h || ' id="' || id || '">' || {_ESC(_T)} || '</h' || h || '>' when 'formula' then '<div class="formula">' || {_T} || '</div>'
  when 'table' then case when text like '<table%' then text else '<pre>' || {_ESC(_T)} || '</pre>' end when 'caption' then '<figcaption>' || {_ESC(_T)} || '</figcaption>' when 'footnote' then '<p class="footnote">' || {_ESC(_T)} || '</p>'
  when 'figure' then '<figure><img src="' || {_ESC("regexp_extract(" + _T + ", '\\(([^)]*)\\)', 1)")} || '" alt="' || {_ESC("regexp_extract(" + _T + ", '!\\[([^\\]]*)\\]', 1)")} || '"></figure>' else '<p>' || {_ESC(_T)} || '</p>' end) as hash from l"""
