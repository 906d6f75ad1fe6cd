"""Documents as a whole: structure hashes, split runs, identifiers, merged texts, nested pages.

Books of any length are worked in stretches (``Ordered``), never as one group. Null texts count
as empty, blocks without doc_id or id are left out, empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators.chunking import block_boundary_chunks, cut_chunks, landmarks, suggested_cuts
from folioflow.operators.ordered import STRETCH, Ordered

#: What of a block a structure hash covers, in this order.
FROZEN = ("id", "kind", "text", "page", "level", "caption_of", "translatable", "is_running_header", "is_reference")


def structure_hashes(blocks: DataFrame) -> DataFrame:
    """(doc_id, n_blocks, structure_hash): a hash over the frozen fields of a book's blocks in
    order. It is one of hashes: of each block's fields, parted by a sign that no text has, of
    the blocks of each STRETCH, and of those, so that a book of any length has one."""
    b = blocks.where("doc_id is not null and id is not null").select("*", F.try_element_at("source_refs", F.lit(1))["page"].alias("page"))
    fields = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FROZEN))
    b = Ordered(b.select("doc_id", "id", "ord", F.sha2(fields, 256).alias("h"))).running_sum("n", F.lit(1)).rows()
    s = b.groupBy("doc_id", F.floor((F.col("n") - 1) / STRETCH).alias("s")).agg(F.count("*").alias("k"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return s.groupBy("doc_id").agg(F.sum("k").alias("n_blocks"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "h"))), lambda x: x["h"]), ""), 256).alias("structure_hash"))


def split_run(blocks: DataFrame, cuts: DataFrame, target: int = 12_000) -> DataFrame:
    """(doc_id, id, chunk_no, method): each book is cut at the blocks that ``cuts`` (doc_id, id)
    names (custom); a book without such at suggested landmarks if it has any (suggested), else
    by size (boundary). Cuts at blocks that a book does not have count for nothing."""
    own = blocks.select("doc_id", "id")
    custom = cuts.join(own, ["doc_id", "id"], "left_semi").select("doc_id", "id").distinct()
    marks = suggested_cuts(landmarks(blocks), target).where("cut").select("doc_id", "id")
    suggested = marks.join(custom.select("doc_id").distinct(), "doc_id", "left_anti")
    at = custom.withColumn("method", F.lit("custom")).unionByName(suggested.withColumn("method", F.lit("suggested")))
    of = at.select("doc_id", "method").distinct()
    cut = cut_chunks(blocks.join(of.select("doc_id"), "doc_id", "left_semi"), at).select("doc_id", "id", "chunk_no").join(of, "doc_id")
    rest = block_boundary_chunks(blocks.join(of.select("doc_id"), "doc_id", "left_anti"), target)
    return cut.unionByName(rest.select("doc_id", "id", "chunk_no", F.lit("boundary").alias("method")))


#: Patterns of identifiers and of the words that introduce them.
DOI = r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"
NAMED_DOI = r"(?i)(?:available at|this paper at|article at)\s*https?://doi\.org/(10\.\d{4,9}/[^\s,;)\]>]+)"
PUBLISHED = r"(?i)(?:published(?:\s*online)?|accepted):\s*.*?(20\d\d)"
RECEIVED = r"(?i)(?:received|©):\s*.*?(20\d\d)"
YEAR_IN_DOI = r"-0?(\d{2,4})-"
FRONT, EARLY = 15, 20


def book_identifiers(blocks: DataFrame, declared: DataFrame | None = None, default_year: int = 2024) -> DataFrame:
    """(doc_id, doi, doi_from, year, year_from), one row a book.

    The DOI is the one ``declared`` (doc_id, doi), else the first in the first FRONT blocks,
    else one the text says it is available at, else the most frequent if it occurs more than
    once, ties to the earliest. The year follows Published or Accepted in the first EARLY
    blocks, else Received or the copyright sign, else stands in the DOI, else is the default."""
    b = Ordered(blocks.where("doc_id is not null").select("doc_id", "id", "ord", "text")).running_sum("n", F.lit(1)).rows()
    first = lambda p, g, most: F.min(F.when((F.col("n") <= most) & F.col("text").rlike(p), F.struct("n", F.regexp_extract("text", p, g).alias("x"))))["x"]
    every = 2**62
    one = b.groupBy("doc_id").agg(first(f"({DOI})", 1, FRONT).alias("front"), first(NAMED_DOI, 1, every).alias("named"), first(PUBLISHED, 1, EARLY).alias("published"), first(RECEIVED, 1, EARLY).alias("received"))
    found = b.select("doc_id", "n", F.explode(F.regexp_extract_all("text", F.lit(DOI), F.lit(0))).alias("x")).groupBy("doc_id", F.rtrim("x", F.lit(".")).alias("x")).agg(F.count("*").alias("k"), F.min("n").alias("f"))
    often = found.where("k > 1").groupBy("doc_id").agg(F.max_by("x", F.struct("k", -F.col("f"), "x")).alias("often"))
    one = one.join(often, "doc_id", "left")
    one = one.join(declared.select("doc_id", F.col("doi").alias("declared")), "doc_id", "left") if declared is not None else one.withColumn("declared", F.lit(None).cast("string"))
    ways = ("declared", "front", "named", "often")
    doi = F.coalesce(F.nullif("declared", F.lit("")), *(F.rtrim(w, F.lit(".")) for w in ways[1:]))
    way = F.when(F.nullif("declared", F.lit("")).isNotNull(), "declared")
    for w in ways[1:]:
        way = way.when(F.col(w).isNotNull(), w)
    one = one.withColumn("doi", doi).withColumn("doi_from", way)
    inside = F.nullif(F.regexp_extract("doi", YEAR_IN_DOI, 1), F.lit(""))
    year = F.coalesce("published", "received", F.when(F.length(inside) == 2, F.concat(F.lit("20"), inside)).otherwise(inside))
    year_from = F.when(F.col("published").isNotNull(), "published").when(F.col("received").isNotNull(), "received").when(inside.isNotNull(), "doi").otherwise("default")
    return one.select("doc_id", "doi", "doi_from", F.coalesce(year.cast("int"), F.lit(default_year)).alias("year"), year_from.alias("year_from"))


def merged_text(chunks: DataFrame, stretch: int = 1_000) -> DataFrame:
    """(doc_id, part, n_chunks, text): a book's outputs, stripped, in order with a blank line
    between; parts of at most ``stretch`` chunks, which follow each other with one too, so that
    no book is one row. A book of which any output is null or blank has none."""
    c = chunks.select("doc_id", "chunk_id", "ord", T.strip(F.coalesce("output", F.lit(""))).alias("text"))
    blank = c.where("text = ''").select("doc_id").distinct()
    c = Ordered(c.join(blank, "doc_id", "left_anti"), ties=("chunk_id",)).running_sum("n", F.lit(1)).rows()
    parts = F.array_sort(F.collect_list(F.struct("n", "text")))
    return c.groupBy("doc_id", F.floor((F.col("n") - 1) / stretch).cast("int").alias("part")).agg(F.count("*").alias("n_chunks"), F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))


def continued_texts(flagged: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, id, n_blocks, text): texts with those that run on from them (``flagged`` from
    ``structure.continuation_groups``). A hyphen before a lower-case letter is dropped with the
    break, between Han or kana there is no blank, else there is one."""
    f = Ordered(flagged).running_sum("_g", F.col("starts").cast("int")).rows()
    t = f.select("doc_id", "id", "ord", "_g", "starts").join(blocks.select("doc_id", "id", T.strip(F.coalesce("text", F.lit(""))).alias("text")), ["doc_id", "id"])
    g = t.groupBy("doc_id", "_g").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "text"))).alias("p"))
    wide = r"[\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{3000}-\x{30FF}]"

    def piece(x: Column, i: Column) -> Column:
        after = F.get(F.col("p"), i + 1)["text"]
        return (
            F.when(after.isNull(), x["text"]).when(x["text"].rlike(r"\p{L}-$") & after.rlike(r"^\p{Ll}"), F.regexp_replace(x["text"], "-$", ""))
            .when(x["text"].rlike(wide + "$") & after.rlike("^" + wide), x["text"]).otherwise(F.concat(x["text"], F.lit(" ")))
        )

    return g.select("doc_id", F.get("p", F.lit(0))["id"].alias("id"), F.size("p").alias("n_blocks"), F.array_join(F.transform("p", piece), "").alias("text"))


def reference_order(blocks: DataFrame) -> DataFrame:
    """(doc_id, id, num, place): references by their number, those without one last, in order."""
    num = F.nullif(F.regexp_extract("text", r"^\[?(\d{1,6})(?:\]|\.)", 1), F.lit("")).cast("int")
    r = blocks.where("coalesce(is_reference, false) and doc_id is not null").select("doc_id", "id", "ord", num.alias("num"))
    r = r.withColumn("at", F.coalesce(F.col("num").cast("long"), F.lit(1 << 40) + F.col("ord")))
    r = Ordered(r, position="at", ties=("ord", "id")).running_sum("place", F.lit(1)).rows()
    return r.select("doc_id", "id", "num", "place")


def glossary_upgrade(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(upgraded, rejected): terms of the second version of a glossary from those of the first
    (doc_id, source, target, category, and what else they have), and the (doc_id, source, n) for
    which that is not possible. Missing fields get their defaults. A book of which two terms
    share a source is rejected whole, as is one with a blank source."""
    key = T.strip(F.coalesce("source", F.lit("")))
    n = terms.where("doc_id is not null").groupBy("doc_id", key.alias("source")).agg(F.count("*").alias("n"))
    rejected = n.where("n > 1 or source = ''")
    has = set(terms.columns)
    kinds = {"aliases": "array<string>", "gender": "string", "confidence": "string", "frequency": "bigint", "evidence_refs": "array<string>", "notes": "string"}
    default = {"aliases": F.array(), "gender": F.lit("unknown"), "confidence": F.lit("medium"), "frequency": F.lit(0), "evidence_refs": F.array(), "notes": F.lit("")}
    filled = [F.coalesce(F.col(c) if c in has else F.lit(None).cast(k), default[c].cast(k)).alias(c) for c, k in kinds.items()]
    up = terms.join(rejected.select("doc_id").distinct(), "doc_id", "left_anti").where("doc_id is not null")
    return up.select("doc_id", F.coalesce(F.col("id") if "id" in has else F.lit(None).cast("string"), "source").alias("id"), "source", "target", "category", *filled, F.lit(2).alias("version")), rejected


def blocking(issues: DataFrame, *severities: str) -> DataFrame:
    """The issues that stop a book: those of the given severities (error, unless others are named)."""
    return issues.where(F.lower("severity").isin(*(severities or ("error",))))


def text_layer(pages: DataFrame, most: int = 8, least: float = 32) -> DataFrame:
    """(doc_id, n_sampled, mean_chars, has_text) of (doc_id, page, n_chars): at most ``most`` pages
    at even strides are looked at."""
    p = Ordered(pages, position="page", ties=()).running_sum("i", F.lit(1)).rows()
    n = pages.groupBy("doc_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") / most)).alias("step"))
    p = p.join(n, "doc_id").where((F.col("i") - 1) % F.col("step") == 0).where((F.col("i") - 1) / F.col("step") < most)
    g = p.groupBy("doc_id").agg(F.count("*").alias("n_sampled"), (F.sum("n_chars") / F.count("*")).alias("m"))
    return g.select("doc_id", "n_sampled", F.round("m", 4).alias("mean_chars"), (F.col("m") >= least).alias("has_text"))


def largest(files: DataFrame, folder: str, name: str, size: str) -> DataFrame:
    """The largest file of each folder, of equal ones the first by name."""
    best = F.min_by(F.struct(name, size), F.struct((-F.coalesce(F.col(size), F.lit(-1))).alias("s"), name))
    return files.groupBy(folder).agg(best.alias("_b")).select(folder, f"_b.{name}", f"_b.{size}")


def opf_metadata(xml: Column) -> Column:
    """struct(title, creator, publisher, language) of a package file; what it lacks is null."""
    of = lambda n: F.nullif(T.strip(F.xpath_string(xml, F.lit(f"//*[local-name()='{n}']"))), F.lit(""))
    return F.struct(*(of(n).alias(n) for n in ("title", "creator", "publisher", "language")))


def tidy(markdown: Column) -> Column:
    """Markdown of a converter without a byte-order mark and with plain blanks."""
    return F.translate(F.replace(markdown, F.lit("﻿")), " ", " ")


#: How types of page blocks become kinds of blocks.
TYPES = {"title": "heading", "text": "text", "list": "text", "interline_equation": "formula", "image": "figure", "table": "table", "image_caption": "caption", "table_caption": "caption"}


def normalised_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page, pos, kind, markdown) of nested pages (doc_id, page_idx, para_blocks
    array<struct<type, lines array<struct<spans array<struct<content, html>>>>>>): titles become
    headings, equations stand between dollar signs, tables keep their HTML; a block of an unknown
    type is text, one without any text is left out."""
    b = pages.where("doc_id is not null").select("doc_id", F.col("page_idx").alias("page"), F.posexplode("para_blocks").alias("pos", "b"))
    spans = F.flatten(F.transform("b.lines", lambda x: x["spans"]))
    html = F.array_join(F.transform(spans, lambda s: F.coalesce(s["html"], F.lit(""))), "")
    lines = F.transform("b.lines", lambda x: F.array_join(F.transform(x["spans"], lambda s: F.coalesce(s["content"], F.lit(""))), " "))
    kinds = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    kind = F.coalesce(F.try_element_at(kinds, F.col("b.type")), F.lit("text"))
    text = T.strip(F.array_join(lines, "\n"))
    markdown = F.when(kind == "heading", F.concat(F.lit("# "), text)).when(kind == "formula", F.concat(F.lit("$$\n"), text, F.lit("\n$$"))).when((kind == "table") & (html != ""), html).otherwise(text)
    return b.select("doc_id", "page", "pos", kind.alias("kind"), markdown.alias("markdown"), text.alias("_t"), html.alias("_h")).where("_t <> '' or _h <> ''").drop("_t", "_h")
