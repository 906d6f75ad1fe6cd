"""Source and translation side by side: markers, pairs, checks, neighbours, merged text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T

MARKER = r"(?m)^<!--\s*tb:(b\d+)\s*-->[ \t]*$"


def marked_blocks(text: Column) -> Column:
    """array<struct<id, body>> of a marked text, and null if something stands before the first
    marker, there is none, or an id repeats."""
    ids = F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))
    parts = F.split(text, MARKER)
    bad = (F.size(ids) == 0) | (T.strip(parts[0]) != "") | (F.size(F.array_distinct(ids)) != F.size(ids))
    bodies = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(ids), F.lit(1))), T.strip)
    return F.when(~bad, F.arrays_zip(ids.alias("id"), bodies.alias("body")))


def pairs(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, pos, id, source_body, output_body): a chunk's blocks with their
    translations where ids and order agree; else the chunk as one pair (id null)."""
    c = chunks.where("output is not null").select("doc_id", "chunk_id", "source", "output", marked_blocks(F.col("source")).alias("s"), marked_blocks(F.col("output")).alias("o"))
    same = F.transform("s", lambda x: x["id"]).eqNullSafe(F.transform("o", lambda x: x["id"])) & F.col("s").isNotNull()
    fine = F.transform(F.arrays_zip("s", "o"), lambda z: F.struct(z["s"]["id"].alias("id"), z["s"]["body"].alias("source_body"), z["o"]["body"].alias("output_body")))
    coarse = F.array(F.struct(F.lit(None).cast("string").alias("id"), T.strip(F.col("source")).alias("source_body"), T.strip(F.col("output")).alias("output_body")))
    return c.select("doc_id", "chunk_id", F.posexplode(F.when(same, fine).otherwise(coarse)).alias("pos", "p")).select("doc_id", "chunk_id", "pos", "p.*")


def table_shape(body: Column) -> Column:
    """Structural tags of an HTML table, or the pipes of each line of a Markdown one."""
    tags = F.transform(F.regexp_extract_all(body, F.lit(r"(?i)</?(?:table|thead|tbody|tfoot|tr|th|td)\b"), F.lit(0)), F.lower)
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: T.strip(x) != "")
    pipes = F.transform(lines, lambda x: F.size(F.regexp_extract_all(x, F.lit(r"(?<!\\)\|"), F.lit(0))).cast("string"))
    return F.when(F.lower(body).contains("<table"), tags).otherwise(pipes)


def translation_errors(paired: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, id, errors): structural faults of each pair, as sorted codes."""
    b = blocks.select("doc_id", "id", "kind", "translatable")
    p = paired.join(b, ["doc_id", "id"], "left")
    s, o = F.col("source_body"), F.col("output_body")
    ps, po = T.protected_objects(s), T.protected_objects(o)
    level = lambda x: F.regexp_extract(x, r"^(#{1,6})\s", 1)
    e = F.array(
        F.when(F.col("id").isNull(), F.lit("ids")), F.when((s != "") & (o == ""), F.lit("empty")), F.when(~F.coalesce("translatable", F.lit(True)) & (s != o), F.lit("fixed_changed")),
        *(F.when(F.col("id").isNotNull() & (ps[k] != po[k]), F.lit(k)) for k in ("math", "destinations", "html_paths", "footnotes", "code", "mathml")),
        F.when(F.col("id").isNotNull() & (level(s) != level(o)), F.lit("heading")), F.when((F.col("kind") == "table") & ~table_shape(s).eqNullSafe(table_shape(o)), F.lit("table")),
    )
    return p.select("doc_id", "chunk_id", F.coalesce("id", F.lit("")).alias("id"), F.array_join(F.array_sort(F.array_compact(e)), ",").alias("errors")).where("errors <> ''")


def image_refs(text: Column) -> Column:
    """All image targets of a text, Markdown first; a ``>`` in quotes ends no tag."""
    md = F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))
    html = F.regexp_extract_all(text, F.lit(r"""(?i)<img\b(?:[^>"']|"[^"]*"|'[^']*')*?\bsrc\s*=\s*["']([^"']+)["']"""), F.lit(1))
    return F.concat(F.transform(md, lambda x: F.concat(F.lit("md:"), x)), F.transform(html, lambda x: F.concat(F.lit("html:"), x)))


def image_diff(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, ref, n_missing, n_extra): multiset difference of image references."""
    c = chunks.where("output is not null")
    side = lambda col, v: c.select("doc_id", "chunk_id", F.explode(image_refs(F.col(col))).alias("ref"), F.lit(v).alias("v"))
    d = side("source", 1).union(side("output", -1)).groupBy("doc_id", "chunk_id", "ref").agg(F.sum("v").alias("d")).where("d <> 0")
    return d.select("doc_id", "chunk_id", "ref", F.greatest("d", F.lit(0)).alias("n_missing"), F.greatest(-F.col("d"), F.lit(0)).alias("n_extra"))


def neighbours(chunks: DataFrame, chars: int = 300) -> DataFrame:
    """(doc_id, chunk_id, prev_excerpt, next_excerpt): the tail of chunk n-1 and the head of
    chunk n+1, cut and then stripped; '' where there is no such number."""
    if chars < 0:
        raise ValueError("chars must not be negative")
    n = F.regexp_extract("chunk_id", r"(\d+)", 1).try_cast("long")
    c = chunks.select("doc_id", "chunk_id", n.alias("n"), "source")
    tail = F.when(F.lit(chars == 0), "").otherwise(F.right("source", F.lit(max(chars, 1))))
    prev = c.select("doc_id", (F.col("n") + 1).alias("n"), T.strip(tail).alias("prev_excerpt"))
    nxt = c.select("doc_id", (F.col("n") - 1).alias("n"), T.strip(F.substring("source", 1, chars)).alias("next_excerpt"))
    j = c.drop("source").join(prev, ["doc_id", "n"], "left").join(nxt, ["doc_id", "n"], "left")
    return j.select("doc_id", "chunk_id", F.coalesce("prev_excerpt", F.lit("")).alias("prev_excerpt"), F.coalesce("next_excerpt", F.lit("")).alias("next_excerpt"))


def neighbour_prompt(prev: Column, nxt: Column) -> Column:
    block = lambda head, x: F.when(x != "", F.concat(F.lit(head + " (read-only):\n```text\n"), x, F.lit("\n```")))
    return F.concat_ws("\n\n", block("Previous chunk excerpt", prev), block("Next chunk excerpt", nxt))


def merged_order(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, ord, ready, char_from): where each chunk's stripped output begins in
    the merged text of its book, whose parts are joined by a blank line; a book with a blank or
    missing output is not ready. The text itself stays in its rows, so that a book of any
    length is no single value."""
    from folioflow.operators.ordered import Ordered

    t = T.strip(F.coalesce("output", F.lit("")))
    c = chunks.select("doc_id", "chunk_id", "ord", F.length(t).alias("size"))
    ready = c.groupBy("doc_id").agg(F.min(F.col("size") > 0).alias("ready"))
    o = Ordered(c, position="ord", ties=("chunk_id",)).running_sum("char_from", F.col("size") + 2, inclusive=False).rows()
    return o.join(ready, "doc_id").select("doc_id", "chunk_id", "ord", "ready", "char_from")


def bilingual(paired: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, n_pairs, text): each chunk's source parts fenced as ``.orig``, headings
    as plain text, each followed by its translation, without images that were just shown."""
    s, o = F.col("source_body"), F.col("output_body")
    pictures = F.transform(image_refs(s), lambda x: F.regexp_replace(x, "^(md|html):", ""))
    only = s.rlike(r"^(?:\s*!\[[^\]]*\]\([^)]*\)\s*)+$") | F.lower(s).contains("<img")
    shown = F.when(s == "", F.lit(None)).when(only, s).otherwise(F.concat(F.lit("::: {.orig}\n"), F.regexp_replace(s, r"^#{1,6}\s+(?=[^\n]*$)", ""), F.lit("\n:::")))
    drop = lambda t: F.aggregate(pictures, t, lambda acc, p: F.regexp_replace(acc, F.concat(F.lit(r"!\[[^\]]*\]\(\Q"), p, F.lit(r"\E[^)]*\)")), F.lit("")))
    said = F.when(T.strip(o) != "", F.nullif(T.strip(F.when(F.size(pictures) > 0, drop(o)).otherwise(o)), F.lit("")))
    p = paired.select("doc_id", "chunk_id", F.struct("pos", F.concat_ws("\n\n", shown, said).alias("t")).alias("x"))
    g = p.groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_list("x")).alias("x"))  # the blocks of one chunk
    return g.select("doc_id", "chunk_id", F.size("x").alias("n_pairs"), F.array_join(F.filter(F.transform("x", lambda y: y["t"]), lambda t: t != ""), "\n\n").alias("text"))


def coverage(paired: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, id, state): every block of a book and of its translation: ``translated``, ``missing``
    (it should have a translation), ``fixed`` (it need not), or ``unknown`` (the book has no such block)."""
    t = paired.where("id is not null").select("doc_id", "id", F.lit(True).alias("_t")).distinct()
    b = blocks.select("doc_id", "id", F.coalesce("translatable", F.lit(True)).alias("_need"))
    state = F.when(F.col("_need").isNull(), "unknown").when(F.col("_t"), "translated").when(F.col("_need"), "missing").otherwise("fixed")
    return b.join(t, ["doc_id", "id"], "full_outer").select("doc_id", "id", state.alias("state"))
