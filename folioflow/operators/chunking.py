"""Cutting books into chunks: greedy packing, cuts at ids, planning, force-splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators.folds import stretched_fold
from folioflow.operators.ordered import Ordered


def marked(id_: Column, text: Column) -> Column:
    """A block as it stands in a chunk: its marker line and its text."""
    return F.concat(F.lit("<!-- tb:"), id_, F.lit(" -->\n"), T.strip(F.coalesce(text, F.lit(""))), F.lit("\n"))


def block_boundary_chunks(blocks: DataFrame, target: int = 12_000) -> DataFrame:
    """(doc_id, id, ord, size, chunk_no): greedy by size with markers counted; references and
    prose never share a chunk, and a heading of level 1 or 2 starts one that is 60 % full."""
    if target < 500:
        raise ValueError("a chunk has at least 500 characters")
    size = F.length(marked(F.col("id"), F.col("text")))
    major = (F.col("kind") == "heading") & (F.coalesce("level", F.lit(3)) <= 2)
    rows = blocks.select("doc_id", "id", "ord", size.alias("size"), F.coalesce("is_reference", F.lit(False)).alias("ref"), F.coalesce(major, F.lit(False)).alias("major"))
    fill = int(target * 0.6)

    def step(state, r):
        full, ref = state
        starts = full is None or r.ref != ref or full + r.size > target or (r.major and full >= fill)
        return ((0 if starts else full) + r.size, r.ref), starts

    return stretched_fold(rows, ["doc_id"], "ord", ["id"], step, lambda: (None, None), "chunk_no", number=True)


def structural_chunks(rows: DataFrame, target: int = 6_000) -> DataFrame:
    """Adds ``chunk_no`` to (doc_id, ord, size, heading): a heading starts a chunk, a chunk that
    would overflow is closed, and a row of over twice the target stands alone. A null size
    counts as 0, a null heading as none."""
    rows = rows.withColumn("size", F.coalesce("size", F.lit(0))).withColumn("heading", F.coalesce("heading", F.lit(False)))

    def step(state, r):
        full, used = state  # not used: the chunk before is closed, the next row starts one
        if r.size > 2 * target:
            return (0, False), True
        starts = not used or (r.heading and full > 0) or full + r.size > target
        return ((0 if starts else full) + r.size, True), starts

    return stretched_fold(rows, ["doc_id"], "ord", [], step, lambda: (0, False), "chunk_no", number=True)


def cut_chunks(blocks: DataFrame, cuts: DataFrame) -> DataFrame:
    """(doc_id, id, ord, chunk_no): a chunk starts at every block of ``cuts`` (doc_id, id)."""
    b = blocks.select("doc_id", "id", "ord").join(cuts.select("doc_id", "id").distinct().withColumn("_cut", F.lit(1)), ["doc_id", "id"], "left")
    b = Ordered(b).running_sum("_n", F.lit(1))
    b = b.running_sum("_no", F.when(F.col("_n") == 1, 1).otherwise(F.coalesce("_cut", F.lit(0)))).rows()
    return b.select("doc_id", "id", "ord", F.col("_no").cast("int").alias("chunk_no"))


def landmarks(blocks: DataFrame) -> DataFrame:
    """(doc_id, id, ord, kind, title, char_offset): headings that are no running headers, and
    the block where the references begin, with the characters before them."""
    text = T.strip(F.coalesce("text", F.lit("")))
    ref = F.coalesce("is_reference", F.lit(False)) | ((F.col("kind") == "heading") & text.rlike(r"(?i)^(?:references?|bibliography|参考文献)(?![\p{L}\p{N}_])"))
    b = blocks.select("doc_id", "id", "ord", "kind", text.alias("t"), ref.alias("ref"), F.coalesce("is_running_header", F.lit(False)).alias("run"), F.coalesce("style_id", F.lit("")).alias("style"))
    b = b.withColumn("size", F.length("t")).withColumn("t", F.substring("t", 1, 80))
    b = Ordered(b).running_sum("char_offset", F.col("size"), inclusive=False).running_sum("nth", F.col("ref").cast("int")).rows()
    opens = F.col("ref") & (F.col("nth") == 1)
    heads = (F.col("kind") == "heading") & ~F.col("run") & (F.col("style") != "running-header")
    return b.where(opens | heads).select("doc_id", "id", "ord", F.when(opens, "references").otherwise("heading").alias("kind"), F.col("t").alias("title"), "char_offset")


def suggested_cuts(marks: DataFrame, target: int = 12_000) -> DataFrame:
    """Adds ``cut``: at a heading once 70 % of the target lies behind the last cut, at the
    references once 500 characters do."""
    least = int(target * 0.70)

    def step(state, r):
        cut = r.char_offset - state[0] >= (500 if r.kind == "references" else least)
        return ((r.char_offset,) if cut else state), bool(cut)

    return stretched_fold(marks, ["doc_id"], "ord", ["id"], step, lambda: (0,), "cut")


def force_split(texts: DataFrame, target: int = 6_000) -> DataFrame:
    """(doc_id, piece_no, piece) of texts over twice the target: by paragraphs, or by lines
    where there is one paragraph; a fenced code block's pieces are fenced again."""
    t = texts.where(F.length("text") > 2 * target).select("doc_id", "text")
    fenced = F.ltrim("text").startswith("```")
    paragraphs, lines = F.split("text", r"\n\n+"), F.split("text", "\n")
    inner = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1 - F.when(F.trim(F.element_at(lines, -1)).startswith("```"), 1).otherwise(0), F.lit(0)))
    by_line = fenced | (F.size(paragraphs) == 1)
    parts = F.when(fenced, inner).when(by_line, lines).otherwise(paragraphs)
    t = t.select("doc_id", "text", by_line.alias("by_line"), fenced.alias("fenced"), F.element_at(F.split(F.ltrim("text"), "\n"), 1).alias("opener"), parts.alias("parts"))
    # Offsets of the cuts only; a piece's parts are joined once.
    extra = F.when(F.col("by_line"), 1).otherwise(0)
    state = F.aggregate(
        F.transform("parts", lambda p: (F.length(p) + extra).cast("int")),
        F.struct(F.lit(0).cast("int").alias("size"), F.lit(0).cast("int").alias("no"), F.array().cast("array<int>").alias("nos")),
        lambda a, n: F.when((a["size"] + n > target) & (a["size"] > 0), F.struct(n.alias("size"), (a["no"] + 1).alias("no"), F.array_append(a["nos"], a["no"] + 1).alias("nos")))
        .otherwise(F.struct((a["size"] + n).alias("size"), a["no"].alias("no"), F.array_append(a["nos"], a["no"]).alias("nos"))),
    )
    rows = t.select("doc_id", "by_line", "fenced", "opener", F.posexplode(F.arrays_zip(F.col("parts").alias("part"), state["nos"].alias("no"))).alias("i", "z"))
    rows = rows.groupBy("doc_id", F.col("z.no").alias("no")).agg(F.first("by_line").alias("by_line"), F.first("fenced").alias("fenced"), F.first("opener").alias("opener"), F.array_sort(F.collect_list(F.struct("i", F.col("z.part").alias("part")))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["part"]), "\n")
    wide = F.array_join(F.transform("p", lambda x: x["part"]), "\n\n")
    piece = F.when(F.col("fenced"), F.concat("opener", F.lit("\n"), body, F.lit("\n```"))).when(F.col("by_line"), body).otherwise(wide)
    return rows.select("doc_id", (F.col("no") + 1).alias("piece_no"), piece.alias("piece"))


def chunk_texts(blocks: DataFrame, numbered: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, n_blocks, n_chars, source_hash, block_ids): what a manifest holds of
    the chunks that ``numbered`` (doc_id, id, chunk_no) assigns blocks to."""
    b = blocks.select("doc_id", "id", "ord", marked(F.col("id"), F.col("text")).alias("m")).join(numbered.select("doc_id", "id", "chunk_no"), ["doc_id", "id"])
    g = b.groupBy("doc_id", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "m"))).alias("p"))
    text = F.concat(F.regexp_replace(F.array_join(F.transform("p", lambda x: x["m"]), "\n"), r"[\s\p{Z}]+$", ""), F.lit("\n"))
    return g.select("doc_id", "chunk_no", F.size("p").alias("n_blocks"), F.length(text).alias("n_chars"), F.sha2(text, 256).alias("source_hash"), F.transform("p", lambda x: x["id"]).alias("block_ids"))
