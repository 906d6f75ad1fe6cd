"""Order-bearing structure of books: outline, sections, references, numbering, continuation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators.ordered import Ordered

#: Headings that open and close a list of references.
REFERENCE_HEADINGS = ("references", "参考文献", "reference", "bibliography")
#: Fixed values.
END_MATTER = ("acknowledgements", "acknowledgments", "致谢", "利益冲突", "附录", "appendix")


def outline(blocks: DataFrame) -> DataFrame:
    """(doc_id, id, ord, level, page, title, suspect): headings, with those that look like a
    running header marked. A heading without a level is of level 1."""
    title = T.strip(F.col("text"))
    page = F.try_element_at("source_refs", F.lit(1))["page"]
    return blocks.where("kind = 'heading'").select("doc_id", "id", "ord", F.coalesce("level", F.lit(1)).alias("level"), page.alias("page"), title.alias("title"), F.coalesce(T.is_running_header_word(title), F.lit(False)).alias("suspect"))


def sections(blocks: DataFrame) -> DataFrame:
    """Adds ``section`` (0 before the first heading) and ``in_section``, the place within it."""
    heading = F.col("kind") == "heading"
    o = Ordered(blocks).running_sum("section", heading.cast("int")).running_sum("_n", F.lit(1)).last_seen("_first", F.when(heading, F.col("_n")))
    rows = o.rows()
    return rows.withColumn("section", F.col("section").cast("int")).withColumn("in_section", (F.col("_n") - F.coalesce("_first", F.lit(1)) + 1).cast("int")).drop("_n", "_first")


def reference_state(blocks: DataFrame) -> DataFrame:
    """Adds ``in_references``: between a heading of references and one of end matter."""
    t = F.lower(T.strip(F.col("text")))
    opens = (F.col("kind") == "heading") & F.coalesce(t.isin(*REFERENCE_HEADINGS), F.lit(False))
    closes = (F.col("kind") == "heading") & F.coalesce(t.isin(*END_MATTER), F.lit(False))
    event = F.when(opens, 1).when(closes, 0)
    rows = Ordered(blocks).last_seen("_state", event).rows()
    return rows.withColumn("in_references", (F.coalesce("_state", F.lit(0)) == 1) & (F.col("kind") != "heading")).drop("_state")


def heading_numbers(blocks: DataFrame) -> DataFrame:
    """(doc_id, id, ord, level, n1, n2, n3, label): counters of three levels, each starting again
    under the level above, as 一、 （一） 1."""
    h = blocks.where("kind = 'heading'").select("doc_id", "id", "ord", F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(3)).alias("level"))
    level = F.col("level")
    o = Ordered(h)
    for i in (1, 2, 3):
        o = o.running_sum(f"c{i}", (level == i).cast("int"))
    o = o.last_seen("b2", F.when(level == 1, F.col("c2"))).last_seen("b3", F.when(level <= 2, F.col("c3")))
    h = o.rows().select("doc_id", "id", "ord", "level", F.col("c1").alias("n1"), (F.col("c2") - F.coalesce("b2", F.lit(0))).alias("n2"), (F.col("c3") - F.coalesce("b3", F.lit(0))).alias("n3"))
    label = F.when(F.col("level") == 1, F.concat(T.cn_ordinal(F.col("n1")), F.lit("、"))).when(F.col("level") == 2, F.concat(F.lit("（"), T.cn_ordinal(F.col("n2")), F.lit("）"))).otherwise(F.concat(F.col("n3").cast("string"), F.lit(".")))
    return h.withColumn("label", label)


def continuation_groups(blocks: DataFrame) -> DataFrame:
    """Adds ``starts``: false for a text block that runs on from the text before it (that one
    ends no sentence and this one looks like a continuation); figures in between don't part."""
    t = blocks.where("kind in ('text', 'heading')").select("doc_id", "id", "ord", "kind", "text")
    t = Ordered(t).neighbour("_open", (F.col("kind") == "text") & ~F.coalesce(T.ends_sentence(F.col("text")), F.lit(True))).rows()
    on = (F.col("kind") == "text") & F.coalesce(T.looks_like_continuation(F.col("text")), F.lit(False)) & F.coalesce("_open", F.lit(False))
    return t.withColumn("starts", ~on).drop("text", "_open")


def block_numbers(blocks: DataFrame) -> DataFrame:
    """(doc_id, id, number): b000001... in order."""
    rows = Ordered(blocks.select("doc_id", "id", "ord")).running_sum("_n", F.lit(1)).rows()
    return rows.select("doc_id", "id", F.format_string("b%06d", F.col("_n")).alias("number"))


def captions_of(blocks: DataFrame) -> DataFrame:
    """(doc_id, id, target, way): each caption's figure or table: the named one, else the last
    before it on the same page, else on any page."""
    b = blocks.select("doc_id", "id", "ord", "kind", "caption_of", F.try_element_at("source_refs", F.lit(1))["page"].alias("page"))
    float_ = F.when(F.col("kind").isin("figure", "table"), F.col("id"))
    paged = Ordered(b, ("doc_id", "page")).last_seen("_p", float_, inclusive=False).rows()
    b = Ordered(paged).last_seen("_b", float_, inclusive=False).rows().withColumn("_p", F.when(F.col("page").isNotNull(), F.col("_p"))).where("kind = 'caption'")
    way = F.when(F.col("caption_of").isNotNull(), "named").when(F.col("_p").isNotNull(), "page").when(F.col("_b").isNotNull(), "before").otherwise("none")
    return b.select("doc_id", "id", F.coalesce("caption_of", "_p", "_b").alias("target"), way.alias("way"))


def hoisted_captions(blocks: DataFrame) -> DataFrame:
    """(doc_id, id, place): order in which a table's caption that follows it comes before it."""
    is_caption = (F.col("kind") == "caption") & F.coalesce(F.col("text").rlike(r"^(?:表|附表|(?i:table))"), F.lit(False))
    b = Ordered(blocks.select("doc_id", "id", "ord", "kind", "text")).neighbour("_before", F.col("kind")).running_sum("_n", F.lit(1))
    b = Ordered(b.rows().withColumn("_hoist", is_caption & (F.coalesce("_before", F.lit("")) == "table"))).neighbour("_next", F.col("_hoist"), before=False).rows()
    place = F.col("_n") + F.when(F.col("_hoist"), -1).when(F.coalesce("_next", F.lit(False)), 1).otherwise(0)
    return b.select("doc_id", "id", place.alias("place"))
