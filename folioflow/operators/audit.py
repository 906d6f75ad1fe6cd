"""Rules over published text: untranslated passages, dropped names, numbering of references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators.ordered import Ordered
from folioflow.operators.terms import occurrences


#: What is left in its own language.
SPARED = {
    "formula": r"^(?:\$\$|\\\[)", "authors": r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s*\d+(?:,\d+)*", "affiliation": r"(?i)^\d*\s*(?:Department|School|Cent(?:er|re)|Institute|University|Faculty|Laborat|Hospital)",
    "link": r"(?i)https?://|doi\.org|doi:", "reference": r"^[A-Z][^(\n]+\(\d{4}\)\.",
}


def untranslated(rows: DataFrame, keys: list[str], column: str = "text", least: int = 100, share: float = 0.85) -> DataFrame:
    """(keys, n_chars, n_ascii) of texts over a length that are mostly ASCII, without those that
    are formulas, lists of authors, affiliations, links or references."""
    t = T.strip(F.col(column))
    spared = F.lit(False)
    for pattern in SPARED.values():
        spared = spared | t.rlike(pattern)
    ascii_ = F.length(F.regexp_replace(t, r"[^\x00-\x7F]", ""))
    r = rows.where(F.col(column).isNotNull()).withColumn("n_chars", F.length(t)).withColumn("n_ascii", ascii_).where(~spared)
    return r.where((F.col("n_chars") > least) & (F.col("n_ascii") / F.col("n_chars") > share)).select(*keys, "n_chars", "n_ascii")


def alias_leaks(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, term_key, n): dropped names (aliases that are not the target) that
    published texts (doc_id, chunk_id, text) of the book still carry."""
    a = glossary.where("target is not null and trim(target) <> ''").select("doc_id", "term_key", F.lit(None).cast("string").alias("source"), F.filter(F.transform("aliases", T.strip), lambda x: (x != "") & (x != T.strip(F.col("target")))).alias("aliases"))
    return occurrences(texts, a)


def reference_numbers(blocks: DataFrame) -> DataFrame:
    """(doc_id, n, lowest, highest, n_gaps, n_repeats, n_disorder): the numbers that begin a
    book's references; gaps are numbers that no reference has."""
    num = F.nullif(F.regexp_extract("text", r"^\[?(\d{1,9})(?:\]|\.)", 1), F.lit("")).cast("int")
    r = blocks.where("coalesce(is_reference, false) and text is not null").select("doc_id", "id", "ord", num.alias("num")).where("num is not null")
    r = Ordered(r).neighbour("_before", F.col("num")).rows()
    g = r.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("num").alias("lowest"), F.max("num").alias("highest"), F.count_distinct("num").alias("_d"), F.count_if(F.col("num") < F.col("_before")).alias("n_disorder"))
    return g.select("doc_id", "n", "lowest", "highest", (F.col("highest") - F.col("lowest") + 1 - F.col("_d")).alias("n_gaps"), (F.col("n") - F.col("_d")).alias("n_repeats"), "n_disorder")


def crowded_sections(blocks: DataFrame, most: int = 8) -> DataFrame:
    """(doc_id, section, n_below): sections of a level-1 heading with more headings below it."""
    h = blocks.where("kind = 'heading'").select("doc_id", "id", "ord", F.coalesce("level", F.lit(1)).alias("level"))
    h = Ordered(h).running_sum("section", (F.col("level") == 1).cast("int")).rows()
    n = h.where("section > 0 and level > 1").groupBy("doc_id", F.col("section").cast("int").alias("section")).agg(F.count("*").alias("n_below"))
    return n.where(F.col("n_below") > most)


def status(issues: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status): the worst severity of issues (keys, severity)."""
    rank = F.max(F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0))
    return issues.groupBy(*keys).agg(F.element_at(F.array(F.lit("passed"), F.lit("warning"), F.lit("failed")), rank + 1).alias("status"))
