"""Finding a book's identifiers by cascades, first rule first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators.ordered import Ordered

DOI = r"10\.\d{4,9}/[^\s\"<>]+"
FRONT = 15


def book_dois(blocks: DataFrame) -> DataFrame:
    """(doc_id, doi, way): the first DOI in the first 15 blocks outside references (``front``),
    else the most frequent one that occurs more than once (``repeated``), ties to the earlier."""
    b = Ordered(blocks.select("doc_id", "id", "ord", "text", "is_reference")).running_sum("_n", F.lit(1)).rows()
    d = b.select("doc_id", "ord", ((F.col("_n") <= FRONT) & ~F.coalesce("is_reference", F.lit(False))).alias("front"), F.explode(F.regexp_extract_all("text", F.lit(DOI), F.lit(0))).alias("doi"))
    d = d.withColumn("doi", F.rtrim(F.lower("doi"), F.lit(".,;)")))
    g = d.groupBy("doc_id", "doi").agg(F.min("ord").alias("_f"), F.count("*").alias("_k"), F.max("front").alias("front")).where("front or _k > 1")
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("front").desc(), F.when(F.col("front"), F.col("_f")).otherwise(0), F.col("_k").desc(), "_f", "doi"))
    return g.withColumn("_r", best).where("_r = 1").select("doc_id", "doi", F.when(F.col("front"), "front").otherwise("repeated").alias("way"))


def book_years(blocks: DataFrame) -> DataFrame:
    """(doc_id, year, n): the year from 1500 on that a book names most, ties to the earliest."""
    y = blocks.select("doc_id", "ord", F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|[^0-9])((?:1[5-9]|20)[0-9][0-9])(?:$|[^0-9])"), F.lit(1))).alias("year"))
    g = y.groupBy("doc_id", F.col("year").cast("int").alias("year")).agg(F.count("*").alias("n"), F.min("ord").alias("_f"))
    r = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "_f", "year"))
    return g.withColumn("_r", r).where("_r = 1").select("doc_id", "year", "n")


#: More patterns than this are no table of fixed rows.
MOST_PATTERNS = 10_000


def first_match(df: DataFrame, text: str, patterns: DataFrame, key: str) -> DataFrame:
    """(key, name): of the table ``patterns`` (priority, pattern, name), which holds a few fixed
    rows, the name of the first pattern that a text matches. All patterns count; a table of
    more than MOST_PATTERNS is refused."""
    rows = patterns.orderBy("priority", "pattern").limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    name = F.lit(None).cast("string")
    for r in reversed(rows):
        name = F.when(F.col(text).rlike(r.pattern), r["name"]).otherwise(name)
    return df.select(key, name.alias("name")).where("name is not null")
