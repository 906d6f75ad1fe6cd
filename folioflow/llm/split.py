"""Problem 6: splitting oversized items at natural boundaries.

Token lengths are summed to offsets, the offsets that end a paragraph, line, sentence,
clause or word form sorted arrays, and each piece ends at the last such offset that a
binary search finds under the limit; the next piece steps back by the overlap. Where there
is no boundary the piece is cut at the limit, but not between a base character and its
combining marks.

Sizes are code points. An overlap of the limit or more is taken as limit - 1. Null texts
and texts within the limit are no cases; a null, zero or negative limit means no limit.
Repeated rows of a block count once. Books without a readable limit have no cases.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.context import read, replicated, salted

SALTS = 8
_TOKEN = re.compile(r"\n[ \t\r]*\n\s*|\n\s*|[^\S\n]+|[.!?。！？…]+[\"'”’»）)\]]*|[,;:，；：、]|[^\W_]+|[\W_]", re.UNICODE)
_ENDS, _CLAUSE = ".!?。！？…", ",;:，；：、"
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD = range(5)


def boundaries(text: str) -> list[np.ndarray]:
    """For each class of boundary the sorted offsets after which a piece may end."""
    tokens = [m.group() for m in _TOKEN.finditer(text)]
    ends = np.cumsum([len(t) for t in tokens]) if tokens else np.zeros(0, int)
    out: list[list[int]] = [[] for _ in range(5)]
    before = ""
    for token, end in zip(tokens, ends.tolist()):
        if token[0] == "\n":
            out[PARAGRAPH if token.count("\n") > 1 else LINE].append(end)
        elif token[0].isspace():
            kind = SENTENCE if before[:1] and before[0] in _ENDS else CLAUSE if before and before in _CLAUSE else WORD
            out[kind].append(end)
        elif token[0] in "。！？":
            out[SENTENCE].append(end)
        elif token[0] in "，；：、":
            out[CLAUSE].append(end)
        before = token
    return [np.array(x, dtype=int) for x in out]


def _hard(text: str, start: int, at: int) -> int:
    cut = at
    while cut > start + 1 and cut < len(text) and (unicodedata.combining(text[cut]) or text[cut] in "‍︎️" or text[cut - 1] == "‍"):
        cut -= 1
    return cut if cut > start + 1 else at


def split_offsets(text: str | None, limit: int | None, overlap: int | None) -> list[tuple[int, int]]:
    """Start and end of each piece; empty for null, one piece for what fits."""
    if text is None:
        return []
    n = len(text)
    if not limit or limit <= 0 or n <= limit:
        return [(0, n)]
    overlap = max(0, min(int(overlap or 0), limit - 1))
    arrays = boundaries(text)
    pieces, start = [], 0
    while n - start > limit:
        most, least, cut = start + limit, start + max(overlap, limit // 2), 0
        for floor in (least, start + overlap):
            for offsets in arrays:
                i = bisect_right(offsets, most) - 1
                if i >= 0 and offsets[i] > floor:
                    cut = int(offsets[i])
                    break
            if cut:
                break
        if not cut:
            cut = _hard(text, start + overlap, most)
        pieces.append((start, cut))
        start = cut - overlap
    pieces.append((start, n))
    return pieces


_PIECES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(_PIECES)
def split_udf(text: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([
        [{"start": a, "end": b} for a, b in split_offsets(t, None if pd.isna(m) else int(m), None if pd.isna(o) else int(o))]
        for t, m, o in zip(text, limit, overlap)
    ])


def written_number(col: Column) -> Column:
    """A whole number however it is written: digits, grouped by commas, blanks, underscores or
    apostrophes, with a fraction, an exponent, k, or a unit behind it. Else null."""
    t = F.lower(F.regexp_replace(F.trim(col), r"[\s  ]+", " "))
    t = F.translate(t, "０１２３４５６７８９", "0123456789")
    body = F.regexp_extract(t, r"^\+?(\d{1,3}(?:[ ,_'’]\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?(?:e\+?\d+)?)\s?(?:k|[^\d\W]*(?: [^\d\W]+)*|字符?)?\.?$", 1)
    number = F.regexp_replace(body, r"[ ,_'’]", "").try_cast("double")
    thousand = F.when(t.rlike(r"\d\s?k( |$)"), 1000).otherwise(1)
    return F.when(body != "", F.floor(number * thousand)).cast("long")


def contracts(manifest: DataFrame) -> DataFrame:
    """(doc_id, limit, overlap) of the greatest revision of each book's manifest, where it
    gives a positive number."""
    last = manifest.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("revision", "created_at", "split_contract")).alias("m"))
    v = F.try_parse_json(F.col("m.split_contract"))
    got = last.select("doc_id", *(written_number(F.try_variant_get(v, f"$.{k}", "string")).alias(a) for k, a in (("target_chars", "limit"), ("overlap_chars", "overlap"))))
    return got.where("limit > 0").select("doc_id", F.least("limit", F.lit(2**31 - 1)).cast("int").alias("limit"), F.least(F.coalesce("overlap", F.lit(0)), F.lit(2**31 - 1)).cast("int").alias("overlap"))


def oversized(blocks: DataFrame, limits: DataFrame) -> DataFrame:
    """Blocks over their book's limit with their pieces' offsets, one row a block.

    What is no longer than the least limit of all cannot be over its own; only longer texts
    are shuffled, spread by salt, so that a book with a third of all rows is no hot key."""
    least = limits.agg(F.min("limit")).scalar()
    long = blocks.select("doc_id", "id", "text").where(F.length("text") > least)
    joined = salted(long, SALTS, "id").join(replicated(limits, SALTS), ["doc_id", "_salt"]).where(F.length("text") > F.col("limit"))
    one = joined.groupBy("doc_id", "_salt", "id").agg(F.max(F.struct("text", "limit", "overlap")).alias("b"))
    return one.select("doc_id", "id", "b.*", split_udf("b.text", "b.limit", "b.overlap").alias("pieces"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that the splitter cuts."""
    cut = oversized(read(spark, sf_dir, "blocks"), contracts(read(spark, sf_dir, "manifest")))
    return cut.where(F.size("pieces") > 1).select("doc_id", "id")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every block over its limit."""
    cut = oversized(read(spark, sf_dir, "blocks"), contracts(read(spark, sf_dir, "manifest")))
    rows = cut.select("doc_id", "id", "text", F.posexplode("pieces").alias("piece_no", "p"))
    piece = F.substring(F.col("text"), F.col("p.start") + 1, F.col("p.end") - F.col("p.start"))
    return rows.select("doc_id", "id", (F.col("piece_no") + 1).alias("piece_no"), F.col("p.start").alias("start"), F.col("p.end").alias("end"), piece.alias("piece"))


QUERIES = {"p6_found": p6_found, "p6_pieces": p6_pieces}
ORACLE = {
    "p6_found": """
with m as (
  select doc_id, try_cast(split_contract as json) as j,
    row_number() over (partition by doc_id order by revision desc, created_at desc) as rn from manifest),
n as (select doc_id, lower(trim(json_extract_string(j, '$.target_chars'))) as t from m where rn = 1),
l as (select doc_id, cast(replace(regexp_extract(t, '^([0-9][0-9,]*)(\\.0+)?( *chars)?$', 1), ',', '') as bigint) as lim
  from n where regexp_matches(t, '^[0-9][0-9,]*(\\.0+)?( *chars)?$'))
select distinct b.doc_id, b.id from blocks b join l on b.doc_id = l.doc_id where length(b.text) > l.lim and l.lim > 0"""
}
