"""Problem 4: text cut off by field limits.

Word trigrams are counted over all documents, apart as they stand within a line and at its
end; each text's final trigram is joined with those counts and flagged if it is common
within and almost never final. All of it is SQL expressions.

Lines are kept apart by what they begin with (prose, list, heading, table, signature, code),
as their ends differ; in code only the end of the text counts. The last word may itself be
cut: a longer word that begins with it counts as going on. Trigrams too rare to tell fall
back on bigrams, words and the kind of the last sign, each weighing as PRIOR occurrences. What
was put after a cut (an ellipsis, half an entity or tag, a broken character) is taken off
first; a deliberate ellipsis stands after words that often end so. Copies of a text do not
speak for its own end. Han and kana count by character, all numbers as one.

Null and blank texts are not cut off and are left out of the report's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.context import checkpoint, read, spread

PRIOR, THRESHOLD = 2.0, 0.02
_FENCE = r"(?m)^[ \t]*(?:```|~~~)[^\n]*$"
_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
_TOKEN = rf"(?:[a-z0-9_[\p{{L}}\p{{M}}\p{{N}}&&[^{_CJK}]]]){{1,40}}|(?![\x00-\x7F])[{_CJK}]|[.]{{2,}}|[^\s\p{{L}}\p{{M}}\p{{N}}_]"
_AFTER = r"(?:\s*(?:\.{3,}|…+|[\[(](?:\.{3,}|…)[\])]|�+|\\(?:u[0-9a-fA-F]{0,4}|x[0-9a-fA-F]{0,2})?|&(?:[A-Za-z]{1,8}|#x?[0-9a-fA-F]{0,6})?;?|<!-{0,2}[^<>\n]*|</?[A-Za-z]*(?:\s[^<>\n]*)?|\u200B))+\s*$"


def bare(text: Column) -> Column:
    """The text without what was put after its end."""
    end = lambda t: F.rtrim(t, F.lit(" \t\n\x0b\f\r"))
    return end(F.regexp_replace(end(text), _AFTER, ""))


def _tokens(line: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(F.lower(line), r"\p{Nd}+", "0"), F.lit(_TOKEN), F.lit(0))


def _mark(line: Column, code: Column) -> Column:
    sign = F.regexp_extract(line, r"^\s*([-*+•#|>$<—–]|\d{1,3}[.)](?=\s))", 1)
    return F.when(code, "C").when(sign == "", "P").when(sign.rlike(r"\d"), "1").otherwise(sign)


def _kind(word: Column) -> Column:
    return F.when(word.rlike(rf"^[{_CJK}]"), "h").when(word.rlike(r"^[\p{L}\p{M}]"), "w").when(word.rlike(r"^\p{N}"), "0").otherwise(word)


def lines_of(documents: DataFrame) -> DataFrame:
    """(doc_id, key, last, m, code, t): the tokens of every line, made once. ``key`` is equal for
    equal texts, ``last`` marks the line a text ends with."""
    d = documents.where("text is not null").select("doc_id", bare(F.col("text")).alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("key"), F.split("text", _FENCE).alias("_parts"))
    d = d.select("doc_id", "key", F.size("_parts").alias("_n"), F.posexplode("_parts").alias("_i", "_part"))
    d = d.select("doc_id", "key", (F.col("_i") % 2 == 1).alias("code"), (F.col("_i") == F.col("_n") - 1).alias("_end"), F.split("_part", r"\n").alias("_lines"))
    d = d.select("doc_id", "key", "code", "_end", F.size("_lines").alias("_n"), F.posexplode("_lines").alias("_j", "line")).where(F.trim("line") != "")
    last = F.col("_end") & (F.col("_j") == F.col("_n") - 1)
    return d.select("doc_id", "key", last.alias("last"), _mark(F.col("line"), F.col("code")).alias("m"), "code", _tokens(F.col("line")).alias("t"))


def trigrams(documents: DataFrame) -> DataFrame:
    """(m, w1, w2, w3, n, n_end): how often a trigram occurs and how often at an end."""
    return _trigrams(lines_of(documents))


def _trigrams(lines: DataFrame) -> DataFrame:
    rows = lines.select(
        "m", "code", F.size("t").alias("_n"), F.posexplode(F.transform("t", lambda w, i: F.struct(
            F.when(i > 1, F.get("t", i - 2)).otherwise("").alias("w1"), F.when(i > 0, F.get("t", i - 1)).otherwise("").alias("w2"), w.alias("w3")))).alias("i", "g"),
    )
    ends = (F.col("i") == F.col("_n") - 1) & ~F.col("code")
    return rows.groupBy("m", F.col("g.w1").alias("w1"), F.col("g.w2").alias("w2"), F.col("g.w3").alias("w3")).agg(F.count("*").alias("n"), F.count_if(ends).alias("n_end"))


def finals(documents: DataFrame) -> DataFrame:
    """(doc_id, own, m, w1, w2, w3): the last trigram of each text, and how many texts are
    equal to it. A text that ends in a closed code block has none."""
    return _finals(lines_of(documents))


def _finals(lines: DataFrame) -> DataFrame:
    t = lines.where(F.col("last") & F.col("doc_id").isNotNull() & (F.size("t") > 0))
    at = lambda k: F.coalesce(F.get("t", F.size("t") - k), F.lit(""))
    t = t.select("doc_id", "key", "m", at(3).alias("w1"), at(2).alias("w2"), at(1).alias("w3"))
    copies = t.groupBy("key").agg(F.count("*").alias("own"))
    return t.join(copies, "key").drop("key")


def _going_on(grams: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """For every wanted (keys, w3): occurrences of w3 or of a word that begins with it, and of
    w3 at an end. Words are expanded to their beginnings only where their keys are wanted."""
    near = grams.join(wanted.select(*keys).distinct(), keys, "left_semi") if len(keys) > 1 else grams
    long = F.length("w3")
    starts = near.select(*keys, F.explode(F.sequence(F.lit(1), F.least(long, F.lit(40)))).alias("k"), "w3", "n", "n_end")
    starts = starts.select(*keys, F.substring(F.col("w3"), F.lit(1), F.col("k")).alias("w3"), "n", F.when(F.col("k") == long, F.col("n_end")).otherwise(0).alias("n_end"))
    return starts.join(wanted, [*keys, "w3"], "left_semi").groupBy(*keys, "w3").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end"))


def scores(documents: DataFrame) -> DataFrame:
    """(doc_id, p_end): the share of its last trigram's occurrences that end, by back-off."""
    lines = checkpoint(lines_of(spread(documents.select("doc_id", "text"))))
    tri, last = checkpoint(_trigrams(lines)), checkpoint(_finals(lines))
    out = last.withColumn("kind", _kind(F.col("w3")))
    grams = {
        ("m", "w1", "w2"): tri,
        ("m", "w2"): tri.groupBy("m", "w2", "w3").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end")),
        ("m",): tri.groupBy("m", "w3").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end")),
    }
    kinds = tri.groupBy("m", _kind(F.col("w3")).alias("kind")).agg(F.sum("n").alias("n0"), F.sum("n_end").alias("e0"))
    out = out.join(kinds, ["m", "kind"], "left")
    p = F.greatest(F.col("e0") - F.col("own"), F.lit(0)) / F.greatest(F.col("n0"), F.lit(1))
    for level, keys in enumerate([["m"], ["m", "w2"], ["m", "w1", "w2"]], 1):
        c = _going_on(grams[tuple(keys)], last.select(*keys, "w3").distinct(), keys).withColumnsRenamed({"n": f"n{level}", "n_end": f"e{level}"})
        out = out.join(c, [*keys, "w3"], "left")
        n, e = F.greatest(F.col(f"n{level}") - F.col("own"), F.lit(0)), F.greatest(F.col(f"e{level}") - F.col("own"), F.lit(0))
        p = (e + F.lit(PRIOR) * p) / (n + F.lit(PRIOR))
    return out.withColumn("p_end", p)


def cut_off(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id of the texts that were cut off."""
    return scores(documents).where(F.col("p_end") < threshold).select("doc_id")


def source_key(source: Column) -> Column:
    """A source's name without case and outer blanks; blank is null."""
    return F.nullif(F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), F.lit(""))


def by_source(documents: DataFrame) -> DataFrame:
    """(source, n_documents, n_cut, share) over documents with a text."""
    cut = cut_off(documents).distinct().withColumn("_cut", F.lit(1))
    d = documents.where("text is not null and trim(text) <> ''").select("doc_id", source_key(F.col("source")).alias("source"))
    return d.join(cut, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n_documents"), F.count("_cut").alias("n_cut"), F.round(F.count("_cut") / F.count("*"), 6).alias("share"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_off(read(spark, sf_dir, "documents")).distinct()


def p4_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_source(read(spark, sf_dir, "documents"))


QUERIES = {"p4_found": p4_found, "p4_by_source": p4_by_source}
ORACLE: dict[str, str] = {}
