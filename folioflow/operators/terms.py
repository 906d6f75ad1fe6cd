"""Terminology: where terms occur, how often, which to show, what to mine.

Terms meet texts by an index, not by trying all pairs: a surface's first word (or, if it is not
ASCII, its first sign beyond ASCII, and for Han and kana its first two signs) is looked up among
the distinct words and signs of each text; only what meets there is searched for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T

_W = r"[\p{L}\p{N}_]"
_CJK2 = r"[\x{3400}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
#: Words in capitals that are no terms.
STOP_CAPITALS = """THE AND FOR WITH THAT THIS FROM THEIR WHICH WERE HAVE BEEN ALSO MORE SUCH THAN EACH WHEN INTO BOTH SOME THEN THESE THOSE ONLY MOST OVER AFTER BEFORE
PDF URL HTML USA UK DOI HTTP HTTPS FIG REF PAGE ET AL VOL NO YES NOT CAN MAY USE NEW ONE TWO ALL ANY BUT ARE HAS HAD WAS OUT OFF PER VIA SEE""".split()
#: Common compounds that are no terms.
STOP_COMPOUNDS = ("state-of-the-art", "peer-reviewed", "well-known", "in-depth", "real-time")


def _ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*$")


def surfaces(glossary: DataFrame) -> DataFrame:
    """(doc_id, term_key, surface): the source and all aliases of each term, once each; empty
    ones and single Han signs, which would match anywhere, are left out."""
    g = glossary.where("term_key is not null and doc_id is not null")
    s = g.select("doc_id", "term_key", F.explode(F.concat(F.array("source"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("surface"))
    return s.where("surface is not null and surface <> ''").where(~(T.contains_cjk(F.col("surface")) & (F.length("surface") <= 1))).distinct()


def _surface_key(s: Column) -> Column:
    word = F.regexp_extract(s, rf"({_W}+)", 1)
    cjk = F.regexp_extract(s, f"({_CJK2}{{2}})", 1)
    sign = F.regexp_extract(s, r"([^\x00-\x7F])", 1)
    return F.when(_ascii(s), F.when(word != "", F.concat(F.lit("w"), word)).otherwise("*")).when(cjk != "", F.concat(F.lit("c"), cjk)).otherwise(F.concat(F.lit("s"), sign))


def _text_keys(t: Column) -> Column:
    words = F.transform(F.array_distinct(F.regexp_extract_all(t, F.lit(f"{_W}+"), F.lit(0))), lambda w: F.concat(F.lit("w"), w))
    runs = F.regexp_extract_all(t, F.lit(f"{_CJK2}{{2,}}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.concat(F.lit("c"), F.substr(r, i, F.lit(2))))))
    signs = F.transform(F.array_distinct(F.regexp_extract_all(t, F.lit(r"[^\x00-\x7F]"), F.lit(0))), lambda x: F.concat(F.lit("s"), x))
    return F.array_distinct(F.concat(words, pairs, signs, F.array(F.lit("*"))))


def count_in(surface: Column, text: Column) -> Column:
    """Occurrences: of ASCII as whole words, of anything else as it stands."""
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.replace(surface, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}_])"))
    plain = (F.length(text) - F.length(F.replace(text, surface, F.lit("")))) / F.length(surface)
    return F.when(_ascii(surface), F.size(F.regexp_extract_all(text, quoted, F.lit(0)))).otherwise(plain).cast("long")


def occurrences(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, term_key, n): occurrences of each term's surfaces in the texts
    (doc_id, chunk_id, text) of its book, where there are any."""
    s = surfaces(glossary).withColumn("key", _surface_key(F.col("surface")))
    keys = texts.where("text is not null").select("doc_id", "chunk_id", F.explode(_text_keys(F.col("text"))).alias("key"))
    hits = keys.join(s, ["doc_id", "key"]).select("doc_id", "chunk_id", "term_key", "surface").distinct()
    n = hits.join(texts.select("doc_id", "chunk_id", "text"), ["doc_id", "chunk_id"]).where(F.col("text").contains(F.col("surface")))
    n = n.select("doc_id", "chunk_id", "term_key", count_in(F.col("surface"), F.col("text")).alias("n")).where("n > 0")
    return n.groupBy("doc_id", "chunk_id", "term_key").agg(F.sum("n").alias("n"))


def frequencies(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """(doc_id, term_key, frequency) of every term, 0 included."""
    n = occurrences(texts, glossary).groupBy("doc_id", "term_key").agg(F.sum("n").alias("frequency"))
    return glossary.where("term_key is not null and doc_id is not null").select("doc_id", "term_key").distinct().join(n, ["doc_id", "term_key"], "left").fillna(0, ["frequency"])


def selected(texts: DataFrame, glossary: DataFrame, top_n: int = 20, most: int = 50) -> DataFrame:
    """(doc_id, chunk_id, term_key, local, rank): the terms to show with each text: those in it,
    by frequency, then the book's most frequent others, ``most`` in all, the local ones first."""
    top_n, most = max(0, top_n), max(0, most)
    by = [F.coalesce("frequency", F.lit(0)).desc(), F.coalesce("source", F.lit("")), "term_key"]
    g = glossary.where("term_key is not null and doc_id is not null").select("doc_id", "term_key", "source", "frequency")
    top = g.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy(*by))).where(F.col("_r") <= top_n + most).drop("_r")
    local = occurrences(texts, glossary.where("source is not null and source <> ''")).select("doc_id", "chunk_id", "term_key").withColumn("local", F.lit(True))
    ids = texts.select("doc_id", "chunk_id").distinct()
    rest = ids.join(top.select("doc_id", "term_key"), "doc_id").join(local.drop("local"), ["doc_id", "chunk_id", "term_key"], "left_anti").withColumn("local", F.lit(False))
    every = local.unionByName(rest).join(g, ["doc_id", "term_key"])
    own = F.row_number().over(Window.partitionBy("doc_id", "chunk_id", "local").orderBy(*by))
    kept = every.withColumn("_own", own).where(F.col("local") | (F.col("_own") <= top_n))
    rank = F.row_number().over(Window.partitionBy("doc_id", "chunk_id").orderBy(F.col("local").desc(), *by))
    return kept.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "chunk_id", "term_key", "local", "rank")


def term_table(chosen: DataFrame, glossary: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, table): the chosen terms as a three-column Markdown table with pipes
    escaped, and under it what is known of gender."""
    g = glossary.select("term_key", "source", "target", "aliases", "gender", "gender_conflict")
    pipe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit(r"\|"))
    alias = F.array_join(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), pipe), ", ")
    row = F.concat(F.lit("| "), pipe(F.col("source")), F.lit(" | "), alias, F.lit(" | "), pipe(F.col("target")), F.lit(" |"))
    name = F.replace(F.coalesce("source", F.lit("")), F.lit("\n"), F.lit(" "))
    note = F.when(F.coalesce("gender_conflict", F.lit(False)), F.concat(F.lit("- "), name, F.lit(": gender unresolved (conflicting evidence); do not infer gender."))).when(F.coalesce("gender", F.lit("unknown")) != "unknown", F.concat(F.lit("- "), name, F.lit(": gender="), F.col("gender")))
    rows = chosen.join(g, "term_key").select("doc_id", "chunk_id", F.struct("rank", row.alias("row"), note.alias("note")).alias("r"))
    got = rows.groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_list("r")).alias("r"))  # no more than the cap of a selection
    notes = F.filter(F.transform("r", lambda x: x["note"]), lambda x: x.isNotNull())
    head = F.array(F.lit("| 原文 | 别名 | 译文 |"), F.lit("|------|------|------|"))
    body = F.concat(head, F.transform("r", lambda x: x["row"]), F.when(F.size(notes) > 0, F.concat(F.array(F.lit(""), F.lit("Entity attributes:")), notes)).otherwise(F.array().cast("array<string>")))
    return got.select("doc_id", "chunk_id", F.array_join(body, "\n").alias("table"))


def candidates(blocks: DataFrame, top_n: int = 30) -> DataFrame:
    """(doc_id, source, kind, frequency, rank): acronyms and hyphenated compounds of a book
    outside its references, the most frequent first, ties by name."""
    b = blocks.where("text is not null and not coalesce(is_reference, false)")
    edge = lambda p: F.lit(rf"(?<!{_W})(?:{p})(?!{_W})")
    caps = b.select("doc_id", F.explode(F.regexp_extract_all("text", edge(r"[A-Z0-9]{2,}(?:/[A-Z0-9]{2,})*"), F.lit(0))).alias("source"), F.lit("acronym").alias("kind"))
    caps = caps.where(~F.col("source").isin(*STOP_CAPITALS) & ~F.col("source").rlike(r"^\d+$"))
    pairs = b.select("doc_id", F.explode(F.regexp_extract_all("text", edge(r"[a-zA-Z]{2,}(?:-[a-zA-Z]{2,})+"), F.lit(0))).alias("source"), F.lit("compound").alias("kind"))
    pairs = pairs.withColumn("source", F.lower("source")).where(~F.col("source").isin(*STOP_COMPOUNDS))
    n = caps.unionByName(pairs).groupBy("doc_id", "source", "kind").agg(F.count("*").alias("frequency"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("frequency").desc(), "kind", "source"))
    return n.withColumn("rank", rank).where(F.col("rank") <= top_n)


def seeds(found: DataFrame, glossary: DataFrame) -> DataFrame:
    """Candidates whose name the book's glossary doesn't have, whatever the case."""
    have = glossary.where("source is not null").select("doc_id", F.lower("source").alias("_low")).distinct()
    return found.withColumn("_low", F.lower("source")).join(have, ["doc_id", "_low"], "left_anti").drop("_low")


def glossary_errors(glossary: DataFrame) -> DataFrame:
    """(term_key, errors): what a row or the surfaces of its book break, as sorted codes."""
    g = glossary
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    own = F.array_compact(F.array(
        F.when(blank("source"), F.lit("no_source")), F.when(blank("target"), F.lit("no_target")), F.when(F.col("aliases").isNull(), F.lit("null_aliases")), F.when(F.array_contains(F.coalesce("aliases", F.array().cast("array<string>")), F.col("source")), F.lit("alias_is_source")),
        F.when(~F.coalesce("gender", F.lit("")).isin("male", "female", "nonbinary", "unknown"), F.lit("gender")), F.when(~F.coalesce("confidence", F.lit("")).isin("low", "medium", "high"), F.lit("confidence")), F.when(F.coalesce("frequency", F.lit(-1)) < 0, F.lit("frequency")),
    ))
    shared = surfaces(g).groupBy("doc_id", "surface").agg(F.min("term_key").alias("lo"), F.max("term_key").alias("hi")).where("lo <> hi")
    clash = surfaces(g).join(shared, ["doc_id", "surface"], "left_semi").select("term_key").distinct().withColumn("_clash", F.lit("surface_not_unique"))
    rows = g.where("term_key is not null").select("term_key", own.alias("e")).join(clash, "term_key", "left")
    return rows.select("term_key", F.array_join(F.array_sort(F.array_compact(F.array_append("e", F.col("_clash")))), ",").alias("errors")).where("errors <> ''")


def term_hash(source: Column, target: Column, category: Column, aliases: Column, gender: Column, conflict: Column) -> Column:
    """SHA-256 of what of a term is shown; parts at their default are left out."""
    e = lambda c: F.coalesce(c, F.lit(""))
    a = F.array_sort(F.coalesce(aliases, F.array().cast("array<string>")))
    payload = F.concat(
        e(source), F.lit("→"), e(target), F.lit("|"), e(category), F.when(F.size(a) > 0, F.concat(F.lit('|aliases=["'), F.array_join(a, '", "'), F.lit('"]'))).otherwise(""),
        F.when(F.coalesce(gender, F.lit("unknown")) != "unknown", F.concat(F.lit("|gender="), gender)).otherwise(""), F.when(F.coalesce(conflict, F.lit(False)), F.lit("|gender_conflict=true")).otherwise(""),
    )
    return F.sha2(payload, 256)


def relevant_hashes(texts: DataFrame, glossary: DataFrame, name: str = "source", most: int = 50) -> DataFrame:
    """(doc_id, chunk_id, terms): of each text that has any, its selected terms that occur in it
    as a map of names to term hashes, of equal names the last; ``name`` is the glossary's column of names."""
    g = glossary.where("term_key is not null and doc_id is not null and source is not null and source <> ''")
    of = g.select("term_key", F.coalesce(name, "source").alias("_name"), F.coalesce("frequency", F.lit(0)).alias("_f"), "source", term_hash(*(F.col(c) for c in ("source", "target", "category", "aliases", "gender", "gender_conflict"))).alias("_hash"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "chunk_id").orderBy(F.col("_f").desc(), "source", "term_key"))
    local = occurrences(texts, g).join(of, "term_key").withColumn("_r", rank).where(F.col("_r") <= max(0, most))
    one = local.groupBy("doc_id", "chunk_id", "_name").agg(F.max_by("_hash", "term_key").alias("_hash"))
    return one.groupBy("doc_id", "chunk_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_name", "_hash")))).alias("terms"))
