"""Merging observations of many chunks into one glossary: grouping, routing of conflicts,
alias chains, evidence and attributes. All grouping is combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators.graph import reachable
from folioflow.operators.incremental import latest

EVIDENCE = 5
_LISTS = ["new_entities", "alias_hypotheses", "attribute_hypotheses", "used_term_sources", "conflicts"]


def current(meta: DataFrame) -> DataFrame:
    """The last arrived observation of each chunk, and only those without errors."""
    m = latest(meta, ["doc_id", "chunk_id"], ["arrived_at", "schema_version"], _LISTS)
    return m.join(errors(meta), ["doc_id", "chunk_id"], "left_anti")


def errors(meta: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, errors): what a chunk's last observation breaks, as sorted codes."""
    m = latest(meta, ["doc_id", "chunk_id"], ["arrived_at", "schema_version"], ["schema_version", *_LISTS])
    long = lambda c: F.exists(F.coalesce(c, F.array().cast(m.schema[c].dataType)), lambda x: F.coalesce(F.length(x["evidence"]) > 200, F.lit(True)))
    blank = lambda c, f: F.exists(F.coalesce(c, F.array().cast(m.schema[c].dataType)), lambda x: F.coalesce(F.trim(x[f]) == "", F.lit(True)))
    e = F.array(
        F.when(F.col("schema_version").isNull(), F.lit("no_version")), F.when(F.col("schema_version") != 1, F.lit("version")), *(F.when(long(c), F.lit(f"evidence:{c}")) for c in ("new_entities", "alias_hypotheses", "attribute_hypotheses", "conflicts")),
        F.when(blank("new_entities", "source"), F.lit("blank:source")), F.when(blank("new_entities", "target_proposal"), F.lit("blank:target")), F.when(blank("alias_hypotheses", "variant"), F.lit("blank:variant")), F.when(blank("alias_hypotheses", "may_be_alias_of_source"), F.lit("blank:alias_of")),
    )
    return m.select("doc_id", "chunk_id", F.array_join(F.array_sort(F.array_compact(e)), ",").alias("errors")).where("errors <> ''")


def surface_index(glossary: DataFrame) -> DataFrame:
    """(doc_id, surface, owner, role, target, category): each name of a book's glossary and the
    term that has it; of several the one with the greatest key, an alias before a source."""
    g = glossary.where("doc_id is not null and term_key is not null")
    named = g.select("doc_id", F.col("source").alias("surface"), F.struct("term_key", F.lit("source").alias("role"), "target", "category").alias("o"))
    alias = g.select("doc_id", F.explode("aliases").alias("surface"), F.struct("term_key", F.lit("alias").alias("role"), "target", "category").alias("o"))
    rank = F.struct(F.col("o.term_key"), (F.col("o.role") == "alias").cast("int"))
    best = named.union(alias).where("surface is not null").groupBy("doc_id", "surface").agg(F.max_by("o", rank).alias("o"))
    return best.select("doc_id", "surface", F.col("o.term_key").alias("owner"), "o.role", "o.target", "o.category")


def proposals(meta: DataFrame) -> DataFrame:
    """(doc_id, source, target, category, n_chunks): distinct proposals for each name."""
    e = current(meta).select("doc_id", "chunk_id", F.explode("new_entities").alias("e"))
    e = e.select("doc_id", "chunk_id", F.col("e.source").alias("source"), F.col("e.target_proposal").alias("target"), F.coalesce("e.category", F.lit("")).alias("category"))
    return e.groupBy("doc_id", "source", "target", "category").agg(F.countDistinct("chunk_id").alias("n_chunks"))


def alias_candidates(meta: DataFrame) -> DataFrame:
    """(doc_id, variant, candidate, n_chunks)."""
    a = current(meta).select("doc_id", "chunk_id", F.explode("alias_hypotheses").alias("a"))
    return a.groupBy("doc_id", F.col("a.variant").alias("variant"), F.col("a.may_be_alias_of_source").alias("candidate")).agg(F.countDistinct("chunk_id").alias("n_chunks"))


def routed(meta: DataFrame, glossary: DataFrame) -> DataFrame:
    """(doc_id, name, kind, n_variants, n_candidates): what is to become of each proposed name:
    auto_apply, conflicting_new_entity_proposals, existing_entity_conflict, no_change,
    new_entity_existing_alias or alias_or_new_entity."""
    idx = surface_index(glossary).withColumnsRenamed({"surface": "name", "target": "_target", "category": "_category"})
    p = proposals(meta).withColumnRenamed("source", "name").join(idx, ["doc_id", "name"], "left")
    same = F.col("target").eqNullSafe(F.col("_target")) & (F.col("category") == F.coalesce("_category", F.lit("")))
    p = p.groupBy("doc_id", "name").agg(F.count("*").alias("n_variants"), F.count_if(~same).alias("_differ"), F.first("role").alias("role"))
    a = alias_candidates(meta).groupBy("doc_id", F.col("variant").alias("name")).agg(F.count("*").alias("n_candidates"))
    a = a.join(idx.select("doc_id", "name", F.col("role").alias("_known")), ["doc_id", "name"], "left").where("_known is null").drop("_known")
    both = p.join(a, ["doc_id", "name"], "full_outer")
    kind = (
        F.when(F.col("n_variants").isNull(), F.when(F.col("n_candidates") >= 2, "alias_or_new_entity")).when(F.col("n_candidates").isNotNull(), "alias_or_new_entity")
        .when(F.col("role") == "source", F.when(F.col("_differ") > 0, "existing_entity_conflict").otherwise("no_change")).when(F.col("role") == "alias", "new_entity_existing_alias")
        .when(F.col("n_variants") == 1, "auto_apply").otherwise("conflicting_new_entity_proposals")
    )
    return both.select("doc_id", "name", kind.alias("kind"), F.coalesce("n_variants", F.lit(0)).alias("n_variants"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates")).where("kind is not null")


def alias_chain(meta: DataFrame, glossary: DataFrame) -> DataFrame:
    """(doc_id, variant): names that can become aliases, also through other names that can: of
    one candidate, not claimed otherwise, in chains of any length."""
    route = routed(meta, glossary)
    standalone = route.where("kind <> 'no_change'").select("doc_id", F.col("name").alias("node")).union(surface_index(glossary).select("doc_id", "surface")).distinct()
    one = alias_candidates(meta).groupBy("doc_id", F.col("variant").alias("node")).agg(F.min("candidate").alias("via"), F.count("*").alias("n")).where("n = 1")
    free = one.join(standalone, ["doc_id", "node"], "left_anti")
    return reachable(free, standalone, ["doc_id"]).select("doc_id", F.col("node").alias("variant"))


def evidence(meta: DataFrame) -> DataFrame:
    """(doc_id, source, refs, n_refs, confidence): for each proposed name the last five chunks
    that named it, in order of arrival, and the confidence that their number gives."""
    m = current(meta).select("doc_id", "chunk_id", F.explode("new_entities").alias("e"))
    arrived = latest(meta, ["doc_id", "chunk_id"], ["arrived_at"], ["arrived_at"])
    m = m.select("doc_id", "chunk_id", F.col("e.source").alias("source")).distinct().join(arrived, ["doc_id", "chunk_id"])
    last = F.row_number().over(Window.partitionBy("doc_id", "source").orderBy(F.col("arrived_at").desc(), F.col("chunk_id").desc()))
    top = m.withColumn("_r", last).where(F.col("_r") <= EVIDENCE)  # limited before the shuffle
    top = top.groupBy("doc_id", "source").agg(F.sort_array(F.collect_list(F.struct("_r", "chunk_id")), asc=False).alias("r"))
    n = F.size("r")
    confidence = F.when(n >= 3, "high").when(n == 2, "medium").otherwise("low")
    return top.select("doc_id", "source", F.array_join(F.transform("r", lambda x: x["chunk_id"]), ",").alias("refs"), n.alias("n_refs"), confidence.alias("confidence"))


def genders(meta: DataFrame) -> DataFrame:
    """(doc_id, entity, gender, conflict): the fold of what was observed, in order of arrival:
    the first value known holds until another one, or unknown, follows, which makes it unknown
    for good. Found by two aggregates: the first known value, and any other after it."""
    arrived = latest(meta, ["doc_id", "chunk_id"], ["arrived_at"], ["arrived_at"])
    a = current(meta).select("doc_id", "chunk_id", F.posexplode("attribute_hypotheses").alias("i", "a")).where("a.attribute = 'gender'")
    a = a.join(arrived, ["doc_id", "chunk_id"]).select("doc_id", F.col("a.entity_source").alias("entity"), F.col("a.value").alias("v"), F.struct("arrived_at", "chunk_id", "i").alias("at"))
    known = F.when(F.col("v") != "unknown", F.col("at"))
    first = a.groupBy("doc_id", "entity").agg(F.min(known).alias("_at"), F.min_by("v", known).alias("_v"))
    r = a.join(first, ["doc_id", "entity"]).groupBy("doc_id", "entity").agg(F.first("_v").alias("_v"), F.max(F.coalesce((F.col("at") > F.col("_at")) & (F.col("v") != F.col("_v")), F.lit(False))).alias("conflict"))
    return r.select("doc_id", "entity", F.when(F.col("conflict") | F.col("_v").isNull(), "unknown").otherwise(F.col("_v")).alias("gender"), "conflict")


def field_conflicts(meta: DataFrame, glossary: DataFrame) -> DataFrame:
    """(doc_id, entity, field, current, proposed): flagged conflicts with a term of the book."""
    c = current(meta).select("doc_id", F.explode("conflicts").alias("c"))
    c = c.select("doc_id", F.col("c.entity_source").alias("entity"), F.col("c.field").alias("field"), F.col("c.observed_better").alias("proposed")).distinct()
    g = surface_index(glossary).select("doc_id", F.col("surface").alias("entity"), "target", "category")
    now = F.when(F.col("field") == "target", F.col("target")).when(F.col("field") == "category", F.col("category"))
    return c.join(g, ["doc_id", "entity"]).select("doc_id", "entity", "field", now.alias("current"), "proposed")


def applied(decisions: DataFrame, glossary: DataFrame) -> DataFrame:
    """(doc_id, name, kind, ok, error): decisions (doc_id, kind, name, target, category, alias_of)
    as they would be carried out: first names are created, then aliases are attached, also to
    names created just now or attached before. A name that the book already has, that is decided
    twice, or whose owner cannot be reached is an error, and a book with any error changes in
    nothing: all its decisions are then not ok."""
    have = surface_index(glossary).select("doc_id", F.col("surface").alias("node"))
    made = decisions.where("kind = 'create'").select("doc_id", F.col("name").alias("node"))
    start = have.union(made).distinct()
    links = decisions.where("kind = 'alias'").select("doc_id", F.col("name").alias("node"), F.col("alias_of").alias("via"))
    got = reachable(links, start, ["doc_id"]).withColumn("_got", F.lit(1))
    twice = decisions.groupBy("doc_id", "name").agg(F.count("*").alias("_k"))
    d = decisions.join(twice, ["doc_id", "name"]).join(have.select("doc_id", F.col("node").alias("name"), F.lit(1).alias("_have")).distinct(), ["doc_id", "name"], "left")
    d = d.join(got.withColumnRenamed("node", "name"), ["doc_id", "name"], "left")
    error = F.when(F.col("_have").isNotNull(), "exists").when(F.col("_k") > 1, "twice").when((F.col("kind") == "alias") & F.col("_got").isNull(), "unreached").otherwise("")
    d = d.select("doc_id", "name", "kind", error.alias("error"))
    bad = d.where("error <> ''").select("doc_id").distinct().withColumn("_bad", F.lit(1))
    return d.join(bad, "doc_id", "left").select("doc_id", "name", "kind", F.col("_bad").isNull().alias("ok"), "error")
