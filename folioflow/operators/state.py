"""Planning what to do from hashes: actions per chunk, merge gate, manifest checks, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators.incremental import digest, parsed_digest


def first_of(*cases: tuple[Column, str]) -> Column:
    """The name of the first condition that holds, else null."""
    out = F.lit(None).cast("string")
    for condition, name in reversed(cases):
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return out


def manifest_chunks(manifests: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, m_ord, m_source_hash, output_file, block_ids) of current manifests."""
    c = manifests.select("doc_id", F.explode("chunks").alias("c"))
    return c.select("doc_id", F.col("c.id").alias("chunk_id"), F.col("c.ord").alias("m_ord"), F.col("c.source_hash").alias("m_source_hash"), F.col("c.output_file").alias("output_file"), F.col("c.block_ids").alias("block_ids"))


def plan(chunks: DataFrame, manifests: DataFrame, state: DataFrame, untracked: str = "record", glossary: DataFrame | None = None, contract: str | None = None, verified: bool = False, on_drift: bool = False, name: str = "source") -> DataFrame:
    """(doc_id, chunk_id, action, reason): the first rule that applies decides. An output that
    is missing, empty or blank, a source that is no longer what was cut or what was recorded, a
    contract other than the recorded one, a term of another hash mean translate; an output that
    was never recorded, or was edited since, means record, or translate if records must be ``verified``.

    With a glossary, terms that occur in a chunk and are not in ``entity_ids_used`` (which has
    the glossary's ``name``) mean translate ``on_drift``, else they are only given as a reason,
    before that of an edited output. Hashes are compared if the state has ``entity_hashes_used``
    (a map by name); provenance ``bypassed_reference`` needs no terms."""
    from folioflow.operators.terms import relevant_hashes

    c = chunks.select("doc_id", "chunk_id", digest(F.col("source")).alias("_s"), digest(F.col("output")).alias("_o"), F.col("output").isNull().alias("_none"), (F.col("output") == "").alias("_empty"), F.col("output").rlike(r"^[\s\p{Z}]*$").alias("_blank"))
    m = manifest_chunks(manifests).groupBy("doc_id", "chunk_id").agg(F.max(parsed_digest(F.col("m_source_hash"))).alias("_m"))
    has = lambda x, kind: F.col(x) if x in state.columns else F.lit(None).cast(kind)
    s = state.select("doc_id", "chunk_id", F.lit(True).alias("_known"), parsed_digest(F.col("source_hash")).alias("_rs"), parsed_digest(F.col("output_hash")).alias("_ro"), parsed_digest(has("contract_hash", "string")).alias("_rc"), has("provenance", "string").alias("_from"), F.coalesce(has("entity_ids_used", "array<string>"), F.array().cast("array<string>")).alias("_ids"), has("entity_hashes_used", "map<string,string>").alias("_hashes"))
    j = c.join(m, ["doc_id", "chunk_id"], "left").join(s, ["doc_id", "chunk_id"], "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    if glossary is None:
        j = j.withColumn("_terms", none)
    else:
        texts = chunks.select("doc_id", "chunk_id", F.col("source").alias("text")).join(state.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_semi")
        j = j.join(relevant_hashes(texts, glossary, name).withColumnRenamed("terms", "_terms"), ["doc_id", "chunk_id"], "left").withColumn("_terms", F.coalesce("_terms", none))
    bypassed = F.coalesce(F.col("_from") == "bypassed_reference", F.lit(False))
    drift = ~bypassed & (F.size(F.array_except(F.map_keys("_terms"), F.col("_ids"))) > 0)
    rehashed = F.lit("entity_hashes_used" in state.columns) & ~bypassed & ~drift & F.exists(F.map_entries("_terms"), lambda e: ~e["value"].eqNullSafe(F.try_element_at(F.col("_hashes"), e["key"])))
    edited = ~F.col("_ro").eqNullSafe(F.col("_o"))
    reason = first_of(
        (F.col("_none"), "missing_output"), (F.col("_empty"), "empty_output"), (F.col("_blank"), "blank_output"), (F.col("_m") != F.col("_s"), "manifest_source_hash_changed"),
        (F.col("_known").isNull(), "untracked_existing_output"), (F.lit(verified) & ~F.coalesce(F.col("_from").isin("verified_dispatch", "bypassed_reference"), F.lit(False)), "legacy_unverified"),
        (F.lit(contract is not None) & ~F.col("_rc").eqNullSafe(parsed_digest(F.lit(contract).cast("string"))), "translation_contract_changed"), (~F.col("_rs").eqNullSafe(F.col("_s")), "source_hash_changed_since_record"),
        (F.lit(on_drift) & drift, "glossary_term_selection_changed"), (rehashed, "glossary_term_hash_changed"),
        (drift & edited, "glossary_term_selection_changed_ignored,output_hash_changed_since_record"), (drift, "glossary_term_selection_changed_ignored"), (edited, "output_hash_changed_since_record"),
    )
    record = "translate" if verified else "record"
    action = F.when(F.col("reason").isNull() | (F.col("reason") == "glossary_term_selection_changed_ignored"), "unchanged").when(F.col("reason") == "untracked_existing_output", "translate" if verified else untracked).when(F.col("reason").endswith("output_hash_changed_since_record"), record).otherwise("translate")
    return j.withColumn("reason", reason).select("doc_id", "chunk_id", action.alias("action"), F.coalesce("reason", F.lit("")).alias("reason"))


def plan_summary(planned: DataFrame, first: int = 10) -> DataFrame:
    """(doc_id, action, n_chunks, sample): counts and the first chunk ids of each action."""
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("doc_id", "action").orderBy("chunk_id"))
    few = planned.withColumn("_r", r).where(F.col("_r") <= first).groupBy("doc_id", "action").agg(F.array_join(F.array_sort(F.collect_list("chunk_id")), ",").alias("sample"))
    return planned.groupBy("doc_id", "action").agg(F.count("*").alias("n_chunks")).join(few, ["doc_id", "action"])


def merge_gate(chunks: DataFrame, manifests: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, error, warning) of every chunk in a manifest that may not be merged, or
    whose output is under a tenth of its source in bytes; and of chunks that no manifest has."""
    m = manifest_chunks(manifests).groupBy("doc_id", "chunk_id").agg(F.max(parsed_digest(F.col("m_source_hash"))).alias("_m"), F.lit(True).alias("_in"))
    size = lambda c: F.octet_length(c)
    c = chunks.select("doc_id", "chunk_id", F.lit(True).alias("_has"), digest(F.col("source")).alias("_s"), size("source").alias("_ns"), size("output").alias("_no"), F.col("output").rlike(r"^[\s\p{Z}]*$").alias("_blank"))
    c = c.join(manifests.where("chunks is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    j = m.join(c, ["doc_id", "chunk_id"], "full_outer")
    error = first_of((F.col("_in").isNull(), "orphan"), (F.col("_has").isNull(), "missing_source"), (F.col("_m") != F.col("_s"), "stale_source"), (F.col("_no").isNull(), "missing_output"), (F.col("_no") == 0, "empty_output"), (F.col("_blank"), "blank_output"))
    short = (F.col("_ns") > 0) & (F.col("_no") < F.col("_ns") * 0.1)
    j = j.withColumn("error", error)
    j = j.withColumn("warning", F.when(F.col("error").isNull() & short, "suspiciously_short"))
    return j.where("error is not null or warning is not null").select("doc_id", "chunk_id", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("warning", F.lit("")).alias("warning"))


def manifest_errors(manifests: DataFrame) -> DataFrame:
    """(doc_id, errors): what a book's current manifest breaks, as sorted codes."""
    c = F.coalesce("chunks", F.array().cast(manifests.schema["chunks"].dataType))
    ids, ords = F.transform(c, lambda x: x["id"]), F.transform(c, lambda x: x["ord"])
    e = F.array(
        F.when(F.col("chunks").isNull(), F.lit("no_chunks")), F.when(F.coalesce(F.col("chunk_count") != F.size(c), F.lit(True)), F.lit("chunk_count")), F.when(F.size(F.array_distinct(ids)) != F.size(ids), F.lit("duplicate_id")),
        F.when((F.size(c) > 0) & ~F.array_sort(ords).eqNullSafe(F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1)))), F.lit("order")), F.when(F.exists(c, lambda x: x["id"].isNull() | x["source_hash"].isNull() | x["output_file"].isNull()), F.lit("null_field")),
        F.when(~F.coalesce("split_complete", F.lit(False)), F.lit("incomplete")), F.when(F.col("source_hash").isNull(), F.lit("no_source_hash")),
    )
    return manifests.select("doc_id", F.array_join(F.array_sort(F.array_compact(e)), ",").alias("errors")).where("errors <> ''")


def block_coverage(manifests: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, n_missing, n_unknown, n_repeated): a book's blocks that no chunk has, ids in
    chunks that are no block, ids that several chunks have."""
    ids = manifest_chunks(manifests).select("doc_id", F.explode("block_ids").alias("id")).groupBy("doc_id", "id").agg(F.count("*").alias("k"))
    b = blocks.join(manifests.where("chunks is not null").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "id").distinct().withColumn("_b", F.lit(1))
    j = ids.join(b, ["doc_id", "id"], "full_outer")
    return j.groupBy("doc_id").agg(F.count_if(F.col("k").isNull()).alias("n_missing"), F.count_if(F.col("_b").isNull()).alias("n_unknown"), F.count_if(F.col("k") > 1).alias("n_repeated"))


def source_cache(found: DataFrame, cached: DataFrame) -> DataFrame:
    """(key, verdict) of sources by (key, checksum, size) now and as cached: new, adopt where
    the cached entry cannot be read (null), reuse where both agree, else mismatch."""
    c = cached.select("key", F.lit(True).alias("_c"), F.col("checksum").alias("_h"), F.col("size").alias("_n"))
    verdict = F.when(F.col("_c").isNull(), "new").when(F.col("_h").isNull() | F.col("_n").isNull(), "adopt").when((F.col("checksum") == F.col("_h")) & (F.col("size") == F.col("_n")), "reuse").otherwise("mismatch")
    return found.join(c, "key", "left").select("key", verdict.alias("verdict"))


#: What shows that a chunk holds more than references.
MORE_THAN_REFERENCES = ("acknowledg", "致谢", "利益冲突", "competing interest", "conflict of interest", "author contribution", "作者贡献", "author information", "作者信息", "affiliations", "supplementary information", "补充信息", "department of", "university", "institute of", "hospital")


def reference_chunks(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, n_blocks): chunks that need no translation, as all their blocks are
    references and nothing in their text speaks of end matter."""
    t = F.col("text")
    ref = F.coalesce("is_reference", F.lit(False)) | ((F.col("kind") == "heading") & F.coalesce(F.lower(t).rlike("references|参考文献|bibliography"), F.lit(False)))
    b = blocks.select("doc_id", "id", ref.alias("ref"))
    ids = chunks.select("doc_id", "chunk_id", F.explode(F.regexp_extract_all("source", F.lit(r"(?m)^<!--\s*tb:(b\d+)\s*-->"), F.lit(1))).alias("id")).distinct()
    pure = ids.join(b, ["doc_id", "id"], "left").groupBy("doc_id", "chunk_id").agg(F.count("*").alias("n_blocks"), F.min(F.coalesce("ref", F.lit(False))).alias("pure")).where("pure")
    more = F.lower("source").rlike("|".join(MORE_THAN_REFERENCES))
    return pure.join(chunks.where(~more).select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_semi").select("doc_id", "chunk_id", "n_blocks")


def term_drift(chunks: DataFrame, glossary: DataFrame, state: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, n_now, n_then, n_added, n_dropped) of recorded chunks: the names of
    the terms that occur in the source now, and those that were used at the last run."""
    from folioflow.operators.terms import occurrences

    texts = chunks.select("doc_id", "chunk_id", F.col("source").alias("text")).join(state.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_semi")
    now = occurrences(texts, glossary).join(glossary.select("term_key", F.col("source").alias("name")), "term_key").select("doc_id", "chunk_id", "name").distinct().withColumn("_n", F.lit(1))
    then = state.select("doc_id", "chunk_id", F.explode("entity_ids_used").alias("name")).distinct().withColumn("_t", F.lit(1))
    j = now.join(then, ["doc_id", "chunk_id", "name"], "full_outer")
    return j.groupBy("doc_id", "chunk_id").agg(F.count("_n").alias("n_now"), F.count("_t").alias("n_then"), F.count_if(F.col("_t").isNull()).alias("n_added"), F.count_if(F.col("_n").isNull()).alias("n_dropped"))
