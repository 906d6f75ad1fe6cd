"""Queries of problem 3: chunks that are new or differ from what was last committed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.context import checkpoint_root, read
from folioflow.operators.incremental import Increment, digest, latest, parsed_digest, plan_changes

KEYS, DIGESTS = ["doc_id", "chunk_id"], ["source_hash", "output_hash"]


def current_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each chunk's greatest revision; texts are hashed where they are read and
    never shuffled."""
    c = read(spark, sf_dir, "chunks")
    rows = c.select(*KEYS, "revision", "arrived_at", digest(F.col("source")).alias("source_hash"), digest(F.col("output")).alias("output_hash"))
    return latest(rows, KEYS, ["revision", "arrived_at"], DIGESTS)


def committed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each chunk's committed run with the greatest number."""
    r = read(spark, sf_dir, "run_state").where(F.col("status") == "committed")
    rows = r.select(*KEYS, "run_no", "updated_at", parsed_digest(F.col("source_hash")).alias("source_hash"), parsed_digest(F.col("output_hash")).alias("output_hash"))
    return latest(rows, KEYS, ["run_no", "updated_at"], DIGESTS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks to process now: an incremental run whose manifest starts with what ``run_state``
    says was committed, and whose output are the keys of the chunks it worked."""
    run = Increment(spark, f"{checkpoint_root(spark)}/increment-{uuid.uuid4().hex}", KEYS, DIGESTS)
    run.adopt(committed_state(spark, sf_dir))
    now = current_chunks(spark, sf_dir)
    batch = run.run(now, lambda work: work.select(*KEYS))
    return run.output(batch).select(*KEYS) if batch else now.select(*KEYS).limit(0)


def p3_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by action and book, those gone from ``chunks`` included."""
    acts = plan_changes(current_chunks(spark, sf_dir), committed_state(spark, sf_dir), KEYS, DIGESTS)
    return acts.groupBy("doc_id", "action").agg(F.count("*").alias("n_chunks"))


_SQL = """
with c as (
  select doc_id, chunk_id, sha256(source) as sh, case when output is null then null else sha256(output) end as oh,
    row_number() over (partition by doc_id, chunk_id order by revision desc, arrived_at desc, source desc) as rn
  from chunks where doc_id is not null and chunk_id is not null),
r as (
  select doc_id, chunk_id, regexp_replace(lower(trim(source_hash)), '^(sha-?256\\s*[:=-]?|0x)\\s*', '') as sh,
    regexp_replace(lower(trim(output_hash)), '^(sha-?256\\s*[:=-]?|0x)\\s*', '') as oh,
    row_number() over (partition by doc_id, chunk_id order by run_no desc, updated_at desc) as rn
  from run_state where status = 'committed' and doc_id is not null and chunk_id is not null),
c1 as (select * from c where rn = 1), r1 as (select * from r where rn = 1)
"""

QUERIES = {"p3_found": p3_found, "p3_actions": p3_actions}
ORACLE = {
    "p3_found": _SQL
    + """select c1.doc_id, c1.chunk_id from c1 left join r1 using (doc_id, chunk_id)
where r1.rn is null or c1.sh is distinct from r1.sh or c1.oh is distinct from r1.oh""",
    "p3_actions": _SQL
    + """select doc_id, case when r1.rn is null then 'new' when c1.rn is null then 'gone'
  when c1.sh is not distinct from r1.sh and c1.oh is not distinct from r1.oh then 'same' else 'changed' end as action, count(*) as n_chunks
from c1 full outer join r1 using (doc_id, chunk_id) group by 1, 2""",
}
