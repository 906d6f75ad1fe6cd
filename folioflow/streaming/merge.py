"""Observations merged as files arrive, and running progress.

Each micro-batch goes through the same manifest as a batch run (``Increment``): an observation
whose content was already merged is passed over, one that changed is merged again, and a batch
that is replayed after a failure writes the same output once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators.incremental import Increment, latest

#: Where each phase begins, in percent.
PHASES = {"prepare": 0, "split": 15, "translate": 25, "patch_terms": 75, "build": 85, "audit_layout": 95, "done": 100}


def content_hash(df: DataFrame, *skip: str) -> Column:
    """SHA-256 of a row's content, without the columns to skip."""
    return F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c not in skip))), 256)


def merge_observations(spark: SparkSession, source: str, root: str, checkpoint: str) -> StreamingQuery:
    """A query over Parquet files of observations in ``source``: new or changed ones of each
    chunk are written under ``root``, each content once."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)

    def merge(batch: DataFrame, _: int) -> None:
        b = batch.withColumn("meta_hash", content_hash(batch, "arrived_at"))
        values = [c for c in b.columns if c not in ("doc_id", "chunk_id", "arrived_at")]
        now = latest(b, ["doc_id", "chunk_id"], ["arrived_at", "meta_hash"], values).persist()
        Increment(spark, root, ["doc_id", "chunk_id"], ["meta_hash"]).run(now, lambda d: d)
        now.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def percent(done: Column, total: Column) -> Column:
    """Progress of the translating phase: 25 to 75 by the share done, without fractions."""
    lo, hi = PHASES["translate"], PHASES["patch_terms"]
    return F.floor(lo + (hi - lo) * done / F.greatest(total, F.lit(1))).cast("int")


def progress(state: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, n_done, percent): books by their chunks with a committed run."""
    done = state.where("status = 'committed'").select("doc_id", "chunk_id").distinct().withColumn("_d", F.lit(1))
    c = chunks.select("doc_id", "chunk_id").distinct().join(done, ["doc_id", "chunk_id"], "left")
    g = c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count("_d").alias("n_done"))
    return g.withColumn("percent", percent(F.col("n_done"), F.col("n_chunks")))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, value): events in windows of time; on a stream, rows later than
    ``late`` are dropped by the watermark, which bounds the state."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))
