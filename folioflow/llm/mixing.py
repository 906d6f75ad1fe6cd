"""Problem 8: mixing sources to target weights.

Per mix, each source's share of the total size is its quota, shares being scaled to sum to 1.
A source's texts are cut into blocks by hash, which bounds a block to about BLOCK texts; a
source is used whole as often as its quota and its cap allow, and of the next round as many
blocks as fit, in permuted order, and texts of the block at the edge, so that the share is met
to within a text. Which shard of the output a block goes to is drawn by a splitting tree: at
each node of the tree over shards the blocks of all sources are divided between the two sides
by a multivariate hypergeometric draw, down to exact quotas for each shard; each source's
permuted blocks are then dealt out by those quotas, and each shard is shuffled by itself:
``position`` counts a shard's texts in the order of a random key. There are as many shards as
SHARD_TOKENS go into the mix's total, SHARDS at least and MOST_SHARDS at most, which bounds
the tree. Ranks and running sums are taken in two levels, over RANGES stretches of the key
and within each, so that no source and no shard is one task's.

Copies of a text are one text, which belongs to the mix's source of its least doc_id, so that
no text is used more than ``max_repeats`` times. Sources are matched without case and outer
blanks; rows of one source in a mix are added up, with the least cap. A null or non-positive
share counts as 0, a cap under 1 as 0 uses. Null and empty texts are not used.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.context import checkpoint, read
from folioflow.llm.cutoff import source_key
from folioflow.llm.tokens import VOCABULARY, sized

BLOCK, SHARDS, SEED = 256, 16, 20
MOST_SHARDS, SHARD_TOKENS, RANGES = 65_536, 1 << 20, 4_096


def targets(mix: DataFrame) -> DataFrame:
    """(mix_name, source, share, cap, quota), a row for each source of a mix."""
    t = mix.where("mix_name is not null").select("mix_name", source_key(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("s"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("cap"), "total_tokens")
    t = t.where("source is not null").groupBy("mix_name", "source").agg(F.sum("s").alias("s"), F.min("cap").alias("cap"), F.max("total_tokens").alias("total"))
    share = F.col("s") / F.nullif(F.sum("s").over(Window.partitionBy("mix_name")), F.lit(0.0))
    t = t.withColumn("share", F.coalesce(share, F.lit(0.0))).withColumn("total", F.max("total").over(Window.partitionBy("mix_name")))
    return t.select("mix_name", "source", "share", "cap", "total", F.floor(F.col("share") * F.col("total")).cast("long").alias("quota"))


def split_quotas(counts: dict[str, int], shards: int, seed: int) -> dict[str, list[int]]:
    """How many blocks of each source go to each shard; every shard gets its part of all."""
    names = sorted(counts)
    out = {n: [0] * shards for n in names}
    rnd = np.random.default_rng(seed)

    def split(lo: int, hi: int, c: np.ndarray) -> None:
        if hi - lo == 1:
            for n, k in zip(names, c):
                out[n][lo] = int(k)
            return
        mid = (lo + hi) // 2
        left = round(int(c.sum()) * (mid - lo) / (hi - lo))
        taken = rnd.multivariate_hypergeometric(c, left, method="marginals") if c.sum() else c
        split(lo, mid, taken)
        split(mid, hi, c - taken)

    if names:
        split(0, shards, np.array([counts[n] for n in names], dtype=np.int64))
    return out


def _permuted(*cols: str) -> Column:
    return F.xxhash64(F.lit(SEED), *cols)


def running(df: DataFrame, by: list[str], key: Column, ties: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each in the order of (key, ties) within
    ``by``: sums of stretches of the key are run over the group, and rows within a stretch."""
    df = df.withColumn("_key", key).withColumn("_range", F.shiftrightunsigned("_key", 52)).withColumn("_value", value)
    over = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*by, "_range").agg(F.sum("_value").alias("_base"))
    sums = sums.select(*by, "_range", F.coalesce(F.sum("_base").over(over), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*by, "_range").orderBy("_key", *ties).rowsBetween(Window.unboundedPreceding, -1)
    df = df.join(sums, [*by, "_range"]).withColumn(name, F.col("_base") + F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return df.drop("_key", "_range", "_value", "_base")


def n_shards(total: int | None, least: int = SHARDS) -> int:
    """How many shards a mix of so many tokens has."""
    return min(MOST_SHARDS, max(least, -(-int(total or 0) // SHARD_TOKENS)))


def texts_of(documents: DataFrame, goals: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(mix_name, source, doc_id, n_tokens, block): the distinct texts that a mix may use.
    Tokens are counted once a text; texts themselves are not shuffled."""
    d = documents.where("text <> ''").select("doc_id", "text", source_key(F.col("source")).alias("source"), F.sha2("text", 256).alias("key"))
    d = sized(d, "doc_id", "source", "key", path=path).where("n_tokens > 0")
    rows = d.join(F.broadcast(goals.select("mix_name", "source")), "source")  # as many rows as mix_targets
    one = rows.groupBy("mix_name", "key").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("d")).select("mix_name", "d.*")
    sizes = one.groupBy("mix_name", "source").agg(F.greatest(F.floor(F.count("*") / BLOCK), F.lit(1)).alias("n_blocks"))
    return one.join(F.broadcast(sizes), ["mix_name", "source"]).withColumn("block", F.pmod(_permuted("doc_id"), F.col("n_blocks"))).drop("n_blocks")


def chosen(texts: DataFrame, goals: DataFrame) -> DataFrame:
    """(mix_name, source, doc_id, n_tokens, block, round): the texts drawn, with repetitions."""
    per = checkpoint(texts.groupBy("mix_name", "source", "block").agg(F.sum("n_tokens").alias("t")))
    per = running(per, ["mix_name", "source"], _permuted("mix_name", "source", "block"), ["block"], F.col("t"), "before")
    have = texts.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("have"))
    g = goals.select("mix_name", "source", "cap", "quota").join(F.broadcast(have), ["mix_name", "source"])
    g = g.withColumn("full", F.least(F.col("cap"), F.floor(F.col("quota") / F.col("have"))).cast("int"))
    g = g.withColumn("rest", F.when(F.col("full") < F.col("cap"), F.col("quota") - F.col("full") * F.col("have")).otherwise(0))
    b = per.join(F.broadcast(g), ["mix_name", "source"]).withColumn("whole", F.col("before") + F.col("t") <= F.col("rest"))
    b = b.withColumn("edge", ~F.col("whole") & (F.col("before") < F.col("rest")))
    b = b.select("mix_name", "source", "block", (F.col("full") + F.col("whole").cast("int")).alias("uses"), "full", "edge", (F.col("rest") - F.col("before")).alias("room"))
    rows = texts.join(b, ["mix_name", "source", "block"])
    used = rows.where("uses > 0").withColumn("round", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    within = Window.partitionBy("mix_name", "source", "block").orderBy(_permuted("mix_name", "doc_id"), "doc_id")
    edge = rows.where("edge").withColumn("_sum", F.sum("n_tokens").over(within)).where("_sum <= room").withColumn("round", F.col("full") + 1)
    cols = ["mix_name", "source", "doc_id", "n_tokens", "block", "round"]
    return used.select(*cols).unionByName(edge.select(*cols))


def mixed(documents: DataFrame, mix: DataFrame, shards: int = SHARDS, path: str = VOCABULARY) -> DataFrame:
    """(mix_name, shard, position, source, doc_id, round, n_tokens), the mixes in their shards."""
    goals = checkpoint(targets(mix))
    rows = checkpoint(chosen(checkpoint(texts_of(documents, goals, path)), goals))
    blocks = checkpoint(rows.select("mix_name", "source", "block", "round").distinct())
    counts = blocks.groupBy("mix_name", "source").agg(F.count("*").alias("n")).collect()  # no more rows than mix_targets
    totals = {r.mix_name: r.total for r in goals.groupBy("mix_name").agg(F.max("total").alias("total")).collect()}
    names = sorted({r.mix_name for r in counts})
    ranges = []
    for i, m in enumerate(names):
        for source, quota in split_quotas({r.source: r.n for r in counts if r.mix_name == m}, n_shards(totals[m], shards), SEED + i).items():
            ends = np.cumsum(quota).tolist()
            ranges.append((m, source, ends))
    spark = documents.sparkSession
    dealt = spark.createDataFrame(ranges, "mix_name string, source string, ends array<long>")
    placed = running(blocks, ["mix_name", "source"], _permuted("source", "mix_name", "block", "round"), ["round", "block"], F.lit(1), "_rank")
    placed = placed.join(F.broadcast(dealt), ["mix_name", "source"])  # MOST_SHARDS numbers for each row of mix_targets at most
    placed = placed.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("_rank")))).select("mix_name", "source", "block", "round", "shard")
    out = checkpoint(rows.join(placed, ["mix_name", "source", "block", "round"]))
    out = running(out, ["mix_name", "shard"], F.xxhash64(F.lit(SEED), "doc_id", "round", "mix_name"), ["doc_id", "round"], F.lit(1), "position")
    return out.select("mix_name", "shard", "position", "source", "doc_id", "round", "n_tokens")


def report(mixes: DataFrame, documents: DataFrame, mix: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Per mix and source: the share wanted and reached, tokens wanted, used and lacking, and
    the most times a text was used."""
    goals = checkpoint(targets(mix))
    have = texts_of(documents, goals, path).groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("available_tokens"), F.count("*").alias("available_texts"))
    used = mixes.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("used_tokens"), F.count("*").alias("n_uses"), F.max("round").alias("repeats"))
    r = goals.join(F.broadcast(have), ["mix_name", "source"], "left").join(F.broadcast(used), ["mix_name", "source"], "left").fillna(0)
    total = F.sum("used_tokens").over(Window.partitionBy("mix_name"))
    return r.select(
        "mix_name", "source", F.round("share", 6).alias("target_share"), F.round(F.coalesce(F.col("used_tokens") / F.nullif(total, F.lit(0)), F.lit(0.0)), 6).alias("actual_share"), F.col("quota").alias("target_tokens"), "used_tokens",
        (F.col("quota") - F.col("used_tokens")).alias("lacking_tokens"), "available_tokens", "available_texts", "n_uses", "repeats", F.col("cap").alias("max_repeats"),
    )


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, m = read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets")
    return report(mixed(d, m), d, m)


QUERIES = {"p8_mix": p8_mix, "p8_report": p8_report}
ORACLE: dict[str, str] = {}
