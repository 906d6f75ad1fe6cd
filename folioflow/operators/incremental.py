"""Processing only new or changed records.

A listing of what is there now (key columns and content digests) is anti-joined with a
manifest of what was last committed. A run stages what is pending, works from that stage
alone, writes its output into a folder named by the batch identifier, which is a digest of
the work itself, and commits its manifest entries last; a run that dies in between is repeated
under the same identifier and overwrites its own partial output, so that nothing is skipped
and nothing appears twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(col: Column) -> Column:
    """SHA-256 of the UTF-8 bytes as 32 raw bytes; null for null."""
    return F.unhex(F.sha2(col.cast("binary"), 256))


def parsed_digest(col: Column) -> Column:
    """A written SHA-256 as raw bytes, whatever its notation: either case, a ``sha256:`` or
    ``0x`` prefix, blanks, colons or dashes between digits, or Base64. Null stays null; what
    cannot be read becomes its own text's bytes, which equal no digest."""
    bare = F.regexp_replace(F.lower(F.trim(col)), r"^(sha-?256\s*[:=\-]?|0x)\s*", "")
    hexa = F.regexp_replace(bare, r"[\s:\-]", "")
    b64 = F.regexp_replace(F.trim(col), r"^(?i:sha-?256\s*[:=\-]?)\s*", "")
    return (
        F.when(col.isNull(), F.lit(None).cast("binary"))
        .when(hexa.rlike("^[0-9a-f]{64}$"), F.unhex(hexa))
        .when(b64.rlike(r"^[A-Za-z0-9+/]{43}=?$"), F.try_to_binary(F.rpad(b64, 44, "="), F.lit("base64")))
        .otherwise(F.encode(col, "UTF-8"))
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per key the values of the row that is greatest by ``order``; ties go to the greatest
    values, so that repeated rows never matter. Map-side combined: a key that holds a third
    of all rows sends one row per map task. Rows with a null key are dropped."""
    best = F.max(F.struct(*order, *(v for v in values if v not in order)))
    kept = df.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(best.alias("_best"))
    return kept.select(*keys, *(F.col(f"_best.{v}").alias(v) for v in values))


def pending(listing: DataFrame, manifest: DataFrame, keys: Sequence[str], digests: Sequence[str]) -> DataFrame:
    """Rows of ``listing`` without an equal row in ``manifest``: new keys and keys any digest of
    which differs (null equals null). Both sides have one row a key. Empty tables give,
    respectively, nothing and the whole listing."""
    m = manifest.select(*(F.col(c).alias(f"_m_{c}") for c in (*keys, *digests)))
    on = [listing[k] == m[f"_m_{k}"] for k in keys] + [listing[d].eqNullSafe(m[f"_m_{d}"]) for d in digests]
    return listing.join(m, on, "left_anti")


def plan_changes(listing: DataFrame, manifest: DataFrame, keys: Sequence[str], digests: Sequence[str]) -> DataFrame:
    """One row for every key of either side with ``action``: new, changed, same or gone."""
    a = listing.select(*keys, F.struct(*digests).alias("_now"))
    b = manifest.select(*keys, F.struct(*digests).alias("_then"))
    action = (
        F.when(F.col("_then").isNull(), "new")
        .when(F.col("_now").isNull(), "gone")
        .when(F.col("_now").eqNullSafe(F.col("_then")), "same")
        .otherwise("changed")
    )
    return a.join(b, list(keys), "full_outer").select(*keys, action.alias("action"))


def file_stats(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under a path as (path, size, modified); their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def file_listing(spark: SparkSession, path: str, glob: str = "*", known: DataFrame | None = None) -> DataFrame:
    """Files under a path as (path, size, modified, checksum), the listing of a file source.

    With ``known``, an earlier such listing, files of which size and time are as they were keep
    their checksum, and only those that differ are read. At most NAMED such files are read by
    name; if more differ, all are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    columns = ["path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("checksum")]
    if known is None:
        return files.load(path).select(*columns)
    old = known.select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"), "checksum")
    stats = file_stats(spark, path, glob).join(old, "path", "left")
    same = F.col("checksum").isNotNull() & (F.col("size") == F.col("_size")) & F.col("modified").eqNullSafe(F.col("_modified"))
    kept = stats.where(same).select("path", "size", "modified", "checksum")
    names = [r.path for r in stats.where(~same).select("path").limit(NAMED + 1).collect()]
    if not names:
        return kept
    if len(names) > NAMED:
        return files.load(path).select(*columns)
    return kept.unionByName(spark.read.format("binaryFile").load(names).select(*columns))


#: Files that differ are read by name up to so many, manifests are folded into one from so many.
NAMED, FOLD = 10_000, 50


class Conflict(RuntimeError):
    """Another run has committed since this one read the manifest; nothing of this one counts."""


class Increment:
    """Runs over what is pending, with a manifest in ``root``.

    A run first writes the pending rows to ``.staging`` and works from there alone, so that a
    source that changes meanwhile is neither half processed nor taken for processed: what is
    committed are the digests of just the rows that were worked. ``out/batch=<id>`` holds the
    output, ``manifest/batch=<id>`` committed keys and digests; ``<id>`` is the run's number and a
    digest of its rows, so that a run that died is repeated under its own name and overwrites
    what it left. The number is claimed by creating a file that no two runs can create; a run
    that finds it taken raises Conflict, and a claim that a dead run left is carried through or
    dropped by the next one. Output counts only if its batch is in the manifest."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], digests: Sequence[str]):
        self.spark, self.root, self.keys, self.digests = spark, root.rstrip("/"), list(keys), list(digests)

    def _path(self, *parts: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str, prefix: str) -> list[str]:
        fs, path = self._path(folder)
        if not fs.exists(path):
            return []
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(path)) if n.startswith(prefix))

    def _committed(self) -> list[str]:
        return self._names("manifest", "batch=")

    def manifest(self, schema: DataFrame) -> DataFrame:
        """The last committed digests of every key."""
        rows = self._manifest()
        return schema.select(*self.keys, *self.digests).limit(0) if rows is None else rows.drop("batch_no")

    def _manifest(self) -> DataFrame | None:
        """(keys, digests, batch_no): from the last fold of manifests and the batches after it."""
        folds = self._names("manifest", "fold=")
        after = folds[-1][5:] if folds else ""
        names = folds[-1:] + [n for n in self._committed() if n[6:] > after]
        if not names:
            return None
        rows = self.spark.read.parquet(*(f"{self.root}/manifest/{n}" for n in names))
        return latest(rows, self.keys, ["batch_no"], [*self.digests, "batch_no"])

    def fold(self) -> None:
        """Puts all manifests committed so far into one, which later reads start from."""
        names = self._committed()
        if names:
            last = names[-1][6:]
            self._manifest().write.mode("overwrite").parquet(f"{self.root}/.staging/fold={last}")
            fs, to = self._path("manifest", f"fold={last}")
            if not fs.exists(to):
                fs.rename(self._path(".staging", f"fold={last}")[1], to)

    def output(self, batch: str | None = None) -> DataFrame | None:
        """All committed output, or a batch's; what a failed run left behind is not read."""
        names = [n for n in self._committed() if batch in (None, n[6:])]
        return self.spark.read.option("basePath", f"{self.root}/out").parquet(*(f"{self.root}/out/{n}" for n in names)) if names else None

    def current(self) -> DataFrame | None:
        """Of the committed output, which must hold the keys, each key's of its last batch."""
        rows = self.output()
        if rows is None:
            return None
        number = F.substring_index(F.col("batch").cast("string"), "-", 1).cast("int")
        return rows.withColumn("batch_no", number).join(self._manifest().select(*self.keys, "batch_no"), [*self.keys, "batch_no"], "left_semi").drop("batch", "batch_no")

    def run(self, listing: DataFrame, process: Callable[[DataFrame], DataFrame]) -> str | None:
        """Processes what is pending and commits; the batch identifier, or None if nothing was."""
        self._settle()
        work = self._staged(pending(listing, self.manifest(listing), self.keys, self.digests))
        number = len(self._committed())
        mark = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in (*self.keys, *self.digests)))
        n, s, x = work.agg(F.count("*"), F.sum(F.shiftright(mark, 20)), F.bit_xor(mark)).first()
        if not n:
            return None
        batch = f"{number:06d}-{n}-{(s or 0) & (2**64 - 1):x}-{(x or 0) & (2**64 - 1):x}"
        self._write(process(work), f"out/batch={batch}")
        self._write(work.select(*self.keys, *self.digests, F.lit(number).alias("batch_no")), f".staging/batch={batch}")
        self._commit(number, batch)
        if (number + 1) % FOLD == 0:
            self.fold()
        return batch

    def adopt(self, manifest: DataFrame) -> None:
        """Takes over what another system committed, as the first batch of an empty manifest."""
        if self._committed():
            raise ValueError("the manifest is not empty")
        self._write(manifest.select(*self.keys, *self.digests, F.lit(0).alias("batch_no")), ".staging/batch=000000-adopted")
        self._write(manifest.select(*self.keys).limit(0), "out/batch=000000-adopted")
        self._commit(0, "000000-adopted")

    def _staged(self, todo: DataFrame) -> DataFrame:
        to = f"{self.root}/.staging/work-{uuid.uuid4().hex}"
        todo.write.parquet(to)
        return self.spark.read.schema(todo.schema).parquet(to)

    def _write(self, rows: DataFrame, to: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{to}")

    def _commit(self, number: int, batch: str) -> None:
        fs, claim = self._path("manifest", f"_claim-{number:06d}")
        fs.mkdirs(claim.getParent())
        try:
            stream = fs.create(claim, False)
        except Exception as e:
            raise Conflict(json.dumps({"batch": batch, "error": "another run took this number"})) from e
        stream.write(batch.encode())
        stream.close()
        self._rename(batch)

    def _rename(self, batch: str) -> None:
        fs, to = self._path("manifest", f"batch={batch}")
        if not fs.exists(to) and not fs.rename(self._path(".staging", f"batch={batch}")[1], to):
            raise RuntimeError(json.dumps({"batch": batch, "error": "the manifest could not be committed"}))

    def _settle(self) -> None:
        """Ends what a run left that died between its claim and its commit: its output and its
        manifest were whole by then, so that they are committed; a claim without a name is dropped."""
        done = {n[6:12] for n in self._committed()}
        for name in self._names("manifest", "_claim-"):
            if name[7:] not in done:
                fs, claim = self._path("manifest", name)
                stream = fs.open(claim)
                batch = bytes(stream.readAllBytes()).decode()
                stream.close()
                if batch and fs.exists(self._path(".staging", f"batch={batch}")[1]):
                    self._rename(batch)
                else:
                    fs.delete(claim, False)
