"""Session helpers: reading tables, checkpoints on shared storage, small-table broadcasts."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once a context: their Python may not find it."""
    sc = spark.sparkContext
    if not getattr(sc, "_folioflow_shipped", False):
        sc._folioflow_shipped = True
        home = os.path.dirname(os.path.abspath(__file__))
        to = os.path.join(tempfile.mkdtemp(prefix="folioflow-"), "folioflow_shipped.zip")
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(home):
                for name in files:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, os.path.dirname(home)))
        sc.addPyFile(to)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table as a DataFrame."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only where the session names none and runs on this machine alone (tests) a temporary
    folder of it is taken; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "folioflow-checkpoint")
        os.makedirs(root[7:], exist_ok=True)
    return root


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager)


def salted(df: DataFrame, parts: int, *by: str) -> DataFrame:
    """Adds ``_salt`` in [0, parts), spread by the given columns."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int"))


def replicated(df: DataFrame, parts: int) -> DataFrame:
    """The other side of a salted join: every row once per salt."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))


def spread(df: DataFrame) -> DataFrame:
    """The rows over at least as many partitions as there are cores: a table of one small file
    would else be worked by one core, however much is to be done with each row. A table that
    is read in enough partitions stays as it is and is not shuffled."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df._jdf.queryExecution().toRdd().getNumPartitions() < want else df
