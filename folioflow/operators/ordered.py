"""Running values over an order that no single task has to walk.

A key's rows are cut into stretches of STRETCH positions. Within a stretch a window does the
work; of each stretch one summary row is kept, and only those are run over per key. A key that
holds a third of all rows so has as many tasks as it has stretches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 4_096


class Ordered:
    """Rows in order: ``position`` is a whole number that grows along the order, ``ties`` decide
    between rows of one position. Each method adds a column and gives a new Ordered."""

    def __init__(self, df: DataFrame, keys: Sequence[str] = ("doc_id",), position: str = "ord", ties: Sequence[str] = ("id",), stretch: int = STRETCH):
        self.keys, self.position, self.ties, self.stretch = list(keys), position, list(ties), stretch
        self.df = df if "_stretch" in df.columns else df.withColumn("_stretch", F.floor(F.col(position) / stretch))

    def _with(self, df: DataFrame) -> Ordered:
        return Ordered(df, self.keys, self.position, self.ties, self.stretch)

    def _inside(self):
        return Window.partitionBy(*self.keys, "_stretch").orderBy(self.position, *self.ties)

    def _across(self):
        return Window.partitionBy(*self.keys).orderBy("_stretch")

    def _carry(self, summary: DataFrame) -> DataFrame:
        on = [self.df[k].eqNullSafe(summary[k]) for k in [*self.keys, "_stretch"]]
        return self.df.join(summary, on, "left").drop(*(summary[k] for k in [*self.keys, "_stretch"]))

    def running_sum(self, name: str, value: Column, inclusive: bool = True) -> Ordered:
        """The sum up to a row, with it or without."""
        d = self._with(self.df.withColumn("_v", F.coalesce(value, F.lit(0)).cast("long")))
        total = d.df.groupBy(*self.keys, "_stretch").agg(F.sum("_v").alias("_t"))
        total = total.select(*self.keys, "_stretch", F.coalesce(F.sum("_t").over(self._across().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_c"))
        local = F.sum("_v").over(self._inside().rowsBetween(Window.unboundedPreceding, 0))
        out = d._carry(total).withColumn(name, local + F.col("_c") - (F.lit(0) if inclusive else F.col("_v")))
        return self._with(out.drop("_v", "_c"))

    def last_seen(self, name: str, value: Column, inclusive: bool = True) -> Ordered:
        """The last value that is not null up to a row, with it or without."""
        d = self._with(self.df.withColumn("_v", value))
        at = F.struct(self.position, *self.ties)
        last = d.df.where(F.col("_v").isNotNull()).groupBy(*self.keys, "_stretch").agg(F.max_by("_v", at).alias("_t"))
        every = d.df.select(*self.keys, "_stretch").distinct()
        on = [every[k].eqNullSafe(last[k]) for k in [*self.keys, "_stretch"]]
        last = every.join(last, on, "left").select(*(every[k] for k in [*self.keys, "_stretch"]), "_t")
        last = last.select(*self.keys, "_stretch", F.last("_t", ignorenulls=True).over(self._across().rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
        local = F.last("_v", ignorenulls=True).over(self._inside().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
        out = d._carry(last).withColumn(name, F.coalesce(local, F.col("_c")))
        return self._with(out.drop("_v", "_c"))

    def neighbour(self, name: str, value: Column, before: bool = True) -> Ordered:
        """The value of the row before, or of the row after; null at the ends."""
        d = self._with(self.df.withColumn("_v", value))
        at = F.struct(self.position, *self.ties)
        edge = (F.max_by if before else F.min_by)(F.struct("_v"), at)
        edges = d.df.groupBy(*self.keys, "_stretch").agg(edge.alias("_t"))
        shift = F.lag("_t") if before else F.lead("_t")
        edges = edges.select(*self.keys, "_stretch", shift.over(self._across()).alias("_c"))
        boxed = F.struct("_v")
        local = (F.lag(boxed) if before else F.lead(boxed)).over(self._inside())
        out = d._carry(edges).withColumn(name, F.coalesce(local, F.col("_c"))["_v"])
        return self._with(out.drop("_v", "_c"))

    def rows(self) -> DataFrame:
        return self.df.drop("_stretch")
