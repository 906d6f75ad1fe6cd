"""Problem 7: filling fixed-capacity containers with items.

Bin completion: the largest text left is set into a new container and the fillings around it
are enumerated; a filling is passed over if another one takes, for each of its texts, one at
least as large. Branch and bound over the containers prunes where the waste so far leaves no
room for fewer containers than the incumbent has; the incumbent is best-fit decreasing or the
best packing found since. Texts of one size are interchangeable, so that only sizes are packed.

Texts are spread over groups by hash, each of about GROUP_CONTAINERS containers' worth and at
least GROUP_TEXTS texts, which bounds what one task holds; a group wastes at most its last
container. Only a text that alone exceeds the capacity is divided, into full containers and a
rest that is packed like a text. The search is a budget: it stops at ``nodes`` containers tried
a group, which leaves the incumbent, and the fillings around one largest text stop at
``fillings`` found or ``tries`` texts tried, so that a better one may be passed over. With None
for all three the search is exact within a group, in time that may grow exponentially with its
texts. All texts are assigned either way. Between two texts of a container stand its separator tokens.

Null texts are not assigned; empty texts have 0 tokens and are. A capacity that is null or not
positive has no containers.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.context import checkpoint, read
from folioflow.llm.tokens import VOCABULARY, sized

GROUP_CONTAINERS, GROUP_TEXTS, NODES, FILLINGS, TRIES = 300, 1_000, 2_000, 24, 400


class Sizes:
    """A multiset of sizes that gives the largest within a limit."""

    def __init__(self, sizes: list[int]):
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.order = sorted(self.count)

    def __bool__(self) -> bool:
        return bool(self.order)

    def take(self, s: int) -> None:
        self.count[s] -= 1
        if not self.count[s]:
            del self.count[s]
            self.order.pop(bisect_right(self.order, s) - 1)

    def give(self, s: int) -> None:
        if s not in self.count:
            self.count[s] = 0
            self.order.insert(bisect_right(self.order, s), s)
        self.count[s] += 1

    def fillings(self, room: int, most: int | None = FILLINGS, tries: int | None = TRIES) -> list[tuple[int, ...]]:
        """Undominated sets that fit the room, least waste first; stops at a perfect one."""
        most, tries = math.inf if most is None else most, math.inf if tries is None else tries
        found: list[tuple[int, tuple[int, ...]]] = []
        path: list[int] = []
        left = [tries]

        def walk(room: int, upto: int) -> bool:
            i = bisect_right(self.order, min(room, upto)) - 1
            if i < 0:
                found.append((room, tuple(path)))
                return room == 0
            while i >= 0 and left[0] > 0 and len(found) < most:
                s = self.order[i]
                if path.count(s) < self.count[s] if s == upto else True:
                    left[0] -= 1
                    path.append(s)
                    done = walk(room - s, s)
                    path.pop()
                    if done:
                        return True
                    # A smaller start cannot fill as well once what is left of it all would not.
                    if found and found[-1][0] == 0:
                        return True
                i -= 1
            if not found:
                found.append((room, tuple(path)))
            return False

        walk(room, room)
        found.sort()
        out: list[tuple[int, ...]] = []
        for _, f in found:
            if not any(_dominates(g, f) for g in out):
                out.append(f)
        return out or [()]


def _dominates(g: tuple[int, ...], f: tuple[int, ...]) -> bool:
    """For each of f's sizes g has one at least as large (both fall)."""
    return len(f) <= len(g) and all(x >= y for x, y in zip(g, f))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing."""
    rooms, by_room = [], []  # sorted room with container number
    bins: list[list[int]] = []
    for s in sorted(sizes, reverse=True):
        i = bisect_right(by_room, (s, -1))
        if i < len(by_room):
            room, b = by_room.pop(i)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(s)
        rest = (room - s, b)
        by_room.insert(bisect_right(by_room, rest), rest)
    del rooms
    return bins


def complete(sizes: list[int], capacity: int, nodes: int | None = NODES, fillings: int | None = FILLINGS, tries: int | None = TRIES) -> list[list[int]]:
    """Containers of sizes, as few as the search finds; every size must be within capacity.
    None sets a limit of the search aside."""
    if not sizes:
        return []
    total = sum(sizes)
    fewest = max(-(-total // capacity), sum(2 * s > capacity for s in sizes))
    best = best_fit(sizes, capacity)
    if len(best) <= fewest:
        return best
    left, bins, todo, waste = Sizes(sizes), [], [], 0
    budget = math.inf if nodes is None else nodes + 2 * len(best)
    while budget > 0:
        budget -= 1
        allowed = (len(best) - 1) * capacity - total
        if not left:
            if len(bins) < len(best):
                best = [list(b) for b in bins]
                if len(best) <= fewest:
                    return best
            options: list[tuple[int, ...]] = []
        else:
            first = left.order[-1]
            left.take(first)
            options = [(first, *f) for f in left.fillings(capacity - first, fillings, tries)]
            left.give(first)
        todo.append([o for o in reversed(options) if waste + capacity - sum(o) <= allowed])
        while todo and not todo[-1]:  # back to the last container with another filling
            todo.pop()
            if bins:
                gone = bins.pop()
                waste -= capacity - sum(gone)
                for s in gone:
                    left.give(s)
        if not todo:
            break
        o = todo[-1].pop()
        for s in o:
            left.take(s)
        bins.append(o)
        waste += capacity - sum(o)
    return best


def pack(documents: DataFrame, containers: DataFrame, path: str = VOCABULARY, nodes: int | None = NODES, fillings: int | None = FILLINGS, tries: int | None = TRIES) -> DataFrame:
    """(spec_id, spec_name, container, position, doc_id, part, token_start, n_tokens)."""
    sizes = checkpoint(sized(documents, "doc_id", path=path))
    specs = containers.where("capacity_tokens > 0 and spec_id is not null").select("spec_id", "spec_name", F.col("capacity_tokens").alias("cap"), F.greatest(F.coalesce("separator_tokens", F.lit(0)), F.lit(0)).alias("sep")).dropDuplicates(["spec_id"])
    few = specs.collect()  # a table of settings
    if not few:
        return sizes.limit(0).selectExpr("0 as spec_id", "'' as spec_name", "'' as container", "0 as position", "doc_id", "0 as part", "0 as token_start", "n_tokens")
    n_docs, n_tokens = sizes.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    mean = max(1.0, n_tokens / max(1, n_docs))
    groups = {r.spec_id: max(1, int(n_docs / max(GROUP_TEXTS, GROUP_CONTAINERS * r.cap / mean))) for r in few}
    rows = sizes.withColumn("s", F.explode(F.array(*(F.struct(F.lit(r.spec_id).alias("spec_id"), F.lit(r.spec_name).alias("spec_name"), F.lit(r.cap).alias("cap"), F.lit(r.sep).alias("sep"), F.lit(groups[r.spec_id]).alias("n_groups")) for r in few))))
    rows = rows.select("doc_id", "n_tokens", "s.*").withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / F.col("cap")).cast("int") - 1, F.lit(0)))))
    rows = rows.select("spec_id", "spec_name", "cap", "sep", "doc_id", "part", (F.col("part") * F.col("cap")).alias("token_start"), F.least("cap", F.col("n_tokens") - F.col("part") * F.col("cap")).alias("n"), F.pmod(F.xxhash64("doc_id", "part"), F.col("n_groups")).alias("group"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        cap, sep = int(pdf["cap"].iloc[0]), int(pdf["sep"].iloc[0])
        pdf = pdf.sort_values(["n", "doc_id", "part"], kind="stable")
        weight = (pdf["n"] + sep).tolist()
        at: dict[int, list[int]] = {}
        for i, w in enumerate(weight):
            at.setdefault(w, []).append(i)
        where, place = [0] * len(pdf), [0] * len(pdf)
        for b, items in enumerate(complete(weight, cap + sep, nodes, fillings, tries)):
            for k, w in enumerate(items):
                i = at[w].pop()
                where[i], place[i] = b, k
        prefix = f"{pdf['spec_id'].iloc[0]}-{pdf['group'].iloc[0]}-"
        return pd.DataFrame({"spec_id": pdf["spec_id"], "spec_name": pdf["spec_name"], "container": [prefix + str(b) for b in where], "position": place, "doc_id": pdf["doc_id"], "part": pdf["part"], "token_start": pdf["token_start"], "n_tokens": pdf["n"]})

    return rows.groupBy("spec_id", "group").applyInPandas(fill, "spec_id int, spec_name string, container string, position int, doc_id bigint, part int, token_start int, n_tokens int")


def report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per row of ``containers``: containers used, the fewest possible by size, room left over."""
    per = packed.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    c = containers.select("spec_id", "spec_name", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("sep")).dropDuplicates(["spec_id"])
    used = F.col("t") + F.col("sep") * (F.col("k") - 1)
    return per.join(F.broadcast(c), "spec_id").groupBy("spec_id", "spec_name", "capacity_tokens").agg(
        F.count("*").alias("n_containers"), F.ceil(F.sum(used + F.col("sep")) / (F.col("capacity_tokens") + F.first("sep"))).alias("fewest_by_size"),
        F.sum("k").alias("n_items"), F.max(used).alias("fullest"), F.round(1 - F.sum(used) / (F.count("*") * F.col("capacity_tokens")), 6).alias("unused_share"),
    )


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), read(spark, sf_dir, "containers"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(checkpoint(p7_containers(spark, sf_dir)), read(spark, sf_dir, "containers"))


QUERIES = {"p7_containers": p7_containers, "p7_report": p7_report}
ORACLE: dict[str, str] = {}
