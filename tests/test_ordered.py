import random

from pyspark.sql import functions as F

from folioflow.operators.folds import stream_fold
from folioflow.operators.graph import components, reachable
from folioflow.operators.ordered import Ordered


def _rows(n=200, seed=1):
    rnd = random.Random(seed)
    return [(rnd.choice("ab"), rnd.randrange(60), i, rnd.choice([None, 1, 2, 3])) for i in range(n)]


def test_running_values_against_plain_loops(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id string, ord int, id int, v int").withColumn("_t", F.lit("clash")).drop("_t")
    o = Ordered(df, stretch=7).running_sum("s", F.col("v")).running_sum("x", F.col("v"), inclusive=False).last_seen("l", F.col("v")).last_seen("m", F.col("v"), inclusive=False)
    o = o.neighbour("p", F.col("v")).neighbour("n", F.col("v"), before=False)
    got = {r.id: r for r in o.rows().collect()}
    assert len(got) == len(rows)
    for key in "ab":
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        total, last = 0, None
        for i, r in enumerate(own):
            g = got[r[2]]
            assert g.x == total and g.m == last
            total, last = total + (r[3] or 0), r[3] if r[3] is not None else last
            assert g.s == total and g.l == last
            assert g.p == (own[i - 1][3] if i else None) and g.n == (own[i + 1][3] if i + 1 < len(own) else None)
    assert Ordered(df.limit(0)).running_sum("s", F.col("v")).rows().count() == 0


def test_fold_does_not_depend_on_partitions(spark):
    rows = _rows(300, 2)
    df = spark.createDataFrame(rows, "doc_id string, ord int, id int, v int")
    step = lambda s, r: (int(s + (r.v or 0)) % 10, s)
    want = None
    for parts in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = sorted((r.id, r.out) for r in stream_fold(df, ["doc_id"], ["ord", "id"], step, lambda: 0, "out").collect())
        assert want in (None, got)
        want = got
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    for key in "ab":
        s = 0
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            assert dict(want)[r[2]] == s
            s = (s + (r[3] or 0)) % 10


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    parent = list(range(500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    out = components(spark.range(500).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in out.collect()} == {i: find(i) for i in range(500)}


def test_reachable_ends_on_cycles(spark):
    links = spark.createDataFrame([("b", "Taighi", "Taig"), ("b", "Taig", "Tai"), ("b", "x", "y"), ("b", "y", "x"), ("c", "Taig", "Tai"), ("b", "Tai", "Taighi")], "doc_id string, node string, via string")
    start = spark.createDataFrame([("b", "Tai")], "doc_id string, node string")
    assert sorted(r.node for r in reachable(links, start, ["doc_id"]).collect()) == ["Tai", "Taig", "Taighi"]
    assert reachable(links.limit(0), start, ["doc_id"]).count() == 0
