from collections import Counter

from folioflow.llm import mixing as M


def test_split_quotas():
    counts = {"a": 100, "b": 7, "c": 0}
    q = M.split_quotas(counts, 8, 1)
    assert {n: sum(x) for n, x in q.items()} == counts
    sizes = [sum(q[n][i] for n in q) for i in range(8)]
    assert max(sizes) - min(sizes) <= 2
    assert M.split_quotas({}, 4, 1) == {}


def test_mix(spark):
    rows = [(i, f"text number {i} of the harbour and the station " + "more words " * (i % 7), "Big " if i % 2 else "big") for i in range(900)]
    rows += [(10_000 + i, f"small text {i} of the village", "small") for i in range(5)] + [(20_000, "small text 0 of the village", "big"), (20_001, None, "small"), (20_002, "", "small"), (20_003, "lost", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as round", "2 as block", "'z' as mix_name")
    m = spark.createDataFrame([("x", "BIG", 3.0, 2, 4000), ("x", "small", 1.0, 3, 4000), ("x", "absent", 1.0, 3, 4000), ("y", "big", 0.5, 1, 100), (None, "big", 0.5, 1, 100), ("y", "small", None, 1, 100)], "mix_name string, source string, target_share double, max_repeats int, total_tokens long")
    mix = M.mixed(d, m)
    got = mix.collect()
    uses = Counter((r.mix_name, r.doc_id) for r in got)
    assert all(n <= (3 if k[1] >= 10_000 else 2) for k, n in uses.items()) and len({(r.mix_name, r.doc_id, r.round) for r in got}) == len(got)
    assert not any(k[1] == 20_000 for k in uses)  # a copy of a text that is used elsewhere
    rep = {(r.mix_name, r.source): r for r in M.report(mix, d, m).collect()}
    big, small, absent = rep[("x", "big")], rep[("x", "small")], rep[("x", "absent")]
    assert big.target_tokens == 2400 and 0 <= big.lacking_tokens <= 30 and small.repeats == 3 and small.lacking_tokens > 0 and absent.lacking_tokens == 800
    assert abs(sum(r.actual_share for k, r in rep.items() if k[0] == "x") - 1) < 1e-5
    assert 0 <= rep[("y", "big")].lacking_tokens < 30 and rep[("y", "small")].used_tokens == 0
    assert {r.shard for r in got if r.mix_name == "x"} <= set(range(M.SHARDS))
    places = {}
    for r in got:
        places.setdefault((r.mix_name, r.shard), []).append(r)
    for own in places.values():  # a rank in each shard, not in the order of ids or sources
        assert sorted(r.position for r in own) == list(range(len(own)))
    own = sorted(max(places.values(), key=len), key=lambda r: r.position)
    assert [r.doc_id for r in own] != sorted(r.doc_id for r in own)
    assert M.mixed(d.limit(0), m).count() == 0 and M.mixed(d, m.limit(0)).count() == 0


def test_running_sums_and_shards(spark):
    from pyspark.sql import functions as F

    rows = [("a" if i % 3 else "b", i, i % 5) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    got = M.running(df, ["g"], F.xxhash64("i"), ["i"], F.col("v"), "before").withColumn("h", F.xxhash64("i")).collect()
    for g in "ab":
        before = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: (r.h % 2**64, r.i)):
            assert r.before == before
            before += r.v
    assert M.n_shards(None) == M.SHARDS and M.n_shards(10**9) == 954 and M.n_shards(10**15) == M.MOST_SHARDS
