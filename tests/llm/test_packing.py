import random

from folioflow.llm import packing as P
from folioflow.llm.tokens import VOCABULARY, encoding


def optimum(sizes, cap):
    """Fewest containers by trying every assignment."""
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i] and rooms[k] not in rooms[:k]:
                go(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, cap - sizes[i]])

    go(0, [])
    return best[0]


def test_search_is_exact_on_small_cases():
    rnd = random.Random(3)
    for _ in range(80):
        cap = rnd.randint(5, 40)
        sizes = sorted((rnd.randint(1, cap) for _ in range(rnd.randint(0, 9))), reverse=True)
        got = P.complete(list(sizes), cap)
        assert sorted(x for b in got for x in b) == sorted(sizes) and all(sum(b) <= cap for b in got)
        assert len(got) == (optimum(sizes, cap) if sizes else 0)


def test_beats_best_fit():
    assert len(P.best_fit([6, 5, 5, 4, 4, 3, 3], 10)) >= len(P.complete([6, 5, 5, 4, 4, 3, 3], 10)) == 3


def test_pack(spark):
    texts = ["word " * k for k in (3, 5, 7, 30, 0, 2, 2, 90)] + [None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as part", "'x' as container")
    c = spark.createDataFrame([(1, "a", 16, 1), (2, "b", 64, 0), (2, "b", 64, 0), (3, "none", 0, 0)], "spec_id int, spec_name string, capacity_tokens int, separator_tokens int")
    rows = P.pack(d, c).collect()
    for spec, cap, sep in ((1, 16, 1), (2, 64, 0)):
        own = [r for r in rows if r.spec_id == spec]
        for i, t in enumerate(texts):
            parts = sorted((r.token_start, r.n_tokens) for r in own if r.doc_id == i)
            n = len(encoding(VOCABULARY).encode_ordinary(t)) if t is not None else None
            assert (not parts) if n is None else sum(p[1] for p in parts) == n and (len(parts) == 1 or n > cap)
        fill = {}
        for r in own:
            fill.setdefault(r.container, []).append(r.n_tokens)
        assert all(sum(f) + sep * (len(f) - 1) <= cap for f in fill.values())
    rep = {r.spec_id: r for r in P.report(P.pack(d, c), c).collect()}
    assert rep.keys() == {1, 2} and all(r.n_containers >= r.fewest_by_size and r.fullest <= r.capacity_tokens for r in rep.values())
    assert P.pack(d.limit(0), c).count() == 0 and P.pack(d, c.limit(0)).count() == 0


def test_exact_search_has_no_limits():
    rnd = random.Random(8)
    for _ in range(25):
        cap = rnd.randint(20, 60)
        sizes = sorted((rnd.randint(cap // 6, cap // 2) for _ in range(10)), reverse=True)
        got = P.complete(list(sizes), cap, None, None, None)
        assert len(got) == optimum(sizes, cap) and sorted(x for b in got for x in b) == sorted(sizes)
    assert len(P.complete([7] * 50 + [3] * 50, 10, None, None, None)) == 50
