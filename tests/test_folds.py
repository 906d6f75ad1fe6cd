import random

import pytest

from folioflow.operators import folds


@pytest.mark.parametrize("stretch", [25, 4096])
def test_stretches_give_what_one_pass_gives(spark, stretch):
    rnd = random.Random(stretch)
    rows = [("hot", i, f"x{i}", rnd.randint(0, 9)) for i in range(150)] + [(f"d{b}", i * 3, f"x{i}", rnd.randint(0, 9)) for b in range(6) for i in range(rnd.randint(1, 30))]
    rows += [("none", None, "x", 5), (None, 4, "y", 7), ("null", 1, "z", None)]
    df = spark.createDataFrame(rows, "doc_id string, ord int, id string, size int")
    for target in (12, 160):  # with the second a state runs through whole stretches

        def step(state, r):
            (full,) = state
            starts = full is None or full + (r.size or 0) > target
            return ((0 if starts else full) + (r.size or 0),), starts

        want = {}
        for d, o, i, v in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2])):
            state, no = want.get(("state", d), ((None,), 0))
            state, starts = step(state, type("R", (), {"size": v}))
            want[("state", d)], want[(d, o, i)] = (state, no + starts), no + starts
        got = folds.stretched_fold(df, ["doc_id"], "ord", ["id"], step, lambda: (None,), "no", number=True, stretch=stretch).collect()
        assert len(got) == len(rows) and all(want[(r.doc_id, r.ord, r.id)] == r.no for r in got if r.doc_id is not None)
    flags = folds.stretched_fold(df, ["doc_id"], "ord", ["id"], step, lambda: (None,), "cut", stretch=stretch)
    assert flags.where("cut").count() == sum(want[("state", d)][1] for d in {r[0] for r in rows})
    assert folds.stretched_fold(df.limit(0), ["doc_id"], "ord", ["id"], step, lambda: (None,), "no", number=True).count() == 0


def _packed(sizes, target):
    """Chunk numbers of one book's (size, heading) rows, row by row."""
    numbers, no, full, used = [], 0, 0, False
    for size, heading in sizes:
        big = size > 2 * target
        if big or not used or (heading and full > 0) or full + size > target:
            no, full = no + 1, 0
        full, used = (0, False) if big else (full + size, True)
        numbers.append(no)
    return numbers


def test_books_with_far_positions_take_few_jobs(spark):
    """Rows lie thousands of positions apart and cuts depend on all that was before."""
    from folioflow.operators.chunking import structural_chunks

    rnd = random.Random(5)
    books = {f"b{b}": [(7 if b % 2 else rnd.randint(0, 60), rnd.random() < 0.02 * (b % 3)) for _ in range(14)] for b in range(3)}
    rows = [(b, i * 5_000, s, h) for b, sizes in books.items() for i, (s, h) in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id string, ord long, size int, heading boolean")
    spark.sparkContext.setJobGroup("far", "far positions")
    got = {(r.doc_id, r.ord): r.chunk_no for r in structural_chunks(df, 24).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("far")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {(b, i * 5_000): n for b, sizes in books.items() for i, n in enumerate(_packed(sizes, 24))}
    assert len(jobs) < 30


@pytest.mark.parametrize("turns", [0, 1, 3])
def test_cuts_that_never_meet_end_in_one_stream(spark, turns, monkeypatch):
    """Rows of one size: where a stretch cuts depends on the first row of the book."""
    from folioflow.operators import chunking

    monkeypatch.setattr(folds, "TURNS", turns)
    monkeypatch.setattr(chunking, "stretched_fold", lambda *a, **k: folds.stretched_fold(*a, **k, stretch=11))
    books = {"a": [(3, False)] * 5, "hot": [(1, False)] * 170 + [(90, False)] + [(2, False)] * 130, "next": [(1, False)] * 140, None: [(4, False)] * 40}
    rows = [(b, (1 << 60) + i, s, h) for b, sizes in books.items() for i, (s, h) in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id string, ord long, size int, heading boolean")
    got = {(r.doc_id, r.ord): r.chunk_no for r in chunking.structural_chunks(df, 31).collect()}
    assert got == {(b, (1 << 60) + i): n for b, sizes in books.items() for i, n in enumerate(_packed(sizes, 31))}
