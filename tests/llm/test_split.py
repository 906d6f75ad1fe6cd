import random

from pyspark.sql import functions as F

from folioflow.llm import split as S


def rebuilt(text, pieces):
    out, at = "", 0
    for a, b in pieces:
        assert a <= at < b or not text
        out, at = out + text[at:b], b
    return out


def test_round_trip_and_overlap():
    rnd = random.Random(1)
    words = ["quiet", "harbour", "the", "a", "ledger.", "moon,", "path;", "end!\n\n", "line\n", "港务局。", "é" * 40]
    for _ in range(300):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 200)))
        limit, overlap = rnd.randint(1, 120), rnd.choice([0, 1, 10, 50, 500])
        p = S.split_offsets(text, limit, overlap)
        assert rebuilt(text, p) == text
        if len(text) > limit:
            assert all(0 < b - a <= limit for a, b in p)
            o = min(overlap, limit - 1)
            assert all(x[1] - y[0] == o for x, y in zip(p, p[1:]))


def test_natural_boundaries():
    text = "One two three. Four five six. Seven eight nine."
    assert [text[a:b] for a, b in S.split_offsets(text, 20, 0)] == ["One two three. ", "Four five six. ", "Seven eight nine."]
    assert S.split_offsets(None, 5, 0) == [] and S.split_offsets("", 5, 0) == [(0, 0)] and S.split_offsets("abcdef", 0, 0) == [(0, 6)]
    assert S.split_offsets("x" * 25, 10, 0) == [(0, 10), (10, 20), (20, 25)]
    assert S.split_offsets("é" * 4, 3, 0)[0] == (0, 2)


def test_limits(spark):
    rows = [("1200", 1200), ("1,200", 1200), ("1200.0", 1200), ("600 chars", 600), ("custom", None), (None, None), ("1.5k", 1500), ("1e3", 1000), ("", None), ("12 34", None)]
    got = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, a string").select("i", S.written_number(F.col("a")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [b for _, b in rows]


def test_blocks(spark):
    m = spark.createDataFrame(
        [("a", 2, '{"target_chars": "5", "overlap_chars": 1}'), ("a", 1, '{"target_chars": 900}'), ("b", 1, '{"target'), ("c", 1, None), ("d", 1, '{"target_chars": 3}')],
        "doc_id string, revision int, split_contract string",
    ).withColumn("created_at", F.current_timestamp())
    b = spark.createDataFrame([("a", "1", "12345"), ("a", "2", "1234567"), ("a", "2", "1234567"), ("b", "1", "x" * 99), ("d", "1", None), (None, "1", "zzzzzzzz")], "doc_id string, id string, text string").withColumn("limit", F.lit("clash"))
    assert [(r.doc_id, r.id, len(r.pieces)) for r in S.oversized(b, S.contracts(m)).collect()] == [("a", "2", 2)]
    assert S.oversized(b.limit(0), S.contracts(m)).count() == 0 and S.oversized(b, S.contracts(m.limit(0))).count() == 0
