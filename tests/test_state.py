import hashlib

from pyspark.sql import functions as F

from folioflow.operators import align as L
from folioflow.operators import audit as U
from folioflow.operators import state as S
from folioflow.operators import terms as T

h = lambda t: hashlib.sha256(t.encode()).hexdigest()
C = "doc_id string, chunk_id string, ord int, source string, output string"
MF = "doc_id string, chunk_count int, source_hash string, split_complete boolean, chunks array<struct<id:string,ord:int,source_file:string,source_hash:string,output_file:string,block_ids:array<string>>>"


def _chunks(spark, *rows):
    return spark.createDataFrame([("d", f"chunk{i:04d}", i, s, o) for i, (s, o) in enumerate(rows, 1)], C).withColumn("m_ord", F.lit(1))


def _manifest(spark, *hashes, count=None, ids=None):
    ids = ids or [f"chunk{i:04d}" for i in range(1, len(hashes) + 1)]
    return spark.createDataFrame([("d", len(hashes) if count is None else count, "x", True, [(n, i, "s", x, "o", [f"b{i:06d}"]) for i, (n, x) in enumerate(zip(ids, hashes), 1)])], MF)


def test_plan(spark):
    c = _chunks(spark, ("a", None), ("a", ""), ("a", "\n \t\n"), ("a", "x"), ("a", "x"), ("a", "x"), ("a", "x"), ("a", "x"))
    m = _manifest(spark, *[h("a")] * 3, h("other"), *[h("a")] * 4)
    st = spark.createDataFrame([("d", "chunk0006", h("old"), h("x")), ("d", "chunk0007", "sha256:" + h("a"), h("edited")), ("d", "chunk0008", h("a").upper(), h("x"))], "doc_id string, chunk_id string, source_hash string, output_hash string")
    got = [(r.action, r.reason) for r in S.plan(c, m, st).orderBy("chunk_id").collect()]
    assert got == [("translate", "missing_output"), ("translate", "empty_output"), ("translate", "blank_output"), ("translate", "manifest_source_hash_changed"), ("record", "untracked_existing_output"), ("translate", "source_hash_changed_since_record"), ("record", "output_hash_changed_since_record"), ("unchanged", "")]
    s = {r.action: (r.n_chunks, r.sample) for r in S.plan_summary(S.plan(c, m, st)).collect()}
    assert s["record"] == (2, "chunk0005,chunk0007")
    assert S.plan(c.limit(0), m, st).count() == 0


def test_plan_terms(spark):
    text = "Ann met Tai."
    c = _chunks(spark, *[(text, "x")] * 6, ("none", "x"))
    m = _manifest(spark, *[h(text)] * 6, h("none"))
    g = spark.createDataFrame([(1, "d", "i1", "Ann", "安", "person", ["Annie"], None, None, 3), (2, "d", "i2", "Tom", "汤", "person", None, None, None, 9), (3, "d", "i3", "Thailand", "泰", None, ["Tai"], "female", True, 5)], "term_key long, doc_id string, id string, source string, target string, category string, aliases array<string>, gender string, gender_conflict boolean, frequency long")
    now = {"Ann": h('Ann→安|person|aliases=["Annie"]'), "Thailand": h('Thailand→泰||aliases=["Tai"]|gender=female|gender_conflict=true')}
    got = T.relevant_hashes(c.select("doc_id", "chunk_id", F.col("source").alias("text")), g).collect()
    assert len(got) == 6 and all(r.terms == now for r in got)
    assert list(T.relevant_hashes(c.select("doc_id", "chunk_id", F.col("source").alias("text")), g, "id", 1).first().terms) == ["i3"]
    both, ST = list(now), "doc_id string, chunk_id string, source_hash string, output_hash string, contract_hash string, provenance string, entity_ids_used array<string>, entity_hashes_used map<string,string>"
    rows = [("x", "dispatched", both, now), ("x", "dispatched", ["Ann", "Gone"], now), ("y", "dispatched", None, None), ("x", "dispatched", both, now | {"Ann": "old"}), ("y", "verified_dispatch", both, now | {"Ann": "old"}), ("x", "bypassed_reference", [], None)]
    st = spark.createDataFrame([("d", f"chunk{i:04d}", h(text), h(o), h("k"), p, e, t) for i, (o, p, e, t) in enumerate(rows, 1)] + [("d", "chunk0007", h("none"), h("x"), h("k"), "dispatched", ["Gone"], {})], ST)
    plan = lambda s=st, **k: [(r.action, r.reason) for r in S.plan(c, m, s, glossary=g, **k).orderBy("chunk_id").collect()]
    same, ignored, hashed = ("unchanged", ""), "glossary_term_selection_changed_ignored", ("translate", "glossary_term_hash_changed")
    assert plan() == [same, ("unchanged", ignored), ("record", ignored + ",output_hash_changed_since_record"), hashed, hashed, same, same]
    assert plan(on_drift=True) == [same, *[("translate", "glossary_term_selection_changed")] * 2, hashed, hashed, same, same]
    assert plan(st.drop("entity_hashes_used"))[3:5] == [same, ("record", "output_hash_changed_since_record")]
    assert plan(contract="sha256:" + h("k")) == plan() and plan(contract=h("other")) == [("translate", "translation_contract_changed")] * 7
    assert [x for x, _ in plan(verified=True)] == ["translate"] * 5 + ["unchanged", "translate"]


def test_gate(spark):
    c = _chunks(spark, ("a" * 100, "b"), ("a", "b"), ("a", None), ("a", ""), ("a", " "))
    got = {r.chunk_id: (r.error, r.warning) for r in S.merge_gate(c, _manifest(spark, h("a" * 100), h("z"), h("a"), h("a"), h("a"), h("q"), ids=["chunk0001", "chunk0002", "chunk0003", "chunk0004", "chunk0009", "chunk0006"])).collect()}
    assert got == {"chunk0001": ("", "suspiciously_short"), "chunk0002": ("stale_source", ""), "chunk0003": ("missing_output", ""), "chunk0004": ("empty_output", ""), "chunk0005": ("orphan", ""), "chunk0009": ("missing_source", ""), "chunk0006": ("missing_source", "")}


def test_manifest_errors(spark):
    assert S.manifest_errors(_manifest(spark, "x", "y")).count() == 0
    assert S.manifest_errors(_manifest(spark, "x", "y", count=5)).first().errors == "chunk_count"
    assert S.manifest_errors(_manifest(spark, "x", None, ids=["a", "a"])).first().errors == "duplicate_id,null_field"
    assert S.manifest_errors(spark.createDataFrame([("d", None, None, None, None)], MF)).first().errors == "chunk_count,incomplete,no_chunks,no_source_hash"


def test_markers_and_pairs(spark):
    src = "<!-- tb:b000001 -->\n# A\n\n<!-- tb:b000002 -->\nx $y$\n"
    c = _chunks(spark, (src, src.replace("A", "B").replace("$y$", "$z$")), (src, "<!-- tb:b000001 -->\n# A\n"), ("no marker", "x"), (src, None), ("lead\n" + src, src), (src + src, src + src))
    got = [(r.chunk_id[-1], r.pos, r.id) for r in L.pairs(c).orderBy("chunk_id", "pos").collect()]
    assert got == [("1", 0, "b000001"), ("1", 1, "b000002"), ("2", 0, None), ("3", 0, None), ("5", 0, None), ("6", 0, None)]
    b = spark.createDataFrame([("d", "b000001", "heading", False), ("d", "b000002", "text", True)], "doc_id string, id string, kind string, translatable boolean")
    e = {(r.chunk_id[-1], r.id): r.errors for r in L.translation_errors(L.pairs(c), b).collect()}
    assert e[("1", "b000001")] == "fixed_changed" and e[("1", "b000002")] == "math" and e[("2", "")] == "ids"
    text = L.bilingual(L.pairs(c)).where("chunk_id = 'chunk0001'").first().text
    assert text == "::: {.orig}\nA\n:::\n\n# B\n\n::: {.orig}\nx $y$\n:::\n\nx $z$"


def test_images(spark):
    c = _chunks(spark, ('![a](p.png) <img alt="x > y" src="q.png"> ![b](p.png)', "![a](p.png) <img src='r.png'>"))
    assert {(r.ref, r.n_missing, r.n_extra) for r in L.image_diff(c).collect()} == {("md:p.png", 1, 0), ("html:q.png", 1, 0), ("html:r.png", 0, 1)}
    p = spark.createDataFrame([("d", "c", 0, "b1", "![a](p.png)", "![z](p.png)\n\nText")], "doc_id string, chunk_id string, pos int, id string, source_body string, output_body string")
    assert L.bilingual(p).first().text == "![a](p.png)\n\nText"


def test_neighbours(spark):
    c = _chunks(spark, ("AAAAAAAAAAprev-tail", None), ("middle", None), ("next-headBBBB", None))
    got = {r.chunk_id[-1]: (r.prev_excerpt, r.next_excerpt) for r in L.neighbours(c, 9).collect()}
    assert got == {"1": ("", "middle"), "2": ("prev-tail", "next-head"), "3": ("middle", "")}
    assert {r.prev_excerpt for r in L.neighbours(c, 0).collect()} == {""}
    assert spark.range(1).select(L.neighbour_prompt(F.lit(""), F.lit("n")).alias("x")).first().x == "Next chunk excerpt (read-only):\n```text\nn\n```"


def test_audits(spark):
    rows = [("d", i, f"b{i}", t, True) for i, t in enumerate(["[1] a", "[3] b", "[3] c", "2. d", "no number", None])]
    r = U.reference_numbers(spark.createDataFrame(rows, "doc_id string, ord int, id string, text string, is_reference boolean")).first()
    assert (r.n, r.lowest, r.highest, r.n_gaps, r.n_repeats, r.n_disorder) == (4, 1, 3, 0, 1, 1)
    t = spark.createDataFrame([(1, "plain english words " * 10), (2, "译文" * 80), (3, "see https://a.b " + "x" * 100), (4, None), (5, "short")], "k int, text string")
    assert [r.k for r in U.untranslated(t, ["k"]).collect()] == [1]
    assert S.source_cache(spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("c", "1", 1), ("e", "1", 1)], "key string, checksum string, size int"), spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("c", None, 1)], "key string, checksum string, size int")).orderBy("key").select("verdict").collect() == [("reuse",), ("mismatch",), ("adopt",), ("new",)]


def test_reference_chunks_and_drift(spark):
    c = _chunks(spark, ("<!-- tb:b000001 -->\n[1] A\n<!-- tb:b000002 -->\n[2] Tai", "x"), ("<!-- tb:b000001 -->\n[1] A\n<!-- tb:b000003 -->\nprose", "x"), ("<!-- tb:b000001 -->\nUniversity of A", "x"), ("no markers", "x"))
    b = spark.createDataFrame([("d", "b000001", "text", "[1] A", True), ("d", "b000002", "heading", "References", None), ("d", "b000003", "text", "prose", None)], "doc_id string, id string, kind string, text string, is_reference boolean")
    assert [(r.chunk_id, r.n_blocks) for r in S.reference_chunks(c, b).collect()] == [("chunk0001", 2)]
    g = spark.createDataFrame([(1, "d", "Tai", []), (2, "d", "prose", None)], "term_key long, doc_id string, source string, aliases array<string>")
    st = spark.createDataFrame([("d", "chunk0001", ["Gone"]), ("d", "chunk0002", ["prose"]), ("d", "chunk0003", None)], "doc_id string, chunk_id string, entity_ids_used array<string>")
    got = {r.chunk_id: (r.n_now, r.n_then, r.n_added, r.n_dropped) for r in S.term_drift(c, g, st).collect()}
    assert got == {"chunk0001": (1, 1, 1, 1), "chunk0002": (1, 1, 0, 0)}
