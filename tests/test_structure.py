from pyspark.sql import functions as F

from folioflow.functions import detect
from folioflow.functions import text as T
from folioflow.operators import chunking as C
from folioflow.operators import structure as S

SCHEMA = "doc_id string, ord int, id string, kind string, level int, text string, is_reference boolean, caption_of string, style_id string, is_running_header boolean"


def _blocks(spark, rows):
    full = [(d, o, i, k, lv, t, ref, None, None, None) for d, o, i, k, lv, t, ref in rows]
    return spark.createDataFrame(full, SCHEMA).selectExpr("*", "array(named_struct('page', cast(1 as int), 'bbox', array(0d,0d,1d,1d))) as source_refs", "'clash' as chunk", "1 as _x")


def test_boundary_chunks(spark):
    rows = [("a", i, f"b{i:06d}", "text", None, "x" * 180, False) for i in range(6)] + [("a", 6, "b000006", "heading", 1, "Next", False), ("a", 7, "b000007", "text", None, "ref", True)]
    got = {r.id: r.chunk_no for r in C.block_boundary_chunks(_blocks(spark, rows), 500).collect()}
    assert [got[f"b{i:06d}"] for i in range(8)] == [1, 1, 2, 2, 3, 3, 4, 5]
    assert C.block_boundary_chunks(_blocks(spark, rows).limit(0), 500).count() == 0


def test_structural_chunks(spark):
    rows = [("a", i, s, h) for i, (s, h) in enumerate([(40, False), (50, True), (40, False), (30, False), (500, False), (10, False)])]
    df = spark.createDataFrame(rows, "doc_id string, ord int, size int, heading boolean")
    assert [r.chunk_no for r in C.structural_chunks(df, 100).orderBy("ord").collect()] == [1, 2, 2, 3, 4, 5]


def test_force_split(spark):
    rows = [("p", "\n\n".join(["a" * 60] * 5)), ("l", "\n".join(["b" * 40] * 6)), ("c", "```py\n" + "\n".join(["c" * 40] * 6) + "\n```"), ("s", "short"), ("n", None), ("e", "")]
    got = {}
    for r in C.force_split(spark.createDataFrame(rows, "doc_id string, text string"), 100).orderBy("doc_id", "piece_no").collect():
        got.setdefault(r.doc_id, []).append(r.piece)
    assert got.keys() == {"p", "l", "c"} and "\n\n".join(got["p"]) == rows[0][1] and "\n".join(got["l"]) == rows[1][1]
    assert all(x.startswith("```py\n") and x.endswith("\n```") for x in got["c"]) and len(got["c"]) == 3


def test_plan_and_outline(spark):
    rows = [("a", 1, "b1", "heading", 1, "1. Start", False), ("a", 2, "b2", "text", None, "x" * 800, False), ("a", 3, "b3", "heading", 2, "Review", False), ("a", 4, "b4", "text", None, "y" * 600, False), ("a", 5, "b5", "heading", 1, "References", False), ("a", 6, "b6", "text", None, "[1] z", None), ("a", 7, "b7", "heading", 1, "Appendix", False), ("a", 8, "b8", "text", None, None, None)]
    b = _blocks(spark, rows)
    cuts = {r.id: (r.char_offset, r.cut) for r in C.suggested_cuts(C.landmarks(b), 1000).collect()}
    assert cuts["b1"] == (0, False) and cuts["b3"] == (808, True) and cuts["b5"] == (1414, True)
    assert {r.id: r.suspect for r in S.outline(b).collect()} == {"b1": False, "b3": True, "b5": False, "b7": False}
    assert {r.id for r in S.reference_state(b).where("in_references").collect()} == {"b6"}
    assert {r.id: r.label for r in S.heading_numbers(b).collect()} == {"b1": "一、", "b3": "（一）", "b5": "二、", "b7": "三、"}


def test_captions(spark):
    rows = [("a", 1, "t", "table", None, "| a |", False), ("a", 2, "c", "caption", None, "Table 1. A.", False), ("a", 3, "f", "figure", None, "!", False), ("a", 4, "x", "text", None, "y", False), ("a", 5, "d", "caption", None, "Figure 1.", False)]
    b = _blocks(spark, rows)
    assert {r.id: r.place for r in S.hoisted_captions(b).collect()} == {"c": 1, "t": 2, "f": 3, "x": 4, "d": 5}
    assert {r.id: (r.target, r.way) for r in S.captions_of(b).collect()} == {"c": ("t", "page"), "d": ("f", "page")}


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    v = F.lit
    assert one(T.heading_text(v("2.1 Methods."))) == "Methods" and one(T.heading_text(v("一、方法"))) == "方法" and one(T.cn_ordinal(v(21))) == "二十一" and one(T.cn_ordinal(v(31))) == "31"
    assert one(T.slug(v("Hello, World! & more"))) == "hello-world-more" and one(T.slug(v("!!!"))) == "section"
    assert one(T.natural_key(v("chunk10"))) > one(T.natural_key(v("chunk9")))
    assert one(T.join_lines(F.array(v("infor-"), v("mation and"), v(" 港务"), v("局 "), v(None)))) == "information and 港务局"
    assert one(T.key_values(v("a=1\n# x\nb=2=3\na=4"))) == {"b": "2=3", "a": "4"}
    assert one(T.is_safe_path(v("a/b.png"))) and not one(T.is_safe_path(v("../b"))) and not one(T.is_safe_path(v("http://x")))
    p = one(T.protected_objects(v("Price $x^2$ and [a](b.html) `c` [^1] $$y$$")))
    assert p.math == ["$x^2$", "$$y$$"] and p.destinations == ["b.html"] and p.code == ["`c`"] and p.footnotes == ["[^1]"]
    assert one(T.file_stem(v(None), v("A: title? doi:10.1234/x"), v("s"))) == "A title"


def test_identifiers(spark):
    rows = [("a", i, f"b{i}", "text", None, t, False) for i, t in enumerate(["no", "see doi:10.1234/AB.1, and 1999", "10.9/x"])] + [("b", i, f"b{i}", "text", None, "10.5555/z 2001" if i > 15 else "q", False) for i in range(20)]
    assert {r.doc_id: (r.doi, r.way) for r in detect.book_dois(_blocks(spark, rows)).collect()} == {"a": ("10.1234/ab.1", "front"), "b": ("10.5555/z", "repeated")}
    assert {r.doc_id: r.year for r in detect.book_years(_blocks(spark, rows)).collect()} == {"a": 1999, "b": 2001}
    pat = spark.createDataFrame([(2, "(?i)nature", "N"), (1, "(?i)nature neuro", "NN")], "priority int, pattern string, name string")
    assert {r.k: r["name"] for r in detect.first_match(spark.createDataFrame([("1", "Nature Neuroscience"), ("2", "nature"), ("3", None)], "k string, t string"), "t", pat, "k").collect()} == {"1": "NN", "2": "N"}
