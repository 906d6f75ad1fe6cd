import itertools
import random

from pyspark.sql import functions as F

from folioflow.functions import detect
from folioflow.operators import align, geometry, render
from folioflow.operators import documents as O
from folioflow.operators import structure as S

SCHEMA = "doc_id string, id string, ord int, kind string, text string, level int, caption_of string, translatable boolean, is_running_header boolean, is_reference boolean, style_id string, source_refs array<struct<page:int,bbox:array<double>>>"


def _blocks(spark, rows):
    full = [(d, i, o, k, t, None, None, None, None, None, None, [(p, None)] if p else []) for d, i, o, k, t, p in rows]
    return spark.createDataFrame(full, SCHEMA).withColumn("n", F.lit("clash")).withColumn("h", F.lit(1))


def test_structure_hash(spark):
    rows = [("a", f"b{i}", i, "text", f"t{i}", 1) for i in range(5)]
    one = O.structure_hashes(_blocks(spark, rows)).collect()
    assert one == O.structure_hashes(_blocks(spark, rows[::-1])).collect() and one[0].n_blocks == 5
    for change in ([*rows[:-1], ("a", "b4", 4, "text", "other", 1)], [*rows[:-1], ("a", "b4", 4, "heading", "t4", 1)], rows[:-1]):
        assert O.structure_hashes(_blocks(spark, change)).first().structure_hash != one[0].structure_hash
    assert O.structure_hashes(_blocks(spark, [("a", "1", 1, None, None, None), (None, "2", 1, "text", "x", 1)])).count() == 1
    assert O.structure_hashes(_blocks(spark, rows).limit(0)).count() == 0


def test_split_run_chooses_its_method(spark):
    rows = [("cut", f"b{i}", i, "text", "x" * 50, 1) for i in range(6)]
    rows += [("land", f"b{i}", i, "heading" if i % 5 == 0 else "text", "y" * 300, 1) for i in range(15)]
    rows += [("size", f"b{i}", i, "text", "z" * 400, 1) for i in range(6)]
    cuts = spark.createDataFrame([("cut", "b3"), ("cut", "b3"), ("size", "no such"), ("gone", "b1")], "doc_id string, id string")
    got = {(r.doc_id, r.id): (r.chunk_no, r.method) for r in O.split_run(_blocks(spark, rows), cuts, 1000).collect()}
    assert len(got) == len(rows) and {got[("cut", f"b{i}")] for i in range(6)} == {(1, "custom"), (2, "custom")} and got[("cut", "b3")][0] == 2
    assert {m for (d, _), (_, m) in got.items() if d == "land"} == {"suggested"} and {m for (d, _), (_, m) in got.items() if d == "size"} == {"boundary"}
    assert O.split_run(_blocks(spark, rows).limit(0), cuts, 1000).count() == 0


def test_identifier_cascades(spark):
    rows = [("front", "1", 1, "text", "See 10.1234/ab-021-05. Published online: 4 May 2021", 1), ("named", "16", 1, "text", "x", 1)]
    rows += [("named", f"p{i}", i, "text", None, 1) for i in range(2, 28)] + [("named", "z", 30, "text", "This is available at https://doi.org/10.5555/zz-99-1. Received: 2019", 1)]
    rows += [("often", f"q{i}", i, "text", "nothing", 1) for i in range(1, 20)] + [("often", "r1", 30, "text", "10.1/no 10.7777/k 10.7777/k 10.8888/once", 1)]
    rows += [("none", "1", 1, "text", "© : year 2018, Received: March 2017", 1)]
    b = _blocks(spark, rows)
    got = {r.doc_id: (r.doi, r.doi_from, r.year, r.year_from) for r in O.book_identifiers(b, default_year=1990).collect()}
    assert got["front"] == ("10.1234/ab-021-05", "front", 2021, "published") and got["often"] == ("10.7777/k", "often", 1990, "default")
    assert got["named"] == ("10.5555/zz-99-1", "named", 2099, "doi") and got["none"] == (None, None, 2017, "received")
    said = spark.createDataFrame([("none", "10.9999/x"), ("front", "")], "doc_id string, doi string")
    got = {r.doc_id: (r.doi, r.doi_from) for r in O.book_identifiers(b, said).collect()}
    assert got["none"] == ("10.9999/x", "declared") and got["front"][1] == "front"


def test_first_match_takes_all_patterns(spark):
    pat = spark.createDataFrame([(i, f"word{i:04d}$", f"n{i}") for i in range(1_500)], "priority int, pattern string, name string")
    t = spark.createDataFrame([("a", "word1400")], "k string, t string")
    assert detect.first_match(t, "t", pat.where("priority > 1300"), "k").collect() == [("a", "n1400")]


def test_merged_and_continued(spark):
    c = spark.createDataFrame([("a", "2", 2, " two\n"), ("a", "1", 1, "one"), ("b", "1", 1, "x"), ("b", "2", 2, " "), ("c", "1", 1, None)], "doc_id string, chunk_id string, ord int, output string")
    assert [(r.doc_id, r.part, r.n_chunks, r.text) for r in O.merged_text(c).collect()] == [("a", 0, 2, "one\n\ntwo")]
    assert sorted((r.part, r.text) for r in O.merged_text(c.where("doc_id = 'a'"), 1).collect()) == [(0, "one"), (1, "two")]
    b = _blocks(spark, [("a", "1", 1, "text", "A long sen-", 1), ("a", "2", 2, "figure", "f", 1), ("a", "3", 3, "text", "tence goes on", 1), ("a", "4", 4, "text", "and ends.", 1), ("a", "5", 5, "text", "New one.", 1), ("a", "6", 6, "text", None, 1)])
    got = {r.id: (r.n_blocks, r.text) for r in O.continued_texts(S.continuation_groups(b), b).collect()}
    assert got["1"] == (3, "A long sentence goes on and ends.") and got["5"] == (1, "New one.")


def test_reference_order_and_upgrade(spark):
    b = _blocks(spark, [("a", "1", 1, "text", "[2] B", 1), ("a", "2", 2, "text", "no number", 1), ("a", "3", 3, "text", "1. A", 1), ("a", "4", 4, "text", "[2] C", 1)]).withColumn("is_reference", F.lit(True))
    assert [r.id for r in sorted(O.reference_order(b).collect(), key=lambda r: r.place)] == ["3", "1", "4", "2"]
    g = spark.createDataFrame([("a", "Tai", "x", "person"), ("a", "Bo", None, None), ("b", "Tai", "x", "person"), ("b", " Tai", "y", "place"), ("c", None, "z", None), (None, "q", "q", "q")], "doc_id string, source string, target string, category string")
    up, bad = O.glossary_upgrade(g)
    assert sorted((r.doc_id, r.id, r.gender, r.confidence, r.frequency, r.aliases) for r in up.collect()) == [("a", "Bo", "unknown", "medium", 0, []), ("a", "Tai", "unknown", "medium", 0, [])]
    assert sorted((r.doc_id, r.n) for r in bad.collect()) == [("b", 2), ("c", 1)]
    issues = spark.createDataFrame([("a", "error"), ("b", "Warning"), ("c", None)], "k string, severity string")
    assert [r.k for r in O.blocking(issues).collect()] == ["a"] and O.blocking(issues, "error", "warning").count() == 2


def test_pages_and_files(spark):
    p = spark.createDataFrame([("a", i, 100 if i % 2 else 0) for i in range(20)] + [("b", 3, 1)], "doc_id string, page int, n_chars int")
    got = {r.doc_id: (r.n_sampled, r.mean_chars, r.has_text) for r in O.text_layer(p).collect()}
    assert got["a"] == (8, 0.0, False) and got["b"] == (1, 1.0, False)
    f = spark.createDataFrame([("x", "b.md", 5), ("x", "a.md", 5), ("x", "c.md", 1), ("y", "d.md", None)], "folder string, name string, size int")
    assert sorted(tuple(r) for r in O.largest(f, "folder", "name", "size").collect()) == [("x", "a.md", 5), ("y", "d.md", None)]
    xml = spark.createDataFrame([("<package xmlns:dc='u'><metadata><dc:title> T </dc:title><dc:language>de</dc:language></metadata></package>",)], "x string")
    assert tuple(xml.select(O.opf_metadata(F.col("x")).alias("m")).first().m) == ("T", None, None, "de")
    pages = spark.createDataFrame(
        [("a", 0, [("title", [([("Head", None)],)]), ("interline_equation", [([("x", None)],)]), ("table", [([(None, "<table></table>")],)]), ("strange", [([("one", None), ("two", None)],), ([("three", None)],)]), ("text", [])])],
        "doc_id string, page_idx int, para_blocks array<struct<type:string,lines:array<struct<spans:array<struct<content:string,html:string>>>>>>",
    )
    assert [(r.kind, r.markdown) for r in O.normalised_pages(pages).orderBy("pos").collect()] == [("heading", "# Head"), ("formula", "$$\nx\n$$"), ("table", "<table></table>"), ("text", "one two\nthree")]


def test_grown_boxes_do_not_depend_on_order():
    rnd = random.Random(4)
    for _ in range(40):
        boxes = [(x, y, x + rnd.randint(5, 40), y + rnd.randint(5, 40)) for x, y in ((rnd.randint(0, 200), rnd.randint(0, 200)) for _ in range(6))]
        got = {str(geometry.grown_boxes(list(p))) for p in itertools.islice(itertools.permutations(boxes), 0, 720, 37)}
        assert len(got) == 1
        out = geometry.grown_boxes(boxes)
        for a, b in itertools.combinations(out, 2):
            assert a[0] > b[2] + 10 or b[0] > a[2] + 10 or a[1] > b[3] + 10 or b[1] > a[3] + 10


def test_ebook_html_and_coverage(spark):
    pages = ["<html><head><title>t</title></head><body></body></html>", '<HTML lang="x"><body style="text-decoration: underline"></body></HTML>', "<p>x</p>", None]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p string").select("i", render.ebook_html(F.col("p"), F.lit("a{}")).alias("h")).orderBy("i").collect()
    sheet = "<style>\na{}</style>"
    assert [r.h for r in rows] == [f"<html><head>{sheet}<title>t</title></head><body></body></html>", f'<HTML lang="x"><head>{sheet}</head><body></body></HTML>', f"<head>{sheet}</head><p>x</p>", None]
    p = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "9"), ("a", None)], "doc_id string, id string")
    b = spark.createDataFrame([("a", "1", True), ("a", "2", None), ("a", "3", False)], "doc_id string, id string, translatable boolean")
    assert {r.id: r.state for r in align.coverage(p, b).collect()} == {"1": "translated", "2": "missing", "3": "fixed", "9": "unknown"}
