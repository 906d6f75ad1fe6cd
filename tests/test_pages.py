import random

from pyspark.sql import functions as F

from folioflow.operators import geometry as G
from folioflow.operators import html_audit as A
from folioflow.operators import markdown as M
from folioflow.operators import render as R
from folioflow.plans import page_queries
from folioflow.sources import tables
from folioflow.streaming import merge as S


def test_page_numbers():
    lines = lambda *n: [x for v in n for x in ("text", str(v))]
    drop = lambda *n: [int(lines(*n)[i]) for i in M.page_number_lines(lines(*n))]
    assert drop(1, 2, 3, 4, 5) == [1, 2, 3, 4, 5] and drop(1, 2, 1984, 3, 4, 5) == [1, 2, 3, 4, 5] and drop(1, 2, 3) == [] and drop(1984, 42, 7, 1066, 3) == []
    rnd = random.Random(1)
    for _ in range(50):  # the longest sequence that never falls, by trying all
        v = [rnd.randint(1, 9) for _ in range(8)]
        best = max((bin(m).count("1") for m in range(256) if (s := [v[i] for i in range(8) if m >> i & 1]) == sorted(s)), default=0)
        assert len(M.page_number_lines([str(x) for x in v])) == (best if best >= 4 else 0)


def test_page_numbers_of_books(spark, tmp_path):
    far = [("a", f"b{i}", i * 300, t) for i, t in enumerate(("1", "x\n2\ny", "Page 3", "[4]", None, "1984\nz"))]  # one or no number in any 256 blocks
    falls = [("b", f"b{i}", i * 300 + k, str(n)) for i in range(3) for k, n in enumerate((100 - 10 * i, 101 - 10 * i, 102 - 10 * i, 103 - 10 * i))]  # falls from one stretch to the next
    rows = [(*r, i) for i, r in enumerate([*far, *falls, ("c", "b0", 0, "7"), ("d", "b0", 0, None)])]
    spark.createDataFrame(rows, "doc_id string, id string, ord int, text string, ingested_at long").write.parquet(f"{tmp_path}/blocks.parquet")
    got = sorted((r.doc_id, r.line_no, r.id, r.line) for r in page_queries.page_number_lines(spark, str(tmp_path)).collect())
    assert got == [("a", 0, "b0", 0), ("a", 2, "b1", 1), ("a", 4, "b2", 0), ("a", 5, "b3", 0), ("a", 6, "b5", 0)]


def test_clean_export():
    t = "A {.calibre3}\n::: box\n12\n[**Bold**](#calibre_link-4)\n1999\nend {#calibre_link-1 .calibre2}\n\n\n\nx.ct}"
    assert M.clean_export(t) == "A \n**Bold**\n1999\nend\n\n" and "1999" not in M.clean_export(t, True) and M.clean_export(None) is None


def test_cleaned_kinds(spark, tmp_path):
    t = "A {.calibre3}\n::: box\n12\nend"
    rows = [("d", f"b{i}", k, t, i) for i, k in enumerate(("text", "heading", "footnote", "caption", None))] + [("d", "x", "heading", "Plain", 9), ("d", "y", "heading", None, 9)]
    spark.createDataFrame(rows, "doc_id string, id string, kind string, text string, ingested_at long").write.parquet(f"{tmp_path}/blocks.parquet")
    assert sorted((r.id, r.text) for r in page_queries.cleaned_exports(spark, str(tmp_path)).collect()) == [(f"b{i}", "A \nend") for i in range(5)]


def test_blocks():
    t = "# T\n\nPara one\nmore\n> q\nlazy\n- a\n\n  b\n1. c\n| x |\n| y |\n![i](p)\n```py\n# no\n\n```\nend"
    got = M.structural_blocks(t)
    assert [k for k, _ in got] == ["heading", "paragraph", "paragraph", "blockquote", "list", "table", "image", "code_block", "paragraph"]
    assert "\n".join(x for _, x in got) == t and M.structural_blocks("") == [("paragraph", "")]
    assert M.blank_line_blocks("a\nb\n\n~~~\nx\n\ny\n~~~\nc") == ["a\nb", "~~~\nx\n\ny\n~~~", "c"] and M.blank_line_blocks("") == []


def _parts(text):
    """Blocks between blank lines by looking ahead for each fence's end."""
    lines, parts, i = text.replace("\r\n", "\n").split("\n"), [[]], 0
    while i < len(lines):
        sign = next((c for c in "`~" if lines[i].strip().startswith(c * 3)), None)
        if sign:
            k = len(lines[i].strip()) - len(lines[i].strip().lstrip(sign))
            ends = [j for j in range(i + 1, len(lines)) if len(lines[j].strip()) >= k and set(lines[j].strip()) == {sign}]
            end = ends[0] + 1 if ends else len(lines)
            parts += [lines[i:end], []]
            i = end
            continue
        parts[-1:] = [parts[-1] + [lines[i]]] if lines[i].strip() else [parts[-1], []]
        i += 1
    return [x for p in parts if (x := "\n".join(p).strip())]


def test_fenced_documents(spark, tmp_path):
    texts = ["a\n\nb", "a\nb\n\n```py\nx\n\ny\n```\nc\n\nd", "~~~\nx\n\n```\n\ny\n~~~~\nc", "a\n\n````\nx\n\n```\n\ny\n````", "a\n\n```\nnever\n\nclosed", "inline ``` stays\n\nb ~~~ c", "a\r\n\r\n```\r\nx\r\n\r\ny\r\n```", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.pos, r.n_chars) for r in page_queries.blank_line_parts(spark, str(tmp_path)).collect())
    assert got == [(i, k, len(x)) for i, t in enumerate(texts) for k, x in enumerate(_parts(t or ""))]
    assert [sum(r[0] == i for r in got) for i in range(7)] == [2, 4, 2, 2, 2, 2, 2]


def test_html():
    assert M.to_html("# A *b*\n\nx **y** $a_1*b*$\n\n- p\n- q\n\n---\n\n<script>z</script>") == '<h1>A <em>b</em></h1>\n<p>x <strong>y</strong> $a_1*b*$</p>\n<ul><li>p</li><li>q</li></ul>\n<div class="page-separator"></div>\n<p>&lt;script>z&lt;/script></p>'
    assert M.to_html(None) is None and M.to_html("") == ""


def test_patch(spark):
    assert M.patched("命中至先导 `命中至先导` ![命中至先导](命中至先导.png) $命中至先导$ 结构活性关系 <!-- 结构活性关系 -->", [("命中至先导", "X"), ("结构活性关系", "Y")]) == ("X `命中至先导` ![命中至先导](命中至先导.png) $命中至先导$ Y <!-- 结构活性关系 -->", 2)
    g = spark.createDataFrame([("d", 1, "s", "Zed", ["ab", "abc", "Zed"]), ("d", 2, "t", None, ["q"]), ("d", 3, "u", "W", None)], "doc_id string, term_key long, source string, target string, aliases array<string>")
    t = spark.createDataFrame([("d", "c1", "abc and ab"), ("d", "c2", "none"), ("d", "c3", None)], "doc_id string, chunk_id string, text string").withColumn("key", F.lit(1)).withColumn("n", F.lit(1))
    assert [(r.chunk_id, r.text, r.n) for r in M.patch_terms(t, g).collect()] == [("c1", "Zed and Zed", 2)]


def test_toc_and_templates(spark):
    d = spark.createDataFrame([(1, "<h1>A b</h1><p>x</p><h2 class='q'>A <i>b</i></h2>"), (2, None), (3, "")], "k int, html string")
    assert [(r.level, r.title, r.anchor) for r in M.toc(d, ["k"]).orderBy("pos").collect()] == [(1, "A b", "a-b"), (2, "A b", "a-b-1")]
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(M.filled(F.lit("<t>$title$</t>{{body}}{{none}}"), {"title": F.lit("T"), "body": F.lit("B"), "none": F.lit(None).cast("string")})) == "<t>T</t>B"
    assert one(M.separators(F.lit("<hr/><p> --- </p>"))) == '<div class="page-separator"></div>' * 2
    assert one(R.html_title(F.lit("<h1>X</h1>"), F.lit("s"))) == "X" and one(R.html_author(F.lit('<meta name="author" content="Q">'))) == "Q"


def _box(spark, *rows):
    return spark.createDataFrame([("d", i, 1, *map(float, b)) for i, b in rows], "doc_id string, id string, page int, x0 double, y0 double, x1 double, y1 double")


def test_reading_order(spark):
    order = lambda b, **k: [r.id for r in G.reading_order(b, **k).orderBy("place").collect()]
    assert order(_box(spark, ("b1", (0, 200, 9, 210)), ("b2", (0, 100, 9, 110)), ("b3", (0, 300, 9, 310))), columns=1) == ["b2", "b1", "b3"]
    two = _box(spark, ("top", (50, 20, 450, 40)), ("l1", (50, 60, 230, 160)), ("r1", (270, 60, 450, 160)), ("l2", (50, 170, 230, 260)), ("r2", (270, 170, 450, 260)), ("foot", (50, 275, 450, 290)))
    assert order(two, width=500.0) == ["top", "l1", "l2", "r1", "r2", "foot"]
    assert order(two.limit(0)) == []


def test_boxes(spark):
    f = _box(spark, ("a", (0, 0, 100, 100)), ("b", (150, 10, 250, 90)), ("c", (0, 120, 100, 200)), ("z", (0, 600, 50, 650)))
    assert sorted((r.figure, r.n) for r in G.figure_groups(f).collect()) == [("a", 3), ("z", 1)]
    assert [r.id for r in G.covered(_box(spark, ("i", (10, 10, 20, 20)), ("o", (90, 90, 200, 200)), ("flat", (1, 1, 1, 9))), f).collect()] == ["i"]
    it = spark.createDataFrame([("d", "x", 1, "The quick brown fox"), ("d", "y", 1, "zzz")], "doc_id string, id string, page int, text string")
    ln = spark.createDataFrame([("d", 2, "quick brown fox"), ("d", 1, "other")], "doc_id string, page int, text string")
    assert {r.id: r.found for r in G.likely_page(it, ln).collect()} == {"x": 2, "y": None}


def test_audit(spark):
    codes = lambda h: [c for _, c, _ in A.audit(h)]
    gov = '<main data-edition="gov_doc"><div class="gov-org-name">x</div><div class="gov-doc-number">y</div>{}</main>'
    assert codes(gov.format('<h2>一、甲</h2><p>正文</p><h2>二、乙</h2><p class="gov-ref-item">[1] a</p><p class="gov-ref-item">[2] b</p>')) == []
    assert codes("<h2>Perspective</h2>") == ["spurious_running_header"] and codes("<h1>doi: 10.1/x</h1>") == ["heading_contains_url_or_doi"]
    assert codes('<p class="ref-item">[1] a</p><p class="ref-item">[3] b</p>') == ["ref_numbering_anomaly"]
    assert codes(gov.format("<h2>二、乙</h2>")) == ["heading_sequence_mismatch"] and codes(gov.format("<ol>" + "".join(f"<li>{i}. x</li>" for i in range(4)) + "</ol>")) == ["ref_style_downgrade"]
    assert codes(gov.format('<table><tr><td>1</td></tr></table><div class="caption">表1 x</div>')) == ["table_caption_below_table"]
    assert codes(gov.format("<table><tr>" + "<td>1</td>" * 4 + "</tr></table>")) == ["table_lacks_dense_styling"]
    assert codes('<p class="ref-item">1. a</p>') == [] and codes(gov.format('<p class="gov-ref-item">1. a</p>')) == ["ref_format_not_gbt7714"]
    assert codes("<p>" + "english words " * 20 + "</p>") == ["untranslated_body_text"] and codes(None) == [] and codes("") == []
    assert codes('<main data-edition="gov_doc"></main>') == ["missing_gov_header", "missing_gov_docno"]
    df = spark.createDataFrame([(1, "<h2>Letter</h2>"), (2, None)], "k int, html string")
    assert [(r.k, r.code) for r in A.audited(df, "k").collect()] == [(1, "spurious_running_header")]


def test_streams(spark, tmp_path):
    src, root, cp = (f"{tmp_path}/{x}" for x in ("in", "root", "cp"))
    row = lambda c, v, t: (("d", c, v, t),)
    schema = "doc_id string, chunk_id string, v string, t int"
    put = lambda rows: spark.createDataFrame(rows, schema).selectExpr("doc_id", "chunk_id", "v", "timestamp_seconds(t) as arrived_at").coalesce(1).write.mode("append").parquet(src)
    seen = lambda: sorted((r.chunk_id, r.v) for r in spark.read.parquet(f"{root}/out").collect())
    put(row("c1", "a", 1))
    S.merge_observations(spark, src, "file://" + root, cp).awaitTermination()
    put(row("c1", "a", 2))  # the same content again
    put(row("c2", "b", 3))
    S.merge_observations(spark, src, "file://" + root, cp).awaitTermination()
    put(row("c1", "z", 4))  # changed
    S.merge_observations(spark, src, "file://" + root, cp).awaitTermination()
    assert seen() == [("c1", "a"), ("c1", "z"), ("c2", "b")]


def test_progress_and_windows(spark):
    st = spark.createDataFrame([("d", "1", "committed"), ("d", "2", "failed"), ("d", "1", "committed")], "doc_id string, chunk_id string, status string")
    ch = spark.createDataFrame([("d", "1"), ("d", "2"), ("d", "3")], "doc_id string, chunk_id string")
    assert S.progress(st, ch).first().percent == 41
    ev = spark.createDataFrame([(1, "a", 1.0), (3599, "a", 2.0), (3600, "a", 4.0)], "s int, event_type string, value double").selectExpr("timestamp_seconds(s) as ts", "event_type", "value")
    assert sorted((r.n, r.value) for r in S.event_windows(ev).collect()) == [(1, 4.0), (2, 3.0)]


def test_marked_files(spark, tmp_path):
    (tmp_path / "chunk0001.md").write_text("a", encoding="utf-8")
    (tmp_path / "output_chunk0001.md").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "notes.md").write_text("n")
    assert sorted((r.chunk_id, r.is_output, r.text) for r in tables.marked_files(spark, str(tmp_path)).collect()) == [("chunk0001", False, "a"), ("chunk0001", True, None)]
