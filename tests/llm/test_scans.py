import random

import pytest
from pyspark.sql import functions as F

from folioflow.llm import scans as S

WORDS = """the a of and river station mountain window letter gentle garden painted mirror account station remember temperature harbour village curtain between measure
nothing everything further evening morning within without office ledger inspection certificate library department building thousand journal counted visited
needle library whistle captain fountain modern corner clerk burn turn government environment little bottle settle""".split()


@pytest.fixture(scope="module")
def editor():
    counts = {w: 50 + 3 * i for i, w in enumerate(WORDS)}
    return S._editor(tuple(sorted(counts.items())), tuple(WORDS))


def test_words_are_repaired(editor):
    hyphen, misread, text = S.repair("The m0untain stati0n was vis1ted; the w|ndow and the gard€n.", editor)
    assert misread and not hyphen and text == "The mountain station was visited; the window and the garden."
    assert S.repair("The gentle river.", editor) == (False, False, "The gentle river.")
    assert S.repair("H2O and B12 on A4 paper, R&D.", editor)[1] is False


def test_lines_are_joined(editor):
    assert S.repair("the moun-\ntain station", editor) == (True, False, "the mountain station")
    assert S.repair("the moun¬ tain station", editor)[0] and S.repair("the certif-", editor)[0]
    assert not S.repair("two- and three-volume sets", editor)[0]
    assert not S.repair("a well-known river - nothing else", editor)[0]
    assert S.repair(None, editor) == (False, False, None) and S.repair("", editor) == (False, False, "")


def test_held_out_accuracy(editor):
    rnd, right, n = random.Random(9), 0, 0
    for w in WORDS:
        if len(w) > 5:
            i = rnd.randrange(len(w))
            back = {"o": "0", "l": "1", "s": "5", "a": "@", "e": "€", "i": "|", "t": "+"}
            if w[i] in back:
                n += 1
                right += editor.edit(w[:i] + back[w[i]] + w[i + 1 :]) == w
    assert n > 8 and right / n > 0.9


def _blocks(spark):
    rows = []
    for d in "xyz":
        ordn = 0
        for page in range(1, 13):
            for y0, y1, text, kind in (
                (30.0, 40.0, f"Annals of {d.upper()}ville", "text"), (100.0, 140.0, "The gentle river by the station was visited by the captain in the garden.", "text"),
                (200.0, 240.0, f"A Chapter Number {'One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve'.split()[page - 1]}", "heading"),
                (300.0, 340.0, "Nothing was counted in the gar-\nden and the ledger", "text"), (350.0, 390.0, "was left within the office.", "text"), (772.0, 788.0, str(page), "text"),
            ):
                ordn += 1
                rows.append((d, ordn, f"b{ordn}", kind, text, None, [(page, [60.0, y0, 500.0, y1])], page))
    rows.append(("x", 900, "b900", "text", "The river\nANNALS OF XVILLE\nby the station.", None, [(12, [60.0, 400.0, 500.0, 440.0])], 1))
    rows.append(("x", 901, "b901", "text", None, None, [], 1))
    rows.append(("x", 902, "b902", "heading", "Annals of Xville", True, [(12, [60.0, 500.0, 500.0, 540.0])], 1))
    rows += rows[:5]
    return spark.createDataFrame(rows, "doc_id string, ord int, id string, kind string, text string, is_running_header boolean, source_refs array<struct<page:int,bbox:array<double>>>, t int").selectExpr("*", "timestamp_seconds(t) as ingested_at", "1 as title")


def test_furniture_and_paragraphs(spark):
    b = _blocks(spark)
    f = {(r.doc_id, r.id, r.line_no): (r.header, r.page_number) for r in S.furniture(b.drop("title")).collect()}
    assert f[("x", "b1", 0)] == (True, False) and f[("y", "b6", 0)] == (False, True) and f[("x", "b900", 1)] == (True, False)
    assert ("x", "b902", 0) not in f and ("x", "b3", 0) not in f
    p = {(r.doc_id, r.start_ord): r for r in S.paragraphs(b.drop("title")).collect()}
    assert p[("x", 4)].n_blocks == 2 and p[("x", 4)].text == "Nothing was counted in the garden and the ledger was left within the office."
    assert p[("x", 900)].text == "The river by the station." and ("x", 1) not in p
    assert S.furniture(b.limit(0)).count() == 0


def test_wild_boxes_and_page_sizes_change_little(spark):
    b = _blocks(spark).drop("title")
    want = {(r.doc_id, r.id) for r in S.furniture(b).collect()}
    wild = b.withColumn("source_refs", F.expr("case when id = 'b4' then array(named_struct('page', 1, 'bbox', array(60d, 300d, 500d, double('NaN')))) when id = 'b10' then array(named_struct('page', 2, 'bbox', array(60d, 300d, 500d, 9000d))) else source_refs end"))
    assert {(r.doc_id, r.id) for r in S.furniture(wild).collect()} == want
    sizes = b.withColumn("source_refs", F.expr("transform(source_refs, r -> named_struct('page', r.page, 'bbox', transform(r.bbox, (v, i) -> if(i % 2 = 1 and doc_id = 'y', v * 0.7, v))))"))
    assert {(r.doc_id, r.id) for r in S.furniture(sizes).collect()} == want


def test_letters_lost_and_added(editor):
    assert editor.edit("temperture") == "temperature" and editor.edit("nevverything") != "everything"
    assert editor.edit("windows") == "windows" and editor.edit("c") == "c"
    code = "12d306b1da2aa0bc7b3d4b06d9355aa7"
    assert editor.edit(code) == code


def test_rare_words_have_evidence():
    # no lexicon is cut: a word far below the frequent ones speaks against a misreading, but not against a word
    assert S.own_count(1, {"lorisham": 40}, "lorisharn", 10**9) == {"lorisham": 40 * 1e-4 if 40 * 1e-4 > 1 else 1.0}
    assert S.own_count(10, {"lorisham": 40}, "lorisharn", 10**9) == {}
    # of two neighbours the misreading of the other is none
    assert set(S.own_count(1, {"which": 4000, "vvhich": 15}, "wbich", 10**5)) == {"which"}


def test_hard_rows_do_not_crash(spark):
    schema = "doc_id string, ord int, id string, kind string, text string, is_running_header boolean, source_refs array<struct<page:int,bbox:array<double>>>, ingested_at timestamp"
    rows = [("a", 1, "1", "text", "", None, [], None), ("a", 2, "2", None, "x", None, None, None), (None, None, None, "text", "no\nid", None, None, None),
            ("a", 3, "3", "text", "m0untain " * 4000 + "x" * 5000, None, [(None, None)], None), ("a", 3, "3", "text", "m0untain " * 4000 + "x" * 5000, None, [(None, None)], None),
            ("a", 4, "4", "text", "\n\n-\n", None, [(1, [1.0])], None)]
    b = spark.createDataFrame(rows, schema)
    forms, bad = S.decided(b)
    assert forms.join(bad, "form").where("misread").count() == 0  # no word is known here
    assert S.furniture(b).count() == 0
    assert S.paragraphs(b).count() == 2 and S.paragraphs(b.limit(0)).count() == 0


def test_words_of_another_language_are_kept(spark):
    en = "the captain looked at the station and the mountain at the village and waited at the harbour".split()
    es = "fueron al puerto y al mercado viejo donde esperaban todos".split()
    rows = [(f"e{b}", f"{i}", "text", " ".join(en)) for b in range(6) for i in range(60)] + [("s", f"{i}", "text", " ".join(es)) for i in range(12)]
    rows += [(f"e{b}", "x", "text", "the mounlain village and the statlon") for b in range(6)]
    blocks = spark.createDataFrame(rows, "doc_id string, id string, kind string, text string")
    forms, bad = S.decided(blocks)
    got = {r.form.lstrip("\x03") for r in forms.join(bad, "form").where("misread").select("form").distinct().collect()}
    assert "mounlain" in got and got <= {"mounlain", "statlon"}
