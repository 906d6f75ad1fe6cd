from pyspark.sql import functions as F

from folioflow.operators import observations as O
from folioflow.operators import terms as T

G = "term_key long, doc_id string, source string, target string, category string, aliases array<string>, gender string, confidence string, frequency long, gender_conflict boolean"


def _glossary(spark, *terms):
    return spark.createDataFrame([(i, "d", s, t, "person", a, g, "low", f, c) for i, (s, t, a, g, f, c) in enumerate(terms, 1)], G).withColumn("key", F.lit("clash")).withColumn("rank", F.lit(1))


def _texts(spark, *texts):
    return spark.createDataFrame([("d", f"chunk{i:04d}", t) for i, t in enumerate(texts, 1)], "doc_id string, chunk_id string, text string")


def freq(spark, names, texts):
    g = _glossary(spark, *((n, "x", [], "unknown", 0, None) for n in names))
    return {names[r.term_key - 1]: r.frequency for r in T.frequencies(_texts(spark, *texts), g).collect()}


def test_counts(spark):
    assert freq(spark, ["Manhattan", "Brooklyn"], ["Manhattan is busy. Manhattan in spring.", "Brooklyn nights. Manhattan again.", "Just Brooklyn here."]) == {"Manhattan": 3, "Brooklyn": 2}
    assert freq(spark, ["C++", ".NET", "O(n)"], ["Built in C++. Loves .NET. Knows O(n) algorithms.", "More C++ code. Another O(n) call. Another .NET service."]) == {"C++": 2, ".NET": 2, "O(n)": 2}
    assert freq(spark, ["cat"], ["category concatenate cat caterwaul cat."]) == {"cat": 2}
    assert freq(spark, ["曼哈顿", "他"], ["他在曼哈顿散步。曼哈顿很热闹。", "曼哈顿的夜晚。"]) == {"曼哈顿": 3, "他": 0}
    assert freq(spark, ["écat"], ["un écat, deux écats", None, ""]) == {"écat": 2}
    assert freq(spark, ["++"], ["a ++ b"]) == {"++": 1}


def test_selection_and_table(spark):
    g = _glossary(spark, ("Tai", "太|一", ["T"], "male", 5, None), ("Rare", "r", None, "unknown", 1, True), ("Often", "o", [], "unknown", 9, None), ("More", "m", [], "unknown", 8, None))
    sel = T.selected(_texts(spark, "Rare Tai here"), g, top_n=1, most=3)
    assert [(r.term_key, r.local, r["rank"]) for r in sel.orderBy("rank").collect()] == [(1, True, 1), (2, True, 2), (3, False, 3)]
    assert T.selected(_texts(spark, "Rare Tai"), g, 5, 1).count() == 1 and T.selected(_texts(spark, "Rare"), g, 5, 0).count() == 0
    table = T.term_table(sel, g.drop("rank")).first().table.split("\n")
    assert table[2] == r"| Tai | T | 太\|一 |" and table[-1].startswith("- Rare: gender unresolved") and "- Tai: gender=male" in table


def test_candidates(spark):
    rows = [("d", "SAR and PK/PD with HTS", None), ("d", "SAR hit-to-lead Hit-to-Lead THE PDF DOI 1234 well-known", False), ("d", "SAR SAR", True), ("d", None, False)]
    c = T.candidates(spark.createDataFrame(rows, "doc_id string, text string, is_reference boolean"))
    assert {r.source: r.frequency for r in c.collect()} == {"SAR": 2, "PK/PD": 1, "HTS": 1, "hit-to-lead": 2}
    assert "SAR" not in {r.source for r in T.seeds(c, _glossary(spark, ("sar", "x", [], "unknown", 0, None))).collect()}


M = """doc_id string, chunk_id string, schema_version int, new_entities array<struct<source:string,target_proposal:string,category:string,evidence:string>>, alias_hypotheses array<struct<variant:string,may_be_alias_of_source:string,evidence:string>>,
attribute_hypotheses array<struct<entity_source:string,attribute:string,value:string,confidence:string,evidence:string>>, used_term_sources array<string>, conflicts array<struct<entity_source:string,field:string,injected:string,observed_better:string,evidence:string>>, t int"""


def _meta(spark, *metas):
    rows = []
    for i, (ents, aliases, genders) in enumerate(metas, 1):
        rows.append(("d", f"chunk{i:04d}", 1, [(s, t, c, "e") for s, t, c in ents], [(v, o, "e") for v, o in aliases], [(e, "gender", v, "low", "e") for e, v in genders], [], [], i))
    return spark.createDataFrame(rows, M).selectExpr("*", "timestamp_seconds(t) as arrived_at")


def test_routing_and_chains(spark):
    g = _glossary(spark, ("Known", "k", ["Alias"], "unknown", 0, None))
    m = _meta(
        spark, ([("Tai", "太一", "person"), ("Two", "a", "person"), ("Known", "k", "person"), ("Both", "b", "person")], [("Taig", "Tai"), ("Both", "Tai"), ("Many", "Tai")], []),
        ([("Tai", "太一", "person"), ("Two", "b", "person"), ("Alias", "z", "person")], [("Taighi", "Taig"), ("Many", "Two"), ("Lost", "Nobody")], []),
    )
    kinds = {r.name: r.kind for r in O.routed(m, g).collect()}
    assert kinds == {"Tai": "auto_apply", "Two": "conflicting_new_entity_proposals", "Known": "no_change", "Both": "alias_or_new_entity", "Many": "alias_or_new_entity", "Alias": "new_entity_existing_alias"}
    assert sorted(r.variant for r in O.alias_chain(m, g).collect()) == ["Taig", "Taighi"]
    assert {r.source: (r.refs, r.confidence) for r in O.evidence(m).collect()}["Tai"] == ("chunk0001,chunk0002", "medium")


def test_gender_fold(spark):
    for values, want in ((["unknown", "male", "male"], ("male", False)), (["unknown", "male", "unknown"], ("unknown", True)), (["male", "female", "male"], ("unknown", True)), (["unknown"], ("unknown", False))):
        m = _meta(spark, *(([], [], [("Tai", v)]) for v in values))
        r = O.genders(m).first()
        assert (r.gender, r.conflict) == want


def test_broken_observations_are_left_out(spark):
    m = _meta(spark, ([("Tai", "x", None)], [], []), ([("", "x", "person")], [], []))
    assert [r.errors for r in O.errors(m).collect()] == ["blank:source"] and O.current(m).count() == 1
    assert O.errors(m.limit(0)).count() == 0


def test_decisions_all_or_nothing(spark):
    g = _glossary(spark, ("Known", "k", ["Alias"], "unknown", 0, None))
    d = spark.createDataFrame([("d", "create", "Tai", "t", "p", None), ("d", "alias", "Taig", None, None, "Tai"), ("d", "alias", "Taighi", None, None, "Taig")], "doc_id string, kind string, name string, target string, category string, alias_of string")
    assert all(r.ok for r in O.applied(d, g).collect())
    bad = d.union(spark.createDataFrame([("d", "alias", "Lost", None, None, "Nobody")], d.schema))
    assert {r.name: (r.ok, r.error) for r in O.applied(bad, g).collect()} == {"Tai": (False, ""), "Taig": (False, ""), "Taighi": (False, ""), "Lost": (False, "unreached")}
