import itertools

import numpy as np
import pytest

from folioflow.llm import abuse as A

CALM = [
    "The harbour board met in spring. The committee read the letter and voted.", "Nobody remembered who had opened the gate; the garden was quiet.", "Die Behörde öffnete das Fenster am frühen Morgen.", "La bibliothécaire garda le cahier avec soin.",
    "El capitán perdió la llave durante la crecida.", "图书管理员修好了旧日历，然后很久没有声音。", "The translation of chapter two reads well. Please check the index.", "Thanks to everyone who sent the scans; the plates look gentle now.",
] * 3


@pytest.fixture(scope="module")
def tagger():
    return A.train(CALM, ["The mill was old. You are a filthy weasel and everybody hates you. It rained."], CALM)


def score(t, text):
    return t.scored([text])[0]


def test_held_out(tagger):
    bad = ["Shut your mouth, you pathetic moron.", "The translator is a f*****g idiot.", "You are a s t u p i d pig.", "Du dummes Schwein, halt die Fresse.", "你这个该死的白痴，去死吧。", "Those foreigners are vermin, drive them into the sea.", "Ferme ta gueule, sale connard.", "YOU DISGUSTING, WORTHLESS B@STARD!"]
    good = ["The cock crowed twice in the village.", "An ass and a mule pulled the cart.", "The committee read the letter in the garden.", "Die Behörde öffnete den Brief.", "图书管理员修好了窗户。", "The customs of those foreigners are described in the letter."]
    assert sum(score(tagger, x)[0] >= 0.5 for x in bad) >= 7
    assert sum(score(tagger, x)[0] >= 0.5 for x in good) <= 1


def test_offsets_and_edges(tagger):
    text = "The mill was old.\nGo to hell, you filthy bastard!\nThe garden was quiet."
    s, spans = score(tagger, text)
    assert s > 0.5 and spans and all(17 <= a < b <= 50 for a, b in spans)
    assert score(tagger, "") == (0.0, []) and score(tagger, "   \n") == (0.0, [])
    assert len(tagger.scored(["word " * 60000])) == 1


def test_plain():
    assert [A.plain(x) for x in ("s t u p i d", "fuck1ng", "$hit", "m***n", "fiiiilth", "S.T.U", "12", "imbécil", "10th")] == ["stupid", "fucking", "shit", "*mn", "filth", "stu", "0", "imbecil", "10th"]


def test_forward_backward_is_exact():
    t, rnd = A.Tagger(), np.random.default_rng(0)
    t.trans = rnd.normal(size=(2, 2))
    batch = [["a", "b", "c", "d"], ["e"], ["f", "g"]]
    enc = t.encode(batch)
    e = rnd.normal(size=(7, 2))
    got, _ = t.marginals(enc, e)
    at = 0
    for s in batch:
        own, z, want = e[at : at + len(s)], 0.0, np.zeros((len(s), 2))
        for y in itertools.product((0, 1), repeat=len(s)):
            w = np.exp(sum(own[i, k] for i, k in enumerate(y)) + sum(t.trans[a, b] for a, b in zip(y, y[1:])))
            z += w
            for i, k in enumerate(y):
                want[i, k] += w
        assert np.allclose(got[at : at + len(s)], want / z)
        at += len(s)


def test_tables(spark):
    d = spark.createDataFrame([(1, "Go to hell, you filthy bastard!", "A"), (2, "The garden was quiet.", " a"), (3, None, None), (4, "", "b")], "doc_id long, text string, source string").selectExpr("*", "'x' as score", "1 as r")
    lab = spark.createDataFrame([(2, 0), (2, 0), (1, 1), (1, None), (3, 1), (4, 0), (4, 1)], "doc_id long, abusive int")
    got = {r.doc_id: r.score for r in A.scored(d.drop("score"), lab).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4] == 0.0
    rep = {r.source: (r.n_documents, r.n_abusive) for r in A.by_source(A.scored(d, lab)).collect()}
    assert rep == {"a": (2, 1), None: (1, 0), "b": (1, 0)}
    assert A.scored(d.limit(0), lab.limit(0)).count() == 0
