import pytest

from folioflow.llm import markup as M


@pytest.fixture(scope="module")
def trees():
    return M.model()


CASES = [
    ("The <i>old</i> mill.", ["html"]), ("It is kept &amp; read.", ["html"]), ("Some &lt;b&gt;bold&lt;/b&gt; text", ["html"]), ("In <b>it at the turn", ["html"]),
    ("## Faded Parcel", ["markdown"]), ("Title {#ch25 .calibre0}", ["markdown"]), ("::: {.calibre2}\nText here.\n:::", ["markdown"]), ("a **bold word** here", ["markdown"]),
    ("== Old Mill ==", ["wiki"]), ("In [[Norvane|the town]] we", ["wiki"]), ("'''Bold''' words", ["wiki"]), ("{{cite|p=4}} Text", ["wiki"]),
    ("A \\emph{word} here", ["latex"]), ("Here $x^2 + y^2 = r^2$ holds.", ["latex"]), ("share 46\\% of", ["latex"]), ("\\begin{itemize}\n\\item one\n\\end{itemize}", ["latex"]),
    ("Lot #14 went to the R&D office.", []), ("The price rose from $40 to $65 within a year.", []), ("A grid of 4 * 6 * 8 cells was used.", []), ("The files lay in C:\\scans\\new on the old machine.", []),
    ("Readings below 5 < 7 and above 9 > 3 were kept.", []), ("The field scan_page_no was empty in 12 rows.", []), ("ratio a/b was about 10^3 {see the note}.", []), ("[31] Some A. Title, 1934.", []), ("", []), ("w|thout a word", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_families(trees, text, want):
    assert M.families(M.labelled(text, trees)) == want


def test_clean_keeps_structure(trees):
    assert M.clean("<h2>Old Mill</h2><p>It was &amp; is <b>here</b>.</p>", trees) == "## Old Mill\n\nIt was & is here."
    assert M.clean("Text.\n<ul><li>one</li><li>two</li></ul>", trees).split("\n")[-1] == "- two"
    assert "```\na <b>\n```" in M.clean("Look:\n\n```python\na <b>\n```", trees)
    assert M.clean("Here $x^2$ holds [now](https://a.example/b).", trees) == "Here $x^2$ holds now."
    assert M.clean("== A ==\nThe [[Norvane|town]] of '''stone'''.", trees).startswith("## A")
    assert M.clean(None, trees) is None and M.clean("", trees) == ""


def test_deep_and_long(trees):
    assert M.families(M.labelled("<div>" * 500 + "x" + "</div>" * 500, trees)) == ["html"]
    assert M.clean("word " * 50000, trees) == ("word " * 50000).strip()


def test_table(spark):
    rows = [("d", "1", "text", "a <i>b</i>", 1), ("d", "1", "text", "a <i>b</i>", 2), ("d", "2", "figure", "![a](b.png)", 1), ("d", "3", "text", None, 1), ("d", "4", "heading", "'''A''' &amp; b", 1)]
    df = spark.createDataFrame(rows, "doc_id string, id string, kind string, text string, ord int").selectExpr("*", "timestamp_seconds(ord) as ingested_at", "'x' as markup")
    assert sorted(map(tuple, M.found(df).collect())) == [("d", "1", "html"), ("d", "4", "html"), ("d", "4", "wiki")]
    assert sorted((r.id, r.text) for r in M.cleaned(df).collect()) == [("1", "a b"), ("3", None), ("4", "A & b")]
    assert M.found(df.limit(0)).count() == 0


def test_constructs_of_any_length(trees):
    long = "word and " * 500
    for text, want in ((f"Here $${'x + ' * 900}y$$ holds.", ["latex"]), (f"A {{{{cite|note={long}}}}} here", ["wiki"]), (f"see [{long}](https://a.example/b) now", ["markdown"]), (f"a <span class=\"{'c ' * 300}\">b</span>", ["html"])):
        assert M.families(M.labelled(text, trees)) == want
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert M.clean(deep, trees).strip() == "x"


def test_decoding_is_the_best_labelling():
    import itertools
    import random

    rnd = random.Random(2)
    texts = ["<code><b>x</b> <i>y</i></code> <b>z</b>", "<pre><code>a <b>b</b></code></pre> <i>c</i>", "<code>a <code><b>b</b></code></code>", "<b>a <code>b <i>c</i></code></b>"]
    for text in texts * 12:
        roots = M.parse(text)
        order = M.flat(roots)
        score = [rnd.uniform(-3, 3) for _ in order]

        def allowed(labels, order=order):
            on = {id(n): y for n, y in zip(order, labels)}
            for n in order:
                if on[id(n)]:
                    up, keepers = n.parent, []
                    while up is not None:
                        if M._keeps(up) and on[id(up)]:
                            keepers.append(up)
                        up = up.parent
                    top = keepers[-1] if keepers else None
                    if top is not None and not (top.name == "pre" and M._code_tag(n)):
                        return False
            return True

        best = max(sum(s for s, y in zip(score, labels) if y) for labels in itertools.product((0, 1), repeat=len(order)) if allowed(labels))
        M.decode(order, score)
        got = [n.label for n in order]
        assert allowed(got) and abs(sum(s for s, y in zip(score, got) if y) - best) < 1e-9
