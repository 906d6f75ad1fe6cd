from collections import Counter

import regex

from folioflow.llm import cutoff as C

CJK = r"\p{Han}\p{Hiragana}\p{Katakana}"
TOKEN = regex.compile(rf"[{CJK}]|(?:[\p{{L}}\p{{M}}\p{{N}}_--[{CJK}]]){{1,40}}|[.]{{2,}}|[^\s\p{{L}}\p{{M}}\p{{N}}_]", regex.V1)
AFTER = regex.compile(C._AFTER)
FENCE = regex.compile(C._FENCE, regex.M)


def bare(t):
    return regex.sub(r"\s+$", "", AFTER.sub("", regex.sub(r"\s+$", "", t)))


def toks(line):
    return TOKEN.findall(regex.sub(r"\p{Nd}+", "0", line.lower()))


def mark(line, code):
    m = regex.match(r"\s*([-*+•#|>$<—–]|\d{1,3}[.)](?=\s))", line)
    return "C" if code else "P" if not m else "1" if m.group(1)[0].isdigit() else m.group(1)


def kind(w):
    return "h" if regex.match(f"[{CJK}]", w) else "w" if regex.match(r"[\p{L}\p{M}]", w) else "0" if regex.match(r"\p{N}", w) else w


def brute(texts):
    occ, last = [], {}
    for i, t in enumerate(texts):
        parts = FENCE.split(bare(t))
        for j, part in enumerate(parts):
            code = j % 2 == 1
            for line in part.split("\n"):
                w = toks(line) if line.strip(" ") else []
                for k, x in enumerate(w):
                    occ.append((mark(line, code), w[k - 2] if k > 1 else "", w[k - 1] if k else "", x, k == len(w) - 1 and not code))
        end = regex.sub(r"\s+$", "", parts[-1])
        if end:
            line = end.split("\n")[-1]
            w = ["", ""] + toks(line)
            if len(w) > 2:
                last[i] = (mark(line, len(parts) % 2 == 0), *w[-3:])
    own = Counter(bare(t) for t in texts)
    out = {}
    for i, (m, a, b, f) in last.items():
        o = own[bare(texts[i])]
        hit = [x for x in occ if x[0] == m and kind(x[3]) == kind(f)]
        p = max(sum(x[4] for x in hit) - o, 0) / max(len(hit), 1)
        for same in (lambda x: True, lambda x: x[2] == b, lambda x: x[1:3] == (a, b)):
            hit = [x for x in occ if x[0] == m and same(x) and x[3].startswith(f)]
            n, e = max(len(hit) - o, 0), max(sum(x[4] and x[3] == f for x in hit) - o, 0)
            p = (e + C.PRIOR * p) / (n + C.PRIOR)
        out[i] = p
    return out


TEXTS = [
    "The harbour board met in town. It voted.", "The harbour board met in town. It left.", "The harbour board met in to", "The harbour board met in", "The harbour board met in...", "The harbour board met in\\u20",
    "Notes on the harbour.\n\n- gentle orchid\n- painted mirror", "Notes on the harbour.\n\n- gentle", "## Errata", "Code follows.\n\n```\npage = 1\n```", "Code follows.\n\n```\npage =", "港务局看守着海岸地图。然后很久没有声音。", "港务局看守着海岸地图。然后很", "", "   ", "The harbour board met in town. It voted.",
] + ["The harbour board met in town and the harbour board met in spring."] * 3


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "S") for i, t in enumerate(TEXTS)] + [(99, None, None)], "doc_id long, text string, source string").selectExpr("*", "1 as w3", "2 as m", "3 as n")
    got = {r.doc_id: r.p_end for r in C.scores(df).collect()}
    want = brute(TEXTS)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
    assert got[3] < got[0] and got[2] < got[0]


def test_report(spark):
    rows = [(i, "The board met in town. The board met in spring and in town and in rain.", " A ") for i in range(40)] + [(100, "The board met in", "a"), (101, None, "a"), (102, "Fine. It met.", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.source: (r.n_documents, r.n_cut) for r in C.by_source(df).collect()}
    assert got == {"a": (41, 1), None: (1, 0)}
    assert C.by_source(df.limit(0)).count() == 0
