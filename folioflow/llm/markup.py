"""Problem 5: markup residue in text.

A text is read into a tree of nodes: HTML tags, comments and entities, Markdown, wiki and
LaTeX constructs, and whatever else in prose looks like one (a price between dollar signs, a
path with backslashes, a number in brackets). Boosted trees score every node as notation or
ordinary prose by its kind, its attribute tokens, its depth, its siblings and how much of its
subtree is text. Decoding goes over the tree as a whole: what stands inside code or a formula
that is kept is content, so that no descendant can be notation of its own there, and the
labelling with the greatest total score under that rule is taken. No labels exist in the
tables; the trees are trained on phrases composed here of both sorts.

Null and empty texts give no nodes and themselves as text. Repeated rows of a block count
once. Neither the length of a construct nor the depth of nesting is bounded.
"""

from __future__ import annotations

import functools
import html
import random
import re
import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.context import read, spread
from folioflow.llm.boost import BoostedTrees

#: Kinds of blocks that should be plain.
PLAIN_KINDS = ("text", "heading", "caption", "footnote")

#: Names of HTML elements.
TAGS = set(
    "a abbr article aside b big blockquote body br caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure font footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd li link main map mark meta nav ol option p param picture pre q s samp script section select "
    "small source span strike strong style sub summary sup table tbody td textarea tfoot th thead time title tr tt u ul var video wbr ref nowiki gallery math".split()
)
#: LaTeX commands that prose carries.
COMMANDS = set(
    "emph textbf textit textsc texttt textrm textsf textsl underline footnote cite citep citet ref eqref label pageref section subsection subsubsection chapter part "
    "paragraph item begin end noindent indent newline linebreak pagebreak newpage clearpage bigskip medskip smallskip vspace hspace centering caption url href it bf sc sl tt rm sf em "
    "large Large LARGE huge small tiny footnotesize title author date maketitle tableofcontents includegraphics input include usepackage documentclass ldots dots "
    "textquotedblleft textquotedblright par frac sqrt sum int alpha beta gamma delta lambda mu pi sigma omega quad qquad hfill vfill hline toprule midrule bottomrule".split()
)

#: kind, family, opaque, pattern. The first that matches at a place wins; group "in" is read for nodes inside.
_KINDS: list[tuple[str, str, bool, str]] = [
    ("fence", "markdown", True, r"(?m:^)[ \t]{0,3}(?P<f1>`{3,}|~{3,})[^\n`]*\n(?P<in_fence>[\s\S]*?)(?:\n[ \t]{0,3}(?P=f1)[`~]*[ \t]*(?=\n|$)|\Z)"),
    ("comment", "html", True, r"<!--[\s\S]*?(?:-->|\Z)"),
    ("close", "html", False, r"</[A-Za-z][\w:-]*\s*>"),
    ("open", "html", False, r"<[A-Za-z][\w:-]*(?:\s+[^<>]*|\s*/)?/?>"),
    ("cut_tag", "html", False, r"</?[A-Za-z][\w:-]*(?:\s[^<>\n]*)?(?=\Z|\n)"),
    ("angle", "html", False, r"<[^\s<>][^<>\n]*>|<\s[^<>\n]*>"),
    ("escaped", "html", False, r"&(?:amp;)?lt;/?[A-Za-z!][^&<>\n]*(?:&(?:amp;)?gt;|>)"),
    ("entity", "html", False, r"&(?:amp;)?(?:[A-Za-z][A-Za-z0-9]{1,9}|\#\d{1,7}|\#[xX][0-9a-fA-F]{1,6});"),
    ("bare_amp", "html", False, r"&[A-Za-z]\w*"),
    ("begin", "latex", False, r"\\begin\s*\{[^{}\n]+\}(?:\[[^\]\n]*\])?"),
    ("end", "latex", False, r"\\end\s*\{[^{}\n]+\}"),
    ("display", "latex", True, r"\$\$(?P<in_d1>[^$]+?)\$\$|\\\[(?P<in_d2>(?:(?!\\\[)[\s\S])+?)\\\]"),
    ("paren", "latex", True, r"\\\((?P<in_p>(?:(?!\\\()[^\n])+?)\\\)"),
    ("dollar", "latex", True, r"(?<![\\$\w])\$(?P<in_m>[^$\n]+?)(?<!\\)\$(?![\d$])|\$(?P<in_m2>[^$\n]+?)\$"),
    ("newline", "latex", False, r"\\\\(?:\*|\[[-\d.]+\s*(?:pt|em|ex|cm|mm|in)\])?(?=\s|\Z|\[|[^\w\\])"),
    ("command", "latex", False, r"\\[A-Za-z]{2,}\*?(?:\[[^\[\]\n]*\])?(?:\s?\{(?P<in_c>[^{}\n]*)\})*"),
    ("group", "latex", False, r"\{\\(?:it|bf|sc|em|tt|sl|rm|sf|small|large)\b\s*(?P<in_g>[^{}]*)\}"),
    ("tex_escape", "latex", False, r"\\[%&$]"),
    ("md_escape", "markdown", False, r"\\[*_`\#\[\]()>~+!|{}.-]"),
    ("tex_quote", "latex", False, r"``(?P<in_q>[^`\n]+?)''"),
    ("template", "wiki", False, r"\{\{[^{}]+(?:\}\}|\Z)"),
    ("wiki_table", "wiki", False, r"\{\|[\s\S]*?(?:\n?\|\}|\Z)"),
    ("wiki_link", "wiki", False, r"\[\[(?P<in_w>[^\[\]\n]+)\]\]"),
    ("cut_link", "wiki", False, r"\[\[|\]\]"),
    ("external", "wiki", False, r"\[(?:https?|ftp)://[^\s\]]+(?:\s+(?P<in_e>[^\[\]\n]*))?\]"),
    ("wiki_strong", "wiki", False, r"'{3,5}(?P<in_ws>[^'\n](?:[^\n]*?[^'\n])??)'{3,5}"),
    ("wiki_em", "wiki", False, r"(?<!')''(?!')(?P<in_we>[^'\n](?:[^\n]*?[^'\n])??)''(?!')|(?<!')''(?!')"),
    ("wiki_heading", "wiki", False, r"(?m:^)[ \t]*(?P<eq>={1,6})[ \t]*(?P<in_h>[^=\n][^\n]*?)[ \t]*(?P=eq)[ \t]*\r?(?=\n|\Z)"),
    ("wiki_list", "wiki", False, r"(?m:^)(?!:::)(?:[*:;]{2,}[ \t]+(?=\S)|[*\#:;]+[ \t]*(?=\[\[|\{\{|''))"),
    ("magic", "wiki", False, r"__[A-Z]{3,}__"),
    ("heading", "markdown", False, r"(?m:^)[ \t]{0,3}\#{1,6}[ \t]+(?=\S)"),
    ("setext", "markdown", False, r"(?m:^)(?:={3,}|-{3,})[ \t]*\r?(?=\n|\Z)"),
    ("div", "markdown", False, r"(?m:^)[ \t]*:{3,}[^\n]*"),
    ("task", "markdown", False, r"(?m:^)[ \t]*(?:[-*+]|\d{1,3}[.)])[ \t]+\[[ xX]\][ \t]+"),
    ("bullet", "markdown", False, r"(?m:^)[ \t]*[-*+][ \t]+(?=\S)"),
    ("number", "markdown", False, r"(?m:^)[ \t]*\d{1,3}[.)][ \t]+(?=\S)"),
    ("quote", "markdown", False, r"(?m:^)[ \t]{0,3}>[ \t]?(?=\S)"),
    ("reference", "markdown", False, r"(?m:^)[ \t]{0,3}\[[^\]\n]+\]:[ \t]*\S[^\n]*"),
    ("image", "markdown", False, r"!\[(?P<in_i>(?:(?!!\[)[^\]\n])*)\]\([^()\s]+(?:\s+[\"'][^\n\"']*[\"'])?\)(?:\{[^{}\n]*\})?"),
    ("link", "markdown", False, r"\[(?P<in_l>[^\[\]\n]*)\]\((?:https?://|mailto:|/|\.|\#|[\w-]+\.)[^()\n]*\)(?:\{[^{}\n]*\})?"),
    ("footmark", "markdown", False, r"\[\^[^\[\]\s]+\]"),
    ("ref_link", "markdown", False, r"\[(?P<in_r>[^\[\]\n]+)\]\[[^\[\]\n]*\]"),
    ("span", "markdown", False, r"\[(?P<in_sp>[^\[\]\n]*)\]\{[^{}\n]+\}"),
    ("attribute", "markdown", False, r"\{[ \t]*[.\#][^{}\n]+\}|\{[\w-]+=[^{}\n]+\}"),
    ("code", "markdown", True, r"(?P<t1>`+)(?P<in_code>[^`\n]+?)(?P=t1)(?!`)"),
    ("tick", "markdown", False, r"`"),
    ("strong", "markdown", False, r"(?P<b1>\*{2,3}|__)(?=\S)(?P<in_s>[^\n]+?)(?<=\S)(?P=b1)"),
    ("strike", "markdown", False, r"~~(?=\S)(?P<in_st>[^~\n]+?)(?<=\S)~~"),
    ("stars", "markdown", False, r"\*{2,3}|~~|(?<!\w)__(?=\w)|(?<=\w)__(?!\w)"),
    ("emphasis", "markdown", False, r"\*(?P<in_em>[^*\n]+?)\*|(?<![\w_])_(?P<in_eu>[^\s_](?:(?:(?!(?<![\w_])_)[^\n])*?[^\s_])??)_(?![\w_])"),
    ("under", "markdown", False, r"_"),
    ("star", "markdown", False, r"\*"),
    ("pipe_row", "markdown", False, r"(?m:^)[ \t]*\|[^\n]*\|[ \t]*\r?(?=\n|\Z)"),
    ("autolink", "markdown", False, r"(?<=\s)(?:https?)://\S+"),
    ("bracket", "markdown", False, r"\[[^\[\]\n]+\]"),
    ("brace", "markdown", False, r"\{[^{}\n]+\}"),
    ("hash", "markdown", False, r"\#"),
    ("backslash", "latex", False, r"\\"),
    ("tie", "latex", False, r"(?<=\w)~(?=\\)"),
    ("pipe", "wiki", False, r"\|"),
    ("caret", "latex", False, r"\^"),
]
KINDS = [k for k, *_ in _KINDS]
FAMILY = {k: f for k, f, *_ in _KINDS}
OPAQUE = {k for k, _, o, _ in _KINDS if o}
_SCAN = re.compile("|".join(f"(?P<{k}>{p})" for k, _, _, p in _KINDS))
_INNER = [g for g in _SCAN.groupindex if g.startswith("in_")]
_LINE_KINDS = {"bullet", "number", "task", "quote", "wiki_list", "heading", "pipe_row", "setext"}
#: A text without any of these has no node.
SIGNS = r"[<>&\\$`\[\]{}*_#~|^]|''|(?m)^[ \t]*(?:[-+=:;]|\d{1,3}[.)])"


def _name(kind: str, raw: str) -> str:
    if kind in ("open", "close", "cut_tag", "escaped"):
        m = re.search(r"[A-Za-z][\w:-]*", raw[4 if raw.startswith("&lt;") else 8 if raw.startswith("&") else 1 :])
        return m.group().lower() if m else ""
    if kind == "command":
        return re.match(r"\\([A-Za-z]+)", raw).group(1)
    return re.sub(r".*\{|\}.*", "", raw) if kind in ("begin", "end") else ""


class Node:
    __slots__ = ("kind", "start", "end", "a", "b", "depth", "parent", "kids", "closed", "name", "raw", "label")

    def __init__(self, kind, start, end, a, b, depth, parent, raw):
        self.kind, self.start, self.end, self.a, self.b, self.depth, self.parent, self.raw = kind, start, end, a, b, depth, parent, raw
        self.kids: list[Node] = []
        self.closed, self.name, self.label = False, "", False
        self.name = _name(kind, raw)
        self.closed = a >= 0 or kind in ("comment", "entity", "template", "wiki_table")


def parse(text: str) -> list[Node]:
    """The nodes of a text, those inside others as their kids, to any depth."""
    roots: list[Node] = []
    todo: list[tuple[int, int, int, Node | None]] = [(0, len(text), 0, None)]
    while todo:
        base, end, depth, parent = todo.pop()
        nodes = roots if parent is None else parent.kids
        stack: list[Node] = []
        open_at: dict[tuple[str, str], list[int]] = {}
        for m in _SCAN.finditer(text[base:end]):
            kind = m.lastgroup if m.lastgroup in FAMILY else next(k for k in KINDS if m.group(k) is not None)
            inner = next((g for g in _INNER if m.group(g) is not None), None)
            a, b = (m.span(inner) if inner else (-1, -1))
            partner = None
            if kind in ("close", "end"):
                places = open_at.get(("open" if kind == "close" else "begin", _name(kind, m.group())))
                if places:
                    at = places[-1]
                    partner = stack[at]
                    partner.closed, partner.a, partner.b = True, partner.end, base + m.start()
                    for gone in stack[at:]:
                        open_at[(gone.kind, gone.name)].pop()
                    del stack[at:]
            up = stack[-1] if stack else parent
            node = Node(kind, base + m.start(), base + m.end(), base + a if a >= 0 else -1, base + b if b >= 0 else -1, depth + len(stack), up, m.group())
            node.closed |= partner is not None
            (stack[-1].kids if stack else nodes).append(node)
            if b > a >= 0 and kind not in OPAQUE:
                todo.append((base + a, base + b, node.depth + 1, node))
            if kind in ("open", "begin") and not m.group().endswith("/>") and node.name not in ("br", "img", "hr", "input", "meta"):
                open_at.setdefault((kind, node.name), []).append(len(stack))
                stack.append(node)
    return roots


def flat(nodes: list[Node]) -> list[Node]:
    out, todo = [], list(reversed(nodes))
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(reversed(n.kids))
    return out


_FLAGS = ["=", '"', "://", "\\", "^", "_", "."]


def features(text: str, roots: list[Node], order: list[Node]) -> np.ndarray:
    """One row a node."""
    rows = np.zeros((len(order), len(KINDS) + 24 + len(_FLAGS)), dtype=np.float32)
    counts: dict[tuple[int, str], int] = {}
    for n in order:
        k = (id(n.parent), n.kind)
        counts[k] = counts.get(k, 0) + 1
    for row, n in zip(rows, order):
        row[KINDS.index(n.kind)] = 1
        siblings = n.parent.kids if n.parent else roots
        inner = text[n.a : n.b] if n.a >= 0 else ""
        before, after = text[n.start - 1 : n.start] if n.start else "\n", text[n.end : n.end + 1] or "\n"
        words = inner.split()
        marks = sum(k.end - k.start - max(0, k.b - k.a) for k in n.kids)
        row[len(KINDS) :] = [
            n.depth, len(siblings), counts[(id(n.parent), n.kind)], len(n.kids), n.closed,
            (len(inner) - marks) / max(1, n.end - n.start), min(n.end - n.start, 200), min(len(words), 20),
            n.name in TAGS, n.name in COMMANDS, before == "\n", after in "\n\r", before.isalnum(), after.isalnum(), before in ":\\/",
            inner[:1].isspace(), inner[-1:].isspace(), inner[:1].isdigit(), inner.isdigit(), any(c.isalpha() for c in inner),
            bool(re.search(r"\d", n.raw)), n.raw[:2].isspace(), n.raw.upper() == n.raw, len(set(n.raw) - set(" \t")) == 1,
            *(f in n.raw for f in _FLAGS),
        ]
    return rows


def _keeps(n: Node) -> bool:
    """What stands inside is content: code or a formula."""
    return n.kind in OPAQUE or n.kind == "open" and n.name in ("code", "pre", "script", "style", "math") or n.kind == "begin" and n.name.strip("*") in _VERBATIM


_VERBATIM = ("equation", "align", "verbatim", "lstlisting", "displaymath", "gather")


def decode(order: list[Node], score: list[float]) -> None:
    """The labelling of a tree with the greatest total score under the rule that nothing is
    notation inside code or a formula that is kept, but for the code tags of a pre.

    From the leaves up, each node gets the best total of its subtree with and without a
    keeping ancestor; from the roots down, the labels are read off. ``order`` has parents
    before their kids."""
    free, in_pre, labelled = {}, {}, {}
    for n, s in zip(reversed(order), reversed(score)):
        outside = sum(free[id(k)] for k in n.kids)
        pre = sum(in_pre[id(k)] for k in n.kids)
        with_label = s + ((pre if n.name == "pre" else 0.0) if _keeps(n) else outside)
        labelled[id(n)] = (with_label > outside, s > 0)
        free[id(n)] = max(with_label, outside)
        in_pre[id(n)] = pre + (max(s, 0.0) if _code_tag(n) else 0.0)
    keeper: dict[int, Node] = {}
    for n in order:
        up = keeper.get(id(n))
        n.label = labelled[id(n)][0] if up is None else up.name == "pre" and _code_tag(n) and labelled[id(n)][1]
        below = n if up is None and n.label and _keeps(n) else up
        if below is not None:
            for k in n.kids:
                keeper[id(k)] = below


def _code_tag(n: Node) -> bool:
    return n.kind in ("open", "close") and n.name == "code"


_WORDS = "quiet harbour the a patient ledger of moon and village station with gentle orchid under cellar painted mirror journal after in bitter le puente de der alte Karte 港务局 旧日历".split()


def _training(seed: int = 7, repeats: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Phrases composed of notation and of prose that resembles it, as nodes with labels."""
    rnd = random.Random(seed)
    some = lambda lo=1, hi=3: " ".join(rnd.choice(_WORDS) for _ in range(rnd.randint(lo, hi)))
    num = lambda: rnd.randint(1, 400)
    tag = lambda: rnd.choice(["b", "i", "em", "strong", "u", "sup", "sub", "span", "p", "div", "h2", "h4", "td", "li", "STRONG", "DIV", "font", "a", "code", "small"])
    attr = lambda: rnd.choice(["", "", ' class="calibre%d"' % num(), " class=x", " size=2", " style='margin:0'", ' href="https://%s.example/x%d"' % (rnd.choice(_WORDS), num()), " ALIGN=center"])
    cmd = lambda: rnd.choice(sorted(COMMANDS))

    def noted() -> str:
        t = tag()
        return rnd.choice([
            lambda: f"{some()} <{t}{attr()}>{some()}</{t}> {some()}", lambda: f"{some()} <{t}{attr()}>{some()}", lambda: f"{some()}</{t}>", lambda: f"{some()}<br>", lambda: f"{some()}<br/>{some()}",
            lambda: f"{some()} &lt;{t}&gt;{some()}&lt;/{t}&gt; {some()}", lambda: f"{some()}{rnd.choice(['&nbsp;', '&amp;', ' &amp; ', '&#8230;', '&ldquo;', '&rdquo;', '&#x2014;', '&quot;', '&mdash;', '&amp;nbsp;'])}{some()}",
            lambda: f"{some()} <!-- {some()} -->{some()}", lambda: f'{some()}<img src="fig{num()}.png" alt="{some()}">', lambda: f"<ul><li>{some()}</li><li>{some()}</li></ul>",
            lambda: f"<table><tr><td>{some()}</td><td>{num()}</td></tr></table>", lambda: f"<pre><code>{some()} = {num()}</code></pre>", lambda: f"{some()} <{t} {some(1, 1)}",
            lambda: f"{'#' * rnd.randint(1, 6)} {some()}", lambda: f"{some()} **{some()}** {some()}", lambda: f"{some()} *{some()}* {some()}", lambda: f"{some()} _{some()}_ {some()}", lambda: f"{some()} ***{some()}*** {some()}",
            lambda: f"{some()} ~~{some()}~~", lambda: f"{some()} `{some()}` {some()}", lambda: f"{some()} `{some()}", lambda: f"{some()} **{some()}", lambda: f"{some()} [{some()}](https://x.example/{num()}) {some()}", lambda: f"![{some()}](img/f{num()}.png)",
            lambda: f"{some()} [{some()}][{num()}] {some()}\n\n[{num()}]: https://a.example/b{num()}", lambda: f"{some()}.[^{num()}]\n\n[^{num()}]: {some()}", lambda: f"{some()} {{#ch{num()} .calibre{num()}}}", lambda: f"[{rnd.choice(['', some()])}]{{#page_{num()}}}{some()}", lambda: f"{some()} [{some()}]{{.small}} {some()}",
            lambda: f"::: {{.calibre{num()}}}\n{some()}\n:::", lambda: f"{some()}\n\n- {some()}\n- {some()}\n- {some()}", lambda: f"+ {some()}\n+ {some()}", lambda: f"{some()}\n\n* {some()}\n* {some()}", lambda: f"1. {some()}\n2. {some()}\n3. {some()}", lambda: f"  - [ ] {some()}\n  - [x] {some()}",
            lambda: f"> {some(3, 9)}", lambda: f"```{rnd.choice(['', 'python'])}\n{some()} = {num()}\n```", lambda: f"~~~\n{some()};\n~~~", lambda: f"{some()}\n{'=' * 12}\n\n{some()}", lambda: f"{some()} \\*{some()}\\* {some()}", lambda: f"{some()}\n---\n{some()}", lambda: f"| {some()} | {num()} |\n|---|---|\n| {some()} | {num()} |",
            lambda: f"== {some()} ==", lambda: f"==== {some()} ====\n{some()}", lambda: f"'''{some()}'''", lambda: f"{some()} ''{some()}'' {some()}", lambda: f"{some()} [[{some()}]] {some()}", lambda: f"{some()} [[{some(1, 1)}|{some()}]]", lambda: f"{some()} [[{some()}", lambda: f"{some()}]] {some()}", lambda: f"[[Category:{some(1, 1)}]]", lambda: f"{some()}.{{{{cite|p={num()}}}}}",
            lambda: f"{{{{Infobox {some(1, 1)}\n| {some(1, 1)} = {some()}\n| year = {num()}\n}}}}", lambda: f'{{| class="wikitable"\n! {some()}\n|-\n| {num()}\n|}}', lambda: f"{some()} [https://a.example/{num()} {some()}]", lambda: f";; [[{some()}]]\n** [[{some()}]]\n## [[{some()}]]",
            lambda: f"{some()} \\{cmd()}{{{some()}}} {some()}", lambda: f"\\{cmd()}*{{{some()}}}", lambda: f"\\noindent {some()}", lambda: f"{some()}~\\cite{{{some(1, 1)}{num()}}}.", lambda: f"{some()} (see~\\ref{{fig:{some(1, 1)}}}).", lambda: f"{some()}.\\footnote{{{some()}.}}", lambda: f"{some()} {{\\it {some()}}} {some()}", lambda: f"{some()} \\textsc {{{some()}}} {some()}",
            lambda: f"{some()} {num()}\\% {some()} \\& {some()}.", lambda: f"{some()}.\\\\[2pt]", lambda: f"{some()} \\\\ {some()}", lambda: f"\\begin{{itemize}}\n\\item {some()}\n\\item {some()}\n\\end{{itemize}}", lambda: f"\\begin{{equation}}\nx^{num()} = \\sqrt{{ab}}\n\\end{{equation}}",
            lambda: f"Here ${rnd.choice(['x^2 + y^2 = r^2', 'a_i', chr(92) + 'alpha', 'E_k = ' + chr(92) + 'frac{1}{2}', 'n', 'x = 3'])}$ holds.", lambda: "\\(x^2 + y^2\\)", lambda: "\\[\\sqrt{ab}\\]", lambda: f"$$x^{num()} = y$$", lambda: f"{some()} ``{some()},'' {some()}",
        ])()

    def prose() -> str:
        ocr = lambda c: (w := rnd.choice(["valley", "committee", "workshop", "until", "table"]))[: len(w) // 2] + c + w[len(w) // 2 + 1 :]
        return rnd.choice([
            lambda: f"{some()} below {num()} < {num()} and above {num()} > {num()} {some()}.", lambda: f"{some()} < {some()} > {some()}", lambda: f"a<b and c>d {some()}", lambda: f"{some()} {rnd.choice(['R&D', 'Q&A', 'AT&T', 'B&B', 'Marks & Co'])} {some()}.", lambda: f"Lot #{num()} {some()}", lambda: f"{some()} #{num()}, {some()}",
            lambda: f"The price rose from ${num()} to ${num()} within a year.", lambda: f"{some()} ${num()} and ${num()}, {some()}", lambda: f"It cost ${num()}.", lambda: f"ratio a/b was about 10^{num()} {{see the {some(1, 1)}}}.", lambda: f"{some()} {{{some()}}} {some()}", lambda: f"{num()}^{num()} {some()}",
            lambda: f"The files lay in C:\\{rnd.choice(['scans', 'new', 'item', 'begin', 'part', 'Users'])}\\{rnd.choice(['new', 'old', 'ref', 'label'])} on {some()}.", lambda: f"D:\\{some(1, 1)}\\x{num()}.txt {some()}", lambda: f"A grid of {num()} * {num()} * {num()} cells was used.", lambda: f"{some()} * {some()}", lambda: f"The field {rnd.choice(['scan_page_no', 'user_id', 'a_b_c', 'file_name'])} was empty in {num()} rows.",
            lambda: f"[{num()}] {some()}. {some()}, {num()}.", lambda: f"Their unit is mg/L [{num()}], see page {num()}.", lambda: f"{some()} [{some()}] {some()}", lambda: f"{some()} [sic] {some()}", lambda: f"The {ocr('|')} {some()}", lambda: f"{some()} {ocr('|')}, {some()}", lambda: f"{some()} {ocr('+')} {some()}", lambda: f"{some()} {num()}| {some()}", lambda: f"{some()} ~{num()} {some()}", lambda: f"{some()} approx. ~ {num()}",
            lambda: f"{some()} 'tis {some()} 'twas {some()}", lambda: f"“{some()}” {some()} ‘{some()}’", lambda: f"{some()} = {num()}; x == {num()}", lambda: f"{some()}* {some()}", lambda: f"— {num()} —", lambda: f"{some()} - {some()} - {some()}", lambda: f"{some()} (n = {num()}).", lambda: f"Section {num()}. {some()}", lambda: f"{num()}. {some()}", lambda: f"{num()}) {some()}", lambda: f"{some()} 5'4'' {some()}", lambda: f"{some()} +{num()} {some()}", lambda: f"{some()} {num()} + {num()} = {num()}", lambda: f"[{num()}]", lambda: f"{some()} ^ {some()}", lambda: f"— {some()}",
        ])()

    xs, ys = [], []
    for _ in range(repeats * 60):
        text, spans = rnd.choice(["", f"{some(3, 8)}. "]), []
        for _ in range(rnd.choice([1, 1, 2, 2, 3])):
            good = rnd.random() < 0.6
            body = noted() if good else prose()
            if text and re.match(r"\#|[>=:;*+\-]|\||~~~|```|  -|\d+[.)]|\{\||\[\d+\]:", body) and (good or body[0].isdigit()):
                text += rnd.choice(["\n", "\n\n"])
            spans.append((len(text), len(text) + len(body), float(good)))
            text += body + rnd.choice([". ", " ", "\n", f" {some(2, 5)}. ", f"\n{some(2, 5)}. "])
        roots = parse(text)
        order = flat(roots)
        own = [(j, y) for j, n in enumerate(order) for a, b, y in spans if a <= n.start and n.end <= b and not _inside(n)]
        if own:
            x = features(text, roots, order)
            xs.append(x[[j for j, _ in own]])
            ys.append(np.array([y for _, y in own]))
    return np.concatenate(xs), np.concatenate(ys)


def _inside(n: Node) -> bool:
    up = n.parent
    while up:
        if _keeps(up):
            return True
        up = up.parent
    return False


@functools.cache
def model() -> BoostedTrees:
    return BoostedTrees(rounds=40, depth=5).fit(*_training())


def labelled_all(texts: list[str], trees: BoostedTrees) -> list[list[Node]]:
    """The trees of texts with ``label`` set on what is notation; all nodes are scored at once."""
    roots = [parse(t) for t in texts]
    orders = [flat(r) for r in roots]
    rows = [features(t, r, o) for t, r, o in zip(texts, roots, orders) if o]
    if rows:
        score, at = trees.score(np.concatenate(rows)).tolist(), 0
        for r, o in zip(roots, orders):
            decode(o, score[at : at + len(o)])
            at += len(o)
    return roots


def labelled(text: str, trees: BoostedTrees) -> list[Node]:
    return labelled_all([text], trees)[0]


#: Texts whose nodes are scored together.
BATCH = 512


def _batches(texts: pd.Series):
    for i in range(0, len(texts), BATCH):
        yield [t or "" for t in texts.iloc[i : i + BATCH]]


def families(roots: list[Node]) -> list[str]:
    return sorted({FAMILY[n.kind] for n in flat(roots) if n.label})


_BLOCK = {"p", "div", "table", "tr", "ul", "ol", "section", "article", "body", "center", "blockquote"}
_DROP = {"comment", "template", "attribute", "div", "magic", "footmark", "setext", "tie", "cut_link", "stars", "tick", "newline", "begin", "end", "cut_tag"}


def _render(text: str, nodes: list[Node], a: int, b: int, depth: int = 0) -> str:
    out, at = [], a
    for n in nodes:
        if n.start < at or n.end > b:
            continue
        out.append(text[at : n.start])
        at = n.end
        inner = (lambda n=n: _render(text, n.kids, n.a, n.b, depth + 1)) if n.a >= 0 else (lambda: "")
        if not n.label:
            if n.kind in ("open", "begin"):
                out.append(n.raw)
                if n.kids and n.b < 0:
                    out.append(_render(text, n.kids, n.end, end := n.kids[-1].end, depth + 1))
                    at = max(at, end)
            elif n.kids and n.a >= 0:
                out.append(text[n.start : n.a] + inner() + text[n.b : n.end])
            else:
                out.append(n.raw)
            continue
        if n.kind == "open":
            if n.a >= 0:
                body, at = inner(), max(at, n.b)
            else:
                end = n.kids[-1].end if n.kids else n.end
                body, at = _render(text, n.kids, n.end, end, depth + 1), max(at, end)
            if re.fullmatch("h[1-6]", n.name):
                out.append(f"\n{'#' * int(n.name[1])} {body.strip()}\n")
            elif n.name == "li":
                out.append(f"\n- {body.strip()}\n")
            elif n.name == "pre":
                out.append(f"\n```\n{html.unescape(body).strip(chr(10) + '`')}\n```\n")
            elif n.name == "code":
                out.append(html.unescape(body) if n.parent is not None and n.parent.name == "pre" else f"`{html.unescape(body)}`")
            elif n.name in ("td", "th"):
                out.append(body.strip() + "\t")
            elif n.name == "br":
                out.append("\n")
            else:
                out.append(f"\n{body}\n" if n.name in _BLOCK else body)
        elif n.kind == "begin":
            if n.a >= 0:
                body, at = inner(), max(at, n.b)
                math = n.name.strip("*") in ("equation", "align", "displaymath", "gather")
                out.append(f"\n$${text[n.a:n.b].strip()}$$\n" if math else f"\n```\n{text[n.a:n.b].strip()}\n```\n" if n.name in ("verbatim", "lstlisting") else f"\n{body}\n")
            elif n.kids:
                out.append(_render(text, n.kids, n.end, end := n.kids[-1].end, depth + 1))
                at = max(at, end)
        elif n.kind == "fence":
            out.append(f"\n```\n{text[n.a:n.b]}\n```\n")
        elif n.kind in ("display", "dollar", "paren"):
            out.append(f"$${text[n.a:n.b].strip()}$$" if n.kind == "display" else f"${text[n.a:n.b].strip()}$")
        elif n.kind == "code":
            out.append(f"`{text[n.a:n.b]}`")
        elif n.kind == "entity":
            out.append(html.unescape(html.unescape(n.raw)).replace(" ", " "))
        elif n.kind == "escaped":
            out.append("")
        elif n.kind in ("tex_escape", "md_escape"):
            out.append(n.raw[1])
        elif n.kind == "heading":
            out.append(n.raw.strip() + " ")
        elif n.kind == "wiki_heading":
            out.append(f"\n{'#' * (len(n.raw.strip()) - len(n.raw.strip().lstrip('=')))} {inner()}\n")
        elif n.kind in ("bullet", "task", "wiki_list"):
            out.append("- ")
        elif n.kind == "number":
            out.append(n.raw.strip() + " ")
        elif n.kind == "quote":
            out.append("")
        elif n.kind == "pipe_row":
            cells = [c.strip() for c in n.raw.strip().strip("|").split("|")]
            out.append("" if all(re.fullmatch(r":?-+:?", c) for c in cells) else "\t".join(cells))
        elif n.kind == "wiki_link":
            body = inner()
            out.append("" if re.match(r"(?i)\s*(category|file|image|kategorie|datei)\s*:", body) else body.split("|")[-1])
        elif n.kind == "wiki_table":
            cells = [c.strip() for line in n.raw.split("\n")[1:] if line[:1] in "|!" and line[:2] not in ("|-", "|}") for c in re.split(r"\|\||!!", line[1:])]
            out.append("\n" + "\n".join(cells) + "\n")
        elif n.kind == "command":
            level = {"chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4}.get(n.name)
            body = inner()
            if level:
                out.append(f"\n{'#' * level} {body}\n")
            elif n.name == "item":
                out.append("- ")
            elif n.name == "footnote":
                out.append(f" ({body})")
            elif n.name not in ("cite", "citep", "citet", "ref", "eqref", "label", "pageref", "vspace", "hspace", "noindent"):
                out.append(body)
        elif n.kind == "reference":
            out.append("" if "://" in n.raw else n.raw.split(":", 1)[1].strip())
        elif n.kind in _DROP:
            out.append("")
        elif n.kind == "tex_quote":
            out.append(f"“{inner()}”")
        elif n.kind == "close":
            out.append("")
        else:
            out.append(inner())
    out.append(text[at:b])
    return "".join(out)


def clean(text: str | None, trees: BoostedTrees, roots: list[Node] | None = None) -> str | None:
    """Plain text: headings as ``#`` lines, list items as ``- `` lines, code between fences or
    ticks and formulas between dollar signs, nothing else of the notation."""
    if not text:
        return text
    roots = labelled(text, trees) if roots is None else roots
    deepest = 4 * max((n.depth for n in flat(roots)), default=0) + 1_000
    if deepest > sys.getrecursionlimit():
        sys.setrecursionlimit(deepest)
    s = _render(text, roots, 0, len(text))
    s = re.sub(r"[ \t]+\n", "\n", s)
    return re.sub(r"\n{3,}", "\n\n", s).strip()


def plain_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that should be plain, once each, the last ingested row of each."""
    of = blocks.where(F.col("kind").isin(*PLAIN_KINDS)).where("doc_id is not null and id is not null")
    return of.groupBy("doc_id", "id").agg(F.max(F.struct("ingested_at", "ord", "kind", "text")).alias("b")).select("doc_id", "id", "b.*")


def found(blocks: DataFrame) -> DataFrame:
    """(doc_id, id, markup), a row for each family of notation in a block."""
    trees = model()

    @F.pandas_udf("array<string>")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([families(r) for part in _batches(texts) for r in labelled_all(part, trees)])

    of = spread(blocks.where(F.col("kind").isin(*PLAIN_KINDS)).where(F.col("text").rlike(SIGNS)).select("doc_id", "id", "text"))
    return of.select("doc_id", "id", F.explode(udf("text")).alias("markup")).distinct()


def cleaned(blocks: DataFrame) -> DataFrame:
    """(doc_id, id, kind, text) with the notation resolved; other kinds are left out."""
    trees = model()

    @F.pandas_udf("string")
    def udf(texts: pd.Series) -> pd.Series:
        out = [clean(t, trees, r) for part in _batches(texts) for t, r in zip(part, labelled_all(part, trees))]
        return pd.Series([c if t is not None else None for t, c in zip(texts, out)], dtype=object)

    # Texts are cleaned where they are read, before blocks are gathered by key.
    noted = F.col("text").rlike(SIGNS)
    rows = spread(blocks.where(F.col("kind").isin(*PLAIN_KINDS)).select("doc_id", "id", "ingested_at", "ord", "kind", "text"))
    return plain_blocks(rows.withColumn("text", F.when(noted, udf("text")).otherwise(F.col("text")))).select("doc_id", "id", "kind", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(read(spark, sf_dir, "blocks"))


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(read(spark, sf_dir, "blocks"))


QUERIES = {"p5_found": p5_found, "p5_clean": p5_clean}
ORACLE: dict[str, str] = {}
