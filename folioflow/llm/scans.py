"""Problem 1: noise in text from scanned pages.

Two averaged perceptrons, trained here, do the work. One reads lines and says which are
furniture (running headers and footers, page numbers) from their place on the page and in
the block, their length and form, their recurrence in the book and whether their number is
the page's. The other edits words character by character: at each place it keeps, replaces,
deletes or inserts a character, and where a line ends in a hyphen it joins the lines or
not. Its evidence is the characters around the place and how often the edited word and the
word itself occur.

What is corpus-wide: the counts of all words of all blocks, kept as a table (words meet the
spellings their edits lead to by joins on those spellings, so that no lexicon is cut or
sent about), and the counts of all combinations of line features, over which the perceptron
of lines is trained. What is sampled: the SAMPLE_WORDS most frequent words, into which the
training of the editor puts confusions, so that its examples are labelled by how they were made.

A run of more than LONGEST letters and digits is no word. Null and empty texts bear no noise;
blocks without a page or box, or with a box that is no finite rectangle, are judged by
recurrence alone; repeated rows of a block count once; a block without doc_id or id is left
out. Further columns are ignored.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.context import checkpoint, read, replicated, salted, spread
from folioflow.llm.markup import PLAIN_KINDS

#: Longer runs of letters and digits are no words.
LONGEST = 1_000
#: A word is frequent from 1/FREQUENT of all occurrences, so that there are no more than FREQUENT such words.
FREQUENT, SAMPLE_WORDS = 100_000, 6_000
#: To so many examples the counts of line signatures are scaled for training.
EXAMPLES = 20_000
#: How many times as frequent a word must be to speak against another spelling; to do so though it is
#: not frequent, or against one that is.
TIMES, MANY_TIMES = 8, 30

#: What recognition writes, and what was printed.
CONFUSIONS = {
    "0": ["o"], "1": ["l", "i"], "5": ["s"], "6": ["b"], "8": ["b"], "9": ["g"], "!": ["l", "i"], "|": ["l", "i"], "@": ["a"], "€": ["e"], "+": ["t"], "$": ["s"],
    "c": ["e"], "e": ["c"], "b": ["h"], "h": ["b", "li"], "l": ["i", "t"], "i": ["l"], "n": ["u"], "u": ["n"], "f": ["t"], "t": ["f"], "o": ["c"], "m": ["rn", "in", "nn"], "d": ["cl"], "w": ["vv"],
    "rn": ["m"], "vv": ["w"], "ii": ["u", "n"], "cl": ["d"], "li": ["h"], "nn": ["m"], "iii": ["m"], "tl": ["d"],
}
#: Words after which a hyphen is suspended.
SUSPENDING = set("and or to nor und oder bis sowie et ou y o e u".split())
HYPHENS = "-‐‑‒­¬⁃﹣－⸗"
_SYMBOLS = set("0123456789!|@€+$")
#: In words of so few letters no letter is deleted, and none inserted that makes no longer one.
SHORT = 4
_TOKEN = re.compile(r"(?:[^\W_]|[!|@€+$̀-ͯ])+")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_NOTATION = re.compile(r"\[\[[^\]|\n]*\||<[^<>\n]*>|&[#\w]+;|https?://\S+|\$[^$\n]+\$|\\[A-Za-z]+(?:\{[^{}\n]*\})?|\\\(.*?\\\)|\{\{[^{}]*\}\}|\{\|[\s\S]*?\|\}|\{[^{}\n]*\}|^[ \t]*```[\s\S]*?```|^[ \t]*~~~[\s\S]*?~~~|^[|!][^\n]*|^[ \t]*[-+*][ \t]", re.M)
_BREAK = re.compile(rf"([^\W\d_]+)([{HYPHENS}])(?:([ \t]*\r?(?:\n|\Z)\s*)|[ \t]+(?=[^\W\d_]))(?=([^\W\d_]*))", re.UNICODE)


class Perceptron:
    """Averaged, over string features; labels may be restricted for each example."""

    def __init__(self):
        self.w: dict = defaultdict(float)

    def score(self, feats: list[str]) -> float:
        w = self.w
        return sum(w.get(f, 0.0) for f in feats)

    def best(self, options: list[tuple[str, list[str]]]) -> str:
        return max(options, key=lambda o: self.score(o[1]))[0]

    def fit(self, examples: list[tuple[list[tuple[str, list[str]]], str]], epochs: int = 4, seed: int = 1) -> Perceptron:
        total, w, n, rnd = defaultdict(float), self.w, 0, random.Random(seed)
        examples = list(examples)
        for _ in range(epochs):
            rnd.shuffle(examples)
            for options, gold in examples:
                n += 1
                got = self.best(options)
                if got != gold:
                    for label, feats in options:
                        d = (label == gold) - (label == got)
                        if d:
                            for f in feats:
                                w[f] += d
                                total[f] += d * n
        self.w = {f: v - total[f] / (n + 1) for f, v in w.items() if v - total[f] / (n + 1)}
        return self


# ---------------------------------------------------------------- characters


def _level(n: float) -> int:
    return 0 if n <= 0 else 1 + min(7, int(math.log2(n + 1) / 2))


class Editor:
    """Edits words; ``counts`` are the words that speak for a spelling, with their counts."""

    def __init__(self, counts: dict[str, float], weights: Perceptron):
        self.counts, self.weights, self.known = counts, weights, {}
        self.shorter: dict[str, list[tuple[int, str]]] = defaultdict(list)
        for word in counts:
            if len(word) > SHORT:
                for i in range(len(word)):
                    if not i or word[i] != word[i - 1]:
                        self.shorter[word[:i] + word[i + 1 :]].append((i, word[i]))

    def _reach(self, word: str, at: int, left: int) -> float:
        """The greatest count of a word that edits from a place on can lead to."""
        n = self.counts.get(word, 0)
        if left and not n:
            for i in range(at, len(word)):
                for size in (1, 2, 3):
                    for right in CONFUSIONS.get(word[i : i + size], ()) if i + size <= len(word) else ():
                        n = max(n, self.counts.get(word[:i] + right + word[i + size :], 0) if left == 1 else self._reach(word[:i] + right + word[i + size :], i + 1, left - 1))
        return n

    def options(self, word: str, i: int, own: float) -> list[tuple[str, str, int, list[str]]]:
        """(label, replacement, length replaced, features) of what can be done at a place."""
        a, b = (word[i - 1] if i else "^"), (word[i] if i < len(word) else "$")
        c, d = (word[i + 1] if i + 1 < len(word) else "$"), (word[i - 2] if i > 1 else "^")
        kind = lambda x: "d" if x.isdigit() else "s" if x in _SYMBOLS else "e" if x in "^$" else "a" if x.isalpha() else "o"
        shape = kind(a) + kind(b) + kind(c)
        digits = sum(x.isdigit() for x in word)
        letters = sum(x.isalpha() for x in word)
        mix = f"{min(digits, 3)}{min(letters, 4)}"
        odd = f"{min(digits, 6)}{min(letters // 4, 6)}"
        out = [("keep", b if i < len(word) else "", 1, [f"k:own{_level(own)}", f"k:{shape}", f"k:{shape}{mix}", f"k:{b}", f"k:own{bool(own)}{shape}{mix}", f"k:odd{odd}{bool(own)}"])]

        def option(op: str, right: str, size: int, got: float) -> tuple[str, str, int, list[str]]:
            gain = f"{_level(got)}"
            ratio = min(6, int(math.log2(got / own))) if got and own and got > own else 0 if own else 9
            y = word[i + size] if i + size < len(word) else "$"
            return (op, right, size, [
                f"e:gain{gain}", f"e:{bool(own)}{gain}", f"e:ratio{bool(got)}{ratio}", f"e:{op}", f"e:{shape}", f"e:{shape}{mix}{bool(got)}", f"e:{op}{bool(got)}", f"e:len{min(len(word), 5)}{bool(got)}{bool(own)}",
                f"e:{a}{op}", f"e:{op}{y}", f"e:{d}{a}{op}", f"e:{size}{len(right)}{bool(got)}", f"e:{shape}{bool(got)}{bool(own)}", f"e:first{i == 0}{bool(got)}", f"e:last{i + size >= len(word)}{size > len(right)}{size < len(right)}",
            ])

        for size in (1, 2, 3):
            wrong = word[i : i + size]
            for right in CONFUSIONS.get(wrong, ()) if len(wrong) == size else ():
                got = self._reach(word[:i] + right + word[i + size :], i + len(right), 1 if len(word) > 3 else 0) if self.counts else 0
                out.append(option(f"{wrong}>{right}", right, size, got))
        if len(word) >= SHORT and word.isalpha():
            if i < len(word) and (not i or b != a) and len(word) > SHORT and (got := self.counts.get(word[:i] + word[i + 1 :], 0)):
                out.append(option("delete", "", 1, got))
            for at, x in self.shorter.get(word, ()):
                if at == i:
                    out.append(option(f"insert {x}", x, 0, self.counts[word[:i] + x + word[i:]]))
        return out

    def edit(self, word: str) -> str:
        """The word as it was printed, by the editor's best guess; lower case in and out."""
        got = self.known.get(word)
        if got is None:
            got, i = word, 0
            while i <= len(got):
                options = self.options(got, i, self.counts.get(got, 0))
                if len(options) > 1:
                    label, right, size, _ = max(options, key=lambda o: self.weights.score(o[3]))
                    if label != "keep":
                        got, i = got[:i] + right + got[i + size :], i + max(len(right), 1)
                        continue
                i += 1
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = got
        return got

    def breaks(self, before: str, hyphen: str, ending: str | None, after: str) -> list[tuple[str, list[str]]]:
        """What can be done at a hyphen: join without it, join with it, or leave it."""
        a, b = before.lower(), after.lower()
        place = "blank" if ending is None else "end" if not after else "line"
        whole, own = _level(self.counts.get(a + b, 0)), _level(self.counts.get(b, 0))
        feats = [f"{place}", f"{place}{hyphen == '-'}", f"susp{b in SUSPENDING}{hyphen == '-'}", f"whole{whole}", f"own{bool(own)}{bool(whole)}", f"upper{after[:1].isupper()}", f"left{bool(self.counts.get(a))}{bool(whole)}", f"susp{b in SUSPENDING}{place}", f"susp{b in SUSPENDING}{bool(whole)}"]
        return [(label, [f"{label}:{f}" for f in feats]) for label in ("join", "hyphen", "leave")]

    def label(self, before: str, hyphen: str, ending: str | None, after: str) -> str:
        return self.weights.best(self.breaks(before, hyphen, ending, after))


class Decided:
    """What was decided for the forms of one block, in the place of an editor."""

    def __init__(self, fixes: dict[str, str]):
        self.fixes, self.counts = fixes, {}

    def edit(self, word: str) -> str:
        return self.fixes.get(word, word)

    def label(self, before: str, hyphen: str, ending: str | None, after: str) -> str:
        return self.fixes.get(break_form(before, hyphen, ending, after), "leave")


def _noisy(word: str, rnd: random.Random, inverse: dict[str, list[str]]) -> tuple[str, dict[int, str]]:
    """A word with noise put in, and by place what undoes it."""
    places = [i for i in range(len(word)) if any(word.startswith(r, i) for r in inverse)]
    chosen = set(rnd.sample(places, min(rnd.choice([0, 1, 1, 2]), len(places))))
    symbol, other = rnd.random() < 0.5, rnd.random() if len(word) > SHORT + 1 and word.isalpha() else 1.0
    if other < 0.1:  # one letter lost, or one too many
        i = rnd.randrange(1, len(word) - 1)
        if other < 0.05:
            return (word[:i] + word[i + 1 :], {i: f"insert {word[i]}"}) if word[i] not in (word[i - 1], word[i + 1]) else (word, {})
        x = rnd.choice("abcdefghilmnoprstu")
        return (word[:i] + x + word[i:], {i: "delete"}) if x not in (word[i - 1], word[i]) else (word, {})
    gold, noisy, at = {}, "", 0
    while at < len(word):
        if at in chosen:
            right = rnd.choice([r for r in inverse if word.startswith(r, at)])
            wrong = rnd.choice([x for x in inverse[right] if x in _SYMBOLS] or inverse[right] if symbol else inverse[right])
            gold[len(noisy)] = f"{wrong}>{right}"
            noisy, at = noisy + wrong, at + len(right)
        else:
            noisy, at = noisy + word[at], at + 1
    return noisy, gold


def train_editor(counts: dict[str, float], words: list[str], seed: int = 3) -> Perceptron:
    """Learns from words as they are and with confusions, losses and additions put in."""
    rnd = random.Random(seed)
    inverse: dict[str, list[str]] = defaultdict(list)
    for wrong, rights in CONFUSIONS.items():
        for right in rights:
            inverse[right].append(wrong)
    p, examples = Perceptron(), []
    hidden = {w for w in words if rnd.random() < 0.25}
    editor = Editor({w: n for w, n in counts.items() if w not in hidden}, p)
    for word in words:
        for _ in range(2):
            noisy, gold = _noisy(word, rnd, inverse)
            if gold and editor.counts.get(noisy, 0) > 0:
                continue
            if word in hidden and any(x[0] not in _SYMBOLS or x[1] != ">" for x in gold.values()):
                continue
            own, i, shift = noisy, 0, 0
            while i <= len(own):
                options = editor.options(own, i, editor.counts.get(own, 0))
                label = gold.get(i - shift, "keep")
                there = next((o for o in options if o[0] == label), None)
                if len(options) > 1 and there:
                    examples.append(([(o[0], o[3]) for o in options], label))
                if label != "keep" and there:
                    own, i, shift = own[:i] + there[1] + own[i + there[2] :], i + max(len(there[1]), 1), shift + len(there[1]) - there[2]
                    if label == "delete":
                        i -= 1
                    continue
                i += 1
    mixed = ["h2o", "b12", "a4", "10th", "2nd", "1st", "3rd", "x1", "co2", "40k", "v2", "mp3", "4b", "12c", "20th", "1990s", "a+b", "no!", "yes!", "wow!", "stop!", "c+", "p1", "fig1", "x2", "e5", "b2b"]
    for word in mixed * 8:
        for i in range(len(word)):
            options = editor.options(word, i, 0)
            if len(options) > 1:
                examples.append(([(o[0], o[3]) for o in options], "keep"))
    for _ in range(600):  # digests, keys and numbers of parts are no words
        code = "".join(rnd.choice(rnd.choice(["0123456789abcdef", "0123456789", "abcdefghijklmnopqrstuvwxyz0123456789"])) for _ in range(rnd.choice([4, 6, 8, 12, 16, 32, 40, 64])))
        for i in rnd.sample(range(len(code)), min(4, len(code))):
            options = editor.options(code, i, 0)
            if len(options) > 1:
                examples.append(([(o[0], o[3]) for o in options], "keep"))
    for letter in "abcdefghijklmnopqrstuvwxyz" * 4:  # a letter alone is a name of something
        options = editor.options(letter, 0, rnd.choice([0, 1, 30]))
        if len(options) > 1:
            examples.append(([(o[0], o[3]) for o in options], "keep"))
    pool = [w for w in words[:3000] if len(w) > 4 and w.isalpha()]
    for word in pool * max(1, 600 // max(1, len(pool))):  # another ending is no misreading
        for other in (word + rnd.choice("sdenry"), word[:-1]):
            if editor.counts.get(word, 0) and not editor.counts.get(other, 0):
                for i in range(len(other) - 2, len(other) + 1):
                    options = editor.options(other, i, 0)
                    if len(options) > 1:
                        examples.append(([(o[0], o[3]) for o in options], "keep"))
    for word in pool * max(1, 600 // max(1, len(pool))):
        cut, other = rnd.randint(2, len(word) - 2), rnd.choice(words)
        h = rnd.choice(HYPHENS[:6])
        place = rnd.choice(["\n", "\n", None])
        examples.append((editor.breaks(word[:cut], h, place, word[cut:]), "join"))
        examples.append((editor.breaks(word[:cut], h, "\n", ""), "join"))
        if rnd.random() < 0.3:
            examples.append((editor.breaks(word, "-", rnd.choice(["\n", None, None]), rnd.choice(sorted(SUSPENDING))), "leave"))
            examples.append((editor.breaks(word, "-", "\n", other), "hyphen"))
            examples.append((editor.breaks(word.title(), "-", "\n", other.title()), "hyphen"))
    return p.fit(examples)


def repair(text: str | None, editor: Editor | Decided, drop: list[int] | None = None) -> tuple[bool, bool, str | None]:
    """(a word is broken by a hyphen, a character is misread, the text repaired).

    ``drop`` are numbers of lines that are furniture."""
    if not text:
        return False, False, text
    source = text
    if drop:
        lines = text.split("\n")
        source = "\n".join(x for i, x in enumerate(lines) if i not in set(drop))
    hyphen = False
    out, at = [], 0
    for text_now in (text, source) if drop else (source,):
        out, at = [], 0
        for m in _BREAK.finditer(text_now):
            if m.start() < at:
                continue
            label = editor.label(m.group(1), m.group(2), m.group(3), m.group(4))
            if label != "leave":
                hyphen = True
                out.append(text_now[at : m.end(2) if label == "hyphen" or not m.group(4) else m.start(2)])
                at = m.end() if m.group(4) else m.end(2)
        out.append(text_now[at:])
    joined = "".join(out)
    misread = False

    def fix(m: re.Match) -> str:
        nonlocal misread
        word = m.group()
        if len(word) > LONGEST or not _LATIN.search(word):
            return word
        low = word.lower()
        new = editor.edit(low)
        if new == low or low not in editor.counts and _fragment(m, low) and not _SYMBOLS & set(low):
            return word
        misread = True
        return new.upper() if word.isupper() and len(word) > 1 else new[:1].upper() + new[1:] if word[0].isupper() else new

    notation = [m.span() for m in _NOTATION.finditer(joined)]
    pieces, at = [], 0
    for m in _TOKEN.finditer(joined):
        while notation and notation[0][1] <= m.start():
            notation.pop(0)
        if notation and notation[0][0] < m.end():
            continue
        pieces += [joined[at : m.start()], fix(m)]
        at = m.end()
    pieces.append(joined[at:])
    return hyphen, misread, "".join(pieces)


def _fragment(m: re.Match, low: str) -> bool:
    """Part of a word that runs over the start or the end of the block."""
    text = m.string
    return not text[: m.start()].strip() and m.group()[0].islower() or bool(re.match(rf"[{HYPHENS}]?\s*\Z", text[m.end() : m.end() + 8]))


def break_form(before: str, hyphen: str, ending: str | None, after: str) -> str:
    """A word broken by a hyphen as one string: what the editor's decision rests on."""
    place = "blank" if ending is None else "end" if not after else "line"
    return "\x02".join(["", before.lower(), hyphen, place, after[:1].upper() + after[1:].lower() if after[:1].isupper() else after.lower()])


def forms_of(text: str) -> set[str]:
    """The forms a text has: words in lower case, behind \\x03 if they have a capital, words that
    are only asked about (the parts of a broken word and their join) behind \\x01, and broken words."""
    out, spans = set(), []
    for m in _BREAK.finditer(text):
        a, b = m.group(1).lower(), m.group(4).lower()
        out.add(break_form(m.group(1), m.group(2), m.group(3), m.group(4)))
        out.update("\x01" + x for x in (a, b, a + b) if x and len(x) <= LONGEST)
        spans.append((m.start(), m.end() + len(m.group(4))))
    notation = [m.span() for m in _NOTATION.finditer(text)]
    skipped = sorted(spans + notation) if spans and notation else spans or notation
    k, end = 0, 0
    for m in _TOKEN.finditer(text):
        s = m.start()
        while k < len(skipped) and skipped[k][0] < m.end():
            end, k = max(end, skipped[k][1]), k + 1
        if s < end:
            continue
        word = m.group()
        low = word.lower()
        if len(low) <= LONGEST and _LATIN.search(low):
            out.add("\x01" + low if _fragment(m, low) and not _SYMBOLS & set(low) else "\x03" + low if word[0].isupper() else low)
    return out


def _spellings(word: str, of: dict) -> set[str]:
    return {word[:i] + r + word[i + s :] for i in range(len(word)) for s in (1, 2, 3) if i + s <= len(word) for r in of.get(word[i : i + s], ())}


def _shorter(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))} if len(word) > SHORT and word.isalpha() else set()


def neighbours(words: DataFrame) -> DataFrame:
    """(w, n, near): every word that has them with the more frequent words, and their counts,
    that up to two confusions or one letter more or less lead to.

    ``words`` has (w, n). Both sides of the join are spellings one edit away, so that a word
    has some dozens of them and none meets all others."""
    inverse: dict[str, list[str]] = defaultdict(list)
    for wrong, rights in CONFUSIONS.items():
        for right in rights:
            inverse[right].append(wrong)

    def emit(frames):
        for f in frames:
            w, n, k, side = [], [], [], []
            for word, count in zip(f["w"], f["n"]):
                asks = {"a" + word, "c" + word} | {"a" + x for x in _spellings(word, CONFUSIONS)} | {"b" + x for x in _shorter(word)}
                says = {"a" + word, "b" + word} | {"a" + x for x in _spellings(word, inverse)} | {"c" + x for x in _shorter(word)} if count > 1 else ()
                for keys, s in ((asks, 0), (says, 1)):
                    w += [word] * len(keys)
                    n += [count] * len(keys)
                    k += keys
                    side += [s] * len(keys)
            yield pd.DataFrame({"w": w, "n": n, "k": k, "side": side})

    keys = words.select("w", "n").mapInPandas(emit, "w string, n long, k string, side int").select("w", "n", F.xxhash64("k").alias("k"), "side")
    asks, says = keys.where("side = 0"), keys.where("side = 1").select("k", F.col("w").alias("_c"), F.col("n").alias("_m"))
    pairs = asks.join(says, "k").where("_m > n and _c <> w")
    return pairs.groupBy("w", "n").agg(F.collect_set(F.struct(F.col("_c").alias("w"), F.col("_m").alias("n"))).alias("near"))


def beside(each: DataFrame, near: DataFrame, least: float) -> DataFrame:
    """(w, c, beside): for frequent words and those that are ``near`` them, how often the other
    occurs in books for each time the word does there. A misreading stands in books where the
    right word is common; a word of another language or subject need not. As both words are
    frequent, what is sent to the executors is bounded."""
    pairs = checkpoint(near.where(F.col("n") >= least).select("w", F.explode("near").alias("x")).select("w", F.col("x.w").alias("c")))
    words = pairs.select("w").union(pairs.select("c")).distinct()
    spelt = words.select("w", F.explode(F.array("w", F.concat(F.lit("\x01"), "w"), F.concat(F.lit("\x03"), "w"))).alias("form"))
    there = checkpoint(each.select("doc_id", "form").join(F.broadcast(spelt), "form").groupBy("doc_id", "w").agg(F.count("*").alias("k")))
    both = there.join(F.broadcast(pairs), "w").join(there.select("doc_id", F.col("w").alias("c"), F.col("k").alias("_k")), ["doc_id", "c"], "left")
    return both.groupBy("w", "c").agg((F.coalesce(F.sum("_k"), F.lit(0)) / F.sum("k")).alias("beside"))


def own_count(n: int, near: dict[str, int], word: str, total: int) -> dict[str, float]:
    """What speaks for the word and its neighbours, a count a FREQUENT words of text.

    Neighbours do that are TIMES as frequent as the word and either frequent or MANY_TIMES as
    frequent as it, but for those that are misreadings of other neighbours. The word speaks for
    itself if it is frequent and very short or no confusion makes a word MANY_TIMES as frequent
    of it. Of a frequent word only those neighbours are given that are common ``beside`` it."""
    scale = FREQUENT / max(total, 1)
    out = {c: m * scale for c, m in near.items() if m >= TIMES * max(n, 1) and (m * scale >= 1 or m >= MANY_TIMES * max(n, 1))}
    out = {c: max(m, 1.0) for c, m in out.items() if not any(out.get(x, 0) >= MANY_TIMES * m for x in _spellings(c, CONFUSIONS))}
    short = word.isalpha() and len(word) < SHORT
    if n * scale >= 1 and n > 1 and (short or not any(near.get(x, 0) >= MANY_TIMES * n for x in _spellings(word, CONFUSIONS))):
        out[word] = n * scale
    return out


def decided(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forms, bad): forms (doc_id, id, form) of all plain blocks but for frequent words that
    are as they should be; bad (form, hyphen, misread, fix) of all forms with noise. ``fix`` is
    the word repaired, or for a broken word what to do with its hyphen."""
    plain = blocks.where(F.col("kind").isin(*PLAIN_KINDS)).where("text <> '' and doc_id is not null and id is not null")

    @F.pandas_udf("array<string>")
    def forms(texts: pd.Series) -> pd.Series:
        return pd.Series([list(forms_of(t)) for t in texts])

    seen = checkpoint(plain.select("doc_id", "id", forms("text").alias("forms")))
    each = seen.select("doc_id", "id", F.explode("forms").alias("form"))
    asked = F.col("form").startswith("\x01")
    counts = checkpoint(each.groupBy("form").agg(F.count("*").alias("n")))
    words = counts.where(~F.col("form").startswith("\x02")).groupBy(F.regexp_replace("form", "^[\x01\x03]", "").alias("w")).agg(F.sum(F.when(asked, 0).otherwise(F.col("n"))).alias("n"))
    total = counts.where(~F.col("form").startswith("\x02") & ~asked).agg(F.sum("n")).first()[0] or 0
    top = words.where(F.col("n") > 1).orderBy(F.desc("n"), "w").limit(SAMPLE_WORDS).collect()
    scale = FREQUENT / max(total, 1)
    editor = _editor(tuple((r.w, r.n * scale) for r in top), tuple(r.w for r in top if r.w.isalpha() and len(r.w) > 1))
    weights = editor.weights

    @F.pandas_udf("string")
    def fixed(w: pd.Series, n: pd.Series, near: pd.Series) -> pd.Series:
        out = []
        for word, count, them in zip(w, n, near):
            known = own_count(count, {x["w"]: x["n"] for x in them} if them is not None else {}, word, total)
            # A word that speaks for itself is none to repair.
            new = Editor(known, weights).edit(word) if word not in known and (known or _SYMBOLS & set(word)) else word
            out.append(None if new == word else new)
        return pd.Series(out, dtype=object)

    odd = F.col("w").rlike(r"[0-9!|@€+$]")
    near = checkpoint(neighbours(words))
    common = beside(each, near, 1 / scale).where(F.col("beside") >= TIMES).groupBy("w").agg(F.collect_set("c").alias("_common"))
    near = near.join(F.broadcast(common), "w", "left").select("w", "n", F.when(F.col("n") < 1 / scale, F.col("near")).otherwise(F.filter("near", lambda x: F.array_contains(F.coalesce("_common", F.array()), x["w"]))).alias("near"))
    some = near.unionByName(words.where(odd).withColumn("near", F.lit(None).cast("array<struct<w:string,n:bigint>>"))).groupBy("w", "n").agg(F.max("near").alias("near"))
    some = some.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "w")  # few bytes, but much to do with each
    fixes = checkpoint(some.select("w", fixed("w", "n", "near").alias("fix")).where("fix is not null"))

    broken = counts.where(F.col("form").startswith("\x02")).select("form", F.split("form", "\x02").alias("p"))
    roles = F.array(*(F.struct(F.lit(i).alias("role"), w.alias("w")) for i, w in enumerate((F.col("p")[1], F.lower(F.col("p")[4]), F.concat(F.col("p")[1], F.lower(F.col("p")[4]))))))
    parts = broken.select("form", F.explode(roles).alias("r")).select("form", "r.role", "r.w").join(words, "w").join(fixes, "w", "left")
    of = lambda i, c: F.max(F.when(F.col("role") == i, F.col(c))).alias(f"{c}{i}")
    parts = parts.groupBy("form").agg(*(of(i, c) for i in range(3) for c in ("n", "fix")))

    @F.pandas_udf("string")
    def labels(form: pd.Series, n0: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        out = []
        for x, *ns in zip(form, n0, n1, n2):
            _, a, hyphen, place, b = x.split("\x02")
            known = {w: n * scale for w, n in zip((a, b.lower(), a + b.lower()), ns) if n == n and n is not None and n * scale >= 1}
            out.append(Editor(known, weights).label(a, hyphen, None if place == "blank" else "\n", b))
        return pd.Series(out)

    parts = parts.select("form", labels("form", "n0", "n1", "n2").alias("fix"), F.coalesce("fix0", "fix1").isNotNull().alias("part"), F.col("fix2").isNotNull().alias("whole"))
    misread = F.when(F.split("form", "\x02")[4] == "", False).when(F.col("fix") == "join", F.col("whole")).otherwise(F.col("part"))
    parts = parts.select("form", (F.col("fix") != "leave").alias("hyphen"), misread.alias("misread"), "fix")
    # One letter more or less in a word with a capital may as well be another spelling of a name.
    length = F.length("fix") - F.length("w")
    typed = (F.abs(length) == 1) & (F.levenshtein("fix", "w") == 1)
    bad = fixes.select(F.explode(F.array("w", F.concat(F.lit("\x01"), "w"), F.when(~typed, F.concat(F.lit("\x03"), "w")))).alias("form"), "fix").where("form is not null")
    bad = bad.select("form", F.lit(False).alias("hyphen"), (~F.col("form").startswith("\x01")).alias("misread"), "fix")
    bad = checkpoint(bad.unionByName(parts.where("hyphen or misread")))
    frequent = counts.where(F.col("n") >= max(2, math.ceil(total / FREQUENT))).join(bad, "form", "left_anti").select("form")
    return each.join(F.broadcast(frequent), "form", "left_anti"), bad


@functools.cache
def _editor(counts: tuple, words: tuple) -> Editor:
    of = dict(counts)

    def misreading(w: str) -> bool:
        """A frequent misreading must not be learnt as a word."""
        if w.isalpha() and len(w) < SHORT:
            return False
        return any(of.get(x, 0) >= MANY_TIMES * of[w] for x in _spellings(w, CONFUSIONS))

    of = {w: n for w, n in of.items() if not misreading(w)}
    return Editor(of, train_editor(of, [w for w in words if w in of]))


# ---------------------------------------------------------------- furniture

_ROMAN = r"[ivxlcdm]+"
_DASH = r"[—–\-·•~]"
_N = rf"(?:\d{{1,4}}|{_ROMAN})"
_NUMBER_ONLY = rf"(?i)^(?:{_DASH}+\s*{_N}\s*{_DASH}+|\[{_N}\]|\({_N}\)|(?:page|pag\.?|seite|página|p\.|s\.|第)?\s*{_N}(?:\s*(?:of|von|de|sur|/)\s*\d{{1,5}})?\s*[页頁]?)$"


def _roman(n: int) -> str:
    out = ""
    for v, s in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += s * (n // v)
        n %= v
    return out


_TITLE = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(_NUMBER_ONLY)
_PAGE_WORD = re.compile(rf"(?i)(?:page|pag|seite|página|p|of|von|de|sur|s|{_ROMAN})\Z")
LINES = "array<struct<line_no:int,title:bigint,signature:string,header:boolean,page_number:boolean>>"


def line_signature(line: str, line_no: int, n_lines: int, kind: str, page: int | None, flag: bool) -> tuple[str, str, bool, bool]:
    """(title, signature, header, page_number): what the line is called without its numbers,
    signs and case; its features apart from place and recurrence; and what it would be if it
    were furniture. Every feature has a few values, so that there are few signatures."""
    words = _TITLE.findall(line)
    title = " ".join(words).lower()
    number = len(line) <= 40 and bool(_NUMBER.match(line))
    digits = re.findall(r"\d{1,4}", line) if page is not None else ()
    same = page is not None and (any(int(x) == page for x in digits) or number and any(x.lower() == _roman(page) for x in words))
    where = "sole" if n_lines == 1 else "first" if line_no == 0 else "last" if line_no == n_lines - 1 else "mid"
    split = line.split()
    long = [w for w in split if len(w) > 3]
    caps = bool(long) and all(w[0].isupper() for w in long if w[0].isalpha()) and len(split) > 1
    signs = bool(re.search(r"[^\w\s'’,—–-]", line))
    letters = "".join(words)
    upper = sum(c.isupper() for c in letters) > 0.9 * len(letters) if letters else False
    size = "short" if len(line) <= 60 and len(split) <= 9 else "long" if len(line) <= 120 else "prose"
    form = "number" if number else "lower" if line[0].islower() else "ended" if re.search(rf"[{HYPHENS},;:]$|[.!?…][\"”’)]?$", line) else "open"
    what = "number" if number else "title"
    named = any(not _PAGE_WORD.match(w) for w in words)
    place = [what, where, kind if kind in PLAIN_KINDS else "other", *("01"[x] for x in (same, caps, signs, upper, flag, page is not None)), size, form]
    return title, "|".join(place), named and not number, number or bool(re.search(r"^\W*\d{1,4}\b|\b\d{1,4}\W*$", line)) or same


def _box(i: int) -> Column:
    """The upper (2) or lower (4) edge of a block's first box, null unless the box is a finite rectangle."""
    v = lambda k: F.try_element_at(F.col("_r.bbox"), F.lit(k))
    good = (v(2) >= 0) & (v(4) > v(2)) & (v(4) < 1e5)
    return F.when(good, v(i))


def edge_of_pages(b: DataFrame) -> DataFrame:
    """Adds ``height``, the height of the pages of a block's book.

    Of all boxes of the corpus the three hundredths that reach lowest are passed over, so that
    some wild boxes do not matter. A book has a size of its own if its lone page numbers stand
    at another height or its boxes reach further; else the corpus's height is taken, as a book
    of a few short pages does not show its own."""
    corpus = b.agg(F.percentile_approx("y1", 0.97, 1000).alias("h")).first()
    whole = float(corpus.h) if corpus and corpus.h else 1.0
    foot = F.expr("exists(lines, x -> x.signature like 'number|sole|%' and split(x.signature, '[|]')[3] = '1')") & (F.col("y0") > whole * 0.4)
    books = b.groupBy("doc_id").agg(
        *(F.percentile_approx("y1", q, 200).alias(f"_h{round(q * 100)}") for q in (0.9, 0.97)), F.count_if(foot).alias("_n"), F.percentile_approx(F.when(foot, F.col("y1")), 0.5, 200).alias("_f"),
    )
    own = F.when((F.col("_n") >= 3) & (F.col("_f") >= F.col("_h90")), F.col("_f")).when(F.col("_h90") > 1.02 * whole, F.col("_h97")).otherwise(F.lit(whole))
    books = replicated(books.select("doc_id", own.alias("height")), 16)
    return salted(b, 16, "id").join(books, ["doc_id", "_salt"]).drop("_salt")


def lines_of(blocks: DataFrame) -> DataFrame:
    """(doc_id, id, line_no, title, signature, header, page_number, place) of the lines of plain blocks."""
    b = blocks.where("text is not null and text <> '' and doc_id is not null and id is not null").where(F.col("kind").isin(*PLAIN_KINDS))
    b = b.select("doc_id", "id", "kind", "text", F.coalesce("is_running_header", F.lit(False)).alias("flag"), F.try_element_at("source_refs", F.lit(1)).alias("_r"))

    @F.pandas_udf(LINES.replace("title:bigint", "title:string"))
    def lines(text: pd.Series, kind: pd.Series, page: pd.Series, flag: pd.Series) -> pd.Series:
        out = []
        for t, k, p, f in zip(text, kind, page, flag):
            every = t.split("\n")
            p = None if p is None or p != p else int(p)
            rows = [(i, line.strip()) for i, line in enumerate(every)]
            out.append([(i, *line_signature(line, i, len(every), k, p, f)) for i, line in rows if line])
        return pd.Series(out)

    made = b.select("doc_id", "id", _box(2).alias("y0"), _box(4).alias("y1"), lines("text", "kind", "_r.page", "flag").alias("lines"))
    hashed = F.transform("lines", lambda x: F.struct(x["line_no"].alias("line_no"), F.when(x["title"] != "", F.xxhash64(x["title"])).alias("title"), x["signature"].alias("signature"), x["header"].alias("header"), x["page_number"].alias("page_number")))
    made = edge_of_pages(checkpoint(made.withColumn("lines", hashed)))
    place = F.when(F.col("y0").isNull(), "none").when(F.col("y1") <= 0.07 * F.col("height"), "top").when(F.col("y0") >= 0.95 * F.col("height"), "bottom").otherwise("body")
    return made.select("doc_id", "id", place.alias("place"), F.explode("lines").alias("l")).select("doc_id", "id", "place", "l.*")


def with_recurrence(lines: DataFrame) -> DataFrame:
    """Adds to the signature the place and how often the line's title occurs in the book alone
    at page edges or at an unknown place, alone within pages, and inside blocks."""
    sole = F.split("signature", "[|]")[1] == "sole"
    counted = (
        lines.where("title is not null").groupBy("doc_id", "title")
        .agg(
            F.count_if(sole & (F.col("place") != "body")).alias("n_edge"), F.count_if(sole & (F.col("place") == "body")).alias("n_body"),
            F.count_if(~sole).alias("n_inside"),
        ).where("n_edge + n_body > 0 or n_inside > 1")
    )
    lines = lines.join(counted, ["doc_id", "title"], "left")
    level = lambda c, most: F.least(F.lit(most), F.when(F.coalesce(c, F.lit(0)) > 0, F.floor(F.log2(c)) + 1).otherwise(0)).cast("string")
    return lines.withColumn("signature", F.concat_ws("|", "signature", "place", level(F.col("n_edge"), 3), F.least(F.lit(2), F.coalesce("n_body", F.lit(0))).cast("string"), level(F.col("n_inside"), 3)))


def line_features(signature: str, dropped: bool = False, once: bool = False) -> list[str]:
    what, where, kind, same, caps, signs, upper, flag, page, size, form, place, edge, body, inside = signature.split("|")
    if dropped:  # as it would stand inside a block of the page's body
        where, kind, place = "mid", "text", "body"
    if once:
        edge = "0"
    some = edge != "0"
    base = [what, f"place={place}", f"where={where}", f"kind={kind}", f"edge={edge}", f"same={same}", f"upper={upper}", f"flag={flag}", f"page={page}", f"body={body}", f"inside={inside}", f"size={size}", f"form={form}"]
    pairs = [f"{what}&{x}" for x in base[1:]] + [f"{what}&{place}&{where}&{kind}", f"{what}&{where}&edge{edge}", f"{what}&{where}&{kind}&edge{edge}&{place}", f"{what}&{where}&same{same}", f"{what}&{place}&same{same}", f"{what}&{where}&edge{some}&upper{upper}", f"{what}&{where}&edge{some}&same{same}", f"{what}&{where}&{kind}&{place == 'none'}"]
    pairs += [f"{what}&{where}&caps{caps}&signs{signs}&edge{some}", f"{what}&caps{caps}&upper{upper}&signs{signs}&{where}", f"signs={signs}", f"{what}&{size}&{form}", f"{what}&{size}&{form}&edge{some}", f"{what}&{size}&{form}&{where}&{place}", f"{what}&{size}&{form}&caps{caps}&upper{upper}&edge{some}"]
    return base + pairs


def train_lines(counts: list[tuple[str, int]]) -> Perceptron:
    """Labels by plain cases: a short block alone at a page's edge is furniture, a heading alone
    within a page and a line of prose are not. Each furniture line is learnt a second time as
    it would stand inside a block, without its place. ``counts`` are all signatures with how
    many lines have them, in proportion to which they are learnt, each at least once."""
    examples, total = [], sum(n for _, n in counts)
    for signature, n in sorted(counts):
        what, where, kind, same, caps, signs, upper, flag, page, size, form, place, edge, body, inside = signature.split("|")
        alone, number = where == "sole", what == "number"
        if alone and place in ("top", "bottom") and (number or size == "short" and form == "open" or int(edge) > 1):
            gold, twice = "yes", not number or same == "1"
        elif alone and place == "none" and (same == "1" if number else size == "short" and form == "open" and int(edge) > 1):
            gold, twice = "yes", True
        elif alone and place == "body":
            gold, twice = "no", False
        elif not alone and edge == "0" and not (number and page == "1"):
            gold, twice = "no", False
        else:
            continue
        for _ in range(max(1, round(n * EXAMPLES / total))):
            for dropped in (False, True) if twice else (False,):
                f = line_features(signature, dropped)
                examples.append(([("yes", f), ("no", [])], gold))
                if dropped and not number:  # and as if its title occurred nowhere else
                    examples.append(([("yes", line_features(signature, True, True)), ("no", [])], gold))
    stray = "number|mid|text|0|0|0|0|0|1|short|number|body|0|0|0"  # numbers that stand alone on a wrapped line of prose
    examples += [([("yes", line_features(stray)), ("no", [])], "no")] * max(40, len(examples) // 60)
    random.Random(5).shuffle(examples)
    return Perceptron().fit(examples, epochs=6)


def furniture(blocks: DataFrame) -> DataFrame:
    """(doc_id, id, line_no, header, page_number) of the lines that are furniture. The model is
    trained and applied on signatures, of which the number is bounded by their features."""
    lines = checkpoint(with_recurrence(lines_of(blocks)).select("doc_id", "id", "line_no", "signature", "header", "page_number"))
    model = train_lines([tuple(r) for r in lines.groupBy("signature").count().collect()])

    @F.pandas_udf("boolean")
    def judged(signature: pd.Series) -> pd.Series:
        return signature.map({s: model.score(line_features(s)) > 0 for s in signature.unique()})

    return lines.where(judged("signature")).drop("signature")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with the kinds of noise they bear."""
    blocks = spread(read(spark, sf_dir, "blocks").select("doc_id", "id", "kind", "text", "is_running_header", "source_refs"))
    forms, bad = decided(blocks)
    marks = lambda *kinds: F.explode(F.array_compact(F.array(*(F.when(F.col(k), F.lit(k)) for k in kinds)))).alias("noise")
    words = forms.join(bad, "form").select("doc_id", "id", marks("hyphen", "misread"))
    return words.unionByName(furniture(blocks).select("doc_id", "id", marks("header", "page_number"))).distinct()


BUCKET = 512


def paragraphs(blocks: DataFrame) -> DataFrame:
    """(doc_id, start_ord, n_blocks, text): the continuous paragraphs of each book.

    Furniture is left out, words are repaired, and a text block that goes on from the one
    before it (that one has no final punctuation or ends in a hyphen, and this one begins in
    lower case) is joined to it, whatever figures, tables and notes lie between; a heading
    ends a paragraph. Books are worked in stretches of BUCKET positions, between which only
    each stretch's last state is carried, so that a long book is no single task's."""
    drop = furniture(blocks).groupBy("doc_id", "id").agg(F.collect_set("line_no").alias("_drop"))
    one = blocks.where("doc_id is not null and id is not null and kind in ('text', 'heading')").groupBy("doc_id", "id").agg(F.max(F.struct("ingested_at", "ord", "kind", "text")).alias("b"))
    kept = F.expr("array_join(transform(filter(transform(split(b.text, '\\n'), (x, i) -> struct(x, i)), x -> not array_contains(_drop, x.i)), x -> x.x), '\n')")
    one = checkpoint(one.join(drop, ["doc_id", "id"], "left").select("doc_id", "id", "b.ord", "b.kind", F.when(F.col("_drop").isNull(), F.col("b.text")).otherwise(kept).alias("text")))
    forms, bad = decided(one)
    fixes = forms.join(bad, "form").select("doc_id", "id", F.regexp_replace("form", "^[\x01\x03]", "").alias("form"), "fix").groupBy("doc_id", "id").agg(F.collect_set(F.struct("form", "fix")).alias("_fixes"))

    @F.pandas_udf("string")
    def fixed(texts: pd.Series, fixes: pd.Series) -> pd.Series:
        return pd.Series([t if f is None else repair(t, Decided({x["form"]: x["fix"] for x in f}))[2] for t, f in zip(texts, fixes)], dtype=object)

    text = F.regexp_replace(F.regexp_replace(fixed("text", "_fixes"), r"[ \t\r]*(?<!\n)\n(?!\s*\n)[ \t]*", " "), r"^\s+|\s+$", "")
    rows = one.join(fixes, ["doc_id", "id"], "left").select("doc_id", "id", "ord", "kind", text.alias("text")).where("text is not null and text <> ''")
    rows = rows.withColumn("_bucket", F.floor(F.col("ord") / BUCKET))
    open_end = (F.col("kind") == "text") & ~F.col("text").rlike(r"[.!?:;。！？：；…][\"'”’»）)\]]*$")
    goes_on = (F.col("kind") == "text") & F.col("text").rlike(r"^[\p{Ll}]")
    rows = rows.withColumn("_open", open_end).withColumn("_on", goes_on)
    inside, upto = Window.partitionBy("doc_id", "_bucket").orderBy("ord", "id"), Window.partitionBy("doc_id").orderBy("_bucket")
    rows = rows.withColumn("_before", F.lag("_open").over(inside))
    ends = rows.groupBy("doc_id", "_bucket").agg(F.max_by("_open", F.struct("ord", "id")).alias("_last"))
    ends = ends.select("doc_id", "_bucket", F.lag("_last").over(upto).alias("_carried"))
    rows = rows.join(ends, ["doc_id", "_bucket"]).withColumn("_start", ~(F.col("_on") & F.coalesce("_before", "_carried", F.lit(False))))
    rows = rows.withColumn("_at", F.last(F.when(F.col("_start"), F.col("ord")), ignorenulls=True).over(inside))
    starts = rows.groupBy("doc_id", "_bucket").agg(F.max(F.when(F.col("_start"), F.col("ord"))).alias("_s"))
    starts = starts.select("doc_id", "_bucket", F.last("_s", ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, -1)).alias("_from"))
    rows = rows.join(starts, ["doc_id", "_bucket"]).withColumn("start_ord", F.coalesce("_at", "_from", "ord"))
    parts = F.array_sort(F.collect_list(F.struct("ord", "id", "text")))
    broken = lambda x: x["text"].rlike(f"\\p{{L}}[{HYPHENS}]$")
    pieces = F.transform(parts, lambda x, i: F.when(i == F.size(parts) - 1, x["text"]).when(broken(x), F.regexp_replace(x["text"], f"[{HYPHENS}]$", "")).otherwise(F.concat(x["text"], F.lit(" "))))
    joined = F.array_join(pieces, "")
    return rows.groupBy("doc_id", "start_ord").agg(F.count("*").alias("n_blocks"), F.first("kind").alias("kind"), joined.alias("text"))


def p1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(read(spark, sf_dir, "blocks"))


QUERIES = {"p1_found": p1_found, "p1_paragraphs": p1_paragraphs}
ORACLE: dict[str, str] = {}
