"""Problem 2: variant spellings of names typed by people.

Each entry of a book's glossary has the names in ``source`` and ``aliases`` and a rendering in
``target``. Names are cut into tokens without accents, case, titles and legal forms, with
abbreviations written out and nicknames led back to full given names. Entries are blocked by
phonetic codes of their sorted tokens (of one token also with each letter left out, so that a
slip never parts them), by initials and by equal rendering. Within blocks tokens are aligned
and compared by Jaro-Winkler and the nickname table; accepted pairs are clustered by
connected components, entries of other books never meeting.

A name with only an initial joins a full name if their renderings agree, or if all full names
that fit it have one given name; so does a family name behind a title; renderings that differ by more than a sign part names that are
not equal. Equal entries are compared once. Entries without a name or book are their own group;
common nouns (categories term and other, in lower case) are left alone. Null aliases are none.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.context import checkpoint, read
from folioflow.operators.graph import components

#: Given names with their short forms.
NICKNAMES = {
    "alexander": "alex sasha sandy xander lex alec", "augustus": "gus augie august", "charles": "charlie chuck chas charley", "dorothy": "dot dolly dottie dora thea", "edward": "ed eddie ned ted teddy", "elizabeth": "liz betty beth lizzie eliza bess lisa libby",
    "frances": "fanny frankie fran francie", "gabrielle": "gabby elle gabi brielle", "henrietta": "hattie etta hettie henny", "isabella": "bella izzy isa belle", "jonathan": "jon jonny john johnny nathan", "katherine": "kate kitty kathy katie kay kit", "leonard": "len lenny leo",
    "margaret": "maggie peggy meg madge marge daisy greta", "nicholas": "nick klaus nicky nico claus", "oliver": "ollie noll olly", "penelope": "penny nell pen", "rebecca": "becky becca reba", "robert": "rob bob bobby robbie bert", "susannah": "susie sukey sue susan anna",
    "theodore": "theo ted teddy dora", "victoria": "vicky tori vic vicki", "william": "will bill billy willy liam", "zachary": "zach zack zac", "richard": "dick rick rich ricky", "james": "jim jimmy jamie", "thomas": "tom tommy", "henry": "harry hank hal", "anthony": "tony ant", "eleanor": "ellie nora nell nellie",
    "mary": "molly polly mae", "sarah": "sally sadie", "joseph": "joe joey", "samuel": "sam sammy", "benjamin": "ben benny", "daniel": "dan danny", "michael": "mike mick micky", "george": "georgie", "david": "dave davy", "peter": "pete", "stephen": "steve", "matthew": "matt", "andrew": "andy drew", "patricia": "pat patty tricia", "philip": "phil pip", "gregory": "greg", "abigail": "abby gail", "caroline": "carrie caro", "charlotte": "lottie charlie", "emily": "em emmy",
}
#: Forms of address, legal forms, abbreviations and nouns of organisations.
TITLES = set("dr prof professor doctor mr mrs ms miss sir lady lord captain capt sister brother judge father mother master madam rev reverend colonel col major general saint st herr frau monsieur madame señor señora don doña".split())
LEGAL = set("ltd limited inc llc plc gmbh sa corp the of for and".split())
ABBREVIATIONS = {"assn": "association", "assoc": "association", "dept": "department", "dep": "department", "comm": "commission", "soc": "society", "co": "company", "inst": "institute", "fdn": "foundation", "found": "foundation", "univ": "university", "bros": "brothers", "intl": "international", "natl": "national", "govt": "government"}
ORGANISATIONS = set("association department commission society company institute foundation university ministry office bureau board council committee authority press union club league agency bank museum".split())

_FULL: dict[str, frozenset[str]] = {}
for _name, _short in NICKNAMES.items():
    for _s in (_name, *_short.split()):
        _FULL[_s] = _FULL.get(_s, frozenset()) | {_name}


def folded(name: str) -> str:
    t = unicodedata.normalize("NFKD", name).replace("ß", "ss").replace("ø", "o").replace("ł", "l")
    return "".join(c for c in t if not unicodedata.combining(c))


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    hit_a, hit_b = [False] * len(a), [False] * len(b)
    m = 0
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not hit_b[j] and b[j] == c:
                hit_a[i] = hit_b[j] = True
                m += 1
                break
    if not m:
        return 0.0
    x, y = [c for c, h in zip(a, hit_a) if h], [c for c, h in zip(b, hit_b) if h]
    t = sum(p != q for p, q in zip(x, y)) / 2
    j = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    return j + min(prefix, 4) * 0.1 * (1 - j)


def distance(a: str, b: str, most: int = 3) -> int:
    """Edits with neighbours swapped counting as one, up to ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    rows = [list(range(len(b) + 1))]
    for i, c in enumerate(a, 1):
        row = [i]
        for j, d in enumerate(b, 1):
            v = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (c != d))
            if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d:
                v = min(v, rows[-2][j - 2] + 1)
            row.append(v)
        rows.append(row)
    return min(rows[-1][-1], most + 1)


_CODES = str.maketrans("bfpvcgjkqsxzdtlmnrwh", "11112222222233455600")


def phonetic(token: str) -> str:
    """First letter and all consonant classes, without doubles; vowels are left out."""
    t = token.replace("ph", "f").replace("ck", "k").replace("sch", "s")
    codes = "".join(c for c in t[1:].translate(_CODES) if c.isdigit() and c != "0")
    return (t[:1] if t[:1] not in "aeiouy" else "a") + re.sub(r"(.)\1+", r"\1", codes)


@functools.lru_cache(200_000)
def given(token: str) -> frozenset[str]:
    """The full given names a token can stand for, a slip in it allowed."""
    if token in _FULL:
        return _FULL[token]
    if len(token) >= 5:
        near = frozenset(n for n in NICKNAMES if abs(len(n) - len(token)) <= 1 and distance(n, token, 1) <= 1)
        return near
    return frozenset()


class Name:
    """A name's tokens: given names, other words, initials; or an organisation's words."""

    __slots__ = ("raw", "words", "given", "rest", "initials", "org", "acronym", "epithet", "titled", "stubs")

    def __init__(self, raw: str, category: str | None):
        self.raw = raw
        bare = folded(raw).strip()
        tokens = [t for t in re.split(r"[^\w]+", bare) if t]
        self.acronym = tokens[0].lower() if len(tokens) == 1 and tokens[0].isupper() and 2 <= len(tokens[0]) <= 6 else ""
        low = [ABBREVIATIONS.get(t.lower(), t.lower()) for t in tokens]
        self.org = bool(self.acronym) or any(t in ORGANISATIONS for t in low) or category == "organisation"
        self.epithet = bool(low) and low[0] in ("the", "der", "die", "le", "la", "el") and not any(t in ORGANISATIONS for t in low)
        self.titled = not self.org and any(t in TITLES for t in low)
        self.stubs = {t.lower() for t in re.findall(r"(\w{3,5})\.", bare) if t.lower() not in ABBREVIATIONS}
        low = [t for t in low if t not in LEGAL and (self.org or t not in TITLES)]
        self.words = sorted(t for t in low if len(t) > 1 or self.org)
        self.initials = sorted(t for t in low if len(t) == 1) if not self.org else []
        names = [t for t in self.words if given(t)] if not self.org and not self.epithet else []
        # A given name is at most one token; of two, the one that is in the table as it stands.
        names.sort(key=lambda t: (t not in _FULL, t))
        self.given = given(names[0]) if names else frozenset()
        self.rest = [t for t in self.words if not names or t != names[0]] if names else list(self.words)
        if names and not self.rest and len(self.words) > 1:
            self.rest = self.words[1:]

    @property
    def short(self) -> bool:
        """A family name with an initial or a title instead of a given name."""
        return not self.org and not self.epithet and not self.given and len(self.rest) == 1 and (bool(self.initials) or self.titled)

    def keys(self) -> set[str]:
        if self.acronym:
            return {"A" + "".join(sorted(self.acronym))}
        if self.org:
            codes = sorted(phonetic(w) for w in self.words)
            out = {"O" + "|".join(codes)} | {"O" + "|".join(codes[:i] + codes[i + 1 :]) for i in range(len(codes)) if len(codes) > 2}
            if len(self.words) > 2:
                out.add("A" + "".join(sorted(w[0] for w in self.words)))
            if len(self.words) == 2:
                out |= {"O" + "|".join(sorted((phonetic(b), phonetic(a[:i] + a[i + 1 :])))) for a, b in (self.words, self.words[::-1]) for i in range(len(a))}
            return out
        if self.epithet:
            return {"E" + "|".join(sorted(phonetic(w) for w in self.words))} if self.words else set()
        family = " ".join(self.rest)
        if not family:
            return set()
        slips = {phonetic(family)} | {phonetic(family[:i] + family[i + 1 :]) for i in range(len(family))}
        if self.given:
            out = {"P" + "|".join(sorted((phonetic(g), s))) for g in self.given for s in slips}
            return out | {f"I{g}|{s}" for n in self.given for g in (n[0], "") for s in slips}
        if self.short:
            return {f"I{i}|{s}" for i in self.initials or ("",) for s in slips}
        return {"P" + "|".join(sorted(phonetic(w) for w in self.words))} | {"P" + "|".join(sorted(phonetic(w) for j, w in enumerate(self.words) if j != i)) for i in range(len(self.words)) if len(self.words) > 2}


def _near(a: str, b: str) -> bool:
    return a == b or min(len(a), len(b)) > 3 and jaro_winkler(a, b) >= 0.85 and distance(a, b, 1) <= 1


def compare(a: Name, b: Name) -> int:
    """3 equal after normalising, 2 equal but for slips, 1 fits by an initial, 0 neither."""
    if a.acronym or b.acronym:
        if a.acronym and b.acronym:
            return 3 if a.acronym == b.acronym else 0
        x, y = (a, b) if a.acronym else (b, a)
        return 1 if y.org and len(y.words) > 1 and sorted(x.acronym) == sorted(w[0] for w in y.words) else 0
    if a.org != b.org or a.epithet != b.epithet:
        return 0
    if a.org or a.epithet:
        if a.words == b.words:
            return 3 if a.words else 0
        if len(a.words) != len(b.words):
            return 0
        off = 0
        left = list(b.words)
        for w in a.words:
            best = max(left, key=lambda x: jaro_winkler(w, x))
            if w != best:
                # words that are both nouns of organisations are different words
                stub = next((x for x in left if w in a.stubs and x.startswith(w) or x in b.stubs and w.startswith(x)), None)
                best = stub or best
                if not stub and (not _near(w, best) or w in ORGANISATIONS and best in ORGANISATIONS):
                    return 0
                off += not stub
            left.remove(best)
        return 2 if off <= 1 else 0
    if not a.rest or not b.rest:
        return 0
    fa, fb = " ".join(a.rest), " ".join(b.rest)
    if a.given and b.given:
        if not a.given & b.given:
            return 0
        return 3 if fa == fb else 2 if _near(fa, fb) else 0
    if a.short or b.short:
        x, y = (a, b) if a.short else (b, a)
        if not (fa == fb or _near(fa, fb)):
            return 0
        if y.short:
            if not x.initials or not y.initials:
                return 1
            return (3 if fa == fb else 2) if set(x.initials) & set(y.initials) else 0
        return 1 if y.given and (not x.initials or any(g[0] in x.initials for g in y.given)) else 0
    if a.words == b.words and len(a.words) > 1:
        return 3
    if len(a.words) == len(b.words) > 1 and sum(x != y for x, y in zip(a.words, b.words)) == 1 and all(_near(x, y) for x, y in zip(a.words, b.words)):
        return 2
    return 0


def rendering(target: str | None) -> str:
    t = re.sub(r"[\s·・•.\-]+", "", unicodedata.normalize("NFKC", target or "")).lower()
    return re.sub(r"(有限)?公司$", "", t) if len(t) > 4 else t


def judge(names_a: list[Name], names_b: list[Name], target_a: str, target_b: str) -> int:
    """0 not linked, 1 linked if nothing else fits, 2 linked."""
    level = max((compare(x, y) for x, y in product(names_a, names_b)), default=0)
    epithet = any(n.epithet for n in (*names_a, *names_b))
    known = bool(target_a and target_b)
    near = known and (target_a == target_b or min(len(target_a), len(target_b)) > 2 and distance(target_a, target_b, 1) <= 1)
    if epithet and level:  # an epithet is rendered by itself
        return 2 if level > 1 or near else 1
    if level == 3:
        return 2 if not known or near or distance(target_a, target_b, 2) <= 2 else 0
    if level == 2:
        return 2 if near or not known else 0
    if level == 1:
        return 2 if near else 0 if known else 1
    if not known or target_a != target_b:
        return 0
    # One rendering, and names too far apart for a single slip.
    alike = any(
        x.org and y.org and len(target_a) > 4 or x.given & y.given and jaro_winkler(" ".join(x.rest), " ".join(y.rest)) >= 0.85 for x, y in product(names_a, names_b)
    )
    return 2 if epithet or alike else 0


def parsed(source: str | None, aliases, category: str | None) -> list[Name]:
    raw = [x for x in [source, *(aliases if aliases is not None else [])] if x and x.strip()]
    names = [Name(x, category) for x in raw]
    org = any(n.org for n in names)
    return [Name(x, "organisation") if org and not n.org and not n.epithet else n for x, n in zip(raw, names)]


def common_noun(source: str | None, category: str | None) -> bool:
    return not source or category not in ("person", "organisation") and not any(c.isupper() for c in source)


def keyed(glossary: DataFrame) -> DataFrame:
    """(term_key, rep, doc_id, source, aliases, category, target, keys): equal entries of a
    book share the least key of them as their rep; keys only at reps."""
    g = glossary.where("term_key is not null and doc_id is not null").select("term_key", "doc_id", "source", "aliases", "category", "target").dropDuplicates(["term_key"])

    @F.pandas_udf("names array<string>, target string, keys array<string>")
    def parse(source: pd.Series, aliases: pd.Series, category: pd.Series, target: pd.Series) -> pd.DataFrame:
        rows = []
        for s, a, c, t in zip(source, aliases, category, target):
            if common_noun(s, c):
                rows.append(([], "", []))
                continue
            names, shown = parsed(s, a, c), rendering(t)
            keys = set().union(*(n.keys() for n in names)) if names else set()
            if shown:
                keys.add("T" + shown)
            rows.append((sorted({("o:" if n.org else "p:") + n.raw.strip() for n in names}), shown, sorted(keys)))
        return pd.DataFrame(rows, columns=["names", "target", "keys"])

    p = g.select("term_key", "doc_id", parse("source", "aliases", "category", "target").alias("p")).select("term_key", "doc_id", "p.*").where(F.size("names") > 0)
    return p


#: Entries of a block that one task compares with the whole block.
PART = 256


def blocked_pairs(keys: DataFrame, part: int = PART) -> DataFrame:
    """Pairs x, y (x.term_key < y.term_key) of rows (doc_id, term_key, key) that share a block. A
    block of more than ``part`` entries is cut into parts by hash, each of which meets the whole
    block in a task of its own, so that no book and no code is one task's."""
    big = keys.groupBy("doc_id", "key").agg(F.ceil(F.count("*") / part).cast("int").alias("_parts")).where("_parts > 1")
    if big.isEmpty():
        x, y = keys.alias("x"), keys.alias("y")
        return x.join(y, [*(F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("doc_id", "key")), F.col("x.term_key") < F.col("y.term_key")])
    sized = keys.join(big, ["doc_id", "key"], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    x = sized.withColumn("_part", F.pmod(F.xxhash64("term_key"), F.col("_parts")).cast("int")).alias("x")
    y = sized.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("doc_id", "key", "_part")]
    return x.join(y, [*same, F.col("x.term_key") < F.col("y.term_key")])


def linked_pairs(entries: DataFrame) -> DataFrame:
    """(doc_id, a, b, link, given): compared pairs of distinct entries that are linked, or would
    be if nothing else fits (link 1, with the given names of the fuller one)."""
    keys = checkpoint(entries.select("doc_id", "term_key", F.explode("keys").alias("key")))
    pairs = blocked_pairs(keys).select(F.col("x.doc_id").alias("doc_id"), F.col("x.term_key").alias("a"), F.col("y.term_key").alias("b")).distinct()
    side = lambda k: entries.select("doc_id", F.col("term_key").alias(k), F.struct("names", "target").alias("n" + k))
    both = pairs.join(side("a"), ["doc_id", "a"]).join(side("b"), ["doc_id", "b"])

    @F.pandas_udf("link int, short boolean, given string")
    def score(na: pd.Series, ta: pd.Series, nb: pd.Series, tb: pd.Series) -> pd.DataFrame:
        rows = []
        cache: dict[tuple, list[Name]] = {}

        def of(raw) -> list[Name]:
            k = tuple(raw)
            if k not in cache:
                cache[k] = [Name(x[2:], "organisation" if x[0] == "o" else None) for x in k]
            return cache[k]

        for w, x, y, z in zip(na, ta, nb, tb):
            p, q = of(w), of(y)
            link = judge(p, q, x, z)
            short_a = all(n.short or bool(n.acronym) or n.epithet for n in p)
            full = q if short_a else p
            who = sorted({g for n in full for g in n.given} | {" ".join(n.words) for n in full if n.org and not n.acronym})
            rows.append((link, short_a, "|".join(who)))
        return pd.DataFrame(rows, columns=["link", "short", "given"])

    scored = both.select("doc_id", "a", "b", score("na.names", "na.target", "nb.names", "nb.target").alias("s")).select("doc_id", "a", "b", "s.*").where("link > 0")
    return scored


def groups(glossary: DataFrame) -> DataFrame:
    """(term_key, doc_id, root): entries with the least key of the entity they mean."""
    all_ = checkpoint(keyed(glossary))
    same = Window.partitionBy("doc_id", "names", "target")
    with_rep = checkpoint(all_.withColumn("rep", F.min("term_key").over(same)).select("term_key", "doc_id", "rep"))
    reps = all_.join(with_rep.where("rep = term_key").select("term_key"), "term_key")
    links = checkpoint(linked_pairs(reps))
    # A name that fits several people by its initial is no link.
    maybe = links.where("link = 1").select("doc_id", F.when(F.col("short"), F.col("a")).otherwise(F.col("b")).alias("s"), "a", "b", "given")
    sure = maybe.groupBy("s").agg(F.min("given").alias("_lo"), F.max("given").alias("_hi")).where("_lo = _hi").select("s")
    edges = links.where("link = 2").select("a", "b").union(maybe.join(sure, "s", "left_semi").select("a", "b"))
    roots = components(with_rep.where("rep = term_key").select(F.col("term_key").alias("node")), edges)
    return with_rep.join(roots, with_rep.rep == roots.node).select("term_key", "doc_id", "root")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry that is a name, with its group's least term_key and its group's size."""
    g = groups(read(spark, sf_dir, "glossary"))
    return g.join(g.groupBy("root").agg(F.count("*").alias("n_entries")), "root").select("term_key", "doc_id", F.col("root").alias("entity"), "n_entries")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of each group, as the query asks."""
    g = checkpoint(groups(read(spark, sf_dir, "glossary")))
    big = g.join(g.groupBy("root").agg(F.count("*").alias("n")).where("n > 1"), "root")
    a, b = big.select("root", F.col("term_key").alias("term_key_a")), big.select("root", F.col("term_key").alias("term_key_b"))
    return a.join(b, "root").where("term_key_a < term_key_b").select("term_key_a", "term_key_b")


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
ORACLE: dict[str, str] = {}
