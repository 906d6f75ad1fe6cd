"""Problem 9: abusive, hateful or sexual language.

A linear-chain conditional random field tags the tokens of each sentence as offending or
not; forward-backward gives each token's marginal, the best-supported run of tokens gives the
sentence's score and the greatest sentence the document's, with the offsets of what offends.

Tokens are labelled in two rounds: first the phrases of ``abuse_seeds`` and, as inoffensive,
all sentences of documents that reviewers found clean, and with little weight sentences drawn
from documents at large; then the sentences of documents found
abusive are tagged by that first model, or, if it finds none, by what sets a sentence apart
from all clean ones. Reviewers err: a document counts by the majority of its labels and not
at all if they tie. The fit uses at most SAMPLE reviewed documents.

Before tagging, disguises are undone: letters spaced out, repeated, replaced by signs or
masked by stars. Null and blank texts score 0. Text is worked in full, by sentences.
"""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.context import read, spread
from folioflow.llm.abuse_seeds import phrases
from folioflow.llm.cutoff import source_key

#: Reviewed documents that the model is fitted on, at most.
SAMPLE = 3_000
#: Documents whose sentences stand for ordinary language, at most, and sentences of each.
BACKGROUND, SENTENCES = 1_500, 40
THRESHOLD, BITS, WINDOW = 0.5, 18, 4
SIZE = 1 << BITS
_SENTENCE = re.compile(r"[^.!?。！？…\n;；]*(?:\.(?=\w)[^.!?。！？…\n;；]*)*[.!?。！？…\n;；]*[\s\"”»“’)\]]*")
#: A sentence, or a part of a very long one.
_STRETCH = r"[^.!?。！？…\n;；]{1,600}[.!?。！？…;；]*"
_HAN = r"㐀-䶿一-鿿぀-ヿ가-힯"
_TOKEN = re.compile(rf"(?<![^\W_])(?:[^\W\d_{_HAN}](?:[ .\-_*][^\W\d_{_HAN}]){{2,}})(?![^\W_])|[{_HAN}]|[^\W_{_HAN}][\w*@$!€'’]*[^\W_{_HAN}*]|[@$][^\W_{_HAN}]\w+|[^\W_{_HAN}]|[^\w\s]")
_LEET = str.maketrans("013457@$!€", "oieastasie")
_HOMO = str.maketrans("авеокмнрстухіѕјԁ", "abeokmhpctyxisjd")


def plain(token: str) -> str:
    """A token without its disguise."""
    t = unicodedata.normalize("NFKC", token).lower().translate(_HOMO)
    if len(t) > 2 and re.fullmatch(r"\w(?:[ .\-_*]\w)+", t):
        t = re.sub(r"[ .\-_*]", "", t)
    if "*" in t and len(t) > 2:
        return f"*{t[0]}{t[-1]}"
    if re.search(r"[^\W\d_]", t) and re.search(r"[\d@$!€]", t) and not re.fullmatch(r"\d+\w{1,2}", t) and len(t) > 2:
        t = t.translate(_LEET)
    t = re.sub(r"(\w)\1{2,}", r"\1", t)
    t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)) if not re.match(rf"[{_HAN}]", t) else t
    return "0" if t.isdigit() else t


def sentences(text: str) -> list[tuple[int, list[re.Match]]]:
    """Tokens of each sentence, with their places in the text."""
    out = []
    for m in _SENTENCE.finditer(text):
        if m.group().strip():
            toks = list(_TOKEN.finditer(text, m.start(), m.end()))
            if toks:
                out.append((m.start(), toks))
    return out


class Tagger:
    """Two labels; hashed weights of words around a token, pairs and parts of words."""

    OFFSETS = (-2, -1, 0, 1, 2)

    def __init__(self):
        self.w = np.zeros((2, SIZE), dtype=np.float32)
        self.trans = np.zeros((2, 2), dtype=np.float64)
        self._ids: dict[str, tuple[int, np.ndarray]] = {}
        self._words: dict[str, str] = {}

    def word(self, raw: str) -> str:
        got = self._words.get(raw)
        if got is None:
            if len(self._words) > 300_000:
                self._words.clear()
            got = self._words[raw] = plain(raw)
        return got

    def ids(self, word: str) -> tuple[int, np.ndarray]:
        got = self._ids.get(word)
        if got is None:
            padded = f"<{word}>"
            parts = {padded[i : i + n] for n in (3, 4, 5) for i in range(len(padded) - n + 1)} if len(word) > 3 else set()
            got = (zlib.crc32(word.encode()), np.array(sorted(zlib.crc32(b"p" + p.encode()) % SIZE for p in parts), dtype=np.int64))
            if len(self._ids) > 300_000:
                self._ids.clear()
            self._ids[word] = got
        return got

    def encode(self, batch: list[list[str]]):
        """(features of every token as hashes, parts as (token, hash), lengths)."""
        lengths = np.array([len(s) for s in batch])
        flat = [self.ids(w) for s in batch for w in s]
        h = np.array([x[0] for x in flat], dtype=np.uint64)
        n = len(h)
        start = np.repeat(np.cumsum(lengths) - lengths, lengths)
        end = start + np.repeat(lengths, lengths)
        at = np.arange(n)
        around = []
        for o in self.OFFSETS:
            j = at + o
            ok = (j >= start) & (j < end)
            around.append(np.where(ok, h[np.clip(j, 0, max(0, n - 1))], np.uint64(7 + (o > 0))))
        mix = lambda a, b, s: ((a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(s)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)) & np.uint64(SIZE - 1)
        with np.errstate(over="ignore"):
            zero = np.zeros(n, dtype=np.uint64)
            f = [mix(a, zero, 11 + i) for i, a in enumerate(around)]
            f += [mix(around[1], around[2], 31), mix(around[2], around[3], 32), mix(around[0], around[1], 33), mix(around[3], around[4], 34), mix(mix(around[1], around[2], 35), around[3], 36)]
        parts = np.concatenate([x[1] for x in flat]) if flat else np.zeros(0, dtype=np.int64)
        owner = np.repeat(at, [len(x[1]) for x in flat]) if flat else np.zeros(0, dtype=np.int64)
        return np.stack(f, axis=1).astype(np.int64), owner, parts, lengths

    @staticmethod
    def _small(enc):
        f, owner, parts, lengths = enc
        return f.astype(np.int32), owner.astype(np.int32), parts.astype(np.int32), lengths

    def emissions(self, enc) -> np.ndarray:
        f, owner, parts, _ = enc
        d = self.w[1] - self.w[0]
        e = d[f].sum(axis=1)
        counts = np.maximum(np.bincount(owner, minlength=len(f)), 1)
        e = e + np.bincount(owner, d[parts], minlength=len(f)) / counts * 3
        return np.stack([np.zeros(len(f)), e], axis=1)

    def marginals(self, enc, e: np.ndarray | None = None):
        """P(label) for each token, by forward-backward over all sentences at once."""
        e = self.emissions(enc) if e is None else e
        lengths = enc[3]
        order = np.argsort(-lengths, kind="stable")
        start = (np.cumsum(lengths) - lengths)[order]
        ls = lengths[order]
        most = int(ls[0]) if len(ls) else 0
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        pair = np.zeros((2, 2))
        live = [int((ls > t).sum()) for t in range(most)]
        alpha[start] = e[start]
        for t in range(1, most):
            at = start[: live[t]] + t
            p = alpha[at - 1][:, :, None] + self.trans[None]
            top = p.max(axis=1)
            alpha[at] = e[at] + top + np.log(np.exp(p - top[:, None]).sum(axis=1))
        last = start + ls - 1
        z = np.logaddexp(alpha[last, 0], alpha[last, 1])
        for t in range(most - 2, -1, -1):
            at = start[: live[t + 1]] + t
            q = self.trans[None] + (e[at + 1] + beta[at + 1])[:, None, :]
            top = q.max(axis=2)
            beta[at] = top + np.log(np.exp(q - top[:, :, None]).sum(axis=2))
            pair += np.exp(alpha[at][:, :, None] + q - z[: live[t + 1], None, None]).sum(axis=0)
        zs = np.empty(len(lengths))
        zs[order] = z
        return np.exp(alpha + beta - np.repeat(zs, lengths)[:, None]), pair

    def fit(self, batch: list[list[str]], labels: list[np.ndarray], weight: list[float], epochs: int = 12, rate: float = 0.25, l2: float = 2e-5, seed: int = 2) -> "Tagger":
        """AdaGrad on the conditional likelihood."""
        rnd = np.random.default_rng(seed)
        grad2, t2 = np.full((2, SIZE), 1e-4, dtype=np.float32), np.full((2, 2), 1e-2)
        # Batches are put together once and encoded once; only their order changes.
        order = rnd.permutation(len(batch))
        picks = [order[c : c + 256] for c in range(0, len(order), 256)]
        encoded = [self._small(self.encode([batch[i] for i in pick])) for pick in picks]
        for _ in range(epochs):
            for c in rnd.permutation(len(picks)):
                pick, enc = picks[c], encoded[c]
                f, owner, parts, lengths = enc
                m, pair = self.marginals(enc)
                y = np.concatenate([labels[i] for i in pick])
                wt = np.repeat([weight[i] for i in pick], lengths)
                d = (m[:, 1] - y) * wt
                g = np.bincount(f.ravel(), np.repeat(d, f.shape[1]), minlength=SIZE)
                counts = np.maximum(np.bincount(owner, minlength=len(f)), 1)
                g += np.bincount(parts, (d / counts * 3)[owner], minlength=SIZE)
                for k, sign in ((1, 1.0), (0, -1.0)):
                    gk = (sign * g + l2 * len(pick) * self.w[k]).astype(np.float32)
                    grad2[k] += gk**2
                    self.w[k] -= rate * gk / np.sqrt(grad2[k])
                gold = np.zeros((2, 2))
                inner = np.ones(len(y), dtype=bool)
                inner[np.cumsum(lengths) - 1] = False
                j = np.nonzero(inner)[0]
                np.add.at(gold, (y[j].astype(int), y[j + 1].astype(int)), 1)
                gt = pair - gold
                t2 += gt**2
                self.trans -= 0.1 * gt / np.sqrt(t2)
        return self

    def scored(self, texts: list[str]) -> list[tuple[float, list[tuple[int, int]]]]:
        """The score of each text and the offsets of offending runs."""
        owner, batch, toks = [], [], []
        for i, text in enumerate(texts):
            for _, t in sentences(text):
                owner.append(i)
                batch.append([self.word(m.group()) for m in t])
                toks.append(t)
        out: list[tuple[float, list]] = [(0.0, []) for _ in texts]
        if not batch:
            return out
        enc = self.encode(batch)
        p = self.marginals(enc)[0][:, 1]
        at = 0
        for i, t in zip(owner, toks):
            own = p[at : at + len(t)]
            at += len(t)
            k = min(WINDOW, len(own))
            score = float(np.convolve(own, np.ones(k) / k, "valid").max())
            spans = out[i][1]
            if score >= THRESHOLD:
                hot = np.nonzero(own >= THRESHOLD)[0]
                for run in np.split(hot, np.nonzero(np.diff(hot) > 1)[0] + 1):
                    if len(run):
                        spans.append((t[run[0]].start(), t[run[-1]].end()))
            out[i] = (max(out[i][0], score), spans)
        return out


def _masked(words: list[str], rnd: np.random.Generator) -> list[str]:
    """One word masked, as abuse often is."""
    long = [i for i, w in enumerate(words) if len(w) > 4]
    if long and rnd.random() < 0.25:
        i = int(rnd.choice(long))
        words = [*words]
        words[i] = f"*{words[i][0]}{words[i][-1]}"
    return words


def train(clean: list[str], abusive: list[str], ordinary: list[str] = ()) -> Tagger:
    """The tagger from reviewed documents and unreviewed ones, which are mostly inoffensive;
    any list may be empty."""
    t = Tagger()
    words = lambda text: [[t.word(m.group()) for m in toks] for _, toks in sentences(text)]
    rnd = np.random.default_rng(4)
    batch, labels, weight = [], [], []

    def add(s: list[str], y: int | np.ndarray, w: float) -> None:
        batch.append(s)
        labels.append(np.full(len(s), float(y)) if np.isscalar(y) else y)
        weight.append(w)

    for text, y in phrases():
        s = [w for x in words(text) for w in x]
        add(_masked(s, rnd) if y else s, y, 1.0)
    seen: Counter = Counter()
    for text in clean:
        for s in words(text):
            seen[tuple(s)] += 1
    grams: Counter = Counter()
    for s in seen:
        grams.update(set(zip(("^", *s), s)))
    for s in seen:
        add(list(s), 0, 1.0)
    for text in abusive:  # ordinary sentences of abusive documents, known from clean ones
        for s in words(text):
            if all(grams[g] > 2 for g in zip(("^", *s), s)):
                add(s, 0, 1.0)
    plainly, others = len(batch), {tuple(s) for text in ordinary for s in words(text)} - set(seen)
    for s in sorted(others):
        add(list(s), 0, 0.1)
    t.fit(batch, labels, weight, epochs=5)
    del batch[plainly:], labels[plainly:], weight[plainly:]
    others = sorted(others)
    for i in range(0, len(others), 2000):
        part = others[i : i + 2000]
        p, at = t.marginals(t.encode([list(s) for s in part]))[0][:, 1], 0
        for s in part:
            if p[at : at + len(s)].max() < 0.4:
                add(list(s), 0, 0.5)
                grams.update(set(zip(("^", *s), s)))
            at += len(s)
    new: Counter = Counter()
    for text in abusive:
        own = words(text)
        if not own:
            continue
        p, _ = t.marginals(t.encode(own))
        at, hits, odd = 0, [], []
        for s in own:
            m = p[at : at + len(s), 1]
            at += len(s)
            if len(s) > 1 and np.sort(m)[-min(WINDOW, len(m)) :].mean() >= THRESHOLD:
                hits.append((s, m))
            odd.append((sum(grams[g] == 0 for g in zip(("^", *s), s)) / (len(s) + 1) if m.max() > 0.1 else 0.0, len(s), s))
        for s, m in hits:
            new[tuple(s)] += 1
        if not hits and clean:
            share, n, s = max(odd, key=lambda x: x[0] * min(x[1], 12))
            if share > 0.6 and n > 3:
                new[tuple(s)] += 1
    for s, _ in new.items():
        if tuple(s) not in seen:
            add(list(s), 1, 1.0)
            add(_masked(list(s), rnd), 1, 0.5)
    second = Tagger()
    second.fit(batch, labels, weight, epochs=7)
    return second


def reviewed(documents: DataFrame, labels: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """At most SAMPLE reviewed texts, chosen by hash of their id, clean ones and abusive ones;
    and of at most BACKGROUND texts of any length at most SENTENCES stretches each, chosen by
    hash, but for those of abusive ones."""
    votes = labels.where("abusive is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("abusive").alias("y")).where("y <> 0.5")
    few = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(few), "doc_id").orderBy("doc_id").collect()
    clean, abusive = [r.text for r in rows if r.y < 0.5], [r.text for r in rows if r.y > 0.5]
    some = documents.where("text is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(BACKGROUND)
    drawn = F.transform(F.regexp_extract_all("text", F.lit(_STRETCH), F.lit(0)), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("s")))
    rest = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id").select("doc_id", F.slice(F.array_sort(drawn), 1, SENTENCES).alias("d")).orderBy("doc_id").collect()
    bad = set(abusive)
    return clean, abusive, [x.s for r in rest for x in r.d if not any(x.s in t for t in bad)]


_FITTED: dict[bytes, Tagger] = {}


def fitted(documents: DataFrame, labels: DataFrame) -> Tagger:
    """The tagger of these tables; what was fitted on the same texts is not fitted again."""
    texts = reviewed(documents, labels)
    key = hashlib.sha256(repr(texts).encode("utf-8", "surrogatepass")).digest()
    if key not in _FITTED:
        _FITTED.clear()
        _FITTED[key] = train(*texts)
    return _FITTED[key]


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, spans) of every document; ``spans`` are offending offsets."""
    tagger = fitted(documents, labels)
    weights, trans = tagger.w.astype(np.float32), tagger.trans
    tag = F.pandas_udf(_iterating(weights, trans), "score double, spans array<struct<start:int,end:int>>")
    return spread(documents.where("doc_id is not null").select("doc_id", "source", "text")).select("doc_id", "source", tag("text").alias("r")).select("doc_id", "source", "r.score", "r.spans")


def _iterating(weights: np.ndarray, trans: np.ndarray):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = Tagger()
        t.w, t.trans = weights, trans
        for s in batches:
            out = []
            for i in range(0, len(s), 500):
                out += t.scored([x or "" for x in s.iloc[i : i + 500]])
            yield pd.DataFrame({"score": [round(a, 6) for a, _ in out], "spans": [[{"start": x, "end": y} for x, y in b] for _, b in out]})
    return run


def by_source(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, n_documents, n_abusive, rate, mean_score)."""
    hit = F.col("score") >= threshold
    s = scores.groupBy(source_key(F.col("source")).alias("source"))
    return s.agg(F.count("*").alias("n_documents"), F.count_if(hit).alias("n_abusive"), F.round(F.count_if(hit) / F.count("*"), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "review_labels"))
    return s.where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "review_labels")).select("doc_id", "score", "spans")


def p9_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_source(scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "review_labels")))


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_by_source": p9_by_source}
ORACLE: dict[str, str] = {}
