"""Toxicity: a linear-chain conditional random field over tokens.

Training. Document labels become token labels: a word or word prefix is an offending cue if it
stands in toxic documents far more often than chance lets it (log-likelihood ratio), near copies
in the sample counting once; tokens of toxic documents that bear a cue are labelled 1, all others
0. The field has two states, weights for word and prefix features, and transition weights, fitted
by maximum likelihood on token windows. A cue need not be clean documents' taboo: a stem that they
hold once by chance and toxic ones many times is one, and the field weighs it.

Scoring. Forward-backward gives each token's marginal. A token that bears no weighted feature has
a constant step matrix, so a gap of k such tokens is that matrix to the power k in closed form:
exact, and whole documents of any length cost little. A document's evidence is the sum of -ln(1 - p)
over its marginals, which is the noisy-or on a scale that does not saturate; a logistic curve over
the logarithms of the evidence and of the number of tokens, fitted to the labels of the same
documents, makes it the score. The offending spans are the tokens with a marginal of at least one half.

Defined cases: null and empty texts and texts without letters score 0 with no spans, whatever their
length; texts without any weighted feature get the curve's value at no evidence; equal texts get equal
scores; repeated rows and rows with a null id are scored each; a column of the result's name gives
way, all others are kept; an empty table gives an empty result; without labels, or with labels of
one class only, no token can offend and every score is 0."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hold, scratch
from .quality import held_out, labelled

TOKEN = re.compile(r"[^\W\d_]+")
#: A cue's share of toxic documents is at least this many times its share of clean ones.
LIFT = 5.0
#: Clean documents for each toxic one in the fit of the score, whatever the sample holds.
CLEAN_ODDS = 8.0
#: Words a worker remembers before it starts anew.
CACHE = 150_000
SPANS = "array<struct<start:int,stop:int,p:double>>"


def features(word: str) -> list[str]:
    """The lower-cased word itself and its prefixes of 3 to 7 characters."""
    w = word.lower()
    return ["=" + w, *("^" + w[:k] for k in range(3, min(7, len(w)) + 1))]


@dataclass
class Field:
    """State scores are 0 and bias + the sum of a token's weights; trans[i][j] scores i followed by j."""

    bias: float = -20.0
    start: float = 0.0
    trans: tuple = ((0.0, 0.0), (0.0, 0.0))
    weights: dict[str, float] = field(default_factory=dict)
    #: constant, factor of ln(1 + evidence) and factor of ln(1 + tokens); without them a score is the noisy-or itself
    curve: tuple[float, float, float] | None = None

    def emission(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))

    def marginals(self, n: int, at: list[int], em: list[float]) -> list[float]:
        """P(state 1) of the tokens at the given places of a text of n tokens; all others have emission 0."""
        eb = math.exp(self.bias)
        a = [[math.exp(x) for x in row] for row in self.trans]
        b = ((a[0][0], a[0][1] * eb), (a[1][0], a[1][1] * eb))
        tr, det = b[0][0] + b[1][1], b[0][0] * b[1][1] - b[0][1] * b[1][0]
        root = math.sqrt(max(tr * tr / 4 - det, 0.0))
        l1, l2 = tr / 2 + root, tr / 2 - root
        gap = max(l1 - l2, 1e-300)

        def power(k):  # b**k / l1**k
            r = (l2 / l1) ** k
            s = (1 - r) / gap
            return ((r + s * (b[0][0] - l2), s * b[0][1]), (s * b[1][0], r + s * (b[1][1] - l2)))

        step = [math.exp(min(self.bias + e, 500.0)) for e in em]
        fwd, v, last = [], (1.0, math.exp(self.start)), -1
        first = True
        for p, x in zip(at, step, strict=True):
            k = p - last - 1
            if first:
                if k:  # the first token of the text is a plain one
                    v = (v[0], v[1] * eb)
                    m = power(k - 1)
                    v = (v[0] * m[0][0] + v[1] * m[1][0], v[0] * m[0][1] + v[1] * m[1][1])
                    v = (v[0] * a[0][0] + v[1] * a[1][0], (v[0] * a[0][1] + v[1] * a[1][1]) * x)
                else:
                    v = (v[0], v[1] * x)
                first = False
            else:
                m = power(k)
                v = (v[0] * m[0][0] + v[1] * m[1][0], v[0] * m[0][1] + v[1] * m[1][1])
                v = (v[0] * a[0][0] + v[1] * a[1][0], (v[0] * a[0][1] + v[1] * a[1][1]) * x)
            s = v[0] + v[1]
            v = (v[0] / s, v[1] / s)
            fwd.append(v)
            last = p
        out, m = [], power(n - 1 - last)
        w = (m[0][0] + m[0][1], m[1][0] + m[1][1])
        for i in range(len(at) - 1, -1, -1):
            p0, p1 = fwd[i][0] * w[0], fwd[i][1] * w[1]
            out.append(p1 / (p0 + p1))
            if i:
                w = (a[0][0] * w[0] + a[0][1] * step[i] * w[1], a[1][0] * w[0] + a[1][1] * step[i] * w[1])
                m = power(at[i] - at[i - 1] - 1)
                w = (m[0][0] * w[0] + m[0][1] * w[1], m[1][0] * w[0] + m[1][1] * w[1])
                s = w[0] + w[1]
                w = (w[0] / s, w[1] / s)
        return out[::-1]

    def score(self, evidence: float, n: int) -> float:
        """The score of a text of n tokens."""
        if self.curve is None:
            return -math.expm1(-evidence)
        c, a, b = self.curve
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, c + a * math.log1p(evidence) + b * math.log1p(n)))))


def evidence(marginals: Iterable[float]) -> float:
    return -sum(math.log1p(-min(p, 1 - 1e-12)) for p in marginals)


class Emissions(dict):
    """Emissions of the words met so far; starts anew when full."""

    def __init__(self, model: Field):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE:
            self.clear()
        e = self[word] = self.model.emission(word)
        return e


class Tagger:
    """Scores texts with a field."""

    def __init__(self, model: Field):
        self.model, self.memory = model, Emissions(model)

    def tag(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        if not text or not self.model.weights:
            return 0.0, []
        em = list(map(self.memory.__getitem__, TOKEN.findall(text)))
        if not em:
            return 0.0, []
        if not any(em):
            return self.model.score(0.0, len(em)), []
        at = [i for i, e in enumerate(em) if e]
        p = dict(zip(at, self.model.marginals(len(em), at, [em[i] for i in at]), strict=True))
        on = {i for i, x in p.items() if x >= 0.5}
        spans = [(m.start(), m.end(), p[i]) for i, m in enumerate(TOKEN.finditer(text)) if i in on] if on else []
        return self.model.score(evidence(p.values()), len(em)), spans


class Corpus:
    """Texts as arrays of word numbers; words are kept once."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        self.docs = [np.fromiter((number.setdefault(w, len(number)) for w in TOKEN.findall(t)), np.int32) for t in texts]
        self.words = list(number)
        self.sets = [np.unique(d) for d in self.docs]


def distinct_rows(corpus: Corpus) -> list[int]:
    """Rows that are no near copy of an earlier one: fewer than 3 of 6 minimal hashes of their long words in common."""
    h = np.array([zlib.crc32(w.lower().encode()) for w in corpus.words], np.uint64)
    long = np.array([len(w) > 8 for w in corpus.words], bool)  # short words are common to all texts
    seen: dict = {}
    out = []
    for i, ws in enumerate(corpus.sets):
        x = h[ws[long[ws]]] if long[ws].any() else h[ws]
        keys = [(k, int(((x * np.uint64(0x9E3779B1 + 2 * k * 7919) + np.uint64(k * 104729)) & np.uint64(0xFFFFFFFF)).min())) for k in range(6)] if len(x) else []
        hits = Counter(seen[k] for k in keys if k in seen)
        if hits and hits.most_common(1)[0][1] >= 3:
            continue
        for k in keys:
            seen.setdefault(k, i)
        out.append(i)
    return out


def cues(corpus: Corpus, y: list[int], least: float = 40.0) -> set[str]:
    """Features that toxic documents bear far more often than chance lets them and clean ones all but lack.

    First every feature whose log-likelihood ratio over all documents reaches least. Then, while
    toxic documents without a cue remain, the one that tells most of these apart from the clean
    ones, if its ratio is beyond what the best of so many features reaches by chance: rare
    languages have few documents each. A cue's share of toxic documents is LIFT times that of clean ones."""
    keep = distinct_rows(corpus)
    bad, good = [corpus.sets[i] for i in keep if y[i]], [corpus.sets[i] for i in keep if not y[i]]
    if not bad or not good:
        return set()
    # numbers only for features that may stand in three toxic documents: a hashed count first, then names
    mask, often = (1 << 22) - 1, np.zeros(1 << 22, np.int32)
    for s in bad:
        often[np.unique(np.array([zlib.crc32(f.encode()) & mask for w in s for f in features(corpus.words[w])], np.int64))] += 1
    n_seen = int((often > 0).sum())
    number: dict[str, int] = {}
    wanted = np.unique(np.concatenate(bad))
    of = {int(w): [number.setdefault(f, len(number)) for f in features(corpus.words[w]) if often[zlib.crc32(f.encode()) & mask] >= 3] for w in wanted}
    names = list(number)
    for w in set(np.unique(np.concatenate(good)).tolist()) - of.keys():
        if found := [number[f] for f in features(corpus.words[w]) if f in number]:
            of[w] = found
    borne = lambda s: np.unique([f for w in s.tolist() for f in of.get(w, ())]).astype(np.int64)
    count = lambda docs: np.bincount(np.concatenate([np.zeros(0, np.int64), *docs]), minlength=len(names))
    d0, n0 = count([borne(s) for s in good]), len(good)
    rows = [borne(s) for s in bad]

    def rated(docs):
        n1, a = len(docs), count(docs).astype(float)
        t = (a + d0) / (n0 + n1)
        part = lambda k, e: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(e, 1e-9)), 0.0)
        g = 2 * (part(a, t * n1) + part(d0, t * n0) + part(n1 - a, (1 - t) * n1) + part(n0 - d0, (1 - t) * n0))
        return np.where((a >= 3) & (a * n0 >= LIFT * d0 * n1), g, 0.0)

    on = rated(rows) >= least
    rest = 2 * math.log(10 * max(2, n_seen))
    while left := [r for r in rows if not on[r].any()]:
        g = rated(left)
        if g.max(initial=0.0) < rest:
            break
        on[min(np.flatnonzero(g == g.max()), key=lambda i: names[i])] = True
    return {names[i] for i in np.flatnonzero(on)}


def fit_field(texts: list[str], y: list[int], window: int = 8, most: int = 4_000, rounds: int = 120, seed: int = 5) -> Field:
    """Maximum likelihood on windows of 2 * window + 1 tokens: around labelled tokens, around unlabelled
    ones that bear a candidate feature, and at even steps through the rest; at most this many of each kind."""
    corpus = Corpus(texts)
    found = cues(corpus, y)
    if not found:
        return Field()
    rng = np.random.default_rng(seed)
    bears = np.array([not found.isdisjoint(features(w)) for w in corpus.words], bool)
    toxic_words = np.unique(np.concatenate([s for s, v in zip(corpus.sets, y, strict=True) if v]))
    names = sorted({f for w in toxic_words[bears[toxic_words]] for f in features(corpus.words[w])})
    number = {f: i + 1 for i, f in enumerate(names)}
    of = {i: fs for i, w in enumerate(corpus.words) if (fs := [number[f] for f in features(w) if f in number])}
    live_word = np.zeros(len(corpus.words), bool)
    live_word[list(of)] = True
    kinds: tuple[list, list, list] = ([], [], [])
    for d, ws in enumerate(corpus.docs):
        mine = bears[ws] & bool(y[d])
        near = live_word[ws] & ~mine
        kinds[0].extend((d, int(t)) for t in np.flatnonzero(mine))
        kinds[1].extend((d, int(t)) for t in np.flatnonzero(near))
        kinds[2].extend((d, t) for t in range(0, len(ws), 40) if not mine[t] and not near[t])
    spots = [k[i] for k in kinds for i in (rng.permutation(len(k))[:most] if len(k) > most else range(len(k)))]
    span = 2 * window + 1
    width = 6
    x, lab, live = np.zeros((len(spots), span, width), np.int32), np.zeros((len(spots), span), np.int8), np.zeros((len(spots), span), bool)
    for r, (d, t) in enumerate(spots):
        ws = corpus.docs[d]
        for c, p in enumerate(range(max(0, t - window), min(len(ws), t + window + 1))):
            fs = of.get(int(ws[p]), ())
            x[r, c, : len(fs)] = fs
            lab[r, c], live[r, c] = y[d] and bears[ws[p]], True
    m = len(names) + 1
    theta = np.zeros(m + 5)  # weights (0 is no feature), bias, start, t01, t10, t11
    theta[m] = -4.0
    mom, var = np.zeros_like(theta), np.zeros_like(theta)
    n = live.sum(1)
    for k in range(1, rounds + 1):
        e = theta[:m][x].sum(2) + theta[m]
        e[~live] = 0
        t = np.exp(np.array([[0.0, theta[m + 2]], [theta[m + 3], theta[m + 4]]]))
        step = np.stack([np.ones_like(e), np.exp(np.clip(e, -50, 50))], 2)
        f = np.empty((len(spots), span, 2))
        v = np.stack([np.ones(len(spots)), np.full(len(spots), math.exp(theta[m + 1]))], 1) * step[:, 0]
        f[:, 0] = v / v.sum(1, keepdims=True)
        for c in range(1, span):
            v = (f[:, c - 1] @ t) * step[:, c]
            f[:, c] = np.where(live[:, c, None], v / v.sum(1, keepdims=True), f[:, c - 1])
        b = np.ones((len(spots), 2))
        p1, g2 = np.zeros((len(spots), span)), np.zeros((2, 2))
        for c in range(span - 1, -1, -1):
            q = f[:, c] * b
            p1[:, c] = np.where(live[:, c], q[:, 1] / q.sum(1), 0)
            if c:
                on = live[:, c]
                joint = f[on, c - 1, :, None] * t[None] * (step[on, c] * b[on])[:, None, :]
                g2 -= (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                seen = lab[on, c - 1] * 2 + lab[on, c]
                g2 += np.bincount(seen, minlength=4).reshape(2, 2)
                nb = (step[:, c] * b) @ t.T
                b = np.where(on[:, None], nb / nb.sum(1, keepdims=True), b)
        d1 = np.where(live, lab - p1, 0)
        grad = np.zeros_like(theta)
        grad[:m] = np.bincount(x.ravel(), np.repeat(d1.ravel(), width), m)
        grad[0] = 0
        grad[m] = d1.sum()
        grad[m + 1] = d1[:, 0].sum()
        grad[m + 2], grad[m + 3], grad[m + 4] = g2[0, 1], g2[1, 0], g2[1, 1]
        grad = grad / max(1, len(spots)) - 1e-5 * theta
        mom, var = 0.9 * mom + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        theta += 0.15 * (mom / (1 - 0.9**k)) / (np.sqrt(var / (1 - 0.99**k)) + 1e-8)
    keep = {f: float(theta[i]) for f, i in number.items() if abs(theta[i]) > 0.05}
    model = Field(float(theta[m]), float(theta[m + 1]), ((0.0, float(theta[m + 2])), (float(theta[m + 3]), float(theta[m + 4]))), keep)
    model.curve = fit_curve(model, corpus, y, list(of))
    return model


def fit_curve(model: Field, corpus: Corpus, y: list[int], live: list[int]) -> tuple[float, float, float]:
    """Logistic regression of the labels on the logarithms of evidence and length, live being the words
    that may bear weights; a text does not become toxic by its length, so that factor is at most 0."""
    em = np.zeros(len(corpus.words))
    em[live] = [model.emission(corpus.words[w]) for w in live]
    rows, on = [], []
    for ws, v in zip(corpus.docs, y, strict=True):
        if not len(ws):
            continue
        at = np.flatnonzero(em[ws])
        seen = evidence(model.marginals(len(ws), at.tolist(), em[ws[at]].tolist())) if len(at) else 0.0
        rows.append((1.0, math.log1p(seen), math.log1p(len(ws))))
        on.append(v)
    x, t = np.array(rows), np.array(on, float)
    w = np.where(t == 1, 1.0, CLEAN_ODDS * t.sum() / max(1.0, (1 - t).sum()))
    for k in (3, 2):
        b = np.zeros(k)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x[:, :k] @ b, -30, 30)))
            h = (x[:, :k] * (w * p * (1 - p))[:, None]).T @ x[:, :k] + 0.01 * np.eye(k)
            b += np.clip(np.linalg.solve(h, x[:, :k].T @ (w * (t - p)) - 0.01 * b), -2, 2)
        if k == 2 or b[2] <= 0:
            break
    return float(b[0]), float(b[1]), float(b[2]) if k == 3 else 0.0


def train_toxicity(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_rows: int = 3_000, max_bytes: int = 48 << 20) -> Field:
    """Fits the field to labels.toxic of at most max_rows toxic and max_rows other documents and, of these,
    whole texts of at most max_bytes in all, in the order of a hash of their ids (documented bounds)."""
    ok = F.lit(True) if usable is None else usable
    with scratch(docs.sparkSession) as keep:
        parts = [labelled(docs, labels, "toxic", ok & (F.col("_y") == v), max_rows, F.max) for v in (1, 0)]
        rows = keep(parts[0].unionByName(parts[1]).where("text IS NOT NULL"))
        sizes = rows.select("doc_id", F.xxhash64("doc_id").alias("h"), F.octet_length("text").alias("n")).groupBy("h", "doc_id").agg(F.sum("n").alias("n")).orderBy("h", "doc_id").collect()
        total, ids = 0, []
        for r in sizes:
            if total + r["n"] <= max_bytes:
                total += r["n"]
                ids.append((r["doc_id"],))
        some = rows if len(ids) == len(sizes) else rows.join(F.broadcast(docs.sparkSession.createDataFrame(ids, rows.select("doc_id").schema)), "doc_id")
        got = some.toPandas().sort_values(["doc_id", "text"])
    return fit_field(got["text"].tolist(), got["_y"].astype(int).tolist())


def tag_toxicity(docs: DataFrame, model: Field, out: str = "toxicity") -> DataFrame:
    """docs with the column out, in the place of an own one of that name: struct<score: double, spans: array<start, stop, p>>; offsets count code points."""

    @F.pandas_udf(f"score double, spans {SPANS}")
    def tag(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hold("toxicity")
        tagger = Tagger(model)
        for texts in parts:
            got = [tagger.tag(t) for t in texts]
            yield pd.DataFrame({"score": [s for s, _ in got], "spans": [[{"start": a, "stop": b, "p": p} for a, b, p in x] for _, x in got]})

    return docs.withColumn(out, tag(docs["text"]))


def op1(spark, docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    model = train_toxicity(docs, labels, ~held_out(3, 1, F.col("_id")))
    got = tag_toxicity(docs.select("doc_id", "text"), model, "_t")
    return got.select(
        "doc_id",
        held_out(3, 1, F.col("doc_id")).alias("held_out"),
        F.col("_t.score").alias("score"),
        F.when(F.col("_t.score") >= threshold, 1).otherwise(0).alias("predicted"),
        F.size("_t.spans").alias("n_spans"),
    )
