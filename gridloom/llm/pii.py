"""Personal data: candidates from wide generators, judged by boosted trees.

Base rules find e-mail addresses, network addresses, card numbers and phone numbers that stand by
themselves; their spans always count. Generators propose many overlapping spans beside: parts of
longer runs of digit groups (two numbers side by side are one failing match to a base rule), every
four parts of a longer dotted run, phone numbers without a plus, addresses with spelt-out or
non-ASCII parts. Trees boosted on format and context features score every candidate; scores are
calibrated on documents the trees have not seen, and a kind's threshold is the least one at which
its precision there holds. Of overlapping candidates above it the likeliest stays.

Nothing is labelled by hand: base spans of a bounded sample are the positive examples, spans that
cut or exceed them and runs that fail their rule the negative ones; copies of base spans set side
by side, spelt out or without their plus teach what base rules miss.

Defined cases: null text counts as empty and has no span; very long texts are read whole, in time
linear in their length; ties in likelihood go to the earlier, then the longer span; rows that are
equal or share an id are read each for itself; ids play no part in any decision; an empty table
gives an empty result; without examples a kind has base spans alone; an own column of the result's
name gives way, all other columns are kept, whatever their names."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# ---- base rules ------------------------------------------------------------------------------

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain from left to right: a local part ends at its @, so each @ is tried once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def matches(text: str) -> list[tuple[int, int, int, bool]]:
    """start, end, kind, valid of every match of the base rules, valid or not, kind by kind."""
    out = [(a, b, EMAIL, True) for a, b in _emails(text)]
    for m in _DOTTED.finditer(text):
        out.append((*m.span(), IP, octets(m.group())))
    for m in _DIGITS.finditer(text):
        d = digits_of(m.group())
        out.append((*m.span(), CARD, 12 <= len(d) <= 19 and luhn(d)))
    for m in _PLUS.finditer(text):
        out.append((*m.span(), PHONE, 9 <= len(digits_of(m.group())) <= 15))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, end, kind by start, then kind."""
    return sorted(((a, b, k) for a, b, k, ok in matches(text) if ok), key=lambda s: (s[0], s[2]))


# ---- candidates ------------------------------------------------------------------------------

_GROUP = re.compile(r"[0-9]+")
_SPELT = re.compile(r"[\w.%+-]+\s?[\[({]\s?at\s?[\])}]\s?[\w-]+(?:\s?(?:[\[({]\s?dot\s?[\])}]|\.)\s?[\w-]+)+|[\w.%+-]+ at [\w-]+(?: dot [\w-]+)+")
_WIDE = re.compile(r"@[\w-]+(?:\.[\w-]+)+")
_BETWEEN = {" ", "-", ".", ") ", ")", " (", "(", ")-", "-(", ". ", " - "}


def candidates(text: str) -> list[tuple[int, int, int]]:
    """start, end, kind of every proposed span: overlapping, wide, at most 30 for each group of digits or @."""
    out = []
    at = text.find("@")
    while at >= 0:
        m, start = _WIDE.match(text, at), at
        while start and (text[start - 1] in _LOCAL or text[start - 1].isalnum()):
            start -= 1
        if m and start < at:
            end = m.end()
            while text[end - 1] in "_-":
                end -= 1
            out.append((start, end, EMAIL))
        at = text.find("@", at + 1)
    if "dot" in text or "at" in text:
        out += [(*m.span(), EMAIL) for m in _SPELT.finditer(text)] if re.search(r"[\[({]\s?at\s?[\])}]| dot ", text) else []
    groups = [m.span() for m in _GROUP.finditer(text)]
    gaps = [text[b : groups[i + 1][0]] if groups[i + 1][0] - b <= 3 else None for i, (_, b) in enumerate(groups[:-1])] + [None]
    for i, (a, b) in enumerate(groups):
        n, k, last = b - a, i, None
        plain = single = dotted = True  # gaps so far: those of a card, of an address
        lead = a - 1 if a and text[a - 1] in "+(" else a
        lead = lead - 1 if lead and text[lead] == "(" and text[lead - 1] == "+" else lead
        while n <= 19:
            end = groups[k][1]
            if plain and 12 <= n <= 19:
                out.append((a, end, CARD))
            if dotted and k - i == 3:
                out.append((a, end, IP))
            if 9 <= n <= 15 and (lead < a or k > i):
                out.append((lead, end, PHONE))
            last = gaps[k]
            if last not in _BETWEEN or not single:
                break
            plain, dotted = plain and last in (" ", "-"), dotted and last == "."
            k += 1
            n += groups[k][1] - groups[k][0]
    return out


# ---- features --------------------------------------------------------------------------------

_CUES = tuple(re.compile(p, re.I) for p in (r"mail|write|contact|@", r"\bip\b|host|addr|server|ping", r"card|visa|master|credit|pay", r"phone|tel|call|mobile|cell|fax", r"token|key|hash|order|ref|serial|version|\bid\b|isbn|no\."))
FEATURES = 27


def _kind_of(c: str) -> int:
    if not c:
        return 0
    if c.isspace():
        return 1
    if "0" <= c <= "9":
        return 2
    if c.isalpha():
        return 3
    return 4 if c in "\"'" else 5 if c in "+-.@(_/=" else 6


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    """Numbers about a candidate's form and about the forty characters on either side."""
    a, b, kind = span
    s, near = text[a:b], (text[max(0, a - 40) : a], text[b : b + 40])
    runs = [len(g) for g in _GROUP.findall(s)] or [0]
    d = digits_of(s)
    around = [_kind_of(text[p : p + 1]) if p >= 0 else 0 for p in (a - 2, a - 1, b, b + 1)]
    name, _, domain = s.partition("@")
    cues = [float(bool(c.search(near[0][-24:]))) for c in _CUES]
    parts = s.split(".") if kind == IP else []
    top = max((int(p.lstrip("0")[:4] or 0) for p in parts if digits_of(p) == p), default=-1)
    return [
        len(d), len(runs), runs[0], runs[-1], min(runs), max(runs),
        s.startswith("+"), s.count("("), s.count(" "), s.count("-"), s.count("."),
        luhn(d) if d else -1, top, int(d[0]) if d else -1,
        *around, len(name) if domain else 0, domain.count("."), len(domain.rpartition(".")[2]),
        sum(c.isdigit() for c in near[0][-20:]), *cues,
    ]


# ---- trees -----------------------------------------------------------------------------------


@dataclass
class Trees:
    """Boosted trees of one depth as arrays: feature and threshold of inner nodes, values of leaves; then the calibration and the threshold."""

    start: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 7), np.int64))
    at: np.ndarray = field(default_factory=lambda: np.zeros((0, 7)))
    value: np.ndarray = field(default_factory=lambda: np.zeros((0, 8)))
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 2.0  # no probability reaches it

    def raw(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, t, v in zip(self.feature, self.at, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < len(f):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            z += v[node - len(f)] if len(x) else 0
        return z

    def p(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.raw(x) + self.scale[1], -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32) -> Trees:
    """Logistic gradient boosting with second-order leaves over binned features."""
    p0 = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Trees(float(np.log(p0 / (1 - p0))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins))) for j in range(x.shape[1])]
    cuts = [(c[1:] + c[:-1]) / 2 for c in cuts]
    codes = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    z, found = np.full(len(y), model.start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        f, t = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key, size = (node - first) * bins + codes[:, j], width * bins
                gs, hs = (np.bincount(key, v, size).reshape(width, bins).cumsum(1) for v in (g, h))
                score = lambda a, b: a * a / (b + 1)
                gain = score(gs, hs) + score(gs[:, -1:] - gs, hs[:, -1:] - hs) - score(gs[:, -1:], hs[:, -1:])
                k = gain[:, : len(c)].argmax(1)
                top = gain[np.arange(width), k]
                for m in np.flatnonzero(top > best):
                    best[m], f[first + m], t[first + m] = top[m], j, c[k[m]]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > t[node])
        leaf = node - len(f)
        v = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
        z += v[leaf]
        found.append((f, t, v))
    model.feature, model.at, model.value = (np.stack(a) for a in zip(*found, strict=True))
    return model


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray, precision: float) -> None:
    """Sets scale by logistic regression on the raw scores, and the least threshold from 0.5 on whose precision holds."""
    if not len(y) or not y.any():
        return
    s, w = model.raw(x), np.array([1.0, 0.0])
    m = np.stack([s, np.ones_like(s)], 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -40, 40)))
        hess = (m * (p * (1 - p))[:, None]).T @ m + 1e-2 * np.eye(2)
        w = w + np.linalg.solve(hess, m.T @ (y - p) - 1e-2 * (w - (1.0, 0.0)))
    model.scale = (float(max(w[0], 1e-3)), float(w[1]))
    p = model.p(x)
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(p[order][1:] != p[order][:-1], True)  # the right end of every run of equal scores
    ok = np.flatnonzero((right >= precision) & last & (p[order] >= 0.5))
    if len(ok):
        below = p[order][ok[-1] + 1] if ok[-1] + 1 < len(p) else 0.0  # half-way to the next lower score
        model.threshold = max(0.5, float(p[order][ok[-1]] + below) / 2)


# ---- examples --------------------------------------------------------------------------------


def _labelled(text: str, true: set, skip: list[tuple[int, int]] = ()) -> Iterator[tuple[int, int, list[float]]]:
    """kind, label, features of a text's candidates: 1 where the span is among the true ones; those inside skip are left out."""
    for c in candidates(text):
        if c in true:
            yield c[2], 1, features(text, c)
        elif not any(a <= c[0] and c[1] <= b for a, b in skip):
            yield c[2], 0, features(text, c)


def _variants(s: str, kind: int, other: str) -> list[tuple[str, int, int]]:
    """Texts in which a true span stands where base rules miss it, with the span's place."""
    out = [(f"{s} {other}", 0, len(s)), (f"{other} {s}", len(other) + 1, len(other) + 1 + len(s))]
    if kind == PHONE and "(" in s:
        at = s.index("(")
        out.append((s[at:], 0, len(s) - at))
    if kind == EMAIL:
        for how in ((" [at] ", " [dot] "), ("(at)", "."), (" at ", " dot ")):
            t = s.replace("@", how[0]).replace(".", how[1]) if how[1] != "." else s.replace("@", how[0])
            t = s.partition("@")[0].replace(".", "-") + t[t.index(how[0]) :]
            out.append((t, 0, len(t)))
        out.append(("é" + s, 0, len(s) + 1))
    return out


def examples(text: str) -> Iterator[tuple[int, int, list[float]]]:
    """kind, label and features of the training examples of one text."""
    found = matches(text)
    true = {(a, b, k) for a, b, k, ok in found if ok}
    unsure = [(a, b) for a, b, k, ok in found if not ok and (" " in text[a:b] or k == IP)]
    yield from _labelled(text, true, unsure)
    spans = sorted(true)
    for i, (a, b, k) in enumerate(spans):
        c, d, other = spans[(i + 1) % len(spans)]
        for t, lo, hi in _variants(text[a:b], k, text[c:d]):
            left, right = text[max(0, a - 40) : a], text[b : b + 40]
            whole = left + t + right
            want = (len(left) + lo, len(left) + hi, k)
            for e in candidates(whole):
                if e == want:
                    yield k, 1, features(whole, e)
                elif e[2] == k and e[0] < want[1] and want[0] < e[1]:
                    yield k, 0, features(whole, e)


def train_pii(docs: DataFrame, max_docs: int = 20_000, max_examples: int = 60_000, precision: float = 0.98, usable=None) -> list[Trees]:
    """Trees by kind, from about max_docs texts that hold a digit or an @, chosen by a hash of the text, and from at most max_examples
    different examples of these (documented bounds); two thirds of the texts fit the trees, the others calibrate them."""
    text = F.col("text")
    rows = docs.select("text").where(text.rlike("[0-9@]"))
    rows = rows if usable is None else rows.where(usable)
    n = rows.count()
    h = F.xxhash64("text")
    some = rows.where(F.pmod(h, F.lit(1 << 40)) < int(min(1.0, max_docs / max(1, n)) * (1 << 40))).distinct()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("pii")
        for p in parts:
            got = [(k, y, int(g), x) for t, g in zip(p["text"], p["part"], strict=True) for k, y, x in examples(t)]
            yield pd.DataFrame(got, columns=["kind", "label", "part", "x"])

    made = some.select("text", F.pmod(F.xxhash64(h, F.lit(1)), F.lit(3)).alias("part")).mapInPandas(run, "kind int, label int, part int, x array<double>").distinct()
    got = made.orderBy(F.xxhash64("kind", "label", "part", "x"), "kind", "label", "part", "x").limit(max_examples).toPandas()
    models = []
    for k in range(len(KINDS)):
        mine = got[got["kind"] == k]
        x = np.array(mine["x"].tolist(), float).reshape(-1, FEATURES)
        y, fit = mine["label"].to_numpy(float), mine["part"].to_numpy() > 0
        if not y[fit].any():
            models.append(Trees())
            continue
        models.append(boost(x[fit], y[fit]))
        calibrate(models[-1], x[~fit], y[~fit], precision)
    return models


# ---- operator --------------------------------------------------------------------------------


class Finder:
    """Spans of texts: base ones, and added candidates that the models accept."""

    def __init__(self, models: list[Trees]):
        self.models = models

    def find(self, texts) -> list[list[tuple[int, int, int, float, bool]]]:
        """start, end, kind, p, base of each text's spans, by start, then kind."""
        found, spans, x = [], [], []
        for i, t in enumerate(texts):
            base = base_spans(t) if t else []
            found.append([(*s, 1.0, True) for s in base])
            if not t:
                continue
            taken = Taken(base)
            for c in candidates(t):
                if taken.free(c[0], c[1]):
                    spans.append((i, *c))
                    x.append(features(t, c))
        if not spans:
            return found
        m, kind, p = np.array(x, float), np.array([s[3] for s in spans]), np.zeros(len(spans))
        for k, model in enumerate(self.models):
            p[kind == k] = model.p(m[kind == k])
        good = p >= np.array([model.threshold for model in self.models])[kind]
        by: dict[int, list] = {}
        for j in np.flatnonzero(good):
            i, a, b, k = spans[j]
            by.setdefault(i, []).append((-p[j], a, -b, k))
        for i, some in by.items():
            taken = Taken([])
            for minus, a, b, k in sorted(some):
                if taken.free(a, -b):
                    taken.add(a, -b)
                    found[i].append((a, -b, k, float(-minus), False))
            found[i].sort(key=lambda s: (s[0], s[2], s[1]))
        return found


class Taken:
    """Places of a text that are taken, in blocks of 64 characters, so that a look-up does not grow with their number."""

    def __init__(self, spans):
        self.at: dict[int, list[tuple[int, int]]] = {}
        for s in spans:
            self.add(s[0], s[1])

    def add(self, a: int, b: int) -> None:
        for k in range(a >> 6, (b >> 6) + 1):
            self.at.setdefault(k, []).append((a, b))

    def free(self, a: int, b: int) -> bool:
        return not self.at or all(b <= c or d <= a for k in range(a >> 6, (b >> 6) + 1) for c, d in self.at.get(k, ()))


SPANS = "array<struct<kind: string, start: long, stop: long, p: double, base: boolean>>"


def find_pii(docs: DataFrame, models: list[Trees], out: str = "pii") -> DataFrame:
    """docs with the column out: its spans by start, then kind; offsets count code points, stop is exclusive."""

    @F.pandas_udf(SPANS)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hold("pii")
        finder = Finder(models)
        names = ("kind", "start", "stop", "p", "base")
        for texts in parts:
            got = finder.find(texts)
            yield pd.Series([[dict(zip(names, (KINDS[k], a, b, p, base), strict=True)) for a, b, k, p, base in s] for s in got], dtype=object)

    return docs.withColumn(out, run(docs["text"]))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span (start, stop, kind) as its kind in brackets; overlapping spans count as one, of the first's kind."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def op11(spark, docs: DataFrame) -> DataFrame:
    """Spans of every document; the counts and base_sha256 are of base spans, spans holds all."""
    got = find_pii(docs.select("doc_id", "text"), train_pii(docs), "_p")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    base = F.filter("_p", lambda s: s["base"])
    count = lambda k: F.size(F.filter("_p", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return got.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("_p")).alias("spans"),
        F.size(F.filter("_p", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )
