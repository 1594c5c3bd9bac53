"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Trees are grown on bootstrap samples over text statistics; every path from a root is a
conjunctive rule; a lasso logistic regression over the rules keeps few of them; the kept rules
and weights become one column expression, so scoring is a single scan without Python.

Defined cases: null text counts as empty; empty texts are scored; repeated rows are scored each;
ties cannot occur; an empty table gives an empty result; with no usable label, or labels of one
class only, every score is the share of label 1 among them (0.5 without any)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod
from .stats import SHAPE, with_shape

#: A rule: ((feature, "<=" or ">", threshold), ...).
Rule = tuple[tuple[str, str, float], ...]


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self) -> Column:
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            cond = F.lit(True)
            for name, op, at in rule:
                cond = cond & (F.col(name) <= at if op == "<=" else F.col(name) > at)
            z = z + F.when(cond, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(x, y, rows, depth, rng, cuts, path, out):
    """Adds to out the path of every node below this one of a Gini tree over x[rows]."""
    p = y[rows].mean()
    if depth == 0 or len(rows) < 10 or p in (0.0, 1.0):
        return
    best = (1e-9, None)
    total, ones = len(rows), y[rows].sum()
    base = p * (1 - p) * total
    for j in rng.choice(x.shape[1], max(2, (2 * x.shape[1] + 2) // 3), replace=False):
        v, t = x[rows, j], cuts[j]
        left = v[:, None] <= t[None, :]
        n = left.sum(0)
        k = (left & (y[rows, None] > 0)).sum(0)
        m, q = total - n, ones - k
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = base - np.where(n > 0, k * (n - k) / n, 0) - np.where(m > 0, q * (m - q) / m, 0)
        gain[(n < 3) | (m < 3)] = -1
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (gain[i], (int(j), float(t[i])))
    if best[1] is None:
        return
    j, t = best[1]
    side = x[rows, j] <= t
    for op, sub in (("<=", rows[side]), (">", rows[~side])):
        out.add(q := (*path, (j, op, t)))
        _grow(x, y, sub, depth - 1, rng, cuts, q, out)


def _covers(rule, x):
    on = np.ones(len(x), bool)
    for j, op, t in rule:
        on &= x[:, j] <= t if op == "<=" else x[:, j] > t
    return on


def lasso_logistic(r: np.ndarray, y: np.ndarray, lam: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Weights that minimise mean log loss + lam * |w|_1, by accelerated proximal gradient; the intercept is free."""
    n, m = r.shape
    w, b = np.zeros(m), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    v, c, k = w.copy(), b, 1.0
    step = 4.0 / (np.linalg.norm(r, 2) ** 2 / n + 1.0)
    for _ in range(steps):
        g = (1 / (1 + np.exp(-np.clip(r @ v + c, -40, 40))) - y) / n
        new = v - step * (r.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - step * lam, 0)
        nb, nk = c - step * g.sum(), (1 + math.sqrt(1 + 4 * k * k)) / 2
        v, c = new + (k - 1) / nk * (new - w), nb + (k - 1) / nk * (nb - b)
        w, b, k = new, nb, nk
    return b, w


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, lam: float = 0.002, seed: int = 7) -> RuleModel:
    """The ensemble over a sample that fits in memory."""
    if len(y) == 0:
        return RuleModel(0.0)
    if y.min() == y.max():
        return RuleModel(math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rng, cuts = np.random.default_rng(seed), []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 33)))
        cuts.append(q)
    found: set = set()
    for _ in range(trees):
        rows = rng.choice(len(y), min(len(y), 2000), replace=True)
        _grow(x, y, rows, depth, rng, cuts, (), found)
    rules = sorted(found)
    if not rules:
        return RuleModel(math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    r = np.stack([_covers(q, x) for q in rules], 1).astype(float)
    _, keep = np.unique(r, axis=1, return_index=True)
    keep = np.sort(keep)
    r, rules = r[:, keep], [rules[i] for i in keep]
    b, w = lasso_logistic(r, y.astype(float), lam)
    on = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleModel(float(b), [(tuple((names[j], op, t) for j, op, t in rules[i]), float(w[i])) for i in on])


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int, worst) -> DataFrame:
    """Text and label of at most max_rows labelled documents, the first by a hash of the id.

    Only the sample of ids (max_rows rows of two numbers, so a proven bound) is broadcast. Of
    several labels of one document the worst counts; nulls do not count."""
    ids = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isNotNull())
        .groupBy("_id")
        .agg(worst("_y").alias("_y"))
        .where(usable)
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).drop("_id")


def train_quality(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_rows: int = 20_000) -> RuleModel:
    """Fits the ensemble to labels.quality of at most max_rows documents (a documented bound).

    usable says, over the column _id, which labelled documents may be learnt from. The driver
    gets ten statistics a row, never a text."""
    rows = labelled(docs, labels, "quality", F.lit(True) if usable is None else usable, max_rows, F.min)
    got = with_shape(rows).select("doc_id", "_y", *SHAPE).toPandas().sort_values(["doc_id", *SHAPE])
    return fit_rules(got[SHAPE].to_numpy(float), got["_y"].to_numpy(int), SHAPE)


def score_quality(docs: DataFrame, model: RuleModel, out: str = "score") -> DataFrame:
    """docs with the column out, 0 to 1, in the place of an own column of that name; all others are kept, whatever their names."""
    rows = docs.drop(out) if out in docs.columns else docs
    text = rows.select(F.struct("*").alias("_row"), docs["text"].alias("text"))
    return with_shape(text).select("_row.*", model.score().alias(out))


def held_out(n: int, at: int, doc_id: Column) -> Column:
    return crc_mod(doc_id, n) == at


def op8(spark, docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    model = train_quality(docs, labels, ~held_out(5, 0, F.col("_id")))
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out(5, 0, F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
