"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become runs of lower-cased code points in which everything but letters is one blank; their
2- and 3-grams are hashed into BUCKETS counters. Counting runs on the executors; the matrix of
log probabilities (at most BLOCK languages x BUCKETS, float32) is broadcast, and batches are scored
by gathering its rows for a batch's n-grams and summing them text by text. More languages than that
are taken block by block, with one pass each, and their likelihoods add up to the same posterior.

Defined cases: null texts and texts without a letter get `und` and score 0; so does every text if
nothing could be learnt; equal posteriors go to the first language in order; repeated rows are
scored each; an empty table gives an empty result. A language is a non-null value of lang."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, scratch
from .quality import held_out

BUCKETS = 1 << 16
#: Languages counted and scored at once: 64 MiB of counters in a worker, 32 MiB broadcast.
BLOCK = 128
STATE = "lang string, top double, rest double"
#: Code points handled at once.
CHUNK = 1 << 20
_fold: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """For each code point itself if it is a letter, else 32."""
    if not _fold:
        t = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                t[c] = c
        _fold.append(t)
    return _fold[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of these texts, the text of each, and whether a text has a letter."""
    low = [(t or "").lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in low])
    c = _fold_table()[np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.repeat(np.arange(len(low)), np.diff(ends, prepend=0))
    letters = np.bincount(doc[c != 32], minlength=len(low)) > 0
    blank = np.concatenate([[True], c[:-1] == 32])
    keep = (c != 32) | ~blank | np.concatenate([[True], doc[1:] != doc[:-1]])
    c, doc = c[keep], doc[keep]
    a = c * np.uint32(0x9E3779B1)
    out, own = [], []
    for n in (2, 3):
        if len(c) < n:
            continue
        h = a[: len(a) - n + 1].copy()
        for k in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + a[k : len(a) - n + 1 + k]
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE3D)
        same = doc[: len(doc) - n + 1] == doc[n - 1 :]
        out.append((h >> np.uint32(16))[same])
        own.append(doc[: len(doc) - n + 1][same])
    if not out:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), letters
    return np.concatenate(out), np.concatenate(own), letters


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > CHUNK:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(texts):
        yield first, len(texts)


def count_grams(rows: DataFrame, shares: dict[str, float]) -> np.ndarray:
    """Log probabilities (float32, languages in their order x BUCKETS) from the given share of each language's texts."""
    names = sorted(shares)
    cut_at = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(shares[k]))])[F.col("lang")]
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < cut_at * (1 << 30)).select("lang", "text")
    number = {k: i for i, k in enumerate(names)}

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(names), BUCKETS), np.int64)
        for part in parts:
            texts, lang = part["text"].tolist(), part["lang"].map(number).to_numpy(np.int64)
            for a, b in chunks(texts):
                g, d, _ = grams(texts[a:b])
                total += np.bincount(lang[a:b][d] * BUCKETS + g, minlength=total.size).reshape(total.shape)
        i, j = np.nonzero(total)
        for k in range(0, len(i), 1 << 16):
            s = slice(k, k + (1 << 16))
            yield pd.DataFrame({"l": i[s].astype(np.int32), "b": j[s].astype(np.int32), "n": total[i[s], j[s]]})

    got = picked.mapInPandas(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((len(names), BUCKETS))
    n[got["l"], got["b"]] = got["n"]
    return np.log((n + 0.5) / (n.sum(1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)


def language_blocks(docs: DataFrame, usable: Column | None = None, per_lang: int = 3_000) -> Iterator[tuple[list[str], np.ndarray]]:
    """Languages in order, at most BLOCK at a time, and their log probabilities.

    Learns from about per_lang whole texts of each language, drawn by a hash of the id: a bounded,
    documented sample. Counters are summed on the executors; the driver gets one name a language, and
    BLOCK x BUCKETS counters at a time."""
    ok = F.col("lang").isNotNull() & F.col("text").isNotNull()
    rows = docs.select("doc_id", "lang", "text").where(ok if usable is None else ok & usable)
    share = rows.groupBy(F.col("lang").alias("_l")).agg(F.least(F.lit(1.0), F.lit(float(per_lang)) / F.count("*")).alias("_p"))
    langs = {r["_l"]: r["_p"] for r in share.collect()}
    names = sorted(langs)
    for first in range(0, len(names), BLOCK):
        some = names[first : first + BLOCK]
        yield some, count_grams(rows, {k: langs[k] for k in some})


def train_langid(docs: DataFrame, usable: Column | None = None, per_lang: int = 3_000) -> tuple[list[str], np.ndarray]:
    """All languages and their log probabilities in one matrix, 256 KiB a language; language_blocks bounds it."""
    got = list(language_blocks(docs, usable, per_lang))
    return [k for names, _ in got for k in names], np.concatenate([np.zeros((0, BUCKETS), np.float32), *[m for _, m in got]])


def score_texts(texts: list[str | None], names: list[str], table: np.ndarray) -> pd.DataFrame:
    """lang, its log likelihood top, and rest, the sum of all likelihoods over its own; without a letter und, 0, infinity."""
    best, most, rest = [], [], []
    for a, b in chunks(texts):
        g, d, letters = grams(texts[a:b])
        ll = np.stack([np.bincount(d, table[g, k], b - a) for k in range(len(names))], 1) if names else np.zeros((b - a, 1))
        top = ll.argmax(1)
        ok = letters & bool(names)
        best += [names[i] if y else "und" for i, y in zip(top, ok, strict=True)]
        most += np.where(ok, ll.max(1), 0.0).tolist()
        rest += np.where(ok, np.exp(ll - ll.max(1, keepdims=True)).sum(1), np.inf).tolist()
    return pd.DataFrame({"lang": pd.Series(best, dtype=object), "top": pd.Series(most, dtype=float), "rest": pd.Series(rest, dtype=float)})


def merged(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """The result over the languages of both; ties go to the old one, whose languages come first."""
    top = np.maximum(old["top"], new["top"])
    rest = old["rest"] * np.exp(old["top"] - top) + new["rest"] * np.exp(new["top"] - top)
    return pd.DataFrame({"lang": old["lang"].where(old["top"] >= new["top"], new["lang"]), "top": top, "rest": rest})


def identify(docs: DataFrame, blocks: Iterable[tuple[list[str], np.ndarray]], out: str = "lang_id") -> DataFrame:
    """docs with the column out, in the place of an own one of that name: struct<lang: string, score: double>; the score is
    the posterior under equal priors. One block is a projection; each further block is one more pass over docs, whose
    results so far are cut to the shared folder, so that no worker ever holds more than a block."""
    spark, state = docs.sparkSession, free_name(docs, "_best")

    def one_pass(df: DataFrame, block: tuple[list[str], np.ndarray], first: bool) -> DataFrame:
        names, shared = block[0], spark.sparkContext.broadcast(np.ascontiguousarray(block[1].T))

        @F.pandas_udf(STATE)
        def begin(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield score_texts(part.tolist(), names, shared.value)

        @F.pandas_udf(STATE)
        def go_on(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield merged(part[["lang", "top", "rest"]], score_texts(part["text"].tolist(), names, shared.value))

        seen = begin(df["text"]) if first else go_on(F.struct(df["text"].alias("text"), *[df[state][k].alias(k) for k in ("lang", "top", "rest")]))
        return df.withColumn(state, seen)

    todo = iter(blocks)
    block, got, passes = next(todo, ([], np.zeros((0, BUCKETS), np.float32))), docs, 0
    with scratch(spark) as keep:
        while block is not None:
            got, block, passes = one_pass(got, block, passes == 0), next(todo, None), passes + 1
            if block is not None:
                got = keep(got)
            elif passes > 1:
                got = cut(got)
    return got.withColumn(out, F.struct(F.col(state)["lang"].alias("lang"), (F.lit(1.0) / F.col(state)["rest"]).alias("score"))).drop(state)


def predict_langid(docs: DataFrame, names: list[str], logp: np.ndarray, out: str = "lang_id") -> DataFrame:
    """identify() by the rows of one matrix."""
    return identify(docs, ((names[i : i + BLOCK], logp[i : i + BLOCK]) for i in range(0, len(names), BLOCK)), out)


def op10(spark, docs: DataFrame) -> DataFrame:
    got = identify(docs.select("doc_id", "text"), language_blocks(docs, ~held_out(4, 2, F.col("doc_id"))), "_p")
    return got.select(
        "doc_id", held_out(4, 2, F.col("doc_id")).alias("held_out"), F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score")
    )
