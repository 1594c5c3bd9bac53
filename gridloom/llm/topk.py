"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks of bounded size, and so are queries; each pair of blocks is one
group. In it every dimension has its list of candidates in order. A query walks its lists from
their better ends in step, scores what it meets in full, and stops once the bound of all unseen
candidates, the score of an imagined one at the current depths, is below its kth score. Where there
are several blocks, one block is searched first, and its kth score of a query is the least that the
others have to beat, so that the bound holds over all blocks and not in each anew. The blocks'
results of a query, k rows each, meet by a window that keeps the first k.

The algorithm saves work where few dimensions decide a score. On dense vectors without structure
every candidate is near the front of some list and all are scored: the share measured on the
embeddings of the given tables is 1.00.

Defined cases: vectors that are null or empty, hold null or non-finite components, or have a null
id take no part; a query meets only candidates with as many components as itself; ties go to the
smaller id; a repeated row counts once; of queries with one id the smallest vector is taken; a row
with the query's id is no candidate of it; components saturate at 2**52 and scores at 63 bits, and
are exact below; extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


#: The largest component, and the ends of a score.
TOP, LONG = 1 << 52, (1 << 63) - 1


def quantise(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v, the array of floor(scale * x), of the vectors that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ok = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)
    code = lambda c: F.greatest(F.lit(-TOP), F.least(F.lit(TOP), F.floor(c.cast("double") * scale).cast("long")))
    return vectors.where(ok & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, code).alias("v"))


def _large(v: np.ndarray) -> np.ndarray:
    """Rows with a component so large that an inner product with another row may not be exact in float64."""
    return (np.abs(v) >= 1 << (53 - v.shape[1].bit_length()) // 2).any(1) if len(v) else np.zeros(0, bool)


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def threshold_search(q: np.ndarray, c: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, least: np.ndarray | None = None, scored: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of q the ids and scores of its k best rows of c, ties to smaller ids; own[i] is no candidate of row i.

    ids must ascend; q and c are floats with exact products. Rows that score less than least[i] may be
    missing. scored gets the number of rows of c that each row of q was multiplied with."""
    m, out = len(c), []
    order = np.argsort(c, axis=0, kind="stable")
    floor = np.full(len(q), -np.inf) if least is None else least
    for x, mine, low in zip(q, own, floor, strict=True):
        dims = np.flatnonzero(x)
        up = x[dims] > 0
        seen = ids == mine
        best, score = np.zeros(0, np.int64), np.zeros(0, c.dtype)
        depth, step, n = 0, max(16, 4 * k), 0
        while depth < m:
            last = min(m, depth + step) if len(dims) else m
            met = np.zeros(m, bool)
            if len(dims):
                met[order[m - last : m - depth, dims[up]]] = True
                met[order[depth:last, dims[~up]]] = True
            else:
                met[:] = True
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            n += len(new)
            best, score = np.concatenate([best, new]), np.concatenate([score, c[new] @ x])
            top = _best(best, score, k)
            best, score = best[top], score[top]
            depth, step = last, 2 * step
            bar = max(low, score[-1] if len(score) == k else -np.inf)
            if depth < m:
                edge = np.where(up, order[m - depth, dims], order[depth - 1, dims])
                if (c[edge, dims] * x[dims]).sum() < bar:
                    break
        out.append((ids[best], score))
        if scored is not None:
            scored.append(n)
    return out


def block_search(q: np.ndarray, qi: np.ndarray, c: np.ndarray, ci: np.ndarray, k: int, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """threshold_search over int64 rows: rows with large components are multiplied one by one in whole numbers, the others in floats, where products are exact."""
    big_q, big_c = _large(q), _large(c)
    got: list = [None] * len(q)
    small = threshold_search(q[~big_q].astype(float), c[~big_c].astype(float), ci[~big_c], qi[~big_q], k, least[~big_q])
    for i, (ids, score) in zip(np.flatnonzero(~big_q), small, strict=True):
        got[i] = ids, score.astype(np.int64)
    for i in range(len(q)) if big_c.any() else np.flatnonzero(big_q):
        rest = np.flatnonzero((big_c | big_q[i]) & (ci != qi[i]))
        x = q[i].tolist()
        score = [max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(x, row, strict=True)))) for row in c[rest].tolist()]
        ids = np.concatenate([got[i][0] if got[i] else np.zeros(0, np.int64), ci[rest]])
        score = np.concatenate([got[i][1] if got[i] else np.zeros(0, np.int64), np.array(score, np.int64)])
        top = sorted(range(len(ids)), key=lambda j: (-int(score[j]), ids[j]))[:k]
        got[i] = ids[top], score[top]
    return got


def _rows(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and vectors, without repeats."""
    if part.empty:
        return np.zeros(0, np.int64), np.zeros((0, 1), np.int64)
    ids, v = part["vec_id"].to_numpy(np.int64), np.stack(part["v"].to_numpy()).astype(np.int64)
    both = np.unique(np.concatenate([ids[:, None], v], 1), axis=0)
    return both[:, 0], both[:, 1:]


def search(vectors: DataFrame, is_query: Column, k: int = 10, block: int = 16_384, query_block: int = 4_096) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query; vectors has vec_id and v (integers).

    is_query is over vec_id. A group holds about block + query_block vectors, at any size."""
    queries = vectors.where(is_query)
    sizes = vectors.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    nb, nq = max(1, -(-sizes["n"] // block)), max(1, -(-sizes["q"] // query_block))
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda lo, hi: F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)))
    kind = "query_id long, vec_id long, score long"

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        (qi, qv), (ci, cv) = _rows(a), _rows(b)
        _, first = np.unique(qi, return_index=True)
        qi, qv = qi[first], qv[first]
        got = []
        if len(qi) and len(ci):
            told = dict(zip(a["vec_id"], a["least"], strict=True))
            least = np.array([told[i] for i in qi.tolist()], float)
            for i, (ids, score) in zip(qi, block_search(qv, qi, cv, ci, k, np.where(np.isnan(least), -np.inf, least)), strict=True):
                got.append(pd.DataFrame({"query_id": i, "vec_id": ids, "score": score}))
        return pd.concat(got) if got else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)

    def near(lo: int, hi: int, asked: DataFrame) -> DataFrame:
        """The k best of every query in each of the blocks from lo on."""
        left = asked.select(F.size("v").alias("d"), every(lo, hi).alias("c"), deal(nq, 2).alias("q"), "vec_id", "v", "least")
        right = vectors.where(deal(nb, 1).between(lo, hi - 1)).select(F.size("v").alias("d"), deal(nb, 1).alias("c"), every(0, nq).alias("q"), "vec_id", "v")
        return left.groupBy("d", "c", "q").cogroup(right.groupBy("d", "c", "q")).applyInPandas(pair, kind)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    unasked = queries.withColumn("least", F.lit(None).cast("double"))
    got = near(0, 1, unasked)
    if nb > 1:
        first = cut(got)
        # a double may round a long up: one step down keeps the bar below the true kth score
        bar = first.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), (F.col("score") - F.abs(F.col("score")) * 1e-15 - 1).alias("least"))
        got = first.unionByName(near(1, nb, cut(queries.join(bar, "vec_id", "left"))))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(spark, embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    return search(quantise(embeddings), F.col("vec_id") % every == 0, k)
