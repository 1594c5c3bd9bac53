"""Near-duplicate classes by DartMinHash over word shingles.

A text is a weighted set: the runs of five words with their multiplicities. Every element owns a
region of the plane weight x rank as wide as its weight, cut into unit cells. Hashed darts fall on
a cell at the arrival times of a Poisson process that depends on the cell alone, so any two texts
see the same darts where their regions overlap; each dart names one of K coordinates, and the
earliest dart of a coordinate is its signature value. Darts are thrown up to a rank that fills all
coordinates of a text of that weight with high probability, and again up to twice the rank where
one stays empty. Two texts agree in a coordinate with their weighted Jaccard similarity.

Joining. Texts of equal bytes are one class from the start. Signatures are cut into bands; buckets
of equal members are kept once; each member of a bucket is linked to the bucket's first member if
signatures and then the exact similarity of the shingles say so. Components of the links are found
by alternating large-star and small-star steps. What is left are buckets with members in different
components: there the members are compared block by block (blocks of bounded size, so a bucket of
any size is spread), by signature first and then exactly, and only links between different
components are emitted. No bucket is capped and no group emits all its pairs.

Words are longest runs of letters, digits and non-ASCII characters of the lower-cased text.

Defined cases: a null text is a class of its own; texts without words are alike only if equal;
texts of one to four words have one shingle, the whole; of equal texts the smallest id names the
class; rows with a null id take no part; repeated ids are one document, whose texts all count;
extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hold, mix, scratch, small_batches, text_chunks, word_hashes

#: Coordinates, rows a band, words a shingle, least similarity.
K, ROWS, SHINGLE, SIMILAR = 120, 5, 5, 0.8
#: Share of equal coordinates below which no exact comparison is made: four deviations below SIMILAR.
LIKELY = SIMILAR - 4 * math.sqrt(SIMILAR * (1 - SIMILAR) / K)
BLOCK = 512
#: Ids that may be broadcast, 8 bytes each.
BROADCAST_IDS = 2_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def cells(array) -> tuple[np.ndarray, np.ndarray]:
    """Unit cells (uint64) of the shingles of an Arrow string array, and the row of each; rows ascend.

    The nth occurrence of a shingle in a text is a cell of its own."""
    h, row = word_hashes(array)
    n = np.bincount(row, minlength=len(array))
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    width = np.minimum(n[row], SHINGLE)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])[row]
    place = np.arange(len(h)) - first
    opens = place + width <= n[row]
    opens &= (n[row] >= SHINGLE) | (place == 0)
    at = np.flatnonzero(opens)
    s = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        on = width[at] > k
        s = mix(s * _GOLD + np.uint64(k + 1) + np.where(on, h[np.minimum(at + k, len(h) - 1)], np.uint64(0)))
    own = row[at]
    order = np.lexsort((s, own))
    s, own = s[order], own[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (own[1:] != own[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    nth = (np.arange(len(s)) - start).astype(np.uint64)
    return mix(s + nth * _GOLD), own


def darts(cell: np.ndarray, own: np.ndarray, n_rows: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Signatures (n_rows x K, uint32) of rows of cells; rows without cells have zeros.

    weight, if given, is the part of each unit cell that the element's region covers (0 to 1)."""
    total = np.bincount(own, weight, minlength=n_rows)
    value = np.zeros((n_rows, K), np.uint32)
    todo = np.flatnonzero(total > 0)
    reach = K * (math.log(K) + 3)
    while len(todo):
        number = np.full(n_rows, -1)
        number[todo] = np.arange(len(todo))
        keep = number[own] >= 0
        c, r = cell[keep], number[own[keep]]
        w = None if weight is None else weight[keep]
        limit = (reach / total[todo])[r]
        best = np.full(len(todo) * K, np.inf)
        sig = np.zeros(len(todo) * K, np.uint32)
        t, i = np.zeros(len(c)), 1
        while len(c):
            x = mix(c + np.uint64(i * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
            t = t - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            on = t < limit
            c, r, t, limit, x = c[on], r[on], t[on], limit[on], x[on]
            w = None if w is None else w[on]
            y = mix(x ^ _GOLD)
            slot = r * K + (y >> np.uint64(40)).astype(np.int64) % K
            name = (y & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            rank, hit = t, slice(None)
            if w is not None:
                hit = ((mix(y) >> np.uint64(11)).astype(np.float64) * 2.0**-53) < w
                slot, name, rank = slot[hit], name[hit], t[hit]
            np.minimum.at(best, slot, rank)
            won = best[slot] == rank
            sig[slot[won]] = name[won]
            i += 1
        full = np.isfinite(best).reshape(-1, K).all(1)
        value[todo[full]] = sig.reshape(-1, K)[full]
        todo, reach = todo[~full], 2 * reach
    return value


def band_keys(sig: np.ndarray) -> np.ndarray:
    """n x (K / ROWS) 64-bit keys, different for different bands."""
    s = sig.reshape(len(sig), K // ROWS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(K // ROWS, dtype=np.uint64), s.shape[:2]).copy()
    for k in range(ROWS):
        h = mix(h * _GOLD + s[:, :, k] + np.uint64(1))
    return h.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """id, h1, h2 (hash of the text), n (cells), sig (binary), bands (array<long>, empty without words)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("neardup")
        for part in parts:
            text = part.column("text")
            for a, b in text_chunks(text):
                cell, own = cells(text.slice(a, b - a))
                n = np.bincount(own, minlength=b - a)
                sig = darts(cell, own, b - a)
                keys = band_keys(sig)
                on = n > 0
                off = np.concatenate([[0], np.cumsum(on * keys.shape[1])]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(off), pa.array(keys[on].ravel()))
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * K), b - a, [None, pa.py_buffer(np.ascontiguousarray(sig, "<u4"))]).cast(pa.binary())
                rest = [part.column(c).slice(a, b - a) for c in ("id", "h1", "h2")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(n.astype(np.int64)), raw, bands], ["id", "h1", "h2", "n", "sig", "bands"])

    t = F.col("text")
    return (
        docs.where(F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(t, F.lit(1)).alias("h1"), F.xxhash64(t, F.lit(2), F.length(t)).alias("h2"), "text")
        .mapInArrow(run, "id long, h1 long, h2 long, n long, sig binary, bands array<long>")
    )


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets of cells, each without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def only(rows: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    """The rows whose id is among n_ids ids; these are broadcast if they were counted to be few, else both sides are shuffled."""
    return rows.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, "id", "left_semi")


def cell_sets(docs: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    """id and cells (binary, sorted uint64) of the documents whose id is in ids, a row a text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("neardup")
        for part in parts:
            text = part.column("text")
            for a, b in text_chunks(text):
                cell, own = cells(text.slice(a, b - a))
                order = np.lexsort((cell, own))
                raw = cell[order].astype("<u8").tobytes()
                ends = np.cumsum(np.bincount(own, minlength=b - a)) * 8
                off = np.concatenate([[0], ends]).astype(np.int64)
                big = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(off), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([part.column("id").slice(a, b - a), big.cast(pa.binary())], ["id", "cells"])

    return only(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), ids, n_ids).mapInArrow(run, "id long, cells binary")


def likely_pairs(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs a, b whose signatures agree in at least LIKELY of their coordinates."""
    left = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa"))
    right = sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                x, y = (np.frombuffer(b"".join(p[c]), "<u4").reshape(-1, K) for c in ("sa", "sb"))
                yield p.loc[(x == y).mean(1) >= LIKELY, ["a", "b"]]

    return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long")


def true_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b that are similar in truth."""
    left = sets.select(F.col("id").alias("a"), F.col("cells").alias("ca"))
    right = sets.select(F.col("id").alias("b"), F.col("cells").alias("cb"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                on = [alike(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) >= SIMILAR for x, y in zip(p["ca"], p["cb"], strict=True)]
                yield p.loc[np.array(on, bool), ["a", "b"]]

    return pairs.join(right, "b").join(left, "a").select("a", "b", "ca", "cb").mapInPandas(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id and root (the smallest id of its component) of every id in links (columns a, b).

    Large-star hangs a node's larger neighbours on its smallest one, small-star the smaller ones and
    itself; once neither changes an edge, every edge is (id, root). The table of nodes and their
    smallest neighbours is broadcast if its rows were counted to be few; else it is written, so that
    the join with it splits a hot node."""
    with scratch(links.sparkSession) as keep:
        e = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
        count = lambda e: e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        mark = count(e)
        while True:
            few = 2 * mark["n"] <= BROADCAST_IDS  # an edge names two nodes at most, and no step makes more edges
            once, side = (lambda df: df, F.broadcast) if few else (keep, keep)
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = side(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
            large = once(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
            low = side(large.groupBy("u").agg(F.min("v").alias("m")))
            small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
            e = keep(small)
            now = count(e)
            if mark == now:
                return cut(e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()))
            mark = now


def buckets(bands: DataFrame, cut=cut) -> DataFrame:
    """key, id, m (members) and a (the first one) of every bucket with two members or more; of buckets with equal members one is kept.

    bands has id and bands. Keys are counted first, so that only rows of shared keys go further."""
    rows = bands.select("id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").count().where("count > 1").select("key")
    some = cut(rows.join(shared, "key").distinct())
    seen = some.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("a"), F.bit_xor(F.xxhash64("id")).alias("x"))
    once = seen.where("m > 1").groupBy("m", "a", "x").agg(F.min("key").alias("key"))
    return some.join(once.select("key", "m", "a"), "key")


def leftovers(members: DataFrame, roots: DataFrame, sigs: DataFrame, sets: DataFrame, cut=cut) -> DataFrame:
    """Links a, b between different components within buckets of three or more whose members lie in several.

    Every pair of blocks of a bucket is a group of bounded size. First the members that have a likely
    partner in another component are found by signature; then, among these alone, pairs are compared
    exactly while their components differ, and a link joins these for the pairs to come."""
    named = members.where("m > 2").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = cut(named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"))  # a table, so that the join splits a hot key
    named = named.join(mixed, "key").withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    dealt = named.withColumn("own", own).withColumn("other", other)
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).select("key", "i", "j", "id", "root", "own")

    def likely(sig, block, k):
        on = (sig[:k] == sig[k]).mean(1)
        if block[0] != block[-1] or (block != block[0]).any():
            on = np.where(block[:k] == block[k], 0.0, on)  # pairs within a block meet in that block's own group
        return on

    def flag(p: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(p["sig"]), "<u4").reshape(-1, K)
        block, root = p["own"].to_numpy(), p["root"].to_numpy()
        keep = np.zeros(len(p), bool)
        for k in range(1, len(p)):
            hit = (likely(sig, block, k) >= LIKELY) & (root[:k] != root[k])
            if hit.any():
                keep[k] = True
                keep[:k] |= hit
        return p[keep]

    def join(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id", kind="stable")
        sig = np.frombuffer(b"".join(p["sig"]), "<u4").reshape(-1, K)
        ids, block, root = p["id"].to_numpy(), p["own"].to_numpy(), p["root"].tolist()
        cs = [np.frombuffer(c, "<u8") for c in p["cells"]]
        up = {r: r for r in root}

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for k in range(1, len(ids)):
            share = likely(sig, block, k)
            near = np.flatnonzero(share >= LIKELY)
            for q in near[np.argsort(-share[near], kind="stable")]:
                x, y = find(root[q]), find(root[k])
                if x != y and alike(cs[q], cs[k]) >= SIMILAR:
                    up[max(x, y)] = min(x, y)
                    out.append((ids[q], ids[k]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    kind = "key long, i int, j int, id long, root long, own int, sig binary"
    flagged = dealt.join(sigs.select("id", "sig"), "id").select("key", "i", "j", "id", "root", "own", "sig").groupBy("key", "i", "j").applyInPandas(flag, kind)
    return flagged.join(sets, "id").groupBy("key", "i", "j").applyInPandas(join, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id (the smallest id of its class) of every document with an id.

    Equal texts meet through the first of them alone, so that copies never enter the component search."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        with small_batches(spark):
            sigs = keep(signatures(docs))
        narrow = sigs.select("id", "h1", "h2", "n")
        equal = keep(narrow.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep")))  # as a table, so that the join may split a hot text
        null = F.xxhash64(F.lit(None).cast("string"), F.lit(1)), F.xxhash64(F.lit(None).cast("string"), F.lit(2), F.lit(None).cast("int"))
        alone = (F.col("h1") == null[0]) & (F.col("h2") == null[1])
        reps = keep(narrow.join(equal, ["h1", "h2", "n"]).select("id", F.when(alone, F.col("id")).otherwise(F.col("rep")).alias("rep"), "n").distinct())
        first = reps.where("id = rep and n > 0").select("id").distinct()
        members = keep(buckets(sigs.where("n > 0").select("id", "bands").join(first, "id", "left_semi"), keep))
        ids = keep(members.select("id").distinct())
        n_ids = ids.count()
        some = keep(only(sigs.select("id", "sig", "n").where("n > 0"), ids, n_ids))
        pairs = members.where("id <> a").select("a", F.col("id").alias("b")).distinct()
        likely = keep(likely_pairs(pairs, some).distinct())
        with small_batches(spark):
            sets = keep(cell_sets(docs, ids, n_ids))
        links = keep(true_links(likely, sets))
        more = keep(leftovers(members, components(links), some, sets, keep))
        own = keep(reps.groupBy("id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last")))
        several = reps.join(own.where("rep <> last").select("id"), "id", "left_semi").select(F.col("rep").alias("a"), F.col("id").alias("b"))  # the texts of a repeated id
        root = components(links.unionByName(more).unionByName(several))
        known = own.join(root.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("root", "rep").alias("class_id"))
        rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"))
        return rows.join(cut(known), F.col("doc_id") == F.col("id")).select("doc_id", "class_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of every class, with all its columns.

    It is a row whose id names the class; if that id is repeated, the row whose text has the smallest
    hash. Rows with a null id take part by a large key made of their values, so a row with an id names
    the class before them, and rows that are equal in every column count as one.

    The ids to keep are counted first: texts stay where they are as long as these may be broadcast, and
    are shuffled once beyond; rows of repeated ids are the only ones that are ranked."""
    spare = F.xxhash64(*[docs[f"`{f.name}`"] for f in docs.schema if "map" not in f.dataType.simpleString()]).bitwiseAND(F.lit((1 << 63) - 1)).bitwiseOR(F.lit(1 << 62))
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), spare).alias("id"))
    named = cut(classes(keyed.select(F.col("id").alias("doc_id"), "row.text")).where("doc_id = class_id").groupBy(F.col("doc_id").alias("id")).count())
    n_once, n_again = named.agg(F.count_if(F.col("count") == 1), F.count_if(F.col("count") > 1)).first()
    once = only(keyed, named.where("count = 1").select("id"), n_once).select("row.*")
    if not n_again:
        return once
    again = only(keyed, named.where("count > 1").select("id"), n_again)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("row.text")))  # each task keeps its first row of an id before the shuffle
    return once.unionByName(again.withColumn("place", place).where("place = 1").select("row.*"))


def op7(spark, docs: DataFrame) -> DataFrame:
    return classes(docs.select("doc_id", "text"))
