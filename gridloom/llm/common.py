"""Shared pieces: durable cuts of lineage, hold-out keys, vectorised word hashing."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, scratch, shared_dir

__all__ = ["crc_mod", "cut", "free_name", "hold", "mix", "scratch", "shared_dir", "small_batches", "table", "text_chunks", "word_hashes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000):
    """Within it at most so many rows make a batch for Python workers: whole texts may be long, and memory is bounded by a batch.

    The session's own setting comes back after it, so what is to run in such batches is written within."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    if not 0 < int(was) <= rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, was)


_held: dict = {}


def hold(name, make=dict):
    """What a worker process remembers for one operator over its tasks; another operator's call drops it."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


#: Bytes of a word after lower-casing: ASCII letters and digits, and every byte of a non-ASCII character.
_WORD = np.zeros(256, bool)
_WORD[0x80:] = True
for _r in (b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
    _WORD[list(_r)] = True

_P, _INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for i, base in enumerate((_P, _INV)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _powers[i] = np.multiply.accumulate(t)
    return _powers[0], _powers[1]


def text_chunks(array, limit: int = 1 << 20):
    """Row ranges (first, past the last) of an Arrow string array with at most limit bytes each; a longer text is alone."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(array).fill_null(0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield first, i
            first, total = i, 0
        total += int(n)
    if len(sizes) > first:
        yield first, len(sizes)


def word_hashes(array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit ids of the words of an Arrow string array, in order, and the row of each.

    A word is a longest run of ASCII letters, ASCII digits and non-ASCII characters of the
    lower-cased text. Nulls have none. Ids depend on the word's bytes alone."""
    import pyarrow as pa
    import pyarrow.compute as pc

    low = pc.utf8_lower(array.fill_null("").cast(pa.large_string()))
    if isinstance(low, pa.ChunkedArray):
        low = low.combine_chunks()
    _, off, data = low.buffers()
    off = np.frombuffer(off, np.int64)[low.offset : low.offset + len(low) + 1]
    lo, hi = int(off[0]), int(off[-1])
    if hi == lo:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    d = np.frombuffer(data, np.uint8)[lo:hi]
    off = off - lo
    w = _WORD[d]
    cut_at = np.zeros(len(d) + 1, bool)
    cut_at[off] = True
    before = np.empty(len(d), bool)
    before[0], before[1:] = False, w[:-1]
    start = np.flatnonzero(w & (~before | cut_at[:-1]))
    after = np.empty(len(d), bool)
    after[-1], after[:-1] = False, w[1:]
    stop = np.flatnonzero(w & (~after | cut_at[1:])) + 1
    up, down = _power_tables(len(d))
    sums = np.zeros(len(d) + 1, np.uint64)
    np.cumsum((d.astype(np.uint64) + np.uint64(1)) * up[: len(d)], out=sums[1:])
    h = (sums[stop] - sums[start]) * down[start]
    return mix(h + (stop - start).astype(np.uint64)), np.searchsorted(off, start, "right") - 1
