"""Whole frames of any height: corner turn and two-dimensional float transform of all lines as one look.

No task holds a column. The turn moves tiles of BLOCK lines and writes samples. The transform along
the columns takes two steps over packed lines, each a shuffle of whole lines: line r of n1 * n2 is
r1 * n2 + r2, a task first holds all r1 of a few r2, then all r2 of a few k1, and the line that comes
out is k1 + n1 * k2. A height without such factors is transformed as a cyclic convolution with a chirp
over a power of two, which takes one shuffle more."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import longline, tiles

#: Lines of a block of the turn, samples that a task of a step aims at, and those that one may hold.
BLOCK, AIM, MOST = 1024, 1 << 19, 1 << 21
LONG = "row long, col int, re long, im long"


def turn(rows: DataFrame, w: int, block: int = BLOCK) -> DataFrame:
    """row, col, re, im of the corner turn of a whole integer frame (row, re, im) of w columns: sample c of line r is sample r of line c.
    Only lines that are there give samples; line numbers must be unique."""

    def marked(x: np.ndarray, at: np.ndarray, first: int) -> np.ndarray:
        return np.concatenate([x, np.broadcast_to(~np.isnan(at), x.shape)], 2)

    def samples(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for at in tiles.chunks(p.num_rows, 2 * block):
                some = p.slice(at.start, at.stop - at.start)
                x, row = tiles.planes(some.column("iq"), 2 * block, "<i8"), some.column("row").to_numpy(zero_copy_only=False)
                line, k = np.nonzero(x[:, 0, block:])
                cols = [pa.array(row[line] % w), pa.array((row[line] // w * block + k).astype("i4")), *(pa.array(x[line, i, k]) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays(cols, ["row", "col", "re", "im"])

    lines = tiles.pack(rows, w, "<i8").withColumn("at", F.col("row").cast("double"))
    return tiles.turn(lines, block, w, "<i8", axis="at", then=marked).select("row", "iq").mapInArrow(samples, LONG)


def shape(h: int, w: int) -> tuple[int, int] | None:
    """n1 <= n2 with n1 * n2 = h, as near as can be; None if n2 lines of w samples are too many for a task."""
    n1 = next(k for k in range(math.isqrt(h), 0, -1) if h % k == 0)
    return (n1, h // n1) if h // n1 * w <= MOST else None


def _complex(column, w: int) -> np.ndarray:
    x = tiles.planes(column, w, "<f8")
    return x[:, 0] + 1j * x[:, 1]


def _lines(row: np.ndarray, z: np.ndarray) -> dict:
    z = z.reshape(row.size, -1)
    return {"row": pa.array(row.ravel().astype(np.int64)), "iq": tiles.binaries(np.stack([z.real, z.imag], 1), "<f8")}


def _roots(power: np.ndarray, n: int) -> np.ndarray:
    return np.exp(-2j * np.pi * (power % n / n))


def _chirp(i: np.ndarray, h: int) -> np.ndarray:
    return _roots(i * i, 2 * h)  # exact: below 2**62


def _columns(lines: DataFrame, n1: int, n2: int, w: int, then) -> DataFrame:
    """A group is all lines r1 * n2 + r2 of a few r2: then(n1 x few x w, r1, r2) gives their new numbers and values. Lines without values only make a group."""
    few = max(1, AIM // (n1 * w))

    def run(t: pa.Table) -> pa.Table:
        first = t.column("row")[0].as_py() % n2 // few * few
        t = t.filter(pc.is_valid(t.column("iq")))
        row, (a, b) = t.column("row").to_numpy(), np.ogrid[:n1, first : min(n2, first + few)]
        z = np.zeros((n1, b.size, w), complex)
        if len(row):
            z[row // n2, row % n2 - first] = _complex(t.column("iq"), w)
        return pa.table(_lines(*then(z, a, b)))

    return lines.groupBy(F.expr(f"row % {n2} div {few}")).applyInArrow(run, tiles.PACKED)


def _rows(lines: DataFrame, n1: int, n2: int, w: int, then) -> DataFrame:
    """A group is all lines k1 * n2 + r2 of a few k1: then(few x n2 x w, k1, r2) gives their new numbers and values."""
    few = max(1, AIM // (n2 * w))

    def run(t: pa.Table) -> pa.Table:
        row = t.column("row").to_numpy()
        first = row[0] // n2 // few * few
        a, b = np.ogrid[first : min(n1, first + few), :n2]
        z = np.zeros((a.size, n2, w), complex)
        z[row // n2 - first, row % n2] = _complex(t.column("iq"), w)
        return pa.table(_lines(*then(z, a, b)))

    return lines.groupBy(F.expr(f"row div {n2} div {few}")).applyInArrow(run, tiles.PACKED)


def _factored(lines: DataFrame, n1: int, n2: int, w: int, number) -> DataFrame:
    def first(z, a, b):
        return a * n2 + b, np.fft.fft(z, axis=0) * _roots(a * b, n1 * n2)[..., None]

    def second(z, a, b):
        return number(a + n1 * b), np.fft.fft(z, axis=1)

    return _rows(_columns(lines, n1, n2, w, first), n1, n2, w, second)


def _by_chirp(lines: DataFrame, h: int, w: int, number) -> DataFrame:
    """nk = (n^2 + k^2 - (k - n)^2) / 2; the chirp that lines are convolved with goes as one sample more of each line."""
    n1, n2 = longline.shape(2 * h - 1)
    n = n1 * n2

    def first(z, a, b):
        r = a * n2 + b
        far = np.minimum(r, n - r)
        z = z * np.where(r < h, _chirp(r, h), 0)[..., None]
        z = np.concatenate([z, np.where(far < h, _chirp(far, h).conj(), 0)[..., None]], 2)
        return r, np.fft.fft(z, axis=0) * _roots(a * b, n)[..., None]

    def middle(z, a, b):
        z = np.fft.fft(z, axis=1)
        return a * n2 + b, np.fft.ifft(z[..., :w] * z[..., w:], axis=1) * _roots(a * b, n).conj()[..., None]

    def last(z, a, b):
        r = a * n2 + b
        on = r < h
        return number(r[on]), (np.fft.ifft(z, axis=0) * _chirp(r, h)[..., None])[on]

    groups = lines.sparkSession.range(n2).select(F.col("id").alias("row"), F.lit(None).cast("binary").alias("iq"))
    return _columns(_rows(_columns(lines.unionByName(groups), n1, n2, w, first), n1, n2, w + 1, middle), n1, n2, w, last)


def fft2(rows: DataFrame, h: int, w: int, taper: bool = False) -> DataFrame:
    """row, re, im (arrays) of the centred float transform of a whole frame (row, re, im) of h lines of w samples, of any h. Missing lines
    count as zeros, line numbers must be unique. With taper, under the outer product of two Hamming windows."""
    mid = h // 2
    hamming = lambda i, n: 0.54 - 0.46 * np.cos(2 * np.pi * i / max(1, n - 1))

    def across(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for at in tiles.chunks(p.num_rows, w):
                x, row = tiles.listed(p, at, w), p.column("row").slice(at.start, at.stop - at.start).to_numpy(zero_copy_only=False)
                z = x[:, 0] + 1j * x[:, 1]
                z = z * (hamming(row, h)[:, None] * hamming(np.arange(w), w)) if taper else z
                z = np.fft.fftshift(np.fft.fft(np.fft.ifftshift(z, axes=1), axis=1), axes=1)
                yield pa.RecordBatch.from_pydict(_lines((row - mid) % h, z))

    lines = rows.select("row", "re", "im").mapInArrow(across, tiles.PACKED)
    if h:
        number, by = (lambda k: (k + mid) % h), shape(h, w)
        lines = _factored(lines, *by, w, number) if by else _by_chirp(lines, h, w, number)
    return tiles.unpack(lines, w, "<f8", "double")
