"""Transforms of lines that are too long for one task, and of even and odd halves under block exponents.

A long line of n1 * n2 samples is held as n1 packed lines of n2 (sample i in line i // n2). Its
transform takes four steps, each of whose tasks holds a strip of lines: turn and transform along n1,
multiply by the roots of the whole line, turn and transform along n2, turn into natural order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as fx
from . import tiles


def shape(n: int) -> tuple[int, int]:
    """n1, n2 of a line of at least n samples: powers of two, n1 at most twice n2."""
    bits = max(0, n - 1).bit_length()
    return 1 << (bits + 1) // 2, 1 << bits // 2


def along(lines: DataFrame, n: int, inverse: bool = False, roots: int = 0) -> DataFrame:
    """The float transform of every packed line; with roots, line r is then multiplied by the roots of order roots to the power r * k."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for at in tiles.chunks(p.num_rows, n):
                row = p.column("row").slice(at.start, at.stop - at.start)
                x = tiles.planes(p.column("iq").slice(at.start, at.stop - at.start), n, "<f8")
                z = x[:, 0] + 1j * x[:, 1]
                z = np.fft.ifft(z, axis=1) if inverse else np.fft.fft(z, axis=1)
                if roots:
                    turns = (row.to_numpy()[:, None] * np.arange(n, dtype=np.int64)) % roots / roots  # exact: below 2**62
                    z = z * np.exp((2j if inverse else -2j) * np.pi * turns)
                yield pa.RecordBatch.from_arrays([row, tiles.binaries(np.stack([z.real, z.imag], 1), "<f8")], ["row", "iq"])

    return lines.select("row", "iq").mapInArrow(run, tiles.PACKED)


def fft_long(lines: DataFrame, n1: int, n2: int, inverse: bool = False) -> DataFrame:
    """The transform of one line held as n1 packed float lines of n2 samples; in natural order, as n2 lines of n1."""
    turn = lambda x, h, w: tiles.turn(x, h, w, "<f8").select("row", "iq")
    first = along(turn(lines, n1, n2), n1, inverse, n1 * n2)  # line n / n2 behind the turn is n % n2: its roots are of power n2-index * k1
    second = along(turn(first, n2, n1), n2, inverse)
    return turn(second, n1, n2)


def rescale_exponent(top: np.ndarray) -> np.ndarray:
    """The least e, of either sign, with top <= 32767 * 2**e; 0 for 0."""
    bits = lambda x: np.frexp(x.astype(float))[1]
    up = bits((top + fx.I16_MAX - 1) // fx.I16_MAX - 1)
    down = 1 - bits(fx.I16_MAX // np.maximum(top, 1))
    return np.where(top == 0, 0, np.where(top > fx.I16_MAX, up, down))


def line_rescaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The staged transform of lines (2 x lines x n, int64) with an exponent a line, found anew after every stage in either direction."""
    n = x.shape[-1]
    x, exp = x[..., fx.reversed_order(n)], np.zeros(x.shape[1], np.int64)
    wr, wi = (np.array(v, np.int64) for v in fx.twiddles(n)) if n > 1 else (np.zeros(0, np.int64),) * 2
    place, half, stride = np.arange(n), 1, n // 2

    def scaled(x, exp, off):
        e = rescale_exponent(np.abs(x).max(axis=(0, 2)))
        by = e[:, None]
        moved = np.where(by >= 0, x >> np.maximum(by, 0), x << np.maximum(-by, 0))
        return np.clip(moved, fx.I16_MIN, fx.I16_MAX), exp + e - off

    x, exp = scaled(x, exp, 0)
    while half < n:
        up = place[place & half == 0]
        down = up + half
        c, d = wr[(up & (half - 1)) * stride], wi[(up & (half - 1)) * stride]
        a, (p, q) = x[..., up] << 15, x[..., down]
        t = np.stack([c * p - d * q, c * q + d * p])
        y = np.empty_like(x)
        y[..., up], y[..., down] = a + t, a - t
        x, exp = scaled(y, exp, 15)
        half, stride = 2 * half, stride // 2
    return x, exp


def line_split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A transform of n points from two of n / 2 over even and odd samples: the halves meet at the larger exponent, odd ones under Q15 roots,
    and the whole is shifted once more to fit 16 bits. Shifts of values drop bits towards 0. Returns mantissas and each line's exponent."""
    n = x.shape[-1]
    cut = lambda v, by: np.sign(v) * (np.abs(v) >> by)
    (even, ea), (odd, eb) = line_rescaled(x[..., 0::2]), line_rescaled(x[..., 1::2])
    e = np.maximum(ea, eb)
    even, odd = cut(even, (e - ea)[:, None]), cut(odd, (e - eb)[:, None])
    c, d = (np.array(v, np.int64) for v in fx.twiddles(n))
    t = cut(np.stack([c * odd[0] - d * odd[1], c * odd[1] + d * odd[0]]), 15)
    y = np.concatenate([even + t, even - t], axis=2)
    top = np.abs(y).max(axis=(0, 2))
    more = np.maximum(0, np.where(top > 0, np.frexp(np.maximum(top - 1, 0).astype(float))[1], 0) - 15)
    return cut(y, more[:, None]), e + more


def fft_split(rows: DataFrame, n: int) -> DataFrame:
    """row, re, im, exp of array lines of n samples by line_split, so that a transform twice as long as a unit takes is two of its own."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for at in tiles.chunks(p.num_rows, n):
                x = tiles.listed(p, at, n).transpose(1, 0, 2).astype(np.int64)
                y, exp = line_split(x)
                off = pa.array(np.arange(0, y.shape[1] * n + 1, n), pa.int32())
                cols = [pa.ListArray.from_arrays(off, pa.array(v.ravel())) for v in y]
                yield pa.RecordBatch.from_arrays([p.column("row").slice(at.start, at.stop - at.start), *cols, pa.array(exp, pa.int32())], ["row", "re", "im", "exp"])

    return rows.select("row", "re", "im").mapInArrow(run, "row long, re array<long>, im array<long>, exp int")


def samples(lines: DataFrame, n: int) -> DataFrame:
    """i, re, im of a long line in natural order, held as packed float lines of n."""
    a = tiles.unpack(lines, n, "<f8", "double")
    return a.select("row", F.posexplode(F.arrays_zip("re", "im")).alias("_c", "_v")).select((F.col("row") * n + F.col("_c")).alias("i"), "_v.re", "_v.im")
