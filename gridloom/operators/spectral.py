"""Row transforms over array frames (row, re, im) in exact integers or floats, with block exponents.

Two forms of one arithmetic: NumPy over Arrow batches (lines, line_pass), which forms images of any
size with one evaluation a pass and a plan that does not grow with the line; and column expressions
(a projection a butterfly stage, JVM only) for short lines, against which it is held. Scaling rules:
l1     one exponent a pass from the largest row L1 norm, before the transform; saturating output
global full-precision transform, then one exponent from the largest output
perrow a row's own shift after every stage; exponents join back for the global renormalisation
uncond every stage halves both operands"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..sources.frames import to_long, to_rows
from ..sources.shared import cut
from . import tiles

ROWS = "row long, re array<long>, im array<long>"


def _ints(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def bit_reversed(rows: DataFrame, n: int) -> DataFrame:
    order = F.array(*[F.lit(i) for i in fx.reversed_order(n)])
    return rows.withColumns({"re": F.transform(order, lambda i: F.get("re", i)), "im": F.transform(order, lambda i: F.get("im", i))})


def butterfly(rows: DataFrame, n: int, stage: int, halve: bool = False, clip: bool = False, wide: bool = False) -> DataFrame:
    """One radix-2 stage over bit-reversed lines; products are floored after their Q15 shift, or kept with all bits (wide)."""
    m = 1 << stage
    mh = m // 2
    wr, wi = map(_ints, fx.twiddles(n))
    down = (lambda x: fx.shr(x, 1)) if halve else (lambda x: x)
    keep = fx.sat16 if clip else (lambda x: x)

    def out(part: str):
        def at(i):
            k = (i % mh).cast("int")
            up = (i - i % m + k).cast("int")
            tw = (k * (n // m)).cast("int")
            br, bi = down(F.get("re", up + mh)), down(F.get("im", up + mh))
            c, d = F.get(wr, tw), F.get(wi, tw)
            prod = c * br - d * bi if part == "re" else c * bi + d * br
            t = prod if wide else keep(fx.shr(prod, 15))
            a = fx.shr(F.get(part, up), -15) if wide else down(F.get(part, up))
            return F.when(i % m < mh, a + t).otherwise(a - t)

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)

    rest = [c for c in rows.columns if c not in ("re", "im")]
    # other names first: within one projection a lambda would take the new re for the old one
    return rows.select(*rest, out("re").alias("_re"), out("im").alias("_im")).withColumnsRenamed({"_re": "re", "_im": "im"})


def _peak(*cols: str) -> Column:
    return F.greatest(*[F.coalesce(F.array_max(F.transform(c, F.abs)), F.lit(0).cast("long")) for c in cols])


def _map(rows: DataFrame, f) -> DataFrame:
    return rows.withColumns({c: F.transform(c, f) for c in ("re", "im")})


def fft_full(rows: DataFrame, n: int) -> DataFrame:
    """Wide-integer transform of every row without scaling."""
    out = bit_reversed(rows, n)
    for s in range(1, n.bit_length()):
        out = butterfly(out, n, s)
    return out


def row_l1(rows: DataFrame) -> DataFrame:
    """row, l1: the sum of |re| + |im|."""
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s + F.abs(v))
    return rows.select("row", (add("re") + add("im")).alias("l1"))


def pass_l1(rows: DataFrame, n: int) -> DataFrame:
    """One pass: rows with exp, the exponent shared by all of them."""
    e = row_l1(rows).agg(fx.l1_exponent(F.coalesce(F.max("l1"), F.lit(0))).alias("exp"))
    out = fft_full(rows, n).crossJoin(F.broadcast(e))  # one row
    return out.withColumns({c: F.transform(c, lambda v: fx.sat16(fx.shr(v, F.col("exp")))) for c in ("re", "im")})


def pass_global(rows: DataFrame, n: int) -> DataFrame:
    """One pass: full precision, then the exponent that fits the largest output."""
    full = fft_full(rows, n)
    e = full.agg(fx.shift_to_fit(F.coalesce(F.max(_peak("re", "im")), F.lit(0))).alias("exp"))
    out = full.crossJoin(F.broadcast(e))
    return out.withColumns({c: F.transform(c, lambda v: fx.sat16(fx.shr(v, F.col("exp")))) for c in ("re", "im")})


def pass_perrow(rows: DataFrame, n: int) -> DataFrame:
    """One pass with a block exponent a row (column exp)."""
    out = bit_reversed(rows, n).withColumn("exp", F.lit(0))
    for s in range(1, n.bit_length()):
        out = butterfly(out, n, s, clip=True)
        out = out.withColumn("_sh", fx.shift_to_fit(_peak("re", "im")))
        out = out.withColumns({c: F.transform(c, lambda v: fx.sat16(fx.shr(v, F.col("_sh")))) for c in ("re", "im")})
        out = out.withColumn("exp", F.col("exp") + F.col("_sh")).drop("_sh")
    return out


def scale_exponent(m: Column, full: int = fx.I16_MAX) -> Column:
    """The least e, of either sign, with m <= full * 2**e; 0 for m = 0."""
    up = fx.bit_length(F.floor((m + full - 1) / full).cast("long") - 1)
    return F.when(m == 0, 0).when(m > full, up).otherwise(1 - fx.bit_length(F.floor(F.lit(full) / F.greatest(m, F.lit(1))).cast("long")))


def _apply_shift(rows: DataFrame, e: DataFrame) -> DataFrame:
    out = rows.crossJoin(F.broadcast(e))  # one row
    out = out.withColumns({c: F.transform(c, lambda v: fx.sat16(fx.shr(v, F.col("_sh")))) for c in ("re", "im")})
    return cut(out.withColumn("exp", F.col("exp") + F.col("_sh")).drop("_sh"))


def pass_block(rows: DataFrame, n: int, rescale: bool = False) -> DataFrame:
    """One pass with a single exponent for the whole block, found anew after every stage.

    Without rescale the block is shifted down only when it overflows; with it, mantissas are scaled
    both ways so that the largest always fills the word, and products keep all bits until then. The
    exponent is an aggregate of everything, so each stage is cut to the shared folder."""
    top = lambda x: F.coalesce(F.max(_peak("re", "im")), F.lit(0).cast("long"))
    out = bit_reversed(rows.select("row", "re", "im"), n).withColumn("exp", F.lit(0))
    if rescale:
        out = cut(out)
        out = _apply_shift(out, out.agg(scale_exponent(top(out)).alias("_sh")))
    for s in range(1, n.bit_length()):
        out = cut(butterfly(out, n, s, clip=not rescale, wide=rescale))
        if rescale:
            out = _apply_shift(out.withColumn("exp", F.col("exp") - 15), out.agg(scale_exponent(top(out)).alias("_sh")))
        else:
            out = _apply_shift(out, out.agg(fx.shift_to_fit(top(out)).alias("_sh")))
    return out


def pass_uncond(rows: DataFrame, n: int) -> DataFrame:
    """One pass that halves both operands of every butterfly: the result is the transform over n."""
    out = bit_reversed(rows, n)
    for s in range(1, n.bit_length()):
        out = _map(butterfly(out, n, s, halve=True, clip=True), fx.sat16)
    return out


def renormalise(rows: DataFrame, exp: str = "exp", deep: int = 12) -> DataFrame:
    """Shifts every row to the largest exponent of all; a row more than deep below it becomes 0."""
    top = rows.agg(F.max(exp).alias("emax"))
    out = rows.crossJoin(F.broadcast(top))
    down = F.col("emax") - F.col(exp)
    return out.withColumns({c: F.transform(c, lambda v: F.when(down > deep, F.lit(0).cast("long")).otherwise(fx.shr(v, down))) for c in ("re", "im")})


def turn(rows: DataFrame, h: int, w: int) -> DataFrame:
    """Corner turn of the array form, of every look of h lines of w samples: one shuffle of tiles."""
    real = "double" in rows.schema["re"].dataType.simpleString()
    dtype = "<f8" if real else "<i8"
    return tiles.unpack(tiles.turn(tiles.pack(rows, w, dtype), h, w, dtype), h, dtype, "double" if real else "long")


def window_q15(rows: DataFrame, row_taper: list[int], col_taper: list[int]) -> DataFrame:
    """Both tapers folded into one Q15 coefficient first (wrapping), then one product a sample (wrapping). The row taper begins anew with every look."""
    wr = F.get(_ints(row_taper), (F.col("row") % len(row_taper)).cast("int"))
    wc = _ints(col_taper)
    fold = lambda x: F.transform(x, lambda v, i: fx.wrap16(fx.shr(v * fx.wrap16(fx.shr(wr * F.get(wc, i), 15)), 15)))
    return rows.withColumns({"re": fold(F.col("re")), "im": fold(F.col("im"))})


def detect_rows(rows: DataFrame) -> DataFrame:
    """row, col, mag."""
    return to_long(rows).select("row", "col", fx.detect(F.col("re"), F.col("im")).alias("mag"))


def _sat(x: np.ndarray) -> np.ndarray:
    return np.clip(x, fx.I16_MIN, fx.I16_MAX)


def line_kernel(x: np.ndarray, rule: str = "full") -> tuple[np.ndarray, np.ndarray]:
    """The staged transform over a block of lines (complex codes in two int64 planes: 2 x lines x n) and each line's exponent.

    rule: full keeps all bits, uncond halves both operands of every butterfly, perrow shifts a line
    after a stage by what its largest value takes. Lines are in bit-reversed places and change there."""
    n, x = x.shape[-1], x[..., fx.reversed_order(x.shape[-1])]
    wr, wi = (np.array(v, np.int64) for v in fx.twiddles(n))
    exp, place = np.zeros(x.shape[1], np.int64), np.arange(n)
    half, stride = 1, n // 2
    while half < n:
        up = place[place & half == 0]
        down = up + half
        c, d = wr[(up & (half - 1)) * stride], wi[(up & (half - 1)) * stride]
        a, (p, q) = x[..., up], x[..., down]
        if rule == "uncond":
            a, p, q = a >> 1, p >> 1, q >> 1
        t = np.stack([c * p - d * q, c * q + d * p]) >> 15
        t = t if rule == "full" else _sat(t)
        x[..., up], x[..., down] = a + t, a - t
        if rule == "uncond":
            x = _sat(x)
        elif rule == "perrow":
            top = np.abs(x).max(axis=(0, 2))
            by = np.where(top > fx.I16_MAX, np.frexp(((top + fx.I16_MAX) // fx.I16_MAX - 1).astype(float))[1], 0)
            x, exp = _sat(x >> by[:, None]), exp + by
        half, stride = 2 * half, stride // 2
    return x, exp


LINES = ROWS + ", exp int"


def lines(rows: DataFrame, n: int, rule: str = "full", shift: int = 0) -> DataFrame:
    """line_kernel over Arrow batches of lines of n samples: row, re, im, exp. A shift above 0 is applied at the end, saturating, and is the exponent."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for at in tiles.chunks(p.num_rows, n):
                y, exp = line_kernel(tiles.listed(p, at, n).transpose(1, 0, 2).astype(np.int64), rule)
                y, exp = (_sat(y >> shift), exp + shift) if shift else (y, exp)
                off = pa.array(np.arange(0, len(exp) * n + 1, n), pa.int32())
                row = p.column("row").slice(at.start, at.stop - at.start)
                yield pa.RecordBatch.from_arrays([row, *[pa.ListArray.from_arrays(off, pa.array(v.ravel())) for v in y], pa.array(exp, pa.int32())], ["row", "re", "im", "exp"])

    return rows.select("row", "re", "im").mapInArrow(run, LINES)


def fft_full_arrow(rows: DataFrame, n: int) -> DataFrame:
    """fft_full in NumPy over Arrow batches, for lines of any power-of-two length."""
    return lines(rows, n).drop("exp")


def line_pass(rows: DataFrame, n: int, scaling: str) -> DataFrame:
    """One pass over array lines in NumPy: row, re, im, exp. Same results as pass_l1, pass_global, pass_perrow and pass_uncond.

    Every line is transformed once. An exponent that all lines share is one number on the driver, from
    the lines before the transform (l1) or from the written transform (global)."""
    if scaling == "l1":
        e = row_l1(rows).agg(fx.l1_exponent(F.coalesce(F.max("l1"), F.lit(0))).alias("e")).first()["e"]
        out = lines(rows, n, "full", e)
        return out if e else _map(out, fx.sat16)
    if scaling == "global":
        full = cut(lines(rows, n))
        e = full.agg(fx.shift_to_fit(F.coalesce(F.max(_peak("re", "im")), F.lit(0))).alias("e")).first()["e"]
        return _map(full, lambda v: fx.sat16(fx.shr(v, e))).withColumn("exp", F.lit(e).cast("int"))
    return lines(rows, n, scaling)


def pad_lines(rows: DataFrame, h: int, w: int) -> DataFrame:
    """rows with lines of zeros behind the last one, up to a whole number of looks of h lines."""
    tall = rows.agg(F.max("row") + 1).first()[0] or 0
    zeros = F.array_repeat(F.lit(0).cast("long"), w)
    return rows.unionByName(rows.sparkSession.range(tall, -(-tall // h) * h).select(F.col("id").alias("row"), zeros.alias("re"), zeros.alias("im")))


def dft_direct(frame: DataFrame, n: int) -> DataFrame:
    """row, k, re, im of integer lines (row, col, re, im) by a direct sum over one table of n roots: floors each product."""
    wr, wi = fx.twiddles(n)
    roots = frame.sparkSession.createDataFrame([([*wr, *[-v for v in wr]], [*wi, *[-v for v in wi]])], "_c array<long>, _s array<long>")  # one row
    got = frame.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).crossJoin(F.broadcast(roots))
    at = (F.col("col").cast("long") * F.col("k") % n).cast("int")
    c, s = F.get("_c", at), F.get("_s", at)
    re, im = fx.shr(F.col("re") * c - F.col("im") * s, 15), fx.shr(F.col("im") * c + F.col("re") * s, 15)
    return got.groupBy("row", "k").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def fft2_arrow(rows: DataFrame, h: int, w: int, centred: bool = True, inverse: bool = False) -> DataFrame:
    """Float two-dimensional transform of every look of h lines of w samples, in the orientation given: NumPy over blocks of
    lines, corner turn, NumPy again, corner turn back. Missing lines count as zeros.

    centred moves the origin from and to the middle along both axes; inverse scales by 1 / (h w)."""

    def along(lines: DataFrame, n: int) -> DataFrame:
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for p in parts:
                for at in tiles.chunks(p.num_rows, n):
                    x = tiles.planes(p.column("iq").slice(at.start, at.stop - at.start), n, "<f8")
                    z = x[:, 0] + 1j * x[:, 1]
                    z = np.fft.ifftshift(z, axes=1) if centred else z
                    z = np.fft.ifft(z, axis=1) if inverse else np.fft.fft(z, axis=1)
                    z = np.fft.fftshift(z, axes=1) if centred else z
                    yield pa.RecordBatch.from_arrays([p.column("row").slice(at.start, at.stop - at.start), tiles.binaries(np.stack([z.real, z.imag], 1), "<f8")], ["row", "iq"])

        return lines.select("row", "iq").mapInArrow(run, tiles.PACKED)

    turned = tiles.turn(along(tiles.pack(rows, w, "<f8"), w), h, w, "<f8")
    return tiles.unpack(tiles.turn(along(turned, h), w, h, "<f8"), w, "<f8", "double")


def taper_float(rows: DataFrame, h: int, w: int) -> DataFrame:
    """Array form times the outer product of two Hamming windows, look by look."""
    a, b = (F.array(*[F.lit(v) for v in fx.hamming(k)]) for k in (h, w))
    k = F.get(a, (F.col("row") % h).cast("int"))
    one = lambda c: F.transform(F.col(c), lambda v, i: v * (k * F.get(b, i)))
    return rows.withColumns({"re": one("re"), "im": one("im")})


def quicklook(rows: DataFrame, h: int, w: int) -> DataFrame:
    """row, col, amp of the windowed float transform of every look, without resampling."""
    x = rows.select("row", *[F.transform(c, lambda v: v.cast("double")).alias(c) for c in ("re", "im")])
    return to_long(fft2_arrow(taper_float(x, h, w), h, w)).select("row", "col", F.hypot("re", "im").alias("amp"))


def focus(rows: DataFrame, h: int, w: int, spacing: tuple[float, float], negative: bool = True) -> tuple[DataFrame, tuple[float, float]]:
    """Pads every look to powers of two, transforms (the inverse for a positive phase sign) and rescales the pixel spacing.

    A look of h lines becomes one of as many lines as its padded height."""
    h2, w2 = (1 << (k - 1).bit_length() for k in (h, w))
    fill = lambda c: F.concat(F.transform(c, lambda v: v.cast("double")), F.array_repeat(F.lit(0.0), F.lit(w2) - F.size(c)))
    row = (F.floor(F.col("row") / h) * h2 + F.col("row") % h).cast("long")
    x = rows.select(row.alias("row"), fill("re").alias("re"), fill("im").alias("im"))
    return fft2_arrow(x, h2, w2, inverse=not negative), (spacing[0] * w / w2, spacing[1] * h / h2)


def phase_correlation(a: DataFrame, b: DataFrame, h: int, w: int) -> DataFrame:
    """look, dy, dx, peak: the cyclic shift that best aligns each look of frame b with that of frame a (array form, float)."""
    fa, fb = (to_long(fft2_arrow(x, h, w, False)) for x in (a, b))
    fb = fb.select("row", "col", F.col("re").alias("br"), F.col("im").alias("bi"))
    re = F.col("re") * F.col("br") + F.col("im") * F.col("bi")
    im = F.col("im") * F.col("br") - F.col("re") * F.col("bi")
    size = F.greatest(F.hypot(re, im), F.lit(1e-12))
    cross = fa.join(fb, ["row", "col"]).select("row", "col", (re / size).alias("re"), (im / size).alias("im"))
    back = to_long(fft2_arrow(to_rows(cross), h, w, False, inverse=True))
    look, best = F.floor(F.col("row") / h).cast("long").alias("look"), F.struct(F.col("re"), -F.col("row"), -F.col("col"))
    got = back.groupBy(look).agg(F.max_by(F.struct((F.col("row") % h).alias("row"), "col"), best).alias("at"), F.max("re").alias("peak"))
    return got.select("look", F.col("at.row").alias("dy"), F.col("at.col").alias("dx"), "peak")
