"""Gathers that interpolate: brackets (as-of or computed), weights, and 2-, 4- and 32-tap kernels.

Endpoint and rounding rules are named options, since they differ between callers:
closed: left [x0, xn), right (x0, xn], both [x0, xn]. rounding: floor, half_up, half_even."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as fx
from .scan import running


def weight_q15(num: Column, den: Column, rounding: str = "floor") -> Column:
    """num / den in Q15, at most 32767."""
    if rounding == "floor":
        w = F.expr("0") + F.floor(num * 32768 / den)
    elif rounding == "half_up":
        w = F.floor(num * 32768.0 / den + 0.5)
    else:
        w = F.rint(num * 32768.0 / den)
    return F.greatest(F.lit(0), F.least(F.lit(32767), w.cast("int")))


def bracket(queries: DataFrame, samples: DataFrame, key: str, closed: str = "left", width: float | None = None, beyond: bool = False) -> DataFrame:
    """queries (key, q, ...) with x0, v0, x1, v1, the samples (key, x, v) around q; null where there is no bracket.

    One union and one sort: the last sample at or before and the first after, both by window, so the
    cost is linear in rows and no range join is planned. Samples of equal abscissa are ordered by value.

    With beyond, a column of that name says whether a query without a bracket lies behind the last sample.
    With a width, a key's axis is cut into stretches of that width, each a window of its own, so a key
    may hold any share of the rows; the samples next to a stretch come from a table of one row a
    stretch."""
    rest = [c for c in queries.columns if c not in (key, "q")]
    order = 1 if closed == "right" else 0  # of a sample against a query of equal abscissa
    s = samples.select(F.col(key), F.col("x").alias("_x"), F.lit(order).alias("_o"), F.struct("x", "v").alias("_s"), F.lit(None).alias("_q"))
    q = queries.select(F.col(key), F.col("q").alias("_x"), F.lit(1 - order).alias("_o"), F.lit(None).alias("_s"), F.struct("q", *rest).alias("_q"))
    both = s.unionByName(q).withColumn("_b", F.lit(0).cast("long") if width is None else F.floor(F.col("_x") / width).cast("long"))
    w = Window.partitionBy(key, "_b").orderBy("_x", "_o", "_s")
    lo = F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    hi = F.first("_s", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    if width is None:
        both = both.withColumns({"_lo": lo, "_hi": hi})
    else:
        along = Window.partitionBy("_k").orderBy("_kb")
        ends = both.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_kb")).agg(F.max("_s").alias("_max"), F.min("_s").alias("_min"))
        ends = ends.select(
            "_k", "_kb",
            F.last("_max", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
            F.first("_min", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
        )
        both = both.join(ends, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb")))
        both = both.withColumns({"_lo": F.coalesce(lo, F.col("_before")), "_hi": F.coalesce(hi, F.col("_after"))})
    lo, hi, x = F.col("_lo"), F.col("_hi"), F.col("_q.q")
    if closed == "both":
        hi = F.when(hi.isNull() & (lo["x"] == x), lo).otherwise(hi)
    ok = lo.isNotNull() & hi.isNotNull()
    cols = {"x0": lo["x"], "v0": lo["v"], "x1": hi["x"], "v1": hi["v"]}
    more = [(lo.isNotNull() & hi.isNull()).alias("beyond")] if beyond else []
    return both.where(F.col("_q").isNotNull()).select(key, "_q.*", *[F.when(ok, c).alias(k) for k, c in cols.items()], *more)


def lerp(v0: Column, v1: Column, wq: Column) -> Column:
    """v0 + ((v1 - v0) * wq >> 15); 0 where there is no bracket."""
    return F.coalesce(v0 + fx.shr((v1 - v0) * wq, 15), F.lit(0).cast("long"))


def interp_float(df: DataFrame, left: float = 0.0, right: float = 0.0) -> Column:
    """Linear interpolation between the columns of bracket(closed='both'); left before the first sample and for a key without samples, right beyond the last, which takes the column beyond."""
    span = F.col("x1") - F.col("x0")
    t = F.when(span == 0, 0.0).otherwise((F.col("q") - F.col("x0")) / F.when(span != 0, span))
    outer = F.lit(left) if left == right else F.when(F.col("beyond"), F.lit(right)).otherwise(F.lit(left))
    return F.coalesce(F.col("v0") + (F.col("v1") - F.col("v0")) * t, outer)


def truncated_weight(t: Column, nbits: int) -> Column:
    """A weight floored to a grid of 2**-(nbits - 1)."""
    step = 2.0 ** -(nbits - 1)
    return F.floor(t / step) * step


def uniform_bracket(q: Column, x0: Column, dx: Column, n: int, rounding: str = "half_up") -> tuple[Column, Column]:
    """idx and wq on the uniform source x0 + k * dx, k < n, for either sign of dx; idx -1 outside 0 <= t < n - 1.

    The index is computed, so the gather is an equi-join or an array access, not a range join."""
    t = (q - x0) / dx
    ok = (t >= 0) & (t < n - 1)
    k = F.floor(t)
    w = (t - k) * 32768
    w = {"half_up": F.floor(w + 0.5), "half_even": F.rint(w), "floor": F.floor(w)}[rounding]
    return F.when(ok, k).otherwise(-1).cast("int"), F.when(ok, F.least(F.lit(32767), w.cast("int"))).otherwise(0).cast("int")


def affine_key(q: Column, a: Column, shift: int, b: Column) -> Column:
    """((q * a) >> shift) + b over bigints."""
    return fx.shr(q * a, shift) + b


def pick_shift(a: float, most: int = 44) -> int:
    """The largest shift at which a * 2**shift still is an int32."""
    return next((s for s in range(most, -1, -1) if abs(round(a * 2.0**s)) < 1 << 31), 0)


def gather_lerp(x: Column, idx: Column, wq: Column, wrap: bool = True) -> Column:
    """Two-tap gather from an array of codes; idx below 0 gives 0; the result wraps to or saturates at int16."""
    a, b = F.get(x, idx), F.get(x, idx + 1)
    v = a + fx.shr((b - a) * wq, 15)
    return F.when(idx < 0, F.lit(0).cast("long")).otherwise(fx.wrap16(v) if wrap else fx.sat16(v))


def kernel_sum(x: Column, idx: Column, table_row: Column, low: int, taps: int) -> Column:
    """sum of table_row[k] * x[idx + low + k]."""
    part = F.slice(x, idx + low + 1, taps)
    return F.aggregate(F.zip_with(part, table_row, lambda v, c: v * c), F.lit(0).cast("long"), lambda s, v: s + v)


def gather_sinc(x: Column, idx: Column, wq: Column, n: int, table: list[list[int]]) -> Column:
    """Polyphase gather with as many taps as table rows have, rounded half up, saturating; two taps near the ends."""
    phases, taps = len(table), len(table[0])
    low = -(taps // 2 - 1)
    rows = F.array(*[F.array(*[F.lit(c).cast("long") for c in r]) for r in table])
    phase = fx.shr(wq.cast("long") * phases, 15).cast("int")
    inside = (idx >= -low) & (idx <= n - (taps + low))
    acc = kernel_sum(x, idx, F.get(rows, phase), low, taps)
    full = fx.sat16(fx.shr(acc + (1 << 14), 15))
    return F.when(inside, full).otherwise(gather_lerp(x, idx, wq, wrap=False))


def cubic_weights(t: Column) -> list[Column]:
    """Lagrange weights at -1, 0, 1, 2."""
    return [
        -t * (t - 1) * (t - 2) / 6,
        (t + 1) * (t - 1) * (t - 2) / 2,
        -(t + 1) * t * (t - 2) / 2,
        (t + 1) * t * (t - 1) / 6,
    ]


def gather_cubic(x: Column, idx: Column, wq: Column, n: int) -> Column:
    """Four-tap Lagrange gather in double, floored and saturating; two taps near the ends, 0 outside."""
    t = wq / 32768.0
    acc = sum((w * F.get(x, idx + k) for k, w in zip((-1, 0, 1, 2), cubic_weights(t), strict=True)), F.lit(0.0))
    inside = (idx >= 1) & (idx <= n - 3)
    return F.when(inside, fx.sat16(F.floor(acc + 0.5).cast("long"))).otherwise(gather_lerp(x, idx, wq, wrap=False))


def bessel_i0(x: float, terms: int = 40) -> float:
    return sum(((x / 2) ** k / math.factorial(k)) ** 2 for k in range(terms))


def kernel(name: str, half: int, mu: float) -> list[float]:
    """Study kernels at offsets -half+1 .. half for a fractional delay mu, scaled to sum 1: sinc, lanczos, hamming, kaiser, lagrange."""
    at = [mu - k for k in range(-half + 1, half + 1)]
    sinc = lambda v: 1.0 if v == 0 else math.sin(math.pi * v) / (math.pi * v)
    if name == "lagrange":
        nodes = list(range(-half + 1, half + 1))
        return [math.prod((mu - m) / (k - m) for m in nodes if m != k) for k in nodes]
    window = {
        "sinc": lambda v: 1.0,
        "lanczos": lambda v: sinc(v / half),
        "hamming": lambda v: 0.54 + 0.46 * math.cos(math.pi * v / half),
        "kaiser": lambda v: bessel_i0(8.6 * math.sqrt(max(0.0, 1 - (v / half) ** 2))) / bessel_i0(8.6),
    }[name]
    w = [sinc(v) * window(v) for v in at]
    return [c / sum(w) for c in w]


def kernel_response(at: DataFrame, taps: DataFrame, first: int, floor: float = 1e-12) -> DataFrame:
    """at (mu, w, ...: a delay and a frequency in radians a sample a row) with name, gain and error_db of every kernel of that delay
    against the ideal one. taps (name, mu, c: array from offset first on) is a bounded table: kernels x delays."""
    both = at.join(F.broadcast(taps), "mu")
    add = lambda f: F.aggregate(F.transform("c", lambda v, i: v * f(F.col("w") * (i + first))), F.lit(0.0), lambda s, v: s + v)
    both = both.withColumns({"_re": add(F.cos), "_im": add(F.sin)})
    angle = F.col("w") * F.col("mu")
    err = F.sqrt(F.pow(F.col("_re") - F.cos(angle), 2) + F.pow(F.col("_im") - F.sin(angle), 2))
    got = both.withColumns({"gain": F.hypot("_re", "_im"), "error_db": 20 * F.log10(F.greatest(err, F.lit(floor)))})
    return got.drop("_re", "_im", "c")


def scaled_unit(unit: Column, most: int) -> tuple[Column, Column]:
    """A factor as a 32-bit mantissa and its right shift: the largest shift up to most at which the rounded mantissa fits and is not 0; null without one."""
    mantissa = lambda s: F.floor(unit * F.pow(F.lit(2.0), s) + 0.5)
    ok = F.filter(F.sequence(F.lit(0), F.lit(most)), lambda s: (mantissa(s) >= -(1 << 31)) & (mantissa(s) < 1 << 31) & (mantissa(s) != 0))
    shift = F.array_max(ok)
    return mantissa(shift).cast("long"), shift


def affine48(q: Column, a: Column, shift: Column, b: Column) -> tuple[Column, Column]:
    """((q * a) >> shift) + b in 48 bits, wrapping, and whether the shifted product or the sum did not fit; q and a have 32 bits."""
    fits = lambda x: (x >= -(1 << 47)) & (x < 1 << 47)
    wrap = lambda x: F.shiftright(F.shiftleft(x, 16), 16)
    p = fx.shr(q * a, shift)
    v = wrap(p) + b
    return wrap(v), ~fits(p) | ~fits(v)


def merge_scan(queries: DataFrame, axis: DataFrame, key: str, inverse_bits: int = 30, width: float | None = None) -> DataFrame:
    """queries (key, v, sat, ...) with idx and wq on an ascending integer axis (key, ts), all in integers.

    v counts 4096ths of the axis' unit. idx is the last point at or before v, -1 where v lies outside
    [first, last) or is saturated; wq is the Q15 weight towards the next point, by a rounded reciprocal
    of the step. Points of an axis are numbered over stretches and brackets are taken over stretches of
    width (in units of v), so that one axis may hold any share of the rows."""
    points = running(axis.select(key, "ts").distinct(), F.lit(1).cast("long"), ["ts"], [key], "_n")
    got = bracket(queries.withColumnRenamed("v", "q"), points.select(key, (F.col("ts") * 4096).alias("x"), F.col("_n").alias("v")), key, "left", width)
    ok = F.col("x0").isNotNull() & ~F.col("sat")
    step, d = fx.shr(F.col("x1") - F.col("x0"), 12), F.col("q") - F.col("x0")
    inverse = F.floor(((1 << inverse_bits + 1) + step) / (2 * step)).cast("long")
    wq = F.when(d >= 1 << 32, 0).otherwise(F.least(F.lit(32767), fx.shr(d * inverse, inverse_bits - 3)))
    idx, wq = F.when(ok, F.col("v0")).otherwise(-1).cast("long"), F.when(ok, wq).otherwise(0).cast("int")
    return got.withColumns({"idx": idx, "wq": wq}).drop("x0", "v0", "x1", "v1").withColumnRenamed("q", "v")
