"""Per-pulse geometry: look directions, wavenumbers, grids, orders and the two-pass resampler."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as fx
from . import interp, tiles
from .scan import PART, halo, running

LIGHT = 299792458.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def look_direction(pulses: DataFrame) -> DataFrame:
    """row, ax, ay of pulses (row, tx, rcv, srp, uiax, uiay): the unit vector from the mean antenna place to the scene, on the image axes."""
    u = F.zip_with("srp", F.zip_with("tx", "rcv", lambda a, b: (a + b) * 0.5), lambda s, p: s - p)
    p = pulses.withColumn("_u", u).withColumn("_n", F.sqrt(dot(F.col("_u"), F.col("_u"))))
    return p.select("row", (dot(F.col("_u"), F.col("uiax")) / F.col("_n")).alias("ax"), (dot(F.col("_u"), F.col("uiay")) / F.col("_n")).alias("ay"))


def wavenumbers(pulses: DataFrame) -> DataFrame:
    """pulses (row, ax, ay, ...) with pr, pc (range and cross-range projections in the frame of the mean look direction) and tan_phi."""
    mean = pulses.agg(F.avg("ax").alias("_mx"), F.avg("ay").alias("_my"))
    p = pulses.crossJoin(F.broadcast(mean))
    n = F.hypot("_mx", "_my")
    dx, dy = F.col("_mx") / n, F.col("_my") / n
    p = p.withColumns({"pr": F.col("ax") * dx + F.col("ay") * dy, "pc": F.col("ay") * dx - F.col("ax") * dy}).drop("_mx", "_my")
    return p.withColumn("tan_phi", F.col("pc") / F.col("pr"))


def ramp(f0: Column, df: Column, k: Column, nu: int = 1) -> Column:
    return f0 + k * (df * nu)


def pulse_order(pulses: DataFrame, key: str = "tan_phi") -> DataFrame:
    """pulses with rank, the place of each in ascending key; ties to the smaller row. Ranks are counted over stretches of the order."""
    return running(pulses, F.lit(1).cast("long"), [key, "row"], out="rank").withColumn("rank", F.col("rank").cast("int"))


def grid_union(pulses: DataFrame, n: int) -> DataFrame:
    """i, q: n uniform points over the union of the pulses' extents (lo, hi)."""
    ends = pulses.agg(F.min("lo").alias("a"), F.max("hi").alias("b"))
    return ends.select(F.posexplode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i", "_k"), "a", "b").select(
        "i", (F.col("a") + F.col("i") * ((F.col("b") - F.col("a")) / (n - 1))).alias("q")
    )


def reciprocals(axis: DataFrame, key: str = "row") -> DataFrame:
    """axis (key, i, t) with inv, the reciprocal of the distance to the key's next point (null at the last); a key may hold any share of the rows."""
    h = halo(axis, ["i"], [key], ahead=1)
    step = F.lead("t").over(Window.partitionBy(PART, key).orderBy("i")) - F.col("t")
    return h.withColumn("inv", F.try_divide(F.lit(1.0), step)).where("NOT _halo").drop(PART, "_halo")


def resample_rows(rows: DataFrame, grid: DataFrame, n: int, kernel: str = "lerp", table: list[list[int]] | None = None) -> DataFrame:
    """rows (row, re, im, x0, dx) on a uniform grid (i, q): the array form with one value a grid point.

    The grid is one array of a few thousand points, broadcast as one row; every line is gathered in
    place by computed indices, so there is no shuffle."""
    g = grid.agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("_g")).select(F.transform("_g", lambda s: s["q"]).alias("_g"))
    x = rows.crossJoin(F.broadcast(g))

    def coeff(q):
        idx, wq = interp.uniform_bracket(q, F.col("x0"), F.col("dx"), n)
        return F.struct(idx.alias("idx"), wq.alias("wq"))

    x = x.withColumn("_c", F.transform("_g", coeff))

    def pick(name: str):
        def one(c):
            if kernel == "sinc":
                return interp.gather_sinc(F.col(name), c["idx"], c["wq"], n, table or fx.sinc_table())
            if kernel == "cubic":
                return interp.gather_cubic(F.col(name), c["idx"], c["wq"], n)
            return interp.gather_lerp(F.col(name), c["idx"], c["wq"])

        return F.transform("_c", one)

    return x.withColumns({"re": pick("re"), "im": pick("im")}).drop("_g", "_c")


def resample_cross(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Second pass over turned lines (row, re, im, axis): the line's source axis is an ascending array; the grid (i, q) is uniform.

    Bracketing by a fold would be quadratic; the axis is searched once a grid point, by as many halvings as its length takes."""
    g = grid.agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("_g")).select(F.transform("_g", lambda s: s["q"]).alias("_g"))
    x = rows.crossJoin(F.broadcast(g))

    def search(q):
        n = F.size("axis")
        step = lambda s, _: F.when(  # noqa: E731  s: lo, hi with axis[lo] <= q < axis[hi]
            F.get("axis", F.floor((s["lo"] + s["hi"]) / 2).cast("int")) <= q,
            F.struct(F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("lo"), s["hi"].alias("hi")),
        ).otherwise(F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi")))
        whole = F.struct(F.lit(0).alias("lo"), (n - 1).cast("int").alias("hi"))
        at = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), fx.bit_length(n.cast("long"))).cast("int")), whole, lambda s, i: F.when(s["hi"] - s["lo"] > 1, step(s, i)).otherwise(s))["lo"]
        ok = (n > 1) & (q >= F.get("axis", F.lit(0))) & (q < F.get("axis", n - 1))
        return F.when(ok, at).otherwise(-1)

    def coeff(q):
        k = search(q)
        a, b = F.get("axis", k), F.get("axis", k + 1)
        return F.struct(k.cast("int").alias("idx"), F.coalesce(interp.weight_q15(q - a, b - a, "half_up"), F.lit(0)).alias("wq"))

    x = x.withColumn("_c", F.transform("_g", coeff))
    one = lambda name: F.transform("_c", lambda c: interp.gather_lerp(F.col(name), c["idx"], c["wq"]))
    return x.withColumns({"re": one("re"), "im": one("im")}).drop("_g", "_c")


def _between(x: np.ndarray, i: np.ndarray, f: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """lines x 2 x n at places i + f, 0 where not ok: one gather for all lines and both planes."""
    a, b = (np.take_along_axis(x, np.broadcast_to(k[:, None], (len(x), 2, k.shape[1])), 2) for k in (i, i + 1))
    return np.where(ok[:, None], a + (b - a) * f[:, None], 0.0)


def polar_format(rows: DataFrame, pulses: DataFrame, n: int, size: int, h: int | None = None) -> DataFrame:
    """The float resampler: array rows (row, re, im) and pulses (row, x0, dx, tan_phi) onto size x size grids (row, re, im by range), look by look of h rows.

    Range pass: each pulse is interpolated onto uniform range wavenumbers over the union of all pulses'
    extents, all lines of a batch at once. Cross pass: where the tiles of the corner turn come together, each
    range bin is interpolated over its own cross axis, the bin's wavenumber times the look's tangents in
    order, all bins of a tile at once. Points up to 1e-9 beyond an end count as the end, what lies farther
    is 0. Three numbers reach the driver, axes stay with their lines; pulses without a row take no part."""
    h = h or size
    end = F.col("x0") + F.col("dx") * (n - 1)
    some = rows.join(pulses, "row")
    e = some.agg(F.min(F.least("x0", end)).alias("lo"), F.max(F.greatest("x0", end)).alias("hi"), F.max(F.abs("tan_phi")).alias("tan")).first()
    if e["lo"] is None:
        return rows.select("row", *[F.transform(c, lambda v: v.cast("double")).alias(c) for c in ("re", "im")]).where(F.lit(False))
    kr = e["lo"] + np.arange(size) * ((e["hi"] - e["lo"]) / (size - 1))
    edge = max(abs(kr[0]), abs(kr[-1])) * e["tan"]
    kc = -edge + np.arange(size) * (2 * edge / (size - 1))

    def range_pass(parts):
        for p in parts:
            for at in tiles.chunks(p.num_rows, max(n, size)):
                x = tiles.listed(p, at, n).astype(float)
                x0, dx, tan = (p.column(c).slice(at.start, at.stop - at.start) for c in ("x0", "dx", "tan_phi"))
                t = (kr - x0.to_numpy()[:, None]) / dx.to_numpy()[:, None]
                ok, t = (t >= -1e-9) & (t <= n - 1 + 1e-9), np.clip(t, 0, n - 1)
                i = np.minimum(np.floor(t).astype(np.int64), n - 2)
                yield pa.RecordBatch.from_arrays([p.column("row").slice(at.start, at.stop - at.start), tiles.binaries(_between(x, i, t - i, ok), "<f8"), tan], ["row", "iq", "tan_phi"])

    def cross_pass(tile, tans, first):
        there = np.flatnonzero(~np.isnan(tans))
        order = there[np.argsort(tans[there], kind="stable")]
        axis, x = tans[order], tile[:, :, order]
        if len(axis) < 2:
            return np.zeros((len(tile), 2, size))
        with np.errstate(divide="ignore", invalid="ignore"):
            u = kc / kr[first : first + len(tile), None]
        ok = (u >= axis[0] - 1e-9) & (u <= axis[-1] + 1e-9)
        u = np.clip(np.where(ok, u, axis[0]), axis[0], axis[-1])
        i = np.clip(np.searchsorted(axis, u.ravel(), "right").reshape(u.shape) - 1, 0, len(axis) - 2)
        span = axis[i + 1] - axis[i]
        f = np.where(span > 0, (u - axis[i]) / np.where(span > 0, span, 1), 0.0)
        return _between(x, i, f, ok)

    lines = some.select("row", "re", "im", "x0", "dx", "tan_phi").mapInArrow(range_pass, tiles.PACKED + ", tan_phi double")
    return tiles.unpack(tiles.turn(lines, h, size, "<f8", axis="tan_phi", then=cross_pass), size, "<f8", "double")


def scatter_rows(rows: DataFrame, order: DataFrame) -> DataFrame:
    """rows with every row moved to its rank (order: row, rank), a join of one row a pulse."""
    return rows.join(order.select("row", "rank"), "row").drop("row").withColumnRenamed("rank", "row")


def pixel_spacing(span_r: Column, span_c: Column) -> tuple[Column, Column]:
    """Range and cross-range spacing, the reciprocals of the grids' spans; null where a span is 0."""
    return F.try_divide(F.lit(1.0), span_r), F.try_divide(F.lit(1.0), span_c)
