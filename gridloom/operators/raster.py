"""Raster queries over detected images (row, col, mag) and metrics between images."""

from __future__ import annotations

import struct
import zlib
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import PART, halo


def multilook(img: DataFrame, n: int, h: int, w: int) -> DataFrame:
    """Means of n x n blocks; ragged edges are dropped."""
    whole = img.where((F.col("row") < h - h % n) & (F.col("col") < w - w % n))
    return whole.groupBy(F.floor(F.col("row") / n).cast("long").alias("row"), F.floor(F.col("col") / n).cast("long").alias("col")).agg(F.avg("mag").alias("mag"))


def histogram(img: DataFrame) -> DataFrame:
    return img.groupBy("mag").agg(F.count("*").alias("n"))


def midpoint_cdf(hist: DataFrame) -> DataFrame:
    """mag, n, cdf: the share of samples below the middle of each value, within (1e-9, 1 - 1e-9).

    A window over the histogram, whose rows are at most 65536 for uint16."""
    upto = F.sum("n").over(Window.orderBy("mag"))
    total = F.sum("n").over(Window.partitionBy())
    cdf = (upto - 0.5 * F.col("n")) / total
    return hist.select("mag", "n", F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), cdf)).alias("cdf"))


def normal_scores(hist: DataFrame) -> DataFrame:
    """mag, z: the inverse normal of the midpoint CDF of the non-zero values; a look-up table of at most 65535 rows."""

    @F.pandas_udf("double")
    def inv(p: pd.Series) -> pd.Series:
        return p.map(NormalDist().inv_cdf)

    return midpoint_cdf(hist.where("mag > 0")).select("mag", inv("cdf").alias("z"))


def stretch_normal(img: DataFrame, sigma: float = 3.0) -> DataFrame:
    """img with v (0 to 255): middle grey plus the normal score, sigma deviations on either side; samples of 0 stay 0."""
    v = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), 128.0 + 127.0 * F.col("z") / sigma))).cast("int")
    lut = normal_scores(histogram(img)).select("mag", v.alias("v"))
    return img.join(F.broadcast(lut), "mag", "left").withColumn("v", F.coalesce("v", F.lit(0)))  # at most 65535 rows


def rescale(img: DataFrame, exponent: int | Column) -> DataFrame:
    """img with real, the sample a block's shared exponent stands for: mag * 2**exponent."""
    return img.withColumn("real", F.col("mag") * F.pow(F.lit(2.0), F.lit(exponent) if isinstance(exponent, int) else exponent))


def write_png(img: DataFrame, path: str, col: str = "v") -> tuple[int, int]:
    """Writes a raster of 0 to 255 (row, col and the column named) as an 8-bit grey PNG on the driver; returns height and width.

    Rows are packed on executors and reach the driver in order, one partition at a time, so that it
    holds one partition's lines and no image."""
    h, w = (int(x or 0) for x in img.agg(F.max("row") + 1, F.max("col") + 1).first())
    line = F.array_sort(F.collect_list(F.struct("col", F.col(col).cast("int").alias("v"))))
    lines = img.groupBy("row").agg(line.alias("p")).orderBy("row")

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))

    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)))
        pack, at = zlib.compressobj(), 0
        for r in lines.toLocalIterator():
            y = bytearray(w)
            for c, v in r["p"]:
                y[c] = v or 0
            blank = bytes(1 + w) * (r["row"] - at)
            if data := pack.compress(blank + b"\0" + bytes(y)):
                f.write(chunk(b"IDAT", data))
            at = r["row"] + 1
        f.write(chunk(b"IDAT", pack.flush()) + chunk(b"IEND", b""))
    return h, w


def apply_lut(img: DataFrame, lut: DataFrame, out: str) -> DataFrame:
    """img with the table's value of each sample (broadcast: a table has at most 65536 rows); 0 where it has none."""
    return img.join(F.broadcast(lut), "mag", "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def order_statistics(df: DataFrame, col: str, ranks: list[int], bins: int = 4096) -> dict[int, float]:
    """The values of these ranks (from 0) of a numeric column without its nulls and NaNs, exact, by refined histograms.

    Each round counts the bins of the stretches that still hold a wanted rank and goes on with the bin that has
    it, from its least to its largest value; bins ascend with the values, so their counts are ranks. A round is
    one aggregate of at most bins x ranks groups, no task holds all values, and a stretch shrinks by the number of bins."""
    x = F.col(col).cast("double")
    df = df.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"))
    e = df.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
    out, todo = {}, [(e["a"], e["b"], 0, sorted(set(ranks)))] if e["a"] is not None and ranks else []
    while todo:
        for a, b, _, some in todo:
            out |= {r: a for r in some if a == b}
        todo = [s for s in todo if s[0] < s[1]]
        if not todo:
            break
        seg = F.coalesce(*[F.when(F.col("x").between(a, b), F.lit(i)) for i, (a, b, *_) in enumerate(todo)])
        low, high = (F.get(F.array(*[F.lit(float(s[k])) for s in todo]), F.col("s")) for k in (0, 1))
        part = F.col("x") / 2 - low / 2, high / 2 - low / 2  # halves, so that no difference overflows
        bin_ = F.least(F.lit(bins - 1), F.floor(part[0] / part[1] * bins)).cast("int")
        got = df.withColumn("s", seg).where("s IS NOT NULL").groupBy("s", bin_.alias("k")).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy("s", "k").collect()
        more, at = [], [s[2] for s in todo]
        for r in got:
            first, at[r["s"]] = at[r["s"]], at[r["s"]] + r["n"]
            mine = [k for k in todo[r["s"]][3] if first <= k < at[r["s"]]]
            if mine:
                more.append((r["a"], r["b"], first, mine))
        todo = more
    return out


def percentiles(df: DataFrame, ps: list[float], col: str = "mag") -> list[float | None]:
    """Linearly interpolated percentiles of a numeric column of any size, from exact order statistics; null without values."""
    x = F.col(col).cast("double")
    n = df.agg(F.count(F.when(~F.isnan(x), x)).alias("n")).first()["n"]
    places = [p / 100 * (n - 1) for p in ps]
    got = order_statistics(df, col, [k for at in places for k in (int(at), min(n - 1, int(at) + 1))]) if n else {}
    ends = [(got[int(at)], got[min(n - 1, int(at) + 1)], at - int(at)) for at in places] if n else []
    return [a + (b - a) * f for a, b, f in ends] or [None] * len(ps)


def percentile(img: DataFrame, p: float, col: str = "mag") -> DataFrame:
    """One row, p: the linearly interpolated percentile. Of whole numbers by one aggregate of their distinct values (65536 of a
    magnitude), of floats by refined histograms."""
    if img.schema[col].dataType.typeName() in ("double", "float"):
        return img.sparkSession.createDataFrame([tuple(percentiles(img, [p], col))], "p double")
    return img.agg(F.percentile(col, F.lit(p / 100)).alias("p"))


def stretch_u8(img: DataFrame, p: float = 99.7) -> DataFrame:
    """row, col, u8: magnitude over its percentile, to 0..255, floored."""
    top = percentile(img, p)
    v = F.col("mag") / (F.col("p") + 1e-12) * 255
    return img.crossJoin(F.broadcast(top)).select("row", "col", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))).cast("int").alias("u8"))


def stretch_db(img: DataFrame, span: float = 28.0, p: float = 99.7, gamma: float = 0.85) -> DataFrame:
    """row, col, v: decibels below the percentile over a span, clipped to 0..1, with a gamma."""
    top = percentile(img, p).select((20 * F.log10(F.col("p") + 1e-6)).alias("top"))
    db = 20 * F.log10(F.col("mag") + 1e-6)
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (db - F.col("top") + span) / span))
    return img.crossJoin(F.broadcast(top)).select("row", "col", F.pow(v, F.lit(gamma)).alias("v"))


def stretch_log(img: DataFrame, lo: float = 30.0, hi: float = 99.5) -> DataFrame:
    """row, col, v: log1p between two percentiles, clipped to 0..1."""
    x = img.withColumn("x", F.log1p("mag"))
    if img.schema["mag"].dataType.typeName() in ("double", "float"):
        ends = img.sparkSession.createDataFrame([tuple(percentiles(x, [lo, hi], "x"))], "a double, b double")
    else:
        ends = x.agg(F.percentile("x", F.lit(lo / 100)).alias("a"), F.percentile("x", F.lit(hi / 100)).alias("b"))
    v = (F.col("x") - F.col("a")) / F.greatest(F.col("b") - F.col("a"), F.lit(1e-12))
    return x.crossJoin(F.broadcast(ends)).select("row", "col", F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)).alias("v"))


def valid_extent(img: DataFrame, frac: float = 0.25) -> DataFrame:
    """r0, r1, c0, c1 (inclusive): the rows and columns whose mean exceeds frac of the median of such means."""
    out = None
    for axis, a, b in (("row", "r0", "r1"), ("col", "c0", "c1")):
        means = img.groupBy(axis).agg(F.avg("mag").alias("m"))
        mid = means.agg(F.median("m").alias("mid"))
        ends = means.crossJoin(F.broadcast(mid)).where(F.col("m") > frac * F.col("mid")).agg(F.min(axis).alias(a), F.max(axis).alias(b))
        out = ends if out is None else out.crossJoin(ends)
    return out


def band_energy(img: DataFrame, size: int = 512) -> DataFrame:
    return img.groupBy(F.floor(F.col("row") / size).cast("long").alias("band")).agg(F.sum(F.col("mag").cast("long")).alias("energy"))


def brightest(img: DataFrame) -> DataFrame:
    """row, col, mag of the largest sample; ties to the smallest row, then column."""
    best = img.agg(F.min_by(F.struct("row", "col", "mag"), F.struct(-F.col("mag"), F.col("row"), F.col("col"))).alias("b"))
    return best.select("b.row", "b.col", "b.mag")


def pslr(img: DataFrame, window: int = 16, null: int = 2) -> DataFrame:
    """peak, side, pslr_db of the brightest sample: the largest other one in the window outside the null square."""
    at = brightest(img).select(F.col("row").alias("pr"), F.col("col").alias("pc"), F.col("mag").alias("peak"))
    dy, dx = F.abs(F.col("row") - F.col("pr")), F.abs(F.col("col") - F.col("pc"))
    near = img.crossJoin(F.broadcast(at)).where((dy <= window) & (dx <= window))
    side = F.max(F.when((dy > null) | (dx > null), F.col("mag"))).alias("side")
    got = near.groupBy("peak").agg(side)
    return got.withColumn("pslr_db", 20 * F.log10((F.col("side") + 1e-12) / F.col("peak")))


def health(img: DataFrame) -> DataFrame:
    """peak, mean, median and the percentages that are saturated and non-zero."""
    pct = lambda c: 100.0 * F.avg(c.cast("double"))
    return img.agg(
        F.max("mag").alias("peak"), F.avg("mag").alias("mean"), F.median("mag").cast("double").alias("median"),
        pct(F.col("mag") >= 65535).alias("saturated_pct"), pct(F.col("mag") > 0).alias("nonzero_pct"),
    )


def dynamic_range(img: DataFrame, col: str = "mag") -> DataFrame:
    """One row, dr_db: the 99.99th percentile over the 5th of the positive samples."""
    if img.schema[col].dataType.typeName() in ("double", "float"):
        (hi,), (lo,) = percentiles(img, [99.99], col), percentiles(img.where(F.col(col) > 0), [5], col)
        ends = img.sparkSession.createDataFrame([(hi, lo)], "hi double, lo double")
        return ends.select((20 * F.log10(F.col("hi") / (F.coalesce("lo", F.lit(1e-12)) + 1e-12))).alias("dr_db"))
    hi, lo = F.percentile(col, F.lit(0.9999)), F.percentile(F.when(F.col(col) > 0, F.col(col)), F.lit(0.05))
    return img.agg((20 * F.log10(hi / (F.coalesce(lo, F.lit(1e-12)) + 1e-12))).alias("dr_db"))


def compare(ref: DataFrame, test: DataFrame) -> DataFrame:
    """nrmse, snr_db, enob, corr, max_err, bias of two images (row, col, mag), each scaled to its own peak.

    A full join on the sample's place; a sample that one image lacks counts as 0 there."""
    pair = ref.select("row", "col", F.col("mag").alias("r")).join(test.select("row", "col", F.col("mag").alias("t")), ["row", "col"], "full")
    pair = pair.select(F.coalesce("r", F.lit(0)).cast("double").alias("r"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    top = pair.agg(F.max("r").alias("rm"), F.max("t").alias("tm"))
    x = pair.crossJoin(F.broadcast(top)).select((F.col("r") / (F.col("rm") + 1e-30)).alias("r"), (F.col("t") / (F.col("tm") + 1e-30)).alias("t"))
    e = F.col("t") - F.col("r")
    got = x.agg(
        F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rr"), (F.sqrt(F.avg(e * e)) + 1e-30).alias("re"),
        F.corr("r", "t").alias("corr"), F.max(F.abs(e)).alias("max_err"), F.avg(e).alias("bias"),
    )
    snr = 20 * F.log10(F.col("rr") / F.col("re"))
    return got.select((F.col("re") / F.col("rr")).alias("nrmse"), snr.alias("snr_db"), ((snr - 1.76) / 6.02).alias("enob"), "corr", "max_err", "bias")


def complex_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """corr, gain_re, gain_im, nrmse, max_lsb, n_bad of frames (row, col, re, im): a against b with the best complex gain."""
    p = a.join(b.select("row", "col", F.col("re").alias("br"), F.col("im").alias("bi")), ["row", "col"])
    d = lambda c: F.col(c).cast("double")
    dr, di = d("re") * d("br") + d("im") * d("bi"), d("im") * d("br") - d("re") * d("bi")
    off = F.greatest(F.abs(F.col("re") - F.col("br")), F.abs(F.col("im") - F.col("bi")))
    s = p.agg(
        F.sum(dr).alias("dr"), F.sum(di).alias("di"), F.sum(d("re") ** 2 + d("im") ** 2).alias("aa"), F.sum(d("br") ** 2 + d("bi") ** 2).alias("bb"),
        F.max(off).cast("double").alias("max_lsb"), F.count(F.when(off > 0, 1)).alias("n_bad"),
    )
    cross = F.col("dr") ** 2 + F.col("di") ** 2
    return s.select(
        F.sqrt(cross / (F.col("aa") * F.col("bb"))).alias("corr"), (F.col("dr") / F.col("bb")).alias("gain_re"), (F.col("di") / F.col("bb")).alias("gain_im"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("aa") - cross / F.col("bb")) / F.col("aa")).alias("nrmse"), "max_lsb", "n_bad",
    )


def psf_metrics(lines: DataFrame, key: str = "row", guard: int = 8) -> DataFrame:
    """key, pslr_db, islr_db, spur_db of every one-dimensional response p (array), JVM-side: the main lobe ends at the first minimum
    on either side of the peak; the spur is the largest sample more than guard from it, null where there is none."""
    p, at = F.col("p"), lambda i: F.get("p", i)
    peak = F.array_position(p, F.array_max(p)).cast("int") - 1
    x = lines.select(key, "p", peak.alias("_k"))
    ends = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (F.coalesce(at(i - 1), at(i)) >= at(i)) & (F.coalesce(at(i + 1), at(i)) >= at(i)))
    x = x.withColumn("_low", ends)
    left, right = F.array_max(F.filter("_low", lambda i: i < F.col("_k"))), F.array_min(F.filter("_low", lambda i: i > F.col("_k")))
    x = x.withColumns({"_a": F.coalesce(left, F.lit(-1)), "_b": F.coalesce(right, F.size(p))})
    inside, energy = lambda i: (i > F.col("_a")) & (i < F.col("_b")), lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)
    main, rest = F.filter(p, lambda v, i: inside(i)), F.filter(p, lambda v, i: ~inside(i))
    far = F.filter(p, lambda v, i: F.abs(i - F.col("_k")) > guard)
    db = lambda k, a, b: k * F.log10(F.try_divide(a, b))
    top = F.array_max(p)
    return x.select(key, db(20, F.array_max(rest), top).alias("pslr_db"), db(10, energy(rest), energy(main)).alias("islr_db"), db(20, F.array_max(far), top).alias("spur_db"))


def orientation_correlations(a: DataFrame, b: DataFrame, h: int, w: int) -> DataFrame:
    """orient, corr: the correlation of image a with every symmetry of image b."""
    from .slicing import oriented

    views = oriented(b.select("row", "col", F.col("mag").alias("m2")), h, w)
    return a.join(views, ["row", "col"]).groupBy("orient").agg(F.corr(F.col("mag").cast("double"), F.col("m2").cast("double")).alias("corr"))


def spacing_uniformity(axis: DataFrame, key: str, x: str, width: int = 31) -> DataFrame:
    """key, worst, middle: the largest and the median ratio of the largest to the smallest difference in sliding windows; a key may hold any share of the rows."""
    h = halo(axis.select(key, x), [x], [key], ahead=width)  # a window and the step behind it
    w = Window.partitionBy(PART, key).orderBy(x)
    d = h.withColumn("d", F.lead(x).over(w) - F.col(x)).where("d is not null")
    full = w.rowsBetween(0, width - 1)
    r = d.select(key, "_halo", F.count("d").over(full).alias("n"), F.max("d").over(full).alias("hi"), F.min("d").over(full).alias("lo")).where("NOT _halo")
    ratio = F.col("hi") / F.greatest(F.col("lo"), F.lit(1e-12))
    return r.where(F.col("n") == width).groupBy(key).agg(F.max(ratio).alias("worst"), F.median(ratio).alias("middle"))


def utm_epsg(lat: Column, lon: Column) -> Column:
    return (F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)).cast("int")


def ecef_to_geodetic(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees on WGS 84, by Bowring's closed form."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    e2, ep2 = f * (2 - f), (a * a - b * b) / (b * b)
    p = F.hypot(x, y)
    t = F.atan2(z * a, p * b)
    lat = F.atan2(z + ep2 * b * F.pow(F.sin(t), 3), p - e2 * a * F.pow(F.cos(t), 3))
    return F.degrees(lat), F.degrees(F.atan2(y, x))


def utm_zone(lon: Column) -> Column:
    return F.least(F.lit(60), F.floor((lon + 180) / 6).cast("int") + 1)


def utm(lat: Column, lon: Column, zone: Column | None = None) -> tuple[Column, Column]:
    """Easting and northing in a zone, that of the longitude if none is given, by the transverse Mercator series."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi = F.radians(lat)
    lam0 = F.radians(((utm_zone(lon) if zone is None else zone) - 1) * 6 - 177)
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c, s = F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2), F.cos(phi) * (F.radians(lon) - lam0)
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    east = k0 * n * (s + (1 - t + c) * s**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * s**5 / 120) + 500000
    north = k0 * (m + n * F.tan(phi) * (s**2 / 2 + (5 - t + 9 * c + 4 * c * c) * s**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * s**6 / 720))
    return east, F.when(lat < 0, north + 10000000).otherwise(north)


def scene_affine(scenes: DataFrame, height: Column, width: Column, flip_row: bool = False, flip_col: bool = False) -> DataFrame:
    """scenes with epsg and affine (array of six): the map place of image place (row, col) is (e_col * col + e_row * row + e0, n_col * col + n_row * row + n0).

    Of a scene are known its centre (ECEF array), the image plane's axes uiax and uiay (ECEF arrays), the range
    and cross-range directions dhat and chat on these (two numbers each) and the ground size dr of a column and
    dc of a row. The centre is image place (height // 2, width // 2). It and the points one column and one row
    away are projected to the zone of the centre; an image plane of this size maps by one affine."""
    at = lambda c, i: F.get(c, F.lit(i))
    move = lambda h, step, sign: [sign * F.col(step) * (at(h, 0) * at("uiax", i) + at(h, 1) * at("uiay", i)) for i in range(3)]
    centre = [at("centre", i) for i in range(3)]
    lat, lon = ecef_to_geodetic(*centre)
    x = scenes.withColumns({"_lat": lat, "_lon": lon})
    zone, south = utm_zone(F.col("_lon")), F.col("_lat") < 0

    def place(p):
        la, lo = ecef_to_geodetic(*p)
        e, n = utm(la, lo, zone)
        return e, F.when(south & (la >= 0), n + 10000000).when(~south & (la < 0), n - 10000000).otherwise(n)  # the centre's own half

    col, row = (move(h, s, -1.0 if flip else 1.0) for h, s, flip in (("dhat", "dr", flip_col), ("chat", "dc", flip_row)))
    points = {"_p": centre, "_q": [a + b for a, b in zip(centre, col, strict=True)], "_r": [a + b for a, b in zip(centre, row, strict=True)]}
    x = x.withColumns({k: F.array(*place(p)) for k, p in points.items()})
    c0, r0, out = F.floor(width / 2), F.floor(height / 2), []
    for i in range(2):
        a, b = at("_q", i) - at("_p", i), at("_r", i) - at("_p", i)
        out += [a, b, at("_p", i) - a * c0 - b * r0]
    epsg = utm_epsg(F.col("_lat"), F.col("_lon"))
    return x.withColumns({"epsg": epsg, "affine": F.array(*out)}).drop("_lat", "_lon", "_p", "_q", "_r")
