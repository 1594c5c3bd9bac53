"""Registered queries of the core library and the SQL each is held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..operators import catalog as ct
from ..operators import geometry as geo
from ..operators import imaging, interp, longline, raster, scan, slicing, spectral, tall
from ..sources import frames, phasehistory
from ..sources.shared import cut, shared_dir
from ..streaming.watch import windowed_counts
from . import sql as s

FLAGSHIP = "form_image_l1bfp"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _iq(spark, d):
    return frames.iq_rows(frames.read(spark, d, "embeddings"))


def _long(spark, d):
    return frames.to_long(_iq(spark, d))


def _image(spark, d):
    return spectral.detect_rows(_iq(spark, d))


def _looks(spark, d):
    """The whole frame as looks of 64 lines."""
    return spectral.pad_lines(_iq(spark, d), 64, 64)


def _height(frame) -> int:
    return frame.agg(F.max("row") + 1).first()[0] or 0


def r6(c, name):
    return F.round(c, 6).alias(name)


# ---- scans, projections, filters -------------------------------------------------------------


@query(f"WITH {s.LONG} SELECT row // 2 AS row, CAST(col // 4 AS INTEGER) AS col, re, im FROM iql WHERE row % 2 = 0 AND col % 4 = 0")
def decimate_crop(spark, d):
    return slicing.decimate(_long(spark, d), 2, 4).select("row", F.col("col").cast("int"), "re", "im")


@query(f"WITH {s.LONG} SELECT row, CAST(col - 12 AS INTEGER) AS col, col AS raw_col, re FROM iql WHERE col >= 12 AND col < 52")
def centre_crop(spark, d):
    return slicing.centre_crop(_long(spark, d), 64, 40).select("row", "col", "raw_col", "re")


@query(f"WITH {s.LONG} SELECT row - 8 AS row, CAST(col - 5 AS INTEGER) AS col, re, im FROM iql WHERE row >= 8 AND row < 40 AND col >= 5 AND col < 37")
def roi_crop(spark, d):
    return slicing.roi(_long(spark, d), 8, 40, 5, 37).select("row", F.col("col").cast("int"), "re", "im")


@query(f"WITH {s.LONG} SELECT max(row) + 1 AS n_rows, CAST(max(col) + 1 AS BIGINT) AS n_cols FROM iql")
def frame_dims(spark, d):
    return frames.dims(_long(spark, d))


PULSES = """pulses AS (
    SELECT vec_id AS row, CAST(embedding[1] AS DOUBLE) + 3.0 AS ax, CAST(embedding[2] AS DOUBLE) + 1.0 AS ay,
           1 + vec_id / 1024.0 AS f0, 1 / 64.0 AS df FROM embeddings)"""


def _pulses(spark, d):
    e = frames.read(spark, d, "embeddings")
    x = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return e.select(
        F.col("vec_id").alias("row"), (x(0) + 3.0).alias("ax"), (x(1) + 1.0).alias("ay"), (1 + F.col("vec_id") / 1024.0).alias("f0"), F.lit(1 / 64.0).alias("df")
    )


@query(f"WITH {PULSES} SELECT row // 2 AS row, f0 FROM pulses WHERE row % 2 = 0")
def pvp_projection(spark, d):
    return _pulses(spark, d).where("row % 2 = 0").select(F.floor(F.col("row") / 2).cast("long").alias("row"), "f0")


@query(f"WITH {PULSES} SELECT row, CAST(k AS BIGINT) AS k, f0 + k * (df * 2) AS freq FROM pulses, range(0, 16) t(k)")
def frequency_ramp(spark, d):
    p = _pulses(spark, d).select("row", "f0", "df", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("k"))
    return p.select("row", "k", geo.ramp(F.col("f0"), F.col("df"), F.col("k"), 2).alias("freq"))


WAVE = (
    PULSES
    + """, mean AS (SELECT avg(ax) AS mx, avg(ay) AS my FROM pulses), wave AS (
    SELECT row, f0, df, (ax * mx + ay * my) / sqrt(mx * mx + my * my) AS pr, (ay * mx - ax * my) / sqrt(mx * mx + my * my) AS pc FROM pulses, mean)"""
)


@query(f"WITH {WAVE} SELECT row, round(pr, 6) AS pr, round(pc, 6) AS pc, round(pc / pr, 6) AS tan_phi FROM wave")
def wavenumber_projection(spark, d):
    w = geo.wavenumbers(_pulses(spark, d))
    return w.select("row", r6(F.col("pr"), "pr"), r6(F.col("pc"), "pc"), r6(F.col("tan_phi"), "tan_phi"))


LOOK = """look AS (SELECT vec_id AS row, [CAST(embedding[1] AS DOUBLE) + 9, CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE) + 5] AS p FROM embeddings)"""


@query(
    f"WITH {LOOK} SELECT row, round(-(p[1] * 0.6 + p[2] * 0.8) / sqrt(p[1] * p[1] + p[2] * p[2] + p[3] * p[3]), 6) AS ax, "
    "round(-p[3] / sqrt(p[1] * p[1] + p[2] * p[2] + p[3] * p[3]), 6) AS ay FROM look"
)
def look_projection(spark, d):
    x = lambda i: F.get("embedding", F.lit(i)).cast("double")
    p = F.array(x(0) + 9, x(1), x(2) + 5)
    const = lambda *v: F.array(*[F.lit(float(i)) for i in v])
    pulses = frames.read(spark, d, "embeddings").select(
        F.col("vec_id").alias("row"), p.alias("tx"), p.alias("rcv"), const(0, 0, 0).alias("srp"), const(0.6, 0.8, 0).alias("uiax"), const(0, 0, 1).alias("uiay")
    )
    got = geo.look_direction(pulses)
    return got.select("row", r6(F.col("ax"), "ax"), r6(F.col("ay"), "ay"))


EXTENT = "ext AS (SELECT min(lo) AS a, max(hi) AS b FROM (SELECT vec_id, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings))"


@query(f"WITH {EXTENT} SELECT CAST(i AS INTEGER) AS i, round(a + i * ((b - a) / 63), 6) AS q FROM ext, range(0, 64) t(i)")
def linspace_grid_union(spark, d):
    e = frames.read(spark, d, "embeddings")
    ends = e.select(F.array_min("embedding").cast("double").alias("lo"), F.array_max("embedding").cast("double").alias("hi"))
    return geo.grid_union(ends, 64).select("i", r6(F.col("q"), "q"))


@query(f"WITH {EXTENT}, g AS (SELECT i, a + i * ((b - a) / 39) AS q FROM ext, range(0, 40) t(i)) SELECT CAST(r.i AS INTEGER) AS i, round(coalesce(g.q, 2 * (SELECT max(q) FROM g) - (SELECT min(q) FROM g) + 1), 6) AS q FROM range(0, 64) r(i) LEFT JOIN g USING (i)")
def padded_grid(spark, d):
    e = frames.read(spark, d, "embeddings")
    ends = e.select(F.array_min("embedding").cast("double").alias("lo"), F.array_max("embedding").cast("double").alias("hi"))
    return slicing.pad_grid(geo.grid_union(ends, 40), 64).select("i", r6(F.col("q"), "q"))


@query(f"WITH {s.IQ} SELECT row, CAST(k AS INTEGER) AS col, coalesce(re[k + 1], 0) AS re, coalesce(im[k + 1], 0) AS im FROM iq, range(0, 80) t(k)")
def zero_pad(spark, d):
    return frames.to_long(slicing.zero_pad(_iq(spark, d), 80)).select("row", "col", "re", "im")


@query(
    f"SELECT o_orderkey, CAST(1 << CASE WHEN (o_orderkey - 1) > 0 THEN length(bin(o_orderkey - 1)) ELSE 0 END AS BIGINT) AS p2, "
    "CAST(CASE WHEN o_orderkey <= 8192 THEN 8192 WHEN o_orderkey <= 16384 THEN 16384 END AS INTEGER) AS fft FROM orders WHERE o_orderkey >= 1"
)
def pow2_plan(spark, d):
    """An axis longer than the ladder has no plan here; without the condition it is an error."""
    k = F.col("o_orderkey")
    return frames.read(spark, d, "orders").where(k >= 1).select("o_orderkey", fx.pow2_ceil(k).alias("p2"), F.when(k <= 16384, slicing.plan_axis(k)).alias("fft"))


_H = "h AS (SELECT max(row) + 1 AS h FROM img)"


@query(f"WITH {s.IMAGE}, {_H} SELECT (row + h // 2) % h AS row, CAST((col + 32) % 64 AS INTEGER) AS col, mag FROM img, h")
def fftshift(spark, d):
    img = _image(spark, d)
    return slicing.shift(img, _height(img), 64).select("row", "col", "mag")


_VIEWS = {"id": ("row", "col"), "flip_rows": ("h - 1 - row", "col"), "flip_cols": ("row", "63 - col"), "rot180": ("h - 1 - row", "63 - col")}
_DIHEDRAL = " UNION ALL ".join(
    f"SELECT '{p}{k}' AS orient, CAST({y} AS BIGINT) AS row, CAST({x} AS BIGINT) AS col, mag FROM img, h"
    for p, flip in (("", False), ("t_", True))
    for k, (a, b) in _VIEWS.items()
    for y, x in [(b, a) if flip else (a, b)]
)


@query(f"WITH {s.IMAGE}, {_H} {_DIHEDRAL}")
def dihedral(spark, d):
    img = _image(spark, d)
    return slicing.oriented(img, _height(img), 64)


@query("SELECT l_orderkey, l_linenumber, CAST(list_reduce(list_transform(range(0, 6), lambda b: (((l_partkey % 64) >> b) & 1) << (5 - b)), lambda x, y: x + y) AS INTEGER) AS r FROM lineitem")
def bit_reverse(spark, d):
    return frames.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fx.bit_reverse(F.col("l_partkey") % 64, 6).cast("int").alias("r"))


@query(f"WITH {s.LONG} SELECT row, col, lpad(lower(hex(((re & 65535) << 16) | (im & 65535))), 8, '0') AS value FROM iql")
def hex_vectors(spark, d):
    return frames.format_hex(_long(spark, d))


@query(f"WITH {s.LONG} SELECT re, im, count(*) AS n FROM iql GROUP BY ALL")
def hex_round_trip(spark, d):
    return frames.parse_hex(frames.format_hex(_long(spark, d)).select("value")).groupBy("re", "im").agg(F.count("*").alias("n"))


@query(
    "SELECT l_orderkey, l_linenumber, CAST(CASE l_orderkey % 12 WHEN 0 THEN 32767 WHEN 6 THEN -32768 ELSE " + s.wrap16("l_partkey * 1021 + l_suppkey") + " END AS BIGINT) AS re, "
    "CAST(CASE l_orderkey % 12 WHEN 0 THEN -32768 WHEN 6 THEN 32767 ELSE " + s.wrap16("l_suppkey * 4093 - l_partkey") + " END AS BIGINT) AS im FROM lineitem"
)
def source_line(spark, d):
    """Full-scale samples of either sign among wrapped products of the table's keys."""
    p, q = F.col("l_partkey"), F.col("l_suppkey")
    li = frames.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fx.wrap16(p * 1021 + q).alias("re"), fx.wrap16(q * 4093 - p).alias("im"))
    return frames.stress_line(li, "l_orderkey")


@query(
    "SELECT c AS \"case\", k, round(level + CASE WHEN k % 64 = spike THEN 2000.0 ELSE 0 END + a * cos(2 * pi() * f * (k % 64) / 64) + b * cos(2 * pi() * g * (k % 64) / 64), 6) + 0.0 AS re, "
    "round(a * sin(2 * pi() * f * (k % 64) / 64) + b * sin(2 * pi() * g * (k % 64) / 64), 6) + 0.0 AS im FROM (SELECT vec_id AS k FROM embeddings) t, (VALUES ('impulse', 0, 0, 0, 0, 0, 0), ('dc', 2000, -1, 0, 0, 0, 0), "
    "('tone', 0, -1, 2000, 8, 0, 0), ('impulse_k', 0, 37, 0, 0, 0, 0), ('twotone', 0, -1, 2000, 5, 1000, 21), ('twotone_hidr', 0, -1, 2000, 11, 2, 21), ('dc_smalltone', 2000, -1, 0, 0, 2, 12)) v(c, level, spike, a, f, b, g)"
)
def stimuli(spark, d):
    got = frames.stimuli(frames.read(spark, d, "embeddings").select(F.col("vec_id").alias("k")), 64)
    return got.select("case", "k", (F.round("re", 6) + 0.0).alias("re"), (F.round("im", 6) + 0.0).alias("im"))


# ---- fixed point, tapers, quantisers ---------------------------------------------------------


@query(
    "WITH v AS (SELECT l_orderkey * 7919 - l_partkey * 6271 AS x FROM lineitem) SELECT x, count(*) AS n, "
    f"CAST(any_value({s.wrap16('x')}) AS BIGINT) AS wrapped, CAST(any_value({s.sat16('x')}) AS BIGINT) AS saturated, any_value(x >> 3) AS shifted FROM v GROUP BY x"
)
def fixed_scalars(spark, d):
    v = frames.read(spark, d, "lineitem").select((F.col("l_orderkey") * 7919 - F.col("l_partkey") * 6271).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    x = F.col("x")
    return v.select("x", "n", fx.wrap16(x).alias("wrapped"), fx.sat16(x).alias("saturated"), fx.shr(x, 3).alias("shifted"))


QUANT = """px AS (SELECT vec_id AS row, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS col, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    e AS (SELECT CAST(min(k) AS INTEGER) AS exp FROM range(-40, 41) t(k) WHERE (SELECT max(abs(x)) FROM px) <= 32767 * pow(2.0, k))"""


@query(f"WITH {QUANT} SELECT row, col, CAST(greatest(-32768, least(32767, floor(x / pow(2.0, exp)))) AS BIGINT) AS code, exp FROM px, e")
def quantize_iq16(spark, d):
    f = frames.real_frame(frames.read(spark, d, "embeddings"))
    top = f.agg(F.max(F.abs("x")).alias("m"))
    fits = F.filter(F.sequence(F.lit(-40), F.lit(40)), lambda k: F.col("m") <= 32767 * F.pow(F.lit(2.0), k))
    e = top.select(F.array_min(fits).alias("exp"))
    return f.crossJoin(F.broadcast(e)).select("row", "col", fx.quantise(F.col("x"), F.pow(F.lit(2.0), F.col("exp"))).alias("code"), "exp")


_SWEEP = "SELECT b AS bits, round(avg(pow(x - greatest(-pow(2, b - 1), least(pow(2, b - 1) - 1, floor(x * pow(2, b - 2)))) / pow(2, b - 2), 2)), 9) AS mse FROM px, (VALUES (8), (10), (12), (16)) t(b) GROUP BY b"


@query(f"WITH px AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) {_SWEEP}")
def quant_sweep(spark, d):
    f = frames.real_frame(frames.read(spark, d, "embeddings")).select("x", F.explode(F.array(*[F.lit(b) for b in (8, 10, 12, 16)])).alias("bits"))
    step, top = F.pow(F.lit(2.0), F.col("bits") - 2), F.pow(F.lit(2.0), F.col("bits") - 1)
    code = F.greatest(-top, F.least(top - 1, F.floor(F.col("x") * step)))
    return f.groupBy("bits").agg(F.round(F.avg(F.pow(F.col("x") - code / step, 2)), 9).alias("mse"))


@query(f"WITH {s.SQUARE}, {s.taper('sq', 'wn', 64, 64)[0]} SELECT row, CAST(unnest(range(0, 64)) AS INTEGER) AS col, CAST(unnest(re) AS BIGINT) AS re, CAST(unnest(im) AS BIGINT) AS im FROM wn")
def window_q15(spark, d):
    return frames.to_long(spectral.window_q15(_looks(spark, d), fx.taper_q15(64), fx.taper_q15(64)))


@query("SELECT vec_id, CAST(i AS INTEGER) AS i, round(CAST(embedding[i + 1] AS DOUBLE) * (0.54 - 0.46 * cos(2 * pi() * i / 63)), 6) + 0.0 AS x FROM embeddings, range(0, 64) t(i)")
def window_float(spark, d):
    x = frames.real_frame(frames.read(spark, d, "embeddings"))
    return x.select(F.col("row").alias("vec_id"), F.col("col").alias("i"), (F.round(F.col("x") * (0.54 - 0.46 * F.cos(2 * F.pi() * F.col("col") / 63)), 6) + 0.0).alias("x"))


@query(f"WITH {s.LONG} SELECT row, col, CAST(floor(sqrt(CAST(re * re + im * im AS DOUBLE))) AS BIGINT) AS root, CAST(least(65535, floor(sqrt(CAST(re * re + im * im AS DOUBLE)))) AS INTEGER) AS mag, round(sqrt(CAST(re * re + im * im AS DOUBLE)), 6) AS amp FROM iql")
def detect(spark, d):
    re, im = F.col("re"), F.col("im")
    return _long(spark, d).select("row", "col", fx.isqrt(re * re + im * im).alias("root"), fx.detect(re, im).alias("mag"), r6(F.hypot(re, im), "amp"))


# ---- transforms ------------------------------------------------------------------------------


def _rows_out(rows, *more):
    return frames.to_long(rows, *more).select("row", "col", F.col("re").cast("long"), F.col("im").cast("long"), *[F.col(m).cast("int") for m in more])


def _rows_sql(ctes: str, src: str, more: str = "") -> str:
    return f"WITH {s.SQUARE}, {ctes} SELECT row, CAST(unnest(range(0, 64)) AS INTEGER) AS col, CAST(unnest(re) AS BIGINT) AS re, CAST(unnest(im) AS BIGINT) AS im{more} FROM {src}"


@query(_rows_sql(*s.fft("sq", "f")))
def fft_row_full(spark, d):
    return _rows_out(spectral.fft_full(_looks(spark, d), 64))


@query(_rows_sql(*s.fft("sq", "f")))
def fft_row_arrow(spark, d):
    return _rows_out(spectral.fft_full_arrow(_looks(spark, d), 64))


@query(_rows_sql(*s.pass_l1("sq", "f"), more=", CAST(exp AS INTEGER) AS exp"))
def dft_row_l1bfp(spark, d):
    return _rows_out(spectral.line_pass(_looks(spark, d), 64, "l1"), "exp")


@query(_rows_sql(*s.pass_global("sq", "f"), more=", CAST(exp AS INTEGER) AS exp"))
def fft_row_global(spark, d):
    return _rows_out(spectral.line_pass(_looks(spark, d), 64, "global"), "exp")


@query(_rows_sql(*s.pass_perrow("sq", "f"), more=", CAST(exp AS INTEGER) AS exp"))
def dft_row_bfp_perrow(spark, d):
    return _rows_out(spectral.line_pass(_looks(spark, d), 64, "perrow"), "exp")


@query(_rows_sql(*s.fft("sq", "f", halve=True, clip=True)))
def fft_row_uncond(spark, d):
    return _rows_out(spectral.pass_uncond(_looks(spark, d), 64))


_RN = s.pass_perrow("sq", "f")
_RN2 = s.renormalise(_RN[1], "rn")


@query(_rows_sql(f"{_RN[0]}, {_RN2[0]}", _RN2[1], ", CAST(exp AS INTEGER) AS exp, CAST(emax AS INTEGER) AS emax"))
def renorm_global(spark, d):
    return _rows_out(spectral.renormalise(spectral.line_pass(_looks(spark, d), 64, "perrow")), "exp", "emax")


_PR_A = f"SELECT row, col, CAST(mag AS INTEGER) AS mag FROM ({s.detect('rn')})"


@query(f"WITH {s.SQUARE}, {_RN[0]}, {_RN2[0]} {_PR_A}")
def detect_order_a(spark, d):
    return spectral.detect_rows(spectral.renormalise(spectral.line_pass(_looks(spark, d), 64, "perrow")))


_PR_B = f"SELECT m.row, m.col, CAST(CASE WHEN emax - exp > 12 THEN 0 ELSE mag >> (emax - exp) END AS INTEGER) AS mag FROM ({s.detect(_RN[1])}) m JOIN {_RN[1]} USING (row), (SELECT max(exp) AS emax FROM {_RN[1]})"


def _order_b(spark, d):
    rows = spectral.line_pass(_looks(spark, d), 64, "perrow")
    top = rows.agg(F.max("exp").alias("emax"))
    f = frames.to_long(rows, "exp").crossJoin(F.broadcast(top))
    down = F.col("emax") - F.col("exp")
    mag = fx.detect(F.col("re"), F.col("im"))
    return f.select("row", "col", F.when(down > 12, 0).otherwise(fx.shr(mag, down)).cast("int").alias("mag"))


@query(f"WITH {s.SQUARE}, {_RN[0]} {_PR_B}")
def detect_order_b(spark, d):
    return _order_b(spark, d)


@query(f"WITH {s.SQUARE}, {_RN[0]}, {_RN2[0]}, a AS ({_PR_A}), b AS ({_PR_B}) SELECT CAST(max(abs(a.mag - b.mag)) AS INTEGER) AS worst, count(*) FILTER (a.mag <> b.mag) AS n FROM a JOIN b USING (row, col)")
def detect_order_diff(spark, d):
    a, b = detect_order_a(spark, d), _order_b(spark, d).withColumnRenamed("mag", "mag_b")
    off = F.abs(F.col("mag") - F.col("mag_b"))
    return a.join(b, ["row", "col"]).agg(F.max(off).cast("int").alias("worst"), F.count(F.when(off > 0, 1)).alias("n"))


@query(s.image("l1"))
def form_image_l1bfp(spark, d):
    return imaging.form_image(_looks(spark, d), 64, 64, "l1")


@query(s.image("global"))
def form_image_global(spark, d):
    return imaging.form_image(_looks(spark, d), 64, 64, "global")


@query(s.image("perrow"))
def form_image_perrow(spark, d):
    return imaging.form_image(_looks(spark, d), 64, 64, "perrow")


_WIDE = """cells AS (SELECT (l_orderkey * 8 + l_linenumber) // 1024 AS row, (l_orderkey * 8 + l_linenumber) % 1024 AS col, CAST(l_partkey % 8192 AS BIGINT) - 4096 AS re, CAST(l_suppkey % 512 AS BIGINT) - 256 AS im FROM lineitem),
    once AS (SELECT row, col, max(struct_pack(re := re, im := im)) AS v FROM cells GROUP BY row, col),
    line AS (SELECT row, map_from_entries(list((col, v.re))) AS r, map_from_entries(list((col, v.im))) AS i FROM once GROUP BY row),
    sq AS (SELECT q.row, list_transform(range(0, 1024), lambda c: coalesce(r[c], 0)) AS re, list_transform(range(0, 1024), lambda c: coalesce(i[c], 0)) AS im
    FROM (SELECT unnest(range(0, (SELECT (max(row) + 1024) // 1024 * 1024 FROM line))) AS row) q LEFT JOIN line USING (row))"""


@query(s.image("l1", 1024, frame=_WIDE))
def form_image_wide(spark, d):
    """Looks of 1024 x 1024 samples over every row of lineitem, at the place that its key gives."""
    at = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    f = frames.read(spark, d, "lineitem").select(
        F.floor(at / 1024).cast("long").alias("row"), (at % 1024).cast("int").alias("col"), (F.col("l_partkey") % 8192 - 4096).alias("re"), (F.col("l_suppkey") % 512 - 256).alias("im")
    )
    rows = frames.to_packed(f, 1024)
    whole = spark.range(-(-_height(f) // 1024) * 1024).select(F.col("id").alias("row"))
    rows = whole.join(rows, "row", "left").select("row", F.coalesce("iq", F.lit(bytes(4 * 1024))).alias("iq"))
    return imaging.form_image(rows, 1024, 1024, "l1")


@query(f"WITH {s.IMAGE} SELECT row, col, CAST(mag * 8 AS DOUBLE) AS real FROM img")
def block_rescale(spark, d):
    return raster.rescale(_image(spark, d), 3).select("row", "col", "real")


@query("SELECT doc_id, 'scene_' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(5, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') || '_geo.tif' AS sibling FROM documents WHERE doc_id % 3 > 0")
def sibling_names(spark, d):
    doc = frames.read(spark, d, "documents").select("doc_id", frames.fixed_name("scene_", F.col("doc_id")).alias("base"))
    name = F.concat("base", F.when(F.col("doc_id") % 3 > 0, "_raw.bin").otherwise("_raw.tmp"))
    return doc.select("doc_id", F.explode(frames.siblings(name, "_raw.bin", ["_geo.tif"])).alias("sibling"))


@query()
def stretch_normal(spark, d):
    return raster.stretch_normal(_image(spark, d)).select("row", "col", "v")


@query(
    f"WITH {s.LONG}, {s.CRC_TABLE}, b AS (SELECT row, col, j, ((CASE WHEN j < 2 THEN re ELSE im END) >> (8 * (j % 2))) & 255 AS b FROM iql, range(0, 4) t(j)), "
    f"y AS (SELECT list(b ORDER BY row, col, j) AS y, count(*) AS n FROM b) SELECT n AS n_bytes, {s.crc('y')} AS crc FROM y, tab"
)
def frame_crc(spark, d):
    return ct.region_crc(_iq(spark, d))


@query(s.image("uncond", tapered=False))
def form_image_uncond(spark, d):
    return imaging.form_image(_looks(spark, d), 64, 64, "uncond", taper=False)


@query(f"WITH {s.LONG} SELECT CAST(col AS BIGINT) AS row, CAST(row AS INTEGER) AS col, re, im FROM iql")
def transpose(spark, d):
    return slicing.transpose(_long(spark, d))


@query(f"WITH {s.LONG} SELECT CAST(col AS BIGINT) AS row, CAST(row AS INTEGER) AS col, re, im FROM iql WHERE col >= 10 AND col < 30")
def transpose_strip(spark, d):
    return slicing.transpose_strip(_long(spark, d), 10, 20)


@query(f"WITH {s.LONG} SELECT CAST(col AS BIGINT) AS row, CAST(row AS INTEGER) AS col, re, im FROM iql")
def corner_turn(spark, d):
    """Of the whole frame, by tiles."""
    return tall.turn(_iq(spark, d), 64)


@query(
    f"WITH {s.LONG}, tw AS (SELECT unnest(range(0, 64)) AS j, unnest(list_transform(range(0, 64), lambda j: (CASE WHEN j < 32 THEN 1 ELSE -1 END) * {s.cos_q15('j % 32', 64)})) AS c, unnest(list_transform(range(0, 64), lambda j: (CASE WHEN j < 32 THEN 1 ELSE -1 END) * {s.sin_q15('j % 32', 64)})) AS s) "
    "SELECT row, CAST(k AS INTEGER) AS k, CAST(sum((re * c - im * s) >> 15) AS BIGINT) AS re, CAST(sum((im * c + re * s) >> 15) AS BIGINT) AS im "
    "FROM iql, range(0, 64) t(k) JOIN tw ON tw.j = (iql.col * k) % 64 GROUP BY row, k"
)
def dft_direct(spark, d):
    return spectral.dft_direct(_long(spark, d), 64)


_SPLIT = "px AS (SELECT vec_id AS row, unnest(range(0, 64)) AS col, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


@query(f"WITH {_SPLIT} SELECT row, CAST(k AS INTEGER) AS k, round(sum(x * cos(2 * pi() * k * col / 64)), 4) + 0.0 AS re, round(-sum(x * sin(2 * pi() * k * col / 64)), 4) + 0.0 AS im FROM px, range(0, 64) t(k) GROUP BY row, k")
def fft_even_odd_identity(spark, d):
    """A 64-point transform from two of 32 points over even and odd samples."""
    f = frames.real_frame(frames.read(spark, d, "embeddings")).withColumn("odd", F.col("col") % 2)
    half = f.select("row", "odd", F.floor(F.col("col") / 2).alias("j"), "x", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("h"))
    a = 2 * F.pi() * F.col("h") * F.col("j") / 32
    two = half.groupBy("row", "odd", "h").agg(F.sum(F.col("x") * F.cos(a)).alias("re"), (-F.sum(F.col("x") * F.sin(a))).alias("im"))
    e = two.where("odd = 0").select("row", "h", F.col("re").alias("er"), F.col("im").alias("ei"))
    both = e.join(two.where("odd = 1").select("row", "h", "re", "im"), ["row", "h"]).select("*", F.explode(F.array(F.lit(0), F.lit(32))).alias("up"))
    k = F.col("h") + F.col("up")
    c, n = F.cos(2 * F.pi() * k / 64), F.sin(2 * F.pi() * k / 64)
    re = F.col("er") + F.col("re") * c + F.col("im") * n
    im = F.col("ei") + F.col("im") * c - F.col("re") * n
    return both.select("row", k.alias("k"), (F.round(re, 4) + 0.0).alias("re"), (F.round(im, 4) + 0.0).alias("im"))


_LONGD = "iqd AS (SELECT row, col, CAST(re AS DOUBLE) AS re, CAST(im AS DOUBLE) AS im FROM iql)"


# twice a sum of integers times roots of unity is, where it is rational, a whole number, so that none of these lies on a tie of the first decimal
@query(f"WITH {s.LONG}, {_LONGD}, {s.dft2_whole('iqd', 'f', 64)} SELECT row, col, round(re, 1) + 0.0 AS re, round(im, 1) + 0.0 AS im FROM f")
def fft2_float(spark, d):
    """Of the whole frame."""
    rows = _iq(spark, d)
    got = frames.to_long(tall.fft2(rows, _height(rows), 64))
    return got.select("row", "col", *[(F.round(c, 1) + 0.0).alias(c) for c in ("re", "im")])


_MOVED = "mvd AS (SELECT row // 64 * 64 + (row % 64 + 59) % 64 AS row, (col + 55) % 64 AS col, re + floor(im / 4) AS re, CAST(0 AS DOUBLE) AS im FROM iqd), flat AS (SELECT row, col, re, CAST(0 AS DOUBLE) AS im FROM iqd)"


@query(
    f"WITH {s.LONG}, {_LONGD}, {_MOVED}, {s.dft2('flat', 'fa', 64, 64, centred=False)}, {s.dft2('mvd', 'fb', 64, 64, centred=False)}, "
    "x AS (SELECT row, col, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im FROM fa a JOIN fb b USING (row, col)), "
    "u AS (SELECT row, col, re / greatest(sqrt(re * re + im * im), 1e-12) / 4096 AS re, -im / greatest(sqrt(re * re + im * im), 1e-12) / 4096 AS im FROM x), "
    f"{s.dft2('u', 'g', 64, 64, centred=False)}, best AS (SELECT row // 64 AS look, arg_max({{'r': row % 64, 'c': col}}, re) AS p, max(re) AS peak FROM g GROUP BY 1) "
    "SELECT look, p.r AS dy, CAST(p.c AS INTEGER) AS dx, round(peak, 4) AS peak FROM best"
)
def phase_correlation(spark, d):
    """Of every look with a moved copy whose samples have a part of the other channel in them."""
    f = frames.to_long(_iq(spark, d)).select("row", "col", *[F.col(c).cast("double").alias(c) for c in ("re", "im")])
    flat, zero = f.withColumn("im", F.lit(0.0)), F.lit(0.0)
    row = (F.floor(F.col("row") / 64) * 64 + (F.col("row") % 64 + 59) % 64).cast("long")
    moved = f.select(row.alias("row"), ((F.col("col") + 55) % 64).alias("col"), (F.col("re") + F.floor(F.col("im") / 4)).alias("re"), zero.alias("im"))
    got = spectral.phase_correlation(frames.to_rows(flat), frames.to_rows(moved), 64, 64)
    return got.select("look", F.col("dy").cast("long").alias("dy"), F.col("dx").cast("int").alias("dx"), F.round("peak", 4).alias("peak"))


# ---- gathers ---------------------------------------------------------------------------------

HOUR_US = 3.6e9
AXIS = """smp AS (SELECT user_id, epoch_us(ts) AS x, CAST(floor(value * 100) AS BIGINT) AS v FROM events WHERE event_id % 4 <> 0),
    qry AS (SELECT user_id, event_id, epoch_us(ts) + (event_id % 3) * 1000 AS q FROM events WHERE event_id % 4 = 0)"""


def _axis(spark, d):
    e = frames.read(spark, d, "events")
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    e = e.withColumn("us", us)
    smp = e.where("event_id % 4 <> 0").select("user_id", F.col("us").alias("x"), F.floor(F.col("value") * 100).cast("long").alias("v"))
    qry = e.where("event_id % 4 = 0").select("user_id", "event_id", (F.col("us") + (F.col("event_id") % 3) * 1000).alias("q"))
    return qry, smp


def _asof_sql(lo: str, hi: str) -> str:
    return f"""WITH {AXIS}, a AS (SELECT q.user_id, q.event_id, q.q, s.x AS x0, s.v AS v0 FROM qry q ASOF LEFT JOIN smp s ON q.user_id = s.user_id AND q.q {lo} s.x),
        b AS (SELECT a.*, s.x AS x1, s.v AS v1 FROM a ASOF LEFT JOIN smp s ON a.user_id = s.user_id AND a.q {hi} s.x)
        SELECT user_id, event_id, CAST(coalesce(v0 + (((v1 - v0) * least(32767, (q - x0) * 32768 // (x1 - x0))) >> 15), 0) AS BIGINT) AS y FROM b"""


def _lerp_events(spark, d, closed):
    got = interp.bracket(*_axis(spark, d), "user_id", closed, HOUR_US)
    wq = interp.weight_q15(F.col("q") - F.col("x0"), F.col("x1") - F.col("x0"))
    return got.select("user_id", "event_id", F.when(F.col("x0").isNotNull(), interp.lerp(F.col("v0"), F.col("v1"), wq)).otherwise(0).cast("long").alias("y"))


@query(_asof_sql(">=", "<"))
def lerp_asof_left(spark, d):
    return _lerp_events(spark, d, "left")


@query(_asof_sql(">", "<="))
def lerp_asof_right(spark, d):
    return _lerp_events(spark, d, "right")


@query(
    f"""WITH {AXIS}, a AS (SELECT q.user_id, q.event_id, q.q, s.x AS x0, s.v AS v0 FROM qry q ASOF LEFT JOIN smp s ON q.user_id = s.user_id AND q.q >= s.x),
        b AS (SELECT a.*, s.x AS x1, s.v AS v1 FROM a ASOF LEFT JOIN smp s ON a.user_id = s.user_id AND a.q <= s.x)
        SELECT user_id, event_id, round(CASE WHEN x0 IS NULL OR x1 IS NULL THEN 0.0 WHEN x1 = x0 THEN CAST(v0 AS DOUBLE) ELSE v0 + (v1 - v0) * ((q - x0) / CAST(x1 - x0 AS DOUBLE)) END, 6) AS y FROM b"""
)
def interp_float(spark, d):
    got = interp.bracket(*_axis(spark, d), "user_id", "both", HOUR_US)
    return got.select("user_id", "event_id", F.round(interp.interp_float(got).cast("double"), 6).alias("y"))


def _uniform_sql(x0: str, dx: str) -> str:
    return f"""WITH {s.IQ}, t AS (SELECT row, i, re, ((i * 0.75 - 3) - ({x0})) / ({dx}) AS t FROM iq, range(0, 96) g(i)),
        k AS (SELECT row, i, re, CASE WHEN t >= 0 AND t < 63 THEN CAST(floor(t) AS INTEGER) ELSE -1 END AS idx, t FROM t),
        w AS (SELECT row, i, re, idx, CASE WHEN idx < 0 THEN 0 ELSE least(32767, CAST(floor((t - idx) * 32768 + 0.5) AS INTEGER)) END AS wq FROM k)
        SELECT row, CAST(i AS INTEGER) AS i, idx, wq, CAST(CASE WHEN idx < 0 THEN 0 ELSE {s.wrap16('re[idx + 1] + (((re[idx + 2] - re[idx + 1]) * wq) >> 15)')} END AS BIGINT) AS y FROM w"""


def _uniform(spark, d, x0, dx):
    rows = _iq(spark, d).select("row", "re", F.explode(F.sequence(F.lit(0), F.lit(95))).alias("i"))
    idx, wq = interp.uniform_bracket(F.col("i") * 0.75 - 3, F.lit(x0) + F.col("row") * 0.0, F.lit(dx), 64)
    got = rows.withColumns({"idx": idx, "wq": wq})
    return got.select("row", "i", "idx", "wq", interp.gather_lerp(F.col("re"), F.col("idx"), F.col("wq")).cast("long").alias("y"))


@query(_uniform_sql("-1.5", "1.0"))
def lerp_uniform(spark, d):
    return _uniform(spark, d, -1.5, 1.0)


@query(_uniform_sql("64.25", "-1.0"))
def lerp_uniform_desc(spark, d):
    return _uniform(spark, d, 64.25, -1.0)


_TABLE = fx.sinc_table(64, 16)
_COEFF = "c AS (SELECT row, re, i, (i * 5) % 70 - 3 AS idx, (i * 7919 + row * 13) % 32768 AS wq FROM iq, range(0, 70) g(i))"
_EDGE = s.sat16("re[idx + 1] + (((re[idx + 2] - re[idx + 1]) * wq) >> 15)")


def _coeffs(spark, d):
    rows = _iq(spark, d).select("row", "re", F.explode(F.sequence(F.lit(0), F.lit(69))).alias("i"))
    return rows.withColumns({"idx": ((F.col("i") * 5) % 70 - 3).cast("int"), "wq": ((F.col("i") * 7919 + F.col("row") * 13) % 32768).cast("int")})


@query(
    f"WITH {s.IQ}, {_COEFF}, tab AS (SELECT unnest(range(0, 64)) AS phase, unnest({_TABLE}) AS k) SELECT row, CAST(i AS INTEGER) AS i, CAST(CASE "
    f"WHEN idx >= 7 AND idx <= 55 THEN {s.sat16('(CAST(list_sum(list_transform(range(0, 16), lambda j: k[j + 1] * re[idx - 7 + j + 1])) AS BIGINT) + 16384) >> 15')} "
    f"WHEN idx < 0 OR idx > 62 THEN 0 ELSE {_EDGE} END AS BIGINT) AS y FROM c JOIN tab ON phase = (wq * 64) >> 15"
)
def sinc_gather(spark, d):
    c = _coeffs(spark, d)
    y = F.coalesce(interp.gather_sinc(F.col("re"), F.col("idx"), F.col("wq"), 64, _TABLE), F.lit(0))
    return c.select("row", "i", y.cast("long").alias("y"))


@query(
    f"""WITH {s.IQ}, {_COEFF}, t AS (SELECT *, wq / 32768.0 AS t FROM c) SELECT row, CAST(i AS INTEGER) AS i, CAST(CASE WHEN idx >= 1 AND idx <= 61 THEN
        {s.sat16('CAST(floor(0.0 + (-t * (t - 1) * (t - 2) / 6) * re[idx] + ((t + 1) * (t - 1) * (t - 2) / 2) * re[idx + 1] + (-(t + 1) * t * (t - 2) / 2) * re[idx + 2] + ((t + 1) * t * (t - 1) / 6) * re[idx + 3] + 0.5) AS BIGINT)')}
        WHEN idx < 0 OR idx > 62 THEN 0 ELSE {_EDGE} END AS BIGINT) AS y FROM t"""
)
def cubic_gather(spark, d):
    c = _coeffs(spark, d)
    return c.select("row", "i", F.coalesce(interp.gather_cubic(F.col("re"), F.col("idx"), F.col("wq"), 64), F.lit(0)).cast("long").alias("y"))


@query(f"WITH {WAVE} SELECT row, CAST(row_number() OVER (ORDER BY pc / pr, row) - 1 AS INTEGER) AS rank FROM wave")
def pulse_order(spark, d):
    return geo.pulse_order(geo.wavenumbers(_pulses(spark, d))).select("row", "rank")


@query(f"WITH {WAVE}, r AS (SELECT row, CAST(row_number() OVER (ORDER BY pc / pr, row) - 1 AS INTEGER) AS rank FROM wave), {s.LONG} SELECT r.rank AS row, col, re, im FROM iql JOIN r USING (row)")
def scatter_rows(spark, d):
    order = geo.pulse_order(geo.wavenumbers(_pulses(spark, d)))
    return frames.to_long(geo.scatter_rows(_iq(spark, d), order)).select("row", "col", "re", "im")


@query(f"WITH {s.LONG} SELECT row, col, ((re * 12345) >> 7) + 77 AS key FROM iql")
def affine_keys(spark, d):
    return _long(spark, d).select("row", "col", interp.affine_key(F.col("re"), F.lit(12345), 7, F.lit(77)).alias("key"))


_GATHER = lambda c, w: s.wrap16(f"{c}[k + 1] + ((({c}[k + 2] - {c}[k + 1]) * {w}) >> 15)")
_RANGE = (
    s.SQUARE.replace("sq AS (", "pad AS (")
    + f""", g AS (SELECT i, i * 0.96875::DOUBLE AS q FROM range(0, 64) t(i)), r1 AS (SELECT row, i, re, im, q - row / 256.0::DOUBLE AS t FROM pad, g),
    r2 AS (SELECT *, CASE WHEN t >= 0 AND t < 63 THEN CAST(floor(t) AS INTEGER) ELSE -1 END AS k FROM r1),
    r3 AS (SELECT *, CASE WHEN k < 0 THEN 0 ELSE least(32767, CAST(floor((t - k) * 32768 + 0.5) AS INTEGER)) END AS w FROM r2),
    r AS (SELECT row, i, CASE WHEN k < 0 THEN 0 ELSE {_GATHER('re', 'w')} END AS re, CASE WHEN k < 0 THEN 0 ELSE {_GATHER('im', 'w')} END AS im FROM r3)"""
)


@query(
    f"""WITH {_RANGE}, lines AS (SELECT row // 64 * 64 + i AS row, list(re ORDER BY row) AS re, list(im ORDER BY row) AS im FROM r GROUP BY row // 64, i),
    c1 AS (SELECT row, g.i, re, im, q, 1 + (row % 64) / 1024.0::DOUBLE AS s FROM lines, g),
    c2 AS (SELECT *, CASE WHEN q < 63 * s THEN list_max(list_filter(range(0, 64), lambda p: p * s <= q)) ELSE -1 END AS k FROM c1),
    c3 AS (SELECT *, CASE WHEN k < 0 THEN 0 ELSE greatest(0, least(32767, CAST(floor((q - k * s) * 32768.0::DOUBLE / ((k + 1) * s - k * s) + 0.5) AS INTEGER))) END AS w FROM c2)
    SELECT row, CAST(i AS INTEGER) AS col, CAST(CASE WHEN k < 0 THEN 0 ELSE {_GATHER('re', 'w')} END AS BIGINT) AS re, CAST(CASE WHEN k < 0 THEN 0 ELSE {_GATHER('im', 'w')} END AS BIGINT) AS im FROM c3"""
)
def resample_2pass(spark, d):
    """Of every look of 64 lines: range pass on a uniform grid, corner turn, cross pass on each bin's scaled axis."""
    rows = _iq(spark, d).withColumns({"x0": F.lit(0.0) + F.col("row") / 256.0, "dx": F.lit(1.0)})
    grid = spark.range(64).select(F.col("id").cast("int").alias("i"), (F.col("id") * 0.96875).alias("q"))
    first = geo.resample_rows(rows, grid, 64).select("row", "re", "im")
    turned = spectral.turn(first, 64, 64)
    axis = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: p * (1 + (F.col("row") % 64) / 1024.0))
    return frames.to_long(geo.resample_cross(turned.withColumn("axis", axis), grid).select("row", "re", "im"))


@query("WITH g AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events), n AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY event_id) - t AS step FROM g) SELECT user_id, event_id, round(1e6 / CASE WHEN step <> 0 THEN step END, 9) AS inv FROM n")
def reciprocal_steps(spark, d):
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    e = frames.read(spark, d, "events").select("user_id", F.col("event_id").alias("i"), us.alias("t"))
    return geo.reciprocals(e, "user_id").select("user_id", F.col("i").alias("event_id"), F.round(1e6 * F.col("inv"), 9).alias("inv"))


def _kernel_sql():
    rows = [(n, q, k, c) for n in _KERNELS for q in range(8) for k, c in zip(range(-3, 5), interp.kernel(n, 4, q / 8), strict=True)]
    return "taps AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {q}, {k}, {c!r})" for n, q, k, c in rows) + ") v(name, q, k, c))"


_KERNELS = ("sinc", "lanczos", "hamming", "kaiser", "lagrange")


@query(
    f"WITH {_kernel_sql()}, pt AS (SELECT vec_id, CAST(floor((CAST(embedding[1] AS DOUBLE) + 4) * 1024) AS BIGINT) % 8 AS q, (1 + vec_id % 31) * pi() / 32 AS w FROM embeddings), "
    "r AS (SELECT vec_id, name, w, q / 8.0 AS mu, sum(c * cos(w * k)) AS re, sum(c * sin(w * k)) AS im FROM pt JOIN taps USING (q) GROUP BY ALL) "
    "SELECT vec_id, name, round(sqrt(re * re + im * im), 6) AS gain, round(20 * log10(greatest(sqrt(pow(re - cos(w * mu), 2) + pow(im - sin(w * mu), 2)), 1e-6)), 3) + 0.0 AS error_db FROM r"
)
def kernel_study(spark, d):
    """The response of every kernel at the delay and the frequency that a vector names; errors below a millionth count as that."""
    q = F.pmod(F.floor((F.get("embedding", F.lit(0)).cast("double") + 4) * 1024), F.lit(8))
    at = frames.read(spark, d, "embeddings").select("vec_id", (q / 8.0).alias("mu"), ((1 + F.col("vec_id") % 31) * F.pi() / 32).alias("w"))
    taps = [(n, k / 8, interp.kernel(n, 4, k / 8)) for n in _KERNELS for k in range(8)]
    got = interp.kernel_response(at, spark.createDataFrame(taps, "name string, mu double, c array<double>"), -3, 1e-6)
    return got.select("vec_id", "name", r6(F.col("gain"), "gain"), (F.round("error_db", 3) + 0.0).alias("error_db"))


# ---- raster queries and metrics --------------------------------------------------------------


@query(f"WITH {s.IMAGE}, d AS (SELECT max(row) + 1 AS h FROM img) SELECT row // 4 AS row, CAST(col // 4 AS BIGINT) AS col, round(avg(mag), 6) AS mag FROM img, d WHERE row < h - h % 4 GROUP BY row // 4, col // 4")
def multilook(spark, d):
    img = _image(spark, d)
    h = frames.read(spark, d, "embeddings").count() // 2
    return raster.multilook(img, 4, h, 64).select("row", "col", r6(F.col("mag"), "mag"))


@query(f"WITH {s.IMAGE} SELECT row // 32 AS band, CAST(sum(mag) AS BIGINT) AS energy FROM img GROUP BY 1")
def band_energy(spark, d):
    return raster.band_energy(_image(spark, d), 32)


@query(f"WITH {s.IMAGE}, b AS (SELECT row // 32 AS band, CAST(sum(mag) AS BIGINT) AS energy FROM img GROUP BY 1) SELECT band, energy FROM b ORDER BY energy DESC, band LIMIT 1")
def brightest_band(spark, d):
    return raster.band_energy(_image(spark, d), 32).orderBy(F.desc("energy"), "band").limit(1)


@query(f"WITH {s.IMAGE}, c AS (SELECT *, row % 7 = 0 OR col > 60 AS dim FROM img), w AS (SELECT row, col, CASE WHEN dim THEN 0 ELSE mag END AS mag FROM c), r AS (SELECT row, avg(mag) AS m FROM w GROUP BY row), k AS (SELECT col, avg(mag) AS m FROM w GROUP BY col) "
       "SELECT * FROM (SELECT min(row) AS r0, max(row) AS r1 FROM r WHERE m > 0.25 * (SELECT median(m) FROM r)), (SELECT min(col) AS c0, max(col) AS c1 FROM k WHERE m > 0.25 * (SELECT median(m) FROM k))")
def valid_extent(spark, d):
    img = _image(spark, d).withColumn("mag", F.when((F.col("row") % 7 == 0) | (F.col("col") > 60), 0).otherwise(F.col("mag")))
    return raster.valid_extent(img)


@query(f"WITH {s.IMAGE} SELECT mag, count(*) AS n FROM img GROUP BY mag")
def histogram(spark, d):
    return raster.histogram(_image(spark, d))


_CDF = "h AS (SELECT mag, count(*) AS n FROM img GROUP BY mag)"


@query(f"WITH {s.IMAGE}, {_CDF} SELECT mag, n, round(greatest(1e-9, least(1 - 1e-9, (sum(n) OVER (ORDER BY mag) - 0.5 * n) / sum(n) OVER ())), 9) AS cdf FROM h")
def normal_score_cdf(spark, d):
    return raster.midpoint_cdf(raster.histogram(_image(spark, d))).select("mag", "n", F.round("cdf", 9).alias("cdf"))


@query()
def normal_score_lut(spark, d):
    img = _image(spark, d)
    return raster.apply_lut(img, raster.normal_scores(raster.histogram(img)), "z").select("row", "col", "mag", r6(F.col("z"), "z"))


@query(f"WITH {s.IMAGE} SELECT round(quantile_cont(mag, 0.997), 6) AS p997, round(quantile_cont(mag, 0.05), 6) AS p5, CAST(median(mag) AS DOUBLE) AS p50 FROM img")
def percentiles(spark, d):
    q = lambda p, n: r6(F.percentile("mag", F.lit(p)), n)
    return _image(spark, d).agg(q(0.997, "p997"), q(0.05, "p5"), F.median("mag").cast("double").alias("p50"))


@query(f"WITH {s.IMAGE}, p AS (SELECT quantile_cont(mag, 0.997) AS p FROM img) SELECT row, col, CAST(floor(greatest(0.0, least(255.0, mag / (p + 1e-12) * 255))) AS INTEGER) AS u8 FROM img, p")
def stretch_u8(spark, d):
    return raster.stretch_u8(_image(spark, d))


@query(f"WITH {s.IMAGE}, p AS (SELECT 20 * log10(quantile_cont(mag, 0.997) + 1e-6) AS t FROM img) SELECT row, col, round(pow(greatest(0.0, least(1.0, (20 * log10(mag + 1e-6) - t + 28.0) / 28.0)), 0.85), 6) AS v FROM img, p")
def stretch_db(spark, d):
    return raster.stretch_db(_image(spark, d)).select("row", "col", r6(F.col("v"), "v"))


@query(f"WITH {s.IMAGE}, x AS (SELECT row, col, ln(1 + CAST(mag AS DOUBLE)) AS x FROM img), p AS (SELECT quantile_cont(x, 0.3) AS a, quantile_cont(x, 0.995) AS b FROM x) SELECT row, col, round(greatest(0.0, least(1.0, (x - a) / greatest(b - a, 1e-12))), 6) AS v FROM x, p")
def stretch_log(spark, d):
    return raster.stretch_log(_image(spark, d)).select("row", "col", r6(F.col("v"), "v"))


_REF = s.IMAGE + ", q AS (SELECT row, col, (mag // 64) * 64 AS mag FROM img), m AS (SELECT max(mag) AS rm FROM img), n AS (SELECT max(mag) AS tm FROM q), p AS (SELECT img.mag / (CAST(rm AS DOUBLE) + 1e-30) AS r, q.mag / (CAST(tm AS DOUBLE) + 1e-30) AS t FROM img JOIN q USING (row, col), m, n), a AS (SELECT sqrt(avg(r * r)) AS rr, sqrt(avg((t - r) * (t - r))) + 1e-30 AS re, corr(r, t) AS corr, max(abs(t - r)) AS max_err, avg(t - r) AS bias FROM p)"


@query(f"WITH {_REF} SELECT round(re / rr, 6) AS nrmse, round(20 * log10(rr / re), 6) AS snr_db, round((20 * log10(rr / re) - 1.76) / 6.02, 6) AS enob, round(corr, 6) AS corr, round(max_err, 6) AS max_err, round(bias, 6) AS bias FROM a")
def compare_metrics(spark, d):
    img = _image(spark, d)
    got = raster.compare(img, img.withColumn("mag", F.floor(F.col("mag") / 64).cast("int") * 64))
    return got.select(*[r6(F.col(c), c) for c in got.columns])


@query(f"WITH {s.IMAGE} SELECT round(20 * log10(quantile_cont(mag, 0.9999) / (quantile_cont(mag, 0.05) FILTER (mag > 0) + 1e-12)), 6) AS dr_db FROM img")
def dynamic_range(spark, d):
    return raster.dynamic_range(_image(spark, d)).select(r6(F.col("dr_db"), "dr_db"))


_CC = "p AS (SELECT CAST(re AS DOUBLE) AS re, CAST(im AS DOUBLE) AS im, CAST(im + (col % 3) AS DOUBLE) AS br, CAST(-re AS DOUBLE) AS bi FROM iql), t AS (SELECT sum(re * br + im * bi) AS dr, sum(im * br - re * bi) AS di, sum(re * re + im * im) AS aa, sum(br * br + bi * bi) AS bb, max(greatest(abs(re - br), abs(im - bi))) AS max_lsb, count(*) FILTER (greatest(abs(re - br), abs(im - bi)) > 0) AS n_bad FROM p)"


@query(f"WITH {s.LONG}, {_CC} SELECT round(sqrt((dr * dr + di * di) / (aa * bb)), 6) AS corr, round(dr / bb, 6) AS gain_re, round(di / bb, 6) AS gain_im, round(sqrt(greatest(0.0, aa - (dr * dr + di * di) / bb) / aa), 6) AS nrmse, max_lsb, n_bad FROM t")
def complex_corr(spark, d):
    f = _long(spark, d)
    turned = f.select("row", "col", (F.col("im") + F.col("col") % 3).alias("re"), (-F.col("re")).alias("im"))
    got = raster.complex_match(f, turned)
    return got.select(*[r6(F.col(c), c) for c in ("corr", "gain_re", "gain_im", "nrmse")], "max_lsb", "n_bad")


@query(f"WITH {s.IMAGE}, {_H}, v AS ({_DIHEDRAL}), b AS (SELECT orient, round(corr(CAST(a.mag AS DOUBLE), CAST(v.mag AS DOUBLE)), 6) AS corr FROM img a CROSS JOIN h JOIN v ON v.row = a.col AND v.col = h - 1 - a.row GROUP BY orient) SELECT orient, corr FROM b")
def orientation_search(spark, d):
    img = _image(spark, d)
    h = _height(img)
    turned = img.select(F.col("col").cast("long").alias("row"), (h - 1 - F.col("row")).alias("col"), "mag")
    got = raster.orientation_correlations(turned, img, h, 64)
    return got.select("orient", r6(F.col("corr"), "corr"))


@query(f"WITH {s.IMAGE} SELECT row, col, mag FROM img ORDER BY mag DESC, row, col LIMIT 1")
def brightest_pixel(spark, d):
    return raster.brightest(_image(spark, d))


@query(f"WITH {s.IMAGE}, b AS (SELECT row AS pr, col AS pc, mag AS peak FROM img ORDER BY mag DESC, row, col LIMIT 1) SELECT peak, max(mag) AS side, round(20 * log10((max(mag) + 1e-12) / peak), 6) AS pslr_db FROM img, b WHERE abs(row - pr) <= 16 AND abs(col - pc) <= 16 AND (abs(row - pr) > 2 OR abs(col - pc) > 2) GROUP BY peak")
def pslr(spark, d):
    got = raster.pslr(_image(spark, d))
    return got.select("peak", "side", r6(F.col("pslr_db"), "pslr_db"))


@query(
    "WITH l AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS p FROM embeddings), k AS (SELECT *, list_position(p, list_max(p)) AS k FROM l), "
    "m AS (SELECT *, list_filter(range(1, 65), lambda i: coalesce(p[nullif(i - 1, 0)], p[i]) >= p[i] AND coalesce(p[i + 1], p[i]) >= p[i]) AS low FROM k), "
    "e AS (SELECT *, coalesce(list_max(list_filter(low, lambda i: i < k)), 0) AS a, coalesce(list_min(list_filter(low, lambda i: i > k)), 65) AS b FROM m), "
    "s AS (SELECT vec_id, p[k] AS top, list_filter(range(1, 65), lambda i: i > a AND i < b) AS main, list_filter(range(1, 65), lambda i: i <= a OR i >= b) AS rest, list_filter(range(1, 65), lambda i: abs(i - k) > 8) AS far, p FROM e) "
    "SELECT vec_id, round(20 * log10(list_max(list_transform(rest, lambda i: p[i])) / top), 6) AS pslr_db, "
    "round(10 * log10(list_sum(list_transform(rest, lambda i: p[i] * p[i])) / list_sum(list_transform(main, lambda i: p[i] * p[i]))), 6) AS islr_db, "
    "round(20 * log10(list_max(list_transform(far, lambda i: p[i])) / top), 6) AS spur_db FROM s"
)
def psf_1d(spark, d):
    """Of every vector's magnitudes."""
    lines = frames.read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("p"))
    return raster.psf_metrics(lines, "vec_id").select("vec_id", *[r6(F.col(c), c) for c in ("pslr_db", "islr_db", "spur_db")])


@query(f"WITH {s.IMAGE} SELECT max(mag) AS peak, round(avg(mag), 6) AS mean, CAST(median(mag) AS DOUBLE) AS median, round(100.0 * avg(CAST(mag >= 65535 AS DOUBLE)), 6) AS saturated_pct, round(100.0 * avg(CAST(mag > 0 AS DOUBLE)), 6) AS nonzero_pct FROM img")
def saturation_stats(spark, d):
    got = raster.health(_image(spark, d))
    return got.select("peak", r6(F.col("mean"), "mean"), "median", r6(F.col("saturated_pct"), "saturated_pct"), r6(F.col("nonzero_pct"), "nonzero_pct"))


@query("WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events), g AS (SELECT user_id, us, lead(us) OVER (PARTITION BY user_id ORDER BY us) - us AS d FROM e), f AS (SELECT user_id, us, d FROM g WHERE d IS NOT NULL), w AS (SELECT user_id, count(d) OVER k AS n, max(d) OVER k AS hi, min(d) OVER k AS lo FROM f WINDOW k AS (PARTITION BY user_id ORDER BY us ROWS BETWEEN CURRENT ROW AND 30 FOLLOWING)) SELECT user_id, round(max(hi / greatest(CAST(lo AS DOUBLE), 1e-12)), 6) AS worst, round(median(hi / greatest(CAST(lo AS DOUBLE), 1e-12)), 6) AS middle FROM w WHERE n = 31 GROUP BY user_id")
def spacing_uniformity(spark, d):
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    e = frames.read(spark, d, "events").select("user_id", us.alias("us"))
    got = raster.spacing_uniformity(e, "user_id", "us")
    return got.select("user_id", r6(F.col("worst"), "worst"), r6(F.col("middle"), "middle"))


@query("WITH p AS (SELECT c_custkey, (c_custkey * 37 % 1600) / 10.0 - 80 AS lat, (c_custkey * 91 % 3590) / 10.0 - 179.5 AS lon FROM customer) SELECT c_custkey, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(60, CAST(floor((lon + 180) / 6) AS INTEGER) + 1) AS INTEGER) AS epsg FROM p")
def geo_utm_zone(spark, d):
    k = F.col("c_custkey")
    lat, lon = (k * 37 % 1600) / 10.0 - 80, (k * 91 % 3590) / 10.0 - 179.5
    return frames.read(spark, d, "customer").select("c_custkey", raster.utm_epsg(lat, lon).alias("epsg"))


@query(
    """
    WITH p AS (
        SELECT c_custkey, (c_custkey * 37 % 1600) / 10.0 - 80 AS lat, (c_custkey * 91 % 3590) / 10.0 - 179.5 AS lon FROM customer
    ), e AS (
        SELECT *, 6378137.0 AS a, f * (2 - f) AS e2, f * (2 - f) / (1 - f * (2 - f)) AS ep2 FROM p, (SELECT 1 / CAST(298.257223563 AS DOUBLE) AS f)
    ), q AS (
        SELECT *, radians(lat) AS phi, radians(lon) - radians((least(60, floor((lon + 180) / 6) + 1) - 1) * 6 - 177) AS dl FROM e
    ), r AS (
        SELECT *, a / sqrt(1 - e2 * sin(phi) ** 2) AS n, tan(phi) ** 2 AS t, ep2 * cos(phi) ** 2 AS c, cos(phi) * dl AS s,
               a * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * phi - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * sin(2 * phi)
                    + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * sin(4 * phi) - (35 * e2 ** 3 / 3072) * sin(6 * phi)) AS m
        FROM q
    )
    SELECT c_custkey,
           round(0.9996 * n * (s + (1 - t + c) * s ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * s ** 5 / 120) + 500000, 3) AS east,
           round(0.9996 * (m + n * tan(phi) * (s ** 2 / 2 + (5 - t + 9 * c + 4 * c * c) * s ** 4 / 24
                 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * s ** 6 / 720)) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END, 3) AS north
    FROM r
    """
)
def geo_affine(spark, d):
    k = F.col("c_custkey")
    c = frames.read(spark, d, "customer").select("c_custkey", ((k * 37 % 1600) / 10.0 - 80).alias("lat"), ((k * 91 % 3590) / 10.0 - 179.5).alias("lon"))
    e, n = raster.utm(F.col("lat"), F.col("lon"))
    return c.select("c_custkey", F.round(e, 3).alias("east"), F.round(n, 3).alias("north"))


@query(f"WITH {EXTENT} SELECT round(1.0 / (b - a), 6) AS dr, CAST(NULL AS DOUBLE) AS dc FROM ext")
def pixel_spacing(spark, d):
    e = frames.read(spark, d, "embeddings")
    ends = e.agg(F.min(F.array_min("embedding").cast("double")).alias("a"), F.max(F.array_max("embedding").cast("double")).alias("b"))
    dr, dc = geo.pixel_spacing(F.col("b") - F.col("a"), F.col("a") - F.col("a"))
    return ends.select(r6(dr, "dr"), dc.alias("dc"))


# ---- catalog, ledgers, telemetry, streams ----------------------------------------------------

SEGS = "segs AS (SELECT doc_id // 10 AS scene_id, CAST(doc_id % 10 AS INTEGER) AS role, CAST(strlen(text) AS BIGINT) AS byte_len FROM documents)"


def _segments(spark, d):
    return frames.read(spark, d, "documents").select(
        F.floor(F.col("doc_id") / 10).cast("long").alias("scene_id"), (F.col("doc_id") % 10).cast("int").alias("role"), F.octet_length("text").cast("long").alias("byte_len"), F.col("text").alias("payload")
    )


_OFF = f"WITH {SEGS}, o AS (SELECT *, CAST(coalesce(sum(CAST(ceil(byte_len / 512.0) AS BIGINT) * 512) OVER (PARTITION BY scene_id ORDER BY role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS blob_off FROM segs)"


@query(f"{_OFF} SELECT scene_id, role, byte_len, blob_off FROM o")
def catalog_offsets(spark, d):
    return ct.offsets(_segments(spark, d)).select("scene_id", "role", "byte_len", "blob_off")


@query(f"{_OFF} SELECT scene_id, role, blob_off FROM o WHERE scene_id = 7")
def job_rebuild(spark, d):
    segs = ct.offsets(_segments(spark, d))
    cat = segs.select("scene_id").distinct()
    return ct.job(cat, segs, 7).select("scene_id", F.explode("at").alias("role", "blob_off"))


@query(
    f"WITH {s.CRC_TABLE}, h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), "
    "y AS (SELECT doc_id, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS y FROM h) "
    "SELECT doc_id // 10 AS scene_id, CAST(doc_id % 10 AS INTEGER) AS role, " f"CASE WHEN y IS NOT NULL THEN {s.crc('y')} END AS got_crc, "
    "CASE WHEN y IS NOT NULL THEN true END AS ok FROM y, tab"
)
def segment_crc(spark, d):
    """Staged segments, read back and checked against the checksums that were staged with them."""
    staged = cut(_segments(spark, d).withColumn("crc", F.crc32(F.col("payload").cast("binary"))))
    return ct.crc_report(staged).select("scene_id", "role", "got_crc", "ok")


@query()
def frame_digest(spark, d):
    return ct.frame_digest(_long(spark, d))


@query("WITH b AS (SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS beats FROM lineitem) SELECT l_suppkey, CASE WHEN beats = 1 THEN 'h1' WHEN beats <= 4 THEN 'h2_4' WHEN beats <= 16 THEN 'h5_16' ELSE 'h17_64' END AS bucket, count(*) AS n FROM b WHERE beats BETWEEN 1 AND 64 GROUP BY 1, 2")
def burst_histogram(spark, d):
    li = frames.read(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("beats"))
    return ct.burst_histogram(li, "l_suppkey", "beats").select("l_suppkey", "bucket", F.col("n").cast("long"))


_BUS = "b AS (SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS beats, count(*) AS aw_count, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) + 5 * count(*) AS busy, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) + 9 * count(*) AS elapsed, count(*) AS r_datawait FROM lineitem GROUP BY 1)"


@query(f"WITH {_BUS} SELECT l_suppkey, round(100.0 * busy / elapsed, 6) AS util_pct, round(beats / CAST(aw_count AS DOUBLE), 6) AS avg_burst, round(100.0 * (elapsed - busy) / elapsed, 6) AS idle_pct, round(100.0 * r_datawait / elapsed, 6) AS wait_pct FROM b")
def bus_ratios(spark, d):
    g = frames.read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("beats"), F.count("*").alias("aw_count"))
    g = g.withColumns({"busy": F.col("beats") + 5 * F.col("aw_count"), "elapsed": F.col("beats") + 9 * F.col("aw_count"), "r_datawait": F.col("aw_count")})
    got = ct.bus_ratios(g)
    return got.select("l_suppkey", *[r6(F.col(c), c) for c in ("util_pct", "avg_burst", "idle_pct", "wait_pct")])


@query("SELECT l_orderkey, l_linenumber, round((CAST(l_quantity AS BIGINT) * 10) / CAST(l_partkey AS DOUBLE), 4) AS ii FROM lineitem WHERE l_partkey > 0")
def initiation_interval(spark, d):
    li = frames.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") * 10).alias("busy"), F.col("l_partkey").alias("elements"), F.lit(1.0).alias("scheduled"))
    return ct.initiation_interval(li).select("l_orderkey", "l_linenumber", "ii")


@query("SELECT event_type AS phenomenon, count(*) AS n, min(epoch_us(ts)) AS first_ts, max(epoch_us(ts)) AS last_ts, arg_max(value, ts) AS last_value, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def ledger_rollup(spark, d):
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    led = frames.read(spark, d, "events").select(F.col("event_type").alias("phenomenon"), us.alias("ts"), "value")
    got = ct.ledger_rollup(led)
    return got.select("phenomenon", "n", "first_ts", "last_ts", "last_value", r6(F.col("mean_value"), "mean_value"))


@query("WITH e AS (SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS elapsed FROM events), k AS (SELECT * FROM e WHERE elapsed IS NOT NULL) SELECT user_id, event_id, elapsed, round(elapsed / CAST(sum(elapsed) OVER (PARTITION BY user_id) AS DOUBLE), 6) AS share FROM k")
def stage_shares(spark, d):
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    e = frames.read(spark, d, "events").select("user_id", "event_id", us.alias("us")).withColumn("o", F.struct("us", "event_id"))
    return ct.stage_shares(e, "user_id", "o", "us").select("user_id", "event_id", "elapsed", r6(F.col("share"), "share"))


@query("WITH c AS (SELECT o_orderkey, o_custkey % 9000 + 100 AS m, o_orderkey % 7000 + 100 AS n FROM orders) SELECT o_orderkey, round(6.4 * (CAST(m AS DOUBLE) * n / 24333246.0) * log2(CAST(m AS DOUBLE) * n) / log2(24333246.0), 6) AS est_seconds, round(2.0 * (CAST(m AS DOUBLE) * n) / 24333246.0, 6) AS est_gb FROM c")
def resource_estimate(spark, d):
    c = frames.read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 9000 + 100).alias("m"), (F.col("o_orderkey") % 7000 + 100).alias("n"))
    got = ct.estimate(c, 24333246.0, 6.4, 2.0)
    return got.select("o_orderkey", r6(F.col("est_seconds"), "est_seconds"), r6(F.col("est_gb"), "est_gb"))


@query("SELECT CAST(w AS INTEGER) AS w, CAST(least(n, ((w * ((n + 31) // 32)) // 6) * 32) AS BIGINT) AS a, CAST(least(n, (((w + 1) * ((n + 31) // 32)) // 6) * 32) AS BIGINT) AS b FROM range(0, 6) t(w), (SELECT count(*) AS n FROM lineitem)")
def worker_bounds(spark, d):
    n = frames.read(spark, d, "lineitem").count()
    rows = [(w, a, b) for w, (a, b) in enumerate(slicing.worker_bounds(n, 6, 32))]
    return spark.createDataFrame(rows, "w int, a long, b long")


@query("SELECT event_id, CAST((event_id // 16) % 3 AS INTEGER) AS chain, CAST((event_id // 16) // 3 * 16 + event_id % 16 AS BIGINT) AS place FROM events")
def block_cyclic(spark, d):
    chain, place = slicing.block_cyclic(F.col("event_id"), 16, 3)
    return frames.read(spark, d, "events").select("event_id", chain.alias("chain"), place.alias("place"))


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS upto FROM events")
def cumulative_axis(spark, d):
    e = frames.read(spark, d, "events").select("user_id", "event_id", "value")
    return scan.running(e, F.col("value"), ["event_id"], ["user_id"], inclusive=True).select("user_id", "event_id", F.round("upto", 4).alias("upto"))


@query("SELECT epoch_us(time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01')) AS w_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    got = windowed_counts(frames.read(spark, d, "events"))
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("w_start").cast("timestamp_ntz"))
    return got.select(us.alias("w_us"), "event_type", "n", F.round("total", 4).alias("total"))


# ---- whole-block exponents, float paths, tables, layout --------------------------------------


@query(_rows_sql(*s.pass_block("sq", "f"), more=", CAST(exp AS INTEGER) AS exp"))
def fft_row_block(spark, d):
    return _rows_out(spectral.pass_block(_looks(spark, d), 64), "exp")


@query(_rows_sql(*s.pass_rescaled("sq", "f"), more=", CAST(exp AS INTEGER) AS exp"))
def fft_row_rescaled(spark, d):
    return _rows_out(spectral.pass_block(_looks(spark, d), 64, rescale=True), "exp")


_TAPERED = "win AS (SELECT row, col, re * (0.54 - 0.46 * cos(2 * pi() * (row % 64) / 63)) * (0.54 - 0.46 * cos(2 * pi() * col / 63)) AS re, im * (0.54 - 0.46 * cos(2 * pi() * (row % 64) / 63)) * (0.54 - 0.46 * cos(2 * pi() * col / 63)) AS im FROM iqd)"


_TAPERED_WHOLE = _TAPERED.replace("(row % 64) / 63", "row / (h - 1)").replace("FROM iqd)", "FROM iqd, (SELECT max(row) + 1 AS h FROM iq))")


@query(f"WITH {s.LONG}, {_LONGD}, {_TAPERED_WHOLE}, {s.dft2_whole('win', 'f', 64)} SELECT row, col, round(sqrt(re * re + im * im), 1) AS amp FROM f")
def quicklook(spark, d):
    """Of the whole frame."""
    rows = _iq(spark, d)
    got = frames.to_long(tall.fft2(rows, _height(rows), 64, taper=True))
    return got.select("row", "col", F.round(F.hypot("re", "im"), 1).alias("amp"))


@query(f"WITH {s.LONG}, {_LONGD}, pad AS (SELECT row // 40 * 64 + row % 40 AS row, col, re, im FROM iqd), {s.dft2('pad', 'f', 64, 64)} SELECT row, col, round(sqrt(re * re + im * im), 1) AS amp FROM f")
def focus_padded(spark, d):
    """Of every look of 40 lines, padded to 64."""
    img, _ = spectral.focus(_iq(spark, d), 40, 64, (1.0, 1.0))
    return frames.to_long(img).select("row", "col", F.round(F.hypot("re", "im"), 1).alias("amp"))


_POLAR = (
    PULSES.replace("SELECT vec_id AS row,", "SELECT vec_id // 2 AS row,").replace("FROM embeddings)", "FROM embeddings WHERE vec_id % 2 = 0)")
    + """, mean AS (SELECT avg(ax) AS mx, avg(ay) AS my FROM pulses), pl AS (
    SELECT row, 1 + (ax * mx + ay * my) / sqrt(mx * mx + my * my) / 64 AS x0, 1 / 64.0::DOUBLE AS dx, (ay * mx - ax * my) / (ax * mx + ay * my) AS tan FROM pulses, mean),
    e AS (SELECT min(x0) AS lo, max(x0 + dx * 63) AS hi, max(abs(tan)) AS tan FROM pl),
    kr AS (SELECT j, lo + j * ((hi - lo) / 63) AS kr FROM e, range(0, 64) t(j)),
    kc AS (SELECT i, -edge + i * (2 * edge / 63) AS kc FROM (SELECT (SELECT max(abs(kr)) FROM kr) * tan AS edge FROM e), range(0, 64) t(i)),
    t1 AS (SELECT iq.row, j, tan, re, im, (kr - x0) / dx AS t FROM iq JOIN pl USING (row), kr),
    t2 AS (SELECT *, t >= -1e-9 AND t <= 63 + 1e-9 AS ok, greatest(0, least(63, t)) AS tc FROM t1),
    t3 AS (SELECT *, CAST(least(62, floor(tc)) AS BIGINT) AS k FROM t2),
    r AS (SELECT row // 64 AS look, j, tan, CASE WHEN ok THEN re[k + 1] + (re[k + 2] - re[k + 1]) * (tc - k) ELSE 0 END AS re, CASE WHEN ok THEN im[k + 1] + (im[k + 2] - im[k + 1]) * (tc - k) ELSE 0 END AS im FROM t3),
    ends AS (SELECT look, min(tan) AS a, max(tan) AS b FROM r GROUP BY look),
    q AS (SELECT look, j, i, kc / kr AS u, a, b FROM ends, kr, kc),
    q2 AS (SELECT look, j, i, greatest(a, least(b, u)) AS u, u >= a - 1e-9 AND u <= b + 1e-9 AS ok FROM q),
    lo AS (SELECT q2.*, s.tan AS t0, s.re AS r0, s.im AS i0 FROM q2 ASOF LEFT JOIN r s ON q2.look = s.look AND q2.j = s.j AND q2.u >= s.tan),
    hi AS (SELECT lo.*, s.tan AS t1, s.re AS r1, s.im AS i1 FROM lo ASOF LEFT JOIN r s ON lo.look = s.look AND lo.j = s.j AND lo.u < s.tan),
    f AS (SELECT *, CASE WHEN t1 IS NULL THEN 0.0 ELSE (u - t0) / (t1 - t0) END AS f FROM hi)
    SELECT look * 64 + j AS row, CAST(i AS INTEGER) AS col, round(CASE WHEN ok THEN r0 + coalesce(r1 - r0, 0) * f ELSE 0 END, 3) + 0.0 AS re, round(CASE WHEN ok THEN i0 + coalesce(i1 - i0, 0) * f ELSE 0 END, 3) + 0.0 AS im FROM f"""
)


@query(f"WITH {s.IQ}, {_POLAR}")
def polar_format(spark, d):
    """Of every look of 64 lines; a line's pulse is that of its even vector."""
    p = geo.wavenumbers(_pulses(spark, d).where("row % 2 = 0").withColumn("row", F.floor(F.col("row") / 2).cast("long")))
    p = p.select("row", (F.lit(1.0) + F.col("pr") / 64).alias("x0"), (F.lit(1.0) / 64).alias("dx"), "tan_phi")
    got = frames.to_long(geo.polar_format(_iq(spark, d), p, 64, 64))
    return got.select("row", "col", *[(F.round(c, 3) + 0.0).alias(c) for c in ("re", "im")])


@query(s.image("perrow", frame=_RANGE + ", sq AS (SELECT row, list(CAST(re AS BIGINT) ORDER BY i) AS re, list(CAST(im AS BIGINT) ORDER BY i) AS im FROM r GROUP BY row)"))
def form_image_device(spark, d):
    """Resampling on a uniform grid, pulses in angle order, tapers, per-row exponents with global renormalisation, detection."""
    rows = _looks(spark, d).withColumns({"x0": F.lit(0.0) + F.col("row") / 256.0, "dx": F.lit(1.0)})
    grid = spark.range(64).select(F.col("id").cast("int").alias("i"), (F.col("id") * 0.96875).alias("q"))
    return imaging.form_image(geo.resample_rows(rows, grid, 64).select("row", "re", "im"), 64, 64, "perrow")


@query(f"SELECT vec_id, CAST({s.cos_q15('(vec_id % 32)', 64)} AS INTEGER) AS c, CAST({s.sin_q15('(vec_id % 32)', 64)} AS INTEGER) AS s FROM embeddings")
def twiddle_table(spark, d):
    wr, wi = (F.array(*[F.lit(v) for v in x]) for x in fx.twiddles(64))
    at = (F.col("vec_id") % 32).cast("int")
    return frames.read(spark, d, "embeddings").select("vec_id", F.get(wr, at).alias("c"), F.get(wi, at).alias("s"))


@query(f"WITH {s.IQ}, {_COEFF} SELECT CAST((wq * 64) >> 15 AS INTEGER) AS phase, CAST(sum(32768) AS BIGINT) AS total, count(*) AS n FROM c GROUP BY 1")
def sinc_unity(spark, d):
    """The taps of every gather of the frame add up to one whole."""
    rows = F.array(*[F.array(*[F.lit(c).cast("long") for c in r]) for r in _TABLE])
    phase = fx.shr(F.col("wq").cast("long") * 64, 15).cast("int")
    add = F.aggregate(F.get(rows, F.col("phase")), F.lit(0).cast("long"), lambda s, v: s + v)
    return _coeffs(spark, d).select(phase.alias("phase")).groupBy("phase").agg(F.sum(add).alias("total"), F.count("*").alias("n"))


@query(f"WITH {s.IMAGE}, lut AS (SELECT mag, mag * 2 + 1 AS y FROM img GROUP BY mag HAVING mag % 3 = 0) SELECT row, col, CAST(coalesce(y, 0) AS DOUBLE) AS y FROM img LEFT JOIN lut USING (mag)")
def lut_apply(spark, d):
    img = _image(spark, d)
    lut = img.where("mag % 3 = 0").select("mag", (F.col("mag") * 2 + 1).cast("double").alias("y")).distinct()
    return raster.apply_lut(img, lut, "y").select("row", "col", "y")


@query("SELECT vec_id, CAST(j AS INTEGER) AS j, ((vec_id % 64) * 511 * j * 257) >> 15 AS w FROM embeddings, range(0, 64) b(j)")
def outer_taper(spark, d):
    j = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j")
    return frames.read(spark, d, "embeddings").select("vec_id", j).select("vec_id", "j", fx.shr((F.col("vec_id") % 64) * 511 * F.col("j") * 257, 15).cast("long").alias("w"))


@query("SELECT vec_id, round(floor((CAST(embedding[1] AS DOUBLE) + 4) / 8 / pow(2.0, -7)) * pow(2.0, -7), 9) AS t FROM embeddings")
def truncated_weights(spark, d):
    t = (F.get("embedding", F.lit(0)).cast("double") + 4) / 8
    return frames.read(spark, d, "embeddings").select("vec_id", F.round(interp.truncated_weight(t, 8), 9).alias("t"))


@query(f"WITH {s.IQ}, {_COEFF} SELECT count(*) AS n, round(avg(CAST(wq / 32768.0 BETWEEN 0.3 AND 0.7 AS DOUBLE)), 6) AS mid_share FROM c")
def fractional_delays(spark, d):
    got = ct.fractional_delays(_coeffs(spark, d))
    return got.select("n", r6(F.col("mid_share"), "mid_share"))


@query(f"WITH {s.IMAGE} SELECT round(avg(CAST(20 * log10(greatest(CAST(mag AS DOUBLE), 1e-300) / (SELECT max(mag) FROM img)) >= -20 AS DOUBLE)), 6) AS share FROM img")
def occupied_bandwidth(spark, d):
    got = ct.occupied_bandwidth(_image(spark, d).select(F.col("mag").cast("double").alias("amp")))
    return got.select(r6(F.col("share"), "share"))


@query("WITH s AS (SELECT l_orderkey * 8 + l_linenumber AS scene_id, CAST(sum(l_partkey * 37 + 1) AS BIGINT) AS byte_len FROM lineitem GROUP BY 1) SELECT scene_id, byte_len, CAST(8 + coalesce(sum(CAST(ceil(byte_len / 512.0) AS BIGINT)) OVER (ORDER BY scene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lba FROM s")
def image_layout(spark, d):
    """Every place that lineitem's keys name as a segment of one image."""
    li = frames.read(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("scene_id"), (F.col("l_partkey") * 37 + 1).alias("byte_len"))
    return ct.image_layout(li.groupBy("scene_id").agg(F.sum("byte_len").alias("byte_len")), 8).select("scene_id", "byte_len", "lba")


@query(f"WITH {s.LONG} SELECT row, CAST(col - 16 AS INTEGER) AS col, re FROM iql WHERE col >= 16 AND col < 48")
def centre_pow2_crop(spark, d):
    return slicing.centre_crop(_long(spark, d), 64, 32).select("row", "col", "re")


@query("SELECT event_type AS phenomenon, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1")
def ledger_filter(spark, d):
    return frames.read(spark, d, "events").where("event_type = 'click'").groupBy(F.col("event_type").alias("phenomenon")).agg(F.count("*").alias("n"))


# ---- long lines, split transforms, integer merge scan ----------------------------------------


@query(
    f"WITH x AS (SELECT vec_id AS i, CAST(floor(4096 * CAST(embedding[1] AS DOUBLE)) AS DOUBLE) AS x FROM embeddings), n AS (SELECT CAST(pow(2, ceil(log2(max(i) + 1))) AS BIGINT) AS n FROM x) "
    "SELECT k AS i, round(sum(x * cos(2 * pi() * ((i * k) % n) / n)), 1) + 0.0 AS re, round(-sum(x * sin(2 * pi() * ((i * k) % n) / n)), 1) + 0.0 AS im FROM x, n, (SELECT unnest(range(0, n)) AS k FROM n) g GROUP BY k"
)
def fft_long(spark, d):
    """One line of the first component of every vector, whatever its length."""
    x = frames.read(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.floor(F.get("embedding", F.lit(0)).cast("double") * 4096).cast("double").alias("x"))
    n1, n2 = longline.shape((x.agg(F.max("i")).first()[0] or 0) + 1)
    lines = frames.to_packed(x.select(F.floor(F.col("i") / n2).cast("long").alias("row"), (F.col("i") % n2).alias("col"), F.col("x").alias("re"), F.lit(0.0).alias("im")), n2, "<f8")
    got = longline.samples(longline.fft_long(lines, n1, n2), n1)
    return got.select("i", *[(F.round(c, 1) + 0.0).alias(c) for c in ("re", "im")])


def _split_sql() -> str:
    half = lambda name, odd: f"{name} AS (SELECT row, list_transform(range(0, 32), lambda i: re[2 * i + {1 + odd}]) AS re, list_transform(range(0, 32), lambda i: im[2 * i + {1 + odd}]) AS im FROM sq)"
    (ea, e), (ob, o) = (s.pass_rescaled(n, n, 32, by_line=True) for n in ("ev", "od"))
    cut = lambda v, by: f"(sign({v}) * (abs({v}) >> ({by})))"
    c, d = s.cos_q15("(i - 1)", 64), s.sin_q15("(i - 1)", 64)
    turned = lambda prod: cut(f"CAST({prod} AS BIGINT)", "15")
    tr, ti = turned(f"({c} * br[i] - {d} * bi[i])"), turned(f"({c} * bi[i] + {d} * br[i])")
    whole = lambda a, t: f"list_concat(list_transform(range(1, 33), lambda i: {a}[i] + {t}), list_transform(range(1, 33), lambda i: {a}[i] - {t}))"
    low = lambda x, e, to: f"list_transform({x}, lambda v: CAST({cut('v', f'g - {e}')} AS BIGINT)) AS {to}"
    return (
        f"WITH {s.SQUARE}, {half('ev', 0)}, {half('od', 1)}, {ea}, {ob}, b AS (SELECT e.row, e.re AS er, e.im AS ei, o.re AS od_r, o.im AS od_i, e.exp AS ea, o.exp AS eb, greatest(e.exp, o.exp) AS g FROM {e} e JOIN {o} o USING (row)), "
        f"a AS (SELECT row, g, {low('er', 'ea', 'ar')}, {low('ei', 'ea', 'ai')}, {low('od_r', 'eb', 'br')}, {low('od_i', 'eb', 'bi')} FROM b), "
        f"y AS (SELECT row, g, {whole('ar', tr)} AS re, {whole('ai', ti)} AS im FROM a), m AS (SELECT *, CAST({s.PEAK} AS BIGINT) AS m FROM y), "
        f"k AS (SELECT *, greatest(0, {s.bits('(m - 1)')} - 15) AS more FROM m) "
        f"SELECT row, CAST(unnest(range(0, 64)) AS INTEGER) AS col, CAST(unnest(list_transform(re, lambda v: {cut('CAST(v AS BIGINT)', 'more')})) AS BIGINT) AS re, "
        f"CAST(unnest(list_transform(im, lambda v: {cut('CAST(v AS BIGINT)', 'more')})) AS BIGINT) AS im, CAST(g + more AS INTEGER) AS exp FROM k"
    )


@query(_split_sql())
def fft_split(spark, d):
    """Every line's transform from those of its even and odd samples, under block exponents."""
    return _rows_out(longline.fft_split(_looks(spark, d), 64), "exp")


_SCAN_T = "((epoch_us(ts) - 1704067200000000) // 2000)"


@query(
    f"""WITH ax AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS k, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM (SELECT DISTINCT user_id, {_SCAN_T} AS ts FROM events WHERE event_id % 4 <> 0)),
    q AS (SELECT user_id, event_id, {_SCAN_T} AS q, 4096.0::DOUBLE * (1 + user_id / 1000.0::DOUBLE) / (1 + user_id % 5 * 7) AS unit, CASE WHEN event_id % 97 = 0 THEN 140737488355300 ELSE user_id % 7 * 4096 END AS b FROM events WHERE event_id % 4 = 0),
    sc AS (SELECT *, list_max(list_filter(range(0, 25), lambda s: floor(unit * pow(2.0, s) + 0.5) BETWEEN -2147483648 AND 2147483647 AND floor(unit * pow(2.0, s) + 0.5) <> 0)) AS sh FROM q),
    p AS (SELECT user_id, event_id, sh, (q * CAST(floor(unit * pow(2.0, sh) + 0.5) AS BIGINT)) >> sh AS p, b FROM sc),
    v AS (SELECT user_id, event_id, sh, p, {s.wrap48('p')} + b AS w FROM p),
    a AS (SELECT user_id, event_id, sh, {s.wrap48('w')} AS v, NOT (p BETWEEN -140737488355328 AND 140737488355327) OR NOT (w BETWEEN -140737488355328 AND 140737488355327) AS sat FROM v),
    j AS (SELECT a.*, ax.k, ax.ts, ax.nx FROM a ASOF LEFT JOIN ax ON a.user_id = ax.user_id AND a.v >= ax.ts * 4096),
    f AS (SELECT *, k IS NOT NULL AND nx IS NOT NULL AND NOT sat AS ok, v - ts * 4096 AS d, (2147483648 + (nx - ts)) // (2 * (nx - ts)) AS inv FROM j)
    SELECT user_id, event_id, CAST(sh AS INTEGER) AS shift, v, sat, CASE WHEN ok THEN k ELSE -1 END AS idx, CAST(CASE WHEN NOT ok OR d >= 4294967296 THEN 0 ELSE least(32767, (d * inv) >> 27) END AS INTEGER) AS wq FROM f"""
)
def merge_scan(spark, d):
    """Every fourth event under its user's scaled affine map, bracketed among the user's other events in integers."""
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    e = frames.read(spark, d, "events").select("user_id", "event_id", F.floor((us - 1704067200000000) / 2000).cast("long").alias("ts"))
    u = F.col("user_id")
    a, shift = interp.scaled_unit(4096.0 * (1 + u / 1000.0) / (1 + u % 5 * 7), 24)
    b = F.when(F.col("event_id") % 97 == 0, 140737488355300).otherwise(u % 7 * 4096)
    q = e.where("event_id % 4 = 0").select("user_id", "event_id", "ts", a.alias("a"), shift.alias("shift"), b.alias("b"))
    v, sat = interp.affine48(F.col("ts"), F.col("a"), F.col("shift"), F.col("b"))
    q = q.select("user_id", "event_id", "shift", v.alias("v"), sat.alias("sat"))
    got = interp.merge_scan(q, e.where("event_id % 4 <> 0"), "user_id", width=4096 * 1.8e6)
    return got.select("user_id", "event_id", "shift", "v", "sat", "idx", "wq")


# ---- scene files in, georeferenced images out ------------------------------------------------


@query(
    f"WITH {s.LONG} SELECT row // 64 AS scene, row % 64 AS row, CAST(col AS INTEGER) AS col, CAST(re AS DOUBLE) AS re, CAST(im AS DOUBLE) AS im, 1 + row / 1024.0::DOUBLE AS f0, CAST(4 * 45 AS BIGINT) AS read_bytes "
    "FROM iql WHERE row % 64 % 2 = 1 AND col BETWEEN 8 AND 55 AND col % 4 = 0"
)
def read_chip(spark, d):
    """The frame's looks of 64 lines as phase history files, of which every second row and every fourth of 48 columns is read back."""
    folder = f"{shared_dir(spark)}/scenes/{uuid.uuid4().hex}"
    lines = _iq(spark, d).select(F.floor(F.col("row") / 64).cast("long").alias("scene"), (F.col("row") % 64).alias("row"), "re", "im", (1 + F.col("row") / 1024.0).alias("SC0"))
    phasehistory.export(lines, folder, ["SC0"]).agg(F.sum("n_bytes")).collect()
    got = phasehistory.read(spark, folder, "1::2", "8:56:4", ["SC0"])
    flat = got.select("scene", "row", "first_col", "col_step", "read_bytes", F.get(F.col("pvp")["SC0"], F.lit(0)).alias("f0"), F.posexplode(F.arrays_zip("re", "im")).alias("k", "v"))
    return flat.select("scene", "row", (F.col("first_col") + F.col("k") * F.col("col_step")).alias("col"), "v.re", "v.im", "f0", "read_bytes")


def _map_sql(name: str, src: str, x: str, y: str, z: str) -> str:
    """CTE name (c_custkey, e, n): the map place of an ECEF point of src in the zone of its column lon0."""
    return f"""{name}g AS (SELECT *, sqrt(({x}) * ({x}) + ({y}) * ({y})) AS hp, {z} AS pz, {x} AS px, {y} AS py, 6378137.0::DOUBLE AS a, f * (2 - f) AS e2, f * (2 - f) / (1 - f * (2 - f)) AS ep2, 6378137.0::DOUBLE * (1 - f) AS sb FROM {src}, (SELECT 1 / CAST(298.257223563 AS DOUBLE) AS f)),
    {name}h AS (SELECT *, atan2(pz * a, hp * sb) AS bt FROM {name}g),
    {name}i AS (SELECT *, atan2(pz + ep2 * sb * pow(sin(bt), 3), hp - e2 * a * pow(cos(bt), 3)) AS phi, atan2(py, px) AS lam FROM {name}h),
    {name}j AS (SELECT *, a / sqrt(1 - e2 * pow(sin(phi), 2)) AS nn, pow(tan(phi), 2) AS t, ep2 * pow(cos(phi), 2) AS cc, cos(phi) * (lam - radians((least(60, floor((coalesce(lon0, degrees(lam)) + 180) / 6) + 1) - 1) * 6 - 177)) AS s,
        a * ((1 - e2 / 4 - 3 * pow(e2, 2) / 64 - 5 * pow(e2, 3) / 256) * phi - (3 * e2 / 8 + 3 * pow(e2, 2) / 32 + 45 * pow(e2, 3) / 1024) * sin(2 * phi) + (15 * pow(e2, 2) / 256 + 45 * pow(e2, 3) / 1024) * sin(4 * phi) - (35 * pow(e2, 3) / 3072) * sin(6 * phi)) AS m FROM {name}i),
    {name} AS (SELECT c_custkey, degrees(phi) AS lat, degrees(lam) AS lon, 0.9996 * nn * (s + (1 - t + cc) * pow(s, 3) / 6 + (5 - 18 * t + t * t + 72 * cc - 58 * ep2) * pow(s, 5) / 120) + 500000 AS e,
        0.9996 * (m + nn * tan(phi) * (pow(s, 2) / 2 + (5 - t + 9 * cc + 4 * cc * cc) * pow(s, 4) / 24 + (61 - 58 * t + t * t + 600 * cc - 330 * ep2) * pow(s, 6) / 720)) + CASE WHEN phi < 0 THEN 10000000 ELSE 0 END AS n FROM {name}j)"""


@query(
    "WITH b AS (SELECT c_custkey, (c_custkey * 37 % 1500) / 10.0::DOUBLE - 75.05 AS la, (c_custkey * 91 % 3590) / 10.0::DOUBLE - 179.5 AS lo FROM customer), "
    "c AS (SELECT *, 6378137.0::DOUBLE * cos(radians(la)) * cos(radians(lo)) AS cx, 6378137.0::DOUBLE * cos(radians(la)) * sin(radians(lo)) AS cy, 6356752.0::DOUBLE * sin(radians(la)) AS cz, -sin(radians(lo)) AS ux, cos(radians(lo)) AS uy, "
    "-sin(radians(la)) * cos(radians(lo)) AS vx, -sin(radians(la)) * sin(radians(lo)) AS vy, cos(radians(la)) AS vz, 0.5 + c_custkey % 5 AS dr, 0.25 + c_custkey % 3 AS dc, CAST(NULL AS DOUBLE) AS lon0 FROM b), "
    f"{_map_sql('p', 'c', 'cx', 'cy', 'cz')}, cz0 AS (SELECT c.* EXCLUDE (lon0), p.lon AS lon0 FROM c JOIN p USING (c_custkey)), "
    f"{_map_sql('q', 'cz0', 'cx + dr * (0.6 * ux + 0.8 * vx)', 'cy + dr * (0.6 * uy + 0.8 * vy)', 'cz + dr * 0.8 * vz')}, {_map_sql('r', 'cz0', 'cx + dc * (-0.8 * ux + 0.6 * vx)', 'cy + dc * (-0.8 * uy + 0.6 * vy)', 'cz + dc * 0.6 * vz')} "
    "SELECT p.c_custkey, CAST(CASE WHEN p.lat >= 0 THEN 32600 ELSE 32700 END + least(60, CAST(floor((p.lon + 180) / 6) AS INTEGER) + 1) AS INTEGER) AS epsg, round(q.e - p.e, 4) AS e_col, round(r.e - p.e, 4) AS e_row, round(p.e - (q.e - p.e) * 64 - (r.e - p.e) * 32, 2) AS e0, "
    "round(q.n - p.n, 4) AS n_col, round(r.n - p.n, 4) AS n_row, round(p.n - (q.n - p.n) * 64 - (r.n - p.n) * 32, 2) AS n0 FROM p JOIN q USING (c_custkey) JOIN r USING (c_custkey)"
)
def scene_affine(spark, d):
    """The affine of a scene of 64 x 128 samples at every customer's place, whose plane is that of east and north."""
    k = F.col("c_custkey")
    c = frames.read(spark, d, "customer").select("c_custkey", F.radians((k * 37 % 1500) / 10.0 - 75.05).alias("la"), F.radians((k * 91 % 3590) / 10.0 - 179.5).alias("lo"), (0.5 + k % 5).alias("dr"), (0.25 + k % 3).alias("dc"))
    sin, cos, la, lo = F.sin, F.cos, F.col("la"), F.col("lo")
    scenes = c.select(
        "c_custkey", "dr", "dc", F.array(6378137.0 * cos(la) * cos(lo), 6378137.0 * cos(la) * sin(lo), 6356752.0 * sin(la)).alias("centre"),
        F.array(-sin(lo), cos(lo), F.lit(0.0)).alias("uiax"), F.array(-sin(la) * cos(lo), -sin(la) * sin(lo), cos(la)).alias("uiay"),
        F.array(F.lit(0.6), F.lit(0.8)).alias("dhat"), F.array(F.lit(-0.8), F.lit(0.6)).alias("chat"),
    )
    got = raster.scene_affine(scenes, F.lit(64), F.lit(128))
    names = {"e_col": (0, 4), "e_row": (1, 4), "e0": (2, 2), "n_col": (3, 4), "n_row": (4, 4), "n0": (5, 2)}
    return got.select("c_custkey", "epsg", *[F.round(F.get("affine", F.lit(i)), places).alias(k) for k, (i, places) in names.items()])


@query(
    f"WITH {s.LONG}, {_LONGD}, {_TAPERED}, {s.dft2('win', 'f', 64, 64)}, a AS (SELECT sqrt(re * re + im * im) AS amp FROM f) "
    "SELECT round(quantile_cont(amp, 0.05), 3) AS p05, round(quantile_cont(amp, 0.5), 3) AS p50, round(quantile_cont(amp, 0.997), 3) AS p997, round(20 * log10(quantile_cont(amp, 0.9999) / (quantile_cont(amp, 0.05) FILTER (amp > 0) + 1e-12)), 4) AS dr_db FROM a"
)
def percentiles_float(spark, d):
    """Of the float quicklook, by refined histograms."""
    amp = cut(spectral.quicklook(_iq(spark, d), 64, 64).select("amp"))
    row = raster.percentiles(amp, [5, 50, 99.7], "amp")
    got = raster.dynamic_range(amp, "amp")
    return got.select(*[F.round(F.lit(v).cast("double"), 3).alias(k) for k, v in zip(("p05", "p50", "p997"), row, strict=True)], F.round("dr_db", 4).alias("dr_db"))
