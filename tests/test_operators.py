import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import fixed as fx
from gridloom.operators import catalog, geometry, imaging, interp, longline, raster, scan, slicing, spectral, tall, tiles
from gridloom.sources import frames, geotiff, phasehistory
from gridloom.streaming.watch import watch, windowed_counts


def rows_of(spark, x):
    return spark.createDataFrame([(i, r.real.astype(int).tolist(), r.imag.astype(int).tolist()) for i, r in enumerate(x)], "row long, re array<long>, im array<long>")


def codes(h, n, seed=0, top=20000):
    r = np.random.default_rng(seed)
    return r.integers(-top, top, (h, n)) + 1j * r.integers(-top, top, (h, n))


def back(df):
    got = df.orderBy("row").collect()
    return np.array([np.array(r["re"]) + 1j * np.array(r["im"]) for r in got])


@pytest.mark.parametrize("n", [2, 8, 64])
def test_expression_and_arrow_transforms_agree(spark, n):
    x = rows_of(spark, codes(3, n))
    assert (back(spectral.fft_full(x, n)) == back(spectral.fft_full_arrow(x, n))).all()


@pytest.mark.parametrize("top", [3, 32767])
def test_kernel_and_expression_passes_agree(spark, top):
    x = rows_of(spark, codes(5, 16, seed=top, top=top) * np.array([1, 0, 1 / 64, 1, 1 / 999])[:, None])
    keep = lambda df, *c: [tuple(r) for r in df.select("row", "re", "im", *c).orderBy("row").collect()]
    for scaling, f in (("l1", spectral.pass_l1), ("global", spectral.pass_global), ("perrow", spectral.pass_perrow)):
        assert keep(spectral.line_pass(x, 16, scaling), "exp") == keep(f(x, 16), "exp")
    assert keep(spectral.line_pass(x, 16, "uncond")) == keep(spectral.pass_uncond(x, 16))


def test_looks_are_formed_alone(spark):
    x = codes(12, 8, top=900)
    pad = spectral.pad_lines(rows_of(spark, x), 8, 8)
    assert pad.count() == 16
    got = {(r["row"], r["col"]): r["mag"] for r in imaging.form_image(pad, 8, 8, "uncond").collect()}
    for k, part in enumerate((x[:8], np.concatenate([x[8:], np.zeros((4, 8))]))):
        alone = imaging.form_image(rows_of(spark, part), 8, 8, "uncond").collect()
        assert len(alone) == 64 and all(got[r["row"] + 8 * k, r["col"]] == r["mag"] for r in alone)


def test_plan_does_not_grow_with_the_line(spark):
    x = spectral.pad_lines(rows_of(spark, codes(1, 512, top=900)), 512, 512)
    img = imaging.form_image(x, 512, 512, "perrow")
    assert len(img._jdf.queryExecution().executedPlan().toString()) < 10_000 and img.count() == 512 * 512


def test_transform_is_close_to_float(spark):
    x = codes(4, 64)
    got, want = back(spectral.fft_full(rows_of(spark, x), 64)), np.fft.fft(x, axis=1)
    assert abs(got - want).max() < 64


def test_per_row_exponents_need_renormalising(spark):
    x = codes(4, 64, top=30000) * np.array([1, 1 / 64, 1, 1 / 256])[:, None]
    r = spectral.pass_perrow(rows_of(spark, np.trunc(x.real) + 1j * np.trunc(x.imag)), 64)
    exps = [q["exp"] for q in r.orderBy("row").collect()]
    assert len(set(exps)) > 1
    got, want = back(spectral.renormalise(r)), np.fft.fft(np.trunc(x.real) + 1j * np.trunc(x.imag), axis=1) / 2 ** max(exps)
    assert abs(got - want).max() < 32  # six stages, each flooring a product and a shift of values that then grow
    assert abs(back(r) - want).max() > 100


def test_zero_rows_stay_zero(spark):
    for scaling in ("l1", "global", "perrow", "uncond"):
        assert (back(spectral.line_pass(rows_of(spark, np.zeros((2, 8), complex)), 8, scaling)) == 0).all()
    for f in (spectral.pass_l1, spectral.pass_global, spectral.pass_perrow, spectral.pass_uncond):
        assert (back(f(rows_of(spark, np.zeros((2, 8), complex)), 8)) == 0).all()


def test_turn_twice_is_identity(spark):
    x = codes(5, 7)
    assert (back(spectral.turn(spectral.turn(rows_of(spark, x), 5, 7), 7, 5)) == x).all()


def test_image_correlates_with_float(spark):
    x = np.zeros((16, 16), complex)
    k = np.arange(16)
    x += 5000 * np.exp(2j * np.pi * (3 * k[:, None] + 5 * k[None, :]) / 16)
    img = imaging.form_image(rows_of(spark, np.round(x.real) + 1j * np.round(x.imag)), 16, 16, "perrow", taper=False)
    top = raster.brightest(img).first()
    assert (top["row"], top["col"]) == (5, 3)


@pytest.mark.parametrize("kernel", ["lerp", "sinc", "cubic"])
def test_resample_on_own_grid_is_identity(spark, kernel):
    x = codes(2, 64, top=3000)
    rows = rows_of(spark, x).withColumns({"x0": F.lit(0.0), "dx": F.lit(1.0)})
    grid = spark.range(63).select(F.col("id").cast("int").alias("i"), F.col("id").cast("double").alias("q"))
    got = back(geometry.resample_rows(rows, grid, 64, kernel, fx.sinc_table(64, 16)).select("row", "re", "im"))
    assert abs(got - x[:, :63]).max() <= (1 if kernel == "sinc" else 0)


def test_descending_source(spark):
    x = codes(1, 16)
    rows = rows_of(spark, x).withColumns({"x0": F.lit(15.0), "dx": F.lit(-1.0)})
    grid = spark.range(16).select(F.col("id").cast("int").alias("i"), F.col("id").cast("double").alias("q"))
    got = back(geometry.resample_rows(rows, grid, 16).select("row", "re", "im"))[0]
    assert (got[1:] == x[0][::-1][1:]).all() and got[0] == 0


def test_endpoint_rules(spark):
    s = spark.createDataFrame([(1, 0, 10), (1, 10, 20)], "k int, x long, v long")
    q = spark.createDataFrame([(1, 0), (1, 5), (1, 10), (1, 11), (2, 5)], "k int, q long")
    valid = lambda c: {r["q"] for r in interp.bracket(q, s, "k", c).where("x0 is not null").collect()}
    assert (valid("left"), valid("right"), valid("both")) == ({0, 5}, {5, 10}, {0, 5, 10})


@pytest.mark.parametrize("closed", ["left", "right", "both"])
def test_stretches_do_not_change_brackets(spark, closed):
    r = np.random.default_rng(1)
    s = spark.createDataFrame([(int(k), int(x), int(v)) for k, x, v in zip(r.integers(0, 3, 200), r.integers(0, 400, 200), r.integers(0, 9, 200), strict=True)], "k int, x long, v long")
    q = spark.createDataFrame([(int(k), int(x), i) for i, (k, x) in enumerate(zip(r.integers(0, 4, 150), r.integers(-20, 420, 150), strict=True))], "k int, q long, n int")
    got = [sorted(map(str, interp.bracket(q, s, "k", closed, w).collect())) for w in (None, 7.0, 90.0, 1e9)]
    assert len(got[0]) == 150 and all(g == got[0] for g in got)


def test_cross_pass_matches_numpy(spark):
    x = codes(3, 8, top=1000)
    axis = np.array([0.0, 1.0, 2.5, 3.0, 5.0, 6.0, 8.0, 9.0])
    rows = rows_of(spark, x).withColumn("axis", F.array(*[F.lit(float(v)) for v in axis]))
    grid = spark.range(10).select(F.col("id").cast("int").alias("i"), F.col("id").cast("double").alias("q"))
    got = back(geometry.resample_cross(rows, grid).select("row", "re", "im"))
    want = np.array([np.interp(np.arange(10), axis, r.real) for r in x])
    want[:, 9] = 0  # the last point itself has no bracket
    assert abs(got.real - want).max() <= 1


def test_slicing_edges(spark):
    f = frames.to_long(rows_of(spark, codes(5, 7)))
    with pytest.raises(ValueError):
        slicing.roi(f, 3, 3, 0, 1)
    assert slicing.roi(f, 1, 3, 2, 5).count() == 6
    s = slicing.shift(slicing.shift(f, 5, 7), 5, 7, inverse=True)
    assert s.exceptAll(f).count() == 0
    assert slicing.oriented(f, 5, 7).count() == 8 * 35
    b = slicing.worker_bounds(1000, 7, 8)
    assert b[0][0] == 0 and b[-1][1] == 1000 and all(x[1] == y[0] for x, y in zip(b, b[1:], strict=False))


def test_hex_round_trip_skips_comments(spark):
    f = frames.to_long(rows_of(spark, np.array([[-32768 + 32767j, -1 + 0j]])))
    lines = frames.format_hex(f).select("value").unionByName(spark.createDataFrame([("# note",), ("",), ("// x",)], "value string"))
    assert sorted(tuple(r) for r in frames.parse_hex(lines).collect()) == [(-32768, 32767), (-1, 0)]


def test_phase_correlation_finds_the_shift(spark):
    x = codes(16, 16)
    f = frames.to_long(rows_of(spark, x.real + 0j)).select("row", "col", F.col("re").cast("double").alias("re"), F.lit(0.0).alias("im"))
    moved = f.withColumns({"row": (F.col("row") + 13) % 16, "col": (F.col("col") + 11) % 16})
    got = spectral.phase_correlation(frames.to_rows(f), frames.to_rows(moved), 16, 16).first()
    assert (got["dy"], got["dx"]) == (3, 5)


def test_save_keeps_history_and_reads_back(spark, tmp_path):
    img = spectral.detect_rows(rows_of(spark, codes(4, 4)))
    for run in (1, 2):
        catalog.save_image(img, f"{tmp_path}/cat", f"{tmp_path}/img", 7, run)
    rows = spark.read.parquet(f"{tmp_path}/cat").collect()
    assert {(r["scene_id"], r["run_seq"], r["rows"], r["cols"]) for r in rows} == {(7, 1, 4, 4), (7, 2, 4, 4)}


def test_ledger(spark, tmp_path):
    ok = spark.createDataFrame([("memory", 1.0, None), ("stall", 2.0, "2024-01-02")], "phenomenon string, value double, ts string")
    catalog.append_ledger(ok, f"{tmp_path}/l")
    got = frames.read_ledger(spark, f"{tmp_path}/l")
    assert got.where("ts is null").count() == 0 and catalog.ledger_rollup(got).count() == 2
    with pytest.raises(Exception, match="unknown phenomenon"):
        catalog.append_ledger(spark.createDataFrame([("odd", 1.0, None)], ok.schema), f"{tmp_path}/l")


def test_raw_words(spark, tmp_path):
    np.arange(5, dtype="<u4").tofile(f"{tmp_path}/a.bin")
    assert [r["value"] for r in frames.read_raw(spark, f"{tmp_path}/a.bin").orderBy("i").collect()] == list(range(5))
    assert frames.stage_files(spark, f"{tmp_path}/a.bin").first()["byte_len"] == 20


def test_watch_takes_each_file_once_and_keeps_failures(spark, tmp_path):
    seen = []
    src = str(tmp_path / "in")
    spark.range(3).write.parquet(src + "/a")
    go = lambda h: watch(spark, src, "id long", h, f"{tmp_path}/ck", f"{tmp_path}/dead", once=True).awaitTermination()
    go(lambda b, n: seen.append(b.count()))
    go(lambda b, n: seen.append(b.count()))
    assert seen == [3]
    spark.range(2).write.parquet(src + "/b")

    def fail(b, n):
        raise ValueError("no")

    go(fail)
    assert spark.read.parquet(f"{tmp_path}/dead").where("error = 'no'").count() == 2


def test_windowed_counts_on_a_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(f"{tmp_path}/e")
    s = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/e").schema).parquet(f"{tmp_path}/e").withColumn("ts", F.col("ts").cast("timestamp"))
    q = windowed_counts(s).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from w").first()[0] == spark.read.parquet(f"{tmp_path}/e").count()


def test_geodesy(spark):
    import math

    lat, lon = math.radians(48.0), math.radians(11.5)
    a, e2 = 6378137.0, 0.00669437999014
    n = a / math.sqrt(1 - e2 * math.sin(lat) ** 2)
    p = (n * math.cos(lat) * math.cos(lon), n * math.cos(lat) * math.sin(lon), n * (1 - e2) * math.sin(lat))
    df = spark.createDataFrame([p], "x double, y double, z double")
    la, lo = raster.ecef_to_geodetic(F.col("x"), F.col("y"), F.col("z"))
    e, north = raster.utm(la, lo)
    r = df.select(la, lo, raster.utm_epsg(la, lo), e, north).first()
    assert abs(r[0] - 48) < 1e-6 and abs(r[1] - 11.5) < 1e-9 and r[2] == 32632
    assert abs(r[3] - 686412) < 500 and abs(r[4] - 5319000) < 2000


def test_empty_frames(spark):
    none = rows_of(spark, codes(1, 4)).where("row < 0")
    assert imaging.form_image(none, 4, 4, "l1").count() == 0
    assert slicing.decimate(frames.to_long(none), 2, 2).count() == 0
    assert raster.histogram(spectral.detect_rows(none)).count() == 0


def test_digest_sees_repeated_rows(spark):
    frame = lambda a, b: spark.createDataFrame([(0, 0, a), (0, 0, a), (0, 1, b), (0, 1, b)], "row long, col int, v int")
    assert not catalog.verify(frame(1, 1), frame(9, 9)) and catalog.verify(frame(1, 2), frame(1, 2))
    assert catalog.frame_digest(frame(1, 1).limit(0)).first()["digest"] == "0"


def test_region_crc_is_that_of_the_bytes(spark):
    import zlib

    x = codes(37, 9)
    want = zlib.crc32(np.stack([x.real, x.imag], -1).astype("<i2").tobytes())
    got = catalog.region_crc(rows_of(spark, x).repartition(5)).first()
    assert (got["n_bytes"], got["crc"]) == (37 * 9 * 4, want)
    assert catalog.region_crc(rows_of(spark, x).where("row < 0")).first()["crc"] == 0
    for a, b in ((b"", b"x"), (b"abc", b""), (b"abc" * 99, b"\0" * 70_001)):
        assert catalog.join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_cross_pass_brackets_long_axes(spark):
    n = 131_077
    rows = spark.range(1).select(F.col("id").alias("row"), *[F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("double") if c == "axis" else (i % 30_000).cast("long")).alias(c) for c in ("re", "im", "axis")])
    grid = spark.createDataFrame([(0, 77_777.0), (1, 3.0), (2, 131_075.0), (3, 131_076.0)], "i int, q double")
    assert geometry.resample_cross(rows, grid).first()["re"] == [17_777, 3, 11_075, 0]


def test_float_interpolation_has_both_outer_values(spark):
    s = spark.createDataFrame([("a", 1.0, 10.0), ("a", 2.0, 20.0)], "k string, x double, v double")
    q = spark.createDataFrame([("a", 0.5), ("a", 1.0), ("a", 1.5), ("a", 2.0), ("a", 2.5), ("b", 1.0)], "k string, q double")
    both = interp.bracket(q, s, "k", "both", beyond=True)
    got = both.select("k", "q", interp.interp_float(both, -1.0, -2.0).alias("v")).collect()
    assert {(r["k"], r["q"]): r["v"] for r in got} == {("a", 0.5): -1, ("a", 1.0): 10, ("a", 1.5): 15, ("a", 2.0): 20, ("a", 2.5): -2, ("b", 1.0): -1}


def test_normal_stretch(spark):
    from statistics import NormalDist

    mags = [0, 0, 5, 5, 9, 70, 70, 70]
    img = spark.createDataFrame([(0, i, m) for i, m in enumerate(mags)], "row long, col int, mag int")
    live = [m for m in mags if m]
    z = {m: NormalDist().inv_cdf((sum(x < m for x in live) + 0.5 * live.count(m)) / len(live)) for m in live}
    want = [int(max(0, min(255, 128 + 127 * z[m] / 3))) if m else 0 for m in mags]
    assert [r["v"] for r in raster.stretch_normal(img).orderBy("col").collect()] == want


def test_png_holds_the_raster(spark, tmp_path):
    import struct
    import zlib

    v = np.random.default_rng(1).integers(0, 256, (5, 7))
    v[3] = 0
    img = spark.createDataFrame([(r, c, int(v[r, c])) for r in range(5) for c in range(7) if r != 3], "row long, col int, v int")
    assert raster.write_png(img, str(tmp_path / "a.png")) == (5, 7)
    raw, at, data = (tmp_path / "a.png").read_bytes(), 8, b""
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        assert struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0] == zlib.crc32(raw[at + 4 : at + 8 + n])
        data += raw[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    assert (np.frombuffer(zlib.decompress(data), np.uint8).reshape(5, 8)[:, 1:] == v).all()


def test_stimuli_lines(spark):
    got = frames.stimuli(spark.range(256).select(F.col("id").alias("k")), 128).toPandas()
    assert got["case"].nunique() == 7 and len(got) == 7 * 256
    lines = {c: g.sort_values("k")["re"].to_numpy() + 1j * g.sort_values("k")["im"].to_numpy() for c, g in got.groupby("case")}
    assert all(np.allclose(v[:128], v[128:]) for v in lines.values())
    spectrum = abs(np.fft.fft(lines["twotone_hidr"][:128]))
    assert abs(spectrum[42] / spectrum[11] - 1e-3) < 1e-9 and np.flatnonzero(lines["impulse_k"][:128]).tolist() == [37]


def test_stress_line(spark):
    got = frames.stress_line(spark.range(24).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("re"), F.lit(2).cast("long").alias("im"), F.lit("x").alias("more")), "k", 8)
    assert got.columns == ["k", "more", "re", "im"]
    want = {0: (32767, -32768), 4: (-32768, 32767)}
    assert all((r["re"], r["im"]) == want.get(r["k"] % 8, (1, 2)) for r in got.collect())


def test_files_come_in_the_order_of_their_paths(spark, tmp_path):
    for name in ("b/two.bin", "a/one.bin", "a/none.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    got = frames.scene_files(spark, str(tmp_path), "*.bin").collect()
    assert [(r["path"][-9:], r["byte_len"]) for r in got] == [("a/one.bin", 9), ("b/two.bin", 9)]


def test_packed_lines(spark):
    f = spark.createDataFrame([(2, 3, 5, 6), (2, 0, 1, 2), (7, 1, -1, -2), (2, 3, 5, -6)], "row long, col int, re int, im int")
    got = {r["row"]: (r["re"], r["im"]) for r in tiles.unpack(frames.to_packed(f, 4), 4).collect()}
    assert got == {2: ([1, 0, 0, 5], [2, 0, 0, 6]), 7: ([0, -1, 0, 0], [0, -2, 0, 0])}
    r = np.random.default_rng(4)
    cells = [(int(a), int(b), int(a) % 999 - 500, int(b) - 3) for a, b in {tuple(x) for x in r.integers(0, 40, (900, 2))}]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # lines go on from batch to batch
    try:
        got = {q["row"]: q["re"] for q in tiles.unpack(frames.to_packed(spark.createDataFrame(cells, f.schema), 40), 40).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {a: [0] * 40 for a, *_ in cells}
    for a, b, x, _ in cells:
        want[a][b] = x
    assert got == want


@pytest.mark.parametrize("shape", [(5, 7, 3), (64, 130, 128), (8, 8, 8)])
def test_tiled_turn(spark, shape):
    """Ragged strips, a look that lacks lines, several looks, few rows moved."""
    h, w, tile = shape
    x = codes(3 * h, w, seed=w)
    lines = tiles.pack(rows_of(spark, x).where(f"row <> {h}"), w)
    got = back(tiles.unpack(tiles.turn(lines, h, w, tile=tile), h))
    x[h] = 0
    assert (got == np.concatenate([x[k * h : (k + 1) * h].T for k in range(3)])).all()
    l1 = {r["row"]: r["l1"] for r in tiles.turn(lines, h, w, tile=tile).collect()}
    assert l1[0] == int(abs(x[:h, 0].real).sum() + abs(x[:h, 0].imag).sum())


def test_samples_must_fit(spark):
    with pytest.raises(Exception, match="16 bits"):
        tiles.pack(rows_of(spark, np.array([[40000 + 0j]])), 1).collect()
    with pytest.raises(Exception, match="must have"):
        tiles.pack(rows_of(spark, codes(1, 3)), 4).collect()


def test_images_equal_the_passes_by_expressions(spark):
    """Every scaling rule against the column expressions, stage by stage."""
    x = rows_of(spark, codes(16, 8, top=30000) * np.array([1, 1 / 512, 1, 0, 1, 1 / 99, 1, 1] * 2)[:, None])
    for scaling, one in (("l1", spectral.pass_l1), ("global", spectral.pass_global), ("perrow", spectral.pass_perrow), ("uncond", spectral.pass_uncond)):
        done = lambda df, n: (spectral.renormalise(one(df, n)) if scaling == "perrow" else one(df, n)).select("row", "re", "im")  # noqa: B023, E731
        mid = done(spectral.window_q15(x, fx.taper_q15(8), fx.taper_q15(8)), 8)
        want = spectral.detect_rows(done(spectral.turn(mid, 8, 8), 8))
        report = imaging.Report()
        got = imaging.form_image(x, 8, 8, scaling, report=report)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and report.code == 0 and len(report.exponents) == 2


def test_stage_codes(spark, monkeypatch):
    x = rows_of(spark, codes(8, 8))
    broken = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost"))
    for name, owner, code in (("tapered", imaging, 1), ("one_pass", imaging, 2), ("turn", tiles, 3), ("detected", imaging, 4)):
        report = imaging.Report()
        with monkeypatch.context() as m, pytest.raises(imaging.StageError) as e:
            m.setattr(owner, name, broken)
            imaging.form_image(x, 8, 8, report=report)
        assert report.code == e.value.code == code
    for h, w, rule in ((6, 8, "l1"), (8, 8, "odd")):
        with pytest.raises(imaging.StageError):
            imaging.form_image(x, h, w, rule)
    report = imaging.Report()
    assert imaging.form_image(rows_of(spark, np.full((8, 8), 32767 + 32767j)), 8, 8, "uncond", taper=False, report=report).count() == 64
    assert report == imaging.Report(0, [0, 0], [0, 0])


@pytest.mark.parametrize("inclusive", [False, True])
def test_running_sums_over_stretches(spark, inclusive):
    r = np.random.default_rng(7)
    keys = np.where(r.random(400) < 0.6, 3, r.integers(0, 9, 400))
    rows = [(None if k == 8 else int(k), i, None if i % 50 == 0 else int(v)) for i, (k, v) in enumerate(zip(keys, r.integers(-5, 9, 400), strict=True))]
    df = spark.createDataFrame(rows, "k int, i int, v long").repartition(6)
    for group in ([], ["k"]):
        for parts in (1, 5, 40):
            got = {q["i"]: q["upto"] for q in scan.running(df, F.col("v"), ["i"], group, inclusive=inclusive, parts=parts).collect()}
            sums, want = {}, {}
            for k, i, v in rows:
                g = k if group else 0
                want[i] = sums.get(g, 0) + ((v or 0) if inclusive else 0)
                sums[g] = sums.get(g, 0) + (v or 0)
            assert got == want
    assert scan.running(df.limit(0), F.col("v"), ["i"]).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 70])
def test_windows_over_halos(spark, parts):
    from pyspark.sql import Window

    df = spark.range(120).select((F.col("id") % 11 < 8).cast("int").alias("k"), "id", (F.col("id") * 37 % 101).alias("v"))
    for back_by, ahead in ((0, 5), (5, 0), (3, 4)):
        whole = Window.partitionBy("k").orderBy("id").rowsBetween(-back_by, ahead)
        want = sorted(map(tuple, df.select("id", F.sum("v").over(whole).alias("s")).collect()))
        h = scan.halo(df, ["id"], ["k"], back_by, ahead, parts)
        some = Window.partitionBy("_part", "k").orderBy("id").rowsBetween(-back_by, ahead)
        got = h.select("id", F.sum("v").over(some).alias("s"), "_halo").where("not _halo").select("id", "s")
        assert sorted(map(tuple, got.collect())) == want
    assert scan.halo(df.limit(0), ["id"], [], 1, 1).count() == 0


@pytest.mark.parametrize("n", [1, 2, 8, 64, 512])
def test_long_lines(spark, n):
    """The four steps against NumPy, forth and back."""
    r = np.random.default_rng(n)
    x = r.normal(size=n) + 1j * r.normal(size=n)
    n1, n2 = longline.shape(n)
    assert n1 * n2 == n and n1 in (n2, 2 * n2)
    cells = spark.createDataFrame([(i // n2, i % n2, float(v.real), float(v.imag)) for i, v in enumerate(x)], "row long, col int, re double, im double")
    lines = frames.to_packed(cells, n2, "<f8")
    out = longline.fft_long(lines, n1, n2)
    got = {q["i"]: q["re"] + 1j * q["im"] for q in longline.samples(out, n1).collect()}
    assert np.allclose([got[i] for i in range(n)], np.fft.fft(x))
    again = longline.samples(longline.fft_long(out, n2, n1, inverse=True), n2) if n1 == n2 else None
    assert again is None or np.allclose([q["re"] + 1j * q["im"] for q in again.orderBy("i").collect()], x)


def test_split_transforms_are_close_to_float_at_every_level(spark):
    for top in (3, 500, 32767):
        x = codes(4, 256, seed=top, top=top)
        x[3] = 0
        rows = longline.fft_split(rows_of(spark, x), 256).orderBy("row").collect()
        got = np.array([(np.array(q["re"]) + 1j * np.array(q["im"])) * 2.0 ** q["exp"] for q in rows])
        want = np.fft.fft(x, axis=1)
        assert abs(got - want).max() < 4e-3 * abs(want).max() and (got[3] == 0).all() and all(max(map(abs, q["re"])) <= 32768 for q in rows)


def test_merge_scan_against_a_plain_scan(spark):
    r = np.random.default_rng(8)
    ts = sorted({int(v) for v in r.integers(-900, 900, 60)})
    vs = [int(v) for v in r.integers(-1000 * 4096, 1000 * 4096, 300)] + [ts[0] * 4096, ts[-1] * 4096, ts[-1] * 4096 - 1, ts[5] * 4096]
    q = spark.createDataFrame([("a", v, i % 9 == 0, i) for i, v in enumerate(vs)] + [("none", 5, False, -1)], "k string, v long, sat boolean, n int")
    axis = spark.createDataFrame([("a", t) for t in ts for _ in range(2)], "k string, ts long")
    for width in (None, 4096 * 100.0):
        got = {x["n"]: (x["idx"], x["wq"]) for x in interp.merge_scan(q, axis, "k", width=width).collect()}
        assert got[-1] == (-1, 0)
        for i, v in enumerate(vs):
            if i % 9 == 0 or not ts[0] * 4096 <= v < ts[-1] * 4096:
                assert got[i] == (-1, 0)
                continue
            k = max(j for j in range(len(ts) - 1) if ts[j] * 4096 <= v)
            inverse = round(2**30 / (ts[k + 1] - ts[k]) + 1e-12)
            assert got[i] == (k, min(32767, (v - ts[k] * 4096) * inverse >> 27))


def test_affine_map_saturates(spark):
    big = (1 << 31) - 1
    cases = [(big, big, 0, 0), (big, big, 20, 0), (-5, 3, 1, 0), (1, 1, 0, (1 << 47) - 1), (0, 1, 0, (1 << 47) - 1), (-1, 1, 0, -(1 << 47))]
    rows = spark.createDataFrame(cases, "q long, a long, s int, b long")
    v, sat = interp.affine48(F.col("q"), F.col("a"), F.col("s"), F.col("b"))
    wrap = lambda x: (x + (1 << 47)) % (1 << 48) - (1 << 47)
    for r, (x, a, s, b) in zip(rows.select(v.alias("v"), sat.alias("sat")).collect(), cases, strict=True):
        p = x * a >> s
        w = wrap(p) + b
        assert (r["v"], r["sat"]) == (wrap(w), p != wrap(p) or w != wrap(w))
    units = spark.createDataFrame([(1.0,), (-0.3,), (1e12,), (3e9,), (2.0**30,)], "u double")
    a, s = interp.scaled_unit(F.col("u"), 24)
    assert [tuple(r) for r in units.select(a.alias("a"), s.alias("s")).collect()] == [(1 << 24, 24), (-5033165, 24), (None, None), (None, None), (1 << 30, 0)]


def test_responses_of_lines(spark):
    p = [float(abs(np.sinc((k - 20) / 4))) for k in range(48)]
    got = raster.psf_metrics(spark.createDataFrame([(1, p), (2, [0.0, 3.0, 0.0])], "row int, p array<double>")).orderBy("row").collect()
    side = max(p[:16] + p[25:])
    energy = lambda v: sum(x * x for x in v)
    assert np.isclose(got[0]["pslr_db"], 20 * np.log10(side)) and np.isclose(got[0]["islr_db"], 10 * np.log10(energy(p[:17] + p[24:]) / energy(p[17:24])))
    assert np.isclose(got[0]["spur_db"], 20 * np.log10(max(p[:12] + p[29:]))) and got[1]["spur_db"] is None


def test_an_old_frame_put_back_is_refused(spark, tmp_path):
    import shutil

    one, two = (frames.to_long(rows_of(spark, codes(4, 4, seed=k))) for k in (1, 2))
    catalog.write_stage(one, str(tmp_path), "s")
    shutil.copytree(f"{tmp_path}/frames/scene=s", f"{tmp_path}/old")
    catalog.write_stage(two, str(tmp_path), "s")
    assert catalog.verify(catalog.read_stage(spark, str(tmp_path), "s"), two)
    shutil.rmtree(f"{tmp_path}/frames/scene=s")
    shutil.copytree(f"{tmp_path}/old", f"{tmp_path}/frames/scene=s")
    with pytest.raises(RuntimeError):
        catalog.read_stage(spark, str(tmp_path), "s")


@pytest.mark.parametrize("kind", ["CI4", "CI2", "CF8"])
def test_phase_history_chips(spark, tmp_path, kind):
    """Every stride against slices of the arrays; what is read is what was asked for."""
    x = codes(9, 12, top=100)
    pvp = {"SC0": np.arange(9) * 1.5, "TxPos": np.arange(27).reshape(9, 3)}
    (tmp_path / "a.cphd").write_bytes(phasehistory.encode(x.real, x.imag, pvp, kind))
    size = {"CI4": 4, "CI2": 2, "CF8": 8}[kind]
    for rows, cols in (("::", "::"), ("1:8:3", "2:11:4"), (":4", "-3:"), ("20:", "::")):
        got = phasehistory.read(spark, str(tmp_path), rows, cols, ["TxPos"]).orderBy("row").collect()
        r, c = (slice(*[int(v) if v else None for v in s.split(":")]) for s in (rows, cols))
        want = x[r, c]
        assert [q["row"] for q in got] == list(range(9)[r]) and all((np.array(q["re"]) + 1j * np.array(q["im"]) == w).all() for q, w in zip(got, want, strict=True))
        used = range(12)[c]
        assert all(q["read_bytes"] == size * (used[-1] + 1 - used[0]) and q["pvp"]["TxPos"] == [q["row"] * 3.0 + i for i in range(3)] for q in got)
    assert phasehistory.read(spark, f"{tmp_path}/a.cphd").count() == 9


def test_phase_history_refuses_damage(spark, tmp_path):
    raw = phasehistory.encode(np.ones((4, 4)), np.ones((4, 4)), {"SC0": np.zeros(4)})
    for name, data, why in (("cut", raw[:-1], "cut short"), ("other", b"x" * 99, "no phase history"), ("empty", b"", "no phase history")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "s.cphd").write_bytes(data)
        with pytest.raises(Exception, match=why):
            phasehistory.read(spark, f"{tmp_path}/{name}").collect()
    (tmp_path / "ok.cphd").write_bytes(raw)
    for bad in ({"rows": "1"}, {"rows": "::0"}, {"cols": "::-1"}, {"pvp": ["None"]}):
        with pytest.raises(Exception):
            phasehistory.read(spark, f"{tmp_path}/ok.cphd", **bad).collect()
    (tmp_path / "none").mkdir()
    assert phasehistory.read(spark, f"{tmp_path}/none").count() == 0


def read_tiff(raw):
    """A plain reader of the written kind of file: image, affine rows, the system's number."""
    import struct
    import zlib

    magic, version, at = struct.unpack("<2sHI", raw[:8])
    assert (magic, version) == (b"II", 42)
    tags, last = {}, 0
    for k in range(struct.unpack("<H", raw[at : at + 2])[0]):
        tag, kind, n = struct.unpack("<HHI", raw[at + 2 + 12 * k : at + 10 + 12 * k])
        code, size = {3: ("H", 2), 4: ("I", 4), 12: ("d", 8)}[kind]
        place = at + 10 + 12 * k if n * size <= 4 else struct.unpack("<I", raw[at + 10 + 12 * k : at + 14 + 12 * k])[0]
        tags[tag], last = struct.unpack(f"<{n}{code}", raw[place : place + n * size]), max(last, tag)
        assert tag == last
    dtype = {(8, 1): "<u1", (16, 1): "<u2", (32, 3): "<f4"}[tags[258][0], tags[339][0]]
    data = b"".join(zlib.decompress(raw[o : o + n]) for o, n in zip(tags[273], tags[279], strict=True))
    keys = tags[34735]
    return np.frombuffer(data, dtype).reshape(tags[257][0], tags[256][0]), np.array(tags[34264]).reshape(4, 4), keys[keys.index(3072) + 3]


@pytest.mark.parametrize("kind", ["float32", "uint16", "uint8"])
def test_georeferenced_strips(spark, tmp_path, kind):
    x = np.random.default_rng(3).integers(0, 250, (150, 33))
    lines = spark.createDataFrame([(s, r, (x[r] + s).tolist()) for s in (0, 4) for r in range(150) if r != 77], "scene int, row int, mag array<int>")
    lines = lines.withColumns({"affine": F.array(*[F.lit(v) for v in (2.0, 0.5, 1000.0, -0.25, -3.0, 5000.0)]), "epsg": F.lit(32632)})
    files = geotiff.write(lines, str(tmp_path), kind, 64).collect()
    assert len(files) == 6 and sum(f["rows"] for f in files) == 300
    for f in files:
        raw = open(f["path"], "rb").read()
        got, m, epsg = read_tiff(raw)
        first = f["strip"] * 64
        want = x[first : first + 64] + f["scene"]
        want[77 - first if 0 <= 77 - first < 64 else slice(0, 0)] = 0
        assert (got == want).all() and epsg == 32632 and len(raw) == f["n_bytes"]
        assert (m[0] == [2.0, 0.5, 0, 1000 + 0.5 * first]).all() and (m[1] == [-0.25, -3.0, 0, 5000 - 3.0 * first]).all()


def test_scene_affine_near_a_zones_edge(spark):
    """Points over the edge stay in the centre's zone, and the affine maps the centre to itself."""
    import math

    lat, lon = math.radians(10.0), math.radians(11.9999999)
    c = [6378137 * math.cos(lat) * math.cos(lon), 6378137 * math.cos(lat) * math.sin(lon), 6356752 * math.sin(lat)]
    east, north = [-math.sin(lon), math.cos(lon), 0.0], [-math.sin(lat) * math.cos(lon), -math.sin(lat) * math.sin(lon), math.cos(lat)]
    scene = spark.createDataFrame([(c, east, north, [1.0, 0.0], [0.0, 1.0], 2.0, 3.0)], "centre array<double>, uiax array<double>, uiay array<double>, dhat array<double>, chat array<double>, dr double, dc double")
    r = raster.scene_affine(scene, F.lit(100), F.lit(60)).first()
    a, b, e0, d, f, n0 = r["affine"]
    assert r["epsg"] == 32632 and abs(math.hypot(a, d) - 2.0) < 0.01 and abs(math.hypot(b, f) - 3.0) < 0.03
    la, lo = raster.ecef_to_geodetic(*[F.lit(v) for v in c])
    e, n = scene.select(*raster.utm(la, lo)).first()
    assert abs(a * 30 + b * 50 + e0 - e) < 1e-6 and abs(d * 30 + f * 50 + n0 - n) < 1e-6
    flipped = raster.scene_affine(scene, F.lit(100), F.lit(60), flip_row=True, flip_col=True).first()["affine"]
    assert abs(flipped[0] + a) < 1e-3 and abs(flipped[4] + f) < 1e-3


def test_order_statistics_of_any_values(spark):
    r = np.random.default_rng(6)
    many = {
        "wide": np.concatenate([r.normal(size=500) * 10.0 ** r.integers(-200, 200, 500), [0.0, -0.0, 1.7e308, -1.7e308]]),
        "ties": r.integers(0, 3, 301).astype(float), "one": np.array([5.0]), "near": 1.0 + np.arange(200) * 2.0**-52,
    }
    for name, x in many.items():
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "mag double")
        assert np.array_equal([v for _, v in sorted(raster.order_statistics(df, "mag", list(range(0, len(x), 60)), bins=64).items())], np.sort(x)[::60]), name
        ps = [0, 5, 50, 99.7, 100]
        assert np.allclose(raster.percentiles(df, ps), np.percentile(x, ps), rtol=1e-12), name
    none = spark.createDataFrame([], "mag double")
    assert raster.percentiles(none, [5, 50]) == [None, None] and raster.stretch_u8(none.selectExpr("1 AS row", "1 AS col", "mag")).count() == 0


def test_float_stretches_equal_numpy(spark):
    x = np.abs(np.random.default_rng(9).normal(size=400)) * 100
    img = spark.createDataFrame([(i // 20, i % 20, float(v)) for i, v in enumerate(x)], "row long, col int, mag double")
    got = [r["u8"] for r in raster.stretch_u8(img).orderBy("row", "col").collect()]
    assert got == np.floor(np.clip(x / (np.percentile(x, 99.7) + 1e-12) * 255, 0, 255)).astype(int).tolist()
    a, b = np.percentile(np.log1p(x), [30, 99.5])
    assert np.allclose([r["v"] for r in raster.stretch_log(img).orderBy("row", "col").collect()], np.clip((np.log1p(x) - a) / (b - a), 0, 1))


def test_crc_report_sees_damage(spark):
    import zlib

    rows = [(i, f"payload {i}", zlib.crc32(f"payload {i}".encode())) for i in range(5)]
    rows[3] = (3, "payload 3 damaged", rows[3][2])
    got = catalog.crc_report(spark.createDataFrame(rows, "i int, payload string, crc long")).collect()
    assert [r["i"] for r in got if not r["ok"]] == [3]


@pytest.mark.parametrize("h", [1, 5, 12])
def test_corner_turn_is_of_the_whole_frame(spark, h):
    """More lines than a block, one of them missing: what comes out are lines as long as the frame is high, without samples of lines that are not there."""
    x = codes(h, 8)
    got = {(r["row"], r["col"]): complex(r["re"], r["im"]) for r in tall.turn(rows_of(spark, x).where("row <> 3"), 8, block=4).collect()}
    assert got == {(c, r): x[r, c] for c in range(8) for r in range(h) if r != 3}


@pytest.mark.parametrize("h", [1, 7, 12, 101])
@pytest.mark.parametrize("most", [1 << 21, 8])
@pytest.mark.parametrize("taper", [False, True])
def test_transform_is_of_the_whole_frame(spark, monkeypatch, h, most, taper):
    """Heights with factors, prime ones, and ones of which no task may hold a factor's lines; a missing line counts as zeros."""
    monkeypatch.setattr(tall, "MOST", most)
    monkeypatch.setattr(tall, "AIM", 64)
    x = codes(h, 8)
    got = back(tall.fft2(rows_of(spark, x).where("row <> 3"), h, 8, taper))
    x[3:4] = 0
    x = x * np.outer(0.54 - 0.46 * np.cos(2 * np.pi * np.arange(h) / max(1, h - 1)), np.hamming(8)) if taper else x
    assert np.allclose(got, np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(x))))
