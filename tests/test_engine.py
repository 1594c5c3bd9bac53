import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.engine import Engine, Options, Timer
from gridloom.operators import catalog, geometry, interp, spectral
from gridloom.sources import frames
from tests.test_operators import back, codes, rows_of


def test_unknown_options_fall_back():
    assert Options.of(scaling="odd", kernel="sinc", other=1) == Options(kernel="sinc")


def test_stage_load_form_save(spark, tmp_path):
    e = Engine(spark, Options(scaling="perrow"))
    frame = frames.to_long(rows_of(spark, codes(12, 10)))
    e.stage(frame, f"{tmp_path}/s", "a")
    loaded = e.load(f"{tmp_path}/s", "a")
    assert e.verify(frame, loaded.select(frame.columns))
    img = e.form_image(loaded)
    assert img.count() == 256 and {c for c, _ in img.dtypes} == {"row", "col", "mag"}
    e.save(img, f"{tmp_path}/o", 1, 0)
    assert e.multilook(img, 4).count() == 16 and e.roi(img, 0, 4, 0, 4).count() == 16
    for kind in ("u8", "db", "log"):
        assert e.stretch(img, kind).count() == 256
    assert abs(e.compare(img, img).first()["nrmse"]) < 1e-12
    with pytest.raises(RuntimeError):
        catalog.write_stage(frame, f"{tmp_path}/t", "a")
        frame.where("row > 0").write.mode("overwrite").parquet(f"{tmp_path}/t/frames/scene=a")
        catalog.read_stage(spark, f"{tmp_path}/t", "a")


@pytest.mark.parametrize("kernel", ["lerp", "cubic", "sinc"])
def test_form_image_with_a_kernel(spark, kernel):
    e = Engine(spark, Options(kernel=kernel, decimate=(2, 1)))
    assert e.form_image(frames.to_long(rows_of(spark, codes(8, 64)))).count() == 4 * 64


def test_watch_forms_images(spark, tmp_path):
    f = frames.to_long(rows_of(spark, codes(8, 8))).select(F.lit("x").alias("scene"), "row", F.col("col").cast("int"), "re", "im")
    f.write.parquet(f"{tmp_path}/in/a")
    Engine(spark).watch(f"{tmp_path}/in", f"{tmp_path}/out", once=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/images").count() == 64


def test_timer(spark):
    t = Timer()
    t.lap("a")
    assert t.frame(spark).first()["step"] == "a"


def test_polar_format_equals_numpy(spark):
    n = 16
    x = codes(6, n)
    tan = np.array([0.3, -0.2, 0.1, -0.4, 0.0, 0.25])
    x0 = 1 + 0.01 * np.arange(6)
    pulses = spark.createDataFrame([(i, float(x0[i]), 0.05, float(tan[i])) for i in range(6)], "row long, x0 double, dx double, tan_phi double")
    got = back(geometry.polar_format(rows_of(spark, x), pulses, n, 20))
    src = x0[:, None] + 0.05 * np.arange(n)
    kr = np.linspace(src.min(), src.max(), 20)
    order = np.argsort(tan, kind="stable")
    first = np.array([np.interp(kr, src[i], x[i].real, 0, 0) + 1j * np.interp(kr, src[i], x[i].imag, 0, 0) for i in order])
    edge = abs(kr).max() * abs(tan).max()
    kc, axis = np.linspace(-edge, edge, 20), np.sort(tan)
    ends = lambda u: np.where(abs(u - axis[0]) < 1e-9, axis[0], np.where(abs(u - axis[-1]) < 1e-9, axis[-1], u))
    want = np.array([np.interp(ends(kc / k), axis, c.real, 0, 0) + 1j * np.interp(ends(kc / k), axis, c.imag, 0, 0) for k, c in zip(kr, first.T, strict=True)])
    assert np.allclose(got, want)


def test_quicklook_equals_numpy(spark):
    x = codes(8, 8)
    got = np.zeros((8, 8))
    for r in spectral.quicklook(rows_of(spark, x), 8, 8).collect():
        got[r["row"], r["col"]] = r["amp"]
    w = np.outer(np.hamming(8), np.hamming(8))
    assert np.allclose(got, abs(np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(x * w)))))


def test_focus_pads_and_rescales(spark):
    x = codes(6, 5)
    img, spacing = spectral.focus(rows_of(spark, x), 6, 5, (1.0, 2.0))
    pad = np.zeros((8, 8), complex)
    pad[:6, :5] = x
    assert np.allclose(back(img), np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(pad)))) and spacing == (5 / 8, 1.5)


@pytest.mark.parametrize("rescale", [False, True])
def test_block_exponent_keeps_values(spark, rescale):
    x = codes(3, 16, top=30000)
    got = spectral.pass_block(rows_of(spark, x), 16, rescale)
    e = {r["exp"] for r in got.collect()}
    assert len(e) == 1
    assert abs(back(got) * 2.0 ** e.pop() - np.fft.fft(x, axis=1)).max() < 200


def test_pick_shift_and_kernels():
    for a in (1e-6, 0.5, 3.0, 1e9, 1e12):
        s = interp.pick_shift(a)
        assert s == 0 or abs(round(a * 2.0**s)) < 1 << 31 <= abs(round(a * 2.0 ** (s + 1))) or s == 44
    for name in ("sinc", "lanczos", "hamming", "kaiser", "lagrange"):
        k = interp.kernel(name, 4, 0.25)
        assert abs(sum(k) - 1) < 1e-9 and len(k) == 8 and interp.kernel(name, 4, 0.0)[3] == pytest.approx(1)


def test_scratch_tables_are_deleted(spark, tmp_path, monkeypatch):
    import os

    from gridloom.sources import shared

    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    with shared.scratch(spark) as keep:
        kept = shared.cut(keep(spark.range(10)).where("id > 4"))
        assert len(os.listdir(tmp_path / "gridloom")) == 2
    assert len(os.listdir(tmp_path / "gridloom")) == 1 and kept.count() == 5


def test_engine_reads_chips_and_writes_maps(spark, tmp_path):
    import zlib

    from gridloom.sources import phasehistory

    x = codes(8, 8, top=900)
    (tmp_path / "scene_00003.cphd").write_bytes(phasehistory.encode(x.real, x.imag, {"SC0": np.zeros(8)}))
    e = Engine(spark)
    chip = e.chip(str(tmp_path), "::2", "1:7:2")
    assert {(r["scene"], r["row"], r["col"]) for r in chip.collect()} == {(3, r, c) for r in range(0, 8, 2) for c in (1, 3, 5)}
    whole = e.chip(str(tmp_path)).drop("scene").selectExpr("row", "col", "CAST(re AS BIGINT) AS re", "CAST(im AS BIGINT) AS im")
    assert e.crc(whole) == zlib.crc32(np.stack([x.real, x.imag], -1).astype("<i2").tobytes())
    image = e.form_image(whole)
    scene = spark.createDataFrame([([4.2e6, 1.0e6, 4.6e6], [0.0, 1.0, 0.0], [-0.7, 0.0, 0.7], [1.0, 0.0], [0.0, 1.0], 1.0, 1.0)], "centre array<double>, uiax array<double>, uiay array<double>, dhat array<double>, chat array<double>, dr double, dc double")
    files = e.save_geotiff(image, scene, f"{tmp_path}/tif").collect()
    assert [(f["rows"], f["cols"]) for f in files] == [(8, 8)]
    assert e.stretch(image, "normal").count() == 64 and e.save_png(e.stretch(image).withColumnRenamed("u8", "v"), f"{tmp_path}/a.png") == (8, 8)


@pytest.mark.parametrize("shape", [(6, 10), (8, 8), (1, 3)])
def test_padded_images_taper_what_was_there(spark, shape):
    """A frame that is no power of two: the taper spans its own lines and samples, zeros surround it."""
    from gridloom.functions import fixed as fx
    from gridloom.operators import imaging

    h, w = shape
    x = codes(h, w, top=9000)
    h2, w2 = (1 << (k - 1).bit_length() for k in shape)
    whole = np.zeros((h2, w2), complex)
    own = back(spectral.window_q15(rows_of(spark, x), fx.taper_q15(h), fx.taper_q15(w)))
    whole[:h, :w] = own
    want = imaging.form_image(rows_of(spark, whole), h2, w2, taper=False).collect()
    got = Engine(spark).form_image(frames.to_long(rows_of(spark, x))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == h2 * w2


@pytest.mark.parametrize("n", [64, 1024, 8192])
def test_a_pass_works_on_few_lines_at_a_time(n):
    """What a worker holds of a pass does not grow with the Arrow batches that it is given."""
    import tracemalloc

    from gridloom.operators import tiles

    at = max(tiles.chunks(10_000, n), key=lambda s: s.stop - s.start)
    tracemalloc.start()
    spectral.line_kernel(np.ones((2, at.stop - at.start, n), np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20


def test_sparse_wide_lines_are_packed_a_few_at_a_time(spark):
    """Lines of one sample each, more of them than are packed at a time, and one that goes on beyond a batch."""
    f = spark.range(0, 300, 1, 2).selectExpr("id as row", "cast(id % 7 as int) as col", "id as re", "-id as im")
    more = spark.range(3000).selectExpr("299L as row", "cast(10 + id as int) as col", "id as re", "id as im")
    got = {r["row"]: np.frombuffer(r["iq"], "<i2").reshape(2, 4096) for r in frames.to_packed(f.union(more), 4096).collect()}
    assert len(got) == 300 and all(x[0, r % 7] == r and x[1, r % 7] == -r for r, x in got.items())
    assert all(np.count_nonzero(x) == 2 for r, x in got.items() if 0 < r < 299) and (got[299][0, 10:3010] == np.arange(3000)).all()
