"""The engine: scenes in, images out, as one object with named options; and a command line."""

from __future__ import annotations

import argparse
import time
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalog, geometry, imaging, raster, slicing
from .sources import frames, geotiff, phasehistory
from .streaming.watch import watch

CHOICES = {"scaling": ("l1", "global", "perrow", "uncond"), "kernel": ("none", "lerp", "cubic", "sinc")}


@dataclass(frozen=True)
class Options:
    """How images are formed. An unknown choice falls back to the default."""

    scaling: str = "l1"
    kernel: str = "none"
    taper: bool = True
    decimate: tuple[int, int] = (1, 1)

    @staticmethod
    def of(**given) -> Options:
        names = {f.name for f in fields(Options)}
        return Options(**{k: v for k, v in given.items() if k in names and v in CHOICES.get(k, (v,))})


@dataclass
class Timer:
    """Seconds by step."""

    steps: list[tuple[str, float]] = field(default_factory=list)
    last: float = field(default_factory=time.time)

    def lap(self, name: str) -> None:
        now = time.time()
        self.steps.append((name, now - self.last))
        self.last = now

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.steps or [("none", 0.0)], "step string, seconds double")


class Engine:
    def __init__(self, spark: SparkSession, options: Options | None = None):
        self.spark, self.options = spark, options or Options()

    def load(self, path: str, scene: str) -> DataFrame:
        return catalog.read_stage(self.spark, path, scene)

    def stage(self, frame: DataFrame, path: str, scene: str) -> None:
        catalog.write_stage(frame, path, scene)

    def form_image(self, frame: DataFrame) -> DataFrame:
        """row, col, mag of a long frame (row, col, re, im): decimation, optional resampling onto a uniform grid, padding, transforms, detection."""
        o = self.options
        x = slicing.decimate(frame, *o.decimate)
        h, w = frames.dims(x).first()
        if not h:
            return x.select("row", "col", F.lit(0).alias("mag"))
        h2, w2 = (1 << (int(k) - 1).bit_length() for k in (h, w))
        if o.kernel == "none":
            return imaging.form_image(frames.to_packed(x, w2), h2, w2, o.scaling, o.taper, window=(int(h), int(w)))
        grid = self.spark.range(int(w)).select(F.col("id").cast("int").alias("i"), (F.col("id") * ((w - 1) / w)).alias("q"))
        rows = geometry.resample_rows(frames.to_rows(x).withColumns({"x0": F.lit(0.0), "dx": F.lit(1.0)}), grid, int(w), o.kernel).select("row", "re", "im")
        return imaging.form_image(slicing.zero_pad(rows, w2), h2, w2, o.scaling, o.taper, window=(int(h), int(w)))

    def roi(self, image: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
        return slicing.roi(image, r0, r1, c0, c1)

    def multilook(self, image: DataFrame, n: int) -> DataFrame:
        h, w = frames.dims(image).first()
        return raster.multilook(image, n, int(h), int(w))

    def stretch(self, image: DataFrame, kind: str = "u8") -> DataFrame:
        return {"u8": raster.stretch_u8, "db": raster.stretch_db, "log": raster.stretch_log, "normal": raster.stretch_normal}[kind](image)

    def crc(self, frame: DataFrame) -> int:
        """CRC-32 of a long frame as a region of 16-bit pairs in row order."""
        return catalog.region_crc(frames.to_rows(frame)).first()["crc"]

    def chip(self, path: str, rows: str = "::", cols: str = "::") -> DataFrame:
        """scene, row, col, re, im of the wanted part of the phase history files below a path."""
        got = phasehistory.read(self.spark, path, rows, cols)
        flat = got.select("scene", "row", "first_col", "col_step", F.posexplode(F.arrays_zip("re", "im")).alias("k", "v"))
        return flat.select("scene", "row", (F.col("first_col") + F.col("k") * F.col("col_step")).alias("col"), "v.re", "v.im")

    def save_png(self, grey: DataFrame, path: str) -> tuple[int, int]:
        return raster.write_png(grey, path)

    def save_geotiff(self, image: DataFrame, scene: DataFrame, folder: str, kind: str = "float32") -> DataFrame:
        """Writes an image (row, col, mag) with the affine of its one scene (columns as of raster.scene_affine) as TIFF strips."""
        h, w = frames.dims(image).first()
        at = raster.scene_affine(scene, F.lit(int(h)), F.lit(int(w))).select("affine", "epsg")  # one row
        lines = image.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "mag"))), lambda v: v["mag"].cast("double")).alias("mag"))
        return geotiff.write(lines.withColumn("scene", F.lit(0)).crossJoin(F.broadcast(at)), folder, kind)

    def compare(self, ref: DataFrame, test: DataFrame) -> DataFrame:
        return raster.compare(ref, test)

    def save(self, image: DataFrame, path: str, scene_id: int, run_seq: int) -> None:
        catalog.save_image(image, f"{path}/catalog", f"{path}/images", scene_id, run_seq)

    def verify(self, a: DataFrame, b: DataFrame) -> bool:
        return catalog.verify(a, b)

    def watch(self, folder: str, out: str, once: bool = False):
        """Forms an image of every frame file (scene, row, col, re, im) dropped into the folder."""

        def handle(batch: DataFrame, number: int) -> None:
            for r in batch.select("scene").distinct().collect():  # scenes of one batch of files
                image = self.form_image(batch.where(F.col("scene") == r["scene"]).drop("scene"))
                image.write.mode("overwrite").parquet(f"{out}/images/scene={r['scene']}/batch={number}")

        return watch(self.spark, folder, "scene string, row long, col int, re long, im long", handle, f"{out}/checkpoint", f"{out}/rejected", once=once)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Forms images of staged scenes.")
    p.add_argument("stage", help="folder of staged scenes")
    p.add_argument("out", help="folder for images and their catalog")
    p.add_argument("scenes", nargs="+")
    p.add_argument("--scaling", default="l1")
    p.add_argument("--kernel", default="none")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    engine, timer = Engine(spark, Options.of(scaling=a.scaling, kernel=a.kernel)), Timer()
    for k, scene in enumerate(a.scenes):
        engine.save(engine.form_image(engine.load(a.stage, scene)), a.out, k, 0)
        timer.lap(scene)
    timer.frame(spark).write.mode("append").json(f"{a.out}/timing")


if __name__ == "__main__":
    main()
