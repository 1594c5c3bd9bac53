"""Forms the image products of a table of sample vectors, strip by strip of looks.

Reads vectors (two of them, real and imaginary part, make a line of samples), stacks the lines to
square looks and forms every look's image: taper, two transforms with a shared exponent, detection.
Writes, partitioned by strip of looks and overwriting only the strips it made:

  products/strip=S   look, row, col, mean of each block of looks x looks samples, and its grey value
  health/strip=S     look, peak, mean, share of saturated and of non-zero samples (JSON lines)

What it wrote is read back and compared by digest before the job ends. A rerun over the same table
gives the same files' contents; strips that another run wrote stay.

    python -m jobs.scene_products SOURCE OUT --config jobs/scene_products.json"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import catalog, imaging, spectral
from gridloom.sources import frames
from gridloom.sources.shared import scratch
from jobs.command import log, main


@dataclass(frozen=True)
class Config:
    side: int = 64  # samples a line and lines a look
    scaling: str = "l1"
    taper: bool = True
    block: int = 4  # samples averaged along each axis
    strip: int = 16  # looks a partition of the output
    white: int = 4096  # magnitude shown as 255


def products(image: DataFrame, c: Config) -> DataFrame:
    """strip, look, row, col, mag, grey: block means of the looks of an image (row, col, mag) and their grey values."""
    look = F.floor(F.col("row") / c.side).cast("long")
    keys = [look.alias("look"), F.floor(F.col("row") % c.side / c.block).cast("int").alias("row"), F.floor(F.col("col") / c.block).cast("int").alias("col")]
    whole = image.where((F.col("row") % c.side < c.side - c.side % c.block) & (F.col("col") < c.side - c.side % c.block))
    means = whole.groupBy(*keys).agg((F.sum(F.col("mag").cast("long")) / (c.block * c.block)).alias("mag"))
    grey = F.least(F.lit(255), F.floor(F.col("mag") * 255 / c.white)).cast("int")
    return means.select(F.floor(F.col("look") / c.strip).cast("long").alias("strip"), "look", "row", "col", "mag", grey.alias("grey"))


def health(image: DataFrame, c: Config) -> DataFrame:
    """strip, look, peak, mean, saturated_pct, nonzero_pct of every look."""
    look = F.floor(F.col("row") / c.side).cast("long").alias("look")
    share = lambda x: (100.0 * F.sum(x.cast("long")) / F.count("*"))
    got = image.groupBy(look).agg(
        F.max("mag").alias("peak"), (F.sum(F.col("mag").cast("long")) / F.count("*")).alias("mean"),
        share(F.col("mag") >= 65535).alias("saturated_pct"), share(F.col("mag") > 0).alias("nonzero_pct"),
    )
    return got.select(F.floor(F.col("look") / c.strip).cast("long").alias("strip"), "*")


def run(spark: SparkSession, source: str, out: str, config: Config = Config()) -> dict[str, int]:
    """The whole job; returns how many vectors it read and how many rows of products and looks it wrote."""
    c, key = config, "spark.sql.sources.partitionOverwriteMode"
    vectors = spark.read.parquet(source)
    told = {"vectors": vectors.count()}
    log.info("read %s: %d vectors", source, told["vectors"])
    was = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        with scratch(spark) as keep:
            lines = spectral.pad_lines(frames.iq_rows(vectors), c.side, c.side)
            image = keep(imaging.form_image(lines, c.side, c.side, c.scaling, c.taper))
            made = {"products": keep(products(image, c)), "health": keep(health(image, c))}
            made["products"].repartition("strip").sortWithinPartitions("look", "row", "col").write.mode("overwrite").partitionBy("strip").parquet(f"{out}/products")
            made["health"].repartition("strip").sortWithinPartitions("look").write.mode("overwrite").partitionBy("strip").json(f"{out}/health")
            for name, back in (("products", read_products(spark, out)), ("health", read_health(spark, out))):
                strips = F.broadcast(made["health"].select("strip").distinct())  # those of this run; a row a strip
                if catalog.frame_digest(made[name].select(*back.columns)).first() != catalog.frame_digest(back.join(strips, "strip", "left_semi").select(*back.columns)).first():
                    raise RuntimeError(f"{out}/{name}: what was read back differs from what was written")
                told[name] = made[name].count()
                log.info("wrote %s/%s: %d rows", out, name, told[name])
    finally:
        spark.conf.set(key, was)
    return told


def read_products(spark: SparkSession, out: str) -> DataFrame:
    """The products as they stand; none before the first vector came."""
    return spark.read.schema("look long, row int, col int, mag double, grey int, strip long").parquet(f"{out}/products")


def read_health(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("look long, peak int, mean double, saturated_pct double, nonzero_pct double, strip long").json(f"{out}/health")


if __name__ == "__main__":
    main(run, Config(), "Forms the image products of a table of sample vectors.")
