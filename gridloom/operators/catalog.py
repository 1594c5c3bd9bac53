"""Scene catalog, segment layout, checksums, ledgers and timing."""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import PART, halo, running

ALIGN = 512
PHENOMENA = ("compute", "memory", "transfer", "stall", "overhead", "other")


def offsets(segments: DataFrame, scene: str = "scene_id", order: str = "role", length: str = "byte_len", align: int = ALIGN) -> DataFrame:
    """segments with blob_off, the aligned running offset within a scene; a scene may hold any share of the segments."""
    return running(segments, (F.ceil(F.col(length) / align) * align).cast("long"), [order], [scene], "blob_off")


def image_layout(scenes: DataFrame, first: int = 0, block: int = ALIGN) -> DataFrame:
    """scenes (scene_id, byte_len) with lba, the first block of each in one image: an exclusive running sum over stretches of the catalog."""
    got = running(scenes, F.ceil(F.col("byte_len") / block).cast("long"), ["scene_id"], out="lba")
    return got.withColumn("lba", F.col("lba") + first)


def write_stage(frame: DataFrame, path: str, scene: str) -> None:
    """A scene's frame as a partition of a dataset, and beside it a manifest with its digest, dimensions and the number of the run."""
    frame.write.mode("overwrite").parquet(f"{path}/frames/scene={scene}")
    d = frame_digest(frame).crossJoin(frame.agg((F.max("row") + 1).alias("m"), (F.max("col") + 1).alias("n_cols")))
    d.select(F.lit(scene).alias("scene"), "n", "digest", "m", "n_cols", F.lit(time.time_ns()).alias("run")).write.mode("append").json(f"{path}/manifest")


def read_stage(spark, path: str, scene: str) -> DataFrame:
    """The scene's frame, or an error if it is not what its newest manifest says."""
    frame = spark.read.parquet(f"{path}/frames/scene={scene}")
    told = spark.read.schema("scene string, n long, digest string, run long").json(f"{path}/manifest").where(F.col("scene") == scene)
    last = told.agg(F.max_by(F.struct("n", "digest"), F.coalesce("run", F.lit(0))).alias("last")).first()["last"]
    got = frame_digest(frame).first()
    if last is None or (got["n"], got["digest"]) != (last["n"], last["digest"]):
        raise RuntimeError(f"scene {scene}: the frame differs from its manifest")
    return frame


def verify(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows, by digest."""
    return frame_digest(a.select(*sorted(a.columns))).first() == frame_digest(b.select(*sorted(a.columns))).first()


def fractional_delays(weights: DataFrame, wq: str = "wq") -> DataFrame:
    """n and the share of Q15 weights whose delay lies in [0.3, 0.7], where two taps err most."""
    t = F.col(wq) / 32768.0
    return weights.agg(F.count("*").alias("n"), F.avg(((t >= 0.3) & (t <= 0.7)).cast("double")).alias("mid_share"))


def occupied_bandwidth(spectrum: DataFrame, floor_db: float = -20.0) -> DataFrame:
    """share: the part of bins (amp) within floor_db of the largest."""
    top = spectrum.agg(F.max("amp").alias("top"))
    on = 20 * F.log10(F.greatest(F.col("amp"), F.lit(1e-300)) / F.col("top")) >= floor_db
    return spectrum.crossJoin(F.broadcast(top)).agg(F.avg(on.cast("double")).alias("share"))


def job(catalog: DataFrame, segments: DataFrame, scene_id: int) -> DataFrame:
    """The scene's catalog row with a map of its segments' offsets by role. Both scans are pruned where scene_id is a stored column and offsets are stored too."""
    s = segments.where(F.col("scene_id") == scene_id).groupBy("scene_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "blob_off")))).alias("at"))
    return catalog.where(F.col("scene_id") == scene_id).join(s, "scene_id")


def crc_report(segments: DataFrame, payload: str = "payload", expected: str = "crc") -> DataFrame:
    """segments with got_crc and ok."""
    got = F.crc32(F.col(payload).cast("binary"))
    return segments.withColumn("got_crc", got).withColumn("ok", F.col("got_crc") == F.col(expected))


def frame_digest(frame: DataFrame) -> DataFrame:
    """One row: count and an order-insensitive digest of a frame, the sum of its rows' hashes, for write-then-read checks of any size."""
    h = F.xxhash64(*sorted(frame.columns)).cast("decimal(28,0)")
    return frame.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the CRC-32 polynomial; the highest bit is the constant term."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def join_crc(first: int, second: int, n: int) -> int:
    """CRC-32 of two byte strings one after the other from those of both; the second has n bytes."""
    step, power = 1 << 23, 1 << 31  # x**8, which is a byte's shift, and 1
    while n:
        power = _times(power, step) if n & 1 else power
        step, n = _times(step, step), n >> 1
    return _times(first, power) ^ second


def region_crc(rows: DataFrame) -> DataFrame:
    """One row, n_bytes and crc: the CRC-32 of a frame (row, re, im) as a region of little-endian int16 pairs re, im in row order.

    Rows are dealt by ranges; a task folds its lines into one checksum, and the tasks' meet in order."""

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, crc, n = None, 0, 0
        for p in parts:
            for row, re, im in zip(p["row"], p["re"], p["im"], strict=True):
                raw = np.stack([re, im], 1).astype("<i2").tobytes()
                first, crc, n = row if first is None else first, zlib.crc32(raw, crc), n + len(raw)
        if first is not None:
            yield pd.DataFrame({"first": [first], "crc": [crc], "n": [n]})

    spark = rows.sparkSession
    got = rows.select("row", "re", "im").repartitionByRange("row").sortWithinPartitions("row").mapInPandas(fold, "first long, crc long, n long").orderBy("first").collect()  # a row a task
    crc = 0
    for r in got:
        crc = join_crc(crc, r["crc"], r["n"])
    return spark.createDataFrame([(sum(r["n"] for r in got), crc)], "n_bytes long, crc long")


def burst_bucket(beats: Column) -> Column:
    """Bucket name of a burst length: 1, 2-4, 5-16, 17-64, 65-256; null outside."""
    return (
        F.when(beats == 1, "h1").when((beats >= 2) & (beats <= 4), "h2_4").when((beats >= 5) & (beats <= 16), "h5_16")
        .when((beats >= 17) & (beats <= 64), "h17_64").when((beats >= 65) & (beats <= 256), "h65_256")
    )


def burst_histogram(bursts: DataFrame, key: str, beats: str) -> DataFrame:
    """key, bucket, n (saturating at 32 bits)."""
    b = bursts.withColumn("bucket", burst_bucket(F.col(beats))).where("bucket is not null")
    return b.groupBy(key, "bucket").agg(F.least(F.count("*"), F.lit(4294967295)).alias("n"))


def bus_ratios(record: DataFrame) -> DataFrame:
    """record (busy, elapsed, beats, aw_count, r_datawait) with utilisation, beats a burst, idle share and wait share in percent."""
    pct = lambda a, b: 100.0 * F.try_divide(a.cast("double"), b)
    c = F.col
    return record.withColumns(
        {
            "util_pct": pct(c("busy"), c("elapsed")), "avg_burst": F.try_divide(c("beats").cast("double"), c("aw_count")),
            "idle_pct": pct(c("elapsed") - c("busy"), c("elapsed")), "wait_pct": pct(c("r_datawait"), c("elapsed")),
        }
    )


def initiation_interval(records: DataFrame) -> DataFrame:
    """records (busy, elements, scheduled) with ii and its ratio to the schedule; records without elements are rejected."""
    ii = F.round(F.col("busy") / F.col("elements"), 4)
    return records.where(F.col("elements") > 0).withColumn("ii", ii).withColumn("ratio", F.round(F.try_divide(F.col("ii"), F.col("scheduled")), 3))


def ledger_rollup(ledger: DataFrame) -> DataFrame:
    """phenomenon, n, first_ts, last_ts, last_value, mean_value."""
    last = F.max_by("value", F.struct("ts", "value"))
    return ledger.groupBy("phenomenon").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), last.alias("last_value"), F.avg("value").alias("mean_value")
    )


def append_ledger(records: DataFrame, path: str) -> None:
    """Appends records as JSON lines; an unknown phenomenon is an error, an absent date is today's."""
    known = F.col("phenomenon").isin(*PHENOMENA)
    ok = records.where(F.when(known, F.lit(True)).otherwise(F.raise_error(F.lit("unknown phenomenon")).cast("boolean")))
    ok.withColumn("ts", F.coalesce("ts", F.current_date().cast("string"))).write.mode("append").json(path)


def stage_shares(stages: DataFrame, key: str, order: str, at: str) -> DataFrame:
    """stages with elapsed (since the stage before) and share of the key's total; a key may hold any share of the rows."""
    w = Window.partitionBy(PART, key).orderBy(order)
    e = halo(stages, [order], [key], back=1).withColumn("elapsed", F.col(at) - F.lag(at).over(w)).where("elapsed IS NOT NULL AND NOT _halo").drop(PART, "_halo")
    total = e.groupBy(F.col(key).alias("_k")).agg(F.sum("elapsed").alias("_total"))
    return e.join(total, F.col(key).eqNullSafe(F.col("_k"))).withColumn("share", F.try_divide(F.col("elapsed").cast("double"), "_total")).drop("_k", "_total")


def estimate(catalog: DataFrame, base_elems: float, base_seconds: float, base_gb: float) -> DataFrame:
    """catalog (m, n) with est_seconds and est_gb: measured figures scaled by elements, time also by the logarithm of the length."""
    e = F.col("m").cast("double") * F.col("n")
    return catalog.withColumns(
        {"est_seconds": base_seconds * (e / base_elems) * F.log2(e) / F.log2(F.lit(base_elems)), "est_gb": base_gb * e / base_elems}
    )


def save_image(image: DataFrame, catalog_path: str, image_path: str, scene_id: int, run_seq: int) -> None:
    """Writes an image, reads it back, compares digests, and only then appends its catalog row; earlier rows stay."""
    spark = image.sparkSession
    target = f"{image_path}/scene={scene_id}/run={run_seq}"
    image.write.mode("overwrite").parquet(target)
    back = spark.read.parquet(target)
    a, b = frame_digest(image.select(*back.columns)).first(), frame_digest(back).first()
    if a != b:
        raise RuntimeError(f"scene {scene_id}: what was read back differs from what was written")
    row = back.agg((F.max("row") + 1).cast("int").alias("rows"), (F.max("col") + 1).cast("int").alias("cols"))
    row.select(F.lit(scene_id).alias("scene_id"), F.lit(run_seq).alias("run_seq"), "rows", "cols", F.lit(b["digest"]).alias("digest")).write.mode("append").parquet(catalog_path)
