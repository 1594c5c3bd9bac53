"""Stages new and changed texts as segments of block-aligned volumes, incrementally.

Follows a table of texts (doc_id, text, any further columns) as a file stream: a checkpoint tells
which files were taken, and each run takes all that are new, then ends. A text becomes a segment
with a fixed-width name, a revision, its checksum and its place: volumes are filled in the order of
ids, each segment begins at a block, and a batch goes on where the one before ended. A text that is
staged already is not staged again; a changed text of a known id becomes its next revision.

  segments/batch=N/volume=V   the payloads with their catalog columns
  rejects/batch=N             rows without an id or a text, with the reason
  journal/batch=N             rows read, staged, known and rejected, and the blocks of each volume after it

A batch is written to folders of its own number, so one that failed half-way is written anew with the same
result, and nothing of it counts until its journal is there.

    python -m jobs.stage_segments SOURCE OUT --config jobs/stage_segments.json"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.scan import running
from gridloom.sources import frames
from gridloom.sources.shared import scratch
from jobs.command import log, main


@dataclass(frozen=True)
class Config:
    volumes: int = 8
    block: int = 512  # bytes
    first: int = 8  # blocks that a volume keeps free at its start
    width: int = 32  # characters of a name
    prefix: str = "seg_"
    files: int = 0  # files a batch takes at most; 0 for all that are new


CATALOG = "doc_id long, revision long, name string, byte_len long, blocks long, lba long, crc long, sha256 string"
SEGMENTS = f"{CATALOG}, payload string, volume int, batch long"


def segments(spark: SparkSession, out: str) -> DataFrame:
    """All staged segments whose batch has its journal."""
    got, done = spark.read.schema(SEGMENTS).parquet(f"{out}/segments"), journal(spark, out).select("batch").distinct()
    return got.join(F.broadcast(done), "batch", "left_semi")  # a row a batch


def journal(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("n_read long, staged long, known long, rejected long, volume int, next_lba long, batch long").json(f"{out}/journal")


def new_segments(rows: DataFrame, known: DataFrame | None, keep) -> DataFrame:
    """doc_id, sha256, byte_len, revision of the texts of a batch that are not staged yet, one row each.

    Several texts of one id in a batch are numbered in the order of their checksums, after those staged before."""
    came = rows.select("doc_id", "sha256", F.octet_length("text").cast("long").alias("byte_len")).distinct()
    if known is not None:
        came = came.join(known.select("doc_id", "sha256"), ["doc_id", "sha256"], "left_anti")
    came = running(came, F.lit(1).cast("long"), ["sha256"], ["doc_id"], "revision", inclusive=True, keep=keep)
    if known is None:
        return came
    last = known.groupBy("doc_id").agg(F.max("revision").alias("_last"))
    return came.join(last, "doc_id", "left").withColumn("revision", F.col("revision") + F.coalesce("_last", F.lit(0))).drop("_last")


def place(new: DataFrame, ends: DataFrame | None, c: Config, keep) -> DataFrame:
    """new with name, volume, blocks and lba, its first block: a running sum over each volume from where it ended."""
    new = new.withColumns(
        {
            "volume": F.pmod("doc_id", F.lit(c.volumes)).cast("int"),
            "blocks": F.greatest(F.lit(1), F.ceil(F.col("byte_len") / c.block)).cast("long"),
            "name": F.rpad(frames.fixed_name(c.prefix, F.col("doc_id"), 10), F.lit(c.width), F.lit(" ")),
        }
    )
    got = running(new, F.col("blocks"), ["doc_id", "revision"], ["volume"], "_at", keep=keep)
    got = got.withColumn("next_lba", F.lit(None).cast("long")) if ends is None else got.join(F.broadcast(ends), "volume", "left")  # a row a volume
    return got.withColumn("lba", F.coalesce("next_lba", F.lit(c.first).cast("long")) + F.col("_at")).drop("_at", "next_lba")


def stage_batch(batch: DataFrame, number: int, out: str, c: Config) -> None:
    """Stages one batch; it depends on the batches before it alone, so that a repeated one gives the same."""
    spark, known, ends = batch.sparkSession, None, None
    if number:
        known = segments(spark, out).where(F.col("batch") < number)
        ends = journal(spark, out).where(F.col("batch") < number).where("volume IS NOT NULL").groupBy("volume").agg(F.max("next_lba").alias("next_lba"))
    reason = F.when(F.col("doc_id").isNull(), "no id").when(F.col("text").isNull(), "no text")
    batch.where(reason.isNotNull()).withColumn("reason", reason).write.mode("overwrite").json(f"{out}/rejects/batch={number}")
    rows = batch.where(reason.isNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.sha2("text", 256).alias("sha256"))
    with scratch(spark) as keep:
        placed = keep(place(new_segments(rows, known, keep), ends, c, keep))
        payload = rows.select("doc_id", "sha256", F.crc32(F.col("text").cast("binary")).alias("crc"), F.col("text").alias("payload"))
        made = payload.join(placed, ["doc_id", "sha256"]).dropDuplicates(["doc_id", "sha256"])
        spread = made.repartition("volume", F.pmod("lba", F.lit(64))).sortWithinPartitions("lba")  # a volume is no single task
        spread.write.mode("overwrite").partitionBy("volume").parquet(f"{out}/segments/batch={number}")
        sizes = batch.agg(F.count("*").alias("n"), F.count(reason).alias("bad")).first()
        staged = placed.count()
        after = placed.groupBy("volume").agg(F.max(F.col("lba") + F.col("blocks")).alias("next_lba")) if staged else spark.createDataFrame([(None, None)], "volume int, next_lba long")
        told = {"n_read": sizes["n"], "staged": staged, "known": sizes["n"] - sizes["bad"] - staged, "rejected": sizes["bad"]}
        after.select(*[F.lit(v).cast("long").alias(k) for k, v in told.items()], "volume", "next_lba").coalesce(1).write.mode("overwrite").json(f"{out}/journal/batch={number}")  # a row a volume
    log.info("batch %d: read %d rows, staged %d, %d known or repeated, %d rejected", number, *told.values())


def followed(path: str) -> str:
    """path as a pattern that matches it alone: a stream of files may begin at a single file only through one."""
    return re.sub(r"([A-Za-z0-9])(/*)$", r"[\1]\2", path)


def run(spark: SparkSession, source: str, out: str, config: Config = Config()) -> int:
    """Takes all files of source that are new since the last run into out; returns the number of batches."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    stream = stream.option("maxFilesPerTrigger", config.files) if config.files else stream
    log.info("following %s", source)
    told: list[int] = []

    def one(batch: DataFrame, number: int) -> None:
        stage_batch(batch, number, out, config)
        told.append(number)

    query = stream.parquet(followed(source)).writeStream.foreachBatch(one).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: %d batches", out, len(told))
    return len(told)


if __name__ == "__main__":
    main(run, Config(), "Stages new and changed texts as segments of block-aligned volumes.")
