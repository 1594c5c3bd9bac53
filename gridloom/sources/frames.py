"""Sampled frames: long form (row, col, values) and array form (row, re, im), and how they are read."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as fx


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def real_frame(vectors: DataFrame) -> DataFrame:
    """row, col, x of a table of vectors: a row a vector."""
    return vectors.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "x")).select("row", "col", F.col("x").cast("double").alias("x"))


def iq_rows(vectors: DataFrame, scale: int = 4096) -> DataFrame:
    """row, re, im (array<bigint>): vector 2r is the real and 2r+1 the imaginary part of row r, floored codes."""
    v = F.col("vec_id")
    codes = F.transform("embedding", lambda x: fx.sat16(F.floor(x.cast("double") * scale).cast("long")))
    even = vectors.where(v % 2 == 0).select(F.floor(v / 2).cast("long").alias("row"), codes.alias("re"))
    odd = vectors.where(v % 2 == 1).select(F.floor(v / 2).cast("long").alias("row"), codes.alias("im"))
    return even.join(odd, "row")


def to_long(rows: DataFrame, *keep: str) -> DataFrame:
    """Array form to long form."""
    return rows.select("row", *keep, F.posexplode(F.arrays_zip("re", "im")).alias("col", "_v")).select("row", "col", *keep, "_v.re", "_v.im")


def to_rows(frame: DataFrame) -> DataFrame:
    """Long form to array form, in the order of col: one shuffle by row."""
    packed = frame.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "re", "im"))).alias("_v"))
    return packed.select("row", F.transform("_v", lambda v: v["re"]).alias("re"), F.transform("_v", lambda v: v["im"]).alias("im"))


def to_packed(frame: DataFrame, width: int, dtype: str = "<i2") -> DataFrame:
    """Long form (row, col, re, im; 16-bit codes or, for <f8, any numbers) to packed lines (row, iq) of this width, with zeros where a line has no sample;
    of several in one place the last by value counts, and codes that do not fit are an error. One shuffle by row and one sort, line by line in Arrow."""

    most = max(1, (1 << 18) // width)  # lines at a time, however few samples each has

    def fill(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, line = None, np.zeros((1, 2, width), dtype)  # the line that the last batch ended in, not yet whole
        pack = lambda rows, x: pa.RecordBatch.from_arrays([pa.array(rows), pa.array([v.tobytes() for v in x], pa.binary())], ["row", "iq"])
        for p in parts:
            row, col, re, im = (p.column(c).to_numpy(zero_copy_only=False) for c in ("row", "col", "re", "im"))
            begins = np.flatnonzero(np.diff(row, prepend=row[:1] - 1))[::most]
            for at in map(slice, begins, [*begins[1:], len(row)]):
                rows, inv = np.unique(row[at], return_inverse=True)
                x = np.zeros((len(rows), 2, width), dtype)
                if rest is not None and rest == rows[0]:
                    x[0] = line[0]
                elif rest is not None:
                    yield pack(np.array([rest]), line)
                for k, v in ((0, re), (1, im)):
                    if dtype == "<i2" and len(v) and (v.min() < fx.I16_MIN or v.max() > fx.I16_MAX):
                        raise ValueError("samples must fit 16 bits")
                    x[inv, k, col[at]] = v[at]
                if len(rows) > 1:
                    yield pack(rows[:-1], x[:-1])
                rest, line = rows[-1], x[-1:].copy()
        if rest is not None:
            yield pack(np.array([rest]), line)

    to = "double" if "f" in dtype else "int"
    kind = frame.select("row", F.col("col").cast("int"), F.col("re").cast(to), F.col("im").cast(to))
    return kind.repartition("row").sortWithinPartitions("row", "col", "re", "im").mapInArrow(fill, "row long, iq binary")


def dims(frame: DataFrame) -> DataFrame:
    """n_rows, n_cols of a long frame."""
    return frame.agg((F.max("row") + 1).cast("long").alias("n_rows"), (F.max("col") + 1).cast("long").alias("n_cols"))


def parse_hex(lines: DataFrame) -> DataFrame:
    """re, im from a text column value of 32-bit words in hex; blank lines and # or // comments are skipped."""
    t = F.trim(F.regexp_replace("value", "(#|//).*$", ""))
    word = F.conv(t, 16, 10).cast("long")
    re, im = fx.unpack_iq(word)
    return lines.where(t != "").select(re.alias("re"), im.alias("im"))


def format_hex(frame: DataFrame) -> DataFrame:
    """One text column value of 8 hex digits a sample, keys kept in front for ordering."""
    return frame.select("row", "col", F.lpad(F.lower(F.hex(fx.pack_iq(F.col("re"), F.col("im")))), 8, "0").alias("value"))


def read_raw(spark: SparkSession, path: str, kind: str = "u32") -> DataFrame:
    """path, i, value of little-endian unsigned words (u16 or u32) in binary files, decoded in Arrow batches."""
    size, code = {"u16": (2, "H"), "u32": (4, "I")}[kind]

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, b in zip(part["path"], part["content"], strict=True):
                n = len(b) // size
                v = struct.unpack(f"<{n}{code}", b[: n * size])
                for k in range(0, n, 1 << 18):
                    yield pd.DataFrame({"path": p, "i": range(k, min(n, k + (1 << 18))), "value": v[k : k + (1 << 18)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, i long, value long")


def stage_files(spark: SparkSession, path: str) -> DataFrame:
    """path, byte_len, crc of every staged file, for checks against a manifest."""
    return spark.read.format("binaryFile").load(path).select("path", F.length("content").cast("long").alias("byte_len"), F.crc32("content").alias("crc"))


LEDGER = "phenomenon string, build string, metric string, value double, scheduled double, unit string, source string, note string, ts string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).json(path)


def stress_line(line: DataFrame, key: str, every: int = 12) -> DataFrame:
    """line (key, re, im, ...) with both ends of the 16-bit range in its way: after every so many keys re is full and im empty, half-way the other way round."""
    k, low, high = F.pmod(key, F.lit(every)), F.lit(fx.I16_MIN), F.lit(fx.I16_MAX)
    put = lambda c, a, b: F.when(k == 0, a).when(k == every // 2, b).otherwise(F.col(c)).cast("long").alias(c)
    return line.withColumns({"_re": put("re", high, low), "_im": put("im", low, high)}).drop("re", "im").withColumnsRenamed({"_re": "re", "_im": "im"})


def stimuli(places: DataFrame, n: int, scale: float = 2000.0) -> DataFrame:
    """case, k, re, im of transform stimuli at the places k of a table, periodic in n: impulses, levels, tones.

    twotone_hidr and dc_smalltone hold a weak tone 60 dB below a strong one, which a datapath that floors
    small values loses. The cases and their sizes are fixed values: they are those of the vectors to match."""
    k = F.col("k")
    wave = lambda size, f: (size * F.cos(2 * F.pi() * f * (k % n) / n), size * F.sin(2 * F.pi() * f * (k % n) / n))
    both = lambda a, b: (a[0] + b[0], a[1] + b[1])
    spike = lambda at: (F.when(k % n == at, scale).otherwise(0.0), F.lit(0.0))
    level = (F.lit(scale), F.lit(0.0))
    rows = {
        "impulse": spike(0), "dc": level, "tone": wave(scale, n // 8), "twotone": both(wave(scale, 5), wave(0.5 * scale, n // 3)), "impulse_k": spike(37 % n),
        "twotone_hidr": both(wave(scale, 11), wave(1e-3 * scale, n // 3)), "dc_smalltone": both(level, wave(1e-3 * scale, n // 5)),
    }
    cases = F.array(*[F.struct(F.lit(c).alias("case"), re.alias("re"), im.alias("im")) for c, (re, im) in rows.items()])
    return places.select(k.alias("k"), F.explode(cases).alias("c")).select("c.case", "k", "c.re", "c.im")


def scene_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and byte_len of the files below a folder that match a pattern, in the order of their paths; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("byte_len")).orderBy("path")


def siblings(name: Column, suffix: str, others: list[str]) -> Column:
    """The names beside one that ends in suffix: its stem with each of the other suffixes; none for another name."""
    stem = F.substring(name, F.lit(1), F.length(name) - len(suffix))
    return F.when(F.endswith(name, F.lit(suffix)), F.array(*[F.concat(stem, F.lit(o)) for o in others])).otherwise(F.array().cast("array<string>"))


def fixed_name(prefix: str, number: Column, width: int = 5) -> Column:
    """A name with its number padded by zeros, so that names sort as numbers do; longer numbers keep all digits."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0")))
