"""Image formation over packed lines: taper, row pass, corner turn, row pass, detection.

Every stage is one look over written lines, and what the next stage must know of all lines (an
exponent, how many values saturated) is observed while they are written, so no stage needs an action
of its own for it. Scaling rules are those of spectral.line_pass, with the same results."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..sources.shared import cut, scratch
from . import tiles
from .spectral import line_kernel

#: Stage codes of a report: done, a frame that cannot be formed, first pass, corner turn, second pass.
DONE, BAD_FRAME, FIRST_PASS, CORNER_TURN, SECOND_PASS = range(5)
RULES = {"l1": "full", "global": "full", "perrow": "perrow", "uncond": "uncond"}


@dataclass
class Report:
    """How far an image came: the code of the stage that failed (0: none), and each pass's exponent and saturated values."""

    code: int = DONE
    exponents: list[int] = field(default_factory=list)
    saturated: list[int] = field(default_factory=list)


class StageError(RuntimeError):
    def __init__(self, code: int, why: Exception):
        super().__init__(f"stage {code}: {why}")
        self.code = code


@contextmanager
def stage(report: Report, code: int):
    try:
        yield
    except Exception as e:
        report.code = code
        raise StageError(code, e) from e


def _wrap(x: np.ndarray) -> np.ndarray:
    return ((x + 32768) & 65535) - 32768


def tapered(rows: DataFrame, h: int, w: int, taper: bool, window: tuple[int, int] | None = None) -> DataFrame:
    """row, iq, l1 of lines (row, re, im or row, iq) under the Q15 window of the first window lines and samples of a look (all, if none is
    given; 0 beyond); both tapers wrap as one coefficient, and so does the product."""
    packed = "iq" in rows.columns
    tr, tc = (np.pad(np.array(fx.taper_q15(k), np.int64), (0, n - k)) for k, n in zip(window or (h, w), (h, w), strict=True))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for at in tiles.chunks(p.num_rows, w):
                row = p.column("row").slice(at.start, at.stop - at.start)
                x = tiles.planes(p.column("iq").slice(at.start, at.stop - at.start), w) if packed else tiles.listed(p, at, w)
                x = x.astype(np.int64)
                if x.size and (x.min() < fx.I16_MIN or x.max() > fx.I16_MAX):
                    raise ValueError("samples must fit 16 bits")
                if taper:
                    k = tr[row.to_numpy(zero_copy_only=False) % h]
                    x = _wrap((x * _wrap((k[:, None] * tc) >> 15)[:, None]) >> 15)
                yield pa.RecordBatch.from_arrays([row, tiles.binaries(x), pa.array(tiles.line_l1(x))], ["row", "iq", "l1"])

    return rows.select("row", *(["iq"] if packed else ["re", "im"])).mapInArrow(run, tiles.PACKED + ", l1 long")


def passed(lines: DataFrame, n: int, rule: str, shift: int = 0, wide: bool = False) -> DataFrame:
    """row, iq, exp, peak (largest value of a line before the shift) and over (values that the shift left too large); wide keeps all bits and does not shift."""
    dtype = ("<i4" if n <= 1 << 14 else "<i8") if wide else "<i2"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for at in tiles.chunks(p.num_rows, n):
                x = tiles.planes(p.column("iq").slice(at.start, at.stop - at.start), n).transpose(1, 0, 2).astype(np.int64)
                y, exp = line_kernel(x, rule)
                peak, y = np.abs(y).max(axis=(0, 2)), y >> shift
                over = ((y > fx.I16_MAX) | (y < fx.I16_MIN)).sum(axis=(0, 2))
                y = y if wide else np.clip(y, fx.I16_MIN, fx.I16_MAX)
                cols = [tiles.binaries(y.transpose(1, 0, 2), dtype), pa.array(exp + shift, pa.int32()), pa.array(peak), pa.array(over * (not wide))]
                yield pa.RecordBatch.from_arrays([p.column("row").slice(at.start, at.stop - at.start), *cols], ["row", "iq", "exp", "peak", "over"])

    return lines.select("row", "iq").mapInArrow(run, tiles.PACKED + ", exp int, peak long, over long")


def shifted(lines: DataFrame, n: int, dtype: str, shift: int | None = None, top: int = 0, deep: int = 12) -> DataFrame:
    """row, iq, over: every value shifted down by shift and saturated, or (None) by how far its line's exponent lies below top; a line more than deep below becomes 0."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for at in tiles.chunks(p.num_rows, n):
                some = p.slice(at.start, at.stop - at.start)
                x = tiles.planes(some.column("iq"), n, dtype).astype(np.int64)
                if shift is None:
                    by = top - some.column("exp").to_numpy(zero_copy_only=False).astype(np.int64)
                    x = np.where((by > deep)[:, None, None], 0, x >> np.minimum(by, 62)[:, None, None])
                else:
                    x = x >> shift
                over = ((x > fx.I16_MAX) | (x < fx.I16_MIN)).sum((1, 2))
                yield pa.RecordBatch.from_arrays([some.column("row"), tiles.binaries(np.clip(x, fx.I16_MIN, fx.I16_MAX)), pa.array(over)], ["row", "iq", "over"])

    return lines.select("row", "iq", *([] if shift is not None else ["exp"])).mapInArrow(run, tiles.PACKED + ", over long")


def watched(df: DataFrame, **measures) -> tuple[DataFrame, Observation]:
    """df whose measures are taken while it is next written; of nothing they are 0."""
    seen = Observation()
    return df.observe(seen, *[F.coalesce(m, F.lit(0)).alias(k) for k, m in measures.items()]), seen


def one_pass(lines: DataFrame, n: int, scaling: str, l1: int, keep, report: Report) -> tuple[DataFrame, Observation | None]:
    """The lines after a pass and its scaling, not yet written, and what will be observed of them (how many values saturated)."""
    over = F.sum("over")
    if scaling == "l1":
        e = max(0, int(l1).bit_length() - 15)
        report.exponents.append(e)
        return watched(passed(lines, n, "full", e), over=over)
    if scaling == "global":
        full, seen = watched(passed(lines, n, "full", wide=True), peak=F.max("peak"))
        full = keep(full)
        m = int(seen.get["peak"])
        e = ((m + fx.I16_MAX) // fx.I16_MAX - 1).bit_length() if m > fx.I16_MAX else 0
        report.exponents.append(e)
        return watched(shifted(full, n, "<i4" if n <= 1 << 14 else "<i8", e), over=over)
    done, seen = watched(passed(lines, n, RULES[scaling]), top=F.max("exp"))
    if scaling != "perrow":
        report.exponents.append(0)
        return done, None
    done = keep(done)
    report.exponents.append(int(seen.get["top"]))
    return watched(shifted(done, n, "<i2", None, report.exponents[-1]), over=over)


def detected(lines: DataFrame, n: int) -> DataFrame:
    """row and mag (binary, uint16): the floored magnitudes of packed lines."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for at in tiles.chunks(p.num_rows, n):
                x = tiles.planes(p.column("iq").slice(at.start, at.stop - at.start), n).astype(np.int64)
                mag = np.minimum(65535, np.floor(np.sqrt((x * x).sum(1).astype(float)))).astype("<u2")
                yield pa.RecordBatch.from_arrays([p.column("row").slice(at.start, at.stop - at.start), pa.array([m.tobytes() for m in mag], pa.binary())], ["row", "mag"])

    return lines.select("row", "iq").mapInArrow(run, "row long, mag binary")


def pixels(lines: DataFrame) -> DataFrame:
    """row, col, mag of detected lines."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for k in range(0, p.num_rows, 256):
                some = p.slice(k, 256)
                mags = [np.frombuffer(m, "<u2").astype(np.int32) for m in some.column("mag").to_pylist()]
                off = np.cumsum([0, *map(len, mags)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column("row"), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(mags)))], ["row", "mag"])

    return lines.mapInArrow(run, "row long, mag array<int>").select("row", F.posexplode("mag").alias("col", "mag"))


def form_image(rows: DataFrame, h: int, w: int, scaling: str = "l1", taper: bool = True, report: Report | None = None, window: tuple[int, int] | None = None) -> DataFrame:
    """row, col, mag of a frame of w columns (row, re, im, or packed row, iq).

    A frame of more than h rows is a stack of looks of h rows each, whose images have w rows each;
    shared exponents are those of all looks. The image has the transform's orientation after the
    turn: (range bin, cross-range bin). Of looks that were padded, window says how many lines and samples the
    taper spans. A failed stage raises StageError; report, if given, then holds
    its code, and exponents and saturated values else."""
    report = Report() if report is None else report
    spark = rows.sparkSession
    with stage(report, BAD_FRAME):
        if h < 1 or w < 1 or h & (h - 1) or w & (w - 1) or scaling not in RULES:
            raise ValueError(f"no image of {h} x {w} samples, rule {scaling}")
    with scratch(spark) as keep, tiles.lines_in_batches(spark, max(h, w)):
        with stage(report, BAD_FRAME):
            x, seen = watched(tapered(rows, h, w, taper, window), l1=F.max("l1"))
            x = keep(x)
        with stage(report, FIRST_PASS):
            y, over = one_pass(x, w, scaling, seen.get["l1"], keep, report)
        with stage(report, CORNER_TURN):
            z, seen = watched(tiles.turn(y.select("row", "iq"), h, w), l1=F.max("l1"))
            z = keep(z)
            report.saturated.append(int(over.get["over"]) if over else 0)
        with stage(report, SECOND_PASS):
            z, over = one_pass(z, h, scaling, seen.get["l1"], keep, report)
            image = cut(detected(z, h))
            report.saturated.append(int(over.get["over"]) if over else 0)
    return pixels(image)
