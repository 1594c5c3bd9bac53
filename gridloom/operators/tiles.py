"""Packed lines and the tiled corner turn.

A packed line is one binary value: the planes re and im of a line one after the other, in numbers of
two bytes (int16 codes), four or eight. Packed lines are what image formation writes and shuffles:
one value a line instead of one a sample. The corner turn cuts lines into strips of TILE columns,
gathers the strips of many lines to one tile a task, shuffles tiles and transposes them where they
meet, so that what moves is a row a tile and no sample is a row of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Columns of a strip, samples of an Arrow batch of lines and of a group of the turn, and samples that a Python worker computes on at a time:
#: transforms hold them several times over in 64 bits.
TILE, BATCH, SAMPLES = 128, 1 << 21, 1 << 18
PACKED = "row long, iq binary"


@contextmanager
def lines_in_batches(spark: SparkSession, width: int):
    """Within it Arrow batches hold about BATCH samples of lines of this width; the session's own setting comes back after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    most = max(1, BATCH // max(1, width))
    if not 0 < int(was) <= most:
        spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def planes(column, width: int, dtype: str = "<i2") -> np.ndarray:
    """lines x 2 x width of a binary column of packed lines of one width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return np.frombuffer(raw.tobytes(), dtype).reshape(len(column), 2, width)


def binaries(x: np.ndarray, dtype: str = "<i2") -> pa.Array:
    """A binary column of packed lines from lines x 2 x width."""
    raw = np.ascontiguousarray(x, dtype)
    size = raw[0].nbytes if len(raw) else 0
    off = np.arange(len(raw) + 1, dtype=np.int64) * size
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(raw.tobytes())])


def chunks(n: int, width: int) -> Iterator[slice]:
    step = max(1, SAMPLES // max(1, width))
    for k in range(0, n, step):
        yield slice(k, min(n, k + step))


def line_l1(x: np.ndarray) -> np.ndarray:
    """The sum of |re| + |im| of each of some lines."""
    wide = x.astype(np.int64) if x.dtype.kind == "i" else x
    return np.abs(wide).sum((1, 2))


def listed(part: pa.RecordBatch, at: slice, width: int) -> np.ndarray:
    """lines x 2 x width of the array columns re and im of a batch; a line of another width is an error."""
    some = part.slice(at.start, at.stop - at.start)
    cols = [some.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("re", "im")]
    if any(len(c) != some.num_rows * width for c in cols):
        raise ValueError(f"every line must have {width} samples")
    return np.stack([c.reshape(-1, width) for c in cols], 1)


def pack(rows: DataFrame, width: int, dtype: str = "<i2") -> DataFrame:
    """Packed lines of the array form (row, re, im); codes that do not fit are an error."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for at in chunks(p.num_rows, width):
                x = listed(p, at, width)
                if dtype == "<i2" and x.size and (x.min() < -32768 or x.max() > 32767):
                    raise ValueError("samples must fit 16 bits")
                yield pa.RecordBatch.from_arrays([p.column("row").slice(at.start, at.stop - at.start), binaries(x, dtype)], ["row", "iq"])

    return rows.select("row", "re", "im").mapInArrow(run, PACKED)


def unpack(lines: DataFrame, width: int, dtype: str = "<i2", kind: str = "long") -> DataFrame:
    """row, re, im (arrays) of packed lines."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for at in chunks(p.num_rows, width):
                x = planes(p.column("iq").slice(at.start, at.stop - at.start), width, dtype)
                off = pa.array(np.arange(0, len(x) * width + 1, width), pa.int32())
                cols = [pa.ListArray.from_arrays(off, pa.array(x[:, k].ravel().astype("i8" if kind == "long" else "f8"))) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([p.column("row").slice(at.start, at.stop - at.start), *cols], ["row", "re", "im"])

    return lines.mapInArrow(run, f"row long, re array<{kind}>, im array<{kind}>")


def turn(lines: DataFrame, h: int, w: int, dtype: str = "<i2", tile: int | None = None, axis: str | None = None, then: Callable | None = None) -> DataFrame:
    """Corner turn of packed lines: of every look of h lines of w samples, w lines of h samples.

    A line that is missing counts as zeros, the last strip may be narrower; line numbers must be unique.
    Each line comes with l1, the sum of |re| + |im|. A group is one strip of one look, h x tile samples; longer
    looks have narrower strips.

    With then, the tile that came together (columns x 2 x h) passes through then(tile, values, first), whose
    result (columns x 2 x any) is what is written: values are those of the double column axis of the look's
    lines (NaN where a line is missing), first the tile's first column."""
    tile = tile or max(1, min(TILE, 4 * BATCH // h))
    also = [axis] if axis else []

    def cut_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kind = ["look", "strip", "rows", "axis", "data"], [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        for p in parts:
            for at in chunks(p.num_rows, w):
                row = p.column("row").slice(at.start, at.stop - at.start).to_numpy(zero_copy_only=False)
                x, look = planes(p.column("iq").slice(at.start, at.stop - at.start), w, dtype), row // h
                for one in np.unique(look):
                    on = np.flatnonzero(look == one)
                    mine, own = x[on], (row[on] % h).astype("<i4").tobytes()
                    value = p.column(axis).slice(at.start, at.stop - at.start).to_numpy(zero_copy_only=False)[on].astype("<f8").tobytes() if axis else b""
                    out = [(int(one), s, own, value, np.ascontiguousarray(mine[:, :, s * tile : (s + 1) * tile].transpose(2, 1, 0)).tobytes()) for s in range(-(-w // tile))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind, strict=True)], names)

    def join(t: pa.Table) -> pa.Table:
        look, strip = t.column("look")[0].as_py(), t.column("strip")[0].as_py()
        width = min(tile, w - strip * tile)
        out, values = np.zeros((width, 2, h), dtype), np.full(h, np.nan)
        for k in range(t.num_rows):
            at = np.frombuffer(t.column("rows")[k].as_py(), "<i4")
            out[:, :, at] = np.frombuffer(t.column("data")[k].as_py(), dtype).reshape(width, 2, len(at))
            if axis:
                values[at] = np.frombuffer(t.column("axis")[k].as_py(), "<f8")
        out = then(out, values, strip * tile) if then else out
        return pa.table([pa.array(look * w + strip * tile + np.arange(width)), binaries(out, dtype), pa.array(line_l1(out))], ["row", "iq", "l1"])

    return lines.select("row", "iq", *also).mapInArrow(cut_up, "look long, strip int, rows binary, axis binary, data binary").groupBy("look", "strip").applyInArrow(join, PACKED + (", l1 double" if "f" in dtype else ", l1 long"))
