"""Georeferenced images as TIFF files, a file a strip of lines, written by the tasks that hold the strips.

Strips of one scene carry the scene's affine moved to their first line, so they lie side by side in any
viewer and no task holds a whole image; a strip as high as the image makes one file."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .phasehistory import opened

FILES = "scene long, strip int, path string, rows int, cols int, n_bytes long, crc long"
#: Fixed values of the format: tags, field types and the codes written.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, FORMAT, TRANSFORM, GEO_KEYS = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339, 34264, 34735
SHORT, LONG, DOUBLE = 3, 4, 12
KINDS = {"uint8": ("<u1", 1), "uint16": ("<u2", 1), "float32": ("<f4", 3)}


def encode(image: np.ndarray, affine: list[float], epsg: int, kind: str = "float32", block: int = 64) -> bytes:
    """A little-endian TIFF of one band in deflated blocks of lines; affine as of raster.scene_affine, of the image's own first line."""
    dtype, fmt = KINDS[kind]
    x = np.ascontiguousarray(image, dtype)
    h, w = x.shape
    blocks = [zlib.compress(x[k : k + block].tobytes(), 6) for k in range(0, h, block)]
    at = 8 + np.cumsum([0, *map(len, blocks)])
    a, b, e0, c, d, n0 = affine
    matrix = [a, b, 0, e0, c, d, 0, n0, 0, 0, 0, 0, 0, 0, 0, 1]
    keys = [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg]  # projected, places are corners of pixels, the system's number
    tags = [
        (WIDTH, LONG, [w]), (HEIGHT, LONG, [h]), (BITS, SHORT, [x.itemsize * 8]), (COMPRESSION, SHORT, [8]), (PHOTOMETRIC, SHORT, [1]),
        (OFFSETS, LONG, at[:-1].tolist()), (SAMPLES, SHORT, [1]), (ROWS, LONG, [block]), (COUNTS, LONG, [len(q) for q in blocks]),
        (FORMAT, SHORT, [fmt]), (TRANSFORM, DOUBLE, matrix), (GEO_KEYS, SHORT, keys),
    ]
    start = int(at[-1]) + int(at[-1]) % 2
    entries, extra, free = b"", b"", start + 2 + 12 * len(tags) + 4
    for tag, kind_no, values in tags:
        raw = struct.pack(f"<{len(values)}{ {SHORT: 'H', LONG: 'I', DOUBLE: 'd'}[kind_no] }", *values)
        if len(raw) > 4:
            place = struct.pack("<I", free + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            place = raw.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, kind_no, len(values)) + place
    return struct.pack("<2sHI", b"II", 42, start) + b"".join(blocks) + b"\0" * (int(at[-1]) % 2) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra


def write(lines: DataFrame, folder: str, kind: str = "float32", rows: int = 1024) -> DataFrame:
    """Writes the images of lines (scene, row, mag: array, affine, epsg) in strips of so many rows; FILES of what was written.

    Lines of a scene have one width; a line that is missing counts as zeros. A file is written whole under its own
    name, so a task that runs again writes the same."""

    def strip(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        scene, first = t.column("scene")[0].as_py(), t.column("row")[0].as_py() // rows * rows
        at = t.column("row").to_numpy() - first
        mags = t.column("mag").combine_chunks()
        x = np.zeros((int(at[-1]) + 1, len(mags[0])))
        x[at] = mags.flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
        a, b, e0, c, d, n0 = t.column("affine")[0].as_py()
        raw = encode(x, [a, b, e0 + b * first, c, d, n0 + d * first], t.column("epsg")[0].as_py(), kind)
        path = f"{folder}/scene={scene}/strip_{first // rows:05d}.tif"
        where, name = opened(path)
        where.create_dir(name.rpartition("/")[0], recursive=True)
        with where.open_output_stream(name) as f:
            f.write(raw)
        return pa.table({"scene": [scene], "strip": pa.array([first // rows], pa.int32()), "path": [path], "rows": pa.array([len(x)], pa.int32()), "cols": pa.array([x.shape[1]], pa.int32()), "n_bytes": [len(raw)], "crc": [zlib.crc32(raw)]})

    some = lines.select(F.col("scene").cast("long"), F.col("row").cast("long"), F.col("mag").cast("array<double>"), F.col("affine").cast("array<double>"), F.col("epsg").cast("int"))
    return some.groupBy("scene", F.floor(F.col("row") / rows).alias("_s")).applyInArrow(strip, FILES)
