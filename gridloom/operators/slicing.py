"""Decimation, crops, padding, flips and shifts over long frames (row, col, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as fx


def decimate(frame: DataFrame, mu: int, nu: int) -> DataFrame:
    """Every mu-th row and nu-th column, renumbered; a plain filter, so it reaches the scan where row is a column of it."""
    kept = frame.where((F.col("row") % mu == 0) & (F.col("col") % nu == 0))
    return kept.withColumns({"row": F.floor(F.col("row") / mu).cast("long"), "col": F.floor(F.col("col") / nu).cast("int")})


def centre_crop(frame: DataFrame, n: int, k: int) -> DataFrame:
    """The middle k of n columns, renumbered; raw_col keeps the column's first place."""
    d0 = (n - k) // 2
    kept = frame.where((F.col("col") >= d0) & (F.col("col") < d0 + k))
    return kept.withColumn("raw_col", F.col("col")).withColumn("col", F.col("col") - d0)


def roi(frame: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Rows r0 to r1 and columns c0 to c1, upper bounds not included, renumbered."""
    if not (0 <= r0 < r1 and 0 <= c0 < c1):
        raise ValueError(f"bad bounds [{r0}, {r1}) x [{c0}, {c1})")
    kept = frame.where((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))
    return kept.withColumns({"row": F.col("row") - r0, "col": F.col("col") - c0})


def zero_pad(rows: DataFrame, width: int) -> DataFrame:
    """Array form: re and im extended by zeros to the width."""
    fill = lambda x: F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), F.lit(width) - F.size(x))))
    return rows.withColumns({"re": fill(F.col("re")), "im": fill(F.col("im"))})


def pad_grid(grid: DataFrame, n: int) -> DataFrame:
    """i, q of a uniform grid extended to n points by a value beyond its range, which no bracket holds."""
    ext = grid.agg(F.max("q").alias("hi"), F.min("q").alias("lo"))
    full = grid.sparkSession.range(n).select(F.col("id").cast("int").alias("i"))
    return full.join(grid, "i", "left").crossJoin(F.broadcast(ext)).select("i", F.coalesce("q", 2 * F.col("hi") - F.col("lo") + 1).alias("q"))


def shift(frame: DataFrame, h: int, w: int, inverse: bool = False) -> DataFrame:
    """Moves the zero-frequency sample to the middle, or back."""
    a, b = ((h + 1) // 2, (w + 1) // 2) if inverse else (h // 2, w // 2)
    return frame.withColumns({"row": (F.col("row") + a) % h, "col": ((F.col("col") + b) % w).cast("int")})


def orientations(h: int, w: int) -> dict[str, tuple[Column, Column]]:
    """The eight symmetries of a raster as expressions of the new row and column; for a square raster all keep its size."""
    r, c = F.col("row"), F.col("col")
    flat = {"id": (r, c), "flip_rows": (h - 1 - r, c), "flip_cols": (r, w - 1 - c), "rot180": (h - 1 - r, w - 1 - c)}
    return flat | {f"t_{k}": (y, x) for k, (x, y) in flat.items()}


def oriented(frame: DataFrame, h: int, w: int) -> DataFrame:
    """orient, row, col and the other columns: every symmetry of the frame in one pass."""
    rest = [x for x in frame.columns if x not in ("row", "col")]
    views = F.array(
        *[F.struct(F.lit(k).alias("orient"), y.cast("long").alias("row"), x.cast("long").alias("col")) for k, (y, x) in orientations(h, w).items()]
    )
    return frame.select(F.explode(views).alias("_o"), *rest).select("_o.*", *rest)


def plan_axis(n: Column, ladder: tuple[int, ...] = (8192, 16384)) -> Column:
    """Transform length for an axis: the first rung that holds it; beyond the last, an error."""
    out = F.lit(None).cast("int")
    for size in sorted(ladder, reverse=True):
        out = F.when(n <= size, size).otherwise(out)
    return F.when(n > max(ladder), F.raise_error(F.lit("axis too long"))).otherwise(out).cast("int")


def transpose(frame: DataFrame) -> DataFrame:
    """Long form: rows become columns; no data moves."""
    rest = [x for x in frame.columns if x not in ("row", "col")]
    return frame.select(F.col("col").cast("long").alias("row"), F.col("row").cast("int").alias("col"), *rest)


def transpose_strip(frame: DataFrame, base: int = 0, count: int = 0) -> DataFrame:
    """The transpose of a band of columns; count 0 is all of them."""
    return transpose(frame.where((F.col("col") >= base) & (F.col("col") < base + count)) if count else frame)


def worker_bounds(n: int, workers: int, align: int = 1) -> list[tuple[int, int]]:
    """Half-open slices of n items in whole units of align, one a worker; disjoint and complete."""
    units = -(-n // align)
    edges = [min(n, w * units // workers * align) for w in range(workers + 1)]
    return list(zip(edges, edges[1:], strict=False))


def block_cyclic(row: Column, block: int, chains: int) -> tuple[Column, Column]:
    """The chain that handles a row, and the row's place in the chain."""
    b = F.floor(row / block)
    return (b % chains).cast("int"), (F.floor(b / chains) * block + row % block).cast("long")


def checked(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """df, or an error at the first row where ok is not true."""
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def pow2_plan(dims: DataFrame) -> DataFrame:
    """dims (m, n) with the padded powers of two."""
    return dims.withColumns({"m2": fx.pow2_ceil(F.col("m")), "n2": fx.pow2_ceil(F.col("n"))})
