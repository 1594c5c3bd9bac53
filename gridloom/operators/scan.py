"""Ordered scans over tables of any size: running sums and sliding windows whose key is absent or hot.

A window function sends every row of its key to one task. Here rows are first dealt by ranges of
(key, order), so that a hot key spans many stretches, and each stretch is scanned by itself. What
passes from one stretch to the next is small: a carried total (running), or the few rows at its
edges (halo). Only these, a number a stretch, meet on the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

PART = "_part"


def deal(df: DataFrame, keys: list[str], parts: int | None = None, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """df in stretches of ascending keys with their number in the column _part; written by keep, so that every later look sees the same ones."""
    if not keys:
        raise ValueError("an order is needed")
    ranged = df.repartitionByRange(*([parts] if parts else []), *keys)
    return keep(ranged.withColumn(PART, F.spark_partition_id()))


def _group(group: list[str]) -> Column:
    return F.struct(*[F.col(g) for g in group]) if group else F.lit(0)


def carries(dealt: DataFrame, value: Column, group: list[str]) -> list[tuple]:
    """(part, total carried in) for the stretches that go on with the last key of the one before: a row a stretch at most."""
    sums = dealt.groupBy(PART, _group(group).alias("_g")).agg(F.sum(value).alias("_s"))
    ends = sums.groupBy(PART).agg(F.min("_g").alias("a"), F.max("_g").alias("z"), F.max_by("_s", "_g").alias("s")).orderBy(PART).collect()
    out, last, total = [], None, None
    for r in ends:
        goes_on = last is not None and last["z"] == r["a"]
        if goes_on and total is not None:
            out.append((r[PART], total))
        own = r["s"]
        if goes_on and r["a"] == r["z"] and total is not None:
            own = total if own is None else total + own
        last, total = r, own
    return out


def running(df: DataFrame, value: Column, order: list[str], group: list[str] = (), out: str = "upto", inclusive: bool = False, parts: int | None = None, keep=cut) -> DataFrame:
    """df with the sum of value over the rows of its group before it (or up to it) in this order.

    Nulls add nothing; without an earlier value the sum is 0. The order should be total, as for any
    window by rows. One shuffle by ranges, one by stretch, and no task holds a whole key."""
    group, order = list(group), list(order)
    dealt = deal(df.withColumn("_v", value), [*group, *order], parts, keep)
    spark = df.sparkSession
    kind = dealt.agg(F.sum("_v").alias("_c")).schema["_c"].dataType.simpleString()
    carry = spark.createDataFrame(carries(dealt, F.col("_v"), group), f"{PART} int, _c {kind}")
    first = dealt.groupBy(PART).agg(F.min(_group(group)).alias("_first"))  # whose key a carried total belongs to
    carry = carry.join(first, PART)
    local = Window.partitionBy(PART, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    got = dealt.withColumn("_own", F.coalesce(F.sum("_v").over(local), F.lit(0).cast(kind)))
    got = got.join(F.broadcast(carry), PART, "left")  # a row a stretch at most
    more = F.when(_group(group).eqNullSafe(F.col("_first")), F.col("_c"))
    rest = [c for c in df.columns if c != out]
    return got.select(*rest, (F.col("_own") + F.coalesce(more, F.lit(0).cast(kind))).alias(out))


def halo(df: DataFrame, order: list[str], group: list[str] = (), back: int = 0, ahead: int = 0, parts: int | None = None, keep=cut) -> DataFrame:
    """df in stretches (_part), each with copies (_halo) of the rows that lie up to back before and ahead behind it.

    Windows of that reach by rows, over Window.partitionBy("_part", *group).orderBy(*order), then equal those
    over whole keys for all rows that are no copies. Edges are back + ahead rows a stretch."""
    group, order = list(group), list(order)
    dealt = deal(df, [*group, *order], parts, keep)
    spark, n = df.sparkSession, [(r[PART], r["n"]) for r in dealt.groupBy(PART).agg(F.count("*").alias("n")).orderBy(PART).collect()]
    needs = []  # of which stretch another needs how many rows at that end
    for i, (p, _) in enumerate(n):
        for reach, step, end in ((back, -1, "tail"), (ahead, 1, "head")):
            k = i + step
            while reach > 0 and 0 <= k < len(n):
                take = min(reach, n[k][1])
                needs.append((n[k][0], end, take, p))
                reach, k = reach - take, k + step
    whole = dealt.withColumn("_halo", F.lit(False))
    if not needs:
        return whole
    keys = [*group, *order]
    up, down = Window.partitionBy(PART).orderBy(*keys), Window.partitionBy(PART).orderBy(*[F.desc_nulls_last(k) for k in keys])
    head = dealt.withColumn("_k", F.row_number().over(up)).where(F.col("_k") <= ahead).withColumn("_end", F.lit("head")) if ahead else None
    tail = dealt.withColumn("_k", F.row_number().over(down)).where(F.col("_k") <= back).withColumn("_end", F.lit("tail")) if back else None
    edge = head if tail is None else tail if head is None else head.unionByName(tail)
    to = F.broadcast(spark.createDataFrame(needs, f"{PART} int, _end string, _take int, _to int"))  # back + ahead rows a stretch at most
    copies = edge.join(to, [PART, "_end"]).where(F.col("_k") <= F.col("_take"))
    return whole.unionByName(copies.select(*df.columns, F.col("_to").alias(PART), F.lit(True).alias("_halo")))
