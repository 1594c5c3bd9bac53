"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in the order of a hash, form blocks. Weights are exact: a real weight is the
fraction its double stands for. With w a source's share of the weights, its ith block is released at
floor((i-1) / w) and due at ceil(i / w); earliest deadline first fills every slot, and at any slot a
source is less than one block off its weight. When a source has no block left, the others go on in
their proportions (the next phase), so every document is scheduled exactly once.

The schedule of blocks is one stream, made by one task on an executor from the written table of the
sources' sizes, so that there may be any number of sources; what it remembers is a block and at most
PIECE slots a source, and a phase begins with one look at the sources left. It leaves as pieces of
PIECE blocks of a source, which are broadcast up to BROADCAST_BLOCKS blocks and shuffled beyond. A document's place in its source is its place in a
bucket of bounded size plus the counts of the buckets before, so a source may hold any share of the rows.

Defined cases: a null source is a source of its own; documents with one id and source, repeated
rows included, keep an arbitrary order among themselves; a last block may be short, which leaves a
gap in position; weights of absent sources are ignored, sources without a weight, or with one of 0,
get a 1,024th of the sum of the weights; extra columns are kept, but for one of the result's name; an empty table gives an empty result."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

FRAME = 1024
#: Sources whose table of sizes may be broadcast: a name and 16 bytes each.
BROADCAST_SOURCES = 100_000
#: Blocks in a piece of the schedule, and blocks whose pieces may be broadcast: 12 bytes each.
PIECE, BROADCAST_BLOCKS = 1024, 4_000_000
PLAN = "m_source string, m_piece long, slots array<long>, phases array<int>"


def whole_parts(weights: list[float], frame: int) -> list[int]:
    """Integers in exactly these proportions; a source without a weight gets a frame-th of all the weights."""
    exact = [max(Fraction(w), Fraction(0)) for w in weights]
    least = sum(exact) / frame or Fraction(1)
    exact = [w or least for w in exact]
    scale = math.lcm(*(w.denominator for w in exact))
    return [int(w * scale) for w in exact]


def schedule(blocks: list[int], weights: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Source, block, slot and phase of every slot."""
    done, slot, number = [0] * len(blocks), 0, 0
    while active := [s for s, n in enumerate(blocks) if done[s] < n]:
        total = sum(weights[s] for s in active)
        waiting = [(0, -(-total // weights[s]), s, 1) for s in active]  # release, deadline, source, which block
        ready: list[tuple[int, int, int]] = []
        start, before, ended = slot, done.copy(), False
        heapq.heapify(waiting)
        while not ended:
            t = slot - start
            while waiting and waiting[0][0] <= t:
                _, due, s, i = heapq.heappop(waiting)
                heapq.heappush(ready, (due, s, i))
            due, s, i = heapq.heappop(ready)
            if due <= t:
                raise AssertionError("a block missed its deadline")
            yield s, done[s], slot, number
            slot, done[s] = slot + 1, before[s] + i
            ended = done[s] == blocks[s]
            heapq.heappush(waiting, (i * total // weights[s], -(-(i + 1) * total // weights[s]), s, i + 1))
        number += 1


def edf_frame(parts: list[int]) -> list[int]:
    """The source of every slot of a frame of as many slots as there are parts."""
    return [s for s, *_ in islice(schedule([a + 1 for a in parts], parts), sum(parts))]


def pieces(blocks: list[int], weights: list[int]) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """Rows (source, piece, slots, phases), a row for every PIECE blocks of a source in their order."""
    slots: list[list[int]] = [[] for _ in blocks]
    numbers: list[list[int]] = [[] for _ in blocks]
    for s, k, slot, number in schedule(blocks, weights):
        slots[s].append(slot)
        numbers[s].append(number)
        if (k + 1) % PIECE == 0 or k + 1 == blocks[s]:
            yield s, k // PIECE, slots[s], numbers[s]
            slots[s], numbers[s] = [], []


def phases(blocks: list[int], parts: list[int]) -> Iterator[tuple[int, int, int, int, int, int, list[int], list[int]]]:
    """pieces() as rows (source, first block, past the last, first slot, blocks, slots spanned, places from the first slot, phases)."""
    for s, piece, slots, numbers in pieces(blocks, parts):
        first = piece * PIECE
        yield s, first, first + len(slots), slots[0], len(slots), slots[-1] - slots[0] + 1, [x - slots[0] for x in slots], numbers


def source_key(source: Column) -> Column:
    """A source as a key that is never null, so that windows and joins on it share one shuffle."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def mix(docs: DataFrame, weights: dict | None = None, power: float = 0.5, block: int = 16, seed: int = 11, per_bucket: int = 1_024, out: str = "mix") -> DataFrame:
    """docs with the column out: struct of block, slot, phase and position, the place in the mixed order.

    weights maps sources to target weights; without it a source weighs its count to the given power."""
    key = source_key(docs["source"])
    sizes = cut(docs.groupBy(key.alias("b_source")).agg(F.count("*").alias("b_count")))  # a row a source, whatever their number
    few, n_blocks = sizes.agg(F.count("*") <= BROADCAST_SOURCES, F.coalesce(F.sum(F.ceil(F.col("b_count") / block)), F.lit(0))).first()
    goals = None if weights is None else {"" if s is None else f"={s}": float(w) for s, w in weights.items()}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sorted((s, n) for part in parts for s, n in zip(part["b_source"], part["b_count"].tolist(), strict=True))
        shares = whole_parts([n**power if goals is None else goals.get(s, 0.0) for s, n in known], FRAME)
        rows = ((known[s][0], *rest) for s, *rest in pieces([-(-n // block) for _, n in known], shares))
        while some := list(islice(rows, 64)):
            yield pd.DataFrame(some, columns=["m_source", "m_piece", "slots", "phases"])

    plan = sizes.coalesce(1).mapInPandas(run, PLAN)
    plan = F.broadcast(plan) if n_blocks <= BROADCAST_BLOCKS and few else plan
    deal = sizes.select("b_source", F.ceil(F.col("b_count") / per_bucket).alias("b_n"))
    deal = F.broadcast(deal) if few else deal
    rows = docs.drop(out) if out in docs.columns else docs
    dealt = rows.select(F.struct("*").alias("m_row"), docs["doc_id"].alias("m_id"), key.alias("m_src"))
    h = F.xxhash64("m_id", F.lit(seed))
    dealt = dealt.join(deal, F.col("m_src") == F.col("b_source"))
    dealt = dealt.withColumns({"m_h": h, "m_b": F.pmod(h, F.col("b_n"))}).drop("b_source", "b_n")
    counts = dealt.groupBy(F.col("m_src").alias("c_source"), F.col("m_b").alias("c_b")).agg(F.count("*").alias("c_n"))
    before = counts.withColumn("c_before", F.sum("c_n").over(Window.partitionBy("c_source").orderBy("c_b")) - F.col("c_n")).drop("c_n")
    local = F.row_number().over(Window.partitionBy("m_src", "m_b").orderBy("m_h", "m_id"))
    ranked = (
        dealt.withColumn("m_local", local)
        .join(before, (F.col("m_src") == F.col("c_source")) & (F.col("m_b") == F.col("c_b")))
        .withColumn("m_rank", F.col("c_before") + F.col("m_local") - 1)
        .withColumn("block", F.floor(F.col("m_rank") / block).cast("long"))
    )
    got = ranked.join(plan, (F.col("m_src") == F.col("m_source")) & (F.floor(F.col("block") / PIECE) == F.col("m_piece")))
    k = (F.col("block") % PIECE).cast("int")
    got = got.withColumns({"slot": F.get("slots", k), "phase": F.get("phases", k)}).withColumn("position", F.col("slot") * block + F.col("m_rank") % block)
    return got.select("m_row.*", F.struct("block", "slot", "phase", "position").alias(out))


def op6(spark, docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source")).select("doc_id", "source", "mix.*")
