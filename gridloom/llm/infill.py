"""Fill-in-middle transformation by a two-pass streaming matcher.

The first pass over a text counts its units; the second advances one lazy match iterator to the
two ranks at which the text is cut. No array of units or of their places is ever stored, so memory
beside the text is constant however many units it has.

Defined cases: null text counts as empty; empty texts stay plain, with no unit; a text that holds
one of the three marks stays plain, so that the marks of an output are unique and it can be taken
back; very long texts are cut whole, a batch of rows at a time; equal ranks give an empty middle;
rows that are equal or share an id are cut alike, each for itself; a null id is hashed as the empty
text; an empty table gives an empty result; an own column of the result's name gives way, all other
columns are kept, whatever their names."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = re.compile("<[PSM]>")


@dataclass(frozen=True)
class Infill:
    """How texts are cut: rate of 100 texts are transformed, spm of 100 of these with the suffix first."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    unit: str = LINES

    def draws(self, key: str) -> list[int]:
        """Four numbers of 32 bits from the seed and a row's key."""
        digest = sha256(f"{self.seed}:{key}".encode()).digest()
        return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def cut_at(text: str, unit: re.Pattern, first: int, second: int) -> tuple[int, int, int]:
    """n, and the ends in characters of the prefix and of the middle: after the smaller and the larger of both draws mod n + 1 units."""
    n = sum(1 for _ in unit.finditer(text))
    low, high = sorted((first % (n + 1), second % (n + 1)))
    walk, at, ends = unit.finditer(text), 0, []
    for steps in (low, high - low):
        for _ in range(steps):
            at = next(walk).end()
        ends.append(at)
    return n, *ends


def transform(text: str, key: str, how: Infill, unit: re.Pattern) -> tuple[int, str, int | None, int | None, str]:
    """n, form, characters of prefix and middle, output."""
    h1, h2, h3, h4 = how.draws(key)
    n, a, b = cut_at(text, unit, h1, h2)
    if not text or h3 % 100 >= how.rate or _MARKS.search(text):
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < how.spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, how: Infill = Infill(), out: str = "infill") -> DataFrame:
    """docs with the column out: struct<n, form, prefix_chars, middle_chars, output>."""

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        unit = re.compile(how.unit)
        for texts, keys in parts:
            got = pd.DataFrame([transform(t or "", k, how, unit) for t, k in zip(texts, keys, strict=True)], columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield got.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64", "form": object, "output": object})

    key = F.coalesce(docs["doc_id"].cast("string"), F.lit(""))
    return docs.withColumn(out, run(docs["text"], key))


def restore(output: Column, form: Column) -> Column:
    """The exact text from an output and its form; JVM-side."""
    p = F.split(output, _MARKS.pattern, -1)
    part = lambda i: F.get(p, F.lit(i))
    return (
        F.when(form == "psm", F.concat(part(1), part(3), part(2)))
        .when(form == "spm", F.concat(part(2), part(3), part(1)))
        .otherwise(output)
    )


def op12(spark, docs: DataFrame) -> DataFrame:
    got = fill_in_middle(docs.select("doc_id", "text"), out="_f")
    output, form = F.col("_f.output"), F.col("_f.form")
    return got.select(
        "doc_id",
        "_f.n",
        "_f.form",
        "_f.prefix_chars",
        "_f.middle_chars",
        F.sha2(output, 256).alias("output_sha256"),
        F.sha2(restore(output, form), 256).alias("restored_sha256"),
    )
