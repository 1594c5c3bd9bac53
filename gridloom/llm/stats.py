"""Statistics of whole texts as Spark columns: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, in order; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def count_chars(text: Column, chars: str) -> Column:
    """How many code points of a text are among chars; null for null.

    One pass of a character class: translate() looks every character of the text up by itself, many times slower."""
    return F.regexp_count(text, F.lit("[" + "".join(c if c.isalnum() else "\\" + c for c in chars) + "]"))


def with_base(df: DataFrame) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) from its column text.

    n_repeat_words: the 64-bit hashes of the 3-word windows are sorted with their places; a place
    whose hash has an equal neighbour starts a repeated window; a window covers three words, less
    what the next one covers too. That is n log n in a text's words and needs no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = df.withColumn("_text", text).withColumn("_w", words(F.col("_text")))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines)
    w = F.col("_w")
    hashes = F.when(
        F.size(w) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
    )
    df = df.withColumn("_hash", hashes)
    own = F.col("_hash")
    windows = F.when(  # texts without a repeated hash, most of them, are done here
        F.size(F.array_distinct(own)) < F.size(own),
        F.sort_array(F.transform(own, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    df = df.withColumn("_win", windows)
    win = F.col("_win")
    hit = F.transform(
        win,
        lambda x, k: F.when(
            (x["h"] == F.get(win, k - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(win, k + 1)["h"]).eqNullSafe(True), x["i"]
        ),
    )
    df = df.withColumn("_at", F.sort_array(F.filter(hit, lambda x: x.isNotNull())))
    at = F.col("_at")
    covered = F.aggregate(
        F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return df.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": count_chars(F.col("_text"), "#*$%&|<>").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop("_text", "_w", "_lines", "_hash", "_win", "_at")


def with_shape(df: DataFrame) -> DataFrame:
    """df with the classifier's statistics, all double and defined for null and empty texts."""
    df = df.withColumn("_text", F.coalesce(F.col("text"), F.lit(""))).withColumn("_w", words(F.col("_text")))
    t, n, c = F.col("_text"), F.greatest(F.size("_w"), F.lit(1)), F.greatest(F.length("_text"), F.lit(1))
    return df.withColumns(
        {
            "f_words": F.log1p(F.size("_w")),
            "f_word_len": F.length(F.array_join("_w", "")) / n,
            "f_symbols": count_chars(t, "#*$%&<>") / n,
            "f_bars": count_chars(t, "|") / n,
            "f_upper": count_chars(t, _UPPER) / c,
            "f_shouts": count_chars(t, "!") / n,
            "f_digits": count_chars(t, "0123456789") / c,
            "f_stops": count_chars(t, ".,;:?") / n,
            "f_lines": F.size(F.split(t, "\n")) / n,
            "f_distinct": F.size(F.array_distinct("_w")) / n,
        }
    ).drop("_text", "_w")


SHAPE = ["f_words", "f_word_len", "f_symbols", "f_bars", "f_upper", "f_shouts", "f_digits", "f_stops", "f_lines", "f_distinct"]
