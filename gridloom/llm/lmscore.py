"""Cross-entropy difference between a target and a background language model.

Both are interpolated bigram models over one vocabulary, the words of the corpus; the background's
counts are scaled to the target's number of words, so the two are smoothed alike. Counts come from
every document and are those of the words and bigrams themselves, each by a hash that has 15 bits more
than the corpus has bigrams, so that of 30,000 keys about one meets another at any size; nothing is
bounded, broadcast or held whole by a task. Chunks of texts send their
counts, added up by key, to ranges of keys, whose totals come back to the chunks. A document is
scored without its own counts in either model (leave one out), so that members of the target have
no advantage.

Defined cases: null texts and texts without words have no loss (null) and n_tokens 0; a very long
text is a chunk by itself; labels that are null or repeated count once, by their worst; rows with a
null id are background and are scored; ties cannot occur; without target documents the target model
is the uniform one; repeated rows count and are scored each; extra columns, whatever their names, are
ignored; an empty table gives an empty result."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, scratch, text_chunks, word_hashes

#: Bytes of text in a chunk, and bytes of text for each range of keys.
CHUNK, RANGE = 1 << 22, 1 << 24
#: Ids of target documents that may be broadcast: 8 bytes each.
BROADCAST_IDS = 2_000_000
OUT = "doc_id long, n_tokens long, loss_target double, loss_background double"
CHUNKS = "chunk string, ids array<long>, t array<boolean>, text binary, words binary, n0 long, n1 long"
PIECES = "chunk string, range int, keys binary, data binary"


def hash_bits(n_bytes: int) -> int:
    """Bits of a key's hash for a corpus of so many bytes, which has less than an eighth as many bigrams."""
    return min(62, max(40, n_bytes.bit_length() + 12))


def opening(bits: int) -> int:
    """The key that stands before a text's first word."""
    return (1 << bits) - 1 << 1


def tokens(array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word its row, its key, the key of the word before (opening() where it opens a text) and the bigram's.

    A key is a hash and a last bit, 0 for words and 1 for bigrams."""
    h, row = word_hashes(array)
    opens = np.ones(len(h), bool)
    opens[1:] = row[1:] != row[:-1]
    last = np.zeros_like(h)
    last[1:] = h[:-1]
    last[opens] = 0
    key = lambda x, bit: ((x & np.uint64((1 << bits) - 1)) << np.uint64(1) | np.uint64(bit)).astype(np.int64)
    word, pair = key(h, 0), key(mix(last * np.uint64(0x9FB21C651E98DF25) + h), 1)
    return row, word, np.where(opens, opening(bits), key(last, 0)), pair


def ranges(keys: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The range of each key of n ranges; ascending keys have ascending ranges."""
    return ((keys.astype(np.uint64) >> np.uint64(bits - 31)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def squeeze(counts: np.ndarray) -> bytes:
    """Counts (2 x n) in as few bytes a number as the largest needs, compressed; the first byte says how many."""
    size = 1 if counts.max(initial=0) < 1 << 8 else 2 if counts.max() < 1 << 16 else 8
    return bytes([size]) + zlib.compress(counts.astype(f"<u{size}").tobytes(), 1)


def spread(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), f"<u{raw[0]}").reshape(2, -1).astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as steps, byte by byte of all of them, compressed; the first byte says how many bytes a step has."""
    steps = np.diff(keys, prepend=0).astype("<u8")
    size = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([size]) + zlib.compress(steps.view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes(), 1)


def unpack_keys(raw: bytes) -> np.ndarray:
    data = np.frombuffer(zlib.decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    steps = np.zeros((data.shape[1], 8), np.uint8)
    steps[:, : raw[0]] = data.T
    return np.cumsum(steps.view("<i8").ravel())


def own_counts(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each word how often its row holds its key (small numbers)."""
    if not len(row):
        return np.zeros(0, np.int64)
    _, inv, n = np.unique(row * (key.max() + 1) + key, return_inverse=True, return_counts=True)
    return n[inv]


def mean_losses(n_rows: int, row, word, before, pair, opens, in_target: np.ndarray, counts: np.ndarray, totals: np.ndarray, vocabulary: int, mixing: float = 0.7, alpha: float = 0.5):
    """Words, and mean loss per word (nats) under the target and the background, of each row; NaN without words.

    word, before and pair are places in counts (2 models x keys), opens the place of the opening; totals are the words of both models."""
    n = np.bincount(row, minlength=n_rows)
    c_word, c_pair = own_counts(row, word), own_counts(row, pair)
    c_before = np.zeros(len(row), np.int64)  # how often the text has the word before, as a word
    if len(row):
        c_before[1:] = c_word[:-1]
        c_before[before == opens] = 1
    loss = []
    for m in (1, 0):
        own = in_target[row] if m else np.ones(len(row), bool)
        size = np.maximum(totals[m] - own * n[row], 0)
        scale = np.ones(len(row)) if m else np.minimum(totals[1] / np.maximum(totals[0], 1), 1.0) if totals[1] else np.ones(len(row))
        a = np.maximum(counts[m, word] - own * c_word, 0) * scale
        c = np.maximum(counts[m, before] - own * c_before, 0) * scale
        b = np.minimum(np.maximum(counts[m, pair] - own * c_pair, 0) * scale, c)
        flat = (a + alpha) / (size * scale + alpha * vocabulary)
        lam = mixing * c / (c + 1.0)
        p = lam * b / np.maximum(c, 1e-12) + (1 - lam) * flat
        with np.errstate(invalid="ignore", divide="ignore"):
            loss.append(np.bincount(row, -np.log(p), n_rows) / n)
    return n, loss[0], loss[1]


def places(array, bits: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Rows of the words of some texts, their distinct keys in order, and the places in these of each word, the one before, each bigram and of the opening."""
    row, word, before, pair = tokens(array, bits)
    u, inv = np.unique(np.concatenate([word, pair, [opening(bits)]]), return_inverse=True)
    n, opens = len(row), int(inv[-1])
    prior = np.concatenate([[opens], inv[: n - 1]]) if n else inv[:0]
    return row, u, (inv[:n], np.where(before == opening(bits), opens, prior), inv[n:-1], opens)


def pack_texts(array) -> bytes:
    """The texts of an Arrow string array, compressed; null counts as empty."""
    sizes = pc.binary_length(array).fill_null(0).to_numpy(zero_copy_only=False).astype("<i4")
    return zlib.compress(sizes.tobytes() + b"".join(x.encode() for x in array.to_pylist() if x), 1)


def unpack_texts(raw: bytes, n: int) -> pa.Array:
    raw = zlib.decompress(raw)
    off = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<i4", n))]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(off), pa.py_buffer(raw[4 * n :])])


def chunked(parts: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """A row for every chunk of texts: these, whether they are in the target, the distinct words and the numbers of words (all, target)."""
    schema = pa.schema([("chunk", pa.string()), ("ids", pa.list_(pa.int64())), ("t", pa.list_(pa.bool_())), ("text", pa.binary()), ("words", pa.binary()), ("n0", pa.int64()), ("n1", pa.int64())])
    for part in parts:
        text, t = part.column("text"), part.column("t").to_numpy(zero_copy_only=False).astype(bool)
        for a, b in text_chunks(text, CHUNK):
            some = text.slice(a, b - a)
            row, word, _, _ = tokens(some, bits)
            rows = {"chunk": uuid.uuid4().hex, "ids": part.column("doc_id").slice(a, b - a).to_pylist(), "t": t[a:b].tolist(), "text": pack_texts(some), "words": pack_keys(np.unique(word)), "n0": len(row), "n1": int(t[a:b][row].sum())}
            yield pa.RecordBatch.from_pylist([rows], schema)


def pieces(parts: Iterator[pa.RecordBatch], n_ranges: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Keys and counts (all, target) of chunks, a row for every range that a chunk meets."""
    for part in parts:
        for k in range(part.num_rows):
            name, t = part.column("chunk")[k].as_py(), part.column("t")[k].values.to_numpy(zero_copy_only=False)
            row, u, (word, before, pair, opens) = places(unpack_texts(part.column("text")[k].as_py(), len(t)), bits)
            on = t[row]
            firsts = before == opens
            at = np.concatenate([word, np.full(int(firsts.sum()), opens), pair])
            sums = np.stack([np.bincount(at, minlength=len(u)), np.bincount(at[np.concatenate([on, on[firsts], on])], minlength=len(u))])
            of = ranges(u, n_ranges, bits)
            first = np.flatnonzero(np.diff(of, prepend=-1))
            ends = zip(first, [*first[1:], len(u)], strict=True)
            rows = [(name, int(of[i]), pack_keys(u[i:j]), squeeze(sums[:, i:j])) for i, j in ends]
            kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, q) for c, q in zip(zip(*rows, strict=True), kinds, strict=True)], ["chunk", "range", "keys", "data"])


def answer(p: pd.DataFrame) -> pd.DataFrame:
    """The pieces of one range with the totals of their keys in place of their counts."""
    keys = [unpack_keys(k) for k in p["keys"]]
    u, inv = np.unique(np.concatenate(keys), return_inverse=True)
    total, at = np.zeros((2, len(u)), np.int64), np.cumsum([0, *map(len, keys)])
    for k, raw in enumerate(p["data"]):
        total[:, inv[at[k] : at[k + 1]]] += spread(raw)  # a piece has each key once
    return pd.DataFrame({"chunk": p["chunk"], "range": p["range"], "data": [squeeze(total[:, inv[at[k] : at[k + 1]]]) for k in range(len(keys))]})


def word_keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for raw in part.column("words").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(unpack_keys(raw))], ["key"])


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background and ce_diff (target less background: the lower, the more like the target).

    target has doc_id, without repeats. Its ids are broadcast only after they were counted."""
    n_ids = target.count()
    ids = target.select(F.col("doc_id").alias("_t"))
    side = F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids
    flagged = docs.select("doc_id", "text").join(side, F.col("doc_id") == F.col("_t"), "left").select("doc_id", "text", F.col("_t").isNotNull().cast("int").alias("t"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits, n_ranges = hash_bits(size), min((1 << 31) - 1, size // RANGE + 1)
    with scratch(docs.sparkSession) as keep:
        met = keep(flagged.mapInArrow(lambda parts: chunked(parts, bits), CHUNKS))
        sums = met.agg(F.coalesce(F.sum("n0"), F.lit(0)).alias("n0"), F.coalesce(F.sum("n1"), F.lit(0)).alias("n1")).first()
        totals = np.array([sums["n0"], sums["n1"]], float)
        vocabulary = max(1, met.select("words").mapInArrow(word_keys, "key long").distinct().count())

        def finish(p: pa.Table) -> pa.Table:
            p = p.sort_by("range")
            ids, t = (p.column(c)[0].values for c in ("ids", "t"))
            row, u, at = places(unpack_texts(p.column("text")[0].as_py(), len(ids)), bits)
            counts = np.concatenate([spread(raw) for raw in p.column("data").to_pylist()[1:]], axis=1)
            n, lt, lb = mean_losses(len(ids), row, *at, t.to_numpy(zero_copy_only=False).astype(bool), counts, totals, vocabulary)
            none = n == 0
            return pa.table([ids, pa.array(n.astype(np.int64)), pa.array(lt, mask=none), pa.array(lb, mask=none)], ["doc_id", "n_tokens", "loss_target", "loss_background"])

        sent = met.select("chunk", "t", "text").mapInArrow(lambda parts: pieces(parts, n_ranges, bits), PIECES)
        answers = sent.groupBy("range").applyInPandas(answer, "chunk string, range int, data binary")
        heads = met.select("chunk", F.lit(-1).alias("range"), "ids", "t", "text")
        got = cut(heads.unionByName(answers, allowMissingColumns=True).groupBy("chunk").applyInArrow(finish, OUT))
    return got.withColumn("ce_diff", F.col("loss_target") - F.col("loss_background"))


def good_ids(labels: DataFrame) -> DataFrame:
    """Documents that no label calls poor or toxic and at least one calls good."""
    worst = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.coalesce(F.max("toxic"), F.lit(0)).alias("t"))
    return worst.where("q = 1 and t = 0").select("doc_id")


def op4(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, good_ids(labels))
