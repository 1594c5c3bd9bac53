"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A piece of length r is in class j = capacity // r, that is r lies in (capacity / (j+1), capacity / j],
and a bin of class j takes exactly j pieces. Workers fill bins independently: a task reads its
documents, tokenises them, and keeps one open bin a class; nothing is shuffled. Documents longer than
the capacity are cut into full pieces and a rest. A rest that would leave more than a 1/SLACK of its
bin unused is cut once more at the next class's length, so padding stays below a 1/SLACK of a bin.

A class's last bin in a task, if not full, is left over: at most j - 1 pieces for each of about
2 * sqrt(capacity) classes, a bound that does not depend on the corpus. Left-over pieces of GROUP
workers meet in one group that fills bins in the same way, and so on up a tree; the pieces left over at
its root, as many as one worker leaves at most, fill sequences by first fit, longest first.

A sequence's length is its last piece's offset + length; it is padded to the capacity unless that
length is a power of two. A sequence_id names the level of the tree, the worker there and its bin.
Within a task sequences follow the order of the rows.

Defined cases: null text counts as empty and gives the closing id alone; repeated rows are packed
each; extra columns are ignored; an empty table gives an empty result. Texts that spell one of the
tokenizer's special tokens get that token's id, as the tokenizer itself does."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hold, small_batches, text_chunks

#: Parts of texts whose ids a worker remembers, and the longest of them in characters.
CACHE_PARTS, KEPT = 400_000, 48
CHUNK = 1 << 21
SLACK, GROUP = 64, 64
MARK = "\x01"
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
ROWS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker long, bin long, offset long, place long"

# The rules of the vocabulary file whose texts may be cut into parts that are encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _kinds() -> np.ndarray:
    """Of the bytes of lower-cased plain texts: 0 white space, 1 letter, 2 digit, 3 other."""
    k = np.full(256, 3, np.uint8)
    k[[*range(9, 14), 32]] = 0
    k[ord("a") : ord("z") + 1] = 1
    k[0x80:] = 1
    k[ord("0") : ord("9") + 1] = 2
    return k


_KIND = _kinds()
#: Bytes that plain texts may hold: white space, printable ASCII, and 0xC3 with what follows it, looked at apart.
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(9, 14), *range(32, 127), 0xC3]] = True


def _bytes(text: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, pa.Buffer]:
    """The bytes of these texts, where each begins (and the last ends), and the buffer of the bytes."""
    _, off, data = text.buffers()
    off = np.frombuffer(off, np.int64)[text.offset : text.offset + len(text) + 1]
    if off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0], pa.py_buffer(b"")
    data = data.slice(int(off[0]), int(off[-1] - off[0]))
    return np.frombuffer(data, np.uint8), off - off[0], data


def plain_rows(d: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts hold only white space and printable characters of ASCII, and letters from U+00C0 to U+00FF."""
    bad = ~_PLAIN[d]
    after = np.flatnonzero(d[:-1] == 0xC3) + 1
    bad[after] = (d[after] == 0x97) | (d[after] == 0xB7)  # the two signs among the letters
    out = np.ones(len(off) - 1, bool)
    out[np.searchsorted(off, np.flatnonzero(bad), "right") - 1] = False
    return out


def part_edges(d: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the parts of lower-cased plain texts begin, and the end. White space goes with the part behind it."""
    k = _KIND[d]
    first = np.zeros(len(d) + 4, bool)
    first[off] = True
    edge = first[: len(d) + 1].copy()
    edge[0] = edge[-1] = True
    edge[1:-1] |= (k[:-1] != 0) & ((k[1:] != k[:-1]) | (k[1:] == 2))
    p = np.flatnonzero(d == ord("'"))
    p = p[first[p] | (k[np.maximum(p - 1, 0)] != 3)]
    p = p[~first[p + 1]]
    if len(p):  # an apostrophe that opens a part, with the letters that the pattern lets it take
        more = np.concatenate([d, np.zeros(3, np.uint8)])
        a, b = more[p + 1], more[p + 2]
        one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
        two = ~first[p + 2] & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        edge[p[one | two] + 1] = False
        edge[p[one] + 2] = True
        edge[p[two] + 3] = True
    return np.flatnonzero(edge)


def blank_edges(d: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the runs without blanks of these texts begin, and the end. Blanks go with the run behind them."""
    blank = (d == 0x20) | (d == 0x0A)
    edge = np.zeros(len(d) + 1, bool)
    edge[off] = edge[0] = edge[-1] = True
    edge[1:-1] |= blank[1:] & ~blank[:-1]
    return np.flatnonzero(edge)


class Memory:
    """Ids of parts: part number i has ids flat[start[i] : start[i] + size[i]]. Once it holds too many, those not used lately go."""

    def __init__(self, most: int):
        self.most, self.number = most, {}
        self.flat, self.start, self.size, self.used = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, parts: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        n = len(self.number)
        self.number.update(zip(parts, range(n, n + len(parts)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
        self.used = np.concatenate([self.used, np.ones(len(parts), bool)])

    def shrink(self) -> None:
        """Keeps short parts used since the last call, and none where these alone fill half of it."""
        if len(self.number) <= self.most and len(self.flat) <= 8 * self.most:
            return
        kept = [(p, i) for p, i in self.number.items() if self.used[i] and len(p) <= KEPT]
        if 2 * len(kept) > self.most:
            kept = []
        at = np.array([i for _, i in kept], np.int64)
        size = self.size[at]
        flat = self.flat[np.repeat(self.start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        self.__init__(self.most)
        self.add([p for p, _ in kept], flat, size)
        self.used[:] = False


class Encoder:
    """Token ids of texts.

    Texts of ASCII and Latin-1 letters need no normalising beyond lower case and are cut by the
    tokenizer's own pattern; other texts are cut at blanks only, over which the tokenizer never merges.
    A chunk's parts become a dictionary and indices in Arrow, so that only its distinct parts meet
    Python, and the ids of short ones are remembered. Texts that may hold a special token, and all texts
    of a tokenizer with other rules than those above, are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        rules = json.loads(self.tok.to_str())
        steps = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.special = [t["content"].lower() for t in rules["added_tokens"]]
        self.known_rules = (
            rules["normalizer"] == NORMALIZER and steps[0].get("pattern") == {"Regex": SPLIT} and steps[0].get("invert") is True
            and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
        )
        self.lean = Tokenizer.from_file(path)
        self.lean.normalizer = normalizers.Sequence([])
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.parts, self.words = Memory(CACHE_PARTS), Memory(CACHE_PARTS // 4)
        mark = self.lean.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    @staticmethod
    def of(path: str) -> Encoder:
        """The worker's own encoder: what it remembers outlives a task."""
        return hold(("encoder", path), lambda: Encoder(path))

    def _learn_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these parts one after the other, and how many each has."""
        if self.mark is not None:
            ids = np.array(self.lean.encode_batch_fast([f" {MARK} ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == self.mark)
            if len(at) == len(parts) - 1:
                return np.delete(ids, at), np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
        return self._learn_words(parts)

    def _learn_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in got for i in x], "<u4"), np.array([len(x) for x in got], np.int64)

    def _gather(self, data: pa.Buffer, off: np.ndarray, edges: np.ndarray, memory: Memory, learn) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and where each text's begin and the last's end."""
        parts = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), data).dictionary_encode()
        names = list(map(str.strip, parts.dictionary.to_pylist(), repeat(" \t\n\x0b\x0c\r")))
        memory.shrink()
        if "" not in memory.number:
            memory.add([""], np.zeros(0, "<u4"), np.zeros(1, np.int64))
        if new := [p for p in dict.fromkeys(names) if p not in memory.number]:
            memory.add(new, *learn(new))
        part = np.fromiter(map(memory.number.__getitem__, names), np.int64, len(names))
        memory.used[part] = True
        at = parts.indices.to_numpy()
        n = memory.size[part][at]
        ends = np.cumsum(n)
        pick = np.repeat(memory.start[part][at] - (ends - n), n)
        pick += np.arange(len(pick))
        return memory.flat[pick], np.concatenate([[0], ends])[np.searchsorted(edges, off)]

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all these texts (little-endian uint32) and where each text's begin and end among them; null counts as empty."""
        text = text.cast(pa.large_string()).fill_null("")
        whole = np.full(len(text), not self.known_rules)
        low = pc.utf8_lower(text)
        for s in self.special:
            whole |= pc.match_substring(low, s).to_numpy(zero_copy_only=False)
        d, off, _ = _bytes(text)
        plain = plain_rows(d, off) & ~whole
        flat, begin, end, n = [np.zeros(0, "<u4")], np.zeros(len(text), np.int64), np.zeros(len(text), np.int64), 0
        jobs = ((plain, low, part_edges, self.parts, self._learn_parts), (~plain & ~whole, text, blank_edges, self.words, self._learn_words))
        for on, source, edges, memory, learn in jobs:
            if on.any():
                d, off, data = _bytes(source if on.all() else source.filter(pa.array(on)))
                if len(d):
                    ids, ends = self._gather(data, off, edges(d, off), memory, learn)
                    flat.append(ids)
                    begin[on], end[on] = n + ends[:-1], n + ends[1:]
                    n += len(ids)
        for i in np.flatnonzero(whole):
            flat.append(np.array(self.tok.encode(text[int(i)].as_py(), add_special_tokens=False).ids, "<u4"))
            begin[i], end[i] = n, n + len(flat[-1])
            n += len(flat[-1])
        return np.ascontiguousarray(np.concatenate(flat), "<u4"), begin, end


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n ids, in order."""
    out, r, least = [capacity] * (n // capacity), n % capacity, capacity // SLACK
    if out and 0 < r < least:  # no crumb behind a full piece
        out[-1] -= least - r
        r = least
    while r:
        j = capacity // r
        if (capacity - j * r) * SLACK <= capacity:
            return [*out, r]
        k = capacity // (j + 1)
        rest = max(r - k, k // SLACK)
        out.append(r - rest)
        r = rest
    return out


class Bins:
    """One open bin a class; a bin leaves once it has as many pieces as its class says."""

    def __init__(self, capacity: int, worker: int):
        self.capacity, self.worker, self.full, self.open = capacity, worker, 0, {}

    def add(self, piece: tuple, out: list) -> None:
        """piece is a row of PIECE; out gets the rows of a bin that it fills."""
        j = self.capacity // piece[2]
        mine = self.open.setdefault(j, [])
        mine.append(piece)
        if len(mine) == j:
            self.close(mine, out)
            del self.open[j]

    def close(self, pieces: list, out: list) -> None:
        offset = 0
        for p in pieces:
            out.append((*p, self.worker, self.full, offset, None))
            offset += p[2]
        self.full += 1

    def rest(self) -> list[tuple]:
        """The pieces in open bins, the longest classes first."""
        return [p for j in sorted(self.open) for p in self.open[j]]

    def leave(self, out: list) -> None:
        out.extend((*p, self.worker, None, None, i) for i, p in enumerate(self.rest()))

    def first_fit(self, out: list) -> None:
        """Closes all, longest pieces first, each in the first sequence with room."""
        some, room = [], np.zeros(0, np.int64)
        for p in sorted(self.rest(), key=lambda p: -p[2]):
            at = np.flatnonzero(room >= p[2])
            if len(at):
                k = int(at[0])
            else:
                k, room = len(some), np.append(room, self.capacity)
                some.append([])
            some[k].append(p)
            room[k] -= p[2]
        for pieces in some:
            self.close(pieces, out)


def fill(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """ROWS of doc_id and text: worker and bin of every piece, bin and offset null where the bin is not full."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64()) for c in (*PIECE, "worker", "bin", "offset", "place")])
        encoder, tail = Encoder.of(path), np.array([end_id], "<u4").tobytes()
        bins = Bins(capacity, TaskContext.get().partitionId())
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
        for part in parts:
            for a, b in text_chunks(part.column("text"), CHUNK):
                ids, begin, end = encoder.encode(part.column("text").slice(a, b - a))
                view, rows = memoryview(ids).cast("B"), []
                for doc_id, x, y in zip(part.column("doc_id").slice(a, b - a).to_pylist(), begin.tolist(), end.tolist(), strict=True):
                    n, at = y - x + 1, 0
                    for k in cut_lengths(n, capacity):
                        crc = zlib.crc32(view[4 * (x + at) : 4 * min(x + at + k, y)])
                        if at + k == n:
                            crc = zlib.crc32(tail, crc)
                        bins.add((doc_id, at, k, crc, n), rows)
                        at += k
                if rows:
                    yield batch(rows)
        rows = []
        bins.leave(rows)
        if rows:
            yield batch(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROWS)


def merge(left: DataFrame, capacity: int, last: bool) -> DataFrame:
    """ROWS of left-over pieces after GROUP workers' have met; at the last level nothing is left over."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        bins, rows = Bins(capacity, key[0]), []
        p = p.sort_values(["worker", "place"], kind="stable")
        ids = [None if pd.isna(x) else int(x) for x in p["doc_id"]]
        for i, *rest in zip(ids, *[p[c].tolist() for c in PIECE[1:]], strict=True):
            bins.add((i, *rest), rows)
        bins.first_fit(rows) if last else bins.leave(rows)
        return pd.DataFrame(rows, columns=[*PIECE, "worker", "bin", "offset", "place"]).astype("Int64")

    return left.withColumn("_g", F.floor(F.col("worker") / GROUP).cast("long")).groupBy("_g").applyInPandas(run, ROWS)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """A row a piece of every document: PIECE, sequence_id and offset."""
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    spark = docs.sparkSession
    with small_batches(spark):
        rows = cut(fill(docs, path, capacity, end_id))
    out, level = [], 0
    while True:
        name = F.lit(level) * (1 << 60) + F.col("worker") * (1 << 32) + F.col("bin")
        out.append(rows.where("bin IS NOT NULL").select(*PIECE, name.alias("sequence_id"), "offset"))
        left = rows.where("bin IS NULL")
        most = left.agg(F.max("worker").alias("w")).first()["w"]
        if most is None:
            break
        rows, level = cut(merge(left, capacity, most < GROUP)), level + 1
    got = out[0]
    for x in out[1:]:
        got = got.unionByName(x)
    return got


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5(spark, docs: DataFrame) -> DataFrame:
    return pack(docs, tokenizer_path())
