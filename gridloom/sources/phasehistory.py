"""Phase history files as a Spark data source: row ranges in parallel, strides pushed into the reads.

A file is that of the public compensated-phase-history standard, version 1.0: a text header with the
sizes and places of its blocks, an XML description, per-vector parameters and the signal array, all
big-endian. Of the signal array only the wanted columns of the wanted rows are read; of the header
nothing is trusted that the file's size contradicts.

    spark.dataSource.register(PhaseHistory)
    spark.read.format("phase_history").option("rows", "0:4096:2").option("cols", "100:900").option("pvp", "SC0,TxPos").load(path)"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The names of the signal's sample types, their bytes and their parts.
SAMPLES = {"CF8": ">f4", "CI4": ">i2", "CI2": ">i1"}
SCHEMA = "path string, row long, first_col int, col_step int, read_bytes long, re array<double>, im array<double>, pvp map<string, array<double>>"
HEAD, LINES = 1 << 16, 2048


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Scene(InputPartition):
    """What the header and the description of a file say, and the rows of it that one task reads."""

    path: str
    rows: int
    cols: int
    kind: str
    signal_at: int
    pvp_at: int
    pvp_bytes: int
    fields: tuple[tuple[str, int, int], ...]  # name, first word, words
    start: int = 0
    stop: int = 0
    step: int = 1


def header(path: str) -> Scene:
    """Reads a file's header and description; a file that is cut short or no such file is an error."""
    where, name = opened(path)
    size = where.get_file_info(name).size
    with where.open_input_file(name) as f:
        raw = f.read_at(min(HEAD, size), 0)
        first, _, rest = raw.partition(b"\n")
        if not first.startswith(b"CPHD/1.") or b"\f\n" not in rest:
            raise ValueError(f"{path} is no phase history file")
        told = dict(line.split(" := ", 1) for line in rest.partition(b"\f\n")[0].decode().splitlines() if " := " in line)
        n = {k: int(told[k]) for k in told if k.endswith(("_SIZE", "_OFFSET"))}
        for block in ("XML", "PVP", "SIGNAL"):
            if n[f"{block}_BLOCK_BYTE_OFFSET"] + n[f"{block}_BLOCK_SIZE"] > size:
                raise ValueError(f"{path} is cut short: its {block} block ends beyond its {size} bytes")
        xml = ET.fromstring(f.read_at(n["XML_BLOCK_SIZE"], n["XML_BLOCK_BYTE_OFFSET"]))
    for e in xml.iter():  # names without their namespace
        e.tag = e.tag.rpartition("}")[2]
    data, channel = xml.find("Data"), xml.find("Data/Channel")
    rows, cols, width, kind = int(channel.findtext("NumVectors")), int(channel.findtext("NumSamples")), int(data.findtext("NumBytesPVP")), data.findtext("SignalArrayFormat")
    if kind not in SAMPLES or rows * cols * 2 * np.dtype(SAMPLES[kind]).itemsize > n["SIGNAL_BLOCK_SIZE"] or rows * width > n["PVP_BLOCK_SIZE"]:
        raise ValueError(f"{path}: {rows} x {cols} samples of {kind} do not fit its blocks")
    fields = tuple((e.tag, int(e.findtext("Offset")), int(e.findtext("Size"))) for e in xml.find("PVP") if e.find("Offset") is not None)
    at = int(channel.findtext("SignalArrayByteOffset") or 0), int(channel.findtext("PVPArrayByteOffset") or 0)
    return Scene(path, rows, cols, kind, n["SIGNAL_BLOCK_BYTE_OFFSET"] + at[0], n["PVP_BLOCK_BYTE_OFFSET"] + at[1], width, fields)


def strided(text: str | None, n: int) -> range:
    """start:stop:step as a range within n; parts may be left out, the step is positive."""
    parts = [int(x) if x.strip() else None for x in (text or "").split(":")] if text else []
    if len(parts) == 1 or len(parts) > 3 or len(parts) == 3 and (parts[2] or 1) < 1:
        raise ValueError(f"{text} is no start:stop:step")
    return range(n)[slice(*parts)]


class PhaseHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "phase_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rows, self.cols = options["path"], options.get("rows"), options.get("cols")
        self.wanted = [x.strip() for x in options.get("pvp", "").split(",") if x.strip()]
        self.lines = int(options.get("lines", LINES))

    def partitions(self) -> list[InputPartition]:
        where, name = opened(self.path)
        info = where.get_file_info(name)
        uri = self.path.rstrip("/")
        files = [uri] if info.is_file else sorted(f"{uri}/{x.path[len(name.rstrip('/')) + 1 :]}" for x in where.get_file_info(fs.FileSelector(name, recursive=True)) if x.is_file and x.path.endswith(".cphd"))
        out = []
        for f in files:  # headers alone: a few kilobytes a file
            h = header(f)
            for missing in set(self.wanted) - {x[0] for x in h.fields}:
                raise ValueError(f"{f} has no parameter {missing}")
            rows = strided(self.rows, h.rows)
            for k in range(0, len(rows), self.lines):
                some = rows[k : k + self.lines]
                out.append(replace(h, start=some[0], stop=some[-1] + 1, step=rows.step))
        return out or [Scene("", 0, 0, "CI2", 0, 0, 0, ())]

    def read(self, p: Scene) -> Iterator[pa.RecordBatch]:
        if not p.rows:
            return
        where, name = opened(p.path)
        kind, cols = np.dtype(SAMPLES[p.kind]), strided(self.cols, p.cols)
        sample, out = 2 * kind.itemsize, []
        with where.open_input_file(name) as f:
            for row in range(p.start, p.stop, p.step):
                raw, read = b"", 0
                if len(cols):
                    read = (cols[-1] + 1 - cols[0]) * sample
                    raw = f.read_at(read, p.signal_at + (row * p.cols + cols[0]) * sample)
                    if len(raw) < read:
                        raise ValueError(f"{p.path} ended within row {row}")
                z = np.frombuffer(raw, kind).reshape(-1, 2)[:: cols.step].astype(float)
                words = np.frombuffer(f.read_at(p.pvp_bytes, p.pvp_at + row * p.pvp_bytes), ">f8") if self.wanted else []
                pvp = [(k, words[a : a + n].tolist()) for k, a, n in p.fields if k in self.wanted]
                out.append({"path": p.path, "row": row, "first_col": cols[0] if len(cols) else 0, "col_step": cols.step, "read_bytes": read, "re": z[:, 0], "im": z[:, 1], "pvp": pvp})
                if len(out) * max(1, len(cols)) >= 1 << 20:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)


def batch(rows: list[dict]) -> pa.RecordBatch:
    kind = pa.schema([("path", pa.string()), ("row", pa.int64()), ("first_col", pa.int32()), ("col_step", pa.int32()), ("read_bytes", pa.int64()),
                      ("re", pa.list_(pa.float64())), ("im", pa.list_(pa.float64())), ("pvp", pa.map_(pa.string(), pa.list_(pa.float64())))])
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in kind], schema=kind)


def encode(re: np.ndarray, im: np.ndarray, pvp: dict[str, np.ndarray], kind: str = "CI4") -> bytes:
    """A file of one channel from samples (rows x cols) and parameters (rows, or rows x words)."""
    rows, cols = re.shape
    fields, at, words = [], 0, []
    for name, v in pvp.items():
        v = np.asarray(v, float).reshape(rows, -1)
        fields.append(f"<{name}><Offset>{at}</Offset><Size>{v.shape[1]}</Size><Format>F8</Format></{name}>")
        at += v.shape[1]
        words.append(v)
    signal = np.stack([re, im], 2).astype(SAMPLES[kind]).tobytes()
    params = (np.concatenate(words, 1) if words else np.zeros((rows, 0))).astype(">f8").tobytes()
    xml = (
        f'<CPHD xmlns="http://api.nsgreg.nga.mil/schema/cphd/1.0.1"><Data><SignalArrayFormat>{kind}</SignalArrayFormat><NumBytesPVP>{8 * at}</NumBytesPVP><NumCPHDChannels>1</NumCPHDChannels>'
        f"<Channel><Identifier>1</Identifier><NumVectors>{rows}</NumVectors><NumSamples>{cols}</NumSamples><SignalArrayByteOffset>0</SignalArrayByteOffset>"
        f"<PVPArrayByteOffset>0</PVPArrayByteOffset></Channel></Data><PVP>{''.join(fields)}</PVP></CPHD>"
    ).encode()
    sizes = {"XML": len(xml), "PVP": len(params), "SIGNAL": len(signal)}
    start, out = 1024, {}
    for k, n in sizes.items():
        out[k], start = start, start + n
    head = "CPHD/1.0.1\n" + "".join(f"{k}_BLOCK_SIZE := {sizes[k]}\n{k}_BLOCK_BYTE_OFFSET := {out[k]}\n" for k in sizes) + "CLASSIFICATION := UNCLASSIFIED\nRELEASE_INFO := NONE\n\f\n"
    return head.encode().ljust(1024, b"\0") + xml + params + signal


def export(lines: DataFrame, folder: str, pvp: list[str], kind: str = "CI4") -> DataFrame:
    """Writes every scene of lines (scene, row, re, im, and one column a parameter) as a file, a task a scene; scene, path and n_bytes of these.

    A file is written whole under its own name, so a task that runs again writes the same."""

    def write(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        scene = t.column("scene")[0].as_py()
        raw = encode(*[np.array(t.column(c).to_pylist()) for c in ("re", "im")], {c: np.array(t.column(c).to_pylist()) for c in pvp}, kind)
        path = f"{folder}/scene_{scene:05d}.cphd"
        where, name = opened(path)
        where.create_dir(name.rpartition("/")[0], recursive=True)
        with where.open_output_stream(name) as f:
            f.write(raw)
        return pa.table({"scene": [scene], "path": [path], "n_bytes": [len(raw)]})

    return lines.select("scene", "row", "re", "im", *pvp).groupBy("scene").applyInArrow(write, "scene long, path string, n_bytes long")


def read(spark: SparkSession, path: str, rows: str = "::", cols: str = "::", pvp: list[str] = ()) -> DataFrame:
    """scene (from the file's name, null for another), row, re, im (arrays), pvp, read_bytes of the wanted part of the files below a path."""
    spark.dataSource.register(PhaseHistory)
    got = spark.read.format("phase_history").options(rows=rows, cols=cols, pvp=",".join(pvp)).load(path)
    return got.withColumn("scene", F.expr(r"try_cast(regexp_extract(path, 'scene_([0-9]+)\\.cphd$', 1) AS BIGINT)"))
