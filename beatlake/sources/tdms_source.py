"""TDMS files of any size as a Spark data source: `spark.read.format("tdms")`.

Planning reads lead-ins and meta data only, which say where each segment's
samples lie. Samples of the chosen channel are cut into chunks, chunks are
dealt to partitions of bounded size, and a task reads the bytes of its own
chunks: other channels' bytes are not read where they lie apart, nor chunks
outside the wanted time. So a file is as many tasks as its samples ask for,
and no task holds a file.

Options: `path` (a file or a folder, searched below, in any store that
pyarrow opens), `channel` (part of the name, `ekg` by default), `from_s` and
`to_s` (seconds from a file's first sample: chunks that meet that range are
returned whole), `chunk` and `part` (samples of a chunk, of a partition).
Rows are those of `binary.read_tdms`: path, channel, fs, start_us, chunk_idx,
start_sample, samples. A file without samples gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from beatlake.sources.binary import CHUNK, SIGNAL, chosen_channel, tdms_layout, values_at

PART = 1 << 22


@dataclass
class Chunk:
    """One chunk's number, first sample, and runs of values: byte, number, stride."""

    number: int
    first: int
    runs: list[tuple[int, int, int]]


@dataclass
class Part(InputPartition):
    path: str
    channel: str
    fs: float
    start_us: int | None
    kind: str
    chunks: list[Chunk]


def store_of(path: str) -> tuple[stores.FileSystem, str]:
    return stores.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (stores.LocalFileSystem(), path)


def files_below(path: str) -> Iterator[tuple[str, int]]:
    """Paths and sizes, in order of their names."""
    store, inner = store_of(path)
    info = store.get_file_info(inner)
    found = [info] if info.is_file else store.get_file_info(stores.FileSelector(inner, recursive=True))
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    for f in sorted(found, key=lambda f: f.path):
        if f.is_file and f.path.lower().endswith(".tdms"):
            yield prefix + f.path, f.size


def chunks_of(raws, size: int, rate: float, from_s: float | None, to_s: float | None) -> Iterator[tuple[str, Chunk]]:
    """The chunks of a channel's samples in order, each of `size` samples or what is left before the type of number changes."""
    number, first, runs, held, kind = 0, 0, [], 0, None

    def wanted() -> bool:
        return (to_s is None or first < to_s * rate) and (from_s is None or first + held > from_s * rate)

    for raw in raws:
        for block in range(raw.blocks):
            done = 0
            while done < raw.n:
                if runs and (held == size or raw.kind != kind):
                    if wanted():
                        yield kind, Chunk(number, first, runs)
                    number, first, runs, held = number + 1, first + held, [], 0
                kind, n = raw.kind, min(raw.n - done, size - held)
                runs.append((raw.at + block * raw.block + done * raw.stride, n, raw.stride))
                done, held = done + n, held + n
    if runs and wanted():
        yield kind, Chunk(number, first, runs)


class TdmsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.hint = options.get("channel", "ekg")
        self.chunk, self.part = int(options.get("chunk", CHUNK)), int(options.get("part", PART))
        self.span = [float(options[k]) if k in options else None for k in ("from_s", "to_s")]

    def partitions(self) -> list[Part]:
        out: list[Part] = []
        for path, size in files_below(self.path):
            store, inner = store_of(path)
            with store.open_input_file(inner) as f:
                props, found = tdms_layout(lambda at, n, f=f: f.read_at(n, at), size)
            if not found:
                continue
            chosen, name, rate, start = chosen_channel(props, list(found), self.hint)
            now: Part | None = None
            held = 0
            for kind, chunk in chunks_of(found[chosen], self.chunk, rate, *self.span):
                if now is None or kind != now.kind or held >= self.part:
                    now, held = Part(path, name, rate, start, kind, []), 0
                    out.append(now)
                now.chunks.append(chunk)
                held += sum(n for _, n, _ in chunk.runs)
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part is None:  # nothing is planned
            return
        store, inner = store_of(part.path)
        width = np.dtype(part.kind).itemsize
        with store.open_input_file(inner) as f:
            for chunk in part.chunks:
                x = np.concatenate([values_at(f.read_at((n - 1) * stride + width, at), part.kind, 0, n, stride) for at, n, stride in chunk.runs])
                samples = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
                columns = [pa.array([part.path]), pa.array([part.channel]), pa.array([part.fs]), pa.array([part.start_us], pa.int64()), pa.array([chunk.number], pa.int64()), pa.array([chunk.first], pa.int64()), samples]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in SIGNAL.split(", ")])


class TdmsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tdms"

    def schema(self) -> str:
        return SIGNAL

    def reader(self, schema) -> TdmsReader:
        return TdmsReader(dict(self.options))


def read_tdms_parts(spark: SparkSession, path: str, channel: str = "ekg", from_s: float | None = None, to_s: float | None = None, **options: int) -> DataFrame:
    """Chunks of the chosen channel of all TDMS files at or below `path`, read in as many tasks as they are long."""
    spark.dataSource.register(TdmsSource)
    given = {"channel": channel, "from_s": from_s, "to_s": to_s} | options
    return spark.read.format("tdms").options(**{k: v for k, v in given.items() if v is not None}).load(path)
