"""Sample files as a Spark data source: a partition for every stretch of a file, and only the channels that are asked for.

``spark.read.format("pulsewave").option("path", folder).load()`` reads WFDB records (any number
of ``.dat`` files each, in formats 8, 16, 24, 32, 61, 80, 160, 212, 310 and 311, with
several samples a frame and byte offsets) and ``.npy`` arrays.  Headers are read
while the query is planned; samples are read by tasks, ``samples`` at most each, through
``pyarrow.fs`` (local paths and the stores that it knows).  ``channels`` ("0,2") keeps some
channels, whose stretches alone are decoded to rows; files without any of them aren't opened.
``write_wfdb`` writes records of format 16, one a recording.

Defined cases.  A sample that stands for "invalid" is NULL, as are NaN and
infinities.  Format 8 stores differences, so its files are read by one task each.
A file that can't be read gives a row with a ``message``; so does a header.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..runtime import ship

SCHEMA = "recording_id string, channel int, channel_name string, idx long, t double, v double, message string"
ARROW = pa.schema([("recording_id", pa.string()), ("channel", pa.int32()), ("channel_name", pa.string()), ("idx", pa.int64()), ("t", pa.float64()), ("v", pa.float64()), ("message", pa.string())])

#: Fixed values of the WFDB signal formats: samples and bytes of their smallest group, and the value that stands for an invalid sample.
FORMATS = {8: (1, 1, None), 16: (1, 2, -(1 << 15)), 24: (1, 3, -(1 << 23)), 32: (1, 4, -(1 << 31)), 61: (1, 2, -(1 << 15)), 80: (1, 1, -(1 << 7)), 160: (1, 2, -(1 << 15)), 212: (2, 3, -(1 << 11)), 310: (3, 4, -(1 << 9)), 311: (3, 4, -(1 << 9))}


def _signed(x: np.ndarray, bits: int) -> np.ndarray:
    return np.where(x >= 1 << (bits - 1), x - (1 << bits), x)


def decode(kind: int, raw: bytes) -> np.ndarray:
    """Samples of whole groups of a format; of format 8 their differences."""
    group = FORMATS[kind][1]
    b = np.frombuffer(raw[: len(raw) // group * group], np.uint8)
    if kind == 8:
        return b.view(np.int8).astype(np.int64)
    if kind in (16, 61):
        return np.frombuffer(b.tobytes(), "<i2" if kind == 16 else ">i2").astype(np.int64)
    if kind == 32:
        return np.frombuffer(b.tobytes(), "<i4").astype(np.int64)
    x = b.astype(np.int64).reshape(-1, group)
    if kind == 24:
        return _signed(x[:, 0] | x[:, 1] << 8 | x[:, 2] << 16, 24)
    if kind == 80:
        return x[:, 0] - 128
    if kind == 160:
        return (x[:, 0] | x[:, 1] << 8) - 32768
    if kind == 212:
        return _signed(np.stack([x[:, 0] | (x[:, 1] & 15) << 8, x[:, 2] | (x[:, 1] >> 4) << 8], 1).ravel(), 12)
    low, high = x[:, 0] | x[:, 1] << 8, x[:, 2] | x[:, 3] << 8
    if kind == 310:  # the third sample lies in the upper five bits of both words
        three = [low >> 1 & 1023, high >> 1 & 1023, low >> 11 | high >> 11 << 5]
    else:
        word = low | high << 16
        three = [word & 1023, word >> 10 & 1023, word >> 20 & 1023]
    return _signed(np.stack(three, 1).ravel(), 10)


@dataclass
class Channel:
    number: int
    name: str
    gain: float
    zero: float
    frame: int  # samples in a frame
    first: int  # the value before the first difference, in format 8


@dataclass
class Stretch(InputPartition):
    """A stretch of a file: ``count`` frames from ``start`` on (of an array: rows)."""

    record: str
    path: str
    kind: int | str
    fs: float | None
    offset: int
    start: int
    count: int
    channels: list[Channel]
    wanted: frozenset[int] | None = None
    message: str | None = None


def parse_header(text: str) -> tuple[float, int | None, list[tuple[str, int, int, Channel]]]:
    """Rate, frames (if said) and, for each signal, file, format, byte offset and channel."""
    lines = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
    top = lines[0].split()
    if "/" in top[0]:
        raise ValueError("records of several segments are not understood")
    count, rate = int(top[1]), float(re.match(r"[\d.]+", top[2])[0]) if len(top) > 2 else 250.0
    frames = int(top[3]) if len(top) > 3 and int(top[3]) > 0 else None
    out = []
    for k, spec in enumerate(x.split() for x in lines[1 : 1 + count]):
        m = re.fullmatch(r"(\d+)(?:x(\d+))?(?::\d+)?(?:\+(\d+))?", spec[1])
        if not m or int(m[1]) not in FORMATS:
            raise ValueError(f"format {spec[1]} is not understood")
        g = re.match(r"([-\d.eE+]+)(?:\(([-\d]+)\))?", spec[2]) if len(spec) > 2 else None
        zero = int(g[2]) if g and g[2] else int(spec[4]) if len(spec) > 4 else 0
        own = Channel(k, " ".join(spec[8:]) or f"Ch{k}", float(g[1]) if g and float(g[1]) else 200.0, zero, int(m[2] or 1), int(spec[5]) if len(spec) > 5 else 0)
        out.append((spec[0], int(m[1]), int(m[3] or 0), own))
    if len(out) < count:
        raise ValueError(f"{len(out)} of {count} signals are described")
    return rate, frames, out


def _store(path: str):
    path = re.sub(r"^file:/(?!/)", "file:///", path)
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class WaveReader(DataSourceReader):
    def __init__(self, path: str, samples: int, wanted: frozenset[int] | None):
        self.path, self.samples, self.wanted = path, samples, wanted
        self.scheme = path.split("://")[0] + "://" if "://" in path else ""

    def partitions(self) -> list[Stretch]:
        store, folder = _store(self.path)
        info = store.get_file_info(folder)
        files = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(folder, recursive=True))
        out: list[Stretch] = []
        for f in sorted(files, key=lambda x: x.path):
            try:
                if f.path.endswith(".hea"):
                    out += self.record(store, f.path)
                elif f.path.endswith(".npy"):
                    out += self.array(store, f.path)
            except Exception as e:  # one bad file must not end the job
                out.append(Stretch(f.path, f.path, "none", None, 0, 0, 0, [], None, str(e)))
        return out or [Stretch("", "", "empty", None, 0, 0, 0, [])]

    def record(self, store, path: str) -> list[Stretch]:
        with store.open_input_file(path) as f:
            rate, frames, signals = parse_header(f.read().decode("utf-8", "replace"))
        groups: dict[str, list] = {}
        for name, kind, offset, channel in signals:
            groups.setdefault(name, []).append((kind, offset, channel))
        out = []
        for name, own in groups.items():
            if self.wanted is not None and not any(c.number in self.wanted for *_, c in own):
                continue
            if len({k for k, *_ in own}) > 1:
                raise ValueError("formats differ within a file")
            kind, offset = own[0][0], own[0][1]
            data = path.rsplit("/", 1)[0] + "/" + name if "/" in path else name
            size = store.get_file_info(data).size
            if size is None:
                raise ValueError(f"{name} is missing")
            width = sum(c.frame for *_, c in own)
            many, group, _ = FORMATS[kind]
            there = (size - offset) // group * many // width
            there = there if frames is None else min(there, frames)
            step = there if kind == 8 else max(1, self.samples // (width * many)) * many  # whole groups of bytes
            out += [Stretch(path[:-4], data, kind, rate, offset, a, min(step, there - a), [c for *_, c in own], self.wanted) for a in range(0, there, max(1, step))]
        return out

    def array(self, store, path: str) -> list[Stretch]:
        with store.open_input_file(path) as f:
            version = np.lib.format.read_magic(f)
            shape, columns, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            offset = f.tell()
        if len(shape) not in (1, 2) or dtype.hasobject:
            raise ValueError(f"{len(shape)} dimensions of {dtype}; 1 or 2 of numbers are understood")
        wide = shape[1] if len(shape) == 2 else 1
        step = max(1, self.samples // max(1, wide))
        names = [Channel(k, f"Ch{k}", 1.0, 0.0, 1, 0) for k in range(wide)]
        layout = f"{dtype.str}|{'F' if columns and wide > 1 else 'C'}|{shape[0]}"
        return [Stretch(path, path, layout, None, offset, a, min(step, shape[0] - a), names, self.wanted) for a in range(0, shape[0], step)]

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        if part.kind == "empty":
            return
        if part.message is None:
            try:
                store, _ = _store(self.path)
                with store.open_input_file(part.path) as f:
                    yield from self.rows(part, f)
                return
            except Exception as e:  # what has been given stays
                part.message = str(e)
        yield pa.RecordBatch.from_pylist([{"recording_id": part.record, "message": part.message}], schema=ARROW)

    def rows(self, part: Stretch, f) -> Iterator[pa.RecordBatch]:
        wanted = [c for c in part.channels if part.wanted is None or c.number in part.wanted]
        if isinstance(part.kind, str):
            dtype, order, length = part.kind.split("|")
            dtype, length, wide = np.dtype(dtype), int(length), len(part.channels)
            if order == "C":
                f.seek(part.offset + part.start * wide * dtype.itemsize)
                x = np.frombuffer(f.read(part.count * wide * dtype.itemsize), dtype).reshape(-1, wide)
            for c in wanted:
                if order == "F":
                    f.seek(part.offset + (c.number * length + part.start) * dtype.itemsize)
                    v = np.frombuffer(f.read(part.count * dtype.itemsize), dtype).astype(float)
                else:
                    v = x[:, c.number].astype(float)
                yield from self.batches(part, c, part.start, v)
            return
        many, group, invalid = FORMATS[part.kind]
        width = sum(c.frame for c in part.channels)
        f.seek(part.offset + part.start * width // many * group)
        flat = decode(part.kind, f.read(-(-part.count * width // many) * group))[: part.count * width].reshape(-1, width)
        at = 0
        for c in part.channels:
            own = flat[:, at : at + c.frame].ravel()
            at += c.frame
            if c in wanted:
                own = np.cumsum(own) + c.first if part.kind == 8 else own
                v = (own - c.zero) / c.gain
                yield from self.batches(part, c, part.start * c.frame, v if invalid is None else np.where(own == invalid, np.nan, v))

    def batches(self, part: Stretch, c: Channel, first: int, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(v), 1 << 16):
            x = v[a : a + (1 << 16)]
            idx = np.arange(first + a, first + a + len(x))
            t = pa.array(idx / (part.fs * c.frame)) if part.fs else pa.nulls(len(x), pa.float64())
            same = lambda s, n=len(x): pa.repeat(pa.scalar(s, pa.string()), n)
            yield pa.RecordBatch.from_arrays([same(part.record), pa.array(np.full(len(x), c.number, np.int32)), same(c.name), pa.array(idx), t, pa.array(x, mask=~np.isfinite(x)), pa.nulls(len(x), pa.string())], schema=ARROW)


class WaveFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pulsewave"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WaveReader:
        channels = self.options.get("channels")
        return WaveReader(self.options["path"], int(self.options.get("samples", 1 << 20)), None if channels is None else frozenset(int(c) for c in channels.split(",") if c.strip()))


def read(spark: SparkSession, path: str, channels: list[int] | None = None, samples: int = 1 << 20) -> DataFrame:
    """``recording_id, channel, channel_name, idx, t, v, message`` of all records and arrays under ``path``."""
    ship(spark)
    spark.dataSource.register(WaveFiles)
    reader = spark.read.format("pulsewave").option("path", path).option("samples", str(samples))
    return (reader if channels is None else reader.option("channels", ",".join(map(str, channels)))).load()


def write_wfdb(signal: DataFrame, folder: str, fs: float, gain: float = 200.0) -> int:
    """``signal(recording_id, idx, v)`` as records of format 16 in ``folder``, a header and a file each; how many there are. What isn't finite or goes beyond 16 bits is invalid."""
    ship(signal.sparkSession)

    def put(t: pa.Table) -> pa.Table:
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        name = t["recording_id"][0].as_py()
        t = t.sort_by("idx")
        v = np.rint(t["v"].fill_null(np.nan).to_numpy() * gain)
        raw = np.where(np.abs(v) < 1 << 15, v, -(1 << 15)).astype("<i2")  # NaN compares false
        safe = re.sub(r"[^\w.-]", "_", name)
        with store.open_output_stream(f"{at}/{safe}.dat") as f:
            f.write(raw.tobytes())
        with store.open_output_stream(f"{at}/{safe}.hea") as f:
            f.write(f"{safe} 1 {fs:g} {len(raw)}\n{safe}.dat 16 {gain:g}(0)/mV 16 0 0 0 0 ecg\n".encode())
        return pa.table({"n": [len(raw)]})

    return signal.select("recording_id", "idx", "v").groupBy("recording_id").applyInArrow(put, "n long").count()
