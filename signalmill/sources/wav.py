"""WAV corpus ingest: files to ``tracks`` metadata and ``blocks`` of samples, as a batch job or a data source.

Files are listed by Spark and read by ranges through the file system that their address names, so a file may be of any
size and no task reads more of it than its blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

BLOCKS_SCHEMA = "track_id string, block_ix bigint, start_frame bigint, n int, ch array<array<float>>, is_last boolean"
HEADER_SCHEMA = (
    "track_id string, sample_rate int, channels int, frames bigint, bit_depth int, sample_format string, "
    "data_offset bigint, status string, error string")
HEADER_ARROW = pa.schema([
    ("track_id", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("frames", pa.int64()), ("bit_depth", pa.int32()),
    ("sample_format", pa.string()), ("data_offset", pa.int64()), ("status", pa.string()), ("error", pa.string())])
BLOCK = 65536
#: samples that a task gives back at once
SAMPLES = 1 << 20


def parse_header(source, size: int) -> dict:
    """Format and data position of a RIFF/WAVE file of ``size`` bytes.

    ``source`` is the file's bytes or ``read(at, n)``. Chunks are stepped over by their lengths, however long they are; in
    an RF64 file the ``ds64`` chunk gives the length of the data.
    """
    read = source if callable(source) else lambda at, n: bytes(source[at: at + n])
    head = read(0, 12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, fmt, long_data = 12, None, None
    while at + 8 <= size:
        head = read(at, 48)
        name, length = head[:4], struct.unpack("<I", head[4:8])[0]
        if name == b"ds64":
            long_data = struct.unpack("<Q", head[16:24])[0]
        elif name == b"fmt ":
            code, channels, rate, _, align, bits = struct.unpack("<HHIIHH", head[8:24])
            if code == 0xFFFE and length >= 40:
                code = struct.unpack("<H", head[32:34])[0]
            fmt = (code, channels, rate, align, bits)
        elif name == b"data":
            if fmt is None:
                raise ValueError("data before format")
            code, channels, rate, align, bits = fmt
            kind = {(1, 16): "pcm16", (1, 24): "pcm24", (1, 32): "pcm32", (3, 32): "float32", (3, 64): "float64"}.get((code, bits))
            if kind is None:
                raise ValueError(f"unsupported encoding {code}/{bits} bit")
            if align != channels * bits // 8 or channels < 1 or rate < 1:
                raise ValueError("inconsistent header")
            if length == 0xFFFFFFFF:
                length = size if long_data is None else long_data
            usable = min(length, size - at - 8)
            return dict(sample_rate=rate, channels=channels, frames=usable // align, bit_depth=bits, sample_format=kind,
                        data_offset=at + 8)
        at += 8 + length + (length & 1)
    raise ValueError("no data chunk")


def decode(raw: bytes, kind: str, channels: int) -> np.ndarray:
    """Bytes of whole frames to a (frames, channels) float array in -1..1."""
    if kind == "pcm16":
        x = np.frombuffer(raw, "<i2").astype(np.float32) / 32768.0
    elif kind == "pcm24":
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / 8388608.0
    elif kind == "pcm32":
        x = (np.frombuffer(raw, "<i4") / 2147483648.0).astype(np.float32)
    elif kind == "float32":
        x = np.frombuffer(raw, "<f4")
    else:
        x = np.frombuffer(raw, "<f8").astype(np.float32)
    return x.reshape(-1, channels)


def _arrays(path: str, read, size: int, block: int, first: int = 0, last: int | None = None) -> Iterator[tuple]:
    info = parse_header(read, size)
    width = info["channels"] * info["bit_depth"] // 8
    count = -(-info["frames"] // block)
    for ix in range(first, count if last is None else min(count, last)):
        n = min(block, info["frames"] - ix * block)
        x = decode(read(info["data_offset"] + ix * block * width, n * width), info["sample_format"], info["channels"])
        yield path, ix, ix * block, n, x, ix == count - 1


def _blocks(*args) -> Iterator[tuple]:
    """The same with a list of samples for each channel."""
    for path, ix, start, n, x, end in _arrays(*args):
        yield path, ix, start, n, [x[:, c].tolist() for c in range(x.shape[1])], end


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Blocks as one batch; their samples are never single objects."""
    path, ix, start, n, xs, end = zip(*rows)
    channels = [x.shape[1] for x in xs]
    inner = pa.ListArray.from_arrays(
        pa.array(np.cumsum([0, *np.repeat(n, channels)]), pa.int32()), pa.array(np.concatenate([x.T.ravel() for x in xs]).astype(np.float32)))
    outer = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *channels]), pa.int32()), inner)
    columns = dict(track_id=path, block_ix=ix, start_frame=start, n=n, ch=outer, is_last=end)
    return pa.RecordBatch.from_arrays([c if k == "ch" else pa.array(c, BLOCKS_ARROW.field(k).type) for k, c in columns.items()], schema=BLOCKS_ARROW)


class Ranges:
    """Byte ranges of a file on any file system with an address (local, HDFS, object stores)."""

    def __init__(self, address: str):
        from pyarrow import fs

        if address.startswith("file:/") and not address.startswith("file://"):
            address = "file://" + address[5:]
        if "://" in address:
            self.system, self.path = fs.FileSystem.from_uri(address.replace(" ", "%20"))
        else:
            self.system, self.path = fs.LocalFileSystem(), address

    def __enter__(self):
        self.file = self.system.open_input_file(self.path)
        return self

    def __exit__(self, *_):
        self.file.close()

    def size(self) -> int:
        return self.file.size()

    def __call__(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at) if at < self.file.size() else b""


def list_files(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """``path, length`` of the files below a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length")


def read_tracks(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """Header facts per file; unreadable files stay in the table with ``status`` error and the reason."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with Ranges(p) as read:
                        rows.append({"track_id": p, **parse_header(read, size), "status": "ok"})
                except (ValueError, OSError, struct.error) as e:
                    rows.append({"track_id": p, "status": "error", "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=HEADER_ARROW)

    return list_files(spark, path, glob).mapInArrow(facts, HEADER_SCHEMA)


BLOCKS_ARROW = pa.schema([
    ("track_id", pa.string()), ("block_ix", pa.int64()), ("start_frame", pa.int64()), ("n", pa.int32()),
    ("ch", pa.list_(pa.list_(pa.float32()))), ("is_last", pa.bool_())])


def read_blocks(tracks: DataFrame, block: int = BLOCK, per_task: int = 64, first: int = 0, last: int | None = None) -> DataFrame:
    """Blocks of the readable files of a tracks table, all or those from ``first`` up to before ``last``. A file is cut into
    ranges of ``per_task`` blocks that are dealt to tasks, each of which opens the file at its range."""
    count = F.ceil(F.col("frames") / F.lit(block)).cast("bigint")
    stop = count if last is None else F.least(count, F.lit(last))
    starts = F.when(stop > first, F.sequence(F.lit(first).cast("bigint"), stop - 1, F.lit(per_task).cast("bigint")))
    ranges = tracks.filter("status = 'ok'").select("track_id", F.explode(starts).alias("first"), stop.alias("stop")).repartition("track_id", "first")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, at, stop in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                with Ranges(p) as read:
                    for row in _blocks(p, read, read.size(), block, at, min(at + per_task, stop)):
                        yield pa.RecordBatch.from_pylist([dict(zip(BLOCKS_ARROW.names, row))], schema=BLOCKS_ARROW)

    return ranges.mapInArrow(cut, BLOCKS_SCHEMA)


def decode_files(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of all readable files in a table of ``path, content``; files are decoded where they lie.

    Blocks are given back many at a time, up to ``SAMPLES`` samples or one longer block.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not data.is_valid:
                    continue  # no file to read; before, a null stopped the job
                view = memoryview(data.as_buffer())
                try:
                    for row in _arrays(p, lambda at, n, v=view: bytes(v[at : at + n]), len(view), block):
                        held.append(row)
                        size += row[4].size
                        if size >= SAMPLES or len(held) >= 10_000:
                            yield _batch(held)
                            held, size = [], 0
                except (ValueError, struct.error):
                    continue  # reported in the tracks table
        if held:
            yield _batch(held)

    return files.select("path", "content").mapInArrow(cut, BLOCKS_SCHEMA)


def read_wav_corpus(spark: SparkSession, path: str, glob: str = "*.wav", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``tracks`` and ``blocks`` of all readable files below ``path``; files of any size are spread over tasks by ranges."""
    tracks = read_tracks(spark, path, glob)
    return tracks, read_blocks(tracks, block)


def blocks_to_samples(blocks: DataFrame) -> DataFrame:
    """Blocks of any number of channels to ``track_id, ch, frame_ix, x``."""
    rows = blocks.select("track_id", "start_frame", F.posexplode("ch").alias("ch", "_x"))
    return rows.select("track_id", "ch", "start_frame", F.posexplode("_x").alias("_i", "x")).select(
        "track_id", "ch", (F.col("start_frame") + F.col("_i")).alias("frame_ix"), F.col("x").cast("double").alias("x"))


def blocks_to_frames(blocks: DataFrame) -> DataFrame:
    """Stereo blocks to ``track_id, frame_ix, l, r`` (mono is used on both sides)."""
    ch = F.when(F.size("ch") >= 2, F.arrays_zip(F.get("ch", F.lit(0)).alias("l"), F.get("ch", F.lit(1)).alias("r"))).otherwise(
        F.arrays_zip(F.get("ch", F.lit(0)).alias("l"), F.get("ch", F.lit(0)).alias("r")))
    return blocks.select("track_id", "start_frame", F.posexplode(ch).alias("i", "s")).select(
        "track_id", (F.col("start_frame") + F.col("i")).alias("frame_ix"), F.col("s")["l"].cast("double").alias("l"),
        F.col("s")["r"].cast("double").alias("r"))


def probe(path: Column, channels: Column, sample_format: Column) -> dict[str, Column]:
    """Container from the extension, layout from the channel count, depth from the sample format."""
    ext = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    # fixed values
    containers = {"wav": (".wav", ".wave"), "aiff": (".aif", ".aiff"), "flac": (".flac",), "ogg": (".ogg",), "mp3": (".mp3",),
                  "aac_m4a": (".m4a", ".aac"), "opus": (".opus",)}
    layouts = {1: "mono", 2: "stereo", 3: "three_zero", 4: "quad", 5: "five_zero", 6: "five_one"}
    depths = {"pcm16": 16, "pcm24": 24, "pcm32": 32}

    def pick(col, table, default):
        out = None
        for key, value in table:
            out = F.when(col.isin(*key) if isinstance(key, tuple) else col == key, value) if out is None else out.when(
                col.isin(*key) if isinstance(key, tuple) else col == key, value)
        return out.otherwise(default)

    return {
        "container": pick(ext, [(v, k) for k, v in containers.items()], "unknown"),
        "layout": pick(channels, layouts.items(), "unknown"), "bit_depth": pick(sample_format, depths.items(), 0)}


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class WavDataSource(DataSource):
    """``spark.read.format("wav_blocks").load(path)``: block ranges of files on a shared folder, one partition each.

    With the option ``pushdown`` filters narrow the ranges; Spark asks for ``spark.sql.python.filterPushdown.enabled`` then.
    """

    @classmethod
    def name(cls):
        return "wav_blocks"

    def schema(self):
        return BLOCKS_SCHEMA

    def reader(self, schema):
        return (NarrowedWavReader if self.options.get("pushdown", "").lower() == "true" else WavReader)(self.options)


class WavReader(DataSourceReader):
    """Splits files into block ranges."""

    def __init__(self, options):
        self.path = options["path"]
        self.block = int(options.get("block", BLOCK))
        self.per_task = int(options.get("blocksPerTask", 256))
        self.first, self.last, self.tracks = 0, None, None

    def partitions(self):
        from pyarrow import fs

        top = Ranges(self.path)
        out = []
        for info in sorted(top.system.get_file_info(fs.FileSelector(top.path, recursive=True)), key=lambda i: i.path):
            if info.type != fs.FileType.File or not info.path.lower().endswith((".wav", ".wave")):
                continue
            # ids are what the reader was asked for: the same kind of address as the folder's
            name = info.path if "://" not in self.path else self.path.split("://")[0] + "://" + info.path
            if self.tracks is not None and name not in self.tracks:
                continue
            # the header tells the width of a frame; an unreadable file has no blocks
            try:
                with Ranges(name) as read:
                    frames = parse_header(read, info.size)["frames"]
            except (ValueError, OSError, struct.error):
                continue
            last = -(-frames // self.block)
            last = last if self.last is None else min(last, self.last)
            out += [_Range(name, i, min(i + self.per_task, last)) for i in range(self.first, last, self.per_task)]
        return out or [_Range("", 0, 0)]

    def read(self, part):
        if part.path:
            with Ranges(part.path) as read:
                yield from _blocks(part.path, read, read.size(), self.block, part.first, part.last)


class NarrowedWavReader(WavReader):
    """Comparisons of ``block_ix`` with numbers and of ``track_id`` with names narrow the ranges before they are planned, so
    other ranges are never opened."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else None
            if column == ("block_ix",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = f.value + (not isinstance(f, LessThan))
                    self.last = end if self.last is None else min(self.last, end)
            elif column == ("track_id",) and isinstance(f, (EqualTo, In)):
                names = set(f.value if isinstance(f, In) else [f.value])
                self.tracks = names if self.tracks is None else self.tracks & names
            else:
                yield f
