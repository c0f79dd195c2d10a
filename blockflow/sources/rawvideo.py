"""Raw video files as frames, and frames as raw video files: format "rawvideo".

    spark.dataSource.register(RawVideo)
    spark.read.format("rawvideo").option("width", 640).option("height", 480).load(path)

Options: width, height; pixel (i420, nv12, yuyv or uyvy; default i420); stride, chroma_stride (bytes from line to line; default:
no padding); partition_bytes (what a task reads, 128 MB by default, a frame at least). A frame is a fixed number of bytes, so
files are cut into ranges of whole frames that tasks read apart; a task holds one batch of frames.

A row: path, frame_idx (from 0 in each file), width, height, y, u, v. Planes have no padding; chroma planes have half the size,
rounded up; packed formats, which have chroma for each line, give the rounded mean of two lines.

Writing takes the same columns y, u, v (i420 only) and pads lines to the strides with their last sample. A task writes one file,
in the order of its rows. A file whose size is no whole number of frames is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader

from .files import Range, Staged, StagedWriter, listed, opened

SCHEMA = "path string, frame_idx bigint, width int, height int, y binary, u binary, v binary"
#: Bytes of frames in a batch.
BATCH = 8_000_000
_ARROW = pa.schema([("path", pa.string()), ("frame_idx", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("y", pa.binary()), ("u", pa.binary()), ("v", pa.binary())])


class Layout:
    """Where the samples of a frame lie."""

    def __init__(self, options: dict):
        get = lambda name, default: int(options.get(name, default))
        self.width, self.height, self.pixel = get("width", 0), get("height", 0), options.get("pixel", "i420").lower()
        if self.width < 1 or self.height < 1:
            raise ValueError("width and height must be positive")
        if self.pixel not in ("i420", "nv12", "yuyv", "uyvy"):
            raise ValueError(f"unknown pixel format {self.pixel}")
        self.half = (self.width + 1) // 2, (self.height + 1) // 2
        packed = self.pixel in ("yuyv", "uyvy")
        line = 4 * self.half[0] if packed else self.width
        self.stride = get("stride", line)
        side = 0 if packed else 2 * self.half[0] if self.pixel == "nv12" else self.half[0]
        self.chroma_stride = 0 if packed else get("chroma_stride", side)
        if self.stride < line or self.chroma_stride < side:
            raise ValueError("a stride is shorter than its line")
        self.luma = self.stride * self.height
        self.chroma = self.chroma_stride * self.half[1]
        self.size = self.luma + self.chroma * {"i420": 2, "nv12": 1}.get(self.pixel, 0)

    def planes(self, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, (cw, ch) = self.width, self.half
        top = frame[: self.luma].reshape(self.height, self.stride)
        if self.pixel in ("yuyv", "uyvy"):
            first = self.pixel == "uyvy"  # place of the first luma sample of a pair
            pair = top[:, : 4 * cw].reshape(self.height, cw, 4)
            luma = pair[:, :, first::2].reshape(self.height, 2 * cw)[:, :w]
            sides = [pair[:, :, k].astype(np.uint16) for k in ((0, 2) if first else (1, 3))]
            below = np.minimum(np.arange(ch) * 2 + 1, self.height - 1)  # an odd last line is alone
            return luma, *((s[::2] + s[below] + 1 >> 1).astype(np.uint8) for s in sides)
        rest = frame[self.luma :]
        if self.pixel == "nv12":
            both = rest.reshape(ch, self.chroma_stride)[:, : 2 * cw]
            return top[:, :w], both[:, ::2], both[:, 1::2]
        u, v = rest.reshape(2, ch, self.chroma_stride)[:, :, :cw]
        return top[:, :w], u, v

    def padded(self, y: bytes, u: bytes, v: bytes) -> Iterator[bytes]:
        for data, (w, h), stride in ((y, (self.width, self.height), self.stride), (u, self.half, self.chroma_stride), (v, self.half, self.chroma_stride)):
            if len(data) != w * h:
                raise ValueError(f"a plane of {len(data)} bytes is not {w} x {h}")
            yield data if stride == w else np.pad(np.frombuffer(data, np.uint8).reshape(h, w), ((0, 0), (0, stride - w)), mode="edge").tobytes()


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.layout, self.path = Layout(options), options["path"]
        self.each = max(1, int(options.get("partition_bytes", 1 << 27)) // self.layout.size)

    def partitions(self) -> list[Range]:
        out = []
        for path, size in listed(self.path):
            n, rest = divmod(size, self.layout.size)
            if rest:
                raise ValueError(f"{path} has {size} bytes, no whole number of frames of {self.layout.size}")
            out += [Range(path, at, min(n, at + self.each), size) for at in range(0, n, self.each)]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.start == part.stop:
            return
        frame, w, h = self.layout.size, self.layout.width, self.layout.height
        system, _ = opened(self.path)
        with system.open_input_file(part.path) as f:
            step = max(1, BATCH // frame)
            for at in range(part.start, part.stop, step):
                n = min(step, part.stop - at)
                data = np.frombuffer(f.read_at(n * frame, at * frame), np.uint8).reshape(n, frame)
                rows = [[p.tobytes() for p in self.layout.planes(x)] for x in data]
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(range(at, at + n), pa.int64()), pa.array([w] * n, pa.int32()), pa.array([h] * n, pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*rows))], schema=_ARROW)


class _Writer(StagedWriter, DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        self.layout = Layout(options)
        if self.layout.pixel != "i420":
            raise ValueError("only i420 is written")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        from pyspark import TaskContext

        path, files = self.new(".yuv"), []
        system, _ = opened(self.path)
        with system.open_output_stream(path) as f:
            for b in batches:
                for row in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in "yuv")):
                    for plane in self.layout.padded(*row):
                        f.write(plane)
                        files = files or [(f"part-{TaskContext.get().partitionId():05d}-{self.staging[-8:]}.yuv", path)]
        return Staged(files)


class RawVideo(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawvideo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)
