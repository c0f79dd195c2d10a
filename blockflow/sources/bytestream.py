"""H.264 byte streams as units, and access units as files: formats "annexb" and "mp4".

    spark.dataSource.register(ByteStream)
    spark.read.format("annexb").load(path)

Reading. A row is a unit: path, offset (of its header), code_length (of its start code, 3 or 4), length, ref_idc, type (0 to 31), forbidden (the
first bit), payload (behind the header, emulation prevention included). Files are cut into ranges of partition_bytes (64 MB by default); a task
gives the units whose start code begins in its range, and reads on behind it to the end of the last one. Chunks are scanned
with the three bytes before them, so a code that lies across a border is found once. A zero byte before a start code belongs
to the code. A code directly behind another one makes no unit; bytes before the first code are none either.

Writing. Rows are access units with a stream and an order: stream_id, seq, unit (binary, with start codes), for "mp4" also ticks (of 90 kHz), width,
height. Rows of a stream must be together and in order, as save_streams() brings them; each stream becomes one file, written
by one task as its rows come. Movie files hold the type box, the media data with lengths in place of start codes, without parameter sets and
delimiters, and the movie box; which samples are synchronisation points is read from the units. Media data is staged first, for its size
stands before it; over 4 GB the sizes become 64-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader

from . import movie
from .files import Range, Staged, StagedWriter, listed, opened

SCHEMA = "path string, offset bigint, code_length int, length bigint, ref_idc int, type int, forbidden boolean, payload binary"
CHUNK, BATCH = 1 << 20, 1 << 22
IDR, SPS, PPS, DELIMITER = 5, 7, 8, 9
_ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("code_length", pa.int32()), ("length", pa.int64()), ("ref_idc", pa.int32()), ("type", pa.int32()), ("forbidden", pa.bool_()), ("payload", pa.binary())])


def units_of(f, start: int, stop: int, size: int, chunk: int = CHUNK) -> Iterator[tuple[int, int, bytes]]:
    """(offset of the header, length of the code, unit) of the units whose code 00 00 01 begins in [start, stop) of a file."""
    at, data, ended = max(0, start - 4), b"", False  # data: the file from `at` on, as far as it was read
    header, code, look = -1, 0, start  # the open unit, and where to look for a code

    def zero_before(found: int) -> bool:
        # A zero that is the whole of a unit belongs to it.
        return found > 0 and data[found - 1] == 0 and (found < 4 or data[found - 4 : found - 1] != b"\0\0\1")

    while True:
        found = data.find(b"\0\0\1", look - at) if look >= at else -1
        if found < 0:
            look = max(look, at + len(data) - 2)
            if header < 0 and look >= stop:
                return
            if ended:
                if header >= 0 and at + len(data) > header:
                    yield header, code, data[header - at :]
                return
            if header < 0:  # nothing is open: only what may tell about the next code stays
                keep = min(max(at, look - 4), at + len(data))
                data, at = data[keep - at :], keep
            got = f.read_at(min(chunk, size - at - len(data)), at + len(data)) if at + len(data) < size else b""
            data, ended = data + got, not got
            continue
        place, zero = at + found, zero_before(found)
        if header >= 0 and place - zero > header:
            yield header, code, data[header - at : found - zero]
        if place >= stop:
            return
        header, code = place + 3, 4 if zero else 3
        look, keep = header, max(at, header - 4)
        data, at = data[keep - at :], keep


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.each = options["path"], max(1, int(options.get("partition_bytes", 1 << 26)))
        self.chunk = max(1, int(options.get("chunk_bytes", CHUNK)))

    def partitions(self) -> list[Range]:
        return [Range(path, at, min(size, at + self.each), size) for path, size in listed(self.path) for at in range(0, size, self.each)] or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        if part.size:
            system, _ = opened(self.path)
            with system.open_input_file(part.path) as f:
                for offset, code, unit in units_of(f, part.start, part.stop, part.size, self.chunk):
                    rows.append((part.path, offset, code, len(unit), unit[0] >> 5 & 3, unit[0] & 31, unit[0] > 127, unit[1:]))
                    held += len(unit) + 100
                    if held > BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), _ARROW)], schema=_ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), _ARROW)], schema=_ARROW)


def split(unit: bytes) -> list[bytes]:
    """The units of an access unit that is at hand, without start codes; the same rules."""

    class Held:
        def read_at(self, n: int, at: int) -> bytes:
            return unit[at : at + n]

    return [u for _, _, u in units_of(Held(), 0, len(unit), len(unit), max(1, len(unit)))]


class _Streams(StagedWriter, DataSourceArrowWriter):
    """A file for each stream, written as its rows come."""

    suffix, columns = "", ("stream_id", "seq")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        files, stream, last, sink = [], None, None, None
        system, _ = opened(self.path)
        try:
            for b in batches:
                for i, q, *values in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in self.columns)):
                    if sink is None or i != stream:
                        if sink is not None:
                            files.append((f"{stream}{self.suffix}", sink.close()))
                        sink, stream, last = self.open(system), i, None
                    if q is None or last is not None and q <= last:
                        raise ValueError(f"stream {i}: {q} behind {last}; rows of a stream must come in order")
                    last = q
                    sink.add(*values)
            if sink is not None:
                files.append((f"{stream}{self.suffix}", sink.close()))
        except BaseException:
            if sink is not None:
                sink.drop()
            raise
        return Staged(files)


class _ByteFile:
    def __init__(self, system, path: str):
        self.path, self.f = path, system.open_output_stream(path)

    def add(self, unit: bytes) -> None:
        self.f.write(unit)

    def close(self) -> str:
        self.f.close()
        return self.path

    drop = close


class _ByteWriter(_Streams):
    suffix, columns = ".h264", ("stream_id", "seq", "unit")

    def open(self, system) -> _ByteFile:
        return _ByteFile(system, self.new(self.suffix))


class _MovieFile:
    """Media data goes to a staged file of its own; close() puts the boxes around it."""

    def __init__(self, system, media: str, path: str):
        self.system, self.media, self.path = system, media, path
        self.f, self.table = system.open_output_stream(media), movie.Samples()

    def add(self, unit: bytes, ticks: int, width: int, height: int) -> None:
        kept, size, sync = [], 0, False
        for u in split(unit):
            kind = u[0] & 31
            if kind in (SPS, PPS):
                self.table.parameters(kind == SPS, u)
            elif kind != DELIMITER:
                kept += [len(u).to_bytes(4, "big"), u]
                size, sync = size + 4 + len(u), sync or kind == IDR
        self.table.add(size, sync, ticks, width, height)
        for x in kept:
            self.f.write(x)

    def close(self) -> str:
        self.f.close()
        with self.system.open_output_stream(self.path) as out, self.system.open_input_stream(self.media) as media:
            out.write(self.table.head())
            while data := media.read(CHUNK):
                out.write(data)
            out.write(self.table.tail())
        self.system.delete_file(self.media)
        return self.path

    def drop(self) -> None:
        self.f.close()


class _MovieWriter(_Streams):
    suffix, columns = ".mp4", ("stream_id", "seq", "unit", "ticks", "width", "height")

    def open(self, system) -> _MovieFile:
        return _MovieFile(system, self.new(".media"), self.new(self.suffix))


class ByteStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "annexb"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ByteWriter(dict(self.options), overwrite)


class Movie(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mp4"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _MovieWriter(dict(self.options), overwrite)


def save_streams(rows: DataFrame, path: str, kind: str = "annexb", mode: str = "overwrite", files: int | None = None) -> None:
    """Each stream of (stream_id, seq, unit, ...) as one file of `path`. Streams are dealt to tasks whole; a task writes one after the other."""
    rows.sparkSession.dataSource.register(ByteStream if kind == "annexb" else Movie)
    dealt = rows.repartition(files, "stream_id") if files else rows.repartition("stream_id")
    dealt.sortWithinPartitions("stream_id", "seq").write.format(kind).mode(mode).save(path)
