"""Raw video, byte streams and movie files: cut anywhere, read back as they were written."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest

from blockflow.sources import bytestream as B
from blockflow.sources import movie as M
from blockflow.sources.rawvideo import Layout, RawVideo
from tests.test_container import boxes


class Bytes:
    """A file in memory that counts what is read."""

    def __init__(self, data):
        self.data, self.most = data, 0

    def read_at(self, n, at):
        self.most = max(self.most, n)
        return self.data[at : at + n]


def by_definition(b):
    """(offset, code length, unit): start codes left to right; a zero before a code belongs to it unless it is a unit's only byte."""
    codes = [i for i in range(len(b) - 2) if b[i : i + 3] == b"\0\0\1"]
    out = []
    for k, p in enumerate(codes):
        h, nxt = p + 3, codes[k + 1] if k + 1 < len(codes) else len(b)
        zero = lambda q: q > 0 and b[q - 1] == 0 and not (q >= 4 and b[q - 4 : q - 1] == b"\0\0\1")
        end = nxt - (k + 1 < len(codes) and zero(nxt))
        if end > h:
            out.append((h, 4 if zero(p) else 3, b[h:end]))
    return out


def test_units_whatever_the_ranges_and_chunks():
    r = random.Random(4)
    for n in range(400):
        b = bytes(r.choice((0, 0, 0, 1, 1, 3, 103, 255)) for _ in range(r.randint(0, 60)))
        want = by_definition(b)
        for size in (1, 2, 3, 5, 7, 16, 100):
            for chunk in (1, 2, 3, 8, 64):
                got = [u for at in range(0, len(b), size) for u in B.units_of(Bytes(b), at, min(len(b), at + size), len(b), chunk)]
                assert got == want, (b, size, chunk)
        assert B.split(b) == [u for _, _, u in want]


def test_only_the_open_unit_is_held():
    b = b"\0\0\1\x65" + b"x" * 10_000 + b"\0\0\0\1\x41" + b"y" * 50
    f = Bytes(b)
    assert [len(u) for _, _, u in B.units_of(f, 0, 10, len(b), 100)] == [10_001] and f.most == 100
    assert [c for _, c, _ in B.units_of(f, 10, len(b), len(b), 100)] == [4]


def saved(spark, tmp_path, rows, **options):
    spark.dataSource.register(RawVideo)
    path = str(tmp_path / "raw")
    spark.createDataFrame(rows, "y binary, u binary, v binary").repartition(3).write.format("rawvideo").options(**options).mode("overwrite").save(path)
    return path


@pytest.mark.parametrize("w,h,strides", [(6, 4, {}), (7, 5, {}), (7, 5, {"stride": 16, "chroma_stride": 9})])
def test_raw_frames_come_back(spark, tmp_path, w, h, strides):
    r = np.random.default_rng(1)
    cw, ch = (w + 1) // 2, (h + 1) // 2
    frames = [tuple(r.integers(0, 256, n, np.uint8).tobytes() for n in (w * h, cw * ch, cw * ch)) for _ in range(40)]
    path = saved(spark, tmp_path, frames, width=w, height=h, **strides)
    for each in (1, 1_000, 1 << 27):
        df = spark.read.format("rawvideo").options(width=w, height=h, partition_bytes=each, **strides).load(path)
        got = df.collect()
        assert sorted((bytes(x.y), bytes(x.u), bytes(x.v)) for x in got) == sorted(frames) and {(x.width, x.height) for x in got} == {(w, h)}
        # Every frame of a file has its number, whatever the ranges; plain reading of the file agrees.
        size = Layout({"width": w, "height": h, **strides}).size
        for x in got:
            stride = strides.get("stride", w)
            with open(x.path, "rb") as f:
                f.seek(x.frame_idx * size)
                assert f.read(stride * h)[:w] == bytes(x.y)[:w]
    binary = spark.read.format("binaryFile").load(path).selectExpr("sum(length) AS n").first().n
    assert binary == 40 * size
    assert not [n for n in os.listdir(path) if n.startswith("_")]


def test_other_layouts():
    r = np.random.default_rng(2)
    yuyv = Layout({"width": 5, "height": 3, "pixel": "yuyv", "stride": 14})
    a = r.integers(0, 256, yuyv.size).astype(np.uint8)
    y, u, v = yuyv.planes(a)
    line = a.reshape(3, 14)
    for j in range(3):
        assert [int(x) for x in y[j]] == [int(line[j, 2 * k]) for k in range(5)]
    for j, (p, q) in enumerate(((0, 1), (2, 2))):
        for k in range(3):
            assert int(u[j, k]) == (int(line[p, 4 * k + 1]) + int(line[q, 4 * k + 1]) + 1) >> 1 and int(v[j, k]) == (int(line[p, 4 * k + 3]) + int(line[q, 4 * k + 3]) + 1) >> 1
    swapped = a.reshape(3, 14).copy()
    swapped[:, :12] = line[:, :12].reshape(3, 6, 2)[:, :, ::-1].reshape(3, 12)
    assert all((p == q).all() for p, q in zip(Layout({"width": 5, "height": 3, "pixel": "uyvy", "stride": 14}).planes(swapped.ravel()), (y, u, v)))
    nv12 = Layout({"width": 4, "height": 2, "pixel": "nv12"})
    y, u, v = nv12.planes(np.arange(12, dtype=np.uint8))
    assert y.tolist() == [[0, 1, 2, 3], [4, 5, 6, 7]] and u.tolist() == [[8, 10]] and v.tolist() == [[9, 11]]
    for wrong in ({"width": 0, "height": 2}, {"width": 4, "height": 2, "stride": 3}, {"width": 4, "height": 2, "pixel": "rgb"}):
        with pytest.raises(ValueError):
            Layout(wrong)


def test_a_part_of_a_frame_is_an_error(spark, tmp_path):
    spark.dataSource.register(RawVideo)
    (tmp_path / "a.yuv").write_bytes(bytes(25))
    with pytest.raises(Exception, match="whole number of frames"):
        spark.read.format("rawvideo").options(width=4, height=4).load(str(tmp_path)).count()
    (tmp_path / "a.yuv").write_bytes(b"")
    assert spark.read.format("rawvideo").options(width=4, height=4).load(str(tmp_path)).count() == 0


SPS, PPS = b"\0\0\0\1\x67\x42\xc0\x1e\x99", b"\0\0\0\1\x68\xce\x01"


def access_units(n, seed=0):
    r = random.Random(seed)
    out = []
    for k in range(n):
        unit = SPS + PPS if k % 4 == 0 else b"\0\0\0\1\x09\x10"
        for _ in range(r.randint(1, 3)):
            unit += (b"\0\0\1" if r.random() < 0.3 else b"\0\0\0\1") + bytes([0x65 if k % 4 == 0 else 0x41]) + bytes(r.randint(2, 255) for _ in range(r.randint(1, 200)))
        out.append((k, unit, k * 3_000 + k // 2, 64, 48))
    return out


def test_streams_are_files_and_come_back(spark, tmp_path):
    streams = {s: access_units(3 + s, s) for s in range(9)}
    rows = [(s, *x) for s, us in streams.items() for x in us]
    random.Random(1).shuffle(rows)
    path = str(tmp_path / "out")
    df = spark.createDataFrame(rows, "stream_id long, seq int, unit binary, ticks long, width int, height int").repartition(5)
    B.save_streams(df, path)
    for s, us in streams.items():
        assert (tmp_path / "out" / f"{s}.h264").read_bytes() == b"".join(u[1] for u in us)
    want = sorted((f"{s}.h264", h, c, len(u), u[0] & 31, u[1:]) for s, us in streams.items() for h, c, u in by_definition(b"".join(x[1] for x in us)))
    for each in (64, 1_000, 1 << 26):
        got = spark.read.format("annexb").options(partition_bytes=each, chunk_bytes=50).load(path).collect()
        assert sorted((x.path.rpartition("/")[2], x.offset, x.code_length, x.length, x.type, bytes(x.payload)) for x in got) == want
    with pytest.raises(Exception, match="already there"):
        B.save_streams(df, path, mode="append")
    B.save_streams(df.where("stream_id < 2"), path)
    assert sorted(os.listdir(path)) == ["0.h264", "1.h264"]


def test_movies_hold_the_samples(spark, tmp_path):
    streams = {s: access_units(1 + 3 * s, s) for s in range(4)}
    rows = [(s, *x) for s, us in streams.items() for x in us]
    path = str(tmp_path / "out")
    B.save_streams(spark.createDataFrame(rows, "stream_id long, seq int, unit binary, ticks long, width int, height int"), path, "mp4")
    for s, us in streams.items():
        b = (tmp_path / "out" / f"{s}.mp4").read_bytes()
        top = dict(boxes(b))
        assert [k for k, _ in boxes(b)] == ["ftyp", "mdat", "moov"]
        moov = dict(boxes(top["moov"]))
        trak = dict(boxes(moov["trak"]))
        mdia = dict(boxes(trak["mdia"]))
        stbl = dict(boxes(dict(boxes(mdia["minf"]))["stbl"]))
        u = lambda x, k: int.from_bytes(x[4 * k : 4 * k + 4], "big")
        sizes = [u(stbl["stsz"], 3 + k) for k in range(u(stbl["stsz"], 2))]
        at = u(stbl["stco"], 2)
        assert len(sizes) == len(us) and at == b.index(b"mdat") + 4
        for (_, unit, *_), size in zip(us, sizes):
            kept = [x for _, _, x in by_definition(unit) if x[0] & 31 not in (7, 8, 9)]
            assert b[at : at + size] == b"".join(len(x).to_bytes(4, "big") + x for x in kept)
            at += size
        assert [u(stbl["stss"], 2 + k) for k in range(u(stbl["stss"], 1))] == [k + 1 for k in range(len(us)) if k % 4 == 0]
        deltas = [d for k in range(u(stbl["stts"], 1)) for d in [u(stbl["stts"], 3 + 2 * k)] * u(stbl["stts"], 2 + 2 * k)]
        ticks = [x[2] for x in us]
        assert deltas[:-1] == [y - x for x, y in zip(ticks, ticks[1:])] and deltas[-1] == (sum(deltas[:-1]) // len(deltas[:-1]) if deltas[:-1] else 3_000)
        assert u(mdia["mdhd"], 4) == sum(deltas) and trak["tkhd"][-8:] == (64 << 16).to_bytes(4, "big") + (48 << 16).to_bytes(4, "big")
        (_, entry), = boxes(stbl["stsd"], 8)
        (_, avcc), = boxes(entry, 78)
        assert avcc[1:4] == SPS[5:8] and avcc[8:13] == SPS[4:]


def test_a_movie_needs_parameter_sets_and_slices(tmp_path):
    s = M.Samples()
    with pytest.raises(ValueError, match="parameter sets"):
        s.add(5, True, 0, 16, 16)
    s.parameters(True, b"\x67\1\2\3")
    s.parameters(False, b"\x68")
    with pytest.raises(ValueError, match="coded slice"):
        s.add(0, True, 0, 16, 16)


def test_large_media_has_wide_sizes():
    s = M.Samples()
    s.parameters(True, b"\x67\1\2\3")
    s.parameters(False, b"\x68")
    for k in range(2):
        s.add(3 << 30, k == 0, k, 16, 16)
    head = s.head()
    assert head[28:32] == b"\0\0\0\1" and int.from_bytes(head[36:44], "big") == 16 + (6 << 30) and b"co64" in s.tail() and b"stco" not in s.tail()


def test_rows_out_of_order_and_streams_in_two_tasks(spark, tmp_path):
    rows = [(1, k, b"\0\0\1\x41x") for k in range(6)]
    spark.dataSource.register(B.ByteStream)
    df = spark.createDataFrame(rows, "stream_id long, seq int, unit binary")
    with pytest.raises(Exception, match="in order"):
        df.coalesce(1).sortWithinPartitions("seq", ascending=False).write.format("annexb").mode("overwrite").save(str(tmp_path / "a"))
    with pytest.raises(Exception, match="more than one task"):
        df.repartition(3).sortWithinPartitions("seq").write.format("annexb").mode("overwrite").save(str(tmp_path / "b"))
    for name in "ab":  # nothing is left of a failed job
        assert not os.path.exists(tmp_path / name) or os.listdir(tmp_path / name) == []


def test_hidden_files_are_not_read(tmp_path):
    from blockflow.sources.files import listed

    (tmp_path / "_staging-x").mkdir()
    for n in ("_staging-x/a", ".b", "c"):
        (tmp_path / n).write_bytes(b"12")
    assert listed(str(tmp_path)) == [(str(tmp_path / "c"), 2)] == listed(f"file://{tmp_path}")

