"""Entropy coding read back by a decoder of its own; headers and units by a bit reader; emulation prevention byte by byte."""

import os
import random

import pytest
from pyspark.sql import functions as F

from blockflow.functions import blocks as B
from blockflow.functions import vlc as V
from blockflow.operators import bits as S
from blockflow.operators import entropy as E

DATA = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


class Reader:
    def __init__(self, bits):
        self.bits, self.at = bits, 0

    def u(self, n):
        self.at += n
        assert self.at <= len(self.bits)
        return int(self.bits[self.at - n : self.at] or "0", 2)

    def ue(self):
        zeros = self.bits.index("1", self.at) - self.at
        self.at += zeros
        return self.u(zeros + 1) - 1

    def se(self):
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)

    def code(self, entries):
        """The key of the entry that comes next; entries: key -> bit string."""
        for key, bits in entries.items():
            if bits and self.bits.startswith(bits, self.at):
                self.at += len(bits)
                return key
        raise AssertionError("no code")


def decode(bits, nc, n):
    """Scanned levels of a block of n places (the parsing process of the standard)."""
    r = Reader(bits)
    table = V.TOKENS[4 if n == 4 else 0 if nc < 2 else 1 if nc < 4 else 2 if nc < 8 else 3]
    total, ones = r.code({(t, o): c for t, line in enumerate(table) for o, c in enumerate(line)})
    levels, suffix = [], 1 if total > 10 and ones < 3 else 0
    for i in range(total):
        if i < ones:
            levels.append(1 - 2 * r.u(1))
            continue
        prefix = r.bits.index("1", r.at) - r.at
        r.at += prefix + 1
        size = 4 if prefix == 14 and suffix == 0 else prefix - 3 if prefix >= 15 else suffix
        code = (min(15, prefix) << suffix) + r.u(size)
        code += 15 if prefix >= 15 and suffix == 0 else 0
        code += 2 if i == ones and ones < 3 else 0
        levels.append((code + 2) // 2 if code % 2 == 0 else (-code - 1) // 2)
        suffix = suffix or 1
        suffix += abs(levels[-1]) > 3 << suffix - 1 and suffix < 6
    zeros = 0
    if 0 < total < n:
        zeros = r.code(dict(enumerate((V.TOTAL_ZEROS_DC if n == 4 else V.TOTAL_ZEROS)[total - 1])))
    out, at, left = [0] * n, total + zeros - 1, zeros
    for i, v in enumerate(levels):
        out[at] = v
        run = left if i == total - 1 else r.code(dict(enumerate(V.RUNS[min(left, 7) - 1]))) if left else 0
        left -= run
        at -= run + 1
    assert r.at == len(bits)
    return out


def blocks():
    r = random.Random(8)
    out = [[0] * 16, [1] * 16, [-1] + [0] * 15, [0] * 15 + [1], [2063] + [0] * 15, [-2000, 1, -1, 1] + [0] * 12, [15, -16, 17, -30, 31] + [3] * 11, [7] * 16, [0, 8, 0, -9, 0, 0, 120, 1, 0, 0, 0, -1, 0, 0, 1, 0]]
    for k in range(600):
        p, big = r.random(), r.choice([1, 2, 20, 300, 1500])
        out.append([r.randint(-big, big) if r.random() < p else 0 for _ in range(16)])
    return out


def test_residual_blocks_are_read_back(spark):
    data = [(k, z, k % 17) for k, z in enumerate(blocks())]
    out = E.residual(spark.createDataFrame(data, "id int, z array<int>, nc int"), "z", "nc").collect()
    assert len(out) == len(data)
    for r in out:
        assert decode(r.bits, r.nc, 16) == list(r.z), r.id


def test_blocks_of_fifteen_are_read_back(spark):
    data = [(k, z[1:], k % 17) for k, z in enumerate(blocks())]
    for r in E.residual(spark.createDataFrame(data, "id int, z array<int>, nc int"), "z", "nc", size=15).collect():
        assert decode(r.bits, r.nc, 15) == list(r.z), r.id


def test_chroma_dc_blocks_are_read_back(spark):
    data = [(k, z[:4]) for k, z in enumerate(blocks())]
    for r in E.residual(spark.createDataFrame(data, "id int, z array<int>"), "z", "", dc=True).collect():
        assert decode(r.bits, -1, 4) == list(r.z), r.id


def test_codes_are_prefix_free():
    for table in [*V.TOKENS, *([x] for x in [*V.TOTAL_ZEROS, *V.TOTAL_ZEROS_DC, *V.RUNS])]:
        words = sorted(c for line in table for c in line)
        assert len(set(words)) == len(words) and not any(b.startswith(a) for a, b in zip(words, words[1:]))
    assert sorted(V.CBP_INTRA) == sorted(V.CBP_INTER) == list(range(48))


def brute_ebsp(b):
    out, zeros = bytearray(), 0
    for x in b:
        if zeros == 2 and x <= 3:
            out.append(3)
            zeros = 0
        out.append(x)
        zeros = zeros + 1 if x == 0 else 0
    return bytes(out)


def test_emulation_prevention_of_bytes(spark):
    r = random.Random(1)
    data = [(bytearray(r.choice([0, 0, 0, 1, 2, 3, 4, 255, 10, 13]) for _ in range(n)),) for n in [*range(40), 5_000]] + [(bytearray(b"\0" * 9),), (None,)]
    out = spark.createDataFrame(data, "b binary").select("b", B.emulation_prevention(F.col("b")).alias("e")).collect()
    assert all(bytes(x.e) == brute_ebsp(bytes(x.b)) for x in out if x.b is not None) and len(out) == len(data)


@data
def test_parameter_sets_are_read_back(spark):
    rows = {(r.id, r.kind): bytes.fromhex(r.unit) for r in E.parameter_sets(spark, DATA).collect()}
    for (i, kind), unit in rows.items():
        assert unit[:4] == b"\0\0\0\1"
        payload = unit[5:].replace(b"\0\0\3", b"\0\0")
        r = Reader("".join(f"{b:08b}" for b in payload))
        w, h, cut = (i % 40 + 1) * 16, (i % 30 + 1) * 16, i % 8 * 2
        if kind == "sps":
            assert unit[4] == 0x67 and (r.u(8), r.u(8), r.u(8)) == (66, 0xC0, 31 + i % 2)
            assert [r.ue() for _ in range(4)] == [0, 0, 2, i % 2 + 1] and r.u(1) == 0
            assert (r.ue(), r.ue(), r.u(2)) == (w // 16 - 1, h // 16 - 1, 3)
            if r.u(1):
                assert [r.ue() for _ in range(4)] == [0, cut // 2, 0, cut // 2] and cut
            assert r.u(1) == 1 and r.u(2) == 0 and (r.u(1), r.u(3), r.u(1), r.u(1)) == (1, 5, 0, 1) and [r.u(8) for _ in range(3)] == [6, 6, 6] and r.u(6) == 0
        elif kind == "pps":
            assert unit[4] == 0x68 and [r.ue(), r.ue(), r.u(2), r.ue(), r.ue(), r.ue(), r.u(3)] == [0] * 7
            assert (r.se(), r.se(), r.se(), r.u(1), r.u(1), r.u(1)) == (i % 52 - 26, 0, 0, 1, int(i % 3 == 0), 0)
        else:
            assert unit[4] == 6 and r.u(8) == 6
            size = r.u(8)
            start = r.at
            assert (r.ue(), r.u(4)) == (i % 600, 8)
            r.at = start + 8 * size
        assert r.u(1) == 1 and set(r.bits[r.at :]) <= {"0"} and len(r.bits) - r.at < 8


@data
def test_slice_headers_are_read_back(spark):
    fields = {(r.stream_id, r.seq): r for r in S.gop(spark, DATA).collect()}
    for row in E.slice_header(spark, DATA).collect():
        r, f = Reader(row.bits), fields[row.stream_id, row.seq]
        idr = f.n_refs == 0
        assert r.ue() == row.first_mb and r.ue() == (2 if idr else 0) and r.ue() == 0 and r.u(4) == f.frame_num
        if idr:
            assert r.ue() == f.idr_pic_id and r.u(2) == 0
        else:
            if r.u(1):
                assert r.ue() == 1 and f.n_refs >= 2
            assert r.u(1) == 0 and r.u(1) == 0
        assert r.se() == row.seq % 21 - 10
        idc = r.ue()
        assert idc == row.seq % 3 and (idc == 1 or (r.se(), r.se()) == (0, 0)) and r.at == len(r.bits)


@data
def test_inter_headers_are_read_back(spark):
    for row in E.p_headers(spark, DATA).collect():
        r, refs = Reader(row.bits), row.mb_id % 3 + 1
        te = lambda: 0 if refs == 1 else 1 - r.u(1) if refs == 2 else r.ue()
        shape = r.ue()
        assert shape == row.mb_id % 4 == row["shape"]
        subs = [r.ue() for _ in range(4)] if shape == 3 else []
        assert all(0 <= te() < refs for _ in range((1, 2, 2, 4)[shape]))
        for _ in range(sum((1, 2, 2, 4)[s] for s in subs) if subs else (1, 2, 2)[shape]):
            assert abs(r.se()) < 140 and abs(r.se()) < 140
        assert r.at == len(r.bits)
