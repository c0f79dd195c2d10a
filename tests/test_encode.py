"""Encoded slices decoded by a parser of their own, sample by sample."""

import os
from hashlib import md5

import numpy as np
import pytest

from blockflow.functions import encode as E
from blockflow.functions import tables as T
from blockflow.functions import vlc as V
from blockflow.operators import session as O
from blockflow.sources import adapters as A
from tests.test_entropy import Reader
from tests.test_motion import plane


def read_block(r, nc, n):
    """Scanned levels of a block, by the parsing process."""
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
        code = (min(15, prefix) << suffix) + r.u(size) + (15 if prefix >= 15 and suffix == 0 else 0) + (2 if i == ones and ones < 3 else 0)
        levels.append((code + 2) // 2 if code % 2 == 0 else (-code - 1) // 2)
        suffix = suffix or 1
        suffix += abs(levels[-1]) > 3 << suffix - 1 and suffix < 6
    left = r.code(dict(enumerate((V.TOTAL_ZEROS_DC if n == 4 else V.TOTAL_ZEROS)[total - 1]))) if 0 < total < n else 0
    out, at = [0] * n, total + left - 1
    for i, v in enumerate(levels):
        out[at] = v
        run = left if i == total - 1 else r.code(dict(enumerate(V.RUNS[min(left, 7) - 1]))) if left else 0
        left -= run
        at -= run + 1
    return out


def decode(bits, w, rows, qp):
    """Planes of a slice of intra 16x16 macroblocks; context counts kept as the standard tells."""
    r = Reader(bits)
    first = r.ue() // (w // 16)
    assert (r.ue(), r.ue(), r.u(4)) == (7, 0, 0)
    r.ue()
    assert r.u(2) == 0 and r.se() == qp - 26 and r.ue() == 1
    h = 16 * (first + rows)
    rec = [np.zeros((h, w), np.int64), np.zeros((h // 2, w // 2), np.int64), np.zeros((h // 2, w // 2), np.int64)]
    n = {}

    def nc(plane, y, x, top):
        a, b = n.get((plane, y, x - 1)), n.get((plane, y - 1, x)) if y > top else None
        return (a + b + 1) >> 1 if a is not None and b is not None else a if a is not None else b or 0

    for my in range(first, first + rows):
        for mx in range(w // 16):
            kind = r.ue() - 1
            mode, pattern, ac = kind % 4, kind // 4 % 3, kind >= 12
            assert r.ue() == 0 and r.se() == 0
            for y in range(4):
                for x in range(4):
                    n[0, 4 * my + y, 4 * mx + x] = n.get((0, 4 * my + y, 4 * mx + x), 0)
            order = np.zeros(16, np.int64)
            order[np.array(T.ZIGZAG)] = read_block(r, nc(0, 4 * my, 4 * mx, 4 * first), 16)
            dc, levels = order.reshape(4, 4), np.zeros((4, 4, 4, 4), np.int64)
            for y in range(4):
                for x in range(4):
                    n.pop((0, 4 * my + y, 4 * mx + x))
            for k in range(16):
                y, x = 2 * (k // 8) + k % 4 // 2, 2 * (k // 4 % 2) + k % 2
                block = np.zeros(16, np.int64)
                if ac:
                    got = read_block(r, nc(0, 4 * my + y, 4 * mx + x, 4 * first), 15)
                    block[np.array(T.ZIGZAG)[1:]] = got
                n[0, 4 * my + y, 4 * mx + x] = int(np.count_nonzero(block))
                levels[y, x] = block.reshape(4, 4)
            cdc = [np.array(read_block(r, -1, 4)).reshape(2, 2) if pattern else np.zeros((2, 2), np.int64) for _ in (0, 1)]
            top = my > first
            rec[0][16 * my : 16 * my + 16, 16 * mx : 16 * mx + 16] = E.luma_rebuilt(E.luma_modes(rec[0], 16 * my, 16 * mx, top)[mode], dc, levels, qp)
            for c in (0, 1):
                levels = np.zeros((2, 2, 4, 4), np.int64)
                for y in range(2):
                    for x in range(2):
                        block = np.zeros(16, np.int64)
                        if pattern == 2:
                            block[np.array(T.ZIGZAG)[1:]] = read_block(r, nc(c + 1, 2 * my + y, 2 * mx + x, 2 * first), 15)
                        n[c + 1, 2 * my + y, 2 * mx + x] = int(np.count_nonzero(block))
                        levels[y, x] = block.reshape(4, 4)
                to = rec[c + 1]
                to[8 * my : 8 * my + 8, 8 * mx : 8 * mx + 8] = E.chroma_rebuilt(E.chroma_dc(to, 8 * my, 8 * mx, top), cdc[c], levels, T.chroma_qp(qp))
    assert r.u(1) == 1 and set(r.bits[r.at :]) <= {"0"} and len(r.bits) - r.at < 8
    return [rec[0][16 * first :], rec[1][8 * first :], rec[2][8 * first :]]


def test_slices_decode_to_the_same_planes():
    for seed, qp in ((1, 10), (2, 23), (3, 28), (4, 36), (5, 51), (6, 4)):
        planes = plane(seed), plane(seed + 1, 24, 16), plane(seed + 2, 24, 16)
        for first, rows in ((0, 2), (0, 1), (1, 1)):
            bits, rec = E.encoded(planes, first, rows, qp, 3)
            assert len(bits) % 8 == 0
            for a, b, own, s in zip(decode(bits, 48, rows, qp), rec, planes, (16, 8, 8)):
                assert np.array_equal(a, b)
                error = float(((b - own[s * first : s * (first + rows)]) ** 2).mean())
                assert error < max(2.0, 0.4 * 2 ** ((qp - 4) / 3))


def test_flat_planes_take_few_bits():
    planes = np.full((32, 48), 128), np.full((16, 24), 128), np.full((16, 24), 128)
    bits, rec = E.encoded(planes, 0, 2, 28)
    assert len(bits) < 120 and all((p == 128).all() for p in rec)


data = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")


@data
def test_access_units_and_recording(spark):
    d = "/root/testdata/sf0.001"
    px = {r.frame_idx: np.frombuffer(bytes(r.px), np.uint8).reshape(32, 48) for r in A.frames(spark, d).collect()}
    got = {r.frame_idx: r for r in O.encode_frames(spark, d).collect()}
    assert set(got) == set(px)
    sizes = {}
    for f, p in px.items():
        units, sse = [], 0
        for k in (0, 1):
            bits, rec = E.encoded(O.planes_of(p), k, 1, O.QP, f % 2)
            units.append(E.unit(0x65, bits))
            assert units[-1][:5] == b"\0\0\0\1\x65" and b"\0\0\0" not in units[-1][5:] and b"\0\0\1" not in units[-1][5:]
            sse += sum(int(((a - b[s * k : s * (k + 1)]) ** 2).sum()) for a, b, s in zip(rec, O.planes_of(p), (16, 8, 8)))
        whole = b"".join(units)
        sizes[f] = len(whole)
        assert (got[f].n_bytes, got[f].sse, got[f].digest) == (len(whole), sse, md5(whole).hexdigest())
    at = 36
    for r in sorted(O.record(spark, d).collect(), key=lambda r: r.frame_idx):
        assert (r.size, r.offset) == (sizes[r.frame_idx], at)
        at += r.size


@data
def test_session_feeds_what_it_encoded_back(spark):
    rows = {}
    for r in O.session(spark, "/root/testdata/sf0.001").collect():
        rows.setdefault(r.stream_id, []).append(r)
    for seqs in rows.values():
        seqs.sort(key=lambda r: r.seq)
        assert seqs[0].idr and seqs[0].frame_num == 0
        for a, b in zip(seqs, seqs[1:]):
            assert b.idr or (a.width, a.height) == (b.width, b.height)
            assert b.frame_num == (0 if b.idr else (a.frame_num + 1) % 16) and 0 <= b.overshoots - a.overshoots <= 1
    assert len({r.base_qp for s in rows.values() for r in s}) > 3
