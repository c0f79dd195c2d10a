"""Decisions of inter macroblocks on what is measured: how far to search, what a spent budget sheds, which reference wins, and whether intra is better.

The pictures of the vectors are taken in order within segments; a macroblock's choices depend on the vectors of its neighbours, on those of the picture
before and on the search effort of the macroblocks before it, so a segment is one pass. The rules are functions of the measured
numbers, and every number is a column of the result, so they can be checked by rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockflow.functions import encode as E
from blockflow.functions import inter as I
from blockflow.functions import intra as N
from blockflow.functions import motion as K
from blockflow.functions import tables as T
from blockflow.functions.folds import dealt
from blockflow.sources import adapters as A

#: QP of all pictures, effort that a macroblock may cost, widest window that is searched here, samples around a reference, pictures of a segment.
QP, CAP, WIDEST, AROUND, SEGMENT = 28, 512, 16, 48, 64
#: From this cost of the inter prediction on, intra 4x4 is tried; what its modes are taken to cost; the good-enough floor of a reference.
TRY_INTRA4, MODE_BITS, FLOOR = 3_000, 16, 1_024


def search_range(variance: int, sad_skip: int, skip: tuple[int, int], temporal: tuple[int, int] | None, sad_temporal: int | None) -> tuple[int, bool]:
    """(range, whether the vector of the picture before explains the motion): by variance, wider where the skip prediction is poor."""
    base = 8 if variance < 64 else 16 if variance < 512 else 32
    far = max(abs(v) for v in temporal) >> 2 if temporal else 0
    within = lambda v: max(8, min(32, v))
    if sad_skip > 2_048:
        if sad_temporal is not None and sad_temporal < sad_skip >> 1:
            return within(far + 4), True
        return max(base, 32 if sad_skip > 4_096 else 24), False
    return max(base, within(far + 2)) if temporal and base < 16 else base, False


def tier(consumed: int, budget: int) -> int:
    """What of the budget is spent: 1 from half, 2 from three quarters, 3 from all of it on."""
    return sum(consumed >= b for b in (budget >> 1, budget - (budget >> 2), budget))


def ue_bits(n: int) -> int:
    return 2 * (n + 1).bit_length() - 1


def se_bits(v: int) -> int:
    return ue_bits(-2 * v if v <= 0 else 2 * v - 1)


def inter_bits(part: int, vectors: list[tuple[int, int]], expected: tuple[int, int]) -> int:
    return ue_bits(part) + 4 * len(vectors) + sum(se_bits(v[k] - expected[k]) for v in vectors for k in (0, 1)) + 8


@dataclass
class Choice:
    frame_idx: int
    row: int
    col: int
    variance: int
    skip_x: int
    skip_y: int
    sad_skip: int
    temporal_x: int | None
    temporal_y: int | None
    sad_temporal: int | None
    range: int
    explained: bool
    consumed: int
    tier: int
    sub: bool
    sub_cap: int
    effort: int
    part: int
    total: int
    probe0: int | None
    probe1: int | None
    searched1: bool
    total1: int | None
    reference: int
    mv_x: int
    mv_y: int
    inter_satd: int
    inter_bits: int
    inter_rd: int
    intra_mode: int
    intra_satd: int
    intra_rd: int
    intra4_satd: int | None
    intra4_rd: int | None
    choice: str


SCHEMA = "frame_idx long, row int, col int, variance int, skip_x int, skip_y int, sad_skip int, temporal_x int, temporal_y int, sad_temporal int, range int, explained boolean, consumed long, tier int, sub boolean, sub_cap int, effort int, part int, total int, probe0 int, probe1 int, searched1 boolean, total1 int, reference int, mv_x int, mv_y int, inter_satd int, inter_bits int, inter_rd int, intra_mode int, intra_satd int, intra_rd int, intra4_satd int, intra4_rd int, choice string"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
_ARROW = pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])


class Chooser:
    """Pictures of a segment in order; references are the pictures themselves."""

    def __init__(self, qp: int = QP, cap: int = CAP):
        self.lam, self.cap, self.refs, self.before = T.LAMBDA_SATD[qp], cap, [], None

    def picture(self, frame_idx: int, planes: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[Choice]:
        """The choices of every macroblock; none for a picture without a reference."""
        out, (h, w) = [], planes[0].shape
        grid = I.MotionGrid(h // 4, w // 4)
        if self.refs:
            consumed, searched, budget, most = 0, 0, self.cap * (h * w // 256), max(8, h * w // 1024)
            for row in range(h // 16):
                for col in range(w // 16):
                    c = self._macroblock(frame_idx, planes, grid, row, col, consumed, budget, searched, most)
                    consumed, searched = consumed + c.effort, searched + (c.variance >= 64)
                    out.append(c)
            self.before = grid
        self.refs = [(K.padded(planes[0], AROUND), *(K.padded(p, AROUND // 2) for p in planes[1:])), *self.refs[:1]]
        return out

    def _sad(self, own: np.ndarray, ref: np.ndarray, x: int, y: int, mv: tuple[int, int]) -> int:
        """Luma difference at a whole-sample probe of a vector; the largest number where it leaves the padded plane."""
        a, b = x + AROUND + (mv[0] >> 2), y + AROUND + (mv[1] >> 2)
        if a < 0 or b < 0 or a + 16 > ref.shape[1] or b + 16 > ref.shape[0]:
            return 2**31 - 1
        return int(np.abs(own - ref[b : b + 16, a : a + 16]).sum())

    def _macroblock(self, f, planes, grid, row, col, consumed, budget, searched, most) -> Choice:
        x, y, r, c, lam = 16 * col, 16 * row, 4 * row, 4 * col, self.lam
        own = planes[0][y : y + 16, x : x + 16].astype(np.int64)
        half = [p[y // 2 : y // 2 + 8, x // 2 : x // 2 + 8].astype(np.int64) for p in planes[1:]]
        variance = (256 * int((own * own).sum()) - int(own.sum()) ** 2) // 65_536
        skip, expected = grid.skipped(r, c, 0), grid.predicted(r, c, "16x16", 0)
        skip = tuple(max(-60, min(60, v)) for v in skip)
        pred = K.predicted(self.refs[0], x, y, 0, [skip], AROUND)
        sad_skip = sum(int(np.abs(a - b).sum()) for a, b in zip((own, *half), pred))
        temporal = self.before.at(r, c, 0)[1] if self.before else None
        probed = sad_skip > 2_048 and temporal is not None and temporal != skip
        sad_temporal = self._sad(own, self.refs[0][0], x, y, temporal) if probed else None
        reach, explained = search_range(variance, sad_skip, skip, temporal, sad_temporal)
        step, sub = tier(consumed, budget), variance >= 64
        sub_cap = min((16, 8, 4, 4)[step], 4 if searched + sub > most else 16)
        how = {"cap": sub_cap, "fallback": step < 1, "sub": sub and step < 3}
        used = min(reach, (32, 32, 16, 8)[step], WIDEST)
        centre = tuple(max(-4 * used, min(4 * used, v)) for v in expected)
        block = K.Block(own, self.refs[0][0], x + AROUND, y + AROUND, WIDEST)
        part, total, vectors = K.search(block, lam, used, centre, temporal, **how)
        effort, reference, probe0, probe1, searched1, total1 = block.effort, 0, None, None, False, None
        if len(self.refs) > 1 and step < 2:
            margin, far = 2 * lam, self.refs[1][0]
            searched1 = True
            if total <= min(FLOOR, 32 * lam) + margin:
                mv = vectors[0]
                probe0, probe1 = self._sad(own, self.refs[0][0], x, y, mv), min(self._sad(own, far, x, y, v) for v in ((2 * mv[0], 2 * mv[1]), mv))
                searched1 = probe1 + margin < probe0
            if searched1:
                block = K.Block(own, far, x + AROUND, y + AROUND, WIDEST)
                part1, total1, vectors1 = K.search(block, lam, used, centre, vectors[0], **how)
                effort += block.effort
                if total1 + margin < total:
                    part, vectors, reference, expected = part1, vectors1, 1, grid.predicted(r, c, "16x16", 0, 1)
        inter = K.predicted(self.refs[reference], x, y, part, vectors, AROUND)[0]
        satd = lambda p: int(K.satd_atoms((own - p).astype(np.int32)).sum())
        inter_satd, n = satd(inter), inter_bits(part, vectors, expected)
        modes = E.luma_modes(planes[0].astype(np.int64), y, x, row > 0)
        mode = min((m for m in (2, 0, 1, 3) if m in modes), key=lambda m: np.abs(own - modes[m]).sum())
        intra_bits = ue_bits(18 + mode) + 64
        inter_rd, intra_satd = inter_satd + lam * n, satd(modes[mode])
        intra_rd, intra4_satd, intra4_rd, choice = intra_satd + lam * intra_bits, None, None, "inter"
        if intra_rd + (intra_rd >> 2) < inter_rd:
            choice = "intra16"
        elif inter_satd >= TRY_INTRA4:
            intra4_satd = self._intra4(planes[0].astype(np.int64), row, col)
            intra4_rd = intra4_satd + lam * (intra_bits + MODE_BITS)
            if intra4_rd + (intra4_rd >> 2) < inter_rd and intra4_rd < intra_rd:
                choice = "intra4"
        if choice == "inter":
            for shape, mv in zip(K.PARTS[part], vectors):
                grid.commit(r, c, shape, mv, reference)
        else:
            grid.commit(r, c, "16x16", (0, 0), I.INTRA)
        return Choice(f, row, col, variance, *skip, sad_skip, *(temporal or (None, None)), sad_temporal, reach, explained, consumed, step, how["sub"], sub_cap, effort, part, total, probe0, probe1, searched1, total1, reference, *map(int, vectors[0]), inter_satd, n, inter_rd, mode, intra_satd, intra_rd, intra4_satd, intra4_rd, choice)

    @staticmethod
    def _intra4(plane: np.ndarray, row: int, col: int) -> int:
        """The least transformed difference of each 4x4 block, predicted from the source around it, summed."""
        total = 0
        for r in range(4 * row, 4 * row + 4):
            for c in range(4 * col, 4 * col + 4):
                own = plane[4 * r : 4 * r + 4, 4 * c : 4 * c + 4]
                found = np.stack(list(N.predictions(plane, r, c, 0).values()))
                total += int(K.satd_atoms((own - found).astype(np.int32)).min())
        return total


def choices(spark, d) -> DataFrame:
    """Measured numbers and choices of every macroblock of the pictures of the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            made = []
            for f, w, h, *data in zip(*(b.column(n).to_pylist() for n in ("frame_idx", "width", "height", "y", "u", "v"))):
                if last is None or f != last + 1 or f % SEGMENT == 0:
                    state = Chooser()
                last = f
                planes = tuple(np.frombuffer(p, np.uint8).reshape(s) for p, s in zip(data, ((h, w), (h // 2, w // 2), (h // 2, w // 2))))
                made += [astuple(x) for x in state.picture(f, planes)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made), _ARROW)], schema=_ARROW)

    rows = dealt(A.pictures(spark, d).withColumn("segment", F.expr(f"frame_idx div {SEGMENT}")), "segment").sortWithinPartitions("frame_idx")
    return rows.select("frame_idx", "width", "height", "y", "u", "v").mapInArrow(run, SCHEMA)


def row_effort(spark, d):
    """What each row of macroblocks of a picture cost the search, and how its macroblocks were coded."""
    kinds = ("intra16", "intra4", "inter")
    return choices(spark, d).groupBy("frame_idx", "row").agg(F.sum("effort").alias("effort"), F.max("tier").alias("tier"), *[F.count_if(F.col("choice") == k).alias(f"n_{k}") for k in kinds], F.count_if((F.col("choice") == "inter") & (F.col("part") == 3)).alias("n_8x8"), F.count_if(F.col("reference") == 1).alias("n_second"))


CATALOG = {
    "q_macroblock_choices": (choices, None),
    "q_row_effort": (row_effort, None),
}
