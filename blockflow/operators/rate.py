"""Budgets: quantisers by macroblock from bits spent, slices of equal effort, and chroma DC levels by rate and distortion."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from blockflow.functions import vlc as V
from blockflow.functions.folds import folded
from blockflow.operators import blockmath as M
from blockflow.operators import chains as C
from blockflow.sources import adapters as A

# Proportional gain 2/125, bits of complexity that count as one of error, and the QP steps that are allowed.
GAIN, PER, COMPLEXITY, DOWN, UP = 2, 125, 9, -26, 25
BUDGET = 3_000


def half_even(n: int, d: int) -> int:
    """n / d to the nearest integer, ties to even; d > 0."""
    q, r = divmod(abs(n), d)
    q += 2 * r > d or (2 * r == d and q % 2)
    return q if n >= 0 else -q


class Budget:
    """What a slice has spent; the QP of each macroblock follows the distance from a linear schedule."""

    def __init__(self, bits: int, mbs: int, base: int):
        self.bits, self.mbs, self.base, self.spent, self.last, self.at = bits, mbs, base, 0, None, 0

    def next_qp(self, complexity: int) -> int:
        if not self.bits:
            return self.base
        error = self.spent - self.bits * self.at // self.mbs - (complexity >> COMPLEXITY)
        qp = min(51, max(0, self.base + half_even(GAIN * error, PER * self.mbs)))
        if self.last is not None:
            qp = min(51, max(0, min(max(qp, self.last + DOWN), self.last + UP)))
        self.last = qp
        return qp

    def update(self, bits: int) -> None:
        self.spent += bits
        self.at += 1


def rate_control(spark, d):
    """QP of each macroblock of a frame under a budget; frames of odd number are two slices, each with its share. Variance stands for bits and complexity."""
    m = M.mb_variance(spark, d).selectExpr("cast(frame_idx * 2 + CASE WHEN frame_idx % 2 = 1 THEN mb_idx div 3 ELSE 0 END as bigint) AS stream_id", "mb_idx AS seq", "CASE WHEN frame_idx % 2 = 1 THEN 3 ELSE 6 END AS mbs", "variance")

    def one(state: list, mbs: int, variance: int) -> tuple:
        if not state:
            state.append(Budget(BUDGET * mbs // 6, mbs, 28))
        qp = state[0].next_qp(variance)
        state[0].update(variance % 2_000)
        return (qp,)

    return folded(m, ["mbs", "variance"], "qp int", list, one)


_ERROR = f"(spent - {BUDGET} * mbs // 6 * done // mbs - (variance >> {COMPLEXITY}))"
_SCALED = f"({GAIN} * {_ERROR})"
_DELTA = f"CAST(round_even({_SCALED} / ({PER} * mbs)::DOUBLE, 0) AS INT)"
RATE_SQL = f"""WITH RECURSIVE m AS MATERIALIZED (SELECT frame_idx * 2 + CASE WHEN frame_idx % 2 = 1 THEN mb_idx // 3 ELSE 0 END AS stream_id, mb_idx AS seq, CASE WHEN frame_idx % 2 = 1 THEN mb_idx % 3 ELSE mb_idx END AS k, CASE WHEN frame_idx % 2 = 1 THEN 3 ELSE 6 END AS mbs, variance FROM ({M.MB_VARIANCE_SQL})),
r(stream_id, seq, done, spent, qp) AS (SELECT DISTINCT stream_id, -1, 0, CAST(0 AS BIGINT), NULL::INT FROM m UNION ALL
  SELECT stream_id, seq, done + 1, spent + variance % 2000, CASE WHEN qp IS NULL THEN q ELSE greatest(0, least(51, least(greatest(q, qp - 26), qp + 25))) END FROM (
    SELECT m.stream_id, m.seq, r.done, r.spent, r.qp, m.variance, greatest(0, least(51, 28 + {_DELTA.replace('variance', 'm.variance').replace('mbs', 'm.mbs')})) AS q FROM r JOIN m ON m.stream_id = r.stream_id AND m.k = r.done))
SELECT stream_id, seq, CAST(qp AS INT) AS qp FROM r WHERE seq >= 0"""

# Effort that each macroblock has besides its search, that the first row of a slice has besides, and frames between decisions.
ROW_BASE, TOP_ROW, FRAMES = 8, 64, 8


def cut_rows(effort: list[int], rows: list[int], width: int) -> list[int]:
    """First rows of slices, filled one after another with their share of what is left. Rows that begin a slice now count as the mean of their neighbours."""
    n, k = len(effort), len(rows) - 1
    cost = [e + ROW_BASE * width for e in effort]
    for top in rows[1:k]:
        near = [cost[r] for r in (top - 1, top + 1) if 0 <= r < n]
        cost[top] = (near[0] + near[-1]) // 2
    left, out, row = sum(cost) + (k - 1) * TOP_ROW * width, [0], 0
    for s in range(k - 1):
        share, have, first = left // (k - s), TOP_ROW * width if s else 0, row
        while row < n - (k - 1 - s) and (row == first or have + cost[row] // 2 < share):
            have += cost[row]
            row += 1
        out.append(row)
        left -= have
    return [*out, n]


def effort_partition(spark, d):
    """Slices of rows of equal effort, decided anew after each eight frames; before, of equal height. A frame is twelve macroblocks in a column, a stream forty frames."""
    v = M.mb_variance(spark, d).groupBy(F.expr("mb_id div 12").alias("f")).agg(F.array_sort(F.collect_list(F.struct("mb_id", "variance"))).alias("x")).where("size(x) = 12")
    v = v.selectExpr("f div 40 AS stream_id", "cast(f % 40 as int) AS seq", "transform(x, y -> cast(y.variance % 5000 as int)) AS effort")

    def one(s: dict, effort: list[int]) -> tuple:
        rows = s.setdefault("rows", [0, 4, 8, 12])
        s["sum"] = [a + b for a, b in zip(s.get("sum", [0] * 12), effort)]
        s["n"] = s.get("n", 0) + 1
        if s["n"] == FRAMES:
            s["rows"], s["sum"], s["n"] = cut_rows([e // FRAMES for e in s["sum"]], rows, 1), [0] * 12, 0
        return rows[1], rows[2], max(1, 512 * 12 // 3)

    return folded(v, ["effort"], "second_row int, third_row int, budget int", dict, one)


def dc_bits(levels: tuple[int, ...]) -> int:
    """Length of four chroma DC levels in context-adaptive codes."""
    at = [i for i, v in enumerate(levels) if v]
    if not at:
        return len(V.TOKENS[4][0][0])
    back = [levels[i] for i in reversed(at)]
    ones = next((i for i, v in enumerate(back) if abs(v) != 1), len(back))
    ones, n, zeros = min(3, ones), len(at), at[-1] + 1 - len(at)
    size, suffix = len(V.TOKENS[4][n][ones]) + ones, 0
    for i, v in enumerate(back[ones:]):
        code = (2 * v - 2 if v > 0 else -2 * v - 1) - (2 if i == 0 and ones < 3 else 0)
        if suffix == 0 and 14 <= code < 30:
            size += 19
        elif code >> suffix >= 15:
            size += 28
        else:
            size += (code >> suffix) + 1 + suffix
        suffix = max(1, suffix)
        suffix += suffix < 6 and abs(v) > 3 << suffix - 1
    size += len(V.TOTAL_ZEROS_DC[n - 1][zeros]) if n < 4 else 0
    for i in range(n - 1):
        if zeros > 0:
            run = at[n - 1 - i] - at[n - 2 - i] - 1
            size += len(V.RUNS[min(zeros, 7) - 1][run])
            zeros -= run
    return size


_H2 = np.array(M._H2, np.int64)
LEVEL_MIN, LEVEL_MAX = -2048, 2048
PAIRS, MOVES = tuple(itertools.combinations(range(4), 2)), ((1, 1), (1, -1), (-1, 1), (-1, -1))


def dc_cost(dc: np.ndarray, scale: int, levels: tuple[int, ...], lam: float) -> float:
    """Squared error of the reconstructed DC values plus lambda times the bits."""
    back = (_H2 @ np.array(levels, np.int64) * scale) >> 8
    return float(((back - dc) ** 2).sum()) + lam * dc_bits(levels)


def dc_refined(dc: np.ndarray, scale: int, levels: tuple[int, ...], lam: float, cost_of=dc_cost) -> tuple[tuple[int, ...], float]:
    """Up to three passes over the levels, by two steps then by one, then moves of pairs; only what is strictly better by `cost_of` stays."""
    q, best = list(levels), cost_of(dc, scale, levels, lam)
    bound = lambda v: max(LEVEL_MIN, min(LEVEL_MAX, v))
    for reach in (2, 1, 1):
        changed = False
        for i in range(4):
            own = q[i]
            tries = [(cost_of(dc, scale, (*q[:i], bound(own + s), *q[i + 1 :]), lam), k, bound(own + s)) for k, s in enumerate(s for s in range(-reach, reach + 1) if s)]
            cost, _, value = min(tries)
            if cost < best:
                q[i], best, changed = value, cost, True
        if not changed:
            break
    for (a, b), (da, db) in itertools.product(PAIRS, MOVES):
        t = list(q)
        t[a], t[b] = bound(t[a] + da), bound(t[b] + db)
        cost = cost_of(dc, scale, tuple(t), lam)
        if cost < best:
            q, best = t, cost
    return tuple(q), best


def chroma_dc_refined(spark, d):
    """Chroma DC levels after refinement, and the costs before and after."""
    r = C.chroma_dc_levels(spark, d).select("vec_id", "level").join(M.chroma_dc(spark, d).select("vec_id", "coef"), "vec_id")

    @F.pandas_udf("refined array<int>, before double, after double")
    def run(ids: pd.Series, levels: pd.Series, coefs: pd.Series) -> pd.DataFrame:
        out = []
        for i, level, coef in zip(ids, levels, coefs):
            qp = int(i) % 52
            dc, scale = _H2 @ np.asarray(coef, np.int64), C.DC_SCALE[qp % 6] << (qp // 6 + 2)
            lam = 0.05 * 2.0 ** ((qp - 28) / 6.0)
            first = tuple(int(v) for v in level)
            q, cost = dc_refined(dc, scale, first, lam)
            out.append((list(q), dc_cost(dc, scale, first, lam), cost))
        return pd.DataFrame(out, columns=["refined", "before", "after"])

    return r.withColumn("x", run("vec_id", "level", "coef")).select("vec_id", "x.*")


CATALOG = {
    "q_rate_control": (rate_control, RATE_SQL),
    "q_effort_partition": (effort_partition, None),
    "q_chroma_dc_refined": (chroma_dc_refined, None),
}
