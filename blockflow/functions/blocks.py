"""Block mathematics on ARRAY<INT> columns, by built-in functions: distances, transforms, quantisers.

Arrays are at most a macroblock (256 samples), so every expression has bounded cost a
row and no operator here shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import CORE, HADAMARD, NORM_ADJUST, QUANT_MF, ZIGZAG, position_class


def array_of(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, v: s + v)


def sad(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def ssd(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def residual(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def split4(px: Column, width: int) -> Column:
    """The 4x4 blocks of a square block, in raster order, each in raster order."""
    n = width // 4
    return F.array(*[F.array(*[px[(br * 4 + r) * width + bc * 4 + c] for r in range(4) for c in range(4)]) for br in range(n) for bc in range(n)])


def _butterfly(rows: tuple[tuple[int, ...], ...], x: list[Column]) -> list[Column]:
    """One pass of a 4-point transform as sums and differences, multiplications by 2 as shifts."""
    s0, s1, d0, d1 = x[0] + x[3], x[1] + x[2], x[0] - x[3], x[1] - x[2]
    if rows is CORE:
        return [s0 + s1, 2 * d0 + d1, s0 - s1, d0 - 2 * d1]
    return [s0 + s1, d0 + d1, s0 - s1, d0 - d1]


def _passes(rows: tuple[tuple[int, ...], ...], block: Column) -> Column:
    """Rows in a first array, columns in a second: each intermediate is computed once, bound by a one-element transform."""
    first = F.array(*[y for i in range(4) for y in _butterfly(rows, [block[4 * i + j] for j in range(4)])])

    def columns(mid: Column) -> Column:
        cols = [_butterfly(rows, [mid[4 * i + j] for i in range(4)]) for j in range(4)]
        return F.array(*[cols[j][i] for i in range(4) for j in range(4)])

    return F.transform(F.array(first), columns)[0]


def dct4x4(block: Column) -> Column:
    return _passes(CORE, block)


def hadamard4x4(block: Column) -> Column:
    return _passes(HADAMARD, block)


def satd4x4(res: Column) -> Column:
    return F.shiftright(total(F.transform(hadamard4x4(res), F.abs)) + 1, 1)


def satd(res: Column, width: int) -> Column:
    """Sum over the 4x4 blocks, each rounded by itself."""
    return total(F.transform(split4(res, width), satd4x4))


def variance_scaled(px: Column, n: int) -> Column:
    """n * sum of squares - square of the sum."""
    return n * total(F.transform(px, lambda x: x * x)).cast("long") - F.pow(total(px), F.lit(2)).cast("long")


def by_class(table, qp: Column) -> Column:
    """The 16 factors of a block for a QP."""
    return F.array(*[array_of([row[position_class(k)] for k in range(16)]) for row in table])[qp % 6]


def quant4x4(coef: Column, qp: Column) -> Column:
    shift = F.lit(15) + F.floor(qp / 6).cast("int")
    half = F.expr("1L").cast("long") * F.pow(F.lit(2), shift - 1).cast("long")
    size = F.pow(F.lit(2), shift).cast("long")
    q = lambda v, m: (F.signum(v).cast("int") * F.floor((F.abs(v).cast("long") * m + half) / size)).cast("int")  # noqa: E731  exact: below 2^53
    return F.zip_with(coef, by_class(QUANT_MF, qp), q)


def dequant4x4(level: Column, qp: Column) -> Column:
    scale = F.pow(F.lit(2), F.floor(qp / 6)).cast("int")
    return F.zip_with(level, by_class(NORM_ADJUST, qp), lambda v, m: v * m * scale)


def _inverse(x: list[Column]) -> list[Column]:
    e, f = x[0] + x[2], x[0] - x[2]
    g, h = F.shiftright(x[1], 1) - x[3], x[1] + F.shiftright(x[3], 1)
    return [e + h, f + g, f - g, e - h]


def idct4x4(coef: Column) -> Column:
    """Decoder-exact inverse with rounding (x + 32) >> 6."""
    first = F.array(*[y for i in range(4) for y in _inverse([coef[4 * i + j] for j in range(4)])])

    def columns(mid: Column) -> Column:
        cols = [_inverse([mid[4 * i + j] for i in range(4)]) for j in range(4)]
        return F.array(*[F.shiftright(cols[j][i] + 32, 6) for i in range(4) for j in range(4)])

    return F.transform(F.array(first), columns)[0]


def zigzag(block: Column) -> Column:
    return F.transform(array_of(ZIGZAG), lambda i: block[i])


def clamp(x: Column, lo: int, hi: int) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def bits_of(v: Column, n: int) -> Column:
    return F.lpad(F.bin(v), n, "0")


def ue(n: Column) -> Column:
    """Exp-Golomb code of n >= 0 as a bit string."""
    b = F.bin(n + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(b) - 1), b)


def se(v: Column) -> Column:
    return ue(F.when(v > 0, 2 * v - 1).otherwise(-2 * v))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def emulation_prevention(data: Column) -> Column:
    """A binary with a 3 put before each byte of at most 3 that follows two zeros. Bytes stand as the characters of ISO 8859-1."""
    text = F.decode(data, "ISO-8859-1")
    return F.encode(F.regexp_replace(text, "\\x00\\x00(?=[\\x00-\\x03])", "\x00\x00\x03"), "ISO-8859-1")
