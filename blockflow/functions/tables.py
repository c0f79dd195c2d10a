"""Fixed values of the H.264 constrained baseline format, and the constants of the control loop."""

from __future__ import annotations

# Quantiser multipliers and normalisation, by qp % 6, for the position classes 0, 1, 2.
QUANT_MF = ((13107, 8066, 5243), (11916, 7490, 4660), (10082, 6554, 4194), (9362, 5825, 3647), (8192, 5243, 3355), (7282, 4559, 2893))
NORM_ADJUST = ((10, 13, 16), (11, 14, 18), (13, 16, 20), (14, 18, 23), (16, 20, 25), (18, 23, 29))
# Zig-zag order of a 4x4 block.
ZIGZAG = (0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15)
# Chroma QP by luma QP.
CHROMA_QP = (
    0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25,
    26, 27, 28, 29, 29, 30, 31, 32, 32, 33, 34, 34, 35, 35, 36, 36, 37, 37, 37, 38, 38, 38, 39, 39, 39, 39,
)
# level_idc and its largest frame size in macroblocks.
LEVELS = ((10, 99), (11, 396), (12, 396), (13, 396), (20, 396), (21, 792), (22, 1620), (30, 1620), (31, 3600), (32, 5120), (40, 8192), (41, 8192), (42, 8704), (50, 22080), (51, 36864), (52, 36864))
# Rungs of the adaptation ladders, best first.
RESOLUTIONS = ((1920, 1080, "1080p"), (1600, 900, "900p"), (1280, 720, "720p"), (960, 540, "540p"), (640, 360, "360p"))
FPS = (60, 30, 15)


def position_class(k: int) -> int:
    return (k % 4 & 1) + (k // 4 & 1)


def chroma_qp(qp: int) -> int:
    return CHROMA_QP[qp]


#: Rows of the forward 4x4 core transform and of the 4-point Hadamard transform.
CORE = ((1, 1, 1, 1), (2, 1, -1, -2), (1, -1, -1, 1), (1, -2, 2, -1))
HADAMARD = ((1, 1, 1, 1), (1, 1, -1, -1), (1, -1, -1, 1), (1, -1, 1, -1))


def two_sided(rows: tuple[tuple[int, ...], ...]) -> list[list[int]]:
    """The 16x16 matrix that applies `rows` to the columns and the rows of a 4x4 block in raster order."""
    return [[rows[u][i] * rows[v][j] for i in range(4) for j in range(4)] for u in range(4) for v in range(4)]


# The Lagrange factor for absolute differences by QP.
LAMBDA_SAD = (
    1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 3, 3, 3, 3, 3, 3, 2,
    2, 2, 2, 2, 2, 6, 6, 6, 6, 6, 6, 8, 8, 8, 8, 8, 8, 10, 10, 10, 10, 10, 10, 10, 10, 10,
)
#: The factor for transformed differences, by its formula.
LAMBDA_SATD = tuple(max(1, int(0.85 * 2 ** ((q - 12) / 3) + 0.5)) for q in range(52))
# Base functions (lines) at the four samples, times 4, of the encoder's own inverse transform.
_BASE = ((4, 4, 4, 4), (4, 2, -2, -4), (4, -4, -4, 4), (4, -2, 2, -4))
#: That transform as a 16x16 matrix, times 16: rows are samples, columns coefficients.
INVERSE = [[_BASE[v][y] * _BASE[u][x] for v in range(4) for u in range(4)] for y in range(4) for x in range(4)]
