"""Variable-length code tables of the H.264 entropy coder, as bit strings."""

from __future__ import annotations

# coeff_token by total coefficients (lines, from 0) and trailing ones (columns, from 0), as (value, bits); 0 <= nC < 2.
TOKEN_0 = (
    ((1, 1),),
    ((5, 6), (1, 2),),
    ((7, 8), (4, 6), (1, 3),),
    ((7, 9), (6, 8), (5, 7), (3, 5),),
    ((7, 10), (6, 9), (5, 8), (3, 6),),
    ((7, 11), (6, 10), (5, 9), (4, 7),),
    ((15, 13), (6, 11), (5, 10), (4, 8),),
    ((11, 13), (14, 13), (5, 11), (4, 9),),
    ((8, 13), (10, 13), (13, 13), (4, 10),),
    ((15, 14), (14, 14), (9, 13), (4, 11),),
    ((11, 14), (10, 14), (13, 14), (12, 13),),
    ((15, 15), (14, 15), (9, 14), (12, 14),),
    ((11, 15), (10, 15), (13, 15), (8, 14),),
    ((15, 16), (1, 15), (9, 15), (12, 15),),
    ((11, 16), (14, 16), (13, 16), (8, 15),),
    ((7, 16), (10, 16), (9, 16), (12, 16),),
    ((4, 16), (6, 16), (5, 16), (8, 16),),
)
# The same for 2 <= nC < 4.
TOKEN_2 = (
    ((3, 2),),
    ((11, 6), (2, 2),),
    ((7, 6), (7, 5), (3, 3),),
    ((7, 7), (10, 6), (9, 6), (5, 4),),
    ((7, 8), (6, 6), (5, 6), (4, 4),),
    ((4, 8), (6, 7), (5, 7), (6, 5),),
    ((7, 9), (6, 8), (5, 8), (8, 6),),
    ((15, 11), (6, 9), (5, 9), (4, 6),),
    ((11, 11), (14, 11), (13, 11), (4, 7),),
    ((15, 12), (10, 11), (9, 11), (4, 9),),
    ((11, 12), (14, 12), (13, 12), (12, 11),),
    ((8, 12), (10, 12), (9, 12), (8, 11),),
    ((15, 13), (14, 13), (13, 13), (12, 12),),
    ((11, 13), (10, 13), (9, 13), (12, 13),),
    ((7, 13), (11, 14), (6, 13), (8, 13),),
    ((9, 14), (8, 14), (10, 14), (1, 13),),
    ((7, 14), (6, 14), (5, 14), (4, 14),),
)
# The same for 4 <= nC < 8.
TOKEN_4 = (
    ((15, 4),),
    ((15, 6), (14, 4),),
    ((11, 6), (15, 5), (13, 4),),
    ((8, 6), (12, 5), (14, 5), (12, 4),),
    ((15, 7), (10, 5), (11, 5), (11, 4),),
    ((11, 7), (8, 5), (9, 5), (10, 4),),
    ((9, 7), (14, 6), (13, 6), (9, 4),),
    ((8, 7), (10, 6), (9, 6), (8, 4),),
    ((15, 8), (14, 7), (13, 7), (13, 5),),
    ((11, 8), (14, 8), (10, 7), (12, 6),),
    ((15, 9), (10, 8), (13, 8), (12, 7),),
    ((11, 9), (14, 9), (9, 8), (12, 8),),
    ((8, 9), (10, 9), (13, 9), (8, 8),),
    ((13, 10), (7, 9), (9, 9), (12, 9),),
    ((9, 10), (12, 10), (11, 10), (10, 10),),
    ((5, 10), (8, 10), (7, 10), (6, 10),),
    ((1, 10), (4, 10), (3, 10), (2, 10),),
)
# The same for chroma DC.
TOKEN_DC = (
    ((1, 2),),
    ((7, 6), (1, 1),),
    ((4, 6), (6, 6), (1, 3),),
    ((3, 6), (3, 7), (2, 7), (5, 6),),
    ((2, 6), (3, 8), (2, 8), (0, 7),),
)
# total_zeros by total coefficients (lines, from 1) and zeros (columns, from 0).
ZEROS = (
    ((1, 1), (3, 3), (2, 3), (3, 4), (2, 4), (3, 5), (2, 5), (3, 6), (2, 6), (3, 7), (2, 7), (3, 8), (2, 8), (3, 9), (2, 9), (1, 9),),
    ((7, 3), (6, 3), (5, 3), (4, 3), (3, 3), (5, 4), (4, 4), (3, 4), (2, 4), (3, 5), (2, 5), (3, 6), (2, 6), (1, 6), (0, 6),),
    ((5, 4), (7, 3), (6, 3), (5, 3), (4, 4), (3, 4), (4, 3), (3, 3), (2, 4), (3, 5), (2, 5), (1, 6), (1, 5), (0, 6),),
    ((3, 5), (7, 3), (5, 4), (4, 4), (6, 3), (5, 3), (4, 3), (3, 4), (3, 3), (2, 4), (2, 5), (1, 5), (0, 5),),
    ((5, 4), (4, 4), (3, 4), (7, 3), (6, 3), (5, 3), (4, 3), (3, 3), (2, 4), (1, 5), (1, 4), (0, 5),),
    ((1, 6), (1, 5), (7, 3), (6, 3), (5, 3), (4, 3), (3, 3), (2, 3), (1, 4), (1, 3), (0, 6),),
    ((1, 6), (1, 5), (5, 3), (4, 3), (3, 3), (3, 2), (2, 3), (1, 4), (1, 3), (0, 6),),
    ((1, 6), (1, 4), (1, 5), (3, 3), (3, 2), (2, 2), (2, 3), (1, 3), (0, 6),),
    ((1, 6), (0, 6), (1, 4), (3, 2), (2, 2), (1, 3), (1, 2), (1, 5),),
    ((1, 5), (0, 5), (1, 3), (3, 2), (2, 2), (1, 2), (1, 4),),
    ((0, 4), (1, 4), (1, 3), (2, 3), (1, 1), (3, 3),),
    ((0, 4), (1, 4), (1, 2), (1, 1), (1, 3),),
    ((0, 3), (1, 3), (1, 1), (1, 2),),
    ((0, 2), (1, 2), (1, 1),),
    ((0, 1), (1, 1),),
)
# The same for chroma DC.
ZEROS_DC = (
    ((1, 1), (1, 2), (1, 3), (0, 3),),
    ((1, 1), (1, 2), (0, 2),),
    ((1, 1), (0, 1),),
)
# run_before by zeros left (lines, from 1; the last for 7 and more) and run (columns, from 0).
RUN_BEFORE = (
    ((1, 1), (0, 1),),
    ((1, 1), (1, 2), (0, 2),),
    ((3, 2), (2, 2), (1, 2), (0, 2),),
    ((3, 2), (2, 2), (1, 2), (1, 3), (0, 3),),
    ((3, 2), (2, 2), (3, 3), (2, 3), (1, 3), (0, 3),),
    ((3, 2), (0, 3), (1, 3), (3, 3), (2, 3), (5, 3), (4, 3),),
    ((7, 3), (6, 3), (5, 3), (4, 3), (3, 3), (2, 3), (1, 3), (1, 4), (1, 5), (1, 6), (1, 7), (1, 8), (1, 9), (1, 10), (1, 11),),
)
# Coded block patterns in the order of their code numbers, for intra 4x4 and for inter macroblocks.
CBP_INTRA = (47, 31, 15, 0, 23, 27, 29, 30, 7, 11, 13, 14, 39, 43, 45, 46, 16, 3, 5, 10, 12, 19, 21, 26, 28, 35, 37, 42, 44, 1, 2, 4, 8, 17, 18, 20, 24, 6, 9, 22, 25, 32, 33, 34, 36, 40, 38, 41)
CBP_INTER = (0, 16, 1, 2, 4, 8, 32, 3, 5, 10, 12, 15, 47, 7, 11, 13, 14, 6, 9, 31, 35, 37, 42, 44, 33, 34, 36, 40, 39, 43, 45, 46, 17, 18, 20, 24, 19, 21, 26, 28, 23, 27, 29, 30, 22, 25, 38, 41)


def codes(table: tuple[tuple[tuple[int, int], ...], ...]) -> list[list[str]]:
    """Lines of (value, bits) as lines of bit strings."""
    return [[format(value, f"0{bits}b") for value, bits in line] for line in table]


def fixed_token(total: int, ones: int) -> str:
    """coeff_token for 8 <= nC: six bits, total - 1 and trailing ones; 000011 for none."""
    return "000011" if total == 0 else format(((total - 1) << 2) | ones, "06b")


#: TOKENS[column][total][ones], columns: nC below 2, 4, 8, from 8 on, and chroma DC.
TOKENS = [*map(codes, (TOKEN_0, TOKEN_2, TOKEN_4)), [[fixed_token(t, o) for o in range(min(t, 3) + 1)] for t in range(17)], codes(TOKEN_DC)]
TOTAL_ZEROS, TOTAL_ZEROS_DC, RUNS = codes(ZEROS), codes(ZEROS_DC), codes(RUN_BEFORE)
