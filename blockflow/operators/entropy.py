"""Entropy coding of residual blocks, contexts, coded patterns, headers and units of the bitstream.

Blocks are coded inside their rows by folds over at most 16 levels; only the neighbour contexts
shuffle, by frame and line of blocks. Bits are strings of 0 and 1 until a unit is packed to bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from blockflow.functions import blocks as B
from blockflow.functions import tables as T
from blockflow.functions import vlc as V
from blockflow.operators import bits as S
from blockflow.operators import blockmath as M
from blockflow.operators import chains as C
from blockflow.sources import adapters as A


def _flat(table: list[list[str]], width: int) -> list[str]:
    return [x for line in table for x in [*line, *[""] * (width - len(line))]]


def _lookup(table: list[list[str]], width: int, line: Column, column: Column) -> Column:
    """table[line][column] of a small constant table."""
    return F.get(F.array(*map(F.lit, _flat(table, width))), line * width + column)


def scanned(z: Column) -> list[Column]:
    """Of scanned levels: the places of the non-zero ones, and these in reverse order."""
    at = F.filter(F.transform(z, lambda v, i: F.when(v != 0, i)), lambda i: i.isNotNull())
    return [at.alias("at"), F.reverse(F.transform(at, lambda i: F.get(z, i))).alias("levels")]


def _suffix(code: Column, length: Column) -> tuple[Column, Column, Column]:
    """(prefix, suffix, suffix bits) of a level code."""
    prefix = F.call_function("shiftright", code, length)
    low = code - F.call_function("shiftleft", prefix, length)
    small = (length == 0) & (prefix >= 14) & (prefix < 30)
    large = ~small & (prefix >= 15)
    top = code - F.call_function("shiftleft", F.lit(15), length) - F.when(length == 0, 15).otherwise(0)
    return F.when(small, 14).when(large, 15).otherwise(prefix), F.when(small, code - 14).when(large, top).otherwise(low), F.when(small, 4).when(large, 12).otherwise(length)


def level_bits(levels: Column, ones: Column) -> Column:
    """Prefix and suffix of the levels behind the trailing ones; the suffix grows with the levels."""
    start = F.when((F.size(levels) > 10) & (ones < 3), 1).otherwise(0)

    def step(acc, v):
        sl = acc["sl"]
        code = F.when(v > 0, 2 * v - 2).otherwise(-2 * v - 1) - F.when(acc["first"] & (ones < 3), 2).otherwise(0)
        prefix, suffix, n = _suffix(code, sl)
        tail = F.when(n > 0, F.lpad(F.bin(suffix), n, "0")).otherwise("")
        one = F.greatest(sl, F.lit(1))
        grown = one + F.when((one < 6) & (F.abs(v) > F.call_function("shiftleft", F.lit(3), one - 1)), 1).otherwise(0)
        return F.struct(grown.alias("sl"), F.lit(False).alias("first"), F.concat(acc["bits"], F.repeat(F.lit("0"), prefix), F.lit("1"), tail).alias("bits"))

    zero = F.struct(start.alias("sl"), F.lit(True).alias("first"), F.lit("").alias("bits"))
    return F.aggregate(F.slice(levels, ones + 1, F.greatest(F.size(levels) - ones, F.lit(0))), zero, step)["bits"]


def run_bits(runs: Column, zeros: Column) -> Column:
    """run_before of all levels but the last, while zeros are left."""

    def step(acc, r):
        left = acc["left"]
        code = F.when(left > 0, _lookup(V.RUNS, 15, F.least(left, F.lit(7)) - 1, r)).otherwise("")
        return F.struct((left - r).alias("left"), F.concat(acc["bits"], code).alias("bits"))

    return F.aggregate(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.struct(zeros.alias("left"), F.lit("").alias("bits")), step)["bits"]


def residual(rows, z: str, nc: str, dc: bool = False, size: int = 16):
    """rows with total_coeff, trailing_ones, total_zeros, bits: a scanned block of `size` levels in context-adaptive codes. nc: context (chroma DC has none)."""
    most = 4 if dc else size
    rows = rows.withColumns({c: e for c, e in zip(("_at", "_levels"), scanned(F.col(z)))})
    runs = F.reverse(F.transform("_at", lambda i, k: i - F.coalesce(F.when(k > 0, F.get("_at", k - 1)), F.lit(-1)) - 1))
    big = F.array_min(F.filter(F.transform("_levels", lambda v, k: F.when(F.abs(v) != 1, k)), lambda k: k.isNotNull()))
    n = F.size("_levels")
    rows = rows.withColumn("_runs", runs).withColumn("total_coeff", n).withColumn("trailing_ones", F.least(F.lit(3), F.coalesce(big, n))).withColumn("total_zeros", F.when(n > 0, F.get("_at", n - 1) + 1 - n).otherwise(0))
    total, ones = F.col("total_coeff"), F.col("trailing_ones")
    column = F.lit(4) if dc else F.when(F.col(nc) < 2, 0).when(F.col(nc) < 4, 1).when(F.col(nc) < 8, 2).otherwise(3)
    flat = [x for table in V.TOKENS for x in [*_flat(table, 4), *[""] * (68 - 4 * len(table))]]
    token = F.get(F.array(*map(F.lit, flat)), column * 68 + total * 4 + ones)
    signs = F.array_join(F.transform(F.slice("_levels", 1, ones), lambda v: F.when(v < 0, "1").otherwise("0")), "")
    zeros = F.when(total < most, _lookup(V.TOTAL_ZEROS_DC if dc else V.TOTAL_ZEROS, 4 if dc else 16, total - 1, F.col("total_zeros"))).otherwise("")
    bits = F.concat(token, signs, level_bits(F.col("_levels"), ones), zeros, run_bits(F.col("_runs"), F.col("total_zeros")))
    return rows.withColumn("bits", F.when(total == 0, token).otherwise(bits)).drop("_at", "_levels", "_runs")


def _list(values) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


def residual_sql(source: str, dc: bool = False, size: int = 16) -> str:
    """(all columns of source, total_coeff, trailing_ones, total_zeros, bits) of source's z and nc, as folds over lists of structs."""
    most, width, lines = (4, 4, V.TOTAL_ZEROS_DC) if dc else (size, 16, V.TOTAL_ZEROS)
    column = "4" if dc else "CASE WHEN nc < 2 THEN 0 WHEN nc < 4 THEN 1 WHEN nc < 8 THEN 2 ELSE 3 END"
    token = _list([x for table in V.TOKENS for x in [*_flat(table, 4), *[""] * (68 - 4 * len(table))]])
    code = "(CASE WHEN x.v > 0 THEN 2 * x.v - 2 ELSE -2 * x.v - 1 END - CASE WHEN a.first AND x.t1 < 3 THEN 2 ELSE 0 END)"
    esc = f"CASE WHEN a.sl = 0 AND {code} >= 14 AND {code} < 30 THEN 's' WHEN {code} >> a.sl >= 15 THEN 'l' ELSE '' END"
    one_level = f"""CASE {esc} WHEN 's' THEN repeat('0', 14) || '1' || lpad(bin({code} - 14), 4, '0') WHEN 'l' THEN repeat('0', 15) || '1' || lpad(bin({code} - (15 << a.sl) - CASE WHEN a.sl = 0 THEN 15 ELSE 0 END), 12, '0')
      ELSE repeat('0', {code} >> a.sl) || '1' || CASE WHEN a.sl > 0 THEN lpad(bin({code} & ((1 << a.sl) - 1)), a.sl, '0') ELSE '' END END"""
    one = "greatest(a.sl, 1)"
    return f"""SELECT * EXCLUDE (z_at, lv, rn, lev, rb), CASE WHEN total_coeff = 0 THEN '' ELSE lev.bits || CASE WHEN total_coeff < {most} THEN {_list(_flat(lines, width))}[(total_coeff - 1) * {width} + total_zeros + 1] ELSE '' END || rb.bits END AS rest,
  {token}[({column}) * 68 + total_coeff * 4 + trailing_ones + 1] || array_to_string(list_transform(lv[1:trailing_ones], lambda v: CASE WHEN v < 0 THEN '1' ELSE '0' END), '') || rest AS bits FROM (
SELECT *, list_reduce(list_transform(lv[trailing_ones + 1:], lambda v: {{'sl': 0, 'first': false, 'v': v, 't1': trailing_ones, 'bits': ''}}), lambda a, x: {{'sl': CAST({one} + CASE WHEN {one} < 6 AND abs(x.v) > (3 << ({one} - 1)) THEN 1 ELSE 0 END AS INT), 'first': false, 'v': x.v, 't1': x.t1, 'bits': a.bits || {one_level}}},
    {{'sl': CASE WHEN total_coeff > 10 AND trailing_ones < 3 THEN 1 ELSE 0 END, 'first': true, 'v': 0, 't1': 0, 'bits': ''}}) AS lev,
  list_reduce(list_transform(rn[:greatest(total_coeff - 1, 0)], lambda r: {{'left': r, 'bits': ''}}), lambda a, x: {{'left': a.left - x.left, 'bits': a.bits || CASE WHEN a.left > 0 THEN {_list(_flat(V.RUNS, 15))}[(least(a.left, 7) - 1) * 15 + x.left + 1] ELSE '' END}}, {{'left': total_zeros, 'bits': ''}}) AS rb FROM (
SELECT *, CAST(len(lv) AS INT) AS total_coeff, CAST(least(3, coalesce(list_position(list_transform(lv, lambda v: abs(v) <> 1), true) - 1, len(lv))) AS INT) AS trailing_ones, CAST(CASE WHEN len(lv) > 0 THEN z_at[-1] - len(lv) ELSE 0 END AS INT) AS total_zeros FROM (
SELECT *, list_reverse(list_transform(z_at, lambda i: z[i])) AS lv, list_reverse(list_transform(range(1, CAST(len(z_at) + 1 AS BIGINT)), lambda k: CAST(z_at[k] - CASE WHEN k > 1 THEN z_at[k - 1] ELSE 0 END - 1 AS INT))) AS rn FROM (
SELECT *, list_filter(range(1, CAST(len(z) + 1 AS BIGINT)), lambda i: z[i] <> 0) AS z_at FROM ({source})))))"""


#: A frame is 12 x 8 blocks of 4x4; frames of odd number have a slice for each row of macroblocks.
_COL4, _ROW4 = "mb_idx % 3 * 4 + k % 2 * 2 + blk % 2", "mb_idx {d} 3 * 4 + k {d} 2 * 2 + blk {d} 2"
_PLACE = "vec_id {d} 24 AS frame_idx, vec_id {d} 4 % 6 AS mb_idx, vec_id % 4 AS k"


def counted(spark, d):
    """frame_idx, row4, col4, vec_id, blk, z, n: scanned levels of every 4x4 block of the frames and their number."""
    q = M.quant(spark, d).select("vec_id", "blk", "qp", B.zigzag(F.col("level")).alias("z"))
    q = q.selectExpr("*", *_PLACE.format(d="div").split(", "))
    return q.selectExpr("frame_idx", "mb_idx", f"cast({_ROW4.format(d='div')} as int) AS row4", f"cast({_COL4} as int) AS col4", "vec_id", "blk", "qp", "z", "size(filter(z, v -> v <> 0)) AS n")


COUNTED_SQL = f"""SELECT frame_idx, mb_idx, CAST({_ROW4.format(d='//')} AS INT) AS row4, CAST({_COL4} AS INT) AS col4, vec_id, blk, qp, z, CAST(len(list_filter(z, lambda v: v <> 0)) AS INT) AS n FROM (
  SELECT vec_id, blk, qp, {_PLACE.format(d='//')}, list_transform({list(T.ZIGZAG)}, lambda i: level[i + 1]) AS z FROM ({M.QUANT_SQL}))"""


def contexts(spark, d):
    """counted() with nc: the mean of the left and the upper count, rounded up, the one that is there, or 0. Other slices are not there."""
    left = F.lag("n").over(Window.partitionBy("frame_idx", "row4").orderBy("col4"))
    up = F.lag("n").over(Window.partitionBy("frame_idx", "col4").orderBy("row4"))
    r = counted(spark, d).withColumn("a", left).withColumn("b", F.when((F.col("frame_idx") % 2 == 0) | (F.col("row4") % 4 > 0), up))
    return r.withColumn("nc", F.coalesce(F.shiftright(F.col("a") + F.col("b") + 1, 1), "a", "b", F.lit(0))).drop("a", "b")


CONTEXT_SQL = f"""SELECT m.*, CASE WHEN a.n IS NULL THEN coalesce(b.n, 0) WHEN b.n IS NULL THEN a.n ELSE (a.n + b.n + 1) >> 1 END AS nc FROM ({COUNTED_SQL}) m
  LEFT JOIN ({COUNTED_SQL}) a ON a.frame_idx = m.frame_idx AND a.row4 = m.row4 AND a.col4 = m.col4 - 1
  LEFT JOIN ({COUNTED_SQL}) b ON b.frame_idx = m.frame_idx AND b.row4 = m.row4 - 1 AND b.col4 = m.col4 AND (m.frame_idx % 2 = 0 OR b.row4 // 4 = m.row4 // 4)"""


def coefficient_context(spark, d):
    return contexts(spark, d).select("vec_id", "blk", "n", "nc")


def cavlc(spark, d):
    """Bits of every 4x4 block in its context."""
    return residual(contexts(spark, d), "z", "nc").select("vec_id", "blk", "total_coeff", "trailing_ones", "total_zeros", "bits")


def cavlc_chroma_dc(spark, d):
    """Bits of the four chroma DC levels, and their number."""
    r = residual(C.chroma_dc_levels(spark, d).select("vec_id", F.col("level").alias("z")), "z", "", dc=True)
    return r.select("vec_id", "bits", F.length("bits").alias("n_bits"))


def level_trace(spark, d):
    """The steps of level coding: each level behind the trailing ones with its code and the suffix length it met."""
    r = counted(spark, d).select("vec_id", "blk", F.reverse(F.filter("z", lambda v: v != 0)).alias("lv"))
    big = F.array_min(F.filter(F.transform("lv", lambda v, k: F.when(F.abs(v) != 1, k)), lambda k: k.isNotNull()))
    r = r.withColumn("ones", F.least(F.lit(3), F.coalesce(big, F.size("lv"))))
    none = F.expr("cast(array() AS array<struct<level:int,level_code:int,suffix_length:int>>)")
    start = F.struct(F.when((F.size("lv") > 10) & (F.col("ones") < 3), 1).otherwise(0).alias("sl"), none.alias("out"))

    def step(acc, v):
        sl, one = acc["sl"], F.greatest(acc["sl"], F.lit(1))
        code = F.when(v > 0, 2 * v - 2).otherwise(-2 * v - 1) - F.when((F.size(acc["out"]) == 0) & (F.col("ones") < 3), 2).otherwise(0)
        grown = one + F.when((one < 6) & (F.abs(v) > F.call_function("shiftleft", F.lit(3), one - 1)), 1).otherwise(0)
        return F.struct(grown.alias("sl"), F.concat(acc["out"], F.array(F.struct(v.alias("level"), code.alias("level_code"), sl.alias("suffix_length")))).alias("out"))

    rest = F.slice("lv", F.col("ones") + 1, F.greatest(F.size("lv") - F.col("ones"), F.lit(0)))
    r = r.withColumn("steps", F.aggregate(rest, start, step)["out"])
    return r.select("vec_id", "blk", F.posexplode("steps").alias("step", "s")).select("vec_id", "blk", "step", "s.*")


TRACE_SQL = f"""WITH RECURSIVE b AS MATERIALIZED (SELECT vec_id, blk, trailing_ones AS t1, total_coeff AS n, list_reverse(list_filter(z, lambda v: v <> 0)) AS lv FROM ({residual_sql(f'SELECT *, 0 AS nc FROM ({COUNTED_SQL})')})),
r(vec_id, blk, t1, n, lv, step, sl) AS (SELECT vec_id, blk, t1, n, lv, 0, CASE WHEN n > 10 AND t1 < 3 THEN 1 ELSE 0 END FROM b WHERE n > t1 UNION ALL
  SELECT vec_id, blk, t1, n, lv, step + 1, greatest(sl, 1) + CASE WHEN greatest(sl, 1) < 6 AND abs(lv[t1 + step + 1]) > (3 << (greatest(sl, 1) - 1)) THEN 1 ELSE 0 END FROM r WHERE t1 + step + 1 < n)
SELECT vec_id, blk, step, lv[t1 + step + 1] AS level, CASE WHEN lv[t1 + step + 1] > 0 THEN 2 * lv[t1 + step + 1] - 2 ELSE -2 * lv[t1 + step + 1] - 1 END - CASE WHEN step = 0 AND t1 < 3 THEN 2 ELSE 0 END AS level_code, sl AS suffix_length FROM r"""


def coded_pattern(spark, d):
    """Coded block pattern of each macroblock: a bit for each 8x8 with a level; chroma 2 with AC, 1 with only DC levels; its code numbers."""
    r = counted(spark, d).groupBy("frame_idx", "mb_idx").agg(F.bit_or(F.when(F.col("n") > 0, F.call_function("shiftleft", F.lit(1), (F.col("vec_id") % 4).cast("int"))).otherwise(0)).alias("luma"),
        F.max(F.when(F.col("vec_id") % 4 == 0, F.exists(F.slice("z", 2, 15), lambda v: v != 0))).alias("ac"), F.max(F.when(F.col("vec_id") % 4 == 0, F.get("z", F.lit(0)) != 0)).alias("dc"))
    r = r.withColumn("cbp", (F.col("luma") + 16 * F.when(F.col("ac"), 2).when(F.col("dc"), 1).otherwise(0)).cast("int"))
    code = lambda order: F.get(B.array_of([order.index(k) for k in range(48)]), F.col("cbp"))
    return r.select("frame_idx", "mb_idx", "cbp", code(V.CBP_INTRA).alias("intra_code"), code(V.CBP_INTER).alias("inter_code"))


CBP_SQL = f"""SELECT frame_idx, mb_idx, cbp, CAST(list_position({list(V.CBP_INTRA)}, cbp) - 1 AS INT) AS intra_code, CAST(list_position({list(V.CBP_INTER)}, cbp) - 1 AS INT) AS inter_code FROM (
  SELECT frame_idx, mb_idx, CAST(sum(DISTINCT CASE WHEN n > 0 THEN 1 << CAST(vec_id % 4 AS INT) ELSE 0 END) + 16 * max(CASE WHEN vec_id % 4 <> 0 THEN 0 WHEN len(list_filter(z[2:], lambda v: v <> 0)) > 0 THEN 2 WHEN z[1] <> 0 THEN 1 ELSE 0 END) AS INT) AS cbp FROM ({COUNTED_SQL}) GROUP BY frame_idx, mb_idx)"""

# Headers: the same text runs in both engines, so tests read the bits back with a parser of their own.
_SE = S.UE.format(n="(CASE WHEN {v} > 0 THEN 2 * {v} - 1 ELSE -2 * {v} END)")
_TE = "CASE refs WHEN 1 THEN '' WHEN 2 THEN CASE WHEN {v} = 0 THEN '1' ELSE '0' END ELSE " + S.UE.format(n="{v}") + " END"


def _ue(v: str) -> str:
    return S.UE.format(n=f"({v})")


def _se(v: str) -> str:
    return _SE.format(v=f"({v})")


def _joined(*parts: str) -> str:
    return " || ".join(f"({p})" for p in parts)


def _p_header(shape: int) -> str:
    """mb_type, then all references, then all vector differences; for 8x8 the sub-types come first."""
    n = (1, 2, 2, 4)[shape]
    subs = [_ue(f"sub{k}") for k in range(4)] if shape == 3 else []
    refs = [_TE.format(v=f"ref{k}") for k in range(n)]
    if shape < 3:
        return _joined(_ue(str(shape)), *refs, *(_se(f"{c}{k}") for k in range(n) for c in ("dx", "dy")))
    # A sub-type has 1, 2, 2 or 4 vectors; they differ from the first by their number.
    mvds = [f"CASE WHEN sub{k} = 0 AND {p} > 0 OR sub{k} < 3 AND {p} > 1 THEN '' ELSE {_se(f'dx{k} + {p}')} || {_se(f'dy{k} - {p}')} END" for k in range(4) for p in range(4)]
    return _joined(_ue("3"), *subs, *refs, *mvds)


_FIELD_COLUMNS = ", ".join(f"px{k}[{{o}}] - 128 AS dx{k}, px{k}[{{o}} + 1] - 128 AS dy{k}, px{k}[{{o}} + 2] % refs AS ref{k}, px{k}[{{o}} + 3] % 4 AS sub{k}" for k in range(4))
_P_SQL = f"SELECT mb_id, shape, CASE shape WHEN 0 THEN {_p_header(0)} WHEN 1 THEN {_p_header(1)} WHEN 2 THEN {_p_header(2)} ELSE {_p_header(3)} END AS bits FROM ({{source}})"


def p_headers(spark, d):
    """Headers of inter macroblocks of every shape, with one to three references."""
    r = A.macroblocks(spark, d).select("mb_id", *[F.get("parts", F.lit(k)).alias(f"px{k}") for k in range(4)], (F.col("mb_id") % 4).cast("int").alias("shape"), (F.col("mb_id") % 3 + 1).cast("int").alias("refs"))
    r = r.selectExpr("mb_id", "shape", "refs", *_FIELD_COLUMNS.format(o=0).replace("[0 + ", "[").split(", "))
    return spark.sql(_P_SQL.format(source="SELECT * FROM {rows}"), rows=r)


_P_FIELDS_SQL = f"SELECT mb_id, shape, refs, {_FIELD_COLUMNS.format(o=1)} FROM (SELECT mb_id, CAST(mb_id % 4 AS INT) AS shape, CAST(mb_id % 3 + 1 AS INT) AS refs, px[1:64] AS px0, px[65:128] AS px1, px[129:192] AS px2, px[193:256] AS px3 FROM ({A.MACROBLOCKS_SQL}))"


def _slice_header() -> str:
    refs = "CASE WHEN idr THEN '' WHEN n_refs >= 2 THEN '1' || " + _ue("1") + " || '0' ELSE '00' END"
    return _joined(_ue("first_mb"), f"CASE WHEN idr THEN {_ue('2')} ELSE {_ue('0')} END", "'1'", "lpad(bin(frame_num), 4, '0')", f"CASE WHEN idr THEN {_ue('idr_pic_id')} ELSE '' END", refs, "CASE WHEN idr THEN '00' ELSE '0' END", _se("qp_delta"),
        f"CASE filter_idc WHEN 1 THEN {_ue('1')} WHEN 2 THEN {_ue('2')} || '11' ELSE '111' END")


_SLICE_SQL = f"SELECT stream_id, seq, first_mb, {_slice_header()} AS bits FROM ({{source}})"


def slice_header(spark, d):
    """Headers of two slices a picture: I in an IDR, else P with one or two references; filter control 0, 1 and 2."""
    g = S.gop(spark, d).withColumn("idr", F.col("n_refs") == 0).withColumn("first_mb", F.explode(F.array(F.lit(0), F.lit(300))))
    g = g.withColumn("qp_delta", (F.col("seq") % 21 - 10).cast("int")).withColumn("filter_idc", (F.col("seq") % 3).cast("int"))
    return spark.sql(_SLICE_SQL.format(source="SELECT * FROM {rows}"), rows=g)


_SLICE_FIELDS_SQL = f"SELECT *, n_refs = 0 AS idr, unnest([0, 300]) AS first_mb, CAST(seq % 21 - 10 AS INT) AS qp_delta, CAST(seq % 3 AS INT) AS filter_idc FROM ({S.GOP_SQL})"


def _sps() -> str:
    """Constrained baseline, picture order 2, cropping in units of two samples, and colours of BT.601."""
    crop = f"CASE WHEN w = dw AND h = dh THEN '0' ELSE '1' || {_ue('0')} || {_ue('(w - dw) {d} 2')} || {_ue('0')} || {_ue('(h - dh) {d} 2')} END"
    return _joined("lpad(bin(66), 8, '0')", "'11000000'", "lpad(bin(level), 8, '0')", _ue("0"), _ue("0"), _ue("2"), _ue("refs"), "'0'", _ue("w {d} 16 - 1"), _ue("h {d} 16 - 1"), "'11'", crop, "'1' || '00' || '1' || '101' || '0' || '1' || '000001100000011000000110' || '000000'", "'1'")


def _pps() -> str:
    return _joined("'11' || '00' || '111' || '000'", _se("qp - 26"), "'11'", "'1'", "CASE WHEN constrained THEN '1' ELSE '0' END", "'0'", "'1'")


def _sei() -> str:
    body = _joined(_ue("recovery"), "'1000'", "'1'")
    return _joined("'00000110'", f"lpad(bin(cast(ceil(length({body}) / 8.0) as int)), 8, '0')", f"rpad({body}, cast(ceil(length({body}) / 8.0) * 8 as int), '0')", "'1'")


#: Units: type, reference importance and payload bits, padded to bytes.
_UNITS_SQL = "SELECT id, kind, nal_header, rpad(bits, cast(ceil(length(bits) / 8.0) * 8 as int), '0') AS bits FROM (SELECT id, 'sps' AS kind, '67' AS nal_header, {sps} AS bits FROM ({source}) UNION ALL SELECT id, 'pps', '68', {pps} FROM ({source}) UNION ALL SELECT id, 'sei', '06', {sei} FROM ({source}))"


def _units_sql(source: str, div: str) -> str:
    return _UNITS_SQL.format(sps=_sps().replace("{d}", div), pps=_pps(), sei=_sei(), source=source)


def units(rows):
    """rows (hexadecimal nal_header, payload bits) with `unit`: start code, header and payload with emulation prevention, as hexadecimal digits."""
    payload = F.transform(F.sequence(F.lit(1), F.length("bits") - 7, F.lit(8)), lambda i: F.lpad(F.conv(F.substr("bits", i, F.lit(8)), 2, 16), 2, "0"))
    return rows.withColumn("unit", F.lower(F.concat(F.lit("00000001"), "nal_header", F.hex(B.emulation_prevention(F.unhex(F.array_join(payload, "")))))))


def parameter_sets(spark, d):
    """Sequence and picture parameter sets and recovery points as units of the byte stream. Parts stand for configurations."""
    p = A.table(spark, d, "part").selectExpr("p_partkey AS id", "cast(p_partkey % 40 + 1 as int) * 16 AS w", "cast(p_partkey % 30 + 1 as int) * 16 AS h", "cast(p_partkey % 8 as int) * 2 AS cut", "cast(31 + p_partkey % 2 as int) AS level", "cast(p_partkey % 2 + 1 as int) AS refs", "cast(p_partkey % 52 as int) AS qp", "p_partkey % 3 = 0 AS constrained", "cast(p_partkey % 600 as int) AS recovery")
    return units(spark.sql(_units_sql("SELECT * FROM {rows}", "div"), rows=p.selectExpr("*", "w - cut AS dw", "h - cut AS dh"))).select("id", "kind", "unit")


_PARTS_SQL = "SELECT *, w - cut AS dw, h - cut AS dh FROM (SELECT p_partkey AS id, CAST(p_partkey % 40 + 1 AS INT) * 16 AS w, CAST(p_partkey % 30 + 1 AS INT) * 16 AS h, CAST(p_partkey % 8 AS INT) * 2 AS cut, CAST(31 + p_partkey % 2 AS INT) AS level, CAST(p_partkey % 2 + 1 AS INT) AS refs, CAST(p_partkey % 52 AS INT) AS qp, p_partkey % 3 = 0 AS constrained, CAST(p_partkey % 600 AS INT) AS recovery FROM part)"
# Emulation prevention over lists of bytes: two zeros before a byte of at most 3.
PARAMETER_SQL = f"""WITH RECURSIVE u AS MATERIALIZED (SELECT id, kind, nal_header, list_transform(range(0, CAST(length(bits) // 8 AS BIGINT)), lambda i: CAST(list_sum(list_transform(range(8), lambda j: CASE WHEN bits[8 * i + j + 1] = '1' THEN 1 << CAST(7 - j AS INT) ELSE 0 END)) AS INT)) AS b FROM ({_units_sql(_PARTS_SQL, '//')})),
r(id, kind, nal_header, b, i, z, out) AS (SELECT id, kind, nal_header, b, 0, 0, '' FROM u UNION ALL SELECT id, kind, nal_header, b, i + 1, CASE WHEN b[i + 1] <> 0 THEN 0 WHEN z = 2 THEN 1 ELSE z + 1 END, out || CASE WHEN z = 2 AND b[i + 1] <= 3 THEN '03' ELSE '' END || lower(lpad(hex(b[i + 1]), 2, '0')) FROM r WHERE i < len(b))
SELECT id, kind, '00000001' || nal_header || out AS unit FROM r WHERE i = len(b)"""

# Macroblocks of intra 16x16: the DC levels first, then fifteen AC levels of each block in the order of coding.
_Z = ", ".join(str(k) for k in (0, 1, 4, 5, 2, 3, 6, 7, 8, 9, 12, 13, 10, 11, 14, 15))


def intra16_body(spark, d):
    """Bits of an intra 16x16 macroblock: type (mode, chroma 0, whether AC levels follow), chroma mode and QP step, DC levels, AC levels."""
    dc = C.luma_dc_quant(spark, d).select("mb_id", "qp", B.zigzag(F.col("level")).alias("z")).withColumn("nc", F.lit(0))
    dc = residual(dc, "z", "nc").select("mb_id", "qp", F.col("bits").alias("dc_bits"))
    ac = contexts(spark, d).select("frame_idx", "mb_idx", "row4", "col4", F.slice("z", 2, 15).alias("z"), "nc")
    ac = residual(ac, "z", "nc", size=15)
    order = F.get(B.array_of([0, 1, 4, 5, 2, 3, 6, 7, 8, 9, 12, 13, 10, 11, 14, 15]), F.expr("row4 % 4 * 4 + col4 % 4"))
    ac = ac.groupBy("frame_idx", "mb_idx").agg(F.array_sort(F.collect_list(F.struct(order.alias("k"), "bits"))).alias("x"), F.max(F.col("total_coeff") > 0).alias("any"))  # sixteen blocks
    ac = ac.select((F.col("frame_idx") * 6 + F.col("mb_idx")).alias("mb_id"), "any", F.array_join(F.transform("x", lambda b: b["bits"]), "").alias("ac_bits"))
    m = dc.join(ac, "mb_id").withColumn("mb_type", (1 + F.col("mb_id") % 4 + F.when(F.col("any"), 12).otherwise(0)).cast("int"))
    return m.select("mb_id", "mb_type", F.concat(B.ue(F.col("mb_type")), F.lit("1"), B.se((F.col("qp") - 26).cast("int")), "dc_bits", F.when(F.col("any"), F.col("ac_bits")).otherwise("")).alias("bits"))


_DC_Z = f"SELECT mb_id, qp, list_transform({list(T.ZIGZAG)}, lambda i: level[i + 1]) AS z, 0 AS nc FROM ({C.DC_LEVEL_SQL})"
_AC_Z = f"SELECT frame_idx, mb_idx, row4, col4, z[2:16] AS z, nc FROM ({CONTEXT_SQL})"
BODY_SQL = f"""SELECT mb_id, mb_type, {_ue('mb_type')} || '1' || {_se('qp - 26')} || dc_bits || CASE WHEN mb_type > 4 THEN ac_bits ELSE '' END AS bits FROM (SELECT d.mb_id, d.qp, d.bits AS dc_bits, ac_bits, CAST(1 + d.mb_id % 4 + CASE WHEN any_ac THEN 12 ELSE 0 END AS INT) AS mb_type FROM ({residual_sql(_DC_Z)}) d
  JOIN (SELECT frame_idx * 6 + mb_idx AS mb_id, bool_or(total_coeff > 0) AS any_ac, string_agg(bits, '' ORDER BY [{_Z}][row4 % 4 * 4 + col4 % 4 + 1]) AS ac_bits FROM ({residual_sql(_AC_Z, size=15)}) GROUP BY 1) a ON a.mb_id = d.mb_id)"""


def zigzag_round(spark, d):
    """Levels in scan order, and back in raster order."""
    inverse = B.array_of([T.ZIGZAG.index(k) for k in range(16)])
    r = M.quant(spark, d).select("vec_id", "blk", "level", B.zigzag(F.col("level")).alias("z"))
    r = r.withColumn("back", F.transform(inverse, lambda i: F.get("z", i)))
    return r.select("vec_id", "blk", "z", "back", (F.col("back") == F.col("level")).alias("same"))


CATALOG = {
    "q_intra16_body": (intra16_body, BODY_SQL),
    "q_zigzag_round": (zigzag_round, f"SELECT vec_id, blk, list_transform({list(T.ZIGZAG)}, lambda i: level[i + 1]) AS z, level AS back, true AS same FROM ({M.QUANT_SQL})"),
    "q_coefficient_context": (coefficient_context, f"SELECT vec_id, blk, n, nc FROM ({CONTEXT_SQL})"),
    "q_cavlc": (cavlc, f"SELECT vec_id, blk, total_coeff, trailing_ones, total_zeros, bits FROM ({residual_sql(CONTEXT_SQL)})"),
    "q_cavlc_chroma_dc": (cavlc_chroma_dc, f"SELECT vec_id, bits, CAST(length(bits) AS INT) AS n_bits FROM ({residual_sql(f'SELECT vec_id, level AS z, 0 AS nc FROM ({C.CHROMA_LEVEL_SQL})', dc=True)})"),
    "q_level_trace": (level_trace, TRACE_SQL),
    "q_coded_pattern": (coded_pattern, CBP_SQL),
    "q_p_headers": (p_headers, _P_SQL.format(source=_P_FIELDS_SQL)),
    "q_slice_header": (slice_header, _SLICE_SQL.format(source=_SLICE_FIELDS_SQL)),
    "q_parameter_sets": (parameter_sets, PARAMETER_SQL),
}
