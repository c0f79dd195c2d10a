"""Deblocking of single edge lines, presets, schedules and report operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from blockflow.functions import blocks as B
from blockflow.operators import frames as P
from blockflow.sources import adapters as A

# Filter thresholds by index, and clipping values by index for strengths 1, 2, 3.
ALPHA = (
    0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 4, 4, 5, 6, 7, 8, 9, 10, 12, 13,
    15, 17, 20, 22, 25, 28, 32, 36, 40, 45, 50, 56, 63, 71, 80, 90, 101, 113, 127, 144, 162, 182, 203, 226, 255, 255,
)
BETA = (
    0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4,
    6, 6, 7, 7, 8, 8, 9, 9, 10, 10, 11, 11, 12, 12, 13, 13, 14, 14, 15, 15, 16, 16, 17, 17, 18, 18,
)
TC0 = (
    (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0),
    (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 1), (0, 0, 1), (0, 0, 1), (0, 0, 1), (0, 1, 1), (0, 1, 1), (1, 1, 1), (1, 1, 1), (1, 1, 1),
    (1, 1, 1), (1, 1, 2), (1, 1, 2), (1, 1, 2), (1, 1, 2), (1, 2, 3), (1, 2, 3), (2, 2, 3), (2, 2, 4), (2, 3, 4), (2, 3, 4), (3, 3, 5), (3, 4, 6),
    (3, 4, 6), (4, 5, 7), (4, 5, 8), (4, 6, 9), (5, 7, 10), (6, 8, 11), (6, 8, 13), (7, 10, 14), (8, 11, 16), (9, 12, 18), (10, 13, 20), (11, 15, 23), (13, 17, 25),
)


def _lines(spark, d):
    """A row for each line of an 8x8 block as p3..p0 | q0..q3, with a QP and a strength."""
    r = A.blocks(spark, d).select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("line"), "px")
    at = lambda k: F.get("px", F.col("line") * 8 + k).alias(("p3", "p2", "p1", "p0", "q0", "q1", "q2", "q3")[k])
    r = r.select("vec_id", "line", ((F.col("vec_id") * 8 + F.col("line")) % 52).cast("int").alias("qp"), ((F.col("vec_id") + F.col("line")) % 4 + 1).cast("int").alias("bs"), *map(at, range(8)))
    table = lambda t: B.array_of(t)[F.col("qp")]
    tc0 = F.array(*[table([x[k] for x in TC0]) for k in range(3)])
    return r.withColumn("alpha", table(ALPHA)).withColumn("beta", table(BETA)).withColumn("tc0", F.get(tc0, F.least(F.col("bs"), F.lit(3)) - 1))


def luma_edge(spark, d):
    """Normal filter with clipping for strengths 1 to 3, strong filter for 4; a gate on the step across the edge."""
    r = _lines(spark, d).selectExpr("*", "abs(p0 - q0) < alpha AND abs(p1 - p0) < beta AND abs(q1 - q0) < beta AS gate", "abs(p2 - p0) < beta AS ap", "abs(q2 - q0) < beta AS aq", "abs(p0 - q0) < shiftright(alpha, 2) + 2 AS flat")
    r = r.selectExpr("*", "tc0 + cast(ap AS int) + cast(aq AS int) AS tc").selectExpr("*", "greatest(-tc, least(tc, shiftright((q0 - p0) * 4 + p1 - q1 + 4, 3))) AS delta")

    def side(n: str, a: str, b: str, c: str, e: str, x: str, y: str, near: str, sign: str) -> list[str]:
        strong = f"flat AND {near}"
        return [
            f"CASE WHEN NOT gate THEN {a} WHEN bs < 4 THEN greatest(0, least(255, {a} {sign} delta)) WHEN {strong} THEN shiftright({c} + 2 * {b} + 2 * {a} + 2 * {x} + {y} + 4, 3) ELSE shiftright(2 * {b} + {a} + {y} + 2, 2) END AS {n}0n",
            f"CASE WHEN NOT gate OR NOT {near} THEN {b} WHEN bs < 4 THEN {b} + greatest(-tc0, least(tc0, shiftright({c} + shiftright({a} + {x} + 1, 1) - 2 * {b}, 1))) WHEN {strong} THEN shiftright({c} + {b} + {a} + {x} + 2, 2) ELSE {b} END AS {n}1n",
            f"CASE WHEN gate AND bs = 4 AND {strong} THEN shiftright(2 * {e} + 3 * {c} + {b} + {a} + {x} + 4, 3) ELSE {c} END AS {n}2n",
        ]

    return r.selectExpr("vec_id", "line", *side("p", "p0", "p1", "p2", "p3", "q0", "q1", "ap", "+"), *side("q", "q0", "q1", "q2", "q3", "p0", "p1", "aq", "-"))


def chroma_edge(spark, d):
    """Two samples a side: clip at tc0 + 1, or the two-tap strong form."""
    r = _lines(spark, d).selectExpr("*", "abs(p0 - q0) < alpha AND abs(p1 - p0) < beta AND abs(q1 - q0) < beta AS gate", "greatest(-(tc0 + 1), least(tc0 + 1, shiftright((q0 - p0) * 4 + p1 - q1 + 4, 3))) AS delta")
    return r.selectExpr("vec_id", "line", "CASE WHEN NOT gate THEN p0 WHEN bs < 4 THEN greatest(0, least(255, p0 + delta)) ELSE shiftright(2 * p1 + p0 + q1 + 2, 2) END AS p0n", "CASE WHEN NOT gate THEN q0 WHEN bs < 4 THEN greatest(0, least(255, q0 - delta)) ELSE shiftright(2 * q1 + q0 + p1 + 2, 2) END AS q0n")


_T = lambda t: f"{list(t)}[qp + 1]"
LINES_SQL = f"""SELECT *, {_T(ALPHA)} AS alpha, {_T(BETA)} AS beta, [{', '.join(_T([x[k] for x in TC0]) for k in range(3))}][least(bs, 3)] AS tc0 FROM (
  SELECT vec_id, CAST(l AS INT) AS line, CAST((vec_id * 8 + l) % 52 AS INT) AS qp, CAST((vec_id + l) % 4 + 1 AS INT) AS bs, {', '.join(f'px[l * 8 + {k + 1}] AS {n}' for k, n in enumerate(('p3', 'p2', 'p1', 'p0', 'q0', 'q1', 'q2', 'q3')))}
  FROM ({A.BLOCKS_SQL}), (SELECT unnest(range(8)) AS l))"""
_GATE = "abs(p0 - q0) < alpha AND abs(p1 - p0) < beta AND abs(q1 - q0) < beta"


def _side_sql(s: str, o: str, sign: str) -> str:
    """One side as a weighted sum over the line in its own order; s: the side filtered, o: the other."""
    w = lambda *c: "(" + " + ".join(f"{k} * {x}" for k, x in zip(c, (f"{s}3", f"{s}2", f"{s}1", f"{s}0", f"{o}0", f"{o}1")) if k) + ")"
    return f"""CASE WHEN NOT gate THEN {s}0 WHEN bs < 4 THEN greatest(0, least(255, {s}0 {sign} d)) WHEN flat AND a{s} THEN ({w(0, 1, 2, 2, 2, 1)} + 4) >> 3 ELSE ({w(0, 0, 2, 1, 0, 1)} + 2) >> 2 END AS {s}0n,
  CASE WHEN gate AND a{s} AND bs < 4 THEN {s}1 + greatest(-tc0, least(tc0, ({s}2 + (({s}0 + {o}0 + 1) >> 1) - 2 * {s}1) >> 1)) WHEN gate AND a{s} AND flat THEN ({w(0, 1, 1, 1, 1, 0)} + 2) >> 2 ELSE {s}1 END AS {s}1n,
  CASE WHEN gate AND a{s} AND bs = 4 AND flat THEN ({w(2, 3, 1, 1, 1, 0)} + 4) >> 3 ELSE {s}2 END AS {s}2n"""


LUMA_EDGE_SQL = f"""SELECT vec_id, line, {_side_sql('p', 'q', '+')}, {_side_sql('q', 'p', '-')} FROM (SELECT *, greatest(-tc, least(tc, ((q0 - p0) * 4 + p1 - q1 + 4) >> 3)) AS d FROM (
  SELECT *, tc0 + CASE WHEN ap THEN 1 ELSE 0 END + CASE WHEN aq THEN 1 ELSE 0 END AS tc FROM (SELECT *, {_GATE} AS gate, abs(p2 - p0) < beta AS ap, abs(q2 - q0) < beta AS aq, abs(p0 - q0) < (alpha >> 2) + 2 AS flat FROM ({LINES_SQL}))))"""
CHROMA_EDGE_SQL = f"""SELECT vec_id, line, CASE WHEN NOT gate THEN p0 WHEN bs < 4 THEN greatest(0, least(255, p0 + d)) ELSE (2 * p1 + p0 + q1 + 2) >> 2 END AS p0n, CASE WHEN NOT gate THEN q0 WHEN bs < 4 THEN greatest(0, least(255, q0 - d)) ELSE (2 * q1 + q0 + p1 + 2) >> 2 END AS q0n
  FROM (SELECT *, {_GATE} AS gate, greatest(-(tc0 + 1), least(tc0 + 1, ((q0 - p0) * 4 + p1 - q1 + 4) >> 3)) AS d FROM ({LINES_SQL}))"""

# What each speed mode sets: references, SATD search, sub-partition range, search cap a macroblock (0: none).
PRESETS = ((0, 2, True, 16, 0), (1, 1, True, 16, 512), (2, 1, True, 8, 256), (3, 1, False, 8, 128))


def presets(spark, d):
    """Knobs of a mode; an explicit value beats the preset. Customers stand for sessions."""
    table = spark.createDataFrame(PRESETS, "mode int, refs int, satd boolean, range int, cap int")
    s = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4).cast("int").alias("mode"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN 3 END").alias("own_refs"), F.expr("CASE WHEN c_custkey % 7 = 0 THEN 64 END").alias("own_cap"))
    return s.join(F.broadcast(table), "mode").select("id", "mode", F.coalesce("own_refs", "refs").alias("refs"), "satd", "range", F.coalesce("own_cap", "cap").alias("cap"))


PRESETS_SQL = "SELECT id, s.mode, coalesce(own_refs, refs) AS refs, satd, range, coalesce(own_cap, cap) AS cap FROM (SELECT c_custkey AS id, CAST(c_custkey % 4 AS INT) AS mode, CASE WHEN c_custkey % 5 = 0 THEN 3 END AS own_refs, CASE WHEN c_custkey % 7 = 0 THEN 64 END AS own_cap FROM customer) s JOIN (VALUES " + ", ".join(str(p) for p in PRESETS) + ") t(mode, refs, satd, range, cap) ON t.mode = s.mode"


def perf_gate(spark, d, kernel: float = 3.0, end_to_end: float = 2.0, cap: float = 12.0):
    """Current against baseline by (suite, method, parameters): a regression where the change exceeds the threshold plus the larger noise, capped; a run
    without a baseline is a warning. Scalar runs and runs with a part switched off are left out. Line items stand for measurements."""
    li = A.table(spark, d, "lineitem").where("l_partkey % 5 <> 0 AND l_suppkey % 4 <> 3").selectExpr("l_returnflag AS suite", "l_linestatus AS method", "concat('p', cast(l_suppkey % 4 as string)) AS params", "l_linenumber AS nth", "cast(l_quantity as double) AS q")
    run = lambda odd, p: li.where(F.col("nth") % 2 == odd).groupBy("suite", "method", "params").agg(F.avg("q").alias(f"{p}_mean"), F.stddev_pop("q").alias(f"{p}_sd"))
    j = run(1, "c").join(run(0, "b").where("NOT (suite = 'A' AND params = 'p1')"), ["suite", "method", "params"], "left")
    pad = F.least(F.lit(cap), F.greatest(F.col("b_sd") / F.col("b_mean"), F.col("c_sd") / F.col("c_mean")) * 100)
    delta = (F.col("c_mean") - F.col("b_mean")) / F.col("b_mean") * 100
    limit = F.when(F.col("suite") == "R", F.lit(end_to_end)).otherwise(F.lit(kernel)) + pad
    return j.select("suite", "method", "params", F.when(F.col("b_mean").isNull(), "warn").when(delta > limit, "fail").otherwise("pass").alias("verdict"), F.round(delta, 4).alias("delta_pct"), F.round(F.when(F.col("b_mean").isNotNull(), limit), 4).alias("limit_pct"))


def _run_sql(odd: int) -> str:
    return f"SELECT l_returnflag AS suite, l_linestatus AS method, 'p' || CAST(l_suppkey % 4 AS VARCHAR) AS params, avg(CAST(l_quantity AS DOUBLE)) AS m, stddev_pop(CAST(l_quantity AS DOUBLE)) AS sd FROM lineitem WHERE l_linenumber % 2 = {odd} AND l_partkey % 5 <> 0 AND l_suppkey % 4 <> 3 GROUP BY ALL"


PERF_SQL = f"""SELECT suite, method, params, CASE WHEN bm IS NULL THEN 'warn' WHEN delta > lim THEN 'fail' ELSE 'pass' END AS verdict, round(delta, 4) AS delta_pct, CASE WHEN bm IS NOT NULL THEN round(lim, 4) END AS limit_pct FROM (
  SELECT c.suite, c.method, c.params, b.m AS bm, (c.m - b.m) / b.m * 100 AS delta, CASE WHEN c.suite = 'R' THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END + least(12.0::DOUBLE, greatest(b.sd / b.m, c.sd / c.m) * 100) AS lim FROM ({_run_sql(1)}) c LEFT JOIN (SELECT * FROM ({_run_sql(0)}) WHERE NOT (suite = 'A' AND params = 'p1')) b ON b.suite = c.suite AND b.method = c.method AND b.params = c.params)"""


def ranking_agreement(spark, d):
    """Agreement of the candidate rankings by SAD and by SATD: does the best of one lie in the first 1, 2, 4 of the other."""
    m = P.intra4_modes(spark, d)
    w = lambda c: Window.partitionBy("vec_id").orderBy(c, "mode")  # noqa: E731  nine rows a block
    r = m.withColumn("rs", F.row_number().over(w("sad"))).withColumn("rt", F.row_number().over(w("satd")))
    g = r.groupBy("vec_id").agg(F.max(F.when(F.col("rt") == 1, F.col("rs"))).alias("pos"), (F.max(F.when(F.col("rt") == 2, F.col("satd"))) - F.max(F.when(F.col("rt") == 1, F.col("satd")))).alias("margin"))
    bucket = F.expr("CASE WHEN margin = 0 THEN 0 WHEN margin < 8 THEN 1 WHEN margin < 64 THEN 2 ELSE 3 END")
    return g.groupBy(bucket.alias("margin_bucket")).agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("pos") <= k, 1)).alias(f"top{k}") for k in (1, 2, 4)])


RANKING_SQL = f"""SELECT CASE WHEN margin = 0 THEN 0 WHEN margin < 8 THEN 1 WHEN margin < 64 THEN 2 ELSE 3 END AS margin_bucket, count(*) AS n, count(*) FILTER (WHERE pos <= 1) AS top1, count(*) FILTER (WHERE pos <= 2) AS top2, count(*) FILTER (WHERE pos <= 4) AS top4 FROM (
  SELECT vec_id, max(rs) FILTER (WHERE rt = 1) AS pos, max(satd) FILTER (WHERE rt = 2) - max(satd) FILTER (WHERE rt = 1) AS margin FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sad, mode) AS rs, row_number() OVER (PARTITION BY vec_id ORDER BY satd, mode) AS rt FROM ({P.INTRA_SQL})) GROUP BY vec_id) GROUP BY margin_bucket"""


CATALOG = {
    "q_luma_edge_filter": (luma_edge, LUMA_EDGE_SQL),
    "q_chroma_edge_filter": (chroma_edge, CHROMA_EDGE_SQL),
    "q_presets": (presets, PRESETS_SQL),
    "q_perf_gate": (perf_gate, PERF_SQL),
    "q_ranking_agreement": (ranking_agreement, RANKING_SQL),
}
