"""Entropy-coding and container operators: codes, scans, emulation prevention, start codes, sample tables, schedules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from blockflow.functions import blocks as B
from blockflow.functions import tables as T
from blockflow.operators import blockmath as M
from blockflow.sources import adapters as A

UE = "repeat('0', CAST(length(bin({n} + 1)) - 1 AS INT)) || bin({n} + 1)"


def golomb(spark, d):
    """ue and se codes of the levels of each block."""
    r = M.quant(spark, d).select("vec_id", "blk", F.posexplode("level").alias("i", "v"))
    return r.select("vec_id", "blk", "i", B.ue(F.abs("v")).alias("ue_bits"), B.se(F.col("v")).alias("se_bits"), F.when(F.abs("v") <= 1, F.when(F.abs("v") == 1, "0").otherwise("1")).alias("te1_bits"))


GOLOMB_SQL = f"""SELECT vec_id, blk, i - 1 AS i, {UE.format(n='abs(v)')} AS ue_bits, {UE.format(n='(CASE WHEN v > 0 THEN 2 * v - 1 ELSE -2 * v END)')} AS se_bits,
  CASE abs(v) WHEN 1 THEN '0' WHEN 0 THEN '1' END AS te1_bits FROM (SELECT vec_id, blk, unnest(level) AS v, unnest(range(1, 17)) AS i FROM ({M.QUANT_SQL}))"""


def run_level(spark, d):
    """Reverse scan of the zig-zag levels: values, runs before each, totals and trailing ones."""
    r = M.quant(spark, d).select("vec_id", "blk", B.zigzag(F.col("level")).alias("z"))
    r = r.withColumn("at", F.filter(F.transform("z", lambda v, i: F.when(v != 0, i)), lambda i: i.isNotNull()))
    r = r.withColumn("levels", F.reverse(F.transform("at", lambda i: F.get("z", i))))
    runs = F.reverse(F.transform("at", lambda i, k: i - F.coalesce(F.when(k > 0, F.get("at", k - 1)), F.lit(-1)) - 1))
    ones = F.transform("levels", lambda v, k: F.when(F.abs(v) != 1, k))
    first_big = F.coalesce(F.array_min(F.filter(ones, lambda k: k.isNotNull())), F.size("levels"))
    return r.select("vec_id", "blk", "levels", runs.alias("runs"), F.size("at").alias("total_coeff"), F.when(F.size("at") > 0, F.array_max("at") + 1 - F.size("at")).otherwise(0).alias("total_zeros"), F.least(F.lit(3), first_big).alias("trailing_ones"))


RUN_LEVEL_SQL = f"""WITH z AS (SELECT vec_id, blk, unnest(range(16)) AS p, unnest(list_transform({list(T.ZIGZAG)}, lambda k: level[k + 1])) AS v FROM ({M.QUANT_SQL})),
nz AS (SELECT *, p - coalesce(lag(p) OVER (PARTITION BY vec_id, blk ORDER BY p), -1) - 1 AS run, row_number() OVER (PARTITION BY vec_id, blk ORDER BY p DESC) AS k FROM z WHERE v <> 0),
t AS (SELECT vec_id, blk, min(k) AS big FROM nz WHERE abs(v) <> 1 GROUP BY ALL),
g AS (SELECT vec_id, blk, list(v ORDER BY p DESC) AS levels, list(CAST(run AS INT) ORDER BY p DESC) AS runs, count(*) AS n, max(p) AS last FROM nz GROUP BY ALL)
SELECT b.vec_id, b.blk, coalesce(levels, CAST([] AS INT[])) AS levels, coalesce(runs, CAST([] AS INT[])) AS runs, CAST(coalesce(n, 0) AS INT) AS total_coeff, CAST(coalesce(last + 1 - n, 0) AS INT) AS total_zeros,
  CAST(least(3, coalesce(big - 1, n, 0)) AS INT) AS trailing_ones FROM (SELECT DISTINCT vec_id, blk FROM z) b LEFT JOIN g ON g.vec_id = b.vec_id AND g.blk = b.blk LEFT JOIN t ON t.vec_id = b.vec_id AND t.blk = b.blk"""


_DIGITS = "translate(regexp_replace(hex(encode(coalesce(text, ''){u})), '.(.)', '{one}'{g}), '0123456789ABCDEF', '0123012301230123')"
DIGITS_SQL = f"SELECT doc_id, {_DIGITS.format(u='', one=chr(92) + '1', g=", 'g'")} AS s FROM documents"


def _digits(spark, d):
    """Every document's whole text as the last two bits of each UTF-8 byte: a byte stream of 0 to 3 that is rich in zeros."""
    return A.table(spark, d, "documents").select("doc_id", F.expr(_DIGITS.format(u=", 'utf-8'", one="$1", g="")).alias("s"))


def ebsp(spark, d):
    """Emulation prevention: after two zeros a byte of at most 3 gets a 3 before it. Out: length, digest, and the room that the buffer is given."""
    r = _digits(spark, d).withColumn("out", F.regexp_replace("s", "00(?=.)", "003"))
    n = F.length("s")
    return r.select("doc_id", F.length("out").alias("n"), F.md5(F.col("out").cast("binary")).alias("digest"), (n + F.greatest(F.lit(1), F.expr("length(s) div 3")) + 8).cast("int").alias("room"))


# Replaced from left to right, too; a pair of zeros at the very end gets none.
EBSP_SQL = f"""SELECT doc_id, CAST(length(out) AS INT) AS n, md5(out) AS digest, CAST(length(s) + greatest(1, length(s) // 3) + 8 AS INT) AS room FROM (
  SELECT doc_id, s, CASE WHEN r LIKE '%003' THEN left(r, length(r) - 1) ELSE r END AS out FROM (SELECT doc_id, s, replace(s, '00', '003') AS r FROM ({DIGITS_SQL})))"""


def nal_split(spark, d):
    """Units between start codes of a digit stream (001 marks one; zeros before it belong to the code): offset, length, type."""
    r = _digits(spark, d).withColumn("codes", F.regexp_extract_all("s", F.lit("(0{2,}1)"), F.lit(1)))
    r = r.withColumn("u", F.split("s", "0{2,}1")).withColumn("u", F.when(F.size("codes") > 0, F.col("u")).otherwise(F.array(F.lit(""))))
    # What stands before a unit: the text before the first code, then pairs of code and unit.
    r = r.select("doc_id", F.length(F.element_at("u", 1)).alias("head"), F.posexplode(F.arrays_zip("codes", F.slice("u", 2, F.size("codes")).alias("unit"))).alias("nal_idx", "z"))
    w = Window.partitionBy("doc_id").orderBy("nal_idx")
    r = r.select("doc_id", "nal_idx", "head", F.length("z.codes").alias("n_code"), F.col("z.unit").alias("unit"))
    end = F.col("head") + F.sum(F.col("n_code") + F.length("unit")).over(w)
    return r.select("doc_id", "nal_idx", (end - F.length("unit")).cast("int").alias("start"), F.length("unit").alias("length"), F.when(F.length("unit") > 0, F.substring("unit", 1, 1).cast("int").bitwiseAND(F.lit(31))).alias("nal_type"))


# The first number of a unit is the length of all that stands before it: what a split of the text so far would leave.
NAL_SQL = f"""SELECT doc_id, CAST(k - 2 AS INT) AS nal_idx, CAST(sum(length(u) + c) OVER (PARTITION BY doc_id ORDER BY k) - length(u) AS INT) AS start, CAST(length(u) AS INT) AS length, CASE WHEN length(u) > 0 THEN CAST(u[1] AS INT) & 31 END AS nal_type FROM (
  SELECT doc_id, unnest(p) AS u, unnest(range(1, CAST(len(p) + 1 AS BIGINT))) AS k, unnest(list_concat([0], list_transform(regexp_extract_all(s, '0{{2,}}1'), lambda x: length(x)))) AS c FROM (SELECT doc_id, s, string_split_regex(s, '0{{2,}}1') AS p FROM ({DIGITS_SQL}))) QUALIFY k > 1"""


def _field(spark, d):
    """A macroblock field from the first samples: skip, intra, motion, reference, coded pattern and QP."""
    px = F.element_at("parts", 1)
    p = lambda k: F.get(px, F.lit(k))
    r = A.macroblocks(spark, d)
    return r.select("mb_id", "frame_idx", "mb_idx", F.expr(f"mb_idx div {A.MB_COLS}").cast("int").alias("row"), (F.col("mb_idx") % A.MB_COLS).alias("col"), (p(0) - 128).alias("mvx"), (p(1) - 128).alias("mvy"), (p(2) % 2).alias("ref"), (p(3) % 4 == 0).alias("intra"), (p(4) % 3 == 0).alias("skip"), (p(5) % 48).alias("cbp"), (20 + p(6) % 16).alias("qp"))


FIELD_SQL = f"""SELECT mb_id, frame_idx, mb_idx, CAST(mb_idx // {A.MB_COLS} AS INT) AS row, mb_idx % {A.MB_COLS} AS col, px[1] - 128 AS mvx, px[2] - 128 AS mvy, px[3] % 2 AS ref, px[4] % 4 = 0 AS intra, px[5] % 3 = 0 AS skip, px[6] % 48 AS cbp, 20 + px[7] % 16 AS qp FROM ({A.MACROBLOCKS_SQL})"""


def skip_run(spark, d):
    """Skipped macroblocks before each coded one, and those left at the end of the frame."""
    w = Window.partitionBy("frame_idx").orderBy("mb_idx")
    f = _field(spark, d).withColumn("coded", F.sum(F.when(F.col("skip"), 0).otherwise(1)).over(w) - F.when(F.col("skip"), 0).otherwise(1))
    g = f.groupBy("frame_idx", "coded").agg(F.count(F.when(F.col("skip"), 1)).alias("skip_run"), F.max(F.when(~F.col("skip"), F.col("mb_idx"))).alias("coded_mb"))
    return g.where("skip_run > 0 OR coded_mb IS NOT NULL").select("frame_idx", "coded_mb", "skip_run")


SKIP_SQL = f"""SELECT frame_idx, max(mb_idx) FILTER (WHERE NOT skip) AS coded_mb, count(*) FILTER (WHERE skip) AS skip_run FROM (
  SELECT *, coalesce(sum(CASE WHEN skip THEN 0 ELSE 1 END) OVER (PARTITION BY frame_idx ORDER BY mb_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM ({FIELD_SQL})) GROUP BY frame_idx, g"""


def qp_delta(spark, d):
    """mb_qp_delta: written, and the predecessor moved, only where the coded pattern is not 0."""
    w = Window.partitionBy("frame_idx").orderBy("mb_idx").rowsBetween(Window.unboundedPreceding, -1)
    f = _field(spark, d).withColumn("coded_qp", F.when(F.col("cbp") != 0, F.col("qp"))).withColumn("last_qp", F.coalesce(F.last("coded_qp", ignorenulls=True).over(w), F.lit(26)))
    return f.select("mb_id", F.when(F.col("cbp") != 0, F.col("qp") - F.col("last_qp")).alias("mb_qp_delta"))


QP_DELTA_SQL = f"""SELECT a.mb_id, CASE WHEN a.cbp <> 0 THEN a.qp - coalesce((SELECT max_by(b.qp, b.mb_idx) FROM ({FIELD_SQL}) b WHERE b.frame_idx = a.frame_idx AND b.mb_idx < a.mb_idx AND b.cbp <> 0), 26) END AS mb_qp_delta FROM ({FIELD_SQL}) a"""


def mv_predictor(spark, d):
    """Median prediction: C stands back to D, B and C to A, one neighbour of the same reference wins, else the median."""
    w = Window.partitionBy("frame_idx").orderBy("mb_idx")
    f = _field(spark, d)
    mv = F.struct("mvx", "mvy", "ref")
    n = f.withColumn("a", F.when(F.col("col") > 0, F.lag(mv, 1).over(w))).withColumn("b", F.lag(mv, A.MB_COLS).over(w))
    n = n.withColumn("c", F.when(F.col("col") < A.MB_COLS - 1, F.lag(mv, A.MB_COLS - 1).over(w))).withColumn("e", F.when(F.col("col") > 0, F.lag(mv, A.MB_COLS + 1).over(w)))
    n = n.withColumn("c", F.coalesce("c", "e"))
    alone = F.col("b").isNull() & F.col("c").isNull() & F.col("a").isNotNull()
    hit = lambda x: F.when(F.col(x)["ref"] == F.col("ref"), 1).otherwise(0)
    one = hit("a") + hit("b") + hit("c") == 1

    def axis(v):
        val = lambda x: F.coalesce(F.col(x)[v], F.lit(0))
        only = F.when(hit("a") == 1, val("a")).when(hit("b") == 1, val("b")).otherwise(val("c"))
        return F.when(alone, val("a")).when(one, only).otherwise(F.array_sort(F.array(val("a"), val("b"), val("c")))[1])

    return n.select("mb_id", axis("mvx").alias("px"), axis("mvy").alias("py"))


def _axis_sql(v: str) -> str:
    va, vb, vc = (f"coalesce({x}.{v}, 0)" for x in "abc")
    return f"CASE WHEN b.mb_id IS NULL AND c.mb_id IS NULL AND a.mb_id IS NOT NULL THEN {va} WHEN (ha + hb + hc) = 1 THEN ha * {va} + hb * {vb} + hc * {vc} ELSE {va} + {vb} + {vc} - greatest({va}, {vb}, {vc}) - least({va}, {vb}, {vc}) END"


MV_PREDICTOR_SQL = f"""WITH f AS ({FIELD_SQL}), j AS (SELECT m.mb_id, m.ref, a, b, CASE WHEN c.mb_id IS NULL THEN e ELSE c END AS c FROM f m LEFT JOIN f a ON a.frame_idx = m.frame_idx AND a.row = m.row AND a.col = m.col - 1 LEFT JOIN f b ON b.frame_idx = m.frame_idx AND b.row = m.row - 1 AND b.col = m.col
  LEFT JOIN f c ON c.frame_idx = m.frame_idx AND c.row = m.row - 1 AND c.col = m.col + 1 LEFT JOIN f e ON e.frame_idx = m.frame_idx AND e.row = m.row - 1 AND e.col = m.col - 1),
h AS (SELECT mb_id, a, b, c, CASE WHEN a.ref = ref THEN 1 ELSE 0 END AS ha, CASE WHEN b.ref = ref THEN 1 ELSE 0 END AS hb, CASE WHEN c.ref = ref THEN 1 ELSE 0 END AS hc FROM j)
SELECT mb_id, CAST({_axis_sql('mvx')} AS INT) AS px, CAST({_axis_sql('mvy')} AS INT) AS py FROM h"""


def scene_change(spark, d):
    f = _field(spark, d).groupBy("frame_idx").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("intra"), 1)).alias("n_intra"))
    return f.select("frame_idx", "n_intra", (F.col("n_intra") * 2 > F.col("n")).alias("scene_change"))


#: Frames that are carried through together; only the last known value of each such segment passes on.
SEGMENT = 4096


def motion_complexity(spark, d):
    """Mean integer motion of the inter macroblocks over 16, in [0, 1]; carried on where a frame has none, however long that lasts."""
    m = F.when(~F.col("intra"), F.shiftright(F.greatest(F.abs("mvx"), F.abs("mvy")), 2))
    f = _field(spark, d).groupBy("frame_idx").agg(F.least(F.lit(1.0), F.avg(m) / 16).alias("c")).withColumn("segment", F.expr(f"frame_idx div {SEGMENT}"))
    last = f.where("c IS NOT NULL").groupBy("segment").agg(F.max_by("c", "frame_idx").alias("c"))
    # One row a segment: what the segments before leave behind.
    last = f.select("segment").distinct().join(last, "segment", "left").withColumn("before", F.last("c", ignorenulls=True).over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.last("c", ignorenulls=True).over(Window.partitionBy("segment").orderBy("frame_idx"))
    f = f.withColumn("own", own).join(last.select("segment", "before"), "segment")
    return f.select("frame_idx", F.round(F.coalesce("own", "before", F.lit(0.0)), 9).alias("motion"))


MOTION_SQL = f"""SELECT frame_idx, round(coalesce(last_value(c IGNORE NULLS) OVER (ORDER BY frame_idx), 0.0), 9) AS motion FROM (
  SELECT frame_idx, least(1.0, avg(greatest(abs(mvx), abs(mvy)) >> 2) FILTER (WHERE NOT intra) / 16) AS c FROM ({FIELD_SQL}) GROUP BY frame_idx)"""


def row_stats(spark, d):
    f = _field(spark, d)
    n = lambda c: F.count(F.when(c, 1))
    return f.groupBy("frame_idx", "row").agg(n(F.col("intra")).alias("n_intra"), n(~F.col("intra") & F.col("skip")).alias("n_skip"), n(~F.col("intra") & ~F.col("skip")).alias("n_inter"))


def _samples(spark, d):
    order = Window.partitionBy("stream_id").orderBy("seq")
    return A.feedback(spark, d).select("stream_id", "seq", F.floor(F.col("rtt_ms") * 90).cast("long").alias("step"), (F.col("pli") | F.col("fir") | (F.col("seq") == 0)).alias("idr")).withColumn("ticks", F.sum("step").over(order))


SAMPLES_SQL = f"SELECT stream_id, seq, pli OR fir OR seq = 0 AS idr, CAST(sum(CAST(floor(rtt_ms * 90) AS BIGINT)) OVER (PARTITION BY stream_id ORDER BY seq) AS BIGINT) AS ticks FROM ({A.FEEDBACK_SQL})"


def _durations(spark, d):
    """Time to the next sample, 1 at least; the last one has the integer mean of the others, 3000 if there are none."""
    w = Window.partitionBy("stream_id").orderBy("seq")
    s = _samples(spark, d).withColumn("gap", F.lead("ticks").over(w) - F.col("ticks"))
    s = s.withColumn("gap", F.greatest("gap", F.when(F.col("gap").isNotNull(), F.lit(1))))
    every = Window.partitionBy("stream_id")
    mean = F.expr("sum(gap) OVER (PARTITION BY stream_id) div count(gap) OVER (PARTITION BY stream_id)")
    s = s.withColumn("n", F.count("gap").over(every)).withColumn("mean", F.when(F.col("n") > 0, mean).otherwise(3000))
    return s.select("stream_id", "seq", F.coalesce("gap", "mean").cast("long").alias("duration"))


DURATIONS_SQL = f"""SELECT stream_id, seq, CAST(coalesce(gap, sum(gap) OVER (PARTITION BY stream_id) // count(gap) OVER (PARTITION BY stream_id), 3000) AS BIGINT) AS duration FROM (
  SELECT *, CASE WHEN g IS NULL THEN NULL WHEN g < 1 THEN 1 ELSE g END AS gap FROM (SELECT *, lead(ticks) OVER (PARTITION BY stream_id ORDER BY seq) - ticks AS g FROM ({SAMPLES_SQL})))"""


def mp4_durations(spark, d):
    return _durations(spark, d)


def stts_rle(spark, d):
    """Runs of equal durations (here in thirds of a second), in order."""
    w = Window.partitionBy("stream_id").orderBy("seq")
    s = _durations(spark, d).withColumn("delta", F.expr("duration div 30000"))
    s = s.withColumn("run", F.sum(F.when(F.col("delta").eqNullSafe(F.lag("delta").over(w)), 0).otherwise(1)).over(w))
    return s.groupBy("stream_id", "run").agg(F.count(F.lit(1)).alias("n"), F.max("delta").alias("delta"))


STTS_SQL = f"""SELECT stream_id, CAST(run AS BIGINT) AS run, count(*) AS n, max(delta) AS delta FROM (SELECT *, sum(CASE WHEN delta = prev THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY seq) AS run FROM (
  SELECT *, lag(delta) OVER (PARTITION BY stream_id ORDER BY seq) AS prev FROM (SELECT *, duration // 30000 AS delta FROM ({DURATIONS_SQL})))) GROUP BY stream_id, run"""


def sync_samples(spark, d):
    return _samples(spark, d).where("idr").select("stream_id", (F.col("seq") + 1).alias("sample_number"))


def gop(spark, d):
    """Pictures in groups that an IDR opens: group, frame_num (mod 16), idr_pic_id (mod 65536), references in the 2-slot buffer."""
    w = Window.partitionBy("stream_id").orderBy("seq")
    s = _samples(spark, d).withColumn("gop_id", F.sum(F.col("idr").cast("int")).over(w))
    g = Window.partitionBy("stream_id", "gop_id").orderBy("seq")
    n = F.row_number().over(g) - 1
    return s.select("stream_id", "seq", "gop_id", (n % 16).alias("frame_num"), ((F.col("gop_id") - 1) % 65536).alias("idr_pic_id"), F.least(n, F.lit(2)).alias("n_refs"), F.lag("seq", 1).over(g).alias("ref0"), F.lag("seq", 2).over(g).alias("ref1"))


GOP_SQL = f"""SELECT stream_id, seq, gop_id, n % 16 AS frame_num, (gop_id - 1) % 65536 AS idr_pic_id, least(n, 2) AS n_refs, lag(seq, 1) OVER g AS ref0, lag(seq, 2) OVER g AS ref1 FROM (
  SELECT *, row_number() OVER (PARTITION BY stream_id, gop_id ORDER BY seq) - 1 AS n FROM (SELECT *, CAST(sum(CASE WHEN idr THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq) AS BIGINT) AS gop_id FROM ({SAMPLES_SQL})))
  WINDOW g AS (PARTITION BY stream_id, gop_id ORDER BY seq)"""


def latest_wins(spark, d):
    """Hand-off of the newest: the first 5 are dropped, then one of each block of 3 arrivals stays and the rest count as drops."""
    f = A.feedback(spark, d).where("seq >= 5").groupBy("stream_id", F.expr("seq div 3").alias("slot"))
    return f.agg(F.max("seq").alias("taken"), (F.count(F.lit(1)) - 1).alias("dropped"), F.max_by("rtt_ms", "seq").alias("rtt_ms"))


def ladders(spark, d):
    """Neighbours of every rung, and the rung a bitrate picks."""
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(T.RESOLUTIONS)], "rung int, width int, height int, name string")
    w = Window.orderBy("rung")  # five rows
    return rows.select("rung", "width", "height", F.lead("name").over(w).alias("lower"), F.lag("name").over(w).alias("higher"), F.expr("CASE rung WHEN 0 THEN 8000000 WHEN 1 THEN 5000000 WHEN 2 THEN 3000000 WHEN 3 THEN 1500000 ELSE 0 END").alias("from_bps"))


def levels(spark, d):
    """Lowest level for a frame size in macroblocks, not below 31 when chosen automatically: a look-up in a constant array."""
    table = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(most).alias("most")) for level, most in T.LEVELS])
    sizes = A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 37) % 40000 + 1).alias("mbs"))
    j = sizes.withColumn("level", F.array_min(F.transform(F.filter(table, lambda x: x["most"] >= F.col("mbs")), lambda x: x["level"])))
    return j.select("id", "mbs", "level", F.greatest("level", F.when(F.col("level").isNotNull(), F.lit(31))).alias("auto_level"))


LEVELS_SQL = "SELECT id, mbs, min(level) AS level, CASE WHEN min(level) IS NOT NULL THEN greatest(min(level), 31) END AS auto_level FROM (SELECT p_partkey AS id, (p_partkey * 37) % 40000 + 1 AS mbs FROM part) LEFT JOIN (VALUES " + ", ".join(map(str, T.LEVELS)) + ") t(level, max_fs) ON max_fs >= mbs GROUP BY id, mbs"


def qp_tables(spark, d):
    """Chroma QP, the trellis factor and the chroma DC factor of each QP."""
    rows = spark.range(52).select(F.col("id").cast("int").alias("qp"))
    chroma = B.array_of([T.chroma_qp(q) for q in range(52)])[F.col("qp")]
    return rows.select("qp", chroma.alias("chroma_qp"), F.greatest(F.lit(1), (F.pow(F.lit(2.0), (F.col("qp") - 12) / 6.0) * 256 + 0.5).cast("int")).alias("trellis_lambda"), F.round(0.05 * F.pow(F.lit(2.0), (F.col("qp") - 28) / 6.0), 9).alias("dc_lambda"))


QP_SQL = f"SELECT qp, {[T.chroma_qp(q) for q in range(52)]}[qp + 1] AS chroma_qp, greatest(1, CAST(trunc(pow(2.0::DOUBLE, (qp - 12) / 6.0::DOUBLE) * 256 + 0.5) AS INT)) AS trellis_lambda, round(0.05::DOUBLE * pow(2.0::DOUBLE, (qp - 28) / 6.0::DOUBLE), 9) AS dc_lambda FROM (SELECT CAST(unnest(range(52)) AS INT) AS qp)"


def slice_partition(spark, d):
    """Equal slices of macroblock rows, the remainder to the last; the default count is min(rows, 8, cpus - 1)."""
    r = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 68 + 1).cast("int").alias("rows"), (F.col("s_suppkey") % 12 + 1).cast("int").alias("cpus"))
    r = r.withColumn("slices", F.greatest(F.lit(1), F.least("rows", F.lit(8), F.col("cpus") - 1))).withColumn("per", F.expr("rows div slices").cast("int"))
    r = r.select("id", "rows", "slices", "per", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("k"))
    return r.select("id", "k", (F.col("k") * F.col("per")).alias("first_row"), F.when(F.col("k") == F.col("slices") - 1, F.col("rows")).otherwise((F.col("k") + 1) * F.col("per")).alias("end_row"))


SLICES_SQL = "SELECT id, k, k * (r // s) AS first_row, CASE WHEN k = s - 1 THEN r ELSE (k + 1) * (r // s) END AS end_row FROM (SELECT *, unnest(range(s)) AS k FROM (SELECT id, r, greatest(1, least(r, 8, cpus - 1)) AS s FROM (SELECT s_suppkey AS id, s_suppkey % 68 + 1 AS r, s_suppkey % 12 + 1 AS cpus FROM supplier)))"


CATALOG = {
    "q_golomb": (golomb, GOLOMB_SQL),
    "q_run_level": (run_level, RUN_LEVEL_SQL),
    "q_ebsp": (ebsp, EBSP_SQL),
    "q_nal_split": (nal_split, NAL_SQL),
    "q_skip_run": (skip_run, SKIP_SQL),
    "q_qp_delta_chain": (qp_delta, QP_DELTA_SQL),
    "q_mv_predictor": (mv_predictor, MV_PREDICTOR_SQL),
    "q_scene_change": (scene_change, f"SELECT frame_idx, count(*) FILTER (WHERE intra) AS n_intra, count(*) FILTER (WHERE intra) * 2 > count(*) AS scene_change FROM ({FIELD_SQL}) GROUP BY frame_idx"),
    "q_motion_complexity": (motion_complexity, MOTION_SQL),
    "q_row_stats": (row_stats, f"SELECT frame_idx, row, count(*) FILTER (WHERE intra) AS n_intra, count(*) FILTER (WHERE NOT intra AND skip) AS n_skip, count(*) FILTER (WHERE NOT intra AND NOT skip) AS n_inter FROM ({FIELD_SQL}) GROUP BY frame_idx, row"),
    "q_mp4_durations": (mp4_durations, f"SELECT stream_id, seq, duration FROM ({DURATIONS_SQL})"),
    "q_stts_rle": (stts_rle, STTS_SQL),
    "q_sync_samples": (sync_samples, f"SELECT stream_id, seq + 1 AS sample_number FROM ({SAMPLES_SQL}) WHERE idr"),
    "q_gop": (gop, GOP_SQL),
    "q_latest_wins": (latest_wins, f"SELECT stream_id, seq // 3 AS slot, max(seq) AS taken, count(*) - 1 AS dropped, max_by(rtt_ms, seq) AS rtt_ms FROM ({A.FEEDBACK_SQL}) WHERE seq >= 5 GROUP BY stream_id, seq // 3"),
    "q_ladders": (ladders, "SELECT rung, width, height, lead(name) OVER (ORDER BY rung) AS lower, lag(name) OVER (ORDER BY rung) AS higher, [8000000, 5000000, 3000000, 1500000, 0][rung + 1] AS from_bps FROM (VALUES " + ", ".join(str((i, *r)) for i, r in enumerate(T.RESOLUTIONS)) + ") t(rung, width, height, name)"),
    "q_levels": (levels, LEVELS_SQL),
    "q_qp_tables": (qp_tables, QP_SQL),
    "q_slice_partition": (slice_partition, SLICES_SQL),
}
