"""Files: samples and boxes of the movie container, and headers of captured bitmaps.

Bytes stand as hexadecimal digits, so that boxes nest by concatenation: a box's size is known when its contents are.
A stream's tables are gathered once, as the file asks; streams are independent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockflow.operators import bits as S
from blockflow.operators import entropy as E
from blockflow.sources import adapters as A

# Ticks a second of the media and of the movie.
MEDIA, MOVIE = 90_000, 1_000
#: Unit types that a sample leaves out: parameter sets and delimiters.
DROPPED = (7, 8, 9)

_SAMPLES = """SELECT doc_id, count(CASE WHEN kind NOT IN (7, 8, 9) THEN 1 END) AS n_kept, count(CASE WHEN kind IN (7, 8, 9) THEN 1 END) AS n_dropped, CAST(coalesce(sum(CASE WHEN kind NOT IN (7, 8, 9) THEN 4 + length END), 0) AS BIGINT) AS sample_bytes, coalesce(max(CASE WHEN kind = 5 THEN 1 END), 0) = 1 AS sync
FROM (SELECT *, (length + nal_idx) % 12 AS kind FROM {source}) GROUP BY doc_id"""


def mp4_samples(spark, d):
    """A byte stream as one sample: parameter sets and delimiters go, each other unit gets a length of four bytes. Lengths stand for unit types."""
    return spark.sql(_SAMPLES.replace("{source}", "{rows}"), rows=S.nal_split(spark, d))


def u32(n: str) -> str:
    return f"lpad(hex(cast({n} as bigint)), 8, '0')"


def u16(n: str) -> str:
    return f"lpad(hex(cast({n} as bigint)), 4, '0')"


def raw(data: bytes) -> str:
    return f"'{data.hex().upper()}'"


def zeros(n: int) -> str:
    return raw(bytes(n))


def boxed(layers: list[tuple[str, str, list[str]]], source: str, kept: str) -> str:
    """Nested selects: each layer adds column `name`, a box of kind `kind` around its parts (columns and expressions)."""
    for name, kind, parts in layers:
        body = " || ".join(parts) if parts else "''"
        source = f"SELECT *, {u32(f'8 + length({name}_body) / 2')} || {raw(kind.encode())} || {name}_body AS {name} FROM (SELECT *, {body} AS {name}_body FROM ({source}) {name}_0) {name}_1"
    return f"SELECT {kept} FROM ({source}) last"


_FULL = zeros(4)  # version and flags
_MATRIX = raw(b"".join(n.to_bytes(4, "big") for n in (0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)))
_TYPES = raw(b"mp42isomavc1")
NAME = b"blockflow"
LAYERS = [
    ("mvhd", "mvhd", [_FULL, zeros(8), u32(str(MOVIE)), u32("duration"), u32("65536"), u16("256"), zeros(10), _MATRIX, zeros(24), u32("2")]),
    ("tkhd", "tkhd", [u32("7"), zeros(8), u32("1"), zeros(4), u32("duration"), zeros(8), zeros(8), _MATRIX, u32("w * 65536"), u32("h * 65536")]),
    ("mdhd", "mdhd", [_FULL, zeros(8), u32(str(MEDIA)), u32("ticks"), u16(str(0x55C4)), zeros(2)]),
    ("hdlr", "hdlr", [_FULL, zeros(4), raw(b"vide"), zeros(12), raw(b"VideoHandler\0")]),
    ("vmhd", "vmhd", [u32("1"), zeros(8)]),
    ("url_", "url ", [u32("1")]),
    ("dref", "dref", [_FULL, u32("1"), "url_"]),
    ("dinf", "dinf", ["dref"]),
    ("avcc", "avcC", [raw(b"\1"), "substr(sps, 3, 6)", raw(b"\xff\xe1"), u16("length(sps) / 2"), "sps", raw(b"\1"), u16("length(pps) / 2"), "pps"]),
    ("avc1", "avc1", [zeros(6), u16("1"), zeros(16), u16("w"), u16("h"), u32("4718592"), u32("4718592"), zeros(4), u16("1"), raw(bytes([len(NAME)]) + NAME + bytes(31 - len(NAME))), u16("24"), u16("65535"), "avcc"]),
    ("stsd", "stsd", [_FULL, u32("1"), "avc1"]),
    ("stts", "stts", [_FULL, u32("length(runs) / 16"), "runs"]),
    ("stss", "stss", [_FULL, u32("length(syncs) / 8"), "syncs"]),
    ("stsc", "stsc", [_FULL, u32("1"), u32("1"), u32("length(sizes) / 8"), u32("1")]),
    ("stsz", "stsz", [_FULL, zeros(4), u32("length(sizes) / 8"), "sizes"]),
    ("stco", "stco", [_FULL, u32("1"), u32("first_offset")]),
    ("stbl", "stbl", ["stsd", "stts", "stss", "stsc", "stsz", "stco"]),
    ("minf", "minf", ["vmhd", "dinf", "stbl"]),
    ("mdia", "mdia", ["mdhd", "hdlr", "minf"]),
    ("trak", "trak", ["tkhd", "mdia"]),
    ("moov", "moov", ["mvhd", "trak"]),
    ("ftyp", "ftyp", [raw(b"mp42"), zeros(4), _TYPES]),
]
# The first sample lies behind the type box and the header of the media data.
_MOVIE_SQL = boxed(LAYERS, "{source}", "stream_id, ftyp, moov")
_FIELDS = f"SELECT stream_id, ticks, cast(ticks * {MOVIE} {{d}} {MEDIA} as bigint) AS duration, (stream_id % 40 + 1) * 16 AS w, (stream_id % 30 + 1) * 16 AS h, upper(substr(s.unit, 9)) AS sps, upper(substr(p.unit, 9)) AS pps, runs, syncs, sizes, 36 AS first_offset FROM {{tables}} t JOIN {{sets}} s ON s.id = t.stream_id % 200 + 1 AND s.kind = 'sps' JOIN {{sets}} p ON p.id = t.stream_id % 200 + 1 AND p.kind = 'pps'"


def _tables(spark, d) -> DataFrame:
    """A row a stream: total ticks, and the tables of runs, sync samples and sizes as digits."""
    digits = lambda rows, key, *cols: rows.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, F.concat(*[F.expr(u32(c)) for c in cols]).alias("x")))), lambda s: s["x"]), ""))  # noqa: E731  one file's tables
    runs = digits(S.stts_rle(spark, d), "run", "n", "delta * 30000").toDF("stream_id", "runs")
    syncs = digits(S.sync_samples(spark, d), "sample_number", "sample_number").toDF("stream_id", "syncs")
    sizes = digits(A.feedback(spark, d), "seq", "last_bytes + 5").toDF("stream_id", "sizes")
    ticks = S.mp4_durations(spark, d).groupBy("stream_id").agg(F.sum("duration").alias("ticks"))
    return ticks.join(runs, "stream_id").join(syncs, "stream_id").join(sizes, "stream_id")


def mp4_movie(spark, d):
    """Type and movie boxes of every stream."""
    sets = E.parameter_sets(spark, d).where("kind <> 'sei'")
    rows = spark.sql(_FIELDS.replace("{d}", "div"), tables=_tables(spark, d), sets=sets)
    for name, kind, parts in LAYERS:
        rows = rows.withColumn(f"{name}_body", F.expr(" || ".join(parts)))
        rows = rows.withColumn(name, F.expr(f"{u32(f'8 + length({name}_body) / 2')} || {raw(kind.encode())} || {name}_body"))
    return rows.select("stream_id", "ftyp", "moov")


def _agg(source: str, key: str, *cols: str) -> str:
    return f"SELECT stream_id, string_agg({' || '.join(u32(c) for c in cols)}, '' ORDER BY {key}) AS x FROM ({source}) GROUP BY stream_id"


_TABLES_SQL = f"""(SELECT k.stream_id, k.ticks, r.x AS runs, y.x AS syncs, z.x AS sizes FROM (SELECT stream_id, CAST(sum(duration) AS BIGINT) AS ticks FROM ({S.DURATIONS_SQL}) GROUP BY stream_id) k JOIN ({_agg(S.STTS_SQL, 'run', 'n', 'delta * 30000')}) r ON r.stream_id = k.stream_id
  JOIN ({_agg(f"SELECT stream_id, seq + 1 AS sample_number FROM ({S.SAMPLES_SQL}) WHERE idr", 'sample_number', 'sample_number')}) y ON y.stream_id = k.stream_id JOIN ({_agg(A.FEEDBACK_SQL, 'seq', 'last_bytes + 5')}) z ON z.stream_id = k.stream_id)"""
MOVIE_ORACLE = _MOVIE_SQL.replace("{source}", _FIELDS.replace("{d}", "//").replace("{tables}", _TABLES_SQL).replace("{sets}", "sets"))
MOVIE_ORACLE = f"WITH sets AS MATERIALIZED ({E.PARAMETER_SQL}) {MOVIE_ORACLE}"

# Bitmaps: file header of 14 bytes, information header of 40, little-endian numbers; parts stand for captured frames.
_BITMAPS = """SELECT id, w, h, n, bytes_pp, h_sign, 'BM' AS mark, CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END AS compression, 54 + id % 3 * 4 AS offset_, CASE WHEN id % 7 = 0 THEN w * 2 ELSE w END AS told_w, 54 + id % 3 * 4 + n * bytes_pp AS size
FROM (SELECT p_partkey AS id, p_partkey % 4 * 8 + 16 AS w, p_partkey % 3 * 6 + 12 AS h, (p_partkey % 4 * 8 + 16) * (p_partkey % 3 * 6 + 12) AS n, CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 3 END AS bytes_pp, CASE WHEN p_partkey % 5 < 2 THEN -1 ELSE 1 END AS h_sign FROM {part} part_0) part_1"""


def _le(n: str, size: int) -> str:
    """A number of `size` bytes, the lowest first, as digits (two's complement)."""
    return " || ".join(f"lpad(hex((cast({n} as bigint) >> {8 * k}) & 255), 2, '0')" for k in range(size))


_HEADER = f"SELECT *, {raw(b'BM')} || {_le('size', 4)} || {zeros(4)} || {_le('offset_', 4)} || {_le('40', 4)} || {_le('told_w', 4)} || {_le('h * h_sign', 4)} || {_le('1', 2)} || {_le('bytes_pp * 8', 2)} || {_le('compression', 4)} || {zeros(20)} AS head FROM ({_BITMAPS}) b"


def _at(offset: int, size: int) -> str:
    """Value of a little-endian number in `head`; four bytes are signed."""
    byte = lambda k: f"((position(substr(head, {2 * (offset + k) + 1}, 1) IN '0123456789ABCDEF') - 1) * 16 + position(substr(head, {2 * (offset + k) + 2}, 1) IN '0123456789ABCDEF') - 1)"
    value = " + ".join(f"cast({byte(k)} as bigint) * {256**k}" for k in range(size))
    return f"({value})" if size < 4 else f"(CASE WHEN {byte(3)} > 127 THEN {value} - 4294967296 ELSE {value} END)"


_SNIFF = f"""SELECT id, valid, CASE WHEN NOT valid THEN NULL WHEN told_width * abs(told_height) = pixels THEN told_width WHEN pixels = 24 * 18 THEN 24 WHEN pixels = 16 * 12 THEN 16 END AS width,
  CASE WHEN NOT valid THEN NULL WHEN told_width * abs(told_height) = pixels THEN abs(told_height) WHEN pixels = 24 * 18 THEN 18 WHEN pixels = 16 * 12 THEN 12 END AS height, CASE WHEN valid THEN told_width * abs(told_height) <> pixels OR told_height < 0 END AS top_down, CASE WHEN valid THEN told_width * abs(told_height) <> pixels END AS anomaly
FROM (SELECT *, substr(head, 1, 4) = '424D' AND compressed = 0 AND told_width > 0 AND told_height <> 0 AND depth IN (24, 32) AND start >= 54 AND start < size AS valid, (size - start) {{d}} greatest(1, depth {{d}} 8) AS pixels
  FROM (SELECT id, head, size, {_at(10, 4)} AS start, {_at(18, 4)} AS told_width, {_at(22, 4)} AS told_height, {_at(28, 2)} AS depth, {_at(30, 4)} AS compressed FROM ({_HEADER}) c) e) g"""


def bitmap_sniff(spark, d):
    """Captured bitmaps: headers of 24 or 32 bits without compression; a size that the payload contradicts is replaced by the first advertised one
    that fits (24x18, 16x12), from the top."""
    return spark.sql(_SNIFF.replace("{d}", "div").replace("{part}", "{rows}"), rows=A.table(spark, d, "part"))


_LANES = """SELECT vec_id, CASE WHEN c0 AND NOT c3 THEN 1 ELSE 2 END AS red, CASE WHEN c0 AND NOT c3 THEN 2 ELSE 1 END AS green, CASE WHEN c0 AND NOT c3 THEN 3 ELSE 0 END AS blue FROM (
  SELECT vec_id, l0 = h0 AS c0, l3 = h3 AS c3 FROM {source})"""


def channel_order(spark, d):
    """Order of the channels of 32-bit samples: a constant first lane is padding. Blocks are 4x4 such samples, some with a constant lane."""
    b = A.blocks(spark, d).select("vec_id", F.transform("px", lambda v, i: F.when((i % 4 == 0) & (F.col("vec_id") % 3 == 0) | (i % 4 == 3) & (F.col("vec_id") % 4 == 0), 0).otherwise(v)).alias("px"))
    lane = lambda k: F.filter("px", lambda v, i: i % 4 == k)
    b = b.select("vec_id", *[f(lane(k)).alias(f"{n}{k}") for k in (0, 3) for f, n in ((F.array_min, "l"), (F.array_max, "h"))])
    return spark.sql(_LANES.replace("{source}", "{rows}"), rows=b)


_LANE_PX = f"SELECT vec_id, list_transform(range(64), lambda i: CASE WHEN i % 4 = 0 AND vec_id % 3 = 0 OR i % 4 = 3 AND vec_id % 4 = 0 THEN 0 ELSE px[i + 1] END) AS px FROM ({A.BLOCKS_SQL})"
LANES_SQL = _LANES.replace("{source}", "(SELECT vec_id, " + ", ".join(f"list_{f}(list_transform(range(16), lambda i: px[4 * i + {k + 1}])) AS {n}{k}" for k in (0, 3) for f, n in (("min", "l"), ("max", "h"))) + f" FROM ({_LANE_PX}))")

CATALOG = {
    "q_mp4_samples": (mp4_samples, _SAMPLES.replace("{source}", f"({S.NAL_SQL})")),
    "q_mp4_movie": (mp4_movie, MOVIE_ORACLE),
    "q_bitmap_sniff": (bitmap_sniff, _SNIFF.replace("{d}", "//").replace("{part}", "part")),
    "q_channel_order": (channel_order, LANES_SQL),
}
