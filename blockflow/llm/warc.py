"""WARC archives: writing with revisits and segments, reading with reassembly.

Writing: each row becomes a record whose block is an HTTP response in chunked transfer
framing. Of records with equal payloads of at least `least` bytes, the one with the largest id
carries it, the rest are revisit records that refer to it. A block longer than `segment`
bytes is cut: the first part keeps the record type, continuation records name its record id as
origin. A record id is made of the page id, the payload's digest and the row's place in the table, so each row has its own.
Records are rows of Spark's text writer with the record separator as line separator, so
any store that Spark writes to will do, and lost tasks are written again. Files are
compressed as a whole (gzip).

Reading: whole files (small, see RECORDS_PER_FILE) are parsed by Content-Length;
continuation records are grouped by origin id, ordered by segment number and checked
against the total length; then chunk framing is removed. A group is the segments of one row.

Defined results: a null payload is empty; a null url gives no target; a null id is written as
none, read as null, and carries a payload only where all that have it have no id; rows that repeat an id are records
of their own, and where several have the largest id each is a response (revisits refer to one of them); a block with a missing segment
or wrong length, or whose framing or digest is wrong, comes back with complete = false and no
payload; other columns, whatever their names, are not archived; payloads of any length are kept whole; an empty table gives an empty archive, read as no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A file holds at most SEGMENT * RECORDS_PER_FILE bytes of blocks, some 64 MB.
SEGMENT, CHUNK, RECORDS_PER_FILE = 16_384, 4_096, 4_000
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
RECORD = "kind string, record_id string, origin string, segment int, total long, page_id long, target string, digest string, refers string, block binary"


def record_id(row: str, part: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'row:{row}:{part}')}>"


def chunked(data: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(data[k : k + size]), data[k : k + size]) for k in range(0, len(data), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """Payload of chunk framing; raises ValueError where it is broken. Extensions and trailers are allowed."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].partition(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(data[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(END)
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")) else body


def _record(kind: str, own: str, fields: dict[str, object], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def records_of(row: str, page: int | None, target: str | None, payload: bytes, sha1: str, refers: str | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of one row, without the separators behind them. row, refers: keys of this row and of the one it revisits."""
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    target = None if target is None else re.sub(r"[\x00-\x20\x7f]", "%20", target)
    fields = {"WARC-Target-URI": target, "WARC-Page-ID": page, "WARC-Payload-Digest": digest}
    own = record_id(row)
    if refers is not None:
        more = {"WARC-Profile": REVISIT, "WARC-Refers-To": record_id(refers), "Content-Type": "application/http; msgtype=response"}
        return [_record("revisit", own, fields | more, HTTP)]
    block = HTTP + chunked(payload)
    kind = {"Content-Type": "application/http; msgtype=response"}
    if len(block) <= segment:
        return [_record("response", own, fields | kind, block)]
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    out = [_record("response", own, fields | kind | {"WARC-Segment-Number": 1}, parts[0])]
    for n, part in enumerate(parts[1:], 2):
        last = {"WARC-Segment-Total-Length": len(block)} if n == len(parts) else {}
        out.append(_record("continuation", record_id(row, n), {"WARC-Segment-Origin-ID": own, "WARC-Segment-Number": n, **last}, part))
    return out


def write(pages: DataFrame, path: str, least: int = 1000, page_id: str = "page_id", url: str = "url", payload: str = "html", segment: int = SEGMENT) -> None:
    """Archive the pages under path."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("target"), body.alias("body")).withColumn("sha1", F.sha1("body"))
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    long = rows.where((F.octet_length("body") >= least) & F.col("id").isNotNull()).groupBy(F.col("sha1").alias("same"), F.octet_length("body").alias("size"))
    # The largest and the smallest place of the rows of largest id: one and the same unless rows repeat.
    carriers = long.agg(F.max(F.struct("id", "place")).alias("top"), (-F.max(F.struct("id", (-F.col("place")).alias("place")))["place"]).alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    placed = rows.join(carriers, (F.col("sha1") == F.col("same")) & (F.octet_length("body") == F.col("size")), "left")

    @F.pandas_udf("array<binary>")
    def records(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        whole = lambda x: None if x is None or pd.isna(x) else int(x)
        text = lambda x: None if x is None or pd.isna(x) else x
        for part in parts:
            yield pd.Series([records_of(k, whole(i), text(t), b, s, text(r), segment) for k, i, t, b, s, r in zip(*part)], dtype=object)

    # A carrier of its own is named by the payload alone, so no name depends on the order of a scan; a place tells other rows apart.
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    carrier, alone = F.concat_ws(":", F.lit("carrier"), "same", "size"), F.col("top.place") == F.col("low")
    is_top = F.col("id").eqNullSafe(F.col("top.id")) & F.col("top").isNotNull()
    own = F.when(is_top & alone, carrier).otherwise(F.concat_ws(":", text("place"), text("id"), "sha1"))
    refers = F.when(F.col("top").isNotNull() & ~is_top, F.when(alone, carrier).otherwise(F.concat_ws(":", text("top.place"), text("top.id"), "sha1")))
    # Ids as text: a nullable long would reach pandas as a float.
    lines = placed.select(F.explode(records(own, F.col("id").cast("string"), F.col("target"), F.col("body"), F.col("sha1"), refers)).alias("r"))
    lines.select(F.col("r").cast("string").alias("value")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[dict]:
    """The records of one archive file."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        head = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        f = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        size = int(f["content-length"])
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4
        algorithm, _, digest = f.get("warc-payload-digest", "").partition(":")
        number = lambda k: int(f[k]) if k in f else None
        yield {
            "kind": f["warc-type"], "record_id": f["warc-record-id"], "origin": f.get("warc-segment-origin-id"), "segment": number("warc-segment-number"),
            "total": number("warc-segment-total-length"), "page_id": number("warc-page-id"), "target": f.get("warc-target-uri"),
            "digest": base64.b32decode(digest).hex() if algorithm == "sha1" else None, "refers": f.get("warc-refers-to"), "block": block,
        }


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records under path, one a row (RECORD)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for part in parts:
            for data in part["content"]:
                yield pd.DataFrame(list(parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)), columns=names, dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(run, RECORD)


def reassembled(records: DataFrame) -> DataFrame:
    """page_id, target, record_id, kind, refers, digest, payload, payload_bytes, complete: a row for each record that is no continuation."""

    @F.pandas_udf("payload binary, complete boolean")
    def decode(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for kinds, blocks, totals, digests in parts:
            rows = []
            for kind, segments, total, digest in zip(kinds, blocks, totals, digests):
                if kind == "revisit":
                    rows.append((None, True))
                    continue
                segments = sorted(segments, key=lambda s: s["segment"])
                block = b"".join(s["block"] for s in segments)
                ok = [s["segment"] for s in segments] == list(range(1, len(segments) + 1)) and (len(segments) == 1 and total is None or total is not None and int(total) == len(block))
                try:
                    data = payload_of(block) if ok else None
                except ValueError:
                    data = None
                if data is not None and digest is not None and hashlib.sha1(data).hexdigest() != digest:
                    data = None
                rows.append((data, data is not None))
            yield pd.DataFrame(rows, columns=["payload", "complete"])

    segment = F.struct(F.coalesce("segment", F.lit(1)).alias("segment"), "block")
    keep = ["record_id", "kind", "page_id", "target", "digest", "refers"]
    whole = records.where("segment is null").select(*keep, F.array(segment).alias("blocks"), F.lit(None).cast("long").alias("total"))
    cut = records.where("segment is not null").groupBy(F.coalesce("origin", "record_id").alias("own"))
    first = F.min(F.when(F.col("kind") != "continuation", F.struct("record_id", "kind", "page_id", "target", "digest", "refers"))).alias("f")
    cut = cut.agg(first, F.collect_set(segment).alias("blocks"), F.max("total").alias("total")).where("f is not null").select("f.*", "blocks", F.coalesce("total", F.lit(-1)).alias("total"))
    out = whole.union(cut.select(whole.columns))
    out = out.withColumn("d", decode(F.col("kind"), F.col("blocks"), F.col("total").cast("string"), F.col("digest")))
    return out.select(*keep, F.col("d.payload").alias("payload"), F.octet_length("d.payload").cast("long").alias("payload_bytes"), F.col("d.complete").alias("complete"))


def resolved(rows: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, complete: a row for each response and each
    revisit, whose payload is looked up by the record id that it refers to. Archives hold a record id once."""
    narrow = rows.select("record_id", "kind", "page_id", "digest", "refers", "payload_bytes", "complete")
    of = narrow.where("kind = 'response'").select(F.col("record_id").alias("r_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("r_bytes"), F.col("complete").alias("r_ok"))
    out = narrow.where("kind = 'revisit'").join(of, F.col("refers") == F.col("r_id"), "left")
    out = out.select("page_id", F.col("r_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", F.coalesce("r_ok", F.lit(False)).alias("complete"))
    own = narrow.where("kind = 'response'").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "complete")
    return own.union(out)
