"""Bounded-space online packing of token ids into windows of a fixed size.

A task reads its documents once and keeps at most `open_windows` windows open. What fills windows alone is emitted at once; the rest of
a document goes whole into the open window that it fills best. Where none has room and no more may be opened, the
fullest is topped up with the beginning of the piece and emitted, so a window that leaves is full. What is still open
when a task ends is merged: tasks by the hundred (FAN) meet in a next one, which packs in the same way, until one
is left; that one cuts its last windows to full ones and a rest, and the rest into lengths that are powers of two, which
need no padding. Each task holds its open windows and one batch, whatever the input; only open windows travel.

Tokens: a text is cut at ASCII white space, which no token of the vocabulary spans, and every distinct chunk of a batch is
encoded once; two generations of chunks are remembered by a worker. The ids are those that the tokenizers library
gives for the whole text.

Defined results: a null text is the empty one, which is a document of the end id alone; strings of special tokens in a text are ordinary text; texts of any length are
packed whole; repeated rows are packed each for itself; null ids pass through; of equal windows the one opened first is
taken; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: Tasks whose open windows meet in one; characters of chunks that one generation of a worker's memory holds, and of a chunk that it takes.
FAN, MEMORY, LONGEST = 100, 6_000_000, 64
#: The vocabulary's own rule for text in ASCII: what is encoded apart.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_SPACE = " \t\n\v\f\r"


class Encoder:
    """ids of whole texts by a tokenizer file of the tokenizers library."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_buffer(data)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        self.parts: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    @staticmethod
    def _packed(ids) -> bytes:
        return np.fromiter(ids, np.uint32).tobytes()

    def _ascii(self, chunk: str) -> bytes:
        out = []
        for part in _PARTS.findall(chunk.lower()):
            ids = self.parts.get(part)
            if ids is None:
                ids = self._packed(t.id for t in self.model.tokenize(part))
                if len(part) <= LONGEST:
                    if len(self.parts) >= MEMORY // 30:
                        self.parts.clear()
                    self.parts[part] = ids
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each chunk; a chunk has no ASCII white space."""
        out = [self.young.get(c) for c in chunks]
        fresh = []
        for k, ids in enumerate(out):
            if ids is None:
                c = chunks[k]
                ids = self.old.get(c)
                if ids is None and c.isascii() and c.isprintable():
                    ids = self._ascii(c)
                if ids is None:
                    fresh.append(k)
                else:
                    out[k] = ids
                    self._keep(c, ids)
        for at in range(0, len(fresh), 1000):
            group = fresh[at : at + 1000]
            for k, e in zip(group, self.whole.encode_batch_fast([chunks[k] for k in group], add_special_tokens=False)):
                out[k] = self._packed(e.ids)
                self._keep(chunks[k], out[k])
        return out

    def _keep(self, chunk: str, ids: bytes) -> None:
        if len(chunk) <= LONGEST:
            if self.size > MEMORY:
                self.old, self.young, self.size = self.young, {}, 0
            self.young[chunk] = ids
            self.size += len(chunk)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text begin (one more entry: the end)."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = words.flatten().dictionary_encode()
        found = self.chunks([c.strip(_SPACE) for c in coded.dictionary.to_pylist()])
        flat = np.frombuffer(b"".join(found), np.uint32)
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start, which = np.cumsum(length) - length, coded.indices.to_numpy()
        each = length[which]
        end = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(start[which] - end[:-1], each) + np.arange(end[-1])]
        return ids, end[np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])]


_encoders: dict[int, Encoder] = {}


def _encoder(key: int, data: bytes) -> Encoder:
    """The worker's encoder; it outlives tasks, and only the last one stays."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(data)
    return _encoders[key]


#: doc_id, ids before it in its document, ids of the document, its own ids.
Piece = tuple[object, int, int, bytes]


class Packer:
    """Windows of `capacity` ids, of which `most` are open. done: rows (piece, window, offset, closed)."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free: list[tuple[int, int]] = []  # (ids, minus number) of open windows, sorted
        self.held: dict[int, list[Piece]] = {}
        self.done: list[tuple[Piece, int, int, bool]] = []
        self.next = 0

    def _emit(self, number: int, pieces: list[Piece], closed: bool = True) -> None:
        offset = 0
        for p in pieces:
            self.done.append((p, number, offset, closed))
            offset += len(p[3]) // 4

    def _number(self) -> int:
        self.next += 1
        return self.next - 1

    @staticmethod
    def _cut(piece: Piece, n: int) -> tuple[Piece, Piece]:
        doc, start, total, ids = piece
        return (doc, start, total, ids[: 4 * n]), (doc, start + n, total, ids[4 * n :])

    def add(self, piece: Piece) -> None:
        n = len(piece[3]) // 4
        while n >= self.capacity:
            head, piece = self._cut(piece, self.capacity)
            self._emit(self._number(), [head])
            n -= self.capacity
        if not n:
            return
        at = bisect_right(self.free, (self.capacity - n, 1)) - 1
        if at < 0 and len(self.free) == self.most:  # none fits: the fullest leaves, filled
            used, minus = self.free.pop()
            head, piece = self._cut(piece, self.capacity - used)
            n -= self.capacity - used
            self._emit(-minus, [*self.held.pop(-minus), head])
            at = bisect_right(self.free, (self.capacity - n, 1)) - 1
        if at < 0:
            number, used = self._number(), 0
            self.held[number] = []
        else:
            used, minus = self.free.pop(at)
            number = -minus
        self.held[number].append(piece)
        if used + n == self.capacity:
            self._emit(number, self.held.pop(number))
        else:
            insort(self.free, (used + n, -number))

    def leave_open(self) -> None:
        for number, pieces in self.held.items():
            self._emit(number, pieces, False)
        self.held, self.free = {}, []

    def close(self) -> None:
        """The fullest first, what is open becomes full windows and lengths that are powers of two."""
        rest = [p for used, minus in reversed(self.free) for p in self.held[-minus]]
        left = sum(len(p[3]) // 4 for p in rest)
        self.held, self.free = {}, []
        window, room = [], 0
        for piece in rest:
            while piece[3]:
                if not room:
                    room = min(self.capacity, 1 << left.bit_length() - 1)
                    left -= room
                head, piece = self._cut(piece, min(room, len(piece[3]) // 4))
                window.append(head)
                room -= len(head[3]) // 4
                if not room:
                    self._emit(self._number(), window)
                    window = []


def _batches(packer: Packer, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    rows, packer.done = packer.done, []
    if rows:
        part = TaskContext.get().partitionId()
        pieces = [r[0] for r in rows]
        columns = [pa.array([p[0] for p in pieces], kind), pa.array([p[1] for p in pieces], pa.int64()), pa.array([p[2] for p in pieces], pa.int64()), pa.array([p[3] for p in pieces], pa.binary())]
        columns += [pa.array([part] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "start", "doc_tokens", "ids", "part", "window", "offset", "closed"])


def _pack_texts(key: int, shared, end_id: int, capacity: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, kind = _encoder(key, shared.value), Packer(capacity, most), None
        end = np.array([end_id], np.uint32).tobytes()
        for b in batches:
            kind = b.column("id").type
            ids, begin = encoder.texts(b.column("text"))
            data = memoryview(ids.tobytes())
            for doc, x, y in zip(b.column("id").to_pylist(), begin[:-1].tolist(), begin[1:].tolist()):
                packer.add((doc, 0, y - x + 1, bytes(data[4 * x : 4 * y]) + end))
            yield from _batches(packer, kind)
        packer.leave_open()
        yield from _batches(packer, kind)

    return run


def _pack_pieces(capacity: int, most: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, kind = Packer(capacity, most), None
        for b in batches:
            kind = b.column("id").type
            for piece in zip(*(b.column(c).to_pylist() for c in ("id", "start", "doc_tokens", "ids"))):
                packer.add(piece)
            yield from _batches(packer, kind)
        packer.close() if last else packer.leave_open()
        yield from _batches(packer, kind)

    return run


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = 4096, open_windows: int = 32, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a piece: doc_id, start (ids of its document before it), doc_tokens (ids of the document, with the end id), sequence_id, offset
    (ids of the sequence before it), ids (binary, little-endian unsigned 32-bit). path: a tokenizer file of the tokenizers library.

    A sequence has `capacity` ids or a power of two. Its id holds the round of merging, the task and the task's own count.
    """
    if capacity < 1 or open_windows < 1:
        raise ValueError("capacity and open_windows must be positive")
    spark = docs.sparkSession
    with open(path, "rb") as f:
        data = f.read()  # bounded by the vocabulary
    shared, kind = spark.sparkContext.broadcast(data), docs.schema[doc_id].dataType.simpleString()
    schema = f"id {kind}, start bigint, doc_tokens bigint, ids binary, part int, window bigint, offset bigint, closed boolean"
    with small_batches(spark, 1_000):
        rows = written(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(_pack_texts(hash(data), shared, end_id, capacity, open_windows), schema), "pieces")
    out, level = [rows.where("closed").withColumn("round", F.lit(0))], 0
    while True:
        level += 1
        rest = rows.where("not closed")
        tasks = rest.agg(F.count_distinct("part")).first()[0]
        groups = max(1, -(-tasks // FAN))
        meet = rest.withColumn("group", F.expr(f"part div {FAN}")) if groups > 1 else rest.withColumn("group", F.lit(0))
        meet = meet.repartition(groups, "group").sortWithinPartitions("part", "window", "offset").select("id", "start", "doc_tokens", "ids")
        with small_batches(spark, 1_000):
            rows = written(meet.mapInArrow(_pack_pieces(capacity, open_windows, groups == 1), schema), "merged-pieces")
        out.append(rows.where("closed").withColumn("round", F.lit(level)))
        if groups == 1:
            break
    pieces = out[0]
    for more in out[1:]:
        pieces = pieces.union(more)
    sequence = F.expr("shiftleft(cast(round as bigint), 58) + shiftleft(cast(part as bigint), 32) + window")
    return pieces.select(F.col("id").alias(doc_id), "start", "doc_tokens", sequence.alias("sequence_id"), "offset", "ids")


def sequences(pieces: DataFrame, capacity: int = 4096, pad_id: int = 0, doc_id: str = "doc_id") -> DataFrame:
    """A row a sequence: sequence_id, n_tokens, padded (its length with padding), ids (binary, padded), starts (where its pieces begin).

    A sequence has at most `capacity` pieces, so a group is bounded.
    """
    row = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    found = pieces.groupBy("sequence_id").agg(row.alias("p"), F.sum(F.octet_length("ids") / 4).cast("long").alias("n_tokens"))
    padded = F.when(F.expr("bit_count(n_tokens) = 1"), F.col("n_tokens")).otherwise(F.lit(capacity).cast("long"))
    pad = np.array([pad_id], np.uint32).tobytes()
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    filler = F.unhex(F.repeat(F.lit(pad.hex()), (F.col("padded") - F.col("n_tokens")).cast("int")))
    return found.withColumn("padded", padded).select("sequence_id", "n_tokens", "padded", F.concat(joined, filler).alias("ids"), F.col("p.offset").alias("starts"))
