"""Sessions: feedback decides, the frame is encoded as decided, and what was applied goes back into the decision.

A stream's state is the controller, the size and speed in force, and what the encoder needs of the picture before (its filtered planes, vectors and
number). The batch query folds a stream in one pass; the streaming query keeps the same state in the state store, so a query that starts again
from its checkpoint goes on with the picture it would have had.

The session never changes the resolution by itself: the decision recommends a rung of the ladder, and a policy tells whether it is taken. A new size
starts a new encoder with an intra picture; the controller is told the rung, speed and rate that are in force. Source frames are brought to the
size in force by taking the nearest sample.
"""

from __future__ import annotations

import json
import struct
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockflow.functions import inter
from blockflow.functions.folds import dealt
from blockflow.operators import control as C
from blockflow.operators.motion import tables

#: Sizes of the five rungs of the ladder, each a whole number of macroblocks, at most the source's.
SIZES = ((48, 32), (32, 32), (32, 16), (16, 32), (16, 16))
INPUTS = tuple(n for n in C.INPUTS if n != "last_bytes")
FRAME = ("src_width", "src_height", "y", "u", "v")
OUTPUT = "width int, height int, recommended boolean, fps int, speed int, qp int, target_bps long, idr boolean, intra_refresh boolean, frame_num int, n_bytes int, sse long, digest string"
SAVED = "control string, seq long, rung int, number int, idr_pic_id int, bytes int, planes binary, vectors binary"

#: Pictures that a worker keeps, about 12 KB each at 48x32.
KEPT = 4096
_KEPT: OrderedDict[bytes, tuple] = OrderedDict()


def pictured(group: inter.Group, planes: tuple[np.ndarray, np.ndarray, np.ndarray], qp: int, satd: bool, sub: bool) -> tuple[int, str, int]:
    """Adds a picture to the group: bytes and digest of its units, squared error of its luma."""
    unit, _, rec = group.add(planes, qp, satd=satd, sub=sub)
    return len(unit), md5(unit).hexdigest(), int(((rec[0] - planes[0]) ** 2).sum())


def pictured_once(group: inter.Group, planes: tuple[np.ndarray, np.ndarray, np.ndarray], qp: int, satd: bool, sub: bool) -> tuple[int, str, int]:
    """The same, by a table of the last KEPT pictures of this worker.

    A picture follows from its planes, what it refers to, and these settings alone, so where a stream is in the state that another one was in with the
    same picture, it takes the result; everything that the encoder reads is in the key.
    """
    before = () if group.reference is None else (*group.reference, group.motion.mv, group.motion.ref)
    state = repr((group.idr_pic_id, group.number % 16, group.slices, qp, satd, sub, *(p.shape for p in planes), *(p.dtype.str for p in before)))
    key = md5(b"".join([state.encode(), *(np.ascontiguousarray(p).tobytes() for p in (*planes, *before))])).digest()
    if key in _KEPT:
        _KEPT.move_to_end(key)
        *made, group.reference, group.motion = _KEPT[key]
        group.number += 1
        return tuple(made)
    made = pictured(group, planes, qp, satd, sub)
    _KEPT[key] = *made, group.reference, group.motion
    if len(_KEPT) > KEPT:
        _KEPT.popitem(last=False)
    return made


def scaled(source: tuple[np.ndarray, np.ndarray, np.ndarray], w: int, h: int) -> tuple[np.ndarray, ...]:
    """Planes of a source frame at the size in force: the nearest samples."""
    return tuple(p[np.arange(b) * p.shape[0] // b][:, np.arange(a) * p.shape[1] // a].astype(np.int64) for p, (a, b) in zip(source, ((w, h), (w // 2, h // 2), (w // 2, h // 2))))


def at_once(decision: dict, rung: int) -> bool:
    """The policy that takes every recommended size."""
    return True


@dataclass
class Session:
    """One stream. recovery: replaces the recovery part of a decision, as (state, feedback, config) -> columns of control.RECOVERY;
    resize: (decision, rung in force) -> whether the recommended size is taken; share: whether results of other streams in the same state are taken."""

    config: C.Config
    sizes: tuple[tuple[int, int], ...] = SIZES
    resize: Callable[[dict, int], bool] = at_once
    recovery: Callable[[C.State, dict, C.Config], dict] | None = None
    state: C.State = None
    rung: int = 0
    seq: int = -1
    bytes: int = 0
    group: inter.Group = field(default=None)
    share: bool = False

    def __post_init__(self):
        self.state = self.state or C.State(bps=self.config.initial_bps)
        self.group = self.group or inter.Group(self.config.base_qp, 1, tables())

    def decide(self, feedback: dict) -> tuple[dict, bool, bool]:
        """The decision for a frame, whether another size is recommended, and whether a new encoder starts."""
        rung, decision = self.rung, C.step(self.state, feedback | {"last_bytes": self.bytes}, self.config)
        if self.recovery:
            decision |= self.recovery(self.state, feedback, self.config)
        recommended, anew = self.state.rung != rung, bool(decision["force_idr"])
        if recommended and self.resize(decision, rung):
            self.rung, anew = self.state.rung, True
        self.state.rung = self.rung  # what is in force, not what was recommended
        return decision, recommended, anew

    def step(self, feedback: dict, source: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple:
        """The columns of OUTPUT for one frame."""
        decision, recommended, anew = self.decide(feedback)
        if anew:
            self.group.restart()
        w, h = self.sizes[self.rung]
        planes = scaled(source, w, h)
        qp, number, idr = max(0, min(51, decision["base_qp"])), self.group.number, self.group.reference is None
        self.bytes, digest, sse = (pictured_once if self.share else pictured)(self.group, planes, qp, decision["speed"] < 3, decision["speed"] < 2)
        return w, h, recommended, decision["fps"], decision["speed"], qp, decision["target_bps"], idr, decision["intra_refresh"], number % 16, self.bytes, sse, digest

    def saved(self) -> tuple:
        """The columns of SAVED."""
        g = self.group
        planes = b"" if g.reference is None else b"".join(p.astype(np.uint8).tobytes() for p in g.reference)
        vectors = b"" if g.motion is None else g.motion.mv.astype("<i2").tobytes() + g.motion.ref.astype(np.int8).tobytes()
        return json.dumps(asdict(self.state)), self.seq, self.rung, g.number, g.idr_pic_id, self.bytes, planes, vectors

    def restore(self, control: str, seq: int, rung: int, number: int, idr_pic_id: int, size: int, planes: bytes, vectors: bytes) -> Session:
        self.state, self.seq, self.rung, self.bytes = C.State(**json.loads(control)), seq, rung, size
        g, (w, h) = self.group, self.sizes[rung]
        g.number, g.idr_pic_id = number, idr_pic_id
        if planes:
            data, n = np.frombuffer(planes, np.uint8).astype(np.int32), w * h
            g.reference = data[:n].reshape(h, w), data[n : n + n // 4].reshape(h // 2, w // 2), data[n + n // 4 :].reshape(h // 2, w // 2)
            g.motion = inter.MotionGrid(h // 4, w // 4)
            cells = h // 4 * (w // 4)
            g.motion.mv[:] = np.frombuffer(vectors[: 4 * cells], "<i2").reshape(h // 4, w // 4, 2)
            g.motion.ref[:] = np.frombuffer(vectors[4 * cells :], np.int8).reshape(h // 4, w // 4)
        return self


def _source(w: int, h: int, y: bytes, u: bytes, v: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(p, np.uint8).reshape(s) for p, s in ((y, (h, w)), (u, (h // 2, w // 2)), (v, (h // 2, w // 2))))


_NAMES = [x.split()[0] for x in OUTPUT.split(", ")]


def encoded(rows: DataFrame, new: Callable[[], Session]) -> DataFrame:
    """stream_id, seq and OUTPUT for rows of feedback and frames (stream_id, seq, INPUTS, FRAME), stream by stream in order of seq. A stream is one task's."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    out = pa.schema([("stream_id", pa.int64()), ("seq", pa.int64()), *((n, kinds[k]) for n, k in (x.split() for x in OUTPUT.split(", ")))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, session = object(), None
        for b in batches:
            made = []
            for k in range(b.num_rows):
                i, q, *values = (b.column(n)[k].as_py() for n in ("stream_id", "seq", *INPUTS, *FRAME))
                if i != stream:
                    stream, session = i, new()
                    session.share = True
                made.append((i, q, *session.step(dict(zip(INPUTS, values)), _source(*values[len(INPUTS) :]))))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)

    arranged = dealt(rows.select("stream_id", "seq", *INPUTS, *FRAME), "stream_id").sortWithinPartitions("stream_id", "seq")
    return arranged.mapInArrow(run, f"stream_id long, seq long, {OUTPUT}")


#: What a frame shows before it is encoded, and what it takes to encode its picture. A picture is named by all that it follows from: `base` by the one
#: before it (parent), its source and its settings; `node` by that and, where it is an intra picture, by the number that its unit bears.
_DECIDED = "stream_id long, seq long, width int, height int, recommended boolean, fps int, speed int, qp int, target_bps long, idr boolean, intra_refresh boolean, frame_num int, node binary, helper boolean"
_MADE = "branch binary, base binary, parent binary, depth int, picture long, satd boolean, sub boolean, idr_pic_id int"
_CODES = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
#: Pictures behind this one of a group are a task's together (a branch), which encodes those before it (helpers) for itself.
SPLIT = 2
#: Names that a task of decisions remembers, so that it tells once what a picture takes.
TOLD = 1 << 17


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, _CODES[k]) for n, k in (x.split() for x in schema.split(", "))])


def _decided(rows: DataFrame, new: Callable[[], Session]) -> DataFrame:
    """_DECIDED and, once a task for each picture, _MADE; helper: a row that is no frame but a picture that a branch needs."""
    names, out = (*INPUTS, "picture"), _arrow(f"{_DECIDED}, {_MADE}")
    untold, no_frame = (None,) * len(_MADE.split(", ")), (None,) * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, session, told = object(), None, set()
        for batch in batches:
            made = []
            for i, q, *values, picture in zip(*(batch.column(n).to_pylist() for n in ("stream_id", "seq", *names))):
                if i != stream:
                    stream, session, base, idr_pic_id = i, new(), None, 0
                decision, recommended, anew = session.decide(dict(zip(INPUTS, values)))
                if base is None or anew:
                    idr_pic_id, depth, parent = 0 if base is None else 1 - idr_pic_id, 0, b""
                else:
                    depth, parent = depth + 1, base
                (w, h), speed, qp = session.sizes[session.rung], decision["speed"], max(0, min(51, decision["base_qp"]))
                satd, sub = (speed < 3, speed < 2) if depth else (False, False)  # an intra picture does not search
                base = md5(parent + struct.pack("<qiiibb", picture, w, h, qp, satd, sub)).digest()
                node = base if depth else base + bytes((idr_pic_id,))
                if depth <= SPLIT:
                    before, branch = before[:depth] if depth else [], base
                    before.append((w, h, qp, base, (base, parent, depth, picture, satd, sub, idr_pic_id)))
                tell = untold
                if node not in told:
                    if len(told) >= TOLD:
                        told.clear()
                    told.add(node)
                    tell = branch, base, parent, depth, picture, satd, sub, idr_pic_id
                    for pw, ph, pqp, name, rest in before[:-1] if depth <= SPLIT else ():
                        made.append((None, None, pw, ph, None, None, None, pqp, *no_frame, name, True, branch, *rest))
                made.append((i, q, w, h, recommended, decision["fps"], speed, qp, decision["target_bps"], not depth, decision["intra_refresh"], depth % 16, node, False, *tell))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)

    return rows.select("stream_id", F.col("seq").cast("long").alias("seq"), *names).mapInArrow(run, f"{_DECIDED}, {_MADE}")


def _encoded_nodes(rows: DataFrame, base_qp: int) -> DataFrame:
    """(node, n_bytes, sse, digest) for rows (branch, depth, width, height, FRAME, nodes), the pictures of a branch at one place of its groups."""
    out = _arrow("node binary, n_bytes int, sse long, digest string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, states = None, {}
        for b in batches:
            for k in range(b.num_rows):
                branch, depth, w, h, nodes, *frame = (b.column(n)[k].as_py() for n in ("branch", "depth", "width", "height", "nodes", *FRAME))
                if branch != now:
                    now, states = branch, {}
                planes, kept, made, parent = scaled(_source(*frame), w, h), {}, [], None
                for x in sorted(nodes, key=lambda x: (x["parent"], x["node"])):
                    group = inter.Group(base_qp, 1, tables(), x["idr_pic_id"])
                    if depth:
                        group.number, (group.reference, group.motion) = depth, states[x["parent"]]
                        if x["parent"] != parent:
                            parent, known = x["parent"], {}
                        group.known = known
                    n_bytes, digest, sse = (pictured_once if depth <= SPLIT else pictured)(group, planes, x["qp"], x["satd"], x["sub"])
                    kept[x["base"]] = group.reference, group.motion
                    if not x["helper"]:
                        made.append((x["node"], n_bytes, sse, digest))
                states = kept
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)

    return rows.mapInArrow(run, "node binary, n_bytes int, sse long, digest string")


def encoded_once(rows: DataFrame, pictures: DataFrame, new: Callable[[], Session], path: str) -> DataFrame:
    """As `encoded`, for sessions whose decisions do not read what was encoded: each different picture is encoded once for all streams.

    rows: (stream_id, seq, INPUTS, picture), together by stream and in order of seq; pictures: (picture, FRAME), one of each number that rows name; path: a
    new folder that driver and executors share, for the decisions, which are both what is to be encoded and what the results are joined to.
    """
    session = new()
    if session.recovery is not None or session.resize is not at_once:
        raise ValueError("a policy may read what was encoded, so its streams are encoded one by one")
    spark = rows.sparkSession
    _decided(rows, new).write.parquet(path)
    decided = spark.read.parquet(path)
    nodes = decided.where("branch IS NOT NULL").select("node", "width", "height", "qp", "helper", *(x.split()[0] for x in _MADE.split(", "))).dropDuplicates(["branch", "node", "helper"])
    node = F.struct("node", "base", "parent", "qp", "satd", "sub", "idr_pic_id", "helper")
    places = nodes.groupBy("branch", "depth", "width", "height", "picture").agg(F.collect_list(node).alias("nodes"))
    places = dealt(places.join(pictures, "picture").select("branch", "depth", "width", "height", "nodes", *FRAME), "branch").sortWithinPartitions("branch", "depth")
    done = _encoded_nodes(places, session.config.base_qp)
    frames = decided.where("NOT helper").join(done, "node", "left")
    lost = F.when(F.col("n_bytes").isNull(), F.raise_error(F.lit("a frame has no picture")).cast("int")).otherwise(F.col("n_bytes")).alias("n_bytes")
    return frames.select("stream_id", "seq", *(lost if n == "n_bytes" else n for n in _NAMES))


def stream_encoded(rows: DataFrame, new: Callable[[], Session]) -> DataFrame:
    """The same over a streaming table. Rows of a micro-batch are taken by seq; a row behind one that is encoded already is ignored."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        session = new().restore(*state.get) if state.exists else new()
        given = pd.concat(list(parts)).sort_values("seq")  # one micro-batch of one stream
        made = []
        for i, q, *values in given.loc[given["seq"] > session.seq, ["stream_id", "seq", *INPUTS, *FRAME]].itertuples(index=False):
            made.append((i, q, *session.step(dict(zip(INPUTS, values)), _source(*values[len(INPUTS) :]))))
            session.seq = int(q)
        state.update(session.saved())
        yield pd.DataFrame(made, columns=["stream_id", "seq", *_NAMES])

    return rows.groupBy("stream_id").applyInPandasWithState(fold, f"stream_id long, seq long, {OUTPUT}", SAVED, "append", GroupStateTimeout.NoTimeout)
