"""Rate control, recovery and adaptation: ordered folds over feedback streams.

`step` is one pure function (state, feedback) -> decision. The batch query folds each stream
by it in one Arrow pass that carries the state of one stream; the streaming job keeps the same state in the state store.
A stream's rows are folded in order, as the semantics ask; streams are independent, so the
work is spread by stream.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockflow.functions import tables as T
from blockflow.functions.folds import folded
from blockflow.sources import adapters as A


@dataclass(frozen=True)
class Config:
    min_bps: int = 500_000
    max_bps: int = 50_000_000
    initial_bps: int = 8_000_000
    min_qp: int = 10
    max_qp: int = 51
    base_qp: int = 28
    burst: float = 2.0
    down: float = 0.7
    up: float = 1.05
    loss: float = 0.02
    rtt_times: int = 2
    rtt_floor_ms: float = 50.0
    severe_rtt_times: int = 3
    severe_rtt_floor_ms: float = 100.0
    settled_rtt_times: float = 1.25
    jitter_times: int = 2
    jitter_floor_ms: float = 10.0
    decode_budget: float = 1.0
    queue_bytes: int = 100_000
    stability_window: int = 60
    idr_cooldown: int = 60
    adaptation_cooldown: int = 30


@dataclass
class State:
    rtt: float = 0.0
    jitter: float = 0.0
    bps: int = 0
    stable: int = 0
    overshoots: int = 0
    idr_wait: int = 0
    idr: int = 0
    pli: int = 0
    fir: int = 0
    a_rtt: float = 0.0
    a_jitter: float = 0.0
    a_wait: int = 0
    speed: int = 1
    fps: int = 60
    rung: int = 0
    seq: int = -1


def drift(base: float, sample: float) -> float:
    """A lower sample is taken at once, a higher one by 1/256 of the gap; none below zero."""
    if sample <= 0:
        return base
    return sample if base <= 0 or sample < base else base + (sample - base) / 256.0


def qp_for(bps: int, loss: float, c: Config) -> int:
    qp, target = c.base_qp, max(1, bps)
    while c.initial_bps >= 2 * target and qp - c.base_qp < 48:
        qp, target = qp + 6, target * 2
    qp += 3 if 2 * c.initial_bps >= 3 * target else 1 if 5 * c.initial_bps >= 6 * target else 0
    return max(c.min_qp, min(c.max_qp, qp + (2 if loss > 0.05 else 0)))


def rate_step(s: State, f: dict, c: Config) -> dict:
    """Congestion cuts, a jitter spike holds, stability raises, an estimate caps."""
    spike = False
    if f["rtt_ms"] > 0:
        s.rtt = drift(s.rtt, f["rtt_ms"])  # before the comparison: a spike lifts its own threshold a little
        spike = f["rtt_ms"] > s.rtt * c.rtt_times and f["rtt_ms"] > c.rtt_floor_ms
    congestion = f["loss"] > c.loss or spike or f["queue_bytes"] > c.queue_bytes or f["nacks"] > 5
    shaky = False
    if f["jitter_ms"] > 0:
        s.jitter = drift(s.jitter, f["jitter_ms"])
        shaky = f["jitter_ms"] > s.jitter * c.jitter_times and f["jitter_ms"] > c.jitter_floor_ms
    if congestion:
        s.bps, s.stable = max(c.min_bps, int(s.bps * c.down)), 0
    elif shaky:
        pass
    elif s.stable >= c.stability_window:
        s.bps, s.stable = min(c.max_bps, int(s.bps * c.up)), 0
    else:
        s.stable += 1
    if f["estimate_bps"] > 0 and s.bps > (cap := max(c.min_bps, f["estimate_bps"])):
        s.bps, s.stable = cap, 0
    return {"congestion": congestion, "jitter_spike": shaky, "target_bps": s.bps, "stable": s.stable, "base_qp": qp_for(s.bps, f["loss"], c)}


def recovery_step(s: State, f: dict, c: Config) -> dict:
    """Full-intra request over picture loss over scene change; in cooldown the first two ask for refresh. A reset zeroes counters and cooldown first."""
    if f.get("reset"):
        s.idr = s.pli = s.fir = s.idr_wait = 0
    force, refresh, reason = False, False, ""
    name = "FIR" if f["fir"] else "PLI" if f["pli"] else ""
    if name == "FIR":
        s.fir += 1
    elif name == "PLI":
        s.pli += 1
    if name and s.idr_wait <= 0:
        force, reason = True, "FIR_requested" if name == "FIR" else "PLI_detected"
    elif name:
        refresh, reason = True, f"{name}_cooldown_fallback"
    elif f["scene_change"] and s.idr_wait <= 0:
        force, reason = True, "scene_change"
    if force:
        s.idr, s.idr_wait = s.idr + 1, c.idr_cooldown
    if s.idr_wait > 0:
        s.idr_wait -= 1
    return {"force_idr": force, "intra_refresh": refresh, "recovery_reason": reason, "idr_count": s.idr, "pli_count": s.pli, "fir_count": s.fir}


def adaptation_step(s: State, f: dict, c: Config, encode_ms: float = 5.0) -> dict:
    """Cascade down by speed, rate of frames, resolution; up in the reverse order; one move a cooldown."""
    s.a_rtt, s.a_jitter = drift(s.a_rtt, f["rtt_ms"]), drift(s.a_jitter, f["jitter_ms"])
    reason = ""
    if s.a_wait > 0:
        s.a_wait -= 1
    else:
        rtt, decode, gap = f["rtt_ms"], f["decode_ms"], 1000.0 / max(1, s.fps)
        severe = f["loss"] > 0.10 or (s.a_rtt > 0 and rtt > s.a_rtt * c.severe_rtt_times and rtt > c.severe_rtt_floor_ms) or f["queue_bytes"] > 200_000 or encode_ms > gap * 0.90
        behind = lambda budget: decode is not None and decode == decode and decode > 0 and decode > gap * budget
        fps_at = T.FPS.index(s.fps)
        if severe or behind(c.decode_budget):
            cause = "severe_congestion" if severe else "client_decode_delay"
            if s.speed < 3:
                s.speed, reason = s.speed + 1, f"speed_mode_increase_{cause}"
            elif fps_at < len(T.FPS) - 1:
                s.fps, reason = T.FPS[fps_at + 1], f"fps_reduction_{cause}"
            elif s.rung < len(T.RESOLUTIONS) - 1:
                s.rung, reason = s.rung + 1, f"resolution_reduction_{cause}"
        else:
            jitter = f["jitter_ms"]
            shaky = jitter > 0 and s.a_jitter > 0 and jitter > s.a_jitter * c.jitter_times and jitter > c.jitter_floor_ms
            settled = rtt < 40 or (s.a_rtt > 0 and rtt < s.a_rtt * c.settled_rtt_times)
            if f["loss"] < 0.01 and settled and not shaky and not behind(c.decode_budget * 0.5) and f["queue_bytes"] < 20_000 and encode_ms < 1000.0 / 60 * 0.5:
                if s.rung > 0:
                    s.rung, reason = s.rung - 1, "resolution_increase_stable"
                elif fps_at > 0:
                    s.fps, reason = T.FPS[fps_at - 1], "fps_increase_stable"
                elif s.speed > 0:
                    s.speed, reason = s.speed - 1, "speed_mode_decrease_stable"
        if reason:
            s.a_wait = c.adaptation_cooldown
    w, h, _ = T.RESOLUTIONS[s.rung]
    return {"width": w, "height": h, "fps": s.fps, "speed": s.speed, "adaptation_reason": reason}


def step(s: State, f: dict, c: Config) -> dict:
    """The composite decision: rate, recovery once, then the adaptation overlay, whose outcome is what the next step starts from."""
    fps, speed, encode_ms = s.fps, s.speed, f.get("encode_ms", 5.0)
    out = rate_step(s, f, c)
    if encode_ms > 1000.0 / fps * 0.75:
        s.speed = min(3, speed + 1)
        out["base_qp"] = min(c.max_qp, out["base_qp"] + 2)
    out["max_frame_bytes"] = max(100, int(s.bps / 8.0 / fps * c.burst))
    if f.get("last_bytes", 0) > out["max_frame_bytes"]:
        s.overshoots += 1
    out["overshoots"] = s.overshoots
    return out | recovery_step(s, f, c) | adaptation_step(s, f, c, encode_ms)


#: Columns of a decision by the part that makes them, and what each part reads.
RATE = "congestion boolean, jitter_spike boolean, target_bps long, stable int, base_qp int"
RECOVERY = "force_idr boolean, intra_refresh boolean, recovery_reason string, idr_count int, pli_count int, fir_count int"
ADAPTATION = "width int, height int, fps int, speed int, adaptation_reason string"
COMPOSITE = f"{RATE}, max_frame_bytes int, overshoots int, {RECOVERY}, {ADAPTATION}"
INPUTS = ("rtt_ms", "jitter_ms", "loss", "queue_bytes", "nacks", "pli", "fir", "estimate_bps", "decode_ms", "scene_change", "encode_ms", "last_bytes")
PARTS = {
    RATE: (lambda s, f, c: rate_step(s, f, c), ("rtt_ms", "jitter_ms", "loss", "queue_bytes", "nacks", "estimate_bps")),
    RECOVERY: (lambda s, f, c: recovery_step(s, f, c), ("pli", "fir", "scene_change", "reset")),
    ADAPTATION: (lambda s, f, c: adaptation_step(s, f, c, f.get("encode_ms", 5.0)), ("rtt_ms", "jitter_ms", "loss", "queue_bytes", "decode_ms", "encode_ms")),
    COMPOSITE: (lambda s, f, c: step(s, f, c), INPUTS),
}


def decisions(feedback: DataFrame, config: Config = Config(), part: str = COMPOSITE, arranged: bool = False) -> DataFrame:
    """stream_id, seq and the columns of that part for each feedback row, by stream in order of seq."""
    fold, reads = PARTS[part]
    names = [n for n in reads if n in feedback.columns]
    out = [x.split()[0] for x in part.split(", ")]

    def one(state: State, *values) -> tuple:
        made = fold(state, dict(zip(names, values)), config)
        return tuple(made[n] for n in out)

    return folded(feedback, names, part, lambda: State(bps=config.initial_bps), one, arranged)


def stream_decisions(feedback: DataFrame, config: Config = Config(), idle_ms: int | None = None) -> DataFrame:
    """The same over a streaming feedback table (columns of adapters.feedback): state by stream, rows of a batch by seq.

    A row that arrives behind a later one of its stream (in another batch) is ignored: decisions once made stand. With
    idle_ms a stream that is silent for so long is forgotten and starts anew, so a job that runs on holds only streams that live; a job
    that ends with its input (trigger availableNow) must leave it out, since time-outs keep a query going.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    columns = ["stream_id", "seq", *(x.split()[0] for x in COMPOSITE.split(", "))]
    kinds = {float: "double", int: "long"}
    fields = [(k, type(v)) for k, v in asdict(State()).items()]

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = State(**dict(zip([k for k, _ in fields], state.get))) if state.exists else State(bps=config.initial_bps)
        rows = pd.concat(list(parts)).sort_values("seq")  # one micro-batch of one stream
        rows = rows[rows["seq"] > s.seq]
        names = [n for n in INPUTS if n in rows.columns]
        made = [{"stream_id": i, "seq": q} | step(s, dict(zip(names, v)), config) for i, q, *v in rows[["stream_id", "seq", *names]].itertuples(index=False)]
        if len(rows):
            s.seq = int(rows["seq"].iloc[-1])
        state.update(tuple(t(getattr(s, k)) for k, t in fields))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(made, columns=columns)

    schema = ", ".join(f"{k} {kinds[t]}" for k, t in fields)
    return feedback.groupBy("stream_id").applyInPandasWithState(fold, f"stream_id long, seq int, {COMPOSITE}", schema, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


SMALL = Config(stability_window=5, idr_cooldown=6, adaptation_cooldown=3)


def _calm(spark, d):
    """A calmer mapping of the same events, which reaches upshifts and recovery."""
    return A.feedback(spark, d).withColumns({"loss": F.col("loss") / 5, "queue_bytes": F.expr("queue_bytes div 5").cast("int"), "nacks": F.expr("queue_bytes div 30000").cast("int"), "encode_ms": F.col("encode_ms") / 3})


CALM_SQL = f"SELECT * REPLACE (loss / 5 AS loss, queue_bytes // 5 AS queue_bytes, queue_bytes // 30000 AS nacks, encode_ms / 3 AS encode_ms) FROM ({A.FEEDBACK_SQL})"


def _drift_sql(base: str, sample: str) -> str:
    return f"CASE WHEN {sample} <= 0 THEN {base} WHEN {base} <= 0 OR {sample} < {base} THEN {sample} ELSE {base} + ({sample} - {base}) / 256.0::DOUBLE END"


def rate_sql(source: str, c: Config) -> str:
    """The rate fold as a recursive CTE."""
    cut = f"greatest({c.min_bps}, CAST(trunc(p.bps * {c.down}::DOUBLE) AS BIGINT))"
    rise = f"least({c.max_bps}, CAST(trunc(p.bps * {c.up}::DOUBLE) AS BIGINT))"
    cap = f"greatest({c.min_bps}, estimate_bps)"
    return f"""WITH RECURSIVE f AS MATERIALIZED ({source}),
r(stream_id, seq, rtt, jitter, bps, stable, congestion, shaky, loss) AS (
  SELECT DISTINCT stream_id, CAST(-1 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, CAST({c.initial_bps} AS BIGINT), CAST(0 AS BIGINT), false, false, 0.0::DOUBLE FROM f
  UNION ALL
  SELECT stream_id, seq, rtt, jitter, CASE WHEN estimate_bps > 0 AND b > {cap} THEN {cap} ELSE b END, CASE WHEN estimate_bps > 0 AND b > {cap} THEN 0 ELSE s END, congestion, shaky, loss FROM (
    SELECT *, CASE WHEN congestion THEN cut WHEN shaky THEN bps WHEN stable >= {c.stability_window} THEN rise ELSE bps END AS b,
      CASE WHEN congestion THEN 0 WHEN shaky THEN stable WHEN stable >= {c.stability_window} THEN 0 ELSE stable + 1 END AS s FROM (
      SELECT *, loss > {c.loss} OR (rtt_ms > 0 AND rtt_ms > rtt * {c.rtt_times} AND rtt_ms > {c.rtt_floor_ms}) OR queue_bytes > {c.queue_bytes} OR nacks > 5 AS congestion,
        jitter_ms > 0 AND jitter_ms > jitter * {c.jitter_times} AND jitter_ms > {c.jitter_floor_ms} AS shaky FROM (
        SELECT f.*, {_drift_sql('p.rtt', 'f.rtt_ms')} AS rtt, {_drift_sql('p.jitter', 'f.jitter_ms')} AS jitter, p.bps, p.stable, {cut} AS cut, {rise} AS rise
        FROM r p JOIN f ON f.stream_id = p.stream_id AND f.seq = p.seq + 1))))
SELECT stream_id, CAST(seq AS INT) AS seq, congestion, shaky AS jitter_spike, bps AS target_bps, CAST(stable AS INT) AS stable, CAST(floor(rtt * 1000) AS BIGINT) AS rtt_base_us, loss FROM r WHERE seq >= 0"""


def qp_sql(source: str, c: Config) -> str:
    """QP of a target: halvings are counted by a range join, so no loop is shared with step()."""
    return f"""SELECT stream_id, seq, target_bps, congestion, jitter_spike, stable, CAST(greatest({c.min_qp}, least({c.max_qp}, {c.base_qp} + 6 * h + CASE WHEN 2 * {c.initial_bps} >= 3 * t THEN 3 WHEN 5 * {c.initial_bps} >= 6 * t THEN 1 ELSE 0 END
  + CASE WHEN loss > 0.05 THEN 2 ELSE 0 END)) AS INT) AS base_qp, CAST(greatest(100, trunc(target_bps / 8.0::DOUBLE / 60 * {c.burst})) AS INT) AS max_frame_bytes FROM (SELECT *, greatest(1, target_bps) * (1::BIGINT << h) AS t FROM (
  SELECT *, (SELECT count(*) FROM range(8) k(i) WHERE {c.initial_bps} >= (2::BIGINT << k.i) * greatest(1, target_bps)) AS h FROM ({source})))"""


def recovery_sql(source: str, c: Config, reset: str = "false") -> str:
    return f"""WITH RECURSIVE f AS MATERIALIZED (SELECT *, {reset} AS zero FROM ({source})),
r(stream_id, seq, wait, idr, pli, fir, force, refresh, reason) AS (
  SELECT DISTINCT stream_id, CAST(-1 AS BIGINT), 0, 0, 0, 0, false, false, '' FROM f
  UNION ALL
  SELECT f.stream_id, f.seq, greatest(0, CASE WHEN p.wait <= 0 AND (f.fir OR f.pli OR f.scene_change) THEN {c.idr_cooldown} ELSE p.wait END - 1),
    p.idr + CASE WHEN p.wait <= 0 AND (f.fir OR f.pli OR f.scene_change) THEN 1 ELSE 0 END, p.pli + CASE WHEN f.pli AND NOT f.fir THEN 1 ELSE 0 END, p.fir + CASE WHEN f.fir THEN 1 ELSE 0 END,
    p.wait <= 0 AND (f.fir OR f.pli OR f.scene_change), p.wait > 0 AND (f.fir OR f.pli),
    CASE WHEN f.fir AND p.wait <= 0 THEN 'FIR_requested' WHEN f.fir THEN 'FIR_cooldown_fallback' WHEN f.pli AND p.wait <= 0 THEN 'PLI_detected' WHEN f.pli THEN 'PLI_cooldown_fallback'
      WHEN f.scene_change AND p.wait <= 0 THEN 'scene_change' ELSE '' END
  FROM (SELECT r.stream_id, r.seq, CASE WHEN zero THEN 0 ELSE wait END AS wait, CASE WHEN zero THEN 0 ELSE idr END AS idr, CASE WHEN zero THEN 0 ELSE r.pli END AS pli, CASE WHEN zero THEN 0 ELSE r.fir END AS fir FROM r JOIN f ON f.stream_id = r.stream_id AND f.seq = r.seq + 1) p
  JOIN f ON f.stream_id = p.stream_id AND f.seq = p.seq + 1)
SELECT stream_id, CAST(seq AS INT) AS seq, force AS force_idr, refresh AS intra_refresh, reason AS recovery_reason, idr AS idr_count, pli AS pli_count, fir AS fir_count FROM r WHERE seq >= 0"""


def adaptation_sql(source: str, c: Config, pressed: bool = False) -> str:
    """The cascade as a recursive CTE. pressed: a slow encode raises the speed first, as the composite decision does; then also how."""
    encode_ms = "encode_ms"
    gap = "(1000.0::DOUBLE / CASE fps_at WHEN 0 THEN 60 WHEN 1 THEN 30 ELSE 15 END)"
    calm = f"{encode_ms} < 1000.0::DOUBLE / 60 * 0.5"
    slow = "f.encode_ms > 1000.0::DOUBLE / CASE p.fps_at WHEN 0 THEN 60 WHEN 1 THEN 30 ELSE 15 END * 0.75"
    return f"""WITH RECURSIVE f AS MATERIALIZED ({source}),
r(stream_id, seq, rtt, jitter, wait, speed, fps_at, rung, reason, slow, fps_used) AS (
  SELECT DISTINCT stream_id, CAST(-1 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 0, 1, 0, 0, '', false, 60 FROM f
  UNION ALL
  SELECT stream_id, seq, rtt, jitter, CASE WHEN wait > 0 THEN wait - 1 WHEN move <> '' THEN {c.adaptation_cooldown} ELSE 0 END,
    speed + CASE WHEN move = 'S+' THEN 1 WHEN move = 'S-' THEN -1 ELSE 0 END, fps_at + CASE WHEN move = 'F+' THEN 1 WHEN move = 'F-' THEN -1 ELSE 0 END, rung + CASE WHEN move = 'R+' THEN 1 WHEN move = 'R-' THEN -1 ELSE 0 END,
    CASE move WHEN 'S+' THEN 'speed_mode_increase_' || cause WHEN 'F+' THEN 'fps_reduction_' || cause WHEN 'R+' THEN 'resolution_reduction_' || cause
      WHEN 'R-' THEN 'resolution_increase_stable' WHEN 'F-' THEN 'fps_increase_stable' WHEN 'S-' THEN 'speed_mode_decrease_stable' ELSE '' END,
    slow, CASE fps_at WHEN 0 THEN 60 WHEN 1 THEN 30 ELSE 15 END
  FROM (SELECT *, CASE WHEN severe THEN 'severe_congestion' ELSE 'client_decode_delay' END AS cause,
    CASE WHEN wait > 0 THEN '' WHEN severe OR behind THEN CASE WHEN speed < 3 THEN 'S+' WHEN fps_at < 2 THEN 'F+' WHEN rung < 4 THEN 'R+' ELSE '' END
      WHEN good THEN CASE WHEN rung > 0 THEN 'R-' WHEN fps_at > 0 THEN 'F-' WHEN speed > 0 THEN 'S-' ELSE '' END ELSE '' END AS move FROM (
    SELECT *, loss > 0.10 OR (rtt > 0 AND rtt_ms > rtt * {c.severe_rtt_times} AND rtt_ms > {c.severe_rtt_floor_ms}) OR queue_bytes > 200000 OR {encode_ms} > {gap} * 0.90 AS severe,
      coalesce(decode_ms > 0 AND decode_ms > {gap} * {c.decode_budget}, false) AS behind,
      loss < 0.01 AND (rtt_ms < 40 OR (rtt > 0 AND rtt_ms < rtt * {c.settled_rtt_times})) AND NOT (jitter_ms > 0 AND jitter > 0 AND jitter_ms > jitter * {c.jitter_times} AND jitter_ms > {c.jitter_floor_ms})
        AND NOT coalesce(decode_ms > 0 AND decode_ms > {gap} * {c.decode_budget * 0.5}, false) AND queue_bytes < 20000 AND {calm} AS good FROM (
      SELECT f.*, {_drift_sql('p.rtt', 'f.rtt_ms')} AS rtt, {_drift_sql('p.jitter', 'f.jitter_ms')} AS jitter, p.wait, {'least(3, p.speed + CASE WHEN ' + slow + ' THEN 1 ELSE 0 END)' if pressed else 'p.speed'} AS speed, {slow} AS slow, p.fps_at, p.rung
      FROM r p JOIN f ON f.stream_id = p.stream_id AND f.seq = p.seq + 1))))
SELECT stream_id, CAST(seq AS INT) AS seq, [1920, 1600, 1280, 960, 640][rung + 1] AS width, [1080, 900, 720, 540, 360][rung + 1] AS height, [60, 30, 15][fps_at + 1] AS fps, speed, reason AS adaptation_reason, slow, fps_used FROM r WHERE seq >= 0"""


def composite_sql(source: str, c: Config) -> str:
    """Rate, recovery and cascade side by side: they meet only in the speed and QP of a slow encode and in the frame rate of the byte limit."""
    return f"""SELECT q.stream_id, q.seq, q.congestion, q.jitter_spike, q.target_bps, q.stable, least({c.max_qp}, q.base_qp + CASE WHEN a.slow THEN 2 ELSE 0 END) AS base_qp,
  CAST(greatest(100, trunc(q.target_bps / 8.0::DOUBLE / a.fps_used * {c.burst})) AS INT) AS max_frame_bytes,
  CAST(sum(CASE WHEN f.last_bytes > greatest(100, trunc(q.target_bps / 8.0::DOUBLE / a.fps_used * {c.burst})) THEN 1 ELSE 0 END) OVER (PARTITION BY q.stream_id ORDER BY q.seq) AS INT) AS overshoots,
  v.force_idr, v.intra_refresh, v.recovery_reason, v.idr_count, v.pli_count, v.fir_count, a.width, a.height, a.fps, a.speed, a.adaptation_reason
  FROM ({qp_sql(rate_sql(source, c), c)}) q JOIN ({adaptation_sql(source, c, pressed=True)}) a ON a.stream_id = q.stream_id AND a.seq = q.seq JOIN ({recovery_sql(source, c)}) v ON v.stream_id = q.stream_id AND v.seq = q.seq JOIN ({source}) f ON f.stream_id = q.stream_id AND f.seq = q.seq"""


# The adapters number a stream's rows by a window, which leaves them arranged.
def bitrate(spark, d):
    return decisions(A.feedback(spark, d), SMALL, RATE, arranged=True).drop("base_qp")


def bitrate_calm(spark, d):
    return decisions(_calm(spark, d), SMALL, RATE, arranged=True).drop("base_qp")


def rtt_baseline(spark, d):
    """The baseline fold alone."""

    def one(state: list[float], rtt: float) -> tuple:
        state[0] = drift(state[0], rtt)
        return (math.floor(state[0] * 1000),)

    return folded(A.feedback(spark, d), ["rtt_ms"], "rtt_base_us long", lambda: [0.0], one, arranged=True)


def qp_decision(spark, d):
    return decisions(_calm(spark, d), SMALL, RATE, arranged=True).select("stream_id", "seq", "target_bps", "base_qp")


def recovery(spark, d):
    return decisions(A.feedback(spark, d), SMALL, RECOVERY, arranged=True)


def recovery_reset(spark, d):
    """Recovery whose counters and cooldown are zeroed on every thirtieth row of a stream."""
    return decisions(A.feedback(spark, d).withColumn("reset", F.col("seq") % 30 == 29), SMALL, RECOVERY, arranged=True)


def adaptation(spark, d):
    return decisions(_calm(spark, d), SMALL, ADAPTATION, arranged=True)


def composite(spark, d):
    return decisions(A.feedback(spark, d), SMALL, arranged=True)


def composite_calm(spark, d):
    return decisions(_calm(spark, d), SMALL, arranged=True)


_RATE = rate_sql(A.FEEDBACK_SQL, SMALL)
_CALM_RATE = rate_sql(CALM_SQL, SMALL)
_COLS = "stream_id, seq, congestion, jitter_spike, target_bps, stable"
CATALOG = {
    "q_rtt_baseline": (rtt_baseline, f"SELECT stream_id, seq, rtt_base_us FROM ({_RATE})"),
    "q_bitrate": (bitrate, f"SELECT {_COLS} FROM ({_RATE})"),
    "q_bitrate_calm": (bitrate_calm, f"SELECT {_COLS} FROM ({_CALM_RATE})"),
    "q_qp_decision": (qp_decision, f"SELECT stream_id, seq, target_bps, base_qp FROM ({qp_sql(_CALM_RATE, SMALL)})"),
    "q_recovery": (recovery, recovery_sql(A.FEEDBACK_SQL, SMALL)),
    "q_recovery_reset": (recovery_reset, recovery_sql(A.FEEDBACK_SQL, SMALL, "seq % 30 = 29")),
    "q_adaptation_cascade": (adaptation, f"SELECT * EXCLUDE (slow, fps_used) FROM ({adaptation_sql(CALM_SQL, SMALL)})"),
    "q_composite_decision": (composite, composite_sql(A.FEEDBACK_SQL, SMALL)),
    "q_composite_calm": (composite_calm, composite_sql(CALM_SQL, SMALL)),
}
