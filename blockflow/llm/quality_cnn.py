"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters
(byte embedding, then a convolution with ReLU) run over each chunk; they are max-pooled and
averaged in a chunk, chunks are max-pooled and averaged in a document, and one linear
layer combines the result into one probability.

The network is fitted on the driver on at most `fit_rows` labelled rows, those of smallest
hashed id, each whole, as far as FIT_BYTES reach, by Adam over mini-batches of chunks; scoring covers every text whole, one
chunk block at a time, so memory does not grow with a text.

Defined results: null and empty texts get the score of one chunk of padding; repeated rows get
equal scores; a table without labels gives a score of untrained weights; a label row occurring twice counts
once, as does a document whose id repeats; null labels and labels of null ids are left out; a document with a null id is
scored like any other; an empty table gives an empty result; other columns pass through (one named `score` is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled

#: Bounds of the sample that the network is fitted on.
FIT_ROWS, FIT_BYTES = 2_000, 64_000_000
CHUNK, STEP = 1_024, 768
WIDTH, STRIDE, EMBED, FILTERS = 8, 4, 6, 16
BLOCK = 64
#: Features of a chunk: maxima and means of the learned filters.
N_CHUNK = 2 * FILTERS


def chunks_of(text: str | None) -> np.ndarray:
    """(n, CHUNK) bytes, overlapping, all of the text; the last chunk is padded with 0."""
    b = np.frombuffer((text or "").encode(), np.uint8)
    n = 1 + max(0, -(-(len(b) - CHUNK) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(b)] = b
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


class Net:
    """Parameters and the forward pass."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        self.p = {"E": f(256, EMBED, s=0.5), "W": f(WIDTH * EMBED, FILTERS, s=0.15), "c": np.zeros(FILTERS, np.float32), "v": f(2 * N_CHUNK, s=0.1), "b": np.zeros(1, np.float32)}

    def windows(self, x: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)[:, ::STRIDE]

    def conv(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        idx = self.windows(x)
        emb = self.p["E"][idx].reshape(*idx.shape[:2], WIDTH * EMBED)
        return idx, emb, np.maximum(emb @ self.p["W"] + self.p["c"], 0)

    def chunk_features(self, x: np.ndarray) -> np.ndarray:
        _, _, a = self.conv(x)
        return np.concatenate([a.max(axis=1), a.mean(axis=1)], axis=1)

    def document(self, text: str | None) -> np.ndarray:
        x = chunks_of(text)
        top, total = np.full(N_CHUNK, -np.inf, np.float32), np.zeros(N_CHUNK, np.float64)
        for at in range(0, len(x), BLOCK):
            g = self.chunk_features(x[at : at + BLOCK])
            top, total = np.maximum(top, g.max(axis=0)), total + g.sum(axis=0)
        return np.concatenate([top, (total / len(x)).astype(np.float32)])

    def score(self, text: str | None) -> float:
        z = float(self.document(text) @ self.p["v"] + self.p["b"][0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _gradients(net: Net, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients of a batch: chunks x, the document of each, the labels of the documents."""
    p, n = net.p, len(y)
    idx, emb, a = net.conv(x)
    t = a.shape[1]
    g = np.concatenate([a.max(axis=1), a.mean(axis=1)], axis=1)
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    per = np.diff(np.append(starts, len(owner)))
    top, mean = np.maximum.reduceat(g, starts, axis=0), np.add.reduceat(g, starts, axis=0) / per[:, None]
    h = np.concatenate([top, mean], axis=1)
    z = h @ p["v"] + p["b"][0]
    q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    dz = ((q - y) / n).astype(np.float32)
    dh = dz[:, None] * p["v"]
    largest = g == top[owner]  # chunks of equal maxima share the gradient
    shared = dh[:, :N_CHUNK] / np.add.reduceat(largest, starts, axis=0, dtype=np.float32)
    dg = (dh[:, N_CHUNK:] / per[:, None])[owner] + np.where(largest, shared[owner], 0)
    da = np.repeat(dg[:, None, FILTERS : 2 * FILTERS] / t, t, axis=1)
    at = a.argmax(axis=1)
    rows, cols = np.indices(at.shape)
    da[rows, at, cols] += dg[:, :FILTERS]
    da *= a > 0
    flat = da.reshape(-1, FILTERS)
    demb = (flat @ p["W"].T).reshape(-1, EMBED)
    dE = np.stack([np.bincount(idx.reshape(-1), demb[:, k], 256) for k in range(EMBED)], axis=1)
    loss = float(-(y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7)).mean())
    return loss, {"E": dE.astype(np.float32), "W": emb.reshape(-1, WIDTH * EMBED).T @ flat, "c": flat.sum(axis=0), "v": h.T @ dz + 1e-5 * p["v"], "b": np.array([dz.sum()], np.float32)}


def fit(rows: list[tuple[str, int]], bytes_seen: int = 48_000_000, batch: int = 24, seed: int = 7, rate: float = 0.01) -> Net:
    """Fit on (text, label) pairs, equal ones once, by Adam. Passes end after so many bytes of chunks."""
    net = Net(seed)
    rows = sorted(set(rows))
    if len({y for _, y in rows}) < 2:
        return net
    r = np.random.default_rng(seed)
    docs = [(chunks_of(t), y) for t, y in rows]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    total = sum(len(x) for x, _ in docs) * CHUNK
    passes = max(2, min(30, bytes_seen // max(1, total)))
    step, due = 0, passes * max(1, sum(len(x) for x, _ in docs) // batch)
    for _ in range(passes):
        group, size = [], 0
        for k in [*r.permutation(len(docs)), -1]:
            if k >= 0:
                group.append(k)
                size += len(docs[k][0])
            if group and (size >= batch or k < 0):
                x = np.concatenate([docs[j][0] for j in group])
                owner = np.repeat(np.arange(len(group)), [len(docs[j][0]) for j in group])
                _, grad = _gradients(net, x, owner, np.array([docs[j][1] for j in group], np.float32))
                step += 1
                lr = rate * max(0.05, 1 - step / (due * 1.2))
                for name, d in grad.items():
                    m[name] = 0.9 * m[name] + 0.1 * d
                    s[name] = 0.99 * s[name] + 0.01 * d * d
                    net.p[name] -= (lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
                group, size = [], 0
    return net


def scores(docs: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs with `score`. labels (doc_id, label) count only where `train`, a column over its doc_id, holds."""
    net = fit([(t or "", y) for t, y in labelled(docs, labels, train, F.col(text), doc_id, label, fit_rows, FIT_BYTES)])
    params = net.p

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Net()
        own.p = params
        for part in parts:
            yield pd.Series([own.score(t) for t in part], dtype=float)

    return docs.withColumn("score", score(F.col(text)))
