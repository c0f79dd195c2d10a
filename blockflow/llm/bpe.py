"""Byte-level BPE through sentencepiece.

A sentencepiece BPE model is serialised directly from a rank vocabulary: each byte is
mapped to one letter, each piece is scored by its negative rank, normalisation is the
identity, and a piece's id is its rank. Pre-tokens are encoded separately; decoding maps
ids to pieces and pieces back to bytes. The model (about 1 MB, bounded by the
vocabulary) is broadcast, so executors need no tokenizer file.

Defined results: a null text is encoded as the empty text (no ids); texts of any length
are encoded whole; equal rows give equal results; null ids and any other columns pass through (one
named like a result is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Pre-tokens that one generation of a worker's memory holds, and the characters taken at a time: memory bounds, no limits on input.
CACHE, TAKE = 100_000, 500_000
_OFFSET = 0x100
_TO_CHAR = {b: _OFFSET + b for b in range(256)}
#: Wire numbers of the public sentencepiece model format.
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _int(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _float(field: int, x: float) -> bytes:
    import struct

    return _varint(field << 3 | 5) + struct.pack("<f", x)


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHAR)


def model_of(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model; ranks must be 0 to n - 1, the unknown piece is n."""
    pieces = sorted(ranks, key=ranks.__getitem__)
    if [ranks[p] for p in pieces] != list(range(len(pieces))):
        raise ValueError("ranks have gaps")
    body = [_bytes(1, _bytes(1, mapped(p).encode()) + _float(2, -float(k)) + _int(3, _NORMAL)) for k, p in enumerate(pieces)]
    body.append(_bytes(1, _bytes(1, b"<unk>") + _float(2, 0.0) + _int(3, _UNKNOWN)))
    trainer = _int(3, _BPE) + _int(4, len(pieces) + 1) + b"".join(_int(f, n) for f, n in ((40, len(pieces)), (41, -1), (42, -1), (43, -1)))
    identity = _bytes(1, b"identity") + _int(3, 0) + _int(4, 0) + _int(5, 0)
    return b"".join(body) + _bytes(2, trainer) + _bytes(3, identity)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """encode and decode of whole texts. The ids of a pre-token are remembered as one string of decimals, in two
    generations: when the young one is full it becomes the old one, whose entries come back when they are met again."""

    def __init__(self, model: bytes, pattern: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        n = self.sp.get_piece_size() - 1
        back = lambda s: bytes(ord(c) - _OFFSET for c in s)
        self.bytes_of = {str(k): back(self.sp.id_to_piece(k)) for k in range(n)}
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def _learn(self, tokens: set[str]) -> None:
        """Afterwards every one of the tokens is in the young generation."""
        new = tokens.difference(self.young)
        if len(self.young) + len(new) > CACHE:
            self.old, self.young = self.young, {}
            new = tokens
        met = new.intersection(self.old)
        self.young.update((t, self.old[t]) for t in met)
        if fresh := list(new.difference(met)):
            ids = self.sp.encode([mapped(t.encode()) for t in fresh], num_threads=1)
            self.young.update((t, ",".join(map(str, i))) for t, i in zip(fresh, ids))

    def lines(self, texts: list[str]) -> list[str]:
        """The ids of each text as decimals joined by commas."""
        found = [self.find(t) for t in texts]
        self._learn(set().union(*found))
        known = self.young.__getitem__
        return [",".join(map(known, tokens)) for tokens in found]

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.lines([text])[0].split(",") if x]

    def decode(self, ids: list[str]) -> bytes:
        """Bytes of ids, given as decimals."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[str, Codec] = {}


def codec_of(key: str, model: bytes, pattern: str) -> Codec:
    """The worker's codec of that key (a digest of model and pattern); it outlives tasks, and only the last one stays."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model, pattern)
    return _codecs[key]


def _takes(texts: list[str]) -> Iterator[list[str]]:
    """Neighbours of at most TAKE characters together; a longer text alone."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > TAKE:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", digest: bool = False) -> DataFrame:
    """docs with ids (array of int) and decoded (binary); with digest=True instead n_tokens, ids_sha256
    (of the decimal ids joined by commas) and decoded_sha256."""
    model = model_of(load_ranks(path))
    key = sha256(model + pattern.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary"

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = codec_of(key, shared.value, pattern)
        for part in parts:
            rows = []
            for group in _takes([t or "" for t in part]):
                for line in codec.lines(group):
                    ids = line.split(",") if line else []
                    data = codec.decode(ids)
                    rows.append((len(ids), sha256(line.encode()).hexdigest(), sha256(data).hexdigest()) if digest else (list(map(int, ids)), data))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"])

    names = [x.split()[0] for x in kind.split(", ")]
    kept = docs.drop(*(n for n in names if n != text))
    if text in names:
        raise ValueError(f"the text column may not be named {text}")
    made = unused("bpe", docs.columns)
    return kept.withColumn(made, run(F.col(text))).select(*kept.columns, f"{made}.*")
