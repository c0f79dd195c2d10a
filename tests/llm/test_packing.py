"""op11: ids against the tokenizers library, windows by their own laws."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from blockflow.llm import packing as P

from . import cases

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
KIND = "doc_id long, text string, start int, ids string, offset string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


def pieces(spark, texts, capacity, most=32, ids=None):
    rows = [(i if ids is None else ids[i], t, 7, "x", "y") for i, t in enumerate(texts)]
    out = P.pack(spark.createDataFrame(rows, KIND).repartition(5) if rows else spark.createDataFrame(rows, KIND), PATH, 2, capacity, most)
    assert out.columns == ["doc_id", "start", "doc_tokens", "sequence_id", "offset", "ids"]
    return out


def check(found, expected: dict[object, list[list[int]]], capacity):
    """Every id is in one piece, every sequence gapless, and full or a power of two."""
    at, windows = defaultdict(list), defaultdict(list)
    for r in found:
        ids = np.frombuffer(r.ids, np.uint32).tolist()
        assert ids
        at[r.doc_id].append((r.start, r.doc_tokens, ids))
        windows[r.sequence_id].append((r.offset, len(ids)))
    for doc, own in expected.items():
        # Rows that repeat an id: their pieces are told apart by what they hold.
        got = sorted(at[doc])
        if len(own) == 1:
            assert [i for _, _, ids in got for i in ids] == own[0] and {n for _, n, _ in got} == {len(own[0])}
            assert [s for s, _, _ in got] == np.cumsum([0] + [len(x) for _, _, x in got])[:-1].tolist()
        else:
            assert sorted(i for _, _, ids in got for i in ids) == sorted(i for o in own for i in o)
    assert set(at) == set(expected)
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == np.cumsum([0] + [n for _, n in w])[:-1].tolist()
        n = sum(n for _, n in w)
        assert n == capacity or n & (n - 1) == 0 and n < capacity
    assert sum(sum(n for _, n in w) != capacity for w in windows.values()) <= capacity.bit_length()


@pytest.mark.parametrize("capacity,most", [(4096, 32), (256, 4), (64, 1), (7, 3), (1, 1)])
def test_every_id_is_packed_once(spark, library, capacity, most):
    texts = [t if capacity > 8 or not t or len(t) < 3_000 else t[:300] for t in cases.edge_texts()] + [cases.prose(k, 5 + 37 * k % 400) for k in range(60)]
    check(pieces(spark, texts, capacity, most).collect(), {i: [library(t)] for i, t in enumerate(texts)}, capacity)


def test_null_and_repeated_ids(spark, library):
    texts = ["one two", "one two", None, "three", "", "four " * 900]
    ids = [1, 1, 1, None, None, 5]
    expected = {1: [library(t) for t in texts[:3]], None: [library("three"), library("")], 5: [library(texts[5])]}
    check(pieces(spark, texts, 64, 2, ids).collect(), expected, 64)


def test_empty_table(spark):
    assert pieces(spark, [], 16).collect() == []


def test_merging_by_rounds(spark, library, monkeypatch):
    monkeypatch.setattr(P, "FAN", 2)
    texts = [cases.prose(k, 20) for k in range(80)]
    found = pieces(spark, texts, 512, 3).collect()
    check(found, {i: [library(t)] for i, t in enumerate(texts)}, 512)
    assert max(r.sequence_id >> 58 for r in found) >= 2


def test_ids_of_odd_texts(library):
    encoder = P.Encoder(open(PATH, "rb").read())
    r = random.Random(3)
    odd = list("ab'Z9_ .!\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 　éÉßſKİΣςﬀ日😀́̌​J") + ["'s", "'LL", "<|endoftext|>", "ẖ", "J̌", "H̱", "don't"]
    texts = ["".join(r.choice(odd) for _ in range(r.randint(0, 60))) for _ in range(2_000)]
    for _ in range(2):  # the second time from memory
        ids, at = encoder.texts(pa.array([*texts, None]))
        assert [ids[a:b].tolist() + [2] for a, b in zip(at, at[1:])] == [library(t) for t in [*texts, None]]


def test_memory_of_chunks_is_bounded(library, monkeypatch):
    monkeypatch.setattr(P, "MEMORY", 300)
    encoder = P.Encoder(open(PATH, "rb").read())
    texts = [cases.prose(k, 60) for k in range(30)] + ["y" * 500]
    ids, at = encoder.texts(pa.array(texts))
    assert [ids[a:b].tolist() + [2] for a, b in zip(at, at[1:])] == [library(t) for t in texts]
    assert sum(map(len, encoder.young)) <= 300 + P.LONGEST and sum(map(len, encoder.old)) <= 300 + P.LONGEST and len(encoder.parts) <= 10


def test_best_fit_and_the_fullest_leaves():
    p = P.Packer(10, 2)
    for doc, n in enumerate((6, 7, 3, 4, 8)):
        p.add((doc, 0, n, bytes(4 * n)))
    # 6 and 7 open two windows, 3 fills that of 7, 4 that of 6; 8 opens a third.
    assert [(r[0][0], r[1], r[2], r[3]) for r in p.done] == [(1, 1, 0, True), (2, 1, 7, True), (0, 0, 0, True), (3, 0, 6, True)]
    p.done = []
    p.add((5, 0, 7, bytes(28)))
    p.add((6, 0, 9, bytes(36)))  # fits nowhere: the window of 8 takes 2 of it and leaves, 7 go on
    assert [(r[0][0], r[0][1], len(r[0][3]) // 4, r[1], r[2]) for r in p.done] == [(4, 0, 8, 2, 0), (6, 0, 2, 2, 8)]
    assert sorted(p.free) == [(7, -4), (7, -3)]


def test_sequences_are_padded(spark, library):
    texts = [cases.prose(k, 30) for k in range(9)]
    found = pieces(spark, texts, 64)
    rows = P.sequences(found, 64).collect()
    assert all(r.padded == len(r.ids) // 4 == r.n_tokens for r in rows)  # full or a power of two
    assert sum(r.n_tokens for r in rows) == sum(len(library(t)) for t in texts)
    cut = P.sequences(found.where("offset = 0 and octet_length(ids) = 12"), 64).collect()
    assert all(r.padded == 64 and r.ids[12:] == bytes(4 * 61) for r in cut)
