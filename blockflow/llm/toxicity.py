"""Toxicity by noisy-channel deobfuscation.

A character trigram model over all texts of the table is counted on the executors (at most
64^3 numbers reach the driver). A text's characters form lattices: a sign offers the letters that it may stand for
(leetspeak), a letter that repeats the one before may be left out (repetition), and a space or separator may be kept, as a
boundary between words, or left out (spacing), each at a cost. A Viterbi decode finds the likeliest text under channel and
language model:

* a word whose lattice has more than one path, that is with a sign, a separator or a doubled letter, is decoded by itself,
  every other word has only itself; lattices of letters alone have few paths, which are weighed many words at a time;
* three or more single characters in a row are decoded as one lattice, whose spaces are kept or left out, so words apart
  letter by letter come back as words;
* any other space is weighed by what its two ways cost under the model (split words); where leaving it out is likelier,
  the joined word is added, and decoded like any word.

The restored text is then scored by logistic regression over its words and word beginnings.

The classifier is fitted on at most `fit_rows` labelled rows, those of smallest hashed
id, and at most FIT_BYTES of their words; the language model and the scoring cover every text whole.

Defined results: null and empty texts get the score of a text without features; an
unlabelled table gives score 0 everywhere; repeated rows get equal scores; a label row
occurring twice counts once, as does a document whose id repeats; null labels and labels of null ids are left out; a document
with a null id is scored like any other; other columns pass through (one named `score` is replaced); an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import product
from math import prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled

#: Bounds of the sample that the classifier is fitted on, and of the words that one generation of a worker's memory holds.
FIT_ROWS, FIT_BYTES, CACHE = 5_000, 64_000_000, 300_000
#: Characters of the language model: 0 is any other, then a-z, then the letters from U+00DF to U+00FF.
ALPHABET = 64
#: What each sign may stand for in leetspeak.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Channel costs in nats: a sign for a letter, a dropped separator, a kept one, a dropped repetition, a dropped space between words.
SWAP, DROP, KEEP, REPEAT, JOIN = 1.0, 0.5, 3.0, 2.0, 4.0
_SIGNS = re.escape("".join(LEET))
_L = "a-zß-ÿ"
_MARKS = "._*-"
#: A word whose lattice has more than one path, and which has a letter.
_DISGUISED = re.compile(rf"(?=.*[{_L}])(?:.*[{_SIGNS}{re.escape(_MARKS)}]|.*(.)\1)", re.DOTALL)
_SIGNED = re.compile(rf"[{_SIGNS}{re.escape(_MARKS)}]")
_RUN = re.compile(r"(.)\1+", re.DOTALL)
_APART = re.compile(rf"(?<!\S)[{_L}{_SIGNS}](?:[ {re.escape(_MARKS)}][{_L}{_SIGNS}]){{2,}}[.,!?]*(?!\S)")
_SPLIT = re.compile(rf"[{re.escape(_MARKS)}]+")
#: Paths of a lattice of letters that are listed; one of more is decoded step by step. Characters taken at a time.
PATHS, TAKE = 16, 500_000
_END = ".,!?;:"
_TRIM = ".,;:!?\"'()[]{}<>*#%&$|-_"


_CODE = np.zeros(0x110000, np.int16)
_CODE[0x61:0x7B] = np.arange(1, 27)
_CODE[0xDF:0x100] = np.arange(27, 60)


def _codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(code, n) of all character trigrams of all lower-cased texts; words stand between zeros."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET**3, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                c = _codes(f"  {(t or '').lower()} ")
                total += np.bincount((c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:], minlength=ALPHABET**3) if len(c) > 50_000 else 0
                if len(c) <= 50_000:
                    np.add.at(total, (c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    return docs.select(text).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class Channel:
    """Restores disguised words. cost: negative log-probabilities of the third character of each trigram."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(ALPHABET, ALPHABET, ALPHABET).astype(np.float64) + 0.01
        table = -np.log(c / c.sum(axis=2, keepdims=True))
        self.cost, self.flat = table.tolist(), table.reshape(-1).astype(np.float32)
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def _arcs(self, c: str, before: str) -> list[tuple[str, float]]:
        """What a character may stand for: (letter, space or nothing, channel cost)."""
        arcs = [(x, SWAP) for x in LEET.get(c, "")]
        if c == " ":
            return [("", DROP), (" ", 0.0)]
        if c in _MARKS:
            return [("", DROP), (" ", KEEP)]
        if c.isalpha():
            arcs.append((c, 0.0))
        if c == before:
            arcs.append(("", REPEAT))
        return arcs or [("", DROP)]

    def decode(self, token: str) -> str:
        """The likeliest plain text: Viterbi over states of the last two characters, a space among them."""
        code = lambda x: int(_codes(x)[0])
        # A state's way is a chain of links (character, chain before), so a token of any length costs time in proportion.
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        before = ""
        for ch in token:
            arcs = [(x, channel, code(x) if x else -1) for x, channel in self._arcs(ch, before)]
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, way) in states.items():
                for letter, channel, z in arcs:
                    if letter:
                        key, value = (b, z), cost + channel + self.cost[a][b][z]
                    else:
                        key, value = (a, b), cost + channel
                    if key not in after or value < after[key][0]:
                        after[key] = (value, (letter, way) if letter else way)
            states, before = after, ch
        way = min(((cost + self.cost[a][b][0], (a, b), way) for (a, b), (cost, way) in states.items()), key=lambda x: x[:2])[2]
        out = []
        while way:
            letter, way = way
            out.append(letter)
        return "".join(reversed(out))

    def listed(self, words: list[str]) -> list[str]:
        """The likeliest plain word of each lattice of letters alone: the lengths of its runs are all its choices."""
        texts, drops, owner = [], [], []
        for k, w in enumerate(words):
            parts, runs, at = [], [], 0
            for m in _RUN.finditer(w):
                parts.append(w[at : m.start()])
                runs.append(m[0])
                at = m.end()
            for cut in product(*(range(len(r)) for r in runs)):
                texts.append("".join(x for p, r, d in zip(parts, runs, cut) for x in (p, r[d:])) + w[at:])
                drops.append(sum(cut))
                owner.append(k)
        if not texts:
            return []
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        c = _codes("  " + "  ".join(texts) + " ")
        cost = self.flat[(c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:]].astype(np.float64)
        # Position of each text's first letter among the trigrams' last ones, and the one behind its closing space.
        start = np.cumsum(size + 2) - (size + 2)
        running = np.concatenate([[0.0], np.cumsum(cost)])
        total = running[start + size + 1] - running[start] + REPEAT * np.array(drops)
        owner = np.array(owner)
        order = np.lexsort((np.array(drops), np.round(total, 9), owner))
        return [texts[i] for i in order[np.flatnonzero(np.concatenate([[True], owner[order][1:] != owner[order][:-1]]))]]

    def _learn(self, words: set[str]) -> None:
        """Afterwards each of the words is in the young generation, with its decoded form (of one with signs or separators, its pieces too)."""
        new = words.difference(self.young)
        if len(self.young) + len(new) > CACHE:
            self.old, self.young, new = self.young, {}, words
        met = new.intersection(self.old)
        self.young.update((w, self.old[w]) for w in met)
        few: list[str] = []
        for w in new.difference(met):
            core = w.strip(_END + _MARKS)
            if not _DISGUISED.match(core):
                self.young[w] = w
            elif _SIGNED.search(core) or prod(len(m[0]) for m in _RUN.finditer(core)) > PATHS:
                self.young[w] = " ".join(dict.fromkeys([self.decode(core), *_SPLIT.split(core)]))
            else:
                few.append(w)
        self.young.update(zip(few, self.listed([w.strip(_END + _MARKS) for w in few])))

    def joined(self, text: str) -> list[str]:
        """Words that were split by a space which is likelier left out. text is lower-case, with one space between words."""
        c = _codes(f"  {text}  ")
        at = np.flatnonzero((c[2:-2] == 0) & (c[1:-3] > 0) & (c[3:-1] > 0)) + 2
        if not len(at):
            return []
        a, b, x, y = c[at - 2], c[at - 1], c[at + 1], c[at + 2]
        end, start = (a * ALPHABET + b) * ALPHABET, x * ALPHABET + y
        # Costs of what ends a word and of what begins one, and of the join of both.
        kept = self.flat[end] + self.flat[b * ALPHABET**2 + x] + self.flat[start]
        left_out = self.flat[end + x] + self.flat[b * ALPHABET**2 + start]
        out, last = [], -1
        for g in (at[left_out + JOIN < kept] - 2).tolist():
            if text[g] != " ":  # some other character that is no letter
                continue
            stop = text.find(" ", g + 1)
            stop = len(text) if stop < 0 else stop
            if last == g:  # the word before was joined to the left, too
                out[-1] += text[g + 1 : stop]
            else:
                out.append(text[text.rfind(" ", 0, g) + 1 : g] + text[g + 1 : stop])
            last = stop
        return out

    def seen(self, text: str) -> set[str]:
        """The words of a text, those joined, and those apart letter by letter."""
        low = " ".join(text.lower().split())
        found = set(low.split(" "))
        found.update(self.joined(low))
        for m in _APART.finditer(low):
            run = m[0].rstrip(_END)
            found.update(self.decode(run).split())
            found.add(_SPLIT.sub("", run.replace(" ", "")))
        return found

    def restored(self, texts: list[str]) -> Iterator[set[str]]:
        """The words of each restored text."""
        group, size = [], 0
        for k, t in enumerate(texts):
            group.append(self.seen(t))
            size += len(t)
            if size >= TAKE or k == len(texts) - 1:
                self._learn(set().union(*group))
                for found in group:
                    out = set(map(self.young.__getitem__, found))
                    apart = [w for w in out if " " in w]
                    out.update(x for w in apart for x in w.split())
                    yield out.difference(apart)
                group, size = [], 0

    def words(self, text: str) -> set[str]:
        return next(self.restored([text]))


def features_of(word: str) -> list[str]:
    """A word and its beginnings of 4 and 5 letters."""
    w = word.strip(_TRIM)
    return [w, *(f"{w[:k]}~" for k in (4, 5) if len(w) > k)] if len(w) > 2 else []


class Model:
    """Logistic regression over the presence of features."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        # A feature is the beginning of a word, or the whole of a short one.
        self.starts = {f.rstrip("~")[:k] for f in weights for k in (3, 4)}

    def score(self, words: set[str]) -> float:
        found: set[str] = set()
        for w in words:
            if w[:4] in self.starts:
                found.update(f for f in features_of(w) if f in self.weights)
            elif w[:1] in _TRIM:
                found.update(f for f in features_of(w) if f in self.weights)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + sum(map(self.weights.__getitem__, sorted(found)))))))


def fit(rows: list[tuple[frozenset[str], int]], least: int = 4, steps: int = 600) -> Model:
    """Fit on (restored words, label) pairs. Equal ones count once; a feature needs `least` texts of label 1."""
    rows = sorted(set(rows), key=lambda r: (sorted(r[0]), r[1]))
    sets = [({f for w in words for f in features_of(w)}, y) for words, y in rows]
    n1 = sum(y for _, y in sets)
    if not 0 < n1 < len(sets):
        return Model({}, 30.0 if n1 else -30.0)
    pos, neg = Counter(), Counter()
    for s, y in sets:
        (pos if y else neg).update(s)
    rate = n1 / len(sets)
    pick = lambda f: (pos[f] + 8 * rate) / (pos[f] + neg[f] + 8) > 0.3 + rate  # noqa: E731  surely more often toxic than not
    names = sorted(f for f in pos if pos[f] >= least and pick(f))
    at = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(sets), len(names)), np.float32)
    for r, (s, _) in enumerate(sets):
        x[r, [at[f] for f in s if f in at]] = 1
    y = np.array([y for _, y in sets], np.float32)
    w, b = np.zeros(len(names), np.float32), math.log(rate / (1 - rate))
    mw, mb, vw, vb = np.zeros_like(w), 0.0, np.zeros_like(w), 0.0
    for t in range(1, steps + 1):  # Adam
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        gw, gb = x.T @ e / len(y) + 1e-5 * w, float(e.mean())
        mw, mb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb
        vw, vb = 0.999 * vw + 0.001 * gw**2, 0.999 * vb + 0.001 * gb**2
        r1, r2 = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.1 * (mw / r1) / (np.sqrt(vw / r2) + 1e-8)
        b -= 0.1 * (mb / r1) / (math.sqrt(vb / r2) + 1e-8)
    return Model({f: float(v) for f, v in zip(names, w) if v > 0.05}, b)


_channels: dict[str, Channel] = {}


def channel_of(key: str, shared) -> Channel:
    """The worker's channel for those counts (by their digest); it outlives tasks, and only the last one stays."""
    if key not in _channels:
        _channels.clear()
        _channels[key] = Channel(shared.value)
    return _channels[key]


def scores(docs: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs with `score`. labels (doc_id, label) count only where `train`, a column over its doc_id, holds."""
    spark = docs.sparkSession
    counts = np.zeros(ALPHABET**3, np.int64)
    for code, n in trigram_counts(docs, text).collect():  # at most ALPHABET^3 rows
        counts[code] = n
    shared, key = spark.sparkContext.broadcast(counts), sha256(counts.tobytes()).hexdigest()
    @F.pandas_udf("string")
    def restored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        channel = channel_of(key, shared)
        for part in parts:
            yield pd.Series([" ".join(sorted(w)) for w in channel.restored([t or "" for t in part])], dtype=object)

    model = fit([(frozenset((t or "").split()), y) for t, y in labelled(docs, labels, train, restored(F.col(text)), doc_id, label, fit_rows, FIT_BYTES)])
    weights, bias = model.weights, model.bias

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        channel, own = channel_of(key, shared), Model(weights, bias)
        for part in parts:
            yield pd.Series([own.score(w) for w in channel.restored([t or "" for t in part])], dtype=float)

    return docs.withColumn("score", score(F.col(text)))
