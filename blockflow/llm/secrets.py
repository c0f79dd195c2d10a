"""Secret scan: fixed patterns, and novelty under a dictionary-primed zstandard model.

The base kinds (assign, access, hex) are patterns. The method adds kind `novel`: a
candidate is a run of 16 or more token characters that begins at most NEAR characters behind a sensitive
word, on its line; its marginal bytes are what the compressed context
grows by when the candidate is appended. The dictionary is trained on identifiers that are joined in the ways of code, so it
holds their parts and, what tells more on short strings, their letter statistics: words and names that it has never seen cost less
than a key, whose characters are all alike to it. A candidate is reported where the marginal bytes reach RATIO of its length.

A sensitive word is a whole one: no letter stands around it, but for a hump as in authToken and a plural s.

Defined results: a null text is scanned as the empty text; positions are code points,
end exclusive; overlaps between base kinds stay, novel spans overlap no base span; equal rows
give equal spans, and there are no ties; ids are not read, so they may be null or repeat; other columns pass through (one
named `spans` is replaced); a text of any length is scanned whole, in time in proportion; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# A run shorter than the least length can hold no longer one, so the least length may stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
SENSITIVE = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "access key", "private_key", "private key", "credential", "bearer", "auth")
_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE)), re.IGNORECASE | re.ASCII)
#: Characters of a candidate at least.
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Characters that may stand between a sensitive word and a candidate; those around it that prime the model.
NEAR, AROUND = 48, 400
RATIO = 0.78
#: Identifiers that code and prose around secrets commonly use.
IDENTIFIERS = (
    "import export return function class public private protected static const final void string integer boolean double float "
    "length index value values result response request session config configuration environment variable default option "
    "username password passwd secret token apikey api_key access_key secret_key private_key client_id client_secret "
    "authorization authentication bearer credential certificate database connection timeout localhost example "
    "https://www.example.com/path/index.html?query=value abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
    "the and that with this from have been were which would there their about into than other"
)


#: Lines of joined identifiers that the dictionary is trained on, and its bytes.
LINES, DICTIONARY = 3_000, 16_384


@cache
def trained(identifiers: str) -> zstandard.ZstdCompressionDict:
    """A dictionary of the parts of `identifiers`, joined as code joins them; the same for the same words."""
    r, parts = random.Random(1), [p for w in identifiers.lower().split() if w.replace("_", "").isalpha() for p in w.split("_")]

    def joined_parts() -> str:
        own = [r.choice(parts) for _ in range(r.randint(1, 5))]
        way = r.randrange(6)
        if way < 2:
            return "".join(w.capitalize() if k or way else w for k, w in enumerate(own))
        return ("_", "-", "/", " ")[way - 2].join(own)

    return zstandard.train_dictionary(DICTIONARY, [" ".join(joined_parts() for _ in range(12)).encode() for _ in range(LINES)], level=3)


def sensitive(text: str) -> Iterator[re.Match]:
    """The sensitive words of a text that are whole."""
    for m in _SENSITIVE.finditer(text):
        before, word, after = text[m.start() - 1 : m.start()], m[0], text[m.end() : m.end() + 2]
        hump = before.islower() and word[0].isupper()
        if before.isalpha() and not hump:
            continue
        if after[:1].lower() == "s" and not after[1:].isalpha() or not after[:1].isalpha() or word[-1].islower() and after[0].isupper():
            yield m


class Scanner:
    def __init__(self, identifiers: str = IDENTIFIERS, ratio: float = RATIO):
        compress = zstandard.ZstdCompressor(level=3, dict_data=trained(identifiers), write_content_size=False).compress
        self.size = lambda data: len(compress(data))
        self.ratio = ratio

    def marginal(self, context: str, candidate: str) -> float:
        """Bytes that the candidate adds to the compressed context, a byte of it."""
        before = context.encode()
        return (self.size(before + candidate.encode()) - self.size(before)) / max(1, len(candidate))

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind as listed."""
        low = text.lower()
        found = []
        if "AKIA" in text:
            found += [("access", *m.span()) for m in ACCESS.finditer(text)]
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
        if any(w in low for w in SENSITIVE):
            found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
            taken = sorted(x[1:] for x in found)
            starts, reach = [x for x, _ in taken], [0, *accumulate((y for _, y in taken), max)]
            # The spans that begin before b end at reach[...] at the latest.
            found += [("novel", a, b) for a, b in self._novel(text) if reach[bisect_left(starts, b)] <= a]
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))

    def _novel(self, text: str) -> Iterator[tuple[int, int]]:
        end = 0
        for s in sensitive(text):
            stop = s.end() + NEAR + LEAST  # the first LEAST characters of what begins in reach
            for m in CANDIDATE.finditer(text, max(end, s.end()), stop):
                if "\n" in text[s.end() : m.start()]:
                    break
                if m.end() == stop:
                    m = CANDIDATE.match(text, m.start())  # whole, also beyond the window
                end = m.end()
                around = text[max(0, m.start() - AROUND) : m.start()] + text[m.end() : m.end() + AROUND]
                if self.marginal(around, m[0]) >= self.ratio:
                    yield m.span()


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `spans`: array of (kind, start, end)."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner()
        for part in parts:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in scanner.spans(t or "")] for t in part], dtype=object)

    return docs.withColumn("spans", run(F.col(text)))


def digest(spans: Column) -> list[Column]:
    """n_assign, n_access, n_hex, base_sha256 and spans (string) of a column of scan()."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    line = lambda x: F.array_join(F.transform(x, one), ",")
    of = lambda kind: F.filter(spans, lambda s: s["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return [*counts, F.sha2(line(F.filter(spans, lambda s: s["kind"] != "novel")).cast("binary"), 256).alias("base_sha256"), line(spans).alias("spans")]


def redact(docs: DataFrame, text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """docs with every span of the text replaced by the mark (overlapping spans by one); a null text stays null."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner()
        for part in parts:
            yield pd.Series([None if t is None else redacted(t, scanner.spans(t), mark) for t in part], dtype=object)

    return docs.withColumn(text, run(F.col(text)))


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
