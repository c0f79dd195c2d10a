"""op12: the relational audit against counting by the definition."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from blockflow.llm import divergence as V

from . import cases

KIND = "doc_id long, text string, lang string, source string, rank int, term string"


def by_definition(rows, least: int, top: int) -> set[tuple]:
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = sorted(s for x, s in groups if x == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = shares(sum((counts[lang, s] for s in own), Counter()))
        p = {s: shares(counts[lang, s]) for s in own}
        for s in own:
            pairs = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            out |= {(lang, s, "pair", o, v, k) for k, (v, o) in enumerate(pairs, 1)} | {(lang, s, "term", t, v, k) for k, (v, t) in enumerate(terms, 1)}
    return out


def got(spark, rows, least, top=50):
    found = V.divergence(spark.createDataFrame(rows, KIND), least=least, top=top)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in found.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_against_the_definition(spark):
    texts = cases.edge_texts() + [cases.prose(k % 7, 90, 60) for k in range(60)]
    rows = [(i, t, ("en", "de", "en", None)[i % 4], f"s{i % 5}" if i % 11 else None, i, "x") for i, t in enumerate(texts)]
    for least, top in ((1, 50), (4, 3), (20, 50)):
        assert got(spark, rows, least, top) == by_definition(rows, least, top)


def test_ties_nulls_repeats_and_languages_without_words(spark):
    rows = [(1, "same words here", "en", s, 0, None) for s in ("a", "b", "c")] * 2
    rows += [(2, "Ä É ä", "fr", "x", 0, None), (None, None, "fr", "y", 0, None), (3, "12 34", None, None, 0, None), (3, "12 34", None, None, 0, None)]
    found = got(spark, rows, 2)
    assert found == by_definition(rows, 2, 50)
    assert {("en", "a", "pair", "b", 0, 1), ("en", "a", "pair", "c", 0, 2), ("fr", "x", "pair", "y", 0, 1), ("fr", "y", "pair", "x", 0, 1)} <= found
    assert not [r for r in found if r[0] == ""]


def test_one_source_holds_most_rows(spark):
    rows = [(i, cases.prose(i % 50, 40, 80), "en", "hot" if i % 3 else f"s{i % 9}", 0, None) for i in range(400)]
    assert got(spark, rows, 30) == by_definition(rows, 30, 50)


def test_empty_table(spark):
    assert got(spark, [], 1) == set()
