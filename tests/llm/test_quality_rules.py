import re
import unicodedata
from collections import Counter

from blockflow.llm import quality_rules as Q
from tests.llm.cases import SCHEMA, edge_texts, prose, rows


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    repeat = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat))


def verdict(text):
    """fail_bits by brute force."""
    text = text or ""
    words, chars, symbols, dup, repeat = brute(text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    fails = [words < 50, 100 * repeat > 50 * words, 100 * symbols > 20 * words, 100 * upper > 40 * chars, 100 * dup > 50 * lines, chars < 2 * words, chars > 14 * words, words >= 50 and 100 * repeat > 50 * words, words == 0]
    return sum(1 << k for k, f in enumerate(fails) if f)


def test_measures_match_brute_force(spark):
    texts = edge_texts() + [prose(k, 200, 8) for k in range(6)]
    out = Q.ledger(spark.createDataFrame(rows(texts), SCHEMA)).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), r.doc_id
        assert r.fail_bits == verdict(texts[r.doc_id])
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert bool(r.fail_bits & Q.mask("base")) == base


def test_policies_and_ablation(spark):
    led = Q.ledger(spark.createDataFrame(rows(edge_texts()), SCHEMA))
    bits = {r.doc_id: r.fail_bits for r in led.collect()}
    kept = {r.doc_id for r in Q.apply_policy(led, "v2").where("kept").collect()}
    assert kept == {i for i, b in bits.items() if not b & Q.mask("v2")}
    assert {6, 7, 9, 10} <= kept and not {0, 1, 11, 12, 13, 14} & kept
    table = {r.rule: r for r in Q.ablation(led, "v2").collect()}
    assert set(table) == set(Q.POLICIES["v2"])
    for name in table:
        k = Q.RULES.index(name)
        assert table[name].n_failed == sum(b >> k & 1 for b in bits.values())
        assert table[name].n_only == sum(b & Q.mask("v2") == 1 << k for b in bits.values())


def test_policies_read_the_stored_ledger_alone(spark):
    docs = spark.createDataFrame(rows(edge_texts()), SCHEMA)
    led = Q.stored(docs)
    assert "text" not in led.columns and led.count() == len(edge_texts())
    plan = Q.apply_policy(led, "v1")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "xxhash64" not in plan
    for v in Q.POLICIES:
        kept = {r.doc_id for r in Q.apply_policy(led, v).where("kept").collect()}
        assert kept == {i for i, t in enumerate(edge_texts()) if not verdict(t) & Q.mask(v)}
    assert {0, 1, 2}.isdisjoint({r.doc_id for r in Q.apply_policy(led, "v3").where("kept").collect()})
    assert {3, 4} <= {r.doc_id for r in Q.apply_policy(led, "v3").where("kept").collect()}  # short ones stay


def test_filter_stays_above_the_measures(spark):
    led = Q.ledger(spark.createDataFrame(rows(edge_texts()), SCHEMA)).where(~Q.failed("v2"))
    plan = led._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("monotonically_increasing_id")


def test_empty_and_clashing_columns(spark):
    assert Q.ledger(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b c", 7, "x", "y", 1), (1, "a b c", 7, "x", "y", 1), (None, None, 7, "x", "y", 1)], "doc_id long, text string, n_words long, _w string, words_ string, fail_bits int")
    out = Q.ledger(df).collect()
    assert sorted(r.n_words for r in out) == [0, 3, 3] and all((r._w, r.words_) == ("x", "y") for r in out) and {r.fail_bits for r in out} == {33, 257}
