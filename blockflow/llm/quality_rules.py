"""Quality rules as a bitmask ledger (built-in functions only, no shuffle).

``ledger`` evaluates every rule once a document: the measurements and one failure bit a rule.
``stored`` writes it without the texts. ``apply_policy`` is then a bitwise AND against the mask of a
named policy version, and ``ablation`` counts by bitwise aggregation what each rule
adds. A change of policy re-reads the stored ledger, never the texts.

Defined results: a null text counts as a text without words; an empty text has 0 in
every measurement and fails the rule on few words; texts of any length are measured whole; repeated rows are judged
independently and ids are not read; other columns pass through, whatever their names (those named like a measurement or
fail_bits are replaced); an empty table gives an empty ledger.

3-word windows are compared by a 64-bit hash within one text; for a text of 100,000
words the chance of any false repetition is below 3e-10.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, unused, words_of, written

SYMBOLS = r"[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def _rules() -> dict[str, Column]:
    c = F.col
    return {
        "few_words": c("n_words") < 50,
        "repeated_words": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 100 * c("n_symbols") > 20 * c("n_words"),
        "upper_case": 100 * c("n_upper") > 40 * c("word_chars"),
        "repeated_lines": 100 * c("n_dup_lines") > 50 * c("n_lines"),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 14 * c("n_words"),
        "repeated_in_long": (c("n_words") >= 50) & (100 * c("n_repeat_words") > 50 * c("n_words")),
        "no_words": c("n_words") == 0,
    }


#: Bit k of a ledger is rule k. Names are only ever appended, so old ledgers stay valid.
RULES = ("few_words", "repeated_words", "symbols", "upper_case", "repeated_lines", "short_words", "long_words", "repeated_in_long", "no_words")
#: v3 does not hold it against a text that it is short, only that it is empty.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "v2": ("few_words", "repeated_words", "symbols", "upper_case", "repeated_lines", "short_words", "long_words"),
    "v3": ("symbols", "upper_case", "repeated_in_long", "short_words", "long_words", "no_words"),
}


def mask(policy: str) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[policy])


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with MEASURES."""
    if text in MEASURES:
        raise ValueError(f"the text column may not be named {text}")
    kept = [c for c in docs.columns if c.lower() not in MEASURES]
    w, h, s, p, ln = (unused(n, docs.columns, MEASURES) for n in ("words_", "hashes_", "sorted_", "places_", "lines_"))
    t = F.coalesce(F.col(text), F.lit(""))
    i64 = lambda x: x.cast("long")
    out = docs.select(*kept).withColumn(w, words_of(F.col(text)))
    out = out.withColumn("n_words", i64(F.size(w)))
    gram = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    at = F.sequence(F.lit(0), F.size(w) - 3)
    out = out.withColumn(h, F.when(F.size(w) > 2, F.transform(at, gram)))
    # Most texts repeat no window: the sort is for those that do.
    out = out.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    twice = F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
    out = out.withColumn(p, F.array_sort(F.filter(twice, lambda i: i.isNotNull())))
    reach = F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3))))
    out = out.withColumn("n_repeat_words", i64(F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0))))
    out = out.withColumn(ln, F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(f"[^{SPACE}]"))))
    out = out.withColumn("n_lines", i64(F.size(ln))).withColumn("n_dup_lines", i64(F.size(ln) - F.size(F.array_distinct(ln))))
    gone = lambda pattern: i64(F.char_length(t) - F.char_length(F.regexp_replace(t, pattern, "")))
    out = out.withColumn("word_chars", i64(F.char_length(F.array_join(w, ""))))
    out = out.withColumn("n_symbols", gone(SYMBOLS)).withColumn("n_upper", gone(r"\p{Lu}+"))
    return out.select(*kept, *MEASURES)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus MEASURES and fail_bits (long): bit k is set where rule k fails."""
    rules = _rules()
    bits = sum((F.when(rules[name], F.lit(1 << k)).otherwise(0) for k, name in enumerate(RULES)), F.lit(0))
    # Always 0, but not deterministic to the optimizer: a filter on fail_bits stays above this projection, else
    # it would be pushed down with the measurements copied into it, into lambdas too.
    barrier = F.shiftright(F.monotonically_increasing_id(), 63)
    return measure(docs.drop("fail_bits"), text).withColumn("fail_bits", bits.cast("long").bitwiseOR(barrier))


def stored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger as a table of its own: doc_id, MEASURES and fail_bits of every row, without the texts."""
    return written(ledger(docs.select(doc_id, text), text).drop(text), "ledger")


def failed(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) != 0


def apply_policy(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """Add kept: no rule of that policy version fails."""
    return rows.withColumn("kept", ~failed(policy))


def ablation(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """A row for each rule: documents it fails, and those that only it fails under the policy."""
    m = mask(policy)
    own = F.col("fail_bits").bitwiseAND(F.lit(m))
    names = [r for r in RULES if m >> RULES.index(r) & 1]
    cols = []
    for name in names:
        bit = 1 << RULES.index(name)
        cols += [F.count_if(own.bitwiseAND(F.lit(bit)) != 0).alias(f"f_{name}"), F.count_if(own == bit).alias(f"o_{name}")]
    wide = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_or(own).alias("any_bits"), *cols)
    row = lambda n: F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"o_{n}").alias("n_only"))
    return wide.select("n_rows", "any_bits", F.inline(F.array(*map(row, names))))
