"""Source divergence audit: how far the words of each source of a language are from those of the others and of the whole language.

Plain relational: matches of a pattern (as what a split leaves, which is faster) are exploded and counted by (lang, source, term); the terms that stand in at
least `least` documents of a language are its vocabulary; groups are crossed with the vocabulary of their language to
put the zeros in; a self-join on language and term gives the differences of two sources, which are summed and ranked.

At scale: texts are read once and only counts leave the scan, summed before they are shuffled. What is joined by language alone is one
row a source and one row a language; all other joins are by language and term, of which there
are many. Each pair of sources is joined once, the smaller name first, and its sum serves both. The first `top` terms are
cut before the shuffle of the ranking, by each task for itself.

All arithmetic is of integers and wide decimals, so it is exact.

Defined results: a null text, language or source is the empty one; a document without terms still makes its group; a row
counts as a document, repeated rows as often as they occur; ids are not read; ties are ranked by the item's UTF-8 bytes; a language
without vocabulary has pairs of value 0 and no terms; a language of one source has no pairs; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, small, written

#: Fixed value: what stands between terms, which are runs of letters A-Z or of anything beyond ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; an empty term too, where a text begins or
    ends with what is no term, or has none."""
    clean = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(clean(lang).alias("lang"), clean(source).alias("source"), F.split(ascii_lower(clean(text)), BETWEEN).alias("terms"))
    # kind 0: every occurrence, kind 1: the distinct terms of the document.
    rows = rows.select("lang", "source", F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("kind", "terms"))
    rows = rows.select("lang", "source", "kind", F.explode("terms").alias("term"))
    return rows.groupBy("lang", "source", "term").agg(F.count_if(F.col("kind") == 0).alias("n"), F.count_if(F.col("kind") == 1).alias("docs"))


def share(n: Column, total: Column, size: Column, smooth: int, scale: int) -> Column:
    """1 + floor(scale * (n + smooth) / (total + smooth * size)), exact."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", wide(n + smooth) * wide(F.lit(scale)), wide(total + smooth * size))


def divergence(docs: DataFrame, least: int = 30, top: int = 50, smooth: int = 5, scale: int = 10**9, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank). part 'pair': item is another source of the language, value the sum of differences of
    shares, all ranks. part 'term': item is a term of larger share in the source than in the language, value the difference, ranks to `top`."""
    counts = written(term_counts(docs, lang, source, text), "term-counts")
    whole = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    words = written(whole.where(F.col("docs") >= least).drop("docs"), "vocabulary")
    langs = words.groupBy("lang").agg(F.count("*").alias("size"), F.sum("n").alias("total"))  # a row a language
    words = words.join(small(written(langs, "languages")), "lang").select("lang", "term", "size", share(F.col("n"), F.col("total"), F.col("size"), smooth, scale).alias("q"))
    kept = written(counts.join(words.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n"), "kept-counts")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
    groups = small(written(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")), "groups"))  # a row a source
    dense = words.join(groups, "lang").join(kept, ["lang", "source", "term"], "left")
    n = F.coalesce("n", F.lit(0))
    dense = written(dense.select("lang", "source", "term", n.alias("n"), "q", share(n, F.col("total"), F.col("size"), smooth, scale).alias("p")), "shares")
    a, b = (dense.select("lang", "term", F.col("source").alias(f"source_{x}"), F.col("p").alias(f"p_{x}")) for x in "ab")
    sums = a.join(b, ["lang", "term"]).where("source_a < source_b").groupBy("lang", "source_a", "source_b").agg(F.sum(F.abs(F.col("p_a") - F.col("p_b"))).alias("value"))
    sums = written(sums, "pair-sums")
    both = sums.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), "value").union(sums.select("lang", "source_b", "source_a", "value"))
    # Every other source has its row, also where the language has no vocabulary.
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = others.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    terms = dense.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(terms.withColumn("rank", rank).where(F.col("rank") <= top))
