"""Benchmark decontamination by winnowing (built-in functions only).

Each text keeps, of every `window` consecutive hashes of `k` words, the smallest value.
Two texts that share k + window - 1 = span words in a row keep a common hash, so no
shared span is missed. An item of fewer words than `span` is one window as a whole and keeps the hash of
all its words; documents keep the hashes of runs of just as many words, for the lengths that occur.
One pass over the documents joins the kept hashes, which leaves the texts with a hit. In those, hits
are extended: all their k-word hashes are laid on diagonals (text, item text, shift) and a run of span - k + 1 or more
consecutive equal hashes is a shared span. A chance hit of one hash gives no run.

Hits belong to texts, named by their MD5, not to ids: documents of equal text share one row of work and
get the same hits, and rows that repeat an id stay apart. Item texts are classes likewise: items of
the same words are compared once.

The item side and the texts with a hit are broadcast only where their counted bytes are at most BROADCAST_BYTES;
beyond that the joins shuffle. Kept hashes are aggregated by document before the shuffle. No group is gathered
but the hit intervals of one text, which its length bounds.

Defined results: a null or empty text has no words and no hits; null ids are ids like others; rows with the same
item_id are one item with several texts, and no run crosses from one to another; each row of docs gets a row of its
own, repeated ones too; very long texts are compared whole; other columns, whatever their names, are ignored; an empty table of items
gives no hits, an empty table of documents no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, small, text_key, words_of, written

#: Fixed value: the characters that are no part of a word, as a class body.
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def item_words(text: Column) -> Column:
    return words_of(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)


def _none() -> Column:
    return F.array().cast("array<bigint>")


def _grams(hashes: Column, k: int) -> Column:
    """Hashes of all runs of k word hashes, by position; none for fewer words."""
    gram = lambda i: F.xxhash64(F.slice(hashes, i, k))
    return F.when(F.size(hashes) >= k, F.transform(F.sequence(F.lit(1), F.size(hashes) - (k - 1)), gram)).otherwise(_none())


def _kept(grams: Column, window: int) -> Column:
    """Winnowing: the smallest hash of each full window, each value once."""
    starts = F.sequence(F.lit(1), F.size(grams) - window + 1)
    lowest = F.transform(starts, lambda i: F.array_min(F.slice(grams, i, window)))
    return F.when(F.size(grams) >= window, F.array_distinct(lowest)).otherwise(_none())


def decontaminate(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 6, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, hits). rows: doc, key, n_words, a row for each of docs. hits: key, item, start, stop,
    the longest runs of shared words on each diagonal (word positions, stop exclusive) of each text."""
    if not 1 <= k <= span:
        raise ValueError("k must be between 1 and span")
    window = span - k + 1
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    it = items.select(F.col(item_id).alias("item"), hashed(item_words(F.col(text))).alias("iw")).where(F.size("iw") > 0).distinct()
    it = written(it.withColumn("class", F.sha2(F.array_join(F.transform("iw", lambda h: h.cast("string")), ",").cast("binary"), 256)), "items")
    classes = it.groupBy("class").agg(F.first("iw").alias("iw"))
    full = classes.where(F.size("iw") >= span).withColumn("g", _grams(F.col("iw"), k))
    lengths = sorted(r[0] for r in it.where(F.size("iw") < span).select(F.size("iw").alias("n")).distinct().collect())  # at most span - 1 numbers
    whole = lambda n: classes.where(F.size("iw") == n).select("class", F.get(_grams(F.col("iw"), n), F.lit(0)).alias("h"))
    prints = reduce(DataFrame.union, [full.select(F.explode(_kept(F.col("g"), window)).alias("h")), *(whole(n).select("h") for n in lengths)])
    prints = small(written(prints.distinct().withColumn("hit", F.lit(True)), "item-prints"))

    named = docs.select(F.col(doc_id).alias("doc"), text_key(F.col(text)).alias("key"), F.col(text).alias("t"))
    words = lambda rows: rows.withColumn("w", item_words(F.col("t"))).drop("t").withColumn("dw", hashed(F.col("w"))).drop("w")
    # A column of its own at each step: an expression inside a lambda runs once an element.
    kept = words(named).withColumn("row", F.monotonically_increasing_id()).withColumn("g", _grams(F.col("dw"), k)).withColumn("m", F.concat(_kept(F.col("g"), window), *(_grams(F.col("dw"), n) for n in lengths)))
    kept = kept.select("row", "doc", "key", F.size("dw").cast("long").alias("n_words"), F.explode_outer("m").alias("h"))
    # A row's hashes are all made by one task, so its number need not outlast the scan.
    seen = kept.join(prints, "h", "left").groupBy("row", "doc", "key", "n_words").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("hit"))
    seen = written(seen.drop("row"), "doc-hits")

    near = small(seen.where("hit").groupBy(F.col("key").alias("near")).agg(F.min("doc").alias("one")))
    again = named.join(near, (F.col("key") == F.col("near")) & F.col("doc").eqNullSafe(F.col("one")), "left_semi")
    again = written(words(again).select("key", "dw"), "texts-with-hits")  # a text once for each row of its smallest id
    at = again.select("key", F.posexplode(_grams(F.col("dw"), k)).alias("i", "h"))
    met = at.join(small(full.select("class", F.posexplode("g").alias("j", "h"))), "h").select("key", "class", (F.col("i") - F.col("j")).alias("diagonal"), "i").distinct()
    diagonal = Window.partitionBy("key", "class", "diagonal").orderBy("i")
    runs = met.withColumn("run", F.col("i") - F.row_number().over(diagonal)).groupBy("key", "class", "diagonal", "run").agg(F.min("i").alias("start"), (F.max("i") + k).alias("stop"))
    found = [runs.where(F.col("stop") - F.col("start") >= span).select("key", "class", "start", "stop")]
    for n in lengths:
        each = again.select("key", F.posexplode(_grams(F.col("dw"), n)).alias("start", "h"))
        found.append(each.join(small(whole(n)), "h").select("key", "class", "start", (F.col("start") + n).alias("stop")))
    hits = written(reduce(DataFrame.union, found).distinct(), "class-hits")
    return seen.drop("hit"), hits.join(small(it.select("class", "item")), "class").select("key", "item", "start", "stop")


def digest(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted strings), contaminated for every row of docs."""
    rows, hits = decontaminate(docs, items, doc_id=doc_id, **options)
    spans = F.array_sort(F.collect_set(F.struct("start", "stop")))
    per = hits.groupBy("key").agg(spans.alias("spans"), F.array_sort(F.collect_set(F.coalesce(F.col("item").cast("string"), F.lit("")))).alias("item_ids"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["stop"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["end"], s["start"]))).alias("n"))
    per = written(per.select("key", F.aggregate("spans", zero, step)["n"].cast("long").alias("n_hit"), "item_ids"), "text-hits")
    out = rows.join(small(per), "key", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(F.col("doc").alias(doc_id), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))
