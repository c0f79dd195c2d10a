"""The training-corpus pipeline: quality rules, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockflow.llm import bpe, decontam, quality_rules, secrets, simhash
from blockflow.llm.common import small, text_key, unused, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v3 rejects go: junk by symbols, capitals, repetition or the length of words; clean ones may be short.

    A null text or one without words goes; texts of any length are measured whole; each row is judged by itself, equal
    ones alike; ids are not read; columns of docs named like a measurement come back as they were.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))
    return quality_rules.ledger(rows, "_text").where(~quality_rules.failed("v3")).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays: that with the smallest
    id, of several the one whose text has the smallest MD5.

    Texts without words are one group; rows that repeat id and text count as one document, any of them stays; rows
    that share only the id are documents of their own; a row with a null id goes if its group has one with an id.
    """
    key, i, k = (unused(n, docs.columns) for n in ("text_key", "its_id", "its_key"))
    rows = simhash.near_copies(docs, least=0.8).select(F.col("doc_id").alias(i), F.col("text_key").alias(k), "stays")
    marked = docs.withColumn(key, text_key(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(key) == F.col(k))
    gone = small(written(rows.where("not stays").select(i, k).distinct(), "gone"))
    kept = marked.join(gone, same, "left_anti")
    twice = written(rows.where("stays").groupBy(i, k).count().where("count > 1").drop("count"), "repeated")
    if not twice.isEmpty():
        twice = small(twice)
        kept = kept.join(twice, same, "left_anti").union(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", key]))
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    The text alone decides, so equal texts share their lot whatever their ids; a null or empty text holds no
    window; an empty benchmark takes nothing.
    """
    _, hits = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit, key = (unused(n, docs.columns) for n in ("hit_key", "text_key"))
    bad = small(written(hits.select(F.col("key").alias(hit)).distinct(), "hit-texts"))
    return docs.withColumn(key, text_key(F.col("text"))).join(bad, F.col(key) == F.col(hit), "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in it are replaced, and n_chars, where docs have it, follows the text.

    A null text stays null and keeps its n_chars; each row is scanned by itself; ids are not read.
    """
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes, a row for each of docs; a null text has no tokens."""
    import public_tokenizers

    return bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True).drop("text")


STAGES = [("quality_rules", rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_scan), ("tokens", tokens)]

#: Fingerprints and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
