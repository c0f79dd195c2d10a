"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The characters that separate words, as a Java and Python class body.
SPACE = r"\x20\x09-\x0D"
#: What a broadcast may hold.
BROADCAST_BYTES = 20_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where a local session (one machine) names none, the warehouse folder takes its place; a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/blockflow-shared"
    return path.rstrip("/")


def unused(name: str, *taken: list[str]) -> str:
    """A column name like `name` that none of the lists holds, also not in other case."""
    low = {c.lower() for names in taken for c in names}
    while name.lower() in low:
        name += "_"
    return name


def new_folder(spark: SparkSession, tag: str) -> str:
    """The name of a new folder in the shared one, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{re.sub(r'[^a-z0-9]', '_', tag)}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df to a new table in the shared folder and read it back.

    The files survive the loss of any executor. remove() deletes them early, the driver's end at the latest.
    """
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2_000):
    """Arrow batches of at most so many rows for what is computed inside: whole texts and their shingles take memory by the batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remove(df: DataFrame) -> None:
    """Delete the files that written() made for df."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if name.startswith(shared_dir(df.sparkSession).replace("file:///", "file:/")) or name.startswith(shared_dir(df.sparkSession)):
            at = jvm.org.apache.hadoop.fs.Path(name)
            at.getFileSystem(conf).delete(at, True)


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcast where its rows, counted as text, have at most BROADCAST_BYTES; else as it is. Costs a pass over df."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def text_key(text: Column) -> Column:
    """The name of a text: its MD5; a null text is the empty one."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def labelled(docs: DataFrame, labels: DataFrame, train: Column, value: Column, doc_id: str, label: str, rows: int, size: int) -> Iterator[tuple[str | None, int]]:
    """(value, label) of at most `rows` labelled documents, those of smallest hashed id, as far as `size` bytes of values reach.

    train: a column over labels. A label or a document that repeats counts once, null labels and null ids not at all.
    """
    y, v, n = (unused(c, docs.columns, labels.columns) for c in ("label_", "value_", "bytes_"))
    sample = labels.where(train & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias(y)).orderBy(F.xxhash64(doc_id), doc_id).limit(rows)
    picked = docs.join(F.broadcast(sample), doc_id).select(doc_id, y, value.alias(v))  # `rows` rows are broadcast
    picked = written(picked.groupBy(doc_id).agg(F.max(y).alias(y), F.min(v).alias(v)), "fit-rows")
    so_far = F.sum(F.coalesce(F.octet_length(v), F.lit(0))).over(Window.orderBy(F.xxhash64(doc_id), doc_id))  # over `rows` rows at most
    for t, k in picked.withColumn(n, so_far).where(F.col(n) <= size).select(v, y).toLocalIterator():
        yield t, int(k)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does the same, faster, where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column, separators: str = SPACE) -> Column:
    """The runs of characters outside the class `separators`; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{separators}]+"), lambda w: w != "")
