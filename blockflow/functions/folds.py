"""Ordered folds over streams of rows, as one Arrow pass that carries a single state; and how rows of much work are dealt to tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by key over four tasks a core, or the session's number of shuffle partitions if that is larger.

    Spark joins small partitions until they have tens of megabytes; rows that are small but slow (a frame, a stream's feedback) would end in one task. It
    leaves a number that is given alone.
    """
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def folded(rows: DataFrame, names: list[str], schema: str, start: Callable[[], object], step: Callable[..., tuple], arranged: bool = False) -> DataFrame:
    """(stream_id, seq, what step gives) for each row of (stream_id, seq, names), stream by stream in order of seq.

    step(state, *values) -> tuple of the columns of `schema` behind stream_id and seq. Memory is one batch and one state, whatever
    the length of a stream; a stream is one task's, as its rows depend on each other. arranged: rows are already together by
    stream and in order, as a window over the stream leaves them, so nothing is shuffled again.
    """
    if not arranged:
        rows = dealt(rows, "stream_id").sortWithinPartitions("stream_id", "seq")
    full = "stream_id long, seq int" + (f", {schema}" if schema else "")
    out = pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in full.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, state = object(), None
        for batch in batches:
            made = []
            for i, q, *values in zip(*(batch.column(n).to_pylist() for n in ("stream_id", "seq", *names))):
                if i != stream:
                    stream, state = i, start()
                made.append((i, q, *step(state, *values)))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)

    return rows.select("stream_id", "seq", *names).mapInArrow(run, full)
