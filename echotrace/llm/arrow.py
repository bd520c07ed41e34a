"""Row-group helpers for operators that run Python over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession


def small_batches(spark: SparkSession, size: int = 1 << 20) -> None:
    """Bound Arrow batches by bytes, as texts can be long; batches of short rows stay large, and a session's own smaller setting stands."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > size:
        spark.conf.set(key, str(size))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The batch's strings as UTF-8; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of neighbouring rows with one value of key, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *((at[1:] != at[:-1]).nonzero()[0] + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if held and held[0].column(batch.schema.get_field_index(key))[0].as_py() != at[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)
