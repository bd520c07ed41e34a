"""Overlapping windows over the words of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_if_null, words_of


def last_window(n: Column, length: int, stride: int) -> Column:
    """Number of the last window of n words, counted from 0: the first that reaches the end."""
    return F.greatest(F.lit(0), F.ceil((n - length) / stride)).cast("int")


def window_starts(n: Column, length: int, stride: int) -> Column:
    """Starts of the windows of n words; none for no words or a length or stride that is not positive."""
    none = F.array().cast("array<int>")
    if length <= 0 or stride <= 0:
        return none
    starts = F.transform(F.sequence(F.lit(0), last_window(n, length, stride)), lambda k: (k * stride).cast("int"))
    return F.when(n > 0, F.filter(starts, lambda a: a < n)).otherwise(none)


def make_windows(docs: DataFrame, length: int = 30, stride: int = 5) -> DataFrame:
    """window_id, doc_id, start_token, end_token, window_len, snippet_norm and, if docs have text_raw, snippet_raw.

    docs: doc_id and text_norm. The raw snippet is the text's first 300 characters, on its first window only.
    """
    raw = [F.col("text_raw")] if "text_raw" in docs.columns else []
    d = docs.select("doc_id", words_of(F.col("text_norm")).alias("w"), *raw)
    d = d.select("*", F.explode(window_starts(F.size("w"), length, stride)).alias("start_token"))
    d = d.withColumn("end_token", F.least(F.col("start_token") + length, F.size("w")))
    out = [
        F.concat_ws("_", "doc_id", "start_token", "end_token").alias("window_id"), "doc_id", "start_token", "end_token",
        (F.col("end_token") - F.col("start_token")).alias("window_len"),
        F.array_join(F.slice("w", F.col("start_token") + 1, F.col("end_token") - F.col("start_token")), " ").alias("snippet_norm"),
    ]
    if raw:
        out.append(F.when(F.col("start_token") == 0, F.replace(F.substring(blank_if_null(F.col("text_raw")), 1, 300), F.lit("\n"), F.lit(" "))).alias("snippet_raw"))
    return d.select(*out)
