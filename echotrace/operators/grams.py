"""Word n-grams of texts as 64-bit hashes, and the windows that cover them, in Arrow batches.

A text is a row (key, tokens, w, p): how many tokens it has, the hashes of its inner words, and the places of their
tokens; p is empty if word i is in token i throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import INNER_WORD, blank_if_null

#: Odd multipliers of the hash, words handled at a time, bits of a filter at most, bits a chunk of it, where its probes begin in a hash.
MIX, END, WORDS, BITS, CHUNK, SHIFTS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 1 << 20, 1 << 29, 1 << 15, (0, 17, 34)


def inner_words(texts: DataFrame, key: str) -> DataFrame:
    """(key, tokens, w, p) of texts with text_norm; tokens are parted by blanks, and a token may hold several inner words or none."""
    text = F.btrim(blank_if_null(F.col("text_norm")), F.lit(" "))
    parts = F.transform(F.regexp_extract_all(text, F.lit(f"{INNER_WORD}| (?! )"), F.lit(0)), lambda x: F.xxhash64(x))  # a run of blanks counts as its last one
    blank = texts.sparkSession.range(1).select(F.xxhash64(F.lit(" "))).first()[0]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, "parts"):
            parts, size = _flat(batch, "parts")
            row = np.repeat(np.arange(len(size)), size)
            gap = parts == blank
            tokens = np.where(batch.column("some").to_numpy(zero_copy_only=False), np.bincount(row[gap], minlength=len(size)) + 1, 0)
            place = np.cumsum(gap)  # tokens that ended before, in all the piece
            place -= np.repeat(np.concatenate([[0], place])[np.cumsum(size) - size], size)
            w, p, row = parts[~gap], place[~gap], row[~gap]
            n = np.bincount(row, minlength=len(size))
            plain = np.bincount(row, p != np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n), minlength=len(size)) == 0
            yield _batch([batch.column(key), pa.array(tokens, pa.int32()), lists(w, n, pa.int64()), lists(p[~plain[row]], np.where(plain, 0, n), pa.int32())], [key, "tokens", "w", "p"])

    rows = texts.select(key, (text != "").alias("some"), parts.alias("parts"))
    return rows.mapInArrow(split, fields(texts, key, "tokens int, w array<bigint>, p array<int>"))


def hashes(w: np.ndarray, row: np.ndarray, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each n where the n-grams of words inside one row begin, and their hashes."""
    h = w
    for n in range(1, min(most, len(w)) + 1):
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * MIX + w[n - 1 :]
        if n >= least:
            at = np.flatnonzero(row[: len(h)] == row[n - 1 :])
            g = (h[at] ^ (h[at] >> np.uint64(32))) * END
            yield n, at, (g ^ (g >> np.uint64(29))).view(np.int64)


class Grams:
    """The n-grams of a piece of texts: for each its text's row, hash and the places of its first and last token, in order of n, row and place."""

    def __init__(self, batch: pa.RecordBatch, least: int, most: int):
        self.w, self.size = _flat(batch, "w")
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        self.begin = np.cumsum(self.size) - self.size
        self.place = np.arange(len(self.w)) - np.repeat(self.begin, self.size)
        p, n = _flat(batch, "p")
        self.place[np.repeat(n > 0, self.size)] = p
        self.tokens = batch.column("tokens").to_numpy().astype(np.int64)
        rows, grams, firsts, lasts = [], [], [], []
        for n, at, g in hashes(self.w.view(np.uint64), self.row, least, most):
            rows.append(self.row[at]), grams.append(g), firsts.append(self.place[at]), lasts.append(self.place[at + n - 1])
        none = [np.zeros(0, np.int64)]
        self.rows, self.grams, self.a, self.b = (np.concatenate(x or none) for x in (rows, grams, firsts, lasts))

    def windows(self, length: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last window that cover each gram's place; the first is the greater if none does."""
        return np.maximum(0, -((length - 1 - self.b) // stride)), np.minimum(self.a // stride, last_windows(self.tokens, length, stride)[self.rows])


def last_windows(tokens: np.ndarray, length: int, stride: int) -> np.ndarray:
    return np.maximum(0, -((length - tokens) // stride))


def fields(rows: DataFrame, key: str | None, more: str) -> T.StructType:
    """The schema of rows' column key, if given, and more."""
    return T.StructType(([rows.schema[key]] if key else []) + T.StructType.fromDDL(more).fields)


def each(rows: DataFrame, schema: T.StructType, body, least: int, most: int) -> DataFrame:
    """body(batch, its Grams) gives the columns of schema for every piece of rows."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, "w"):
            yield _batch(body(batch, Grams(batch, least, most)), schema.names)

    return rows.mapInArrow(over, schema)


def gram_filter(grams: DataFrame, count: int, share: int, probes: int) -> np.ndarray:
    """A bitmap that has every gram of the column gram at so many probes, and few others: share bits for each of count grams, at most BITS in all."""
    bits = min(BITS, max(CHUNK, 1 << (share * max(1, count) - 1).bit_length()))
    at = F.explode(F.array(*(F.shiftright("gram", s).bitwiseAND(F.lit(bits - 1)) for s in SHIFTS[:probes])))
    dealt = grams.select(at.alias("i")).select(F.shiftright("i", 15).alias("chunk"), F.col("i").bitwiseAND(F.lit(CHUNK - 1)).alias("at")).repartition("chunk")
    out = np.zeros((bits // CHUNK, CHUNK // 8), np.uint8)
    for c, x in dealt.groupBy("chunk").agg(F.bitmap_construct_agg("at")).collect():
        out[c] = np.frombuffer(x, np.uint8)
    return out.reshape(-1)


def passes(bitmap: np.ndarray, grams: np.ndarray, probes: int) -> np.ndarray:
    """The indices of the grams that the bitmap has at so many probes."""
    left = np.arange(len(grams))
    for s in SHIFTS[:probes]:
        at = (grams[left] >> s) & np.int64(len(bitmap) * 8 - 1)
        left = left[(bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
    return left


def places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ...: counts of them for each start."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches' rows in pieces of about WORDS values of a column."""
    for batch in batches:
        if batch.num_rows:
            part = np.cumsum(pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)) // WORDS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]))


def _flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists: their values, and how many each has."""
    x = batch.column(column)
    return x.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64)


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)
