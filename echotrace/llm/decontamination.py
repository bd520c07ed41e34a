"""Benchmark decontamination by the q-gram lemma.

Items and texts are lower-cased, white space runs become one blank, and every q characters make a
q-gram. If an item of m characters aligns with a passage within e edits, at least m - q + 1 - q*e of
its q-grams are found again on diagonals (text position minus item position) at most e apart. So the
diagonals are cut into bands of 2(e + 1) that overlap by half, each alignment lies in one whole band,
and a band is a candidate only if it holds that many different q-gram positions of the item. A banded
alignment in and around the band then decides, and gives the edits and the place.

Items are the stated query set: they are taken in blocks of at most ``block_chars``, each block is
sent to every task (its size is proven by the running sum that cuts the blocks), and the documents
are scanned once a block, whose matches are written before the next one is sent. Within a task, documents are scanned in runs of bounded length; a text is
never cut.

Edge cases. Null and empty items match nothing; null and empty texts have no matches. Items shorter
than q are found exactly. Equal items each match. Rows that repeat a doc_id are scanned each.
An empty table on either side gives an empty result. Other columns are ignored by ``matches`` and
kept by ``drop_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import small_batches, texts
from .common import fresh, parts_for, stored, table

Q, EDIT_RATE, BLOCK_CHARS, RUN_CHARS = 8, 0.1, 4_000_000, 400_000
SCHEMA = "doc_id bigint, item_id bigint, edits int, item_chars int, start_word bigint, end_word bigint"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def normal(text: bytes) -> bytes:
    """Lower case, ends trimmed, each run of white space one blank."""
    return b" ".join(text.decode().lower().encode().split())


def _codes(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit value for the q-gram at each position."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    wide = codes.astype(np.uint64)
    h = wide[:n].copy()
    for k in range(1, q):
        h *= _BASE
        h += wide[k : k + n]
    return h


class Items:
    """A block of items, with an index of their q-grams."""

    def __init__(self, rows: list[tuple[int, bytes]], q: int = Q, edit_rate: float = EDIT_RATE):
        self.q = q
        self.ids = [i for i, _ in rows]
        self.codes = [_codes(normal(t)) for _, t in rows]
        self.size = np.array([len(c) for c in self.codes])
        self.edits = np.maximum(0, np.minimum((self.size * edit_rate).astype(int), (self.size - q) // q))
        self.need = self.size - q + 1 - q * self.edits
        self.short = [i for i, c in enumerate(self.codes) if 0 < len(c) < q]
        grams = [_grams(c, q) for c in self.codes]
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, int)
        value = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(value, kind="stable")
        self.item, self.place = item[order], place[order]
        self.values, self.first, self.count = np.unique(value[order], return_index=True, return_counts=True)
        self.bits = max(16, int(np.ceil(np.log2(max(1, len(self.values)) * 64))))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.values * _MIX) >> np.uint64(64 - self.bits)] = True
        self.gap = int(self.edits.max(initial=0)) + 1

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text position, item, item position) of every q-gram that text and items share."""
        g = _grams(codes, self.q)
        at = np.flatnonzero(self.seen[(g * _MIX) >> np.uint64(64 - self.bits)])
        slot = np.searchsorted(self.values, g[at])
        slot[slot == len(self.values)] = 0
        real = self.values[slot] == g[at] if len(self.values) else np.zeros(0, bool)
        at, slot = at[real], slot[real]
        n = self.count[slot]
        flat = np.repeat(self.first[slot] - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n, n) + np.arange(n.sum())
        return np.repeat(at, n), self.item[flat], self.place[flat]

    def bands(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(item, lowest diagonal) of the bands that hold enough of the item's q-grams."""
        at, item, place = self.hits(codes)
        step = self.edits[item] + 1
        band = (at - place) // step
        # Cheap bound first: occurrences in a band and its upper neighbour, with repeats counted.
        low = int(band.min(initial=0)) - 1
        width = int(band.max(initial=0)) - low + 2
        key = item * width + (band - low)
        keys, n = np.unique(key, return_counts=True)
        nxt = np.searchsorted(keys, keys + 1)
        nxt[nxt == len(keys)] = 0
        upper = np.where(len(keys) and keys[nxt] == keys + 1, n[nxt], 0)
        prv = np.searchsorted(keys, keys - 1)
        prv[prv == len(keys)] = 0
        lower = np.where(len(keys) and keys[prv] == keys - 1, n[prv], 0)
        need = self.need[keys // width]
        good = np.isin(key, keys[(n + np.maximum(upper, lower)) >= need])
        key, place, item = key[good], place[good], item[good]
        longest = int(self.size.max(initial=1))
        both = np.unique(np.concatenate((key, key - 1)) * longest + np.concatenate((place, place)))
        keys, n = np.unique(both // longest, return_counts=True)
        ok = keys[n >= self.need[keys // width]]
        return [(int(k // width), int((k % width + low) * (self.edits[k // width] + 1))) for k in ok]

    def align(self, codes: np.ndarray, i: int, low: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the item's best alignment on diagonals low..low+2(e+1), if within budget."""
        pattern, e = self.codes[i], int(self.edits[i])
        d0, d1 = low - e, low + 2 * (e + 1) + e
        at = _find(codes[max(0, d0) : max(0, d1 + len(pattern))], pattern)
        if at >= 0:  # no edits: the alignment is the text itself
            return 0, max(0, d0) + at, max(0, d0) + at + len(pattern)
        found = _banded(codes, pattern, d0, d1, e)
        if found is None:
            return None
        best, end = found
        back = _banded(codes[:end][::-1], pattern[::-1], -e, e + 1, e, from_start=True)
        return best, end - (back[1] if back else len(pattern)), end


def _find(text: np.ndarray, pattern: np.ndarray) -> int:
    """Where pattern first stands in text, or -1."""
    whole, part, at = text.tobytes(), pattern.tobytes(), -1
    while (at := whole.find(part, at + 1)) >= 0:
        if at % 4 == 0:
            return at // 4
    return -1


def _banded(text: np.ndarray, pattern: np.ndarray, d0: int, d1: int, most: int, from_start: bool = False) -> tuple[int, int] | None:
    """(edits, end) of the cheapest alignment of pattern that stays on diagonals d0..d1-1, if at most most.

    The start in text is free, or text's first position if from_start."""
    m, wide = len(pattern), d1 - d0
    far = 1 << 20
    at = np.arange(d0, d1)
    index = np.arange(wide)
    row = np.where((at >= 0) & (at <= len(text)), np.abs(at) if from_start else 0, far)
    if from_start:
        row = np.where(at >= 0, at, far)
    padded = np.concatenate((np.zeros(max(0, -d0), np.uint32), text[max(0, d0) : max(0, d1 + m)]))
    padded = np.concatenate((padded, np.zeros(max(0, wide + m - len(padded)), np.uint32)))
    for k in range(1, m + 1):
        sub = row + (padded[k - 1 : k - 1 + wide] != pattern[k - 1])
        skip = np.append(row[1:], far) + 1
        row = np.minimum(sub, skip)
        row = np.where((at + k < 0) | (at + k > len(text)), far, row)
        row = np.minimum.accumulate(row - index) + index
        if row.min() > most:
            return None
    best = int(row.argmin())
    return int(row[best]), int(at[best] + m)


def _scan(items: Items, docs: list[tuple[int | None, bytes]]) -> list[tuple]:
    """The matches in some documents, whose texts are set one after another with gaps that no alignment crosses."""
    parts = [normal(t) for _, t in docs]
    out = []
    for i in items.short:
        word = items.codes[i].tobytes().decode("utf-32-le").encode()
        for (doc, _), p in zip(docs, parts):
            at = p.find(word)
            if at >= 0:
                first = p[:at].count(b" ")
                out.append((doc, items.ids[i], 0, len(items.codes[i]), first, first + word.count(b" ") + 1))
    gap = np.zeros(items.gap, np.uint32)
    codes = [_codes(p) for p in parts]
    starts = np.cumsum([0] + [len(c) + len(gap) for c in codes])
    if not len(items.values) or not starts[-1]:
        return out
    whole = np.concatenate([x for c in codes for x in (c, gap)])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i, low in items.bands(whole):
        found = items.align(whole, i, low)
        if found is not None:
            k = int(np.searchsorted(starts, found[1], "right")) - 1
            best[k, i] = min(best.get((k, i), found), found)
    for (k, i), (edits, a, b) in best.items():
        text = whole[starts[k] : starts[k + 1]]
        a, b = a - starts[k], b - starts[k]
        first = int((text[:a] == 32).sum())
        out.append((docs[k][0], items.ids[i], edits, len(items.codes[i]), first, first + int((text[a:b] == 32).sum()) + 1))
    return out


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, bytes]]]:
    """Items in blocks of bounded size, one block on the driver at a time in the caller's loop."""
    b = benchmark.where("item_id is not null and text is not null").select("item_id", "text", F.char_length("text").alias("n"))
    total = b.agg(F.sum("n")).first()[0] or 0
    parts = parts_for(total, block_chars, 1)
    # A part has about a block's characters, so that the running sums are taken by many tasks.
    running = F.sum("n").over(Window.partitionBy("part").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    sized = b.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))).withColumn("block", F.floor((running - 1) / block_chars))
    sized = stored(sized.drop("n"))
    for part, block in sorted(map(tuple, sized.select("part", "block").distinct().collect())):
        of = sized.where((F.col("part") == part) & (F.col("block") == block))
        yield [(r[0], r[1].encode()) for r in of.select("item_id", "text").orderBy("item_id", "text").collect()]


def matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and item that the document holds: edits, and the words from start_word to end_word (exclusive)."""
    spark = docs.sparkSession
    small_batches(spark)
    out = held = None
    for block in _blocks(benchmark, block_chars):
        if held is not None:  # no more than one block stays with the tasks
            out = stored(out)
            held.destroy()
        shared = held = spark.sparkContext.broadcast(Items(block, q, edit_rate))

        def run(batches, shared=shared):
            for b in batches:
                rows = list(zip(b.column(0).to_pylist(), texts(b)))
                found, at = [], 0
                while at < len(rows):
                    end, n = at, 0
                    while end < len(rows) and (end == at or n + len(rows[end][1]) <= RUN_CHARS):
                        n += len(rows[end][1])
                        end += 1
                    found += _scan(shared.value, rows[at:end])
                    at = end
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["doc_id", "item_id", "edits", "item_chars", "start_word", "end_word"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no item; rows without a doc_id are kept."""
    leak = fresh(docs, "__leak")[0]
    leaks = matches(docs, benchmark, **options).select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(leaks, F.col("doc_id") == F.col(leak), "left_anti")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that the document holds within the edit budget."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
