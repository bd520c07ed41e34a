"""Suffix-array dedup: remove bytes that lie in a string of ``length`` bytes that starts anywhere else.

Passages that repeat may be shorter than what is worth removing. So the same run also finds the strings of
``shared`` bytes (by default fifty words of five bytes) that start anywhere else; they are counted, not removed.

1. Pieces. A window of ``shared`` bytes is known by its minimizer, the least hash of its K-byte strings.
   Neighbouring windows with one minimizer make a piece, which reaches ``length`` bytes from its last window's
   start, or to the end of the text. Equal strings have equal first windows and so equal minimizers: only
   pieces of one minimizer can share strings; the table of pieces holds hashes and places, no text.
2. Equal pieces are one class, counted before the shuffle; where a class has two members all their
   windows repeat. Only one member of a class goes on, and only if its minimizer has other classes or
   occurs twice in the piece itself.
3. Suffix buckets. The pieces of a minimizer meet in a task, block by block. A block's suffixes are cut
   to ``shared`` bytes, and those that repeat again to ``length`` bytes, and sorted bucket by bucket (a bucket: one minimizer, one 8-byte prefix). Within
   a bucket a three-way quicksort compares suffixes with its pivot: first V bytes of text; then, as ties
   are long here, the precomputed rank of the difference-cover sample suffixes that both reach after
   the same shift; then the bytes that the ranks leave at the end. So a comparison costs a few words,
   not all bytes, and memory is bounded by the block and one group of buckets. The cover {x mod V
   in D} holds for any two positions a common shift below V. Suffixes that compare equal repeat.
   Memory of a task is bounded by ``hot_pieces``: a minimizer with more classes than that (only huge groups
   of near copies have so many) is left to an exact way for the rest, which compares 128-bit hashes of its
   classes' windows in a grouped count, spread over all tasks.
   Joins send the rows of the most frequent keys past the exchange to a broadcast of those keys.
4. The repeats of each document are merged and cut out of its bytes.

Edge cases. A null or empty text has 0 bytes. Texts shorter than ``length`` lose nothing. A document is
a row: rows that repeat a text lose all of it (if long enough), whatever their doc_ids; null doc_ids
are allowed. Overlapping and self-overlapping repeats count. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import runs, small_batches, texts
from .common import cut, matched, release, stored, table

LENGTH, SHARED, K, V = 400, 250, 32, 31
BLOCK_BYTES, HOT_PIECES = 2_000_000, 20_000
NO_ID = -(2**63)  # stands for a null doc_id within the operator
ONLY_SHARED, WHOLE = 0, 1  # kinds of repeats: of shared bytes, of length bytes
PIECES = "v bigint, p bigint, doc bigint, tk bigint, start bigint, size int, windows int, again boolean"
REPEATS = "doc bigint, tk bigint, start bigint, end bigint, kind int"
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def difference_cover(v: int) -> list[int]:
    """The first of the smallest sets whose differences give every residue mod v."""
    for size in range(1, v + 1):
        for rest in combinations(range(1, v), size - 1):
            d = (0, *rest)
            if len({(a - b) % v for a in d for b in d}) == v:
                return list(d)
    raise AssertionError


COVER = difference_cover(V)
#: SHIFT[a, b]: the least shift that takes positions of residues a and b both into the cover.
SHIFT = np.array([[next(s for s in range(V) if (a + s) % V in COVER and (b + s) % V in COVER) for b in range(V)] for a in range(V)])


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as a number."""
    n = len(data) - 7
    return np.ndarray((n,), np.uint64, data.tobytes(), strides=(1,)).copy() if n > 0 else np.empty(0, np.uint64)


def _minimizers(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each K-byte string, and the least of them in each window of length bytes."""
    w = _words(data)
    n = len(data) - K + 1
    h = w[:n] * _M[0]
    for i in (1, 2, 3):
        h ^= h >> np.uint64(31)
        h += w[8 * i : 8 * i + n]
        h *= _M[i]
    h ^= h >> np.uint64(29)
    h *= _M[0]
    h ^= h >> np.uint64(32)
    wide = length - K + 1
    padded = np.full(-(-n // wide) * wide, np.uint64(2**64 - 1))
    padded[:n] = h
    rows = padded.reshape(-1, wide)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - wide + 1
    return h, np.minimum(after[:last], before[wide - 1 : wide - 1 + last])


def pieces_of(text: bytes, length: int, shared: int) -> list[tuple[int, int, int, int, int, bool]]:
    """(minimizer, hash of the piece, start, size, windows, whether the minimizer occurs again in them).

    Only pieces of one 64-bit minimizer are compared by the 64-bit hash, so equality stands on 128 bits."""
    from xxhash import xxh3_64_digest

    if len(text) < shared:
        return []
    data = np.frombuffer(text, np.uint8)
    h, least = _minimizers(data, shared)
    starts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    ends = np.append(starts[1:], len(least))
    out = []
    for v, a, b in zip(least[starts].view(np.int64).tolist(), starts.tolist(), ends.tolist()):
        piece = text[a : b - 1 + length]
        again = b - a > 1 and int(np.count_nonzero(h[a : b + shared - K] == least[a])) > 1
        out.append((v, int.from_bytes(xxh3_64_digest(piece), "little", signed=True), a, len(piece), b - a, again))
    return out


class Block:
    """Pieces of text whose repeated windows of length bytes are found by suffix sorting.

    group: each piece's minimizer; windows: how many start in it, by default all that fit."""

    def __init__(self, parts: list[bytes], group: list[int], length: int = LENGTH, windows: list[int] | None = None):
        self.length = length
        size = np.array([len(p) for p in parts])
        self.first = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int32)  # a block has far fewer than 2^31 bytes
        self.data = np.frombuffer(b"".join(parts) + bytes(2 * length), np.uint8)
        self.word = _words(self.data)
        windows = np.maximum(0, np.minimum(size - length + 1, size if windows is None else np.array(windows)))
        self.piece = np.repeat(np.arange(len(parts), dtype=np.int32), windows)
        self.start = np.repeat((self.first - np.concatenate(([0], np.cumsum(windows)[:-1]))).astype(np.int32), windows) + np.arange(windows.sum(), dtype=np.int32)
        self.group = np.unique(np.array(group), return_inverse=True)[1].astype(np.int32)[self.piece]
        self.reach = (length - V + 1) // V * V  # bytes that a sample's rank covers
        self.rank = self._sample_ranks()

    def _sample_ranks(self) -> np.ndarray:
        """By position: the rank of the text of ``reach`` bytes that starts there, for positions in the cover."""
        n = len(self.word) - V
        at = np.flatnonzero(np.isin(np.arange(V), COVER)[np.arange(n) % V])
        keys = [self.word[at + s].byteswap() for s in (0, 8, 16, V - 8)]
        order = np.lexsort(keys[::-1])
        step = np.zeros(len(at), bool)
        for k in keys:
            step[1:] |= k[order][1:] != k[order][:-1]
        rank = np.zeros(len(self.data), np.int32)
        rank[at[order]] = np.cumsum(step) + 1
        have = V
        while have < self.reach:
            ahead = min(have, self.reach - have)
            far = at + ahead
            far[far >= len(rank)] = len(rank) - 1
            pair = rank[at].astype(np.int64) * (len(at) + 2) + rank[far]
            rank[at] = np.unique(pair, return_inverse=True)[1] + 1
            have += ahead
        return rank

    def _against(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the window at a is less than, equal to or greater than the one at b."""
        out = np.zeros(len(a), np.int8)
        todo = np.arange(len(a))

        def settle(x: np.ndarray, y: np.ndarray) -> None:
            nonlocal todo
            differ = x != y
            out[todo[differ]] = np.where(x[differ] < y[differ], -1, 1)
            todo = todo[~differ]

        for s in (8, 16, V - 8):
            settle(self.word[a[todo] + s].byteswap(), self.word[b[todo] + s].byteswap())
        shift = SHIFT[a[todo] % V, b[todo] % V]
        settle(self.rank[a[todo] + shift], self.rank[b[todo] + shift])
        for s in range((self.reach // 8) * 8, self.length - 7, 8):
            settle(self.word[a[todo] + s].byteswap(), self.word[b[todo] + s].byteswap())
        s = self.length - 8
        settle(self.word[a[todo] + s].byteswap(), self.word[b[todo] + s].byteswap())
        return out

    def repeated(self, among: np.ndarray | None = None, most: int = 2_000_000) -> np.ndarray:
        """Which windows have an equal one in the block; among: the positions at which windows may, if known."""
        found = np.zeros(len(self.start), bool)
        may = np.ones(len(self.start), bool) if among is None else among[self.start]
        bucket = self.word[self.start] * _M[0] >> np.uint64(40)
        rounds = max(1, len(self.start) // most)
        for turn in range(rounds):
            mine = np.flatnonzero((bucket % np.uint64(rounds) == turn) & may)
            order = mine[np.lexsort((self.word[self.start[mine]], self.group[mine]))]
            w, g = self.word[self.start[order]], self.group[order]
            new = np.concatenate(([True], (w[1:] != w[:-1]) | (g[1:] != g[:-1]))) if len(order) else np.zeros(0, bool)
            while len(order):
                gid = np.cumsum(new) - 1
                count = np.bincount(gid)
                keep = count[gid] > 1
                order, gid = order[keep], gid[keep]
                if not len(order):
                    break
                head = np.concatenate(([True], gid[1:] != gid[:-1]))
                pivot = order[np.flatnonzero(head)][np.cumsum(head) - 1]
                cmp = self._against(self.start[order], self.start[pivot])
                same = cmp == 0
                gid = np.cumsum(head) - 1
                equal = np.bincount(gid[same], minlength=gid[-1] + 1)
                found[order[same & (equal[gid] > 1)]] = True
                order, key = order[~same], (gid * 2 + (cmp > 0))[~same]
                again = np.argsort(key, kind="stable")
                order, key = order[again], key[again]
                new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        return found

    def spans(self, found: np.ndarray) -> list[tuple[int, int, int]]:
        """(piece, start, end) of the runs of windows found, in bytes of the piece."""
        at = np.flatnonzero(found)
        if not len(at):
            return []
        brk = np.flatnonzero((np.diff(at) != 1) | (np.diff(self.piece[at]) != 0)) + 1
        lo, hi = at[np.concatenate(([0], brk))], at[np.concatenate((brk - 1, [len(at) - 1]))]
        p = self.piece[lo]
        return list(zip(p.tolist(), (self.start[lo] - self.first[p]).tolist(), (self.start[hi] - self.first[p] + self.length).tolist()))


def _solve(batch: list[tuple], length: int, shared: int) -> pa.RecordBatch | None:
    """Repeats among pieces (v, doc, tk, start, n, windows, bytes)."""
    out = []

    def note(block: Block, found: np.ndarray, pieces: list[tuple], kind: int) -> None:
        out.extend((pieces[p][1], pieces[p][2], pieces[p][3] + a, pieces[p][3] + b, kind) for p, a, b in block.spans(found) if pieces[p][4] == 1)

    windows = [r[5] for r in batch]
    block = Block([r[6][: r[5] - 1 + shared] for r in batch], [r[0] for r in batch], shared, windows)
    found = block.repeated()
    note(block, found, batch, WHOLE if shared == length else ONLY_SHARED)
    if shared < length and found.any():
        # Only pieces with repeats go on, and only these windows; the first block is given up before the second is made.
        flags = np.split(found, np.cumsum(windows)[:-1])
        some = [p for p, f in enumerate(flags) if f.any()]
        pieces = [batch[p] for p in some]
        among = np.zeros(sum(len(r[6]) for r in pieces) + 2 * length, bool)
        at = 0
        for p, r in zip(some, pieces):
            among[at : at + len(flags[p])] = flags[p]
            at += len(r[6])
        del block, found, flags
        block = Block([r[6] for r in pieces], [r[0] for r in pieces], length, [r[5] for r in pieces])
        note(block, block.repeated(among), pieces, WHOLE)
    if not out:
        return None
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 4 else pa.int32()) for i, c in enumerate(zip(*out))], ["doc", "tk", "start", "end", "kind"])


def _repeats(rows: DataFrame, length: int, shared: int) -> DataFrame:
    """REPEATS among pieces with their text, sorted by v in each partition."""

    def run(batches):
        held, size = [], 0
        for group in runs(batches, "v"):
            if held and size > BLOCK_BYTES:
                if (out := _solve(held, length, shared)) is not None:
                    yield out
                held, size = [], 0
            new = list(zip(*(group.column(c).to_pylist() for c in ("v", "doc", "tk", "start", "n", "windows", "bytes"))))
            held += new
            size += sum(len(r[6]) for r in new)
        if held and (out := _solve(held, length, shared)) is not None:
            yield out

    return rows.mapInArrow(run, REPEATS)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc, tk and text; doc and tk are a row key that is never null, so both joins with texts can share one exchange."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("tk"), text.alias("text"))


def _window_repeats(keyed: DataFrame, reps: DataFrame, length: int, shared: int) -> DataFrame:
    """REPEATS among the pieces reps, by hashes of all their windows."""
    lists = reps.groupBy("doc", "tk").agg(F.collect_list(F.struct("n", "start", "windows")).alias("pieces"))
    sizes = {ONLY_SHARED: shared, WHOLE: length} if shared < length else {WHOLE: length}

    def hash_all(batches):
        from xxhash import xxh3_128_digest

        for b in batches:
            for doc, tk, text, pieces in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b), b.column(3).to_pylist()):
                for p in pieces:
                    for kind, size in sizes.items():
                        at = np.arange(p["start"], min(p["start"] + p["windows"], len(text) - size + 1))
                        if not len(at):
                            continue
                        h = np.frombuffer(b"".join(xxh3_128_digest(text[a : a + size]) for a in at.tolist()), np.int64).reshape(-1, 2)
                        same = lambda x: pa.array(np.full(len(at), x, np.int64))  # noqa: E731, B023
                        yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), same(doc), same(tk), pa.array(at), same(p["n"]), same(kind)], ["h1", "h2", "doc", "tk", "start", "n", "kind"])

    hashed = keyed.join(lists, ["doc", "tk"]).select("doc", "tk", "text", "pieces").mapInArrow(hash_all, "h1 bigint, h2 bigint, doc bigint, tk bigint, start bigint, n bigint, kind bigint")
    w = cut(hashed)
    keys = ["h1", "h2", "kind"]
    twice = cut(w.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1"))
    at = matched(w.where("n = 1"), twice, keys, "times").select("doc", "tk", "start", "kind").distinct()
    island = F.col("start") - F.row_number().over(Window.partitionBy("doc", "tk", "kind").orderBy("start"))
    size = F.when(F.col("kind") == WHOLE, length).otherwise(shared)
    found = at.withColumn("island", island).groupBy("doc", "tk", "kind", "island").agg(F.min("start").alias("start"), F.max("start").alias("last"))
    return found.select("doc", "tk", "start", (F.col("last") + size).alias("end"), F.col("kind").cast("int").alias("kind"))


def repeats(keyed: DataFrame, length: int = LENGTH, shared: int = SHARED, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """REPEATS: byte ranges that repeats of shared or of length bytes cover, possibly overlapping."""
    assert K <= shared <= length
    spark = keyed.sparkSession
    small_batches(spark)

    def cut_up(batches):
        for b in batches:
            out = [(*p[:2], doc, tk, *p[2:]) for doc, tk, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b)) for p in pieces_of(t, length, shared)]
            if out:
                kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["v", "p", "doc", "tk", "start", "size", "windows", "again"])

    pieces = stored(keyed.mapInArrow(cut_up, PIECES))
    classes = stored(pieces.groupBy("v", "p").agg(F.count("*").alias("n"), F.min(F.struct("doc", "tk", "start", "windows")).alias("one"), F.max("again").alias("again")))
    release(spark)
    keys = ["v", "p"]
    copies = classes.where("n > 1").select(*keys, "n")
    range_ = lambda end, kind: F.struct(end.alias("end"), F.lit(kind).alias("kind"))
    whole = F.when(F.col("size") >= length, range_(F.col("start") + F.col("size"), WHOLE))
    short = range_(F.col("start") + F.col("windows") + (shared - 1), ONLY_SHARED)
    both = F.array_compact(F.array(whole, short) if shared < length else F.array(whole))
    copied = matched(pieces, copies, keys, "n").select("doc", "tk", "start", F.explode(both).alias("x")).select("doc", "tk", "start", "x.*")

    shared_by = stored(classes.groupBy("v").agg(F.count("*").alias("kinds"), F.max("again").alias("self")).where("kinds > 1 or self").select("v", "kinds"))
    one = classes.select("v", "n", "one")
    wanted = matched(one, shared_by.where(F.col("kinds") <= hot_pieces), ["v"], "kinds").select("one.*", "v", "n")
    lists = wanted.groupBy("doc", "tk").agg(F.collect_list(F.struct("v", "n", "start", "windows")).alias("pieces"))

    def fetch(batches):
        for b in batches:
            out = []
            for doc, tk, text, pieces_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b), b.column(3).to_pylist()):
                done = set()
                for p in pieces_:
                    a = p["start"]
                    if a not in done:  # rows that repeat doc_id and text bring a piece twice
                        done.add(a)
                        out.append((p["v"], p["n"], doc, tk, a, p["windows"], text[a : a + p["windows"] - 1 + length]))
            if out:
                kinds = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["v", "n", "doc", "tk", "start", "windows", "bytes"])

    fetched = keyed.join(lists, ["doc", "tk"]).select("doc", "tk", "text", "pieces").mapInArrow(fetch, "v bigint, n bigint, doc bigint, tk bigint, start bigint, windows bigint, bytes binary")
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    out = copied.unionByName(_repeats(fetched.repartition(count, "v").sortWithinPartitions("v"), length, shared))
    crowded = shared_by.where(F.col("kinds") > hot_pieces)
    if crowded.take(1):
        out = out.unionByName(_window_repeats(keyed, matched(one, crowded, ["v"], "kinds").select("one.*", "n"), length, shared))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def dedup(docs: DataFrame, length: int = LENGTH, shared: int = SHARED, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), and n_shared for every row.

    n_shared: the bytes, removed or not, that lie in a string of shared bytes that starts anywhere else."""
    keyed = _keyed(docs)
    spans = repeats(keyed, length, shared, hot_pieces).groupBy("doc", "tk").agg(F.collect_set(F.struct("start", "end", "kind")).alias("spans"))

    def remove(batches):
        for b in batches:
            out = []
            for doc, text, spans_ in zip(b.column(0).to_pylist(), texts(b), b.column(2).to_pylist()):
                merged = _merged([(s["start"], s["end"]) for s in spans_ or () if s["kind"] == WHOLE])
                held = _merged([(s["start"], s["end"]) for s in spans_ or ()])
                edges = [0, *(x for s in merged for x in s), len(text)]
                kept = b"".join(text[a:e] for a, e in zip(edges[::2], edges[1::2]))
                out.append((doc, len(text), len(text) - len(kept), len(merged), kept, sha256(kept).hexdigest(), sum(e - a for a, e in held)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "n_shared"])

    joined = keyed.join(spans, ["doc", "tk"], "left").select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "text", "spans")
    return joined.mapInArrow(remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string, n_shared bigint")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then the bytes in repeats of SHARED bytes, which shorter passages fill too."""
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared")
