"""SimHash near-dedup with vantage-point trees.

Fingerprints: 64 bits by majority over the XXH64 of word shingles. Documents with one fingerprint
are one class, so groups of copies shrink to a row before any search.

Search. In a space of 64 even bits a plain vantage-point tree prunes little: distances crowd around
32 and most balls of radius 4 cross most boundaries. So the outer trees stand in subspaces. The bits
are split into ``blocks``; two fingerprints that differ in at most k bits differ in at most
r = k // blocks bits of some block. Each block has a tree of vantage points; a fingerprint's shard is
the list of its Hamming distances to them, and by the triangle bound its ball of radius r in the
block overlaps only shards whose distances differ by r at most. The fingerprint goes to its own
shard, and to every overlapping one that a ball of radius r reaches (none but its own for the default
of 5 blocks, where r = 0), so each link shows up in some shard. Within a shard a vantage-point tree
over whole fingerprints splits at the median distance, and only the bands within k of the boundary
are compared across it. Shards of over ``shard_rows`` are dealt into chunks, and every pair of chunks
is searched in a task of its own.

A shard returns a spanning forest of the links that it finds, not all pairs; components() joins them.

Edge cases. Null and empty texts have fingerprint zero and are linked like any other. Rows that
repeat a doc_id with several texts are not linked by it: each row has the component of its own text, named
by the smallest doc_id there. A null doc_id is given
the component of its fingerprint's other rows, or null. An empty table gives an empty result.
Other columns are ignored by ``near_duplicates`` and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import runs, small_batches, texts
from .common import cut, fresh, parts_for, table
from .components import components

SHINGLE, SEED, RADIUS, BLOCKS = 4, 42, 4, 5
SHARD_ROWS = 20_000
LEAF = 512


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of UTF-8 text, unsigned."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        digests = xxh64_digest(whole, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digests = b"".join([xxh64_digest(whole[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(bits)
    return int.from_bytes(np.packbits(over).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


class BlockTree:
    """The outer tree of one block: its vantage points, and the shards that a ball overlaps."""

    def __init__(self, low: int, width: int, radius: int, salt: int):
        self.low, self.width, self.salt = np.uint64(low), width, np.uint64(salt)
        draw = np.random.default_rng(1_000 + salt)
        self.vantage = draw.integers(0, 1 << width, 2 * width, dtype=np.uint64)
        self.flips = [sum(1 << i for i in c) for n in range(radius + 1) for c in combinations(range(width), n)]

    def shards(self, fps: np.ndarray) -> Iterator[np.ndarray]:
        """The shard of each fingerprint, then those of its neighbours in the ball."""
        block = (fps >> self.low) & np.uint64((1 << self.width) - 1)
        for flip in self.flips:
            key = np.full(len(fps), self.salt, np.uint64)
            for v in self.vantage:
                key = (key + np.bitwise_count(block ^ np.uint64(flip) ^ v)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            yield key


def block_trees(radius: int = RADIUS, blocks: int = BLOCKS) -> list[BlockTree]:
    edges = np.linspace(0, 64, blocks + 1).round().astype(int).tolist()
    return [BlockTree(a, b - a, radius // blocks, i) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


class Shard:
    """Finds the links among a shard's fingerprints with a vantage-point tree; keeps a forest of them."""

    def __init__(self, fps: np.ndarray, radius: int = RADIUS):
        self.fps, self.radius = fps, radius
        self.label = np.arange(len(fps))
        self.edges: list[tuple[int, int]] = []

    def search(self) -> list[tuple[int, int]]:
        todo: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(self.fps)), None)]
        while todo:
            a, b = todo.pop()
            if len(a) * len(a if b is None else b) <= LEAF * LEAF:
                self._compare(a, b)
            else:
                parts = self._split(a, b)
                if parts is None:
                    self._compare(a, b)
                else:
                    todo += [p for p in parts if len(p[0]) and (p[1] is None or len(p[1]))]
        return self.edges

    def _split(self, a: np.ndarray, b: np.ndarray | None):
        """The parts of a (or of a against b) that the triangle bound leaves; None if nothing is split."""
        v = self.fps[a[len(a) // 2]]
        da = np.bitwise_count(self.fps[a] ^ v).astype(int)
        mid = int(np.median(da))
        near, far, k = da <= mid, da > mid, self.radius
        if b is None:
            if not far.any():
                return None
            return [(a[near], None), (a[far], None), (a[near & (da > mid - k)], a[far & (da <= mid + k)])]
        db = np.bitwise_count(self.fps[b] ^ v).astype(int)
        parts = [(a[near & (da > mid - k)], b[(db > mid) & (db <= mid + k)]), (a[far & (da <= mid + k)], b[(db <= mid) & (db > mid - k)]), (a[near], b[db <= mid]), (a[far], b[db > mid])]
        whole = len(a) * len(b)
        return parts if max(len(x) * len(y) for x, y in parts) < 0.8 * whole else None

    def _compare(self, a: np.ndarray, b: np.ndarray | None) -> None:
        for at, i in enumerate(a):
            others = a[at + 1 :] if b is None else b
            hit = others[np.bitwise_count(self.fps[others] ^ self.fps[i]) <= self.radius]
            if len(hit):
                hit = hit[self.label[hit] != self.label[i]]
            while len(hit):
                j = hit[0]
                old, new = self.label[j], self.label[i]
                self.label[self.label == old] = new
                self.edges.append((int(i), int(j)))
                hit = hit[self.label[hit] != new]


def _deal(classes: DataFrame, radius: int, blocks: int, shard_rows: int) -> DataFrame:
    """(shard, id, fp): every class in every shard that it belongs to; large shards in pairs of chunks."""
    trees = block_trees(radius, blocks)

    def run(batches):
        for b in batches:
            fps, ids = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64), b.column(0)
            for tree in trees:
                for key in tree.shards(fps):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids, b.column(1)], ["shard", "id", "fp"])

    dealt = cut(classes.select("id", "fp").mapInArrow(run, "shard bigint, id bigint, fp bigint"))
    # At most rows / shard_rows shards are large, and a row of theirs goes to as many tasks as its shard has chunks.
    large = dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows).select(F.col("shard").alias("k"), F.ceil(F.col("n") / shard_rows).cast("long").alias("chunks"))
    d = dealt.join(large, F.col("shard") == F.col("k"), "left").drop("k").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    own = F.pmod(F.xxhash64("fp"), "chunks")
    pair = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    d = d.withColumn("own", own).select("shard", "id", "fp", "own", pair.alias("other"))
    return d.select(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "id", "fp")


def links(classes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): ids of classes that are linked, enough of them to give the components."""
    dealt = _deal(classes, radius, blocks, shard_rows)

    def run(batches):
        for shard in runs(batches, "shard"):
            if shard.num_rows < 2:
                continue
            ids, fps = (shard.column(c).to_numpy() for c in ("id", "fp"))
            edges = Shard(fps.view(np.uint64), radius).search()
            if edges:
                at = np.array(edges)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], ["a", "b"])

    spark = classes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    return dealt.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shingle: int = SHINGLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fp and component_id for every row."""
    fps = cut(fingerprints(docs, shingle))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("id"))
    known = cut(classes)
    roots = components(links(known.where("id is not null"), radius, blocks, shard_rows))
    named = known.join(roots, F.col("id") == F.col("a"), "left").select(F.col("fp").alias("k"), F.coalesce("b", "id").alias("component_id"))
    return fps.join(named, F.col("fp") == F.col("k")).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; rows without a doc_id stay."""
    found = near_duplicates(docs, **options)
    gone = fresh(docs, "__gone")[0]
    first = found.groupBy("doc_id").agg(F.min("component_id").alias("c")).where("doc_id <> c").select(F.col("doc_id").alias(gone))
    return docs.join(first, F.col("doc_id") == F.col(gone), "left_anti")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
