"""Best-fit packing under conflicts.

Documents become pieces of at most ``capacity`` words; a bin takes pieces up to its capacity, never
two of one source nor two of one duplicate cluster (equal texts, and so pieces of one document).
Pieces go longest first to the tightest bin that fits: bins are ordered by residual, a bitmap of
residuals in use gives the successor of a size, and the search goes on upward while the bins found
conflict. Bins carry a bitmap of sources and one of clusters; bins with equal source bitmaps and
residuals are searched together.

Documents are dealt by a hash of doc_id, text and, among equal rows, the row's number into shards of about
``shard_rows``, whose number follows the count of rows; each shard is packed by itself in one task, which holds
the lengths, sources and clusters of its rows and no texts. A source, a doc_id or a text that has a third of all
rows is spread over all shards.
What sharding costs is at most the unfilled bins at the end of each shard.

Edge cases. A null or empty text is a piece of 0 words, which takes part in conflicts. A null source
conflicts with nothing; null texts are of one cluster. Ties in length go by doc_id, nulls last.
Repeated rows are packed each, into different bins as they are of one cluster. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, parts_for, table

CAPACITY = 2048
SHARD_ROWS = 20_000
RUN = 10_000  # so many of a group of equal rows are numbered at once
SCHEMA = "bin_id bigint, slot int, doc_id bigint, source string, cluster_id bigint, start_word bigint, n_words bigint"


class Packer:
    """The open bins of one shard, in order of residual."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.used = 0  # bit r: some bin has residual r
        self.by_residual: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.clusters: list[int] = []
        self.slots: list[int] = []

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin and slot for a piece; source and cluster are bits, or 0."""
        found = self._tightest(size, source, cluster)
        if found is None:
            found = (len(self.clusters), self.capacity, 0)
            self.clusters.append(0)
            self.slots.append(0)
        else:
            self._take(*found)
        b, residual, mask = found
        self.clusters[b] |= cluster
        self.slots[b] += 1
        r, mask = residual - size, mask | source
        self.by_residual[r].setdefault(mask, []).append(b)
        self.used |= 1 << r
        return b, self.slots[b] - 1

    def _tightest(self, size: int, source: int, cluster: int) -> tuple[int, int, int] | None:
        rest = self.used >> size
        while rest:
            low = rest & -rest
            r = size + low.bit_length() - 1
            fits = ((b, r, m) for m, bins in self.by_residual[r].items() if not m & source for b in bins if not self.clusters[b] & cluster)
            if (found := next(fits, None)) is not None:
                return found
            rest ^= low
        return None

    def _take(self, b: int, r: int, mask: int) -> None:
        bins = self.by_residual[r][mask]
        bins.remove(b)
        if not bins:
            del self.by_residual[r][mask]
            if not self.by_residual[r]:
                self.used &= ~(1 << r)


def _pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    shard = int(rows["shard"].iloc[0])
    pieces = []
    for doc, source, cluster, n in zip(rows["doc_id"], rows["source"], rows["cluster_id"], rows["n_words"]):
        doc, source = (None if pd.isna(doc) else int(doc)), (None if pd.isna(source) else source)
        n = int(n)
        for a in range(0, max(n, 1), capacity):
            pieces.append((min(capacity, n - a), doc, a, source, int(cluster)))
    pieces.sort(key=lambda p: (-p[0], p[1] is None, p[1] or 0, p[2], p[4]))
    held: dict[int, int] = {}
    for p in pieces:
        held[p[4]] = held.get(p[4], 0) + 1
    sources: dict[str, int] = {}
    clusters: dict[int, int] = {}
    packer, out = Packer(capacity), []
    for size, doc, a, source, cluster in pieces:
        s = 0 if source is None else 1 << sources.setdefault(source, len(sources))
        c = 1 << clusters.setdefault(cluster, len(clusters)) if held[cluster] > 1 else 0
        b, slot = packer.put(size, s, c)
        out.append(((shard << 32) + b, slot, doc, source, cluster, a, size))
    frame = pd.DataFrame(out, columns=["bin_id", "slot", "doc_id", "source", "cluster_id", "start_word", "n_words"])
    return frame.astype({"doc_id": "Int64"})


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each piece: its bin, its slot there, and which words of which document it has."""
    text = F.coalesce(F.col("text"), F.lit(""))
    shards = parts_for(docs.count(), shard_rows)
    d = docs.select("doc_id", "source", F.xxhash64(text).alias("cluster_id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"))
    # Equal rows are counted first, and each gets its number among them as a part of what deals it.
    d = d.groupBy(*d.columns).agg(F.count("*").alias("rows"))
    d = d.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / RUN)))).withColumn("first", F.col("run") * RUN)
    d = d.withColumn("row", F.explode(F.sequence(F.col("first"), F.least("rows", F.col("first") + RUN) - 1)))
    shard = F.pmod(F.xxhash64(F.lit(3), F.col("doc_id"), F.col("cluster_id"), F.col("row")), F.lit(shards)).cast("int")
    d = d.select("doc_id", "source", "cluster_id", "n_words", shard.alias("shard"))
    return d.groupBy("shard").applyInPandas(lambda rows: _pack_shard(rows, capacity), SCHEMA)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
