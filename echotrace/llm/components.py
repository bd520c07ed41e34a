"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; links of all nodes never meet in one task or the driver.
Every round is cut by a checkpoint, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("k"), F.least("a", "least").alias("m"))
    joined = both.join(least, F.col("a") == F.col("k"))
    if large:  # each larger neighbour of a points to the least of a's neighbourhood
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # links run from larger to smaller: the smaller neighbours and a itself point to the least
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b): b is the smallest node that a can reach; nodes that are the smallest have no row.

    links: two columns a and b of long node ids, in any order and repeated at will; null: no link.
    """
    now = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a") + F.col("b")).alias("s")).where("s is not null and a <> b").select("a", "b").distinct())
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            return now
        state = seen
        now = cut(_star(_star(now, True), False))
