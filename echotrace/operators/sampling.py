"""Exact-size sampling and stratified splits, by an order of hashes instead of a random stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storing import kept


def order_hash(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


BUCKETS = 4096


def _ranked(rows: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """rows with __n, the rank within the class by order_hash and key, and __size of the class."""
    bucket = F.conv(F.substring(order_hash(key, seed), 1, 3), 16, 10).cast("int")
    r = rows.withColumn("__bucket", bucket)
    sizes = r.groupBy(F.col(label).alias("__l"), F.col("__bucket").alias("__b")).agg(F.count("*").alias("__c"))  # BUCKETS rows a class
    before = F.sum("__c").over(Window.partitionBy("__l").orderBy("__b")) - F.col("__c")
    sizes = sizes.select("__l", "__b", before.alias("__before"), F.sum("__c").over(Window.partitionBy("__l")).alias("__size"))
    inside = F.row_number().over(Window.partitionBy(F.col(label), "__bucket").orderBy(order_hash(key, seed), key))
    r = r.withColumn("__n", inside).join(sizes, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__bucket") == F.col("__b")))
    return r.withColumn("__n", F.col("__n") + F.col("__before")).drop("__bucket", "__l", "__b", "__before")


def balance(rows: DataFrame, label: str, key: str, ratio: int = 4, seed: int = 42) -> DataFrame:
    """All positives and at most ratio times as many negatives; all rows if a class is empty.

    A class is never sorted in one task: its rows are ranked within BUCKETS ranges of the hash that orders them."""
    pos = rows.agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("__pos"))  # one row
    r = _ranked(rows, label, key, seed).crossJoin(F.broadcast(pos))
    return r.where((F.col(label) == 1) | (F.col("__pos") == 0) | (F.col("__n") <= ratio * F.col("__pos"))).drop("__pos", "__n", "__size")


def split(rows: DataFrame, label: str, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with is_test: the same share of each class, rounded."""
    return _ranked(rows, label, key, seed).withColumn("is_test", F.col("__n") <= F.round(F.col("__size") * test)).drop("__n", "__size")


def scores(rows: DataFrame, truth: str, probability: str, threshold: float = 0.01) -> DataFrame:
    """One row: precision, recall, f1 at the threshold, and positives; 0 for 0/0."""
    yes = F.col(probability) >= threshold
    s = rows.agg(
        F.sum(F.when(yes & (F.col(truth) == 1), 1).otherwise(0)).alias("tp"), F.sum(F.when(yes & (F.col(truth) == 0), 1).otherwise(0)).alias("fp"),
        F.sum(F.when(~yes & (F.col(truth) == 1), 1).otherwise(0)).alias("fn"), F.sum(yes.cast("int")).alias("positives"),
    )
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.select(p.alias("precision"), r.alias("recall"), share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), F.col("positives").cast("long"))


def ranking_scores(rows: DataFrame, truth: str, probability: str) -> DataFrame:
    """One row: auc (ties count half) and average_precision over all thresholds; null if a class is empty. Rows without a score are left out.

    Scores are summed first, then dealt by range, so that running sums are made within ranges and joined by the ranges' totals."""
    yes = F.col(truth) == 1
    s = rows.where(F.col(probability).isNotNull()).groupBy(F.col(probability).cast("double").alias("p")).agg(F.sum(F.when(yes, 1).otherwise(0)).alias("pos"), F.sum(F.when(yes, 0).otherwise(1)).alias("neg"))
    s = kept(s.repartitionByRange(F.desc("p")).withColumn("part", F.spark_partition_id()))
    parts = s.groupBy("part").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each partition
    parts = parts.select("part", F.coalesce(F.sum("tp").over(above), F.lit(0)).alias("tp0"), F.coalesce(F.sum("fp").over(above), F.lit(0)).alias("fp0"))
    by = Window.partitionBy("part").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    s = s.join(F.broadcast(parts), "part").withColumn("tp", F.sum("pos").over(by) + F.col("tp0")).withColumn("fp", F.sum("neg").over(by) + F.col("fp0"))
    pos, neg = F.sum("pos"), F.sum("neg")
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    precise = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return s.agg(F.when((pos > 0) & (neg > 0), area / pos / neg).alias("auc"), F.when(pos > 0, precise / pos).alias("average_precision"))


def describe(rows: DataFrame, value: str) -> DataFrame:
    """One row: count, mean, sample deviation, least, quartiles (interpolated), largest."""
    q = F.percentile(F.col(value).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    d = rows.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), q.alias("q"), F.max(value).alias("max"))
    return d.select("count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")
