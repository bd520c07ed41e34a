"""Line dedup: hash normalised lines, count their documents, drop the frequent ones, reassemble.

The plan: one narrow pass gives a row of (key hash, document) for each distinct key of a document,
summed on the map side; a second narrow pass finds the positions of lines whose key is frequent;
only then do texts move, once, to meet the positions that leave them. A key that a third of all
lines share is summed before the shuffle; the HOT_KEYS keys of most documents are then broadcast, and
their lines pass the join on a scattered key, while all other keys meet in it.

Edge cases. A null or empty text has one empty line and keeps it. A document is a doc_id: where
rows repeat a doc_id, the line counts once for that doc_id, and each row is reassembled by itself, as
positions belong to doc_id and text. A null doc_id is a document of its own that is smaller than all others. An empty table gives an
empty result. Lines over the length bound of 20 code points and any number of ties are exact: keys
are compared by 128 bits of hash. Other columns, whatever their names, are ignored by ``dedup`` and kept by ``apply``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, cut, fresh, let, table

MIN_CHARS = 20
MIN_DOCS = 3
HOT_KEYS = 1000


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _keys(lines: Column, min_chars: int) -> Column:
    """Of each line that counts: its position and the two hashes of its key."""

    def one(line: Column, i: Column) -> Column:
        key = let(F.btrim(line, F.lit(BLANKS)), lambda s: F.when(F.char_length(s) >= min_chars, let(ascii_lower(s), lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"), i.alias("pos")))))
        return key

    return F.filter(F.transform(lines, one), lambda x: x.isNotNull())


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, tk, drop): the sorted positions of the lines that each row of doc_id and text (known by its hash tk) loses, if any."""
    lines = docs.select("doc_id", F.xxhash64(_text()).alias("tk"), F.explode(_keys(F.split(_text(), "\n"), min_chars)).alias("k")).select("doc_id", "tk", "k.*")
    # Distinct within the row before the explode would miss rows that repeat a doc_id, so pairs are made distinct by Spark.
    held = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("one").alias("n"), F.max("doc_id").alias("last"))
    frequent = cut(held.where(F.col("n") >= min_docs))
    hot = frequent.orderBy(F.desc("n"), "h1", "h2").limit(HOT_KEYS).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("last").alias("hot_last"), F.lit(True).alias("hot"))
    rest = frequent.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), F.col("last").alias("rest_last"), F.lit(True).alias("found"))
    lines = lines.join(F.broadcast(hot), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    lines = lines.withColumn("k", F.when(F.col("hot"), F.xxhash64("doc_id", "tk", "pos")).otherwise(F.col("h1")))
    met = lines.join(rest, (F.col("k") == F.col("f1")) & (F.col("h2") == F.col("f2")) & F.col("hot").isNull(), "left")
    last = F.when(F.col("hot"), F.col("hot_last")).otherwise(F.col("rest_last"))
    lost = met.where((F.col("hot") | F.col("found")) & ~F.col("doc_id").eqNullSafe(last))
    return lost.groupBy("doc_id", "tk").agg(F.sort_array(F.collect_set("pos")).alias("drop"))


def _kept_text(text: Column, drop: Column) -> Column:
    def join(lines: Column) -> Column:
        rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
        return F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n")

    return F.when(drop.isNull(), text).otherwise(let(F.split(text, "\n"), join))


def _reassembled(docs: DataFrame, min_chars: int, min_docs: int) -> tuple[DataFrame, str]:
    """docs with what is left of text, and a column (its name) of the positions dropped, or null."""
    doc, tk, drop, key = fresh(docs, "__doc", "__tk", "__drop", "__key")
    drops = dropped_lines(docs, min_chars, min_docs).select(F.col("doc_id").alias(doc), F.col("tk").alias(tk), F.col("drop").alias(drop))
    keyed = docs.withColumn(key, F.xxhash64(_text()))
    joined = keyed.join(drops, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(tk)), "left").drop(doc, tk, key)
    return joined.withColumn("text", _kept_text(_text(), F.col(drop))), drop


def apply(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs, all columns, with text replaced by what is left of it."""
    out, drop = _reassembled(docs, min_chars, min_docs)
    return out.drop(drop)


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (kept lines) for every row."""
    d = docs.select("doc_id", _text().alias("text"))
    d = d.withColumn("n_lines", F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1)
    out, drop = _reassembled(d, min_chars, min_docs)
    return out.select("doc_id", F.col("n_lines").cast("long"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"), "text")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, i AS pos, s[i] AS line, translate(trim(s[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
f AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, f.k IS NOT NULL AND l.doc_id <> f.last AS lost FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN lost THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
