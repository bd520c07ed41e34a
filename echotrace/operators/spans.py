"""Windows that hit the same passage, merged to spans; the spans' features, filter and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import lcs_words
from ..functions.text import ngrams, words_of


def join_candidates(cand: DataFrame, windows: DataFrame, passages: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates with their windows' places; those of unknown windows, passages or documents go."""
    c = cand.select("window_id", "verse_id", "score").join(windows.select("window_id", "doc_id", "start_token", "end_token"), "window_id")
    return c.join(passages.select("verse_id"), "verse_id", "left_semi").join(docs.select("doc_id"), "doc_id", "left_semi")


def merge_spans(hits: DataFrame, max_gap: int = 8) -> DataFrame:
    """doc_id, verse_id, start_token, end_token, score_max.

    Within a document and passage a span goes on while the next start is at most max_gap past its end.
    """
    by = Window.partitionBy("doc_id", "verse_id").orderBy("start_token", "end_token")
    reach = F.max("end_token").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("reach").isNull() | (F.col("start_token") > F.col("reach") + max_gap), 1).otherwise(0)
    h = hits.select("doc_id", "verse_id", "start_token", "end_token", "score").withColumn("reach", reach).withColumn("new", new)
    h = h.withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = h.groupBy("doc_id", "verse_id", "span").agg(F.min("start_token").alias("start_token"), F.max("end_token").alias("end_token"), F.max("score").alias("score_max"))
    return merged.drop("span")


def coverage(snippet_grams: Column, passage_grams: Column) -> Column:
    """Share of the passage's distinct grams that the snippet has."""
    return F.size(F.array_intersect(snippet_grams, passage_grams)) / F.greatest(F.lit(1), F.size(F.array_distinct(passage_grams)))


def add_features(spans: DataFrame, docs: DataFrame, passages: DataFrame, least: int = 3, most: int = 5) -> DataFrame:
    """Spans with their text, the passage, coverage by n-grams and the word LCS ratio, and the document's columns."""
    d = docs.select("doc_id", "title", "president", "date", F.col("text_norm").alias("doc_norm"))
    v = passages.select("verse_id", "ref", F.col("text_raw").alias("verse_text"), F.col("text_norm").alias("verse_norm"))
    s = spans.join(v, "verse_id").join(d, "doc_id", "left")
    words = F.slice(words_of(F.col("doc_norm")), F.col("start_token") + 1, F.col("end_token") - F.col("start_token"))
    s = s.withColumn("snippet_norm", F.array_join(words, " "))
    s = s.withColumn("sw", words_of(F.col("snippet_norm"))).withColumn("vw", words_of(F.col("verse_norm")))
    s = s.withColumn("sg", ngrams(F.col("sw"), least, most)).withColumn("vg", ngrams(F.col("vw"), least, most))
    s = s.withColumn("cov_ngram", coverage(F.col("sg"), F.col("vg")))
    s = s.withColumn("lcs_ratio", lcs_words("snippet_norm", "verse_norm") / F.greatest(F.lit(1), F.size("vw")))
    return s.select("doc_id", "verse_id", "start_token", "end_token", "score_max", "snippet_norm", "ref", "verse_text", "cov_ngram", "lcs_ratio", "title", "president", "date", "doc_norm")


def keep_aligned(matches: DataFrame, min_cov: float = 0.55, min_lcs: float = 0.45) -> DataFrame:
    return matches.where((F.col("cov_ngram") >= min_cov) | (F.col("lcs_ratio") >= min_lcs))


def best_per_passage(matches: DataFrame) -> DataFrame:
    """The best span of each document and passage; the earlier one of a tie."""
    by = Window.partitionBy("doc_id", "verse_id").orderBy(F.desc("score_max"), "start_token")
    return matches.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def rank_in_document(matches: DataFrame) -> DataFrame:
    by = Window.partitionBy("doc_id").orderBy(F.desc("score_max"), "verse_id")
    return matches.withColumn("rank_in_doc", F.row_number().over(by))


PREVIEW = ("doc_id", "title", "president", "date", "ref", "score_max", "cov_ngram", "lcs_ratio", "start_token", "end_token", "snippet_norm", "verse_text")


def preview(ranked: DataFrame, top_per_doc: int = 10) -> DataFrame:
    """The best matches of each document, in order of document and score."""
    return ranked.where(F.col("rank_in_doc") <= top_per_doc).orderBy("doc_id", F.desc("score_max"), "verse_id").select(*PREVIEW)


def by_probability(scored: DataFrame) -> DataFrame:
    """Scored matches, likeliest first; null and NaN last."""
    return scored.orderBy(F.nanvl(F.col("match_proba").cast("double"), F.lit(None)).desc_nulls_last(), "doc_id", "verse_id")
