"""The stages of passage matching, each a DataFrame from DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrow, text
from ..operators import retrieval, spans, windows
from ..operators.storing import stored
from ..sources.tables import column, require_columns


def index_passages(rows: DataFrame, translation: str = "KJV") -> DataFrame:
    """Reference passages with ids and their matching form. rows: book, chapter, verse, ref, text in any case."""
    names = require_columns(rows, ["book", "chapter", "verse", "ref", "text"])
    c = lambda n: column(rows, names[n])
    out = rows.select(
        F.lit(translation).alias("translation"), c("book").cast("string").alias("book"), c("chapter").cast("int").alias("chapter"), c("verse").cast("int").alias("verse"),
        c("ref").cast("string").alias("ref"), text.short_hash(F.lit(translation), c("ref")).alias("verse_id"), text.blank_if_null(c("text").cast("string")).alias("text_raw"),
    )
    out = out.withColumn("text_norm", text.normalize_passage(F.col("text_raw"), arrow.unescape_nfkc))
    return out.withColumn("token_count", text.token_count(F.col("text_norm")))


def index_documents(rows: DataFrame) -> DataFrame:
    """Documents in matching form. rows: doc_id, title, president, date_iso, transcript_norm and perhaps url, transcript_raw."""
    names = require_columns(rows, ["doc_id", "title", "president", "date_iso", "transcript_norm"])
    have = {c.lower(): c for c in rows.columns}
    c = lambda n: column(rows, have[n])
    out = [
        c("doc_id").cast("string").alias("doc_id"), c("title").cast("string").alias("title"), c("president").cast("string").alias("president"),
        F.try_to_timestamp(c("date_iso").cast("string")).alias("date"), text.blank_if_null(c("transcript_norm").cast("string")).alias("text_norm"),
    ]
    out += [c("url").cast("string").alias("url")] if "url" in have else []
    out += [c("transcript_raw").cast("string").alias("text_raw")] if "transcript_raw" in have else []
    assert names
    return rows.select(*out).withColumn("token_count", text.token_count(F.col("text_norm")))


def normalize_rows(rows: DataFrame, notes: bool = True, flatten: bool = False) -> DataFrame:
    """Scraped rows with doc_id, the raw transcript, its matching form and token count; columns that rows lack stay out."""
    own = F.nullif(F.trim(F.col("node_id").cast("string")), F.lit("")) if "node_id" in rows.columns else F.lit(None).cast("string")
    r = rows.withColumn("doc_id", F.coalesce(own, F.xxhash64(text.blank_if_null(F.col("url"))).cast("string"))).withColumn("transcript_raw", F.col("transcript"))
    r = r.withColumn("transcript_norm", text.normalize_document(F.col("transcript"), notes, arrow.unescape)).withColumn("token_count_norm", text.token_count(F.col("transcript_norm")))
    if flatten:
        r = r.withColumn("transcript_flat", text.flatten_lines(F.col("transcript")))
    keep = ["doc_id", "title", "president", "date_iso", "date_text", "location", "url", "word_count", "has_video_flag", "transcript_raw", "transcript_norm", "token_count_norm", "transcript_flat"]
    return r.select(*(c for c in keep if c in r.columns))


def match(docs: DataFrame, passages: DataFrame, length: int = 30, stride: int = 5, least: int = 3, most: int = 5, top: int = 10, max_gap: int = 8, min_cov: float = 0.55, min_lcs: float = 0.45) -> DataFrame:
    """Ranked matches of indexed documents and passages, from retrieval to ranks."""
    docs = stored(docs)  # retrieval, spans and ranks all read it
    found = retrieval.candidates(docs, passages, length, stride, least, most, top)
    merged = spans.merge_spans(found, max_gap)
    aligned = spans.keep_aligned(spans.add_features(merged, docs, passages, least, most), min_cov, min_lcs)
    return spans.rank_in_document(spans.best_per_passage(aligned))


__all__ = ["index_passages", "index_documents", "normalize_rows", "match", "windows"]
