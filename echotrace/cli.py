"""Command line: ``python -m echotrace <command>``. Each command is a plan from files to files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import normalize_pair_text
from .operators import retrieval, sampling, spans, windows
from .operators.classifier import TextPairClassifier, training_pairs
from .plans import matching
from .sources import listing, pages, tables

#: Where the archive's categories are.
SITE, CATEGORIES = "https://www.presidency.ucsb.edu", "/documents/app-categories/spoken-addresses-and-remarks/presidential/"
WHOLE = 1 << 30  # a window that no text outgrows


def _read(spark: SparkSession, path: str) -> DataFrame:
    tables.require_path(spark, path)
    return tables.read_table(spark, path)


def _write(df: DataFrame, path: str) -> None:
    tables.write_table(df, path)
    print(f"wrote {path}")


def normalize(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = matching.normalize_rows(_read(spark, a.input), not a.drop_notes, a.flatten_transcript)
    base = a.out or tables.mirrored_base(a.input)
    tables.write_both(rows, base)
    print(f"wrote {base}.csv and {base}.parquet")


def index_passages(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = matching.index_passages(_read(spark, a.bible_in), a.translation)
    tables.require_unique(rows, "verse_id")
    _write(rows, f"{a.out_dir}/verses_index.parquet")


def index_documents(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = matching.index_documents(_read(spark, a.speeches_in))
    _write(docs, f"{a.out_dir}/speeches_index.parquet")
    _write(windows.make_windows(docs, a.window_len, a.stride), f"{a.out_dir}/windows.parquet")


def gen_candidates(spark: SparkSession, a: argparse.Namespace) -> None:
    """Each row of the windows file is a text of its own, so any windows will do."""
    w = _read(spark, a.windows).select(F.col("window_id").alias("doc_id"), F.col("snippet_norm").alias("text_norm"))
    found = retrieval.candidates(w, _read(spark, a.bible_index), WHOLE, WHOLE, a.ngram_min, a.ngram_max, a.topk)
    _write(found.select(F.col("doc_id").alias("window_id"), "verse_id", "ref", "score", "rank").orderBy("window_id", "rank"), f"{a.out_dir}/candidates.parquet")


def merge_spans(spark: SparkSession, a: argparse.Namespace) -> None:
    at = lambda given, name: _read(spark, given or f"{a.out_dir}/{name}.parquet")
    passages, docs = at(a.bible_index, "verses_index"), at(a.speeches_index, "speeches_index")
    tables.require_unique(passages, "verse_id")
    tables.require_unique(docs, "doc_id")
    hits = spans.join_candidates(at(a.candidates, "candidates"), at(a.windows, "windows"), passages, docs)
    kept = spans.keep_aligned(spans.add_features(spans.merge_spans(hits, a.max_gap), docs, passages, a.ngram_min, a.ngram_max), a.min_cov, a.min_lcs)
    _ranked(spark, spans.rank_in_document(spans.best_per_passage(kept)), a)


def match(spark: SparkSession, a: argparse.Namespace) -> None:
    """All steps in one plan, without a table of windows."""
    docs, passages = _read(spark, a.speeches_index), _read(spark, a.bible_index)
    _ranked(spark, matching.match(docs, passages, a.window_len, a.stride, a.ngram_min, a.ngram_max, a.topk, a.max_gap, a.min_cov, a.min_lcs), a)


def _ranked(spark: SparkSession, ranked: DataFrame, a: argparse.Namespace) -> None:
    _write(ranked, f"{a.out_dir}/matches.parquet")
    _write(spans.preview(spark.read.parquet(f"{a.out_dir}/matches.parquet"), a.top_per_doc), f"{a.out_dir}/matches_preview.csv")


def scrape(spark: SparkSession, a: argparse.Namespace) -> None:
    """Lists a category, fetches what is not yet seen, and adds to rows.* and seen_urls."""
    listing.register(spark)
    category = a.slug if a.slug.startswith("http") else SITE + CATEGORIES + a.slug.strip("/ ")
    reader = spark.read.format("listing").option("category", category).option("items_per_page", a.items_per_page)
    pages_ = (reader.option("max_pages", a.max_pages) if a.max_pages else reader).load()
    urls = pages.listed_documents(pages_, category)
    seen = f"{a.out_dir}/seen_urls"
    try:
        tables.require_path(spark, seen)
        urls = pages.unseen(urls, spark.read.text(seen))
    except FileNotFoundError:
        pass
    got = listing.fetch_documents(urls.orderBy("page", "pos").select("url"), a.pause).persist()  # fetched once, used twice
    rows = pages.parse_pages(got.where("html is not null"))
    rows = pages.with_transcript(rows, a.min_words) if a.require_transcript else rows
    rows = rows.orderBy(*(F.col(c).asc_nulls_last() for c in ("date_iso", "president", "title")))
    tables.write_both(rows, f"{a.out_dir}/rows", "append")
    got.where("html is not null").select(F.col("url").alias("value")).write.mode("append").text(seen)
    failed = got.where("html is null").count()
    got.unpersist()
    print(f"added to {a.out_dir}/rows; {failed} pages failed and will be tried again")


def classify(spark: SparkSession, a: argparse.Namespace) -> None:
    train = training_pairs(_read(spark, a.train_csv))
    model = TextPairClassifier(rounds=a.rounds).fit(train)
    model.validation.show()
    m = _read(spark, a.matches_path)
    tables.require_columns(m, ["snippet_norm", "verse_text"])
    m = m.withColumn("snippet_norm", normalize_pair_text(F.col("snippet_norm"))).withColumn("verse_norm", normalize_pair_text(F.col("verse_text")))
    _write(model.predict(m, a.threshold).drop("pair_id"), a.output_path)
    scored = tables.read_table(spark, a.output_path)
    sampling.describe(scored, "match_proba").show()
    scored.agg(F.sum("match_label").alias("positives")).show()


def sort_scored(spark: SparkSession, a: argparse.Namespace) -> None:
    tables.write_both(spans.by_probability(_read(spark, a.input)), a.out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="echotrace", description="Finds and scores quotations of short passages in documents.")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, **options) -> None:
        c = sub.add_parser(name, help=run.__doc__)
        for flag, default in options.items():
            flag = "--" + flag
            if default is ...:
                c.add_argument(flag, required=True)
            elif default is False:
                c.add_argument(flag, action="store_true")
            else:
                c.add_argument(flag, default=default, type=type(default) if default is not None else str)
        c.set_defaults(run=run)

    grams = {"ngram_min": 3, "ngram_max": 5}
    merge = {"min_cov": 0.55, "min_lcs": 0.45, "max_gap": 8, "top_per_doc": 10}
    command("normalize", normalize, input=..., out=None, **{"flatten-transcript": False, "drop-notes": False})
    command("index-bible", index_passages, bible_in=..., translation="KJV", out_dir=...)
    command("index-speeches", index_documents, speeches_in=..., out_dir=..., window_len=30, stride=5)
    command("gen-candidates", gen_candidates, bible_index=..., windows=..., out_dir=..., topk=10, **grams)
    command("merge-spans", merge_spans, out_dir=..., candidates=None, windows=None, bible_index=None, speeches_index=None, **grams, **merge)
    command("match", match, bible_index=..., speeches_index=..., out_dir=..., window_len=30, stride=5, topk=10, **grams, **merge)
    command("scrape", scrape, slug=..., pause=0.25, **{"items-per-page": 60, "max-pages": 0, "out-dir": ..., "require-transcript": False, "min-words": 30})
    command("classify", classify, threshold=0.01, rounds=50, **{"train-csv": ..., "matches-path": ..., "output-path": ...})
    command("sort-scored", sort_scored, input=..., out=...)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(spark or SparkSession.builder.appName("echotrace").getOrCreate(), a)
