"""Features of aligned pairs of texts: BM25, TF-IDF cosines, lexical overlap, vectors.

Pairs are rows with pair_id, s (snippet) and v (passage text). Corpus statistics come from tables, so the
ones of a training set can be kept and joined when new pairs are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import token_sort_ratio
from ..functions.text import blank_if_null, simple_tokens, squeeze
from . import grams as gr
from .storing import small_batches, stored


def term_documents(texts: DataFrame, text: str) -> DataFrame:
    """(term, df): in how many texts each token is."""
    return texts.select(F.explode(F.array_distinct(simple_tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_size(texts: DataFrame, text: str) -> DataFrame:
    """One row: n_docs and avg_len (0 for an empty corpus)."""
    size = F.size(simple_tokens(F.col(text)))
    return texts.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_len"))


def bm25(pairs: DataFrame, df: DataFrame, size: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(pair_id, bm25): s as the query over its distinct tokens, v as the document; the idf may be negative."""
    p = pairs.select("pair_id", F.explode(F.array_distinct(simple_tokens(F.col("s")))).alias("term"))
    d = pairs.select("pair_id", simple_tokens(F.col("v")).alias("t")).select("pair_id", F.size("t").alias("len"), F.explode("t").alias("term"))
    tf = d.groupBy("pair_id", "term", "len").agg(F.count("*").alias("tf"))
    x = p.join(tf, ["pair_id", "term"]).join(df, "term", "left").crossJoin(F.broadcast(size))  # size has one row
    n, f = F.col("n_docs"), F.coalesce("df", F.lit(0))
    idf = F.when(n > 0, F.ln((n - f + 0.5) / (f + 0.5))).otherwise(0.0)
    norm = F.col("tf") + k1 * (1 - b + b * F.col("len") / F.when(F.col("avg_len") == 0, 1.0).otherwise(F.col("avg_len")))
    scored = x.groupBy("pair_id").agg(F.sum(idf * F.col("tf") * (k1 + 1) / norm).alias("bm25"))
    return pairs.select("pair_id").join(scored, "pair_id", "left").select("pair_id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"))


class Kind(NamedTuple):
    """What n-grams are made of: a text's hashed units, or a string for its code points; least and most n."""

    units: Callable[[Column], Column]
    least: int
    most: int


char_grams = Kind(lambda text: F.lower(squeeze(text)), 3, 5)
word_grams = Kind(lambda text: F.transform(F.regexp_extract_all(F.lower(blank_if_null(text)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: F.xxhash64(w)), 1, 2)
#: Pairs that look up their weights together, units handled at a time.
BLOCK, UNITS = 2048, 1 << 20


def _units(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' units one after another, and how many each has."""
    if pa.types.is_list(texts.type):
        return np.concatenate([np.zeros(0, np.int64), pc.list_flatten(texts).to_numpy(zero_copy_only=False)]).astype(np.int64).view(np.uint64), pc.list_value_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = texts.to_pylist()
    return np.frombuffer("".join(rows).encode("utf-32-le"), "<u4").astype(np.uint64) * gr.MIX, np.array([len(x) for x in rows], np.int64)


def _counts(rows: pa.RecordBatch | pa.Table, kind: Kind) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of the rows: the first row, how many; the distinct grams, sorted; key = text * number of grams + gram, sorted, and
    how often the text has it. Of m rows, text i is row i's s and text m + i its v."""
    sides = [_units(rows.column(c)) for c in ("s", "v")]
    ends = [np.concatenate([[0], np.cumsum(n)]) for _, n in sides]
    part = (ends[0] + ends[1])[1:] // UNITS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), rows.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        w = np.concatenate([x[e[a] : e[b]] for (x, _), e in zip(sides, ends)])
        text = np.repeat(np.arange(2 * (b - a)), np.concatenate([n[a:b] for _, n in sides]))
        found = [(text[at], g) for _, at, g in gr.hashes(w, text, kind.least, kind.most)] or [(np.zeros(0, np.int64),) * 2]
        grams, code = np.unique(np.concatenate([g for _, g in found]), return_inverse=True)
        yield a, b - a, grams, *np.unique(np.concatenate([t for t, _ in found]) * len(grams) + code, return_counts=True)


def _sides(pairs: DataFrame, kind: Kind) -> DataFrame:
    return pairs.select("pair_id", kind.units(F.col("s")).alias("s"), kind.units(F.col("v")).alias("v"))


def tfidf_fit(pairs: DataFrame, grams: Kind, min_df: int = 2) -> DataFrame:
    """(gram, idf) over the texts of both sides: ln((1 + n) / (1 + df)) + 1; gram is a hash. Texts are counted where they lie."""
    small_batches(pairs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, g, key, _ in _counts(batch, grams):
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.bincount(key % max(1, len(g)), minlength=len(g)))], ["gram", "n"])

    n = pairs.agg((2 * F.count("*")).alias("n"))
    df = _sides(pairs, grams).mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("df")).where(F.col("df") >= min_df)
    return df.crossJoin(F.broadcast(n)).select("gram", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_cosine(pairs: DataFrame, idf: DataFrame, grams: Kind, name: str) -> DataFrame:
    """(pair_id, name): cosine of both sides' weights; 0 if a side has none. idf: of tfidf_fit() with the same grams.

    A block of pairs asks for each of its grams once, and meets the answers in one task.
    """
    small_batches(pairs.sparkSession)
    blocks = stored(_sides(pairs, grams).withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK)))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:]):
                for _, _, g, _, _ in _counts(batch.slice(a, b - a), grams):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block[a : a + 1], len(g))), pa.array(g)], ["block", "gram"])

    def cosines(rows: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known.column("gram").to_numpy())
        gram, weight = known.column("gram").to_numpy()[order], known.column("idf").to_numpy()[order]
        out = np.zeros(rows.num_rows)
        for first, m, g, key, tf in _counts(rows, grams) if len(gram) else ():
            at = np.minimum(np.searchsorted(gram, g), len(gram) - 1)
            x = tf * np.where(gram[at] == g, weight[at], 0.0)[key % max(1, len(g))]
            text = key // max(1, len(g))
            norm = np.sqrt(np.bincount(text, x * x, minlength=2 * m))
            half = np.searchsorted(key, m * len(g))
            both, i, j = np.intersect1d(key[:half], key[half:] - m * len(g), assume_unique=True, return_indices=True)
            den = norm[:m] * norm[m:]
            out[first : first + m] = np.bincount(text[i], x[i] * x[half + j], minlength=m) / np.where(den == 0, 1e-8, den)
        return pa.table([rows.column("pair_id"), pa.array(out)], ["pair_id", name])

    weights = blocks.select("block", "s", "v").mapInArrow(asked, "block bigint, gram bigint").join(idf, "gram").select("block", "gram", "idf")
    return blocks.groupBy("block").cogroup(weights.groupBy("block")).applyInArrow(cosines, gr.fields(pairs, "pair_id", f"{name} double"))


def lexical(pairs: DataFrame, sort_ratio: bool = True) -> DataFrame:
    """pair_id and the overlap of tokens, lengths and characters of both sides."""
    p = pairs.select("pair_id", "s", "v", F.array_distinct(simple_tokens(F.col("s"))).alias("a"), F.array_distinct(simple_tokens(F.col("v"))).alias("b"))
    one = lambda x: F.greatest(F.lit(1), F.size(x))
    both = F.size(F.array_intersect("a", "b"))
    ls, lv = F.char_length("s"), F.char_length("v")
    longest = F.greatest(ls, lv)
    out = {
        "tok_jaccard": both / one(F.array_union("a", "b")),
        "tok_contain_snip_in_verse": both / one("a"),
        "tok_contain_verse_in_snip": both / one("b"),
        "len_ratio": F.when(longest == 0, 1.0).otherwise(F.least(ls, lv) / longest),
        "char_lev_norm": F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein("s", "v") / longest),
    }
    if sort_ratio:
        out["fuzz_token_sort_ratio"] = token_sort_ratio("s", "v")
    return p.select("pair_id", *(c.alias(k) for k, c in out.items()))


def vector_features(a: Column, b: Column) -> dict[str, Column]:
    """Cosine, mean absolute difference and mean product of two vectors."""
    total = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda t, x: t + x)
    d = lambda x: x.cast("double")
    norm = F.sqrt(total(lambda x, y: d(x) * d(x))) * F.sqrt(total(lambda x, y: d(y) * d(y)))
    dot = total(lambda x, y: d(x) * d(y))
    return {"sem_cos": dot / F.greatest(norm, F.lit(1e-8)), "sem_diff": total(lambda x, y: F.abs(d(x) - d(y))) / F.size(a), "sem_prod": dot / F.size(a)}


FEATURES = ("cos_char", "cos_word", "tok_jaccard", "tok_contain_snip_in_verse", "tok_contain_verse_in_snip", "len_ratio", "char_lev_norm", "fuzz_token_sort_ratio", "bm25", "sem_cos", "sem_diff", "sem_prod")
