"""A classifier of text pairs: twelve features and gradient-boosted trees."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_pair_text, simple_tokens
from . import pair_features as pf
from . import sampling
from .storing import kept


def hashed_vector(text: Column, size: int = 32) -> Column:
    """A deterministic stand-in for a sentence encoder: counts of hashed tokens."""
    places = F.transform(simple_tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(size)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("float"))


def training_pairs(rows: DataFrame) -> DataFrame:
    """snippet_norm, verse_norm, match from rows with match, most_unusual_phrase or snippet, and verse or verse_text."""
    from ..sources.tables import column, first_of

    s, v = first_of(rows, ["most_unusual_phrase", "snippet"]), first_of(rows, ["verse", "verse_text"])
    first_of(rows, ["match"])
    out = rows.select(normalize_pair_text(column(rows, s)).alias("snippet_norm"), normalize_pair_text(column(rows, v)).alias("verse_norm"), F.coalesce(F.col("match"), F.lit(0)).cast("int").alias("match"))
    return out.where("snippet_norm <> '' and verse_norm <> ''")


class TextPairClassifier:
    """fit on snippet_norm, verse_norm, match; then predict adds match_proba.

    Corpus statistics are fitted on all balanced training pairs, before the validation split.
    encode: a function from a text column to a vector column.
    """

    def __init__(self, rounds: int = 50, seed: int = 42, encode: Callable[[Column], Column] = hashed_vector):
        self.rounds, self.seed, self.encode, self.model = rounds, seed, encode, None

    @staticmethod
    def _with_ids(rows: DataFrame) -> DataFrame:
        """rows with pair_id; numbers that Spark deals out are kept before anything is joined by them."""
        return rows if "pair_id" in rows.columns else kept(rows.withColumn("pair_id", F.monotonically_increasing_id()))

    def _pairs(self, rows: DataFrame) -> DataFrame:
        return rows.select("pair_id", F.coalesce("snippet_norm", F.lit("")).alias("s"), F.coalesce("verse_norm", F.lit("")).alias("v"))

    def features(self, rows: DataFrame) -> DataFrame:
        """rows (with pair_id) and the twelve features as one vector column."""
        p = self._pairs(rows)
        parts = [
            pf.tfidf_cosine(p, self.idf_char, pf.char_grams, "cos_char"), pf.tfidf_cosine(p, self.idf_word, pf.word_grams, "cos_word"), pf.lexical(p), pf.bm25(p, self.df, self.size),
            p.select("pair_id", *(c.alias(k) for k, c in pf.vector_features(self.encode(F.col("s")), self.encode(F.col("v"))).items())),
        ]
        x = reduce(lambda a, b: a.join(b, "pair_id"), parts, rows)
        return VectorAssembler(inputCols=list(pf.FEATURES), outputCol="features").transform(x)

    def fit(self, rows: DataFrame) -> TextPairClassifier:
        rows = kept(sampling.balance(self._with_ids(rows), "match", "pair_id", seed=self.seed))
        p = self._pairs(rows)
        self.idf_char, self.idf_word = kept(pf.tfidf_fit(p, pf.char_grams)), kept(pf.tfidf_fit(p, pf.word_grams))
        self.df, self.size = kept(pf.term_documents(p, "v")), kept(pf.corpus_size(p, "v"))
        x = kept(sampling.split(self.features(rows), "match", "pair_id", seed=self.seed))
        gbt = GBTClassifier(labelCol="match", maxIter=self.rounds, stepSize=0.05, maxDepth=6, minInstancesPerNode=20, subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=self.seed)
        self.model = gbt.fit(x.where("not is_test"))
        judged = kept(self._score(x.where("is_test")))
        self.validation = sampling.scores(judged, "match", "match_proba")
        self.ranking = sampling.ranking_scores(judged, "match", "match_proba")
        return self

    def _score(self, features: DataFrame) -> DataFrame:
        return self.model.transform(features).withColumn("match_proba", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction", *pf.FEATURES)

    def predict(self, rows: DataFrame, threshold: float = 0.01) -> DataFrame:
        """rows with match_proba and match_label."""
        if self.model is None:
            raise RuntimeError("fit the model first")
        rows = self._with_ids(rows)
        return self._score(self.features(rows)).withColumn("match_label", (F.col("match_proba") >= threshold).cast("int"))
