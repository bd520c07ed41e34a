"""What Spark has no built-in for, as Arrow-batched functions."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Character references of HTML5, once."""
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) and "&" in x else x)


@F.pandas_udf(T.StringType())
def unescape_nfkc(s: pd.Series) -> pd.Series:
    """Character references, then Unicode NFKC."""
    return s.map(lambda x: x if not isinstance(x, str) or (x.isascii() and "&" not in x) else unicodedata.normalize("NFKC", html.unescape(x)))


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence; a bit for each place of b."""
    places: dict = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    free = full
    for x in a:
        hit = free & places.get(x, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(b) - free.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_words(a: pd.Series, b: pd.Series) -> pd.Series:
    """Common subsequence of the words of two texts."""
    return pd.Series([lcs_length((x or "").split(), (y or "").split()) for x, y in zip(a, b)], dtype="int32")


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 LCS / (len a + len b) over the characters of both texts' sorted words; 1 if both are empty."""

    def ratio(x: str, y: str) -> float:
        x, y = (" ".join(sorted((t or "").split())) for t in (x, y))
        return 2 * lcs_length(x, y) / (len(x) + len(y)) if x or y else 1.0

    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def register(spark) -> None:
    """Make the functions available to SQL."""
    for name, f in {"html_unescape": unescape, "unescape_nfkc": unescape_nfkc, "lcs_words": lcs_words, "token_sort_ratio": token_sort_ratio}.items():
        spark.udf.register(name, f)
