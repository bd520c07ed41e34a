"""Quality rules: a table of thresholds compiled into one Spark projection.

Everything is computed within the row from built-in functions: no shuffle, no user function.

Edge cases. A null text counts as empty: no words, all counts 0, base_failed. Repeated rows and
ties are judged row by row. An empty table gives an empty result. Other columns of the input are
ignored by ``measure`` and kept by ``keep_good``, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, let, table

#: Function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with is in it for on a as are was by this from or an at "
    "le la les de et des du un une que en au aux dans par pour sur qui "
    "der die das und ist nicht ein eine mit von zu auf für im den dem als sich "
    "el los las y por con se su para al lo es no"
).split()

#: (measure, smallest allowed, largest allowed); None: no bound. A document is kept if all hold.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 2.0, 20.0),
    ("symbol_ratio", None, 0.25),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("shout_ratio", None, 0.5),
    ("ellipsis_line_ratio", None, 0.5),
)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows that are found twice or more, from the windows' hashes in order.

    Windows are sorted with their positions; equal neighbours are repeats. A repeated window at p
    covers p..p+2, so in order of position each adds the smaller of 3 and the step from the last.
    """
    indexed = F.sort_array(F.zip_with(hashes, F.sequence(F.lit(0), F.size(hashes) - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        n = F.size(s) - 1
        pairs = F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
        return F.sort_array(F.array_distinct(F.flatten(pairs)))

    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(let(indexed, places), start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered)


def measure(docs: DataFrame) -> DataFrame:
    """One row per document: counts, ratios, base_failed and the verdict of RULES as kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"), F.split("text", "\n").alias("lines"))
    n = F.size("w")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    full = F.filter("lines", lambda x: x.rlike(WORD))
    d = d.select("doc_id", "text", "w", windows.alias("g"), full.alias("full"))
    stop = F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))
    shout = F.filter("w", lambda x: x.rlike(r"[!?]{2,}$"))
    counts = {
        "n_words": n,
        "word_chars": F.char_length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]")),
        "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size("full") - F.size(F.array_distinct("full")),
        "n_repeat_words": F.when(F.size("g") > 0, _repeat_words(F.col("g"))).otherwise(F.lit(0)),
        "n_lines": F.size("full"),
        "n_stop_words": F.size(stop),
        "n_shouts": F.size(shout),
        "n_ellipsis_lines": F.size(F.filter("full", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
    }
    d = d.select("doc_id", *(c.cast("long").alias(k) for k, c in counts.items()))
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    ratios = {
        "mean_word_chars": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "stop_word_ratio": F.col("n_stop_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "shout_ratio": F.col("n_shouts") / words,
        "ellipsis_line_ratio": F.col("n_ellipsis_lines") / lines,
    }
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    d = d.select("*", *(c.alias(k) for k, c in ratios.items()), failed.alias("base_failed"))
    good = F.lit(True)
    for name, low, high in RULES:
        good = good & (F.col(name) >= low if low is not None else F.lit(True)) & (F.col(name) <= high if high is not None else F.lit(True))
    return d.withColumn("kept", ~F.col("base_failed") & good)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that measure() keeps, with all their columns."""
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("__row")
    judged = measure(docs.select(row, F.col("text")).select(F.col("__row").alias("doc_id"), "text"))
    # A filter right on the verdict would be pushed below the projections, each use of a measure written out anew;
    # a generator of one row stops it.
    return judged.select("doc_id", F.explode(F.array("kept")).alias("kept")).where("kept").select("doc_id.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    return measure(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS f FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM t WHERE len(w) >= 3),
h AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM g),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM h),
p AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS q FROM k WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS BIGINT) AS word_chars,
         CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(f) - len(list_distinct(f)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
         len(f) AS n_lines, len(list_filter(w, lambda y: lower(y) IN ({stop}))) AS n_stop,
         len(list_filter(w, lambda y: regexp_matches(y, '[!?]{{2,}}$'))) AS n_shout,
         len(list_filter(f, lambda y: regexp_matches(y, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_dots
  FROM t LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2.0 AND 20.0 AND n_symbols / greatest(n_words, 1) <= 0.25
  AND n_stop / greatest(n_words, 1) >= 0.02 AND n_dup_lines / greatest(n_lines, 1) <= 0.5
  AND n_shout / greatest(n_words, 1) <= 0.5 AND n_dots / greatest(n_lines, 1) <= 0.5 AS kept
FROM b"""


ORACLE_SQL = _sql()
