"""Named queries over the driver's tables, and their SQL.

documents stand for speeches, benchmark for reference passages, neighbouring turns of a conversation for
pairs of texts, and labels for labelled rows. Each query runs over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import pair_features as pf
from ..operators import retrieval, sampling, spans, windows
from ..operators.storing import stored
from ..sources import pages as pg
from . import matching

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("node_id"), F.col("source").alias("title"), F.col("lang").alias("president"), F.lit(None).cast("string").alias("date_iso"), F.lit("").alias("url"), F.col("text").alias("transcript"))
    return matching.index_documents(matching.normalize_rows(rows))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    b = _table(spark, d, "benchmark")
    return matching.index_passages(b.select(F.lit("book").alias("book"), F.lit(1).alias("chapter"), F.col("item_id").cast("int").alias("verse"), F.concat(F.lit("book 1:"), F.col("item_id")).alias("ref"), "text"))


def _pairs(spark: SparkSession, d: str, ascii: bool = False) -> DataFrame:
    """Neighbouring turns in the classifier's form; ascii: with everything beyond ASCII as a question mark."""
    text = tx.normalize_pair_text(F.col("text"))
    c = _table(spark, d, "conversations").select("conv_id", "turn", (F.regexp_replace(text, "[^ -~]", "?") if ascii else text).alias("x"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("v"))
    return c.join(nxt, ["conv_id", "turn"]).select(F.concat_ws(":", "conv_id", "turn").alias("pair_id"), F.col("x").alias("s"), "v")


_W = r"""d AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, list_filter(list_transform(string_split(lower(trim(regexp_replace(
    translate(coalesce(text, ''), '“”„‟’‘‚‛—–−', repeat(chr(34), 4) || repeat(chr(39), 4) || '---'), '\s+', ' ', 'g'))), ' '),
    lambda w: regexp_replace(w, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g')), lambda w: w <> '') AS w FROM documents),
v AS (
  SELECT substr(md5('KJV||book 1:' || item_id), 1, 16) AS verse_id, 'book 1:' || item_id AS ref,
    array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_](?:[\p{L}\p{N}_''-]*[\p{L}\p{N}_])?'), ' ') AS t FROM benchmark),
win AS (
  SELECT doc_id || '_' || a || '_' || least(a + 30, n) AS window_id, doc_id, a AS start_token, least(a + 30, n) AS end_token, array_to_string(w[a + 1:least(a + 30, n)], ' ') AS t
  FROM (SELECT doc_id, w, len(w) AS n, unnest(range(0, CAST(greatest(0, ceil((len(w) - 30) / 5)) AS BIGINT) * 5 + 1, 5)) AS a FROM d WHERE len(w) > 0) WHERE a < n)"""
_C = _W + r""",
txt AS (SELECT 'w' AS side, window_id AS id, t FROM win UNION ALL SELECT 'v', verse_id, t FROM v),
tok AS (SELECT side, id, regexp_extract_all(t, '[\p{L}\p{N}_](?:[\p{L}\p{N}_''-]*[\p{L}\p{N}_])?') AS k FROM txt),
g AS (SELECT side, id, array_to_string(k[i:i + n - 1], ' ') AS gram FROM (SELECT side, id, k, n, unnest(range(1, len(k) - n + 2)) AS i FROM tok, (SELECT unnest([3, 4, 5]) AS n))),
tf AS (SELECT side, id, gram, count(*) AS tf FROM g GROUP BY ALL),
df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram),
x AS (SELECT side, id, gram, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM txt)) / (1 + df)) + 1) AS x FROM tf JOIN df USING (gram)),
nx AS (SELECT side, id, sqrt(sum(x * x)) AS n FROM x GROUP BY ALL),
s AS (SELECT a.id AS window_id, b.id AS verse_id, sum(a.x * b.x) / any_value(p.n) / any_value(q.n) AS score FROM x a JOIN x b ON a.gram = b.gram AND a.side = 'w' AND b.side = 'v'
  JOIN nx p ON p.id = a.id AND p.side = 'w' JOIN nx q ON q.id = b.id AND q.side = 'v' GROUP BY ALL),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY score DESC, verse_id) AS rank FROM s) WHERE rank <= 10)"""
_S = _C + """,
h AS (SELECT doc_id, verse_id, start_token, end_token, score, max(end_token) OVER (PARTITION BY doc_id, verse_id ORDER BY start_token, end_token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM c JOIN win USING (window_id)),
i AS (SELECT *, sum(CASE WHEN r IS NULL OR start_token > r + 8 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, verse_id ORDER BY start_token, end_token ROWS UNBOUNDED PRECEDING) AS k FROM h),
sp AS (SELECT doc_id, verse_id, CAST(min(start_token) AS BIGINT) AS start_token, CAST(max(end_token) AS BIGINT) AS end_token, max(score) AS score_max FROM i GROUP BY doc_id, verse_id, k)"""


@query(f"WITH {_W} SELECT doc_id, CAST(len(w) AS BIGINT) AS token_count, md5(array_to_string(w, ' ')) AS norm_md5 FROM d")
def documents_index(spark, d):
    return _docs(spark, d).select("doc_id", F.col("token_count").cast("long"), F.md5(F.col("text_norm").cast("binary")).alias("norm_md5"))


@query(f"WITH {_W} SELECT verse_id, ref, md5(t) AS norm_md5, CAST(len(list_filter(string_split(t, ' '), lambda x: x <> '')) AS BIGINT) AS token_count FROM v")
def passages_index(spark, d):
    return _passages(spark, d).select("verse_id", "ref", F.md5(F.col("text_norm").cast("binary")).alias("norm_md5"), F.col("token_count").cast("long"))


@query(f"WITH {_W} SELECT window_id, start_token, end_token, end_token - start_token AS window_len, md5(t) AS snippet_md5 FROM win")
def token_windows(spark, d):
    w = windows.make_windows(_docs(spark, d).select("doc_id", "text_norm"))
    return w.select("window_id", *(F.col(c).cast("long") for c in ("start_token", "end_token", "window_len")), F.md5(F.col("snippet_norm").cast("binary")).alias("snippet_md5"))


@query(f"WITH {_C} SELECT window_id, verse_id, ref, round(score, 6) AS score, rank FROM c JOIN v USING (verse_id)")
def retrieval_candidates(spark, d):
    c = retrieval.candidates(_docs(spark, d).select("doc_id", "text_norm"), _passages(spark, d))
    return c.select("window_id", "verse_id", "ref", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query(f"WITH {_S} SELECT doc_id, verse_id, start_token, end_token, round(score_max, 6) AS score_max FROM sp")
def merged_spans(spark, d):
    m = spans.merge_spans(retrieval.candidates(_docs(spark, d).select("doc_id", "text_norm"), _passages(spark, d)))
    return m.select("doc_id", "verse_id", F.col("start_token").cast("long"), F.col("end_token").cast("long"), F.round("score_max", 6).alias("score_max"))


_Q = _S + """,
f AS (SELECT sp.*, d.w[start_token + 1:end_token] AS sw, string_split(v.t, ' ') AS vw, v.ref FROM sp JOIN d USING (doc_id) JOIN v USING (verse_id)),
fg AS (SELECT *, list_distinct(flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, len(sw) - n + 2), lambda i: array_to_string(sw[i:i + n - 1], ' '))))) AS sg,
  list_distinct(flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, len(vw) - n + 2), lambda i: array_to_string(vw[i:i + n - 1], ' '))))) AS vg FROM f),
cv AS (SELECT *, len(list_intersect(sg, vg)) / greatest(1, len(vg)) AS cov_ngram FROM fg),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, verse_id ORDER BY score_max DESC, start_token) AS one FROM cv WHERE cov_ngram >= 0.55) WHERE one = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score_max DESC, verse_id) AS rank_in_doc FROM b)"""


@query(f"WITH {_Q} SELECT doc_id, verse_id, ref, start_token, end_token, round(score_max, 6) AS score_max, round(cov_ngram, 6) AS cov_ngram, md5(array_to_string(sw, ' ')) AS snippet_md5, rank_in_doc FROM rk WHERE rank_in_doc <= 10")
def covered_quotations(spark, d):
    """Quotations kept by coverage alone: the best span of each document and passage, and the ten best of each document."""
    docs, passages = stored(_docs(spark, d)), _passages(spark, d)
    s = spans.add_features(spans.merge_spans(retrieval.candidates(docs, passages)), docs, passages)
    ranked = spans.rank_in_document(spans.best_per_passage(spans.keep_aligned(s, min_lcs=2.0))).where("rank_in_doc <= 10")
    return ranked.select("doc_id", "verse_id", "ref", F.col("start_token").cast("long"), F.col("end_token").cast("long"), F.round("score_max", 6).alias("score_max"), F.round("cov_ngram", 6).alias("cov_ngram"), F.md5(F.col("snippet_norm").cast("binary")).alias("snippet_md5"), F.col("rank_in_doc").cast("long"))


@query()
def quotations(spark, d):
    """Flagship: documents' best quotations with places and strength."""
    return spans.preview(matching.match(_docs(spark, d), _passages(spark, d)))


@query(r"""WITH t AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+') AS t FROM documents)
SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM t) GROUP BY term""")
def term_documents(spark, d):
    return pf.term_documents(_table(spark, d, "documents"), "text")


@query(r"SELECT count(*) AS n_docs, round(avg(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+'))), 6) AS avg_len FROM documents")
def corpus_size(spark, d):
    return pf.corpus_size(_table(spark, d, "documents"), "text").select("n_docs", F.round("avg_len", 6).alias("avg_len"))


_P = r"""c AS (SELECT conv_id, turn, trim(regexp_replace(translate(lower(coalesce(text, '')), '“”‘’', repeat(chr(34), 2) || repeat(chr(39), 2)), '\s+', ' ', 'g')) AS x FROM conversations),
p AS (SELECT a.conv_id || ':' || a.turn AS pair_id, a.x AS s, b.x AS v FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
q AS (SELECT *, regexp_extract_all(s, '[a-z0-9'']+') AS a, regexp_extract_all(v, '[a-z0-9'']+') AS b FROM p)"""


#: DuckDB's levenshtein counts bytes, so the edit distance is compared on ASCII; all other pair features on the texts as they are.
_PA = _P.replace("AS x FROM conversations", "AS x0 FROM conversations").replace("p AS (SELECT a.conv_id", "ca AS (SELECT conv_id, turn, regexp_replace(x0, '[^ -~]', '?', 'g') AS x FROM c),\np AS (SELECT a.conv_id").replace("FROM c a JOIN c b", "FROM ca a JOIN ca b")


@query(rf"""WITH {_PA}, r AS (SELECT *, len(list_intersect(list_distinct(a), list_distinct(b))) AS n, greatest(length(s), length(v)) AS m FROM q)
SELECT pair_id, round(n / greatest(1, len(list_distinct(list_concat(a, b)))), 6) AS tok_jaccard, round(n / greatest(1, len(list_distinct(a))), 6) AS tok_contain_snip_in_verse,
  round(n / greatest(1, len(list_distinct(b))), 6) AS tok_contain_verse_in_snip, round(CASE WHEN m = 0 THEN 1.0 ELSE least(length(s), length(v)) / m END, 6) AS len_ratio,
  round(CASE WHEN m = 0 THEN 1.0 ELSE 1 - levenshtein(s, v) / m END, 6) AS char_lev_norm FROM r""")
def lexical_pairs(spark, d):
    x = pf.lexical(_pairs(spark, d, ascii=True), sort_ratio=False)
    return x.select("pair_id", *(F.round(c, 6).alias(c) for c in x.columns[1:]))


@query(rf"""WITH {_P}, n AS (SELECT count(*) AS n, avg(len(b)) AS l FROM q), df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(b)) AS term FROM q) GROUP BY term),
t AS (SELECT pair_id, term, len, count(*) AS tf FROM (SELECT pair_id, len(b) AS len, unnest(b) AS term FROM q) GROUP BY ALL),
m AS (SELECT pair_id, sum(ln((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / l))) AS x
  FROM (SELECT pair_id, unnest(list_distinct(a)) AS term FROM q) JOIN t USING (pair_id, term) JOIN df USING (term), n GROUP BY pair_id)
SELECT pair_id, round(coalesce(x, 0.0), 6) AS bm25 FROM p LEFT JOIN m USING (pair_id)""")
def bm25_pairs(spark, d):
    p = _pairs(spark, d)
    return pf.bm25(p, pf.term_documents(p, "v"), pf.corpus_size(p, "v")).select("pair_id", F.round("bm25", 6).alias("bm25"))


_TF = """, u AS (SELECT pair_id, side, gram, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM u GROUP BY gram HAVING count(*) >= 2),
x AS (SELECT pair_id, side, gram, tf * (ln((1 + 2 * (SELECT count(*) FROM p)) / (1 + df)) + 1) AS x FROM u JOIN df USING (gram)),
n AS (SELECT pair_id, sqrt(coalesce(sum(x * x) FILTER (WHERE side = 's'), 0)) * sqrt(coalesce(sum(x * x) FILTER (WHERE side = 'v'), 0)) AS d FROM x GROUP BY pair_id),
m AS (SELECT a.pair_id, sum(a.x * b.x) AS y FROM x a JOIN x b ON a.pair_id = b.pair_id AND a.gram = b.gram AND a.side = 's' AND b.side = 'v' GROUP BY a.pair_id)
SELECT pair_id, round(coalesce(y / CASE WHEN d = 0 THEN 1e-8 ELSE d END, 0.0), 6) AS {name} FROM p LEFT JOIN m USING (pair_id) LEFT JOIN n USING (pair_id)"""
_SIDES = "sides AS (SELECT pair_id, 's' AS side, s AS t FROM p UNION ALL SELECT pair_id, 'v', v FROM p)"


@query(rf"""WITH {_P}, {_SIDES}, k AS (SELECT pair_id, side, regexp_extract_all(t, '[\p{{L}}\p{{N}}_]{{2,}}') AS k FROM sides),
g AS (SELECT pair_id, side, array_to_string(k[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(k) - n + 2)) AS i FROM k, (SELECT unnest([1, 2]) AS n))) {_TF.format(name='cos_word')}""")
def tfidf_word_pairs(spark, d):
    p = _pairs(spark, d)
    return pf.tfidf_cosine(p, pf.tfidf_fit(p, pf.word_grams), pf.word_grams, "cos_word").select("pair_id", F.round("cos_word", 6).alias("cos_word"))


@query(rf"""WITH {_P}, {_SIDES}, g AS (SELECT pair_id, side, substr(t, i, n) AS gram FROM (SELECT *, unnest(range(1, length(t) - n + 2)) AS i FROM sides, (SELECT unnest([3, 4, 5]) AS n))) {_TF.format(name='cos_char')}""")
def tfidf_char_pairs(spark, d):
    p = _pairs(spark, d)
    return pf.tfidf_cosine(p, pf.tfidf_fit(p, pf.char_grams), pf.char_grams, "cos_char").select("pair_id", F.round("cos_char", 6).alias("cos_char"))


@query()
def sort_ratio_pairs(spark, d):
    return pf.lexical(_pairs(spark, d)).select("pair_id", "fuzz_token_sort_ratio")


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), p AS (SELECT a.vec_id, a.x, b.x AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_inner_product(x, y) / greatest(sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y)), 1e-8), 5) + 0.0 AS sem_cos,
  round(list_sum(list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - y[i]))) / len(x), 5) AS sem_diff, round(list_inner_product(x, y) / len(x), 5) + 0.0 AS sem_prod FROM p""")
def embedding_pairs(spark, d):
    e = _table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    f = pf.vector_features(F.col("embedding"), F.col("y"))
    return e.join(nxt, "vec_id").select("vec_id", *((F.round(c, 5) + 0.0).alias(k) for k, c in f.items()))


_ORD = "md5('42:' || doc_id)"


@query(f"""WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {_ORD}, doc_id) AS n, (SELECT count(*) FROM labels WHERE toxic = 1) AS pos FROM labels)
SELECT doc_id, toxic FROM r WHERE toxic = 1 OR pos = 0 OR n <= 4 * pos""")
def balanced_sample(spark, d):
    return sampling.balance(_table(spark, d, "labels"), "toxic", "doc_id").select("doc_id", "toxic")


@query(f"SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {_ORD}, doc_id) <= round(count(*) OVER (PARTITION BY toxic) * 0.2) AS is_test FROM labels")
def stratified_split(spark, d):
    return sampling.split(_table(spark, d, "labels"), "toxic", "doc_id").select("doc_id", "toxic", "is_test")


@query("""WITH s AS (SELECT count(*) FILTER (WHERE quality >= 0.01 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality >= 0.01 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality < 0.01 AND toxic = 1) AS fn, count(*) FILTER (WHERE quality >= 0.01) AS positives FROM labels)
SELECT round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, positives FROM s""")
def threshold_scores(spark, d):
    s = sampling.scores(_table(spark, d, "labels"), "toxic", "quality")
    return s.select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "positives")


@query("""WITH s AS (SELECT l_extendedprice AS p, count(*) FILTER (WHERE l_returnflag = 'R') AS pos, count(*) FILTER (WHERE l_returnflag <> 'R') AS neg FROM lineitem GROUP BY 1),
t AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM s)
SELECT round(sum(neg * (tp - pos / 2)) / sum(pos) / sum(neg), 6) AS auc, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision FROM t""")
def ranking_scores(spark, d):
    rows = _table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), "l_extendedprice")
    return sampling.ranking_scores(rows, "y", "l_extendedprice").select(F.round("auc", 6).alias("auc"), F.round("average_precision", 6).alias("average_precision"))


@query("""SELECT count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS p25,
  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS max FROM events""")
def describe_values(spark, d):
    s = sampling.describe(_table(spark, d, "events"), "value")
    return s.select("count", *(F.round(c, 6).alias(c) for c in s.columns[1:]))


@query(r"""SELECT conv_id, turn, md5(trim(regexp_replace(translate(lower(coalesce(text, '')), '“”‘’', repeat(chr(34), 2) || repeat(chr(39), 2)), '\s+', ' ', 'g'))) AS norm_md5 FROM conversations""")
def pair_text_normal(spark, d):
    return _table(spark, d, "conversations").select("conv_id", "turn", F.md5(tx.normalize_pair_text(F.col("text")).cast("binary")).alias("norm_md5"))


@query(r"SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE url LIKE 'http:%')")
def unseen_urls(spark, d):
    p = _table(spark, d, "pages")
    return pg.unseen(p.select("page_id", "url"), p.where("url like 'http:%'").select(F.col("url").alias("value")))


@query("SELECT doc_id, CASE WHEN starts_with(source, 'http') THEN source ELSE 'https://example.org/categories/' || trim(source, '/ ') END AS url FROM documents")
def category_urls(spark, d):
    return _table(spark, d, "documents").select("doc_id", tx.category_url(F.col("source"), "https://example.org", "/categories/").alias("url"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date_iso FROM orders")
def guessed_dates(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", tx.guess_date(F.date_format("o_orderdate", "MMMM d, yyyy")).alias("date_iso"))


@query()
def page_rows(spark, d):
    return pg.parse_pages(_table(spark, d, "pages"))
