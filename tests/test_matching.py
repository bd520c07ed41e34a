import pytest
from pyspark.sql import functions as F

from echotrace.operators import sampling, spans, windows
from echotrace.operators.classifier import TextPairClassifier
from echotrace.plans import matching
from echotrace.sources import pages, tables


@pytest.mark.parametrize(("n", "length", "stride", "out"), [(0, 30, 5, []), (7, 30, 5, [(0, 7)]), (12, 5, 5, [(0, 5), (5, 10), (10, 12)]), (4, 2, 5, [(0, 2)]), (7, 2, 5, [(0, 2), (5, 7)]), (4, 0, 5, [])])
def test_windows(spark, n, length, stride, out):
    docs = spark.createDataFrame([("d", " ".join(map(str, range(n))))], "doc_id string, text_norm string")
    assert sorted((r.start_token, r.end_token) for r in windows.make_windows(docs, length, stride).collect()) == out


@pytest.mark.parametrize(("second", "out"), [((5, 35), [(0, 35)]), ((38, 68), [(0, 68)]), ((39, 69), [(0, 30), (39, 69)])])
def test_span_merge(spark, second, out):
    hits = spark.createDataFrame([("d", "v", 0, 30, 0.5), ("d", "v", *second, 0.7)], "doc_id string, verse_id string, start_token int, end_token int, score double")
    assert sorted((r.start_token, r.end_token) for r in spans.merge_spans(hits).collect()) == out


def test_match_end_to_end(spark):
    verse = "in the beginning was the word and the word was with all of us here"
    docs = matching.index_documents(spark.createDataFrame([("1", "t", "p", "2020-01-02", f"so he said {verse} and then left"), ("2", "t", "p", "bad", None)], "doc_id string, title string, president string, date_iso string, transcript_norm string"))
    verses = matching.index_passages(spark.createDataFrame([("John", 1, 1, "John 1:1", verse)], "Book string, chapter int, verse int, ref string, text string"))
    got = matching.match(docs, verses).collect()
    assert [(r.doc_id, r.ref, r.cov_ngram, r.lcs_ratio, r.rank_in_doc) for r in got] == [("1", "John 1:1", 1.0, 1.0, 1)]
    assert matching.match(docs.where("doc_id = '2'"), verses).collect() == []


def test_balance(spark):
    rows = spark.createDataFrame([(i, int(i < 10)) for i in range(110)], "id int, match int")
    assert sorted(r["count"] for r in sampling.balance(rows, "match", "id").groupBy("match").count().collect()) == [10, 40]
    assert sampling.balance(rows.where("match = 0"), "match", "id").count() == 100


def test_null_and_nan_last(spark):
    rows = spark.createDataFrame([("a", "v", float("nan")), ("b", "v", None), ("c", "v", 0.2), ("d", "v", 0.9)], "doc_id string, verse_id string, match_proba double")
    assert [r.doc_id for r in spans.by_probability(rows).collect()] == ["d", "c", "a", "b"]


def test_classifier(spark):
    rows = spark.createDataFrame([(f"the word number {i} is here", f"the word number {i if i % 2 else i + 50} is {'here' if i % 2 else 'gone now'}", i % 2) for i in range(80)], "snippet_norm string, verse_norm string, match int")
    model = TextPairClassifier(rounds=3).fit(rows)
    got = model.predict(rows).agg(F.avg(F.when(F.col("match") == 1, F.col("match_proba"))), F.avg(F.when(F.col("match") == 0, F.col("match_proba")))).first()
    assert got[0] > got[1]
    with pytest.raises(RuntimeError):
        TextPairClassifier().predict(rows)


def test_page_fields():
    html = "<h3><a href='/people/x'>A B</a></h3><h1> T\n1 </h1><span>March 4, 1861</span><h3>Location:</h3><h4>Location</h4><div>Paris</div><a href='/node/12'>n</a><main><p>one two</p><p> </p><p>three</p><b>Watch Video</b></main>"
    got = pages.parse_page(html)
    assert got == {"title": "T 1", "date_text": "March 4, 1861", "president": "A B", "location": "Paris", "node_id": "12", "word_count": 3, "has_video_flag": True, "transcript": "one two\n\nthree"}
    assert pages.parse_page(None)["transcript"] is None
    listing = "<main><a href='/documents/a'>a</a><a href='/x'>x</a><a href='/documents/a'>a</a></main><ul class='pagination'><a>next ›</a></ul>"
    assert pages.document_links(listing, "https://e.org") == ["https://e.org/documents/a"] and pages.has_next(listing)


def test_http_retries():
    calls = []

    def fetch(url):
        calls.append(url)
        raise OSError

    with pytest.raises(RuntimeError):
        pages.http_get("u", pause=lambda s: None, fetch=fetch)
    assert len(calls) == 5


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'x "y", z\n\nw \\ v'), ("b", "NA")], "k string, t string")
    tables.write_both(rows, str(tmp_path / "r"))
    back = {r.k: r.t for r in tables.read_table(spark, str(tmp_path / "r.csv")).collect()}
    assert back == {"a": 'x "y", z\n\nw \\ v', "b": None}
    assert tables.mirrored_base("data/x/rows.csv") == "cleaned_data/x/rows_norm"
    with pytest.raises(ValueError):
        tables.require_columns(rows, ["nope"])
    with pytest.raises(FileNotFoundError):
        tables.require_path(spark, str(tmp_path / "none"))
