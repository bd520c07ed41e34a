"""The command line from end to end, the listing source and the streams."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from echotrace import cli
from echotrace.sources import listing
from echotrace.streaming import ingest

VERSE = "in the beginning was the word and the word was with all of us here"
PAGE = "<h1>Title {n}</h1><h3>A B</h3><time>March {n}, 1861</time><main><p>So he said: {verse}.</p><p>{more}</p></main>"


class Site(BaseHTTPRequestHandler):
    def do_GET(self):
        if "page=" in self.path:
            n = int(self.path.rpartition("=")[2])
            body = f"<main><a href='/documents/{2 * n}'>x</a><a href='/documents/{2 * n + 1}'>x</a></main>" + ("<ul class='pagination'><a>next</a></ul>" if n < 1 else "")
        else:
            n = int(self.path.rpartition("/")[2])
            body = PAGE.format(n=n + 1, verse=VERSE, more="more words " * (20 if n else 0))
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_scrape_to_matches(spark, site, tmp_path):
    d = str(tmp_path)
    run = lambda line: cli.main(line.split(), spark)
    for _ in range(2):  # the second run finds every page seen
        run(f"scrape --slug {site}/c --out-dir {d} --pause 0 --require-transcript")
        assert spark.read.parquet(f"{d}/rows.parquet").count() == 3
    assert spark.read.text(f"{d}/seen_urls").where("value <> ''").count() == 4
    run(f"normalize --input {d}/rows.csv --out {d}/norm --flatten-transcript")
    spark.createDataFrame([("John", 1, 1, "John 1:1", VERSE)], "book string, chapter int, verse int, ref string, text string").write.csv(f"{d}/b.csv", header=True)
    run(f"index-bible --bible_in {d}/b.csv --out_dir {d}")
    run(f"index-speeches --speeches_in {d}/norm.parquet --out_dir {d}")
    run(f"gen-candidates --bible_index {d}/verses_index.parquet --windows {d}/windows.parquet --out_dir {d}")
    run(f"merge-spans --out_dir {d}")
    steps = spark.read.parquet(f"{d}/matches.parquet").drop("score_max").collect()
    assert len(steps) == 3 and {r.lcs_ratio for r in steps} == {1.0}
    run(f"match --bible_index {d}/verses_index.parquet --speeches_index {d}/speeches_index.parquet --out_dir {d}/one")
    assert sorted(spark.read.parquet(f"{d}/one/matches.parquet").drop("score_max").collect()) == sorted(steps)
    rows = [(i % 2, f"the word number {i} is here", f"the word number {i if i % 2 else i + 50} is here") for i in range(60)]
    spark.createDataFrame(rows, "match int, snippet string, verse string").coalesce(1).write.csv(f"{d}/t.csv", header=True)
    run(f"classify --train-csv {d}/t.csv --matches-path {d}/matches.parquet --output-path {d}/scored.parquet --rounds 2")
    run(f"sort-scored --input {d}/scored.parquet --out {d}/sorted")
    assert {"match_proba", "match_label", "verse_norm"} <= set(spark.read.parquet(f"{d}/sorted.parquet").columns)


def test_missing_input(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        cli.main(["normalize", "--input", f"{tmp_path}/none.csv"], spark)


def test_fetch_reports_failures(spark):
    def get(url):
        if url == "bad":
            raise RuntimeError("no answer")
        return "x"

    got = listing.fetch_documents(spark.createDataFrame([("bad",), ("good",)], "url string"), 0, get).collect()
    assert {(r.url, r.html, r.error) for r in got} == {("bad", None, "no answer"), ("good", "x", None)}


def test_listing_stream(spark, site, tmp_path):
    listing.register(spark)
    assert spark.read.format("listing").option("category", f"{site}/c").option("max_pages", 1).load().count() == 1
    stream = spark.readStream.format("listing").option("category", f"{site}/c").load()
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").start(f"{tmp_path}/out")
    for _ in range(3):
        q.processAllAvailable()
    q.stop()
    assert sorted(r.page for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1]


def test_streams(spark, tmp_path):
    d = str(tmp_path)
    rows = [(f"t{i}", "2020-01-02", f"u{i % 3}", f"and {VERSE} then") for i in range(4)]
    spark.createDataFrame(rows, "title string, date_iso string, url string, transcript string").coalesce(1).write.parquet(f"{d}/in")
    once = ingest.first_of_each_url(ingest.read_rows(spark, f"{d}/in"))
    ingest.write_index(once, f"{d}/index", f"{d}/c1").awaitTermination()
    index = spark.read.parquet(f"{d}/index")
    assert index.count() == 3 and index.where("text_norm like 'and in the beginning%'").count() == 3
    from echotrace.plans import matching

    verses = matching.index_passages(spark.createDataFrame([("John", 1, 1, "John 1:1", VERSE)], "book string, chapter int, verse int, ref string, text string"))
    ingest.write_matches(ingest.first_of_each_url(ingest.read_rows(spark, f"{d}/in")), verses, f"{d}/m", f"{d}/c2").awaitTermination()
    assert spark.read.parquet(f"{d}/m").count() == 3
