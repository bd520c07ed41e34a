"""The operators of echotrace.llm against brute force, on small tables with odd rows."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from echotrace.llm import decontamination, html_extraction, line_dedup, packing, passage_dedup, pii, quality_rules, simhash, suffix_dedup, token_counts

LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(900))
TEXTS = [LONG, LONG, "a b\n" + LONG[:700] + "\nend", None, "", "short one", "the and of to be " * 40, "ab" * 600, "é" * 450, LONG.upper(), "x " + LONG[300:2500]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"src{i % 2}", i) for i, t in enumerate(TEXTS)] + [(0, LONG, "src0", 7), (None, "short one", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, pos long").cache()


def empty(docs):
    return docs.limit(0)


def test_packing(docs):
    got = packing.pack(docs, 100).toPandas()
    assert got.groupby("bin_id")["n_words"].sum().max() <= 100
    known = got[got["source"].notna()]
    assert known.groupby(["bin_id", "source"]).size().max() == 1 and got.groupby(["bin_id", "cluster_id"]).size().max() == 1
    assert got["n_words"].sum() == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect())
    assert packing.pack(empty(docs)).count() == 0


def test_best_fit_is_the_tightest_compatible():
    p = packing.Packer(10)
    assert [p.put(*x)[0] for x in ((7, 1, 0), (6, 2, 0), (3, 1, 0), (3, 2, 0), (1, 4, 0))] == [0, 1, 1, 0, 1]


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    out = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [f"card:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]([ -]?[0-9])+", t) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    return out + [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii(spark):
    texts = ["a@b.c@d.e", "a@b.com_x@d.e, .-@-.- 1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.4", "4111 1111 1111 1111-1 4111-1111-1111-1111  4111111111111111", "+1 (743) 555-3824. +123456789012345678", "😀 x@y.zz", None, "", "1 2 3 4 " * 3000, "9" * 50_000, "a@b" + ".c" * 60_000 + "..d", "+1" + "(" * 50_000, "x." * 50_000 + "@y.z"]
    got = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in pii.BASE_KINDS] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got == {i: base_spans(t or "") for i, t in enumerate(texts)}


def test_em_trusts_labelers_that_agree():
    real, _ = pii.fit_em({("email", 1, 1, 1): 90, ("email", -1, -1, 0): 60, ("email", 1, 1, 0): 30})
    assert real["email", 1, 1, 1] > 0.9 > 0.1 > real["email", -1, -1, 0]


def test_line_dedup(spark):
    line = "This line is long enough to count"
    rows = [(1, f"a\n{line}\nb"), (2, f" {line.upper()}\t\n"), (3, line), (4, None), (5, "short\nshort"), (6, f"{line}\n{line}")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: (3, 1, "a\nb"), 2: (2, 1, ""), 3: (1, 1, ""), 4: (1, 0, ""), 5: (2, 0, "short\nshort"), 6: (2, 0, f"{line}\n{line}")}


def test_line_dedup_of_rows_that_repeat_a_doc_id(spark):
    line = "This line is long enough to count"
    rows = [(1, f"short\n{line}", 5), (1, "keep me\nother", 6), (2, line, 7), (3, line, 8)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, __drop int")
    assert sorted(map(tuple, line_dedup.apply(docs).collect())) == [(1, "keep me\nother", 6), (1, "short", 5), (2, "", 7), (3, line, 8)]
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_pii_keeps_planted_secrets(spark):
    rows = [(i, f"some words token = \"{hashlib.sha1(bytes([i])).hexdigest()}\" more") for i in range(30)]
    rows += [(100 + i, f"write to ann{i}@mail.example.com or +1 (743) 555-38{10 + i}") for i in range(60)] + [(200, "my ssn is 219-31-4455"), (201, "a password: xxxxxxxxxx here")]
    found = {r.doc_id: [s.kind for s in r.spans] for r in pii.find(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert all(found[i] == ["secret"] for i in range(30)) and found[200] == ["ssn"]
    assert all("email" in found[100 + i] and "phone" in found[100 + i] for i in range(60))
    assert pii.find(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_labelers_are_judged_for_each_kind():
    real, _ = pii.fit_em({("email", 1, 1, 0): 900, ("ip", 1, 1, 0): 900, ("secret", 1, 0, 1): 13})
    assert real["secret", 1, 0, 1] > 0.9


def test_passages_by_document(spark):
    words = lambda x, n: " ".join(f"{x}{k}" for k in range(n))
    rows = [(1, f"{words('a', 30)} {words('s', 80)}"), (2, f"{words('s', 80)} {words('b', 20)}"), (3, words("c", 90)), (4, words("c", 90)), (5, words("d", 70)), (6, None), (7, "short"), (8, "short"), (None, words("c", 90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in passage_dedup.by_document(docs).collect()}
    assert got == {1: (1, 0, 1, 1, 80), 2: (1, 0, 1, 1, 80), 3: (3, 1, 0, 1, 90), 4: (3, 1, 0, 1, 90)} | {i: (i, 0, 0, 0, 0) for i in (5, 6, 7, 8)}
    assert passage_dedup.by_document(docs.limit(0)).count() == 0


def test_html():
    page = "<head><title>t</title></head><nav><li>x</nav><div class='cookie notice'>n</div><article><header><h1>A &amp; B</h1></header><p>one<br>two<p>th&eacute;<div class=comments><p>c</div></article><footer>f"
    assert html_extraction.main_text(page) == "A & B\none two\nthé"
    assert html_extraction.main_text("") == "" and html_extraction.main_text("a < b") == "a < b"


def test_style_tree_removes_what_a_site_repeats(spark):
    rows = [(i, f"http://h/{i}", f"<div class=x>same words</div><div class=y>text of page {i}</div>") for i in range(6)] + [(9, None, None)]
    rows += [(i, f"http://hot/{i}", f"<p class=x>always this</p><p class=y>text of page {i}</p>") for i in range(100, 300)]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id int, url string, html string").selectExpr("cast(page_id as long) page_id", "url", "html")).collect()}
    assert got == {i: f"text of page {i}" for i in (*range(6), *range(100, 300))} | {9: ""}


def test_style_tree_decides_inside_the_article(spark):
    page = "<article class=post><div class=x>join our letter today</div><p>text of page {0}<article class=comment><p>reader {0} says</article></article><div class=y>side {0}</div>"
    rows = [(i, f"http://h/{i}", page.format(i)) for i in range(8)] + [(20 + i, f"http://same/{i}", "<div class=x>only this</div>") for i in range(8)]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text of page {i}" for i in range(8)} | {20 + i: "" for i in range(8)}


def test_pii_secret_is_whole(spark):
    text = f"use token={'aB3.' * 150} now"
    spans = pii.find(spark.createDataFrame([(1, text)], "doc_id int, text string")).first().spans
    assert [(s.start, s.end) for s in spans if s.kind == "secret"] == [(4, len(text) - 4)]


def test_passages(docs, spark):
    got = {(r.doc_id_a, r.doc_id_b) for r in passage_dedup.near_passages(docs).collect()}
    group = {x for p in got for x in p}
    assert group == {0, 1, 2, 9, 10} and (0, 1) in got
    assert passage_dedup.near_passages(empty(docs)).count() == 0


def test_passages_of_a_frequent_key(spark):
    shared = " ".join(f"s{i}" for i in range(120))
    rows = [(i, f"{' '.join(f'u{i}x{k}' for k in range(30))} {shared} {' '.join(f'v{i}x{k}' for k in range(i % 40))}") for i in range(60)]
    rows += [(i, rows[3][1]) for i in range(60, 80)]
    found = passage_dedup.near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    root = list(range(80))
    for _ in range(80):
        for r in found:
            root[r.doc_id_a] = root[r.doc_id_b] = min(root[r.doc_id_a], root[r.doc_id_b])
    assert set(root) == {0}
    assert all(r.start_a <= 30 and r.end_a >= 150 and r.start_b <= 30 and r.end_b >= 150 for r in found)


def test_passages_between_the_whole_chain_and_exact_stretches(spark):
    import random

    rng = random.Random(3)
    word = lambda: f"q{rng.randrange(10**9)}"
    words = lambda n: [word() for _ in range(n)]
    edited = lambda x, at: [*x[:at], word(), *x[at + 1 :]]
    rows, want = [], {}
    for k in range(40):
        one, two = words(90), words(90)
        rows += [(4 * k, [*words(20), *one, *words(60), *two]), (4 * k + 1, [*words(35), *edited(one, 40), *words(60), *edited(two, 50)])]
        want[4 * k] = [(20, 110, 35, 125), (170, 260, 185, 275)]
        one = words(60)
        rows += [(4 * k + 2, [*words(15), *one, *words(30)]), (4 * k + 3, [*words(25), *edited(one, 11), *words(10)])]
        want[4 * k + 2] = [(15, 75, 25, 85)]
    texts = dict(rows)
    found = {}
    for r in passage_dedup.near_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")).collect():
        a, b = ({tuple(w[i : i + 5]) for i in range(x, y - 4)} for w, x, y in ((texts[r.doc_id_a], r.start_a, r.end_a), (texts[r.doc_id_b], r.start_b, r.end_b)))
        assert r.similarity == pytest.approx(len(a & b) / len(a | b)) and r.similarity >= 0.8
        found.setdefault(r.doc_id_a, []).append((r.start_a, r.end_a, r.start_b, r.end_b))
    # What is found is whole; what min-hashes by four functions leave out is no more than their chance.
    assert all(set(v) <= set(want[k]) for k, v in found.items())
    assert sum(map(len, found.values())) >= 0.9 * sum(map(len, want.values()))


def texts_with_a_frequent_line(n, own):
    """n texts with one frequent line of 45 words; 2i and 2i + 1 share the own words before it too, and then no other text does."""
    line = " ".join(f"line{k}" for k in range(45))
    return [(i, f"{' '.join(f'u{i}x{k}' for k in range(40))} {' '.join(f'p{i // 2}x{k}' for k in range(own))} {line} {' '.join(f'v{i}x{k}' for k in range(30))}") for i in range(n)]


@pytest.mark.parametrize("own", [15, 10])
def test_passages_of_two_texts_around_a_frequent_line(spark, own):
    rows = texts_with_a_frequent_line(300, own)
    got = {(r.doc_id_a, r.doc_id_b): (r.start_a, r.end_a, r.start_b, r.end_b) for r in passage_dedup.near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {(i, i + 1): (40, 85 + own, 40, 85 + own) for i in range(0, 300, 2)}


def test_passages_do_not_depend_on_partitions(spark):
    rows = texts_with_a_frequent_line(120, 20)
    rows += [(i, rows[0][1]) for i in range(200, 210)]  # copies are rows of one key too
    rows.append((300, f"{' '.join(f'z{k}' for k in range(60))} {' '.join(f'line{k}' for k in range(45))}"))  # shares the line only
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(map(tuple, passage_dedup.near_passages(docs.repartition(n, "doc_id")).collect())) for n in (1, 3, 40)]
    want = {(i, i + 1) for i in range(0, 120, 2)} | {(0, i) for i in range(200, 210)}
    assert got[0] == got[1] == got[2] and {x[:2] for x in got[0]} == want


def test_no_edited_passage_of_a_frequent_line_is_lost(spark, monkeypatch):
    line = " ".join(f"line{k}" for k in range(40))
    own = lambda i: " ".join(f"e{i}" if k == 7 else f"p{i // 2}x{k}" for k in range(14))
    rows = [(i, f"{' '.join(f'u{i}x{k}' for k in range(40))} {own(i)} {line} {' '.join(f'v{i}x{k}' for k in range(30))}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for block in (passage_dedup.BLOCK, 60):  # one cell for the line's texts, and a grid of them
        monkeypatch.setattr(passage_dedup, "BLOCK", block)
        got = {(r.doc_id_a, r.doc_id_b): (r.start_a, r.end_a, r.start_b, r.end_b) for r in passage_dedup.near_passages(docs).collect()}
        assert got == {(i, i + 1): (40, 94, 40, 94) for i in range(0, 400, 2)}


def test_texts_that_share_a_line_and_no_passage_are_not_verified(spark):
    words = lambda x, n: " ".join(f"{x}{k}" for k in range(n))
    line, block = words("line", 30), [f"{words('b', 26)} {x} {words('c', 4)} " for x in ("one", "two")]
    texts = {i: f"{words(f'u{i}x', 60)} {line} {words(f'v{i}x', 200)}" for i in range(30)}  # a line
    texts |= {i: " ".join(f"r{i}x{k} " * 30 for k in range(4)) + "as " * 30 + " ".join(f"s{i}x{k} " * 30 for k in range(4)) for i in range(30, 60)}  # a word 30 times
    texts |= {i: f"{words('in', 12)} {block[i - 60] * 30} {words('out', 40)}" for i in (60, 61)}  # similar as a whole only, by what is outside the repeats
    texts |= {i: f"{words(f'w{i}x', 60)} {line} {words('own', 16)} {words(f'z{i}x', 60)}" for i in (62, 63)}  # a line, and more
    df = spark.createDataFrame([(i, t, None) for i, t in texts.items()], "tk long, text string, runs array<struct<start:long,end:long,root:long>>")
    got = {(r.a, r.b) for r in passage_dedup._rest(df, 50, 0.8).collect()}
    assert {(60, 61), (62, 63)} <= got
    assert len(got) < 100 and all(30 <= a < 60 for a, b in got - {(60, 61), (62, 63)})  # not each with each other; words that share a byte leave some


def test_near_copies_without_a_passage_are_not_verified_pair_by_pair(spark):
    import random

    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    near = lambda model, gap, at: [w if 55 <= k < 85 or k % gap != at else word() for k, w in enumerate(model)]
    one, two = ([word() for _ in range(130)] for _ in range(2))
    rows = {i: near(one, 8, 6) for i in range(100)}  # an edit every 8 words around a stretch that all share: no passages
    rows |= {i: near(two, 20, i % 20) for i in range(100, 130)}  # every 20 words: some have passages
    df = spark.createDataFrame([(i, " ".join(x), None) for i, x in rows.items()], "tk long, text string, runs array<struct<start:long,end:long,root:long>>")
    got = {(r.a, r.b) for r in passage_dedup._rest(df, 50, 0.8).select("a", "b").collect()}
    assert not {x for x in got if x[0] < 100}

    shingles = lambda x: {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
    similar = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    want = set()
    for a in range(100, 108):  # brute force, at equal places as words are edited only
        for b in range(a + 1, 130):
            if any(similar(shingles(rows[a][x : x + n]), shingles(rows[b][x : x + n])) for x in range(0, 56) for n in range(max(50, 85 - x), 131 - x, 3)):
                want.add((a, b))
    assert len(want) > 20 and want <= got


def test_every_anchor_outside_the_passages_found_is_tried():
    a = [f"a{k}".encode() for k in range(260)]
    b = [b"x%d" % k if k in (221, 223, 225, 227, 229) or 100 <= k < 160 or k >= 231 else w for k, w in enumerate(a)]
    b[170:221] = a[170:221]
    b[185] = b"y"
    chain = [(0, 0, 7), (60, 60, 7), (200, 200, 7)]
    assert [x[:4] for x in passage_dedup.passages(a, b, chain, 50, 0.8)][0][:2] == (0, 100)
    assert any(x[0] >= 150 for x in passage_dedup.passages(a, b, chain, 50, 0.8, True))


def test_every_pair_that_verification_finds_from_a_meeting_place_is_found():
    import random

    import numpy as np

    least, span, window = 46, 15, 7
    for seed in (9, 13):
        rng = random.Random(seed)
        vocab = rng.choice([10**9, 10**9, 40, 400])
        word = lambda: f"w{rng.randrange(vocab)}"  # noqa: B023, E731
        model = [word() for _ in range(rng.choice([60, 90, 200, 500]))]
        core = rng.randrange(5, len(model) - 40)
        kept = range(core, core + rng.choice([20, 28, 35]))

        def edited():
            gap, out = rng.choice([6, 8, 10, 14, 20, 40]), []  # noqa: B023
            for k, w in enumerate(model):  # noqa: B023
                edit = [[word()], [], [w, word()], [w] * rng.choice([2, 3])][rng.choice([0, 0, 1, 2, 3])]  # noqa: B023
                out += [w] if k in kept or rng.random() > 1 / gap else edit  # noqa: B023
            return [x.encode() for x in ([f"q{rng.random()}"] * rng.choice([0, 30]) + out)]  # noqa: B023

        texts = [edited() for _ in range(40)]
        rows = []
        for tk, words in enumerate(texts):
            w = passage_dedup.word_hashes(words)
            numbered = (w % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
            sub, at = passage_dedup.picked(passage_dedup._shingled(w), span, window)
            for key, p, x in zip(sub.tolist(), at.tolist(), passage_dedup._around(numbered, at, span, 160)):
                rows.append((key, 0, False, tk, p, tk, max(0, len(w) - 4 - span - 160 - p), x.tobytes()))
        kinds = [np.uint64, np.int64, bool, np.int64, np.int64, np.int64, np.int32, object]
        cols = [np.array(c, k) for c, k in zip(zip(*sorted(rows)), kinds)]
        got = defaultdict(list)
        for b in passage_dedup._across(*cols, least, span, 0.8):
            for x, y, at in zip(*(c.to_pylist() for c in b.columns)):
                got[x, y].append(passage_dedup._unpack(at))
        found = {(x, y) for (x, y), at in got.items() if any(passage_dedup.passages(texts[x], texts[y], c, 50, 0.8) for c in passage_dedup._chains(at, 50))}
        want, by_key = set(), defaultdict(list)
        for key, _, _, tk, p, *_ in rows:
            by_key[key].append((tk, p))
        for places in by_key.values():
            want |= {(x, y) for x, p in places for y, q in places if x < y and (x, y) not in want and passage_dedup.passages(texts[x], texts[y], [(p, q, 7)], 50, 0.8)}
        assert want and want <= found


def test_common_shingles_around_a_place_and_fewest_of_a_passage():
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [rng.integers(1, n, 139).astype(np.uint8) for n in (250, 250, 3, 2)] + [np.tile(np.arange(1, 21, dtype=np.uint8), 7)[:139]]
    rows += [np.concatenate((rows[0][:70], rows[1][70:])), np.concatenate((np.zeros(50, np.uint8), rows[2][50:]))]
    count, fewest, repeats = passage_dedup._in_common(np.array(rows), 46, 15)
    shingles = [[tuple(r[i : i + 5]) if r[i : i + 5].all() else None for i in range(135)] for r in rows]
    sets = [set(x) - {None} for x in shingles]
    assert (count(0, 7) * (1 - np.eye(7)) == np.array([[len(a & b) for b in sets] for a in sets]) * (1 - np.eye(7))).all()
    want = [min(len(set(x[p : p + 46])) for p in range(29, 61) if None not in x[p : p + 46]) for x in shingles]
    assert fewest.tolist() == want and repeats.tolist() == [len(s) < len(x) - x.count(None) for s, x in zip(sets, shingles)]


def test_equal_stretches_share_a_picked_place():
    import numpy as np

    assert passage_dedup.sure_stretch(46, 0.8) == 21
    rng = np.random.default_rng(2)
    for n in (21, 40):
        same = rng.integers(0, 2**63, n, dtype=np.uint64)
        a, b = (np.concatenate((rng.integers(0, 2**63, k, dtype=np.uint64), same, rng.integers(0, 2**63, 30, dtype=np.uint64))) for k in (13, 50))
        assert set(passage_dedup.picked(a, 15, 7)[0]) & set(passage_dedup.picked(b, 15, 7)[0])
    assert len(passage_dedup.picked(np.tile(a[:3], 500), 15, 7)[0]) <= 6  # a repeat without a break: its ends


def test_compact_windows_cover_every_run_once():
    import numpy as np

    h = np.random.default_rng(1).permutation(60).astype(np.uint64)
    w = passage_dedup.compact_windows(h, 7)
    for a in range(60):
        for b in range(a + 6, 60):
            assert [c for lo, c, hi in w if lo <= a <= c <= b <= hi] == [a + int(h[a : b + 1].argmin())]


def test_quality_repeats(spark):
    text = "a b c d a b c a b c x y z " * 3
    got = quality_rules.measure(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")).orderBy("doc_id").collect()
    w = text.split()
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    assert got[0].n_repeat_words == len({p for i, x in enumerate(g) if g.count(x) > 1 for p in range(i, i + 3)}) and got[1].base_failed


def test_suffix_dedup(docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]

    def covered(length):
        seen = {}
        for d, (_, b) in enumerate(rows):
            for a in range(len(b) - length + 1):
                seen.setdefault(b[a : a + length], []).append((d, a))
        cover = [bytearray(len(b)) for _, b in rows]
        for places in seen.values():
            for d, a in places if len(places) > 1 else ():
                cover[d][a : a + length] = b"\1" * length
        return cover

    want = sorted((str(i), len(b), sum(c), hashlib.sha256(bytes(x for x, y in zip(b, c) if not y)).hexdigest(), sum(s)) for (i, b), c, s in zip(rows, covered(400), covered(250)))
    for hot in (20_000, 1):
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256, r.n_shared) for r in suffix_dedup.dedup(docs, hot_pieces=hot).collect()) == want
    assert [r.n_removed for r in suffix_dedup.dedup(docs, shared=400).orderBy("doc_id", "n_bytes").collect()] == [r.n_removed for r in suffix_dedup.dedup(docs).orderBy("doc_id", "n_bytes").collect()]
    assert suffix_dedup.dedup(empty(docs)).count() == 0


@pytest.mark.parametrize(("blocks", "shard_rows"), [(5, 20_000), (5, 2), (3, 20_000)])
def test_simhash(docs, blocks, shard_rows):
    fp = {r.doc_id: simhash.fingerprint((r.text or "").encode()) for r in docs.where("doc_id is not null").collect()}
    root = {d: d for d in fp}
    for _ in fp:
        root = {d: min(root[x] for x in fp if (fp[d] ^ fp[x]).bit_count() <= 4) for d in fp}
    got = simhash.near_duplicates(docs, blocks=blocks, shard_rows=shard_rows).where("doc_id is not null").collect()
    assert {r.doc_id: r.component_id for r in got} == root
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_token_counts():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, c = Tokenizer.from_file(path), token_counts.Counter(path, chunk=300, overlap=8)
    for text in (LONG, "é " * 500, "nospace" * 300, "a <|endoftext|> b " * 60, ""):
        assert c.batch([text.encode()]) == [len(t.encode(text, add_special_tokens=False))]
        assert c.huge(text) == len(t.encode(text, add_special_tokens=False))
    assert c.widened


def test_decontamination(docs, spark):
    item = " ".join(LONG.split()[40:70])
    edited = item.replace("w50", "v50").upper().replace(" ", "\n", 3)
    items = spark.createDataFrame([(1, item), (2, edited), (3, "unrelated words that are nowhere in any of these texts"), (4, None)], "item_id long, text string")
    got = decontamination.matches(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.item_id != 2} == {(d, 1) for d in (0, 1, 2, 9)} and {r.doc_id for r in got if r.item_id == 2} == {0, 1, 2, 9}
    assert {(r.start_word, r.end_word) for r in got if r.doc_id == 0 and r.item_id == 1} == {(40, 70)}
    assert decontamination.matches(docs, items.limit(0)).count() == 0
    assert decontamination.drop_leaks(docs, items).count() == docs.count() - 5


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = [(1, LONG + " the of and to " * 20, "en", "a", 1), (2, LONG + " the of and to " * 20, "en", "b", 1), (3, "### " * 80, "en", "a", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "words of a benchmark that nobody has copied")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1}


def test_component_chain(spark):
    from echotrace.llm.components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (5, None)], "a long, b long")
    assert {(r.a, r.b) for r in components(links).collect()} == {(i, 0) for i in range(1, 31)} | {(101, 100)}
    assert components(links.limit(0)).where(F.lit(True)).count() == 0


def test_packing_puts_each_piece_into_the_tightest_bin(spark):
    import random

    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 250) + [str(rng.randrange(40))]), rng.choice(["a", "b", "c", "d", None])) for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows + rows[:30], "doc_id long, text string, source string"), 100).toPandas()
    got = got.sort_values(["n_words", "doc_id", "start_word", "cluster_id"], ascending=[False, True, True, True], kind="stable")
    # Equal pieces may come in either order; their bins' slots tell which came first.
    bins, left = {}, got.to_dict("records")
    while left:
        same = [p for p in left if (p["n_words"], p["doc_id"], p["start_word"]) == (left[0]["n_words"], left[0]["doc_id"], left[0]["start_word"])]
        for p in same:
            left.remove(p)
        residual = lambda b: 100 - sum(x["n_words"] for x in b)
        fits = lambda p, b: p["n_words"] <= residual(b) and all(p["source"] is None or x["source"] != p["source"] for x in b) and all(x["cluster_id"] != p["cluster_id"] for x in b)
        while same:
            best = {id(p): min((residual(b) for b in bins.values() if fits(p, b)), default=None) for p in same}
            able = [p for p in same if (residual(bins[p["bin_id"]]) if p["bin_id"] in bins else None) == best[id(p)] and len(bins.get(p["bin_id"], [])) == p["slot"]]
            assert able
            bins.setdefault(able[0]["bin_id"], []).append(able[0])
            same.remove(able[0])


def test_packing_deals_equal_rows_over_shards(spark):
    docs = spark.range(400).selectExpr("cast(null as long) doc_id", "cast(null as string) text", "cast(null as string) source")
    got = packing.pack(docs, shard_rows=50).toPandas()
    assert len(got) == got["bin_id"].nunique() == 400 and (got["bin_id"] // 2**32).value_counts().max() <= 100


def test_decontamination_against_every_alignment(spark):
    import random

    rng = random.Random(2)
    letters = "abcdefghij"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 14)))) for i in range(25)]

    def edited(text, n):
        for _ in range(n):
            at = rng.randrange(len(text))
            text = rng.choice((text[:at] + text[at + 1 :], text[:at] + rng.choice(letters) + text[at:], text[:at] + rng.choice(letters) + text[at + 1 :]))
        return text

    docs = [(i, " ".join([*(word() for _ in range(rng.randrange(30))), edited(items[i % 25][1], rng.randrange(12)), *(word() for _ in range(rng.randrange(30)))])) for i in range(80)]

    def edits(item, text):
        row = [0] * (len(text) + 1)
        for k, c in enumerate(item):
            new = [k + 1]
            for t, d in enumerate(text):
                new.append(min(row[t] + (c != d), row[t + 1] + 1, new[t] + 1))
            row = new
        return min(row)

    # Within the budget e, and no shorter than the lemma needs: items under q characters are found exactly.
    want = {}
    for d, t in [(d, " ".join(t.split())) for d, t in docs]:  # runs of white space are one blank
        for i, x in items:
            m = len(x)
            least = edits(x, t) if m >= decontamination.Q else (0 if x in t else None)
            if least is not None and least <= max(0, min(int(m * decontamination.EDIT_RATE), (m - decontamination.Q) // decontamination.Q)):
                want[d, i] = least
    for block_chars in (4_000_000, 300):
        found = decontamination.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=block_chars).collect()
        assert {(r.doc_id, r.item_id): r.edits for r in found} == want
