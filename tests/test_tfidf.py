import math
import random
from collections import Counter

import pytest

from echotrace.operators import pair_features as pf


def _brute(pairs, grams):
    sides = {(i, x): Counter(grams(t or "")) for i, *both in pairs for x, t in enumerate(both)}
    df = Counter(g for c in sides.values() for g in c)
    w = {k: {g: n * (math.log((1 + len(sides)) / (1 + df[g])) + 1) for g, n in c.items() if df[g] > 1} for k, c in sides.items()}
    norm = lambda x: math.sqrt(sum(y * y for y in x.values()))
    return {i: sum(y * w[i, 1].get(g, 0) for g, y in w[i, 0].items()) / ((norm(w[i, 0]) * norm(w[i, 1])) or 1e-8) for i, *_ in pairs}


@pytest.mark.parametrize(("kind", "grams"), [
    (pf.char_grams, lambda t: [t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)]),
    (pf.word_grams, lambda t: [" ".join(k[i : i + n]) for k in [[w for w in t.split() if len(w) > 1]] for n in (1, 2) for i in range(len(k) - n + 1)]),
])
def test_tfidf_cosine_is_that_of_brute_force(spark, monkeypatch, kind, grams):
    monkeypatch.setattr(pf, "BLOCK", 3)
    r = random.Random(5)
    words = ["ab", "abc", "é", "漢字", "𝔸𝔹", "x", "the", "end"]
    pairs = [(f"p{i}", *(" ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 40]))) for _ in "sv")) for i in range(40)] + [("n", None, "the end"), ("e", "", "")]
    p = spark.createDataFrame(pairs, "pair_id string, s string, v string")
    got = {x.pair_id: x.c for x in pf.tfidf_cosine(p, pf.tfidf_fit(p, kind), kind, "c").collect()}
    want = _brute(pairs, grams)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_tfidf_does_not_shuffle_each_texts_grams(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(40)]
    pairs = [(str(i), *(" ".join(r.choice(words) for _ in range(60)) for _ in "sv")) for i in range(1500)]
    p = spark.createDataFrame(pairs, "pair_id string, s string, v string")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = shuffled()
    assert len(pf.tfidf_cosine(p, pf.tfidf_fit(p, pf.char_grams), pf.char_grams, "c").collect()) == 1500
    ratio = (shuffled() - before) / sum(len(s) + len(v) for _, s, v in pairs)
    assert ratio < 3
