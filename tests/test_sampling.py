"""Samples, splits and ranking scores against plain Python."""

import hashlib
import random

import pytest

from echotrace.operators import sampling


def test_split_and_balance_are_exact(spark):
    rng = random.Random(1)
    rows = [(i, int(rng.random() < 0.1)) for i in range(3000)]
    order = lambda r: (hashlib.md5(f"42:{r[0]}".encode()).hexdigest(), r[0])
    by = {c: sorted((r for r in rows if r[1] == c), key=order) for c in (0, 1)}
    df = spark.createDataFrame(rows, "k long, y int")
    got = {(r.k, r.y) for r in sampling.split(df, "y", "k").where("is_test").collect()}
    assert got == {r for c in (0, 1) for r in by[c][: round(len(by[c]) * 0.2)]}
    assert {(r.k, r.y) for r in sampling.balance(df, "y", "k").collect()} == {*by[1], *by[0][: 4 * len(by[1])]}
    assert sampling.balance(df.where("y = 0"), "y", "k").count() == len(by[0]) and sampling.split(df.limit(0), "y", "k").count() == 0


def test_ranking_scores(spark):
    rng = random.Random(2)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(2000)] + [(1, None)]
    pos, neg = ([p for y, p in rows if y == c and p is not None] for c in (1, 0))
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    above = lambda t, xs: sum(x >= t for x in xs)
    ap = sum(pos.count(t) * above(t, pos) / (above(t, pos) + above(t, neg)) for t in set(pos)) / len(pos)
    df = spark.createDataFrame(rows, "y int, p double")
    got = sampling.ranking_scores(df, "y", "p").first()
    assert got.auc == pytest.approx(auc) and got.average_precision == pytest.approx(ap)
    assert tuple(sampling.ranking_scores(df.where("y = 0"), "y", "p").first()) == (None, None)
