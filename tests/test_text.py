import pytest
from pyspark.sql import functions as F

from echotrace.functions import text as tx
from echotrace.functions.arrow import lcs_length, unescape, unescape_nfkc


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("value", "out"), [("“Don’t”", "don't"), ("word—next", "word-next"), ("God,and", "god,and"), ("***", ""), (None, ""), ("&amp;amp;", "amp")])
def test_documents(spark, value, out):
    assert one(spark, lambda c: tx.normalize_document(c, unescape=unescape), value) == out


@pytest.mark.parametrize(("value", "out"), [("don’t", "don t"), ("don't", "don't"), ("lord'", "lord"), ("a--b", "a--b"), ("ﬁ", "fi"), (None, "")])
def test_passages(spark, value, out):
    assert one(spark, lambda c: tx.normalize_passage(c, unescape_nfkc), value) == out


def test_small_functions(spark):
    assert one(spark, tx.drop_notes, "Note: x\n\nbody") == "body"
    assert one(spark, tx.strip_credit, "a online by Gerhard Peters x\nb") == "a online by Gerhard Peters x\nb"
    assert one(spark, tx.strip_credit, "a\nOnline by Gerhard Peters x") == "a"
    assert one(spark, tx.token_count, "") == 0
    assert one(spark, lambda c: tx.short_hash(F.lit("KJV"), c), "Genesis 1:1") == "a4b607417196d362"
    assert one(spark, tx.guess_date, "March 4, 1861") == "1861-03-04" and one(spark, tx.guess_date, "no date") is None
    assert len(one(spark, lambda c: tx.ngrams(tx.words_of(c)), "a b c d e")) == 6 and one(spark, lambda c: tx.ngrams(tx.words_of(c)), "a b") == []
    assert one(spark, lambda c: tx.char_ngrams(c), "abcd") == ["abc", "bcd", "abcd"]


def test_lcs():
    assert lcs_length("abcbdab", "bdcaba") == 4 and lcs_length([], [1]) == 0
