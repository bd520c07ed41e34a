"""Text functions as Spark expressions. A Column in, a Column out; null text counts as empty unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's \w and \s, spelt out for Java.
WORD_CHAR = r"\p{L}\p{N}_"
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: A word that may hold apostrophes and hyphens inside.
INNER_WORD = rf"[{WORD_CHAR}](?:[{WORD_CHAR}'-]*[{WORD_CHAR}])?"
#: A word without its outer punctuation: from a word character on to the last one before white space (what SPACE has).
CORE_WORD = rf"[{WORD_CHAR}](?:[^\s\x1c-\x1f\x85\p{{Z}}]*[{WORD_CHAR}])?"

#: Typographic characters and what stands for each.
STRAIGHT = {"“": '"', "”": '"', "„": '"', "‟": '"', "’": "'", "‘": "'", "‚": "'", "‛": "'", "—": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " ", "​": " "}


def blank_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def straighten(text: Column) -> Column:
    """Typographic quotes, dashes, blanks and dots in their ASCII form."""
    return F.replace(F.translate(text, "".join(STRAIGHT), "".join(STRAIGHT.values())), F.lit("…"), F.lit("..."))


def strip_blank(text: Column) -> Column:
    return F.regexp_replace(text, r"^(?U)[\s\x1c-\x1f]+|(?U)[\s\x1c-\x1f]+$", "")


def squeeze(text: Column) -> Column:
    """Each run of white space one blank, none at the ends."""
    return F.btrim(F.regexp_replace(blank_if_null(text), SPACE, " "), F.lit(" "))


def strip_credit(text: Column) -> Column:
    """Without the archive's credit on the last line and a trailing link to its node."""
    text = F.regexp_replace(text, r"(?id)online by gerhard peters.*?$", "")
    return strip_blank(F.regexp_replace(text, r"(?id)https?://www\.presidency\.ucsb\.edu/node/\d+\s*$", ""))


def drop_notes(text: Column) -> Column:
    """Without the paragraphs that begin with ``Note:``."""
    parts = F.transform(F.split(text, r"\n{2,}"), strip_blank)
    return strip_blank(F.array_join(F.filter(parts, lambda p: ~p.rlike(r"(?i)^\s*note:")), "\n\n"))


def normalize_document(text: Column, notes: bool = True, unescape=None) -> Column:
    """The matching form of a document: straight quotes, no credit, lower case, words without outer punctuation.

    notes: whether paragraphs of notes stay. unescape: a function for character references, or None.
    """
    s = blank_if_null(text)
    s = strip_credit(straighten(unescape(s) if unescape else s))
    s = s if notes else drop_notes(s)
    return F.array_join(F.regexp_extract_all(F.lower(s), F.lit(CORE_WORD), F.lit(0)), " ")


def normalize_passage(text: Column, compose=None) -> Column:
    """The matching form of a reference passage; compose: unescaping and NFKC, or None."""
    s = blank_if_null(text)
    return F.array_join(F.regexp_extract_all(F.lower(compose(s) if compose else s), F.lit(INNER_WORD), F.lit(0)), " ")


def normalize_pair_text(text: Column) -> Column:
    """The form in which the classifier compares texts."""
    return squeeze(F.translate(F.lower(blank_if_null(text)), "“”‘’", "\"\"''"))


def simple_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(blank_if_null(text)), F.lit("[a-z0-9']+"), F.lit(0))


def flatten_lines(text: Column) -> Column:
    return strip_blank(F.regexp_replace(blank_if_null(text), r"\s*\n\s*", " "))


def words_of(normal: Column) -> Column:
    """The words of a text in matching form; none for the empty text."""
    return F.filter(F.split(normal, " "), lambda w: w != "")


def token_count(normal: Column) -> Column:
    return F.when(normal == "", 0).otherwise(F.size(F.split(normal, " "))).cast("int")


def short_hash(*parts: Column, n: int = 16) -> Column:
    """The first n hex digits of the MD5 of the parts, joined by two bars; null parts count as empty."""
    return F.substring(F.md5(F.concat_ws("||", *(blank_if_null(p.cast("string")) for p in parts)).cast("binary")), 1, n)


def guess_date(text: Column) -> Column:
    """ISO date of a lenient date text, or null."""
    text = squeeze(text)
    forms = ("MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM-dd", "d MMMM yyyy", "M/d/yyyy", "yyyy/MM/dd")
    dates = [F.try_to_date(text, f) if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in forms]
    return F.date_format(F.coalesce(*dates, F.to_date(F.try_to_timestamp(text))), "yyyy-MM-dd")


def category_url(slug: Column, base: str, prefix: str) -> Column:
    """A category's address from its slug; full addresses stay."""
    return F.when(slug.startswith("http"), slug).otherwise(F.concat(F.lit(base + prefix), F.btrim(slug, F.lit("/ "))))


def ngrams(words: Column, least: int = 3, most: int = 5) -> Column:
    """All n-grams of words for n from least to most, in order of n and place."""
    none = F.array().cast("array<string>")

    def of(w: Column, n: int) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - n)
        return F.when(F.size(w) >= n, F.transform(places, lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(n))))).otherwise(none)

    # Within transform the words are evaluated once a row, not once a gram.
    return F.get(F.transform(F.array(words), lambda w: F.concat(*(of(w, n) for n in range(least, most + 1)))), F.lit(0))


def char_ngrams(text: Column, least: int = 3, most: int = 5) -> Column:
    """All character n-grams of a text whose white space is squeezed."""
    none = F.array().cast("array<string>")

    def of(t: Column, n: int) -> Column:
        places = F.sequence(F.lit(1), F.char_length(t) - n + 1)
        return F.when(F.char_length(t) >= n, F.transform(places, lambda i: F.substring(t, i, F.lit(n)))).otherwise(none)

    # Within transform the text is evaluated once a row, not once a gram.
    return F.get(F.transform(F.array(text), lambda t: F.concat(*(of(t, n) for n in range(least, most + 1)))), F.lit(0))
