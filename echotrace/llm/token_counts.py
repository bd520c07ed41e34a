"""Token counts, with overlap resynchronisation for huge documents.

A text of up to ``chunk`` characters is one chunk. A longer one is encoded in chunks that overlap.
Both neighbours encode the overlap with offsets; they are spliced at a boundary that is common to
both and proven stable: a token starts there in both, the tokens that follow agree, and white space
stands before it. White space belongs to no token of these vocabularies and no piece of their
pre-tokenisers crosses it, so what stands before such a boundary cannot change what follows. Where
an overlap has none, it is widened, in the end to the whole text.

Within a chunk the same property lets a task remember the counts of pieces between blanks, which
the library has encoded; the memory is bounded by ``remember`` pieces.

Edge cases. A null or empty text has 0 bytes and 0 tokens. Special strings inside a text are taken
as the library's default takes them. Repeated rows are counted row by row; null doc_ids stay. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrow import small_batches, texts
from .common import table

LIMIT = 2048
CHUNK, OVERLAP, AGREE = 65_536, 1_024, 4
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
_SPACE = frozenset(" \t\n\x0b\x0c\r")


class Counter:
    """Counts the tokens of texts by one vocabulary of the tokenizers library that drops white space."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, remember: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.chunk, self.overlap, self.remember = chunk, overlap, remember
        self.known: dict[bytes, int] = {}
        self.widened = 0

    def batch(self, values: list[bytes]) -> list[int]:
        short = [v.split() if len(v) <= self.chunk else [] for v in values]
        new = list({w for words in short for w in words if w not in self.known})
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            encoded = self.library.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            self.known.update(zip(some, map(len, encoded)))
        out = [sum(map(self.known.__getitem__, words)) if len(v) <= self.chunk else self.huge(v.decode()) for v, words in zip(values, short)]
        if len(self.known) > self.remember:
            self.known.clear()
        return out

    def _tokens(self, text: str, start: int, end: int) -> tuple[list[int], list[int]]:
        """Where each token of text[start:end] starts, and its id."""
        e = self.library.encode(text[start:end], add_special_tokens=False)
        return [start + a for a, _ in e.offsets], e.ids

    def huge(self, text: str) -> int:
        """The count for a text of any length."""
        total, cut, n = 0, 0, len(text)
        left, end = self._tokens(text, 0, min(self.chunk, n)), min(self.chunk, n)
        while end < n:
            overlap = self.overlap
            while True:
                start, stop = max(cut, end - overlap), min(n, end + self.chunk)
                right = self._tokens(text, start, stop)
                if start == cut:  # widened over all that is not yet spliced: the right chunk replaces the left
                    left, end = right, stop
                    break
                boundary = self._splice(text, left, right, start, end)
                if boundary is not None:
                    total += sum(cut <= a < boundary for a in left[0])
                    cut, end = boundary, stop
                    keep = next(i for i, a in enumerate(right[0]) if a >= boundary)
                    left = (right[0][keep:], right[1][keep:])
                    break
                overlap *= 4
                self.widened += 1
        return total + len(left[0])

    @staticmethod
    def _splice(text: str, left: tuple, right: tuple, start: int, end: int) -> int | None:
        """The first stable boundary that both encodings of text[start:end] have in common."""
        at = {a: i for i, a in reversed(list(enumerate(left[0]))) if a > start}
        for j, a in enumerate(right[0]):
            if a <= start or a not in at or text[a - 1] not in _SPACE or (j and right[0][j - 1] == a):
                continue
            i = at[a]
            if i + AGREE < len(left[1]) and left[1][i : i + AGREE] == right[1][j : j + AGREE]:
                return a
            if a >= end:
                break
        return None


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; path: a .json file that executors can open."""
    small_batches(docs.sparkSession)

    def run(batches):
        counter = Counter(path, chunk, overlap)
        for b in batches:
            values = texts(b)
            n = counter.batch(values)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, values), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
