"""Substring dedup: near-duplicate passages by compact windows over token min-hashes.

Tokens are lower-cased words, elements are shingles of five of them, and a passage has at least
``least_words`` words. For a hash function, every long enough run of shingles l..r has its least hash at
some place c; all runs with lo <= l <= c <= r <= hi for one c form one compact window. The Cartesian tree
of the hashes gives them: c is the least of lo..hi, and both sides are split likewise until they are
shorter than a passage, so a text of n shingles has about 2n / (t + 1) windows. Runs that are near
duplicates have the same least hash with a chance of their similarity; equal runs always have.

Equal windows of copies of a text are merged within a map task; all others meet by their key. Up to ``FEW`` of
one key are all linked with one another. Windows of a more frequent key go by their texts to a second meeting
(``surroundings``) under the hash of every stretch of ``least_words`` words in which too few functions can have
rare keys, so texts that share a passage word by word always meet; these stretches are equal, so a link to the
first text is enough, and a map task sends only its first on. For passages with edits they meet too under the
shingle with a least hash from either side of it, near by or beyond the frequent shingles; up to ``FEW`` of these
are all linked, more are linked to their predecessor and the first. A key that has over ``FEW`` rows in one map task
is known there to be frequent: its rows are dealt evenly, and one row tells the key's task, so none gathers a
frequent key. Which texts are compared does not depend on how the input is partitioned. Links of two texts are
then joined by place: links whose windows follow one another form a chain, and a chain that ``agree`` different
hash functions or an equal stretch support is verified against the words themselves: its anchors are extended
as far as words agree and past small edits, which gives stretches of equal words in order, and every longest
run of stretches stands whose two passages have shingle sets of Jaccard similarity of at least ``similarity``;
so a chain that joins two passages over other text gives both.

For passages with edits under frequent keys a third meeting follows (``_rest``), in which no group is cut. Two
passages within ``similarity`` have, repeats apart, ``sure_stretch`` shingles in a row in common, so texts with
frequent keys meet under least hashes of shorter stretches that such a row cannot do without. All pairs of a
group are linked and verified but those whose words the passages found before connect already (``_runs``).
So texts and passages are connected as if all pairs of frequent keys were compared; links between texts that are
connected anyway need not all be given, and of a stretch that a text repeats without a break the first and
the last place count. Pairs whose words around the place have too few shingles in common for any passage (``_across``)
are not verified; all others of a group are, so the cost of this meeting may grow with the square of their number.

Texts are known by a hash until they are verified, so equal texts are one text. The result has pairs of
class representatives (the smallest doc_id of each text) with the passage in both, and for membership a
pair (representative, doc_id) over the whole text for every further copy. ``drop_passages`` marks the
words of the larger doc_id. ``by_document`` sums that up in a row for each document.

Edge cases. Null and empty texts and texts under ``least_words`` have no passages. Rows without a doc_id
take no part. Rows that repeat doc_id and text count once. Passages that repeat within one text only are
not pairs. An empty table gives an empty result. Other columns are ignored. ``by_document`` has a row for each
doc_id that is not null; a doc_id with several texts joins their components, and its counts are those of the
text whose class has the smallest id. Documents without a passage are components of their own.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import small_batches, texts
from .common import cut, matched, release, stored, table
from .components import components

SHINGLE, LEAST_WORDS, SIMILARITY = 5, 50, 0.8
HASHES, AGREE = 4, 2
CHUNK, FEW, HELD = 1_000_000, 16, 8192
EXACT, PLACE = 7, 2**30 - 1  # EXACT stands in a link where the function stands, for equal stretches
ROW, PASS, MARK = 0, 1, 2  # kinds of rows: a window, one whose key is known to be frequent, and the word of it for the key's task
NEAR_HASHES = 2
BLOCK = 1000  # texts of one key on either side that a task compares at a time
GAP = 64
STRIDE, CELLS = 32, 1_000_000
EDIT = 3  # words on either side that verification steps over between stretches of equal words
EDITS = sorted(((x, y) for x in range(EDIT + 1) for y in range(EDIT + 1) if x + y), key=lambda e: (max(e), e[0] != e[1], e))
MARGIN = 4  # passages of words on either side of a chain that verification sees; longer agreement has anchors of its own
PAIRS = "doc_id_a bigint, doc_id_b bigint, start_a bigint, end_a bigint, start_b bigint, end_b bigint, similarity double"
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of the shingle that starts at each word."""
    return _shingled(word_hashes(words), shingle)


def _shingled(w: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    n = len(w) - shingle + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = w[:n].copy()
    for k in range(1, shingle):
        h *= _BASE
        h ^= h >> np.uint64(29)
        h += w[k : k + n]
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def salts(hashes: int) -> np.ndarray:
    """An odd multiplier for each hash function."""
    return np.random.default_rng(7).integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def compact_windows(h: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(lo, c, hi), both ends included, of every compact window of at least ``least`` elements."""
    out, todo = [], [(0, len(h))]
    while todo:
        a, b = todo.pop()
        while b - a >= least:
            c = a + int(h[a:b].argmin())
            out.append((a, c, b - 1))
            if b - c > least:
                todo.append((c + 1, b))
            b = c
    return out


def _neighbours(key: np.ndarray, tk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key and tk: the pairs (a, b) of rows with their predecessor or their key's first row, if of another text."""
    group, first, _ = _groups(key)
    at, first = np.arange(len(key)), first[group]
    prev = np.maximum(at - 1, 0)
    near = (at > first) & (tk[prev] != tk)
    star = (first < prev) & (tk[first] != tk) & (tk[first] != tk[prev])
    return np.concatenate((prev[near], first[star])), np.concatenate((at[near], at[star]))


def _pack(c: np.ndarray, j: np.ndarray | int, co: np.ndarray | int) -> np.ndarray:
    """Two places below 2^30, more than a text of 2 GB has words, and a function below 8, in 64 bits."""
    low, mid, high = (np.asarray(x).astype(np.uint64) for x in (j, c, co))
    return (high << np.uint64(34) | mid << np.uint64(4) | low).view(np.int64)


def _unpack(at: int) -> tuple[int, int, int]:
    """(c, co, j) of a packed link."""
    return at >> 4 & PLACE, at >> 34 & PLACE, at & 7


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: the number of each row's group, and each group's first and last row."""
    edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    return np.repeat(np.arange(len(edges) - 1), np.diff(edges)), edges[:-1], edges[1:] - 1


def _once(key: np.ndarray, tk: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the rows sorted by all three differ from their predecessor; copies of a text give equal rows."""
    return np.concatenate(([True], (key[1:] != key[:-1]) | (tk[1:] != tk[:-1]) | (at[1:] != at[:-1])))[: len(key)]


def _frequent(key: np.ndarray, tk: np.ndarray) -> np.ndarray:
    """Which rows, sorted by key and tk, are of a key with more than FEW rows of several texts."""
    group, first, last = _groups(key)
    return ((last - first >= FEW) & (tk[first] != tk[last]))[group]


def _all_pairs(key: np.ndarray, tk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of one key and two texts, of rows sorted by key whose groups are of FEW rows or of one text."""
    a, b = [np.empty(0, int)], [np.empty(0, int)]
    for step in range(1, FEW):
        at = np.flatnonzero((key[step:] == key[:-step]) & (tk[step:] != tk[:-step]))
        a.append(at)
        b.append(at + step)
    return np.concatenate(a), np.concatenate(b)


def _batch(a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Links (a, b, at) with a < b; at packs both places."""
    low = a < b
    at = _pack(np.where(low, ca, cb), j, np.where(low, cb, ca))
    return pa.RecordBatch.from_arrays([pa.array(np.where(low, a, b)), pa.array(np.where(low, b, a)), pa.array(at)], ["a", "b", "at"])


def combine(key: np.ndarray, j: np.ndarray, tk: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    """The windows of part of a map task as rows of windows()."""
    order = np.argsort(key, kind="stable")
    key, tk, at = key[order], tk[order], _pack(c[order], j[order], 0)
    group, first, last = _groups(key)
    several = (last > first)[group]
    rows = [(key[~several], tk[~several], at[~several], np.full((~several).sum(), ROW, np.int8))]
    key, tk, at = key[several], tk[several], at[several]
    if len(key):
        order = np.lexsort((at, tk, key))
        key, tk, at = key[order], tk[order], at[order]
        once = _once(key, tk, at)
        key, tk, at = key[once], tk[once], at[once]
        often = _frequent(key, tk)
        rows.append((key[~often], tk[~often], at[~often], np.full((~often).sum(), ROW, np.int8)))
        key, tk, at = key[often], tk[often], at[often]
        if len(key):
            first = _groups(key)[1]
            place = ((key.view(np.uint64) * _BASE) ^ tk.view(np.uint64)) * _MIX  # these rows need no place; this deals them evenly
            rows += [(place.view(np.int64), tk, at, np.full(len(tk), PASS, np.int8)), (key[first], tk[first], at[first], np.full(len(first), MARK, np.int8))]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows)], ["key", "tk", "at", "kind"])


def windows(keyed: DataFrame, least_words: int = LEAST_WORDS, hashes: int = HASHES) -> DataFrame:
    """(key, tk, at, kind) of the compact windows of every text; key is the function's least hash.

    at packs the window's place and function (below EXACT)."""
    assert hashes <= EXACT
    least, mult = least_words - SHINGLE + 1, salts(hashes)

    def run(batches):
        held, size = [], 0
        for b in batches:
            for tk, text in zip(b.column(0).to_pylist(), texts(b)):
                x = shingle_hashes(text.lower().split())
                if len(x) < least:
                    continue
                for j, m in enumerate(mult):
                    h = x * m
                    h ^= h >> np.uint64(31)
                    c = np.array([w[1] for w in compact_windows(h, least)])
                    key = ((h[c] + np.uint64(j)) * _MIX).view(np.int64)
                    held.append((key, np.full(len(c), j, np.int8), np.full(len(c), tk), c.astype(np.int32)))
                    size += len(c)
            if size >= CHUNK:
                yield combine(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if held:
            yield combine(*map(np.concatenate, zip(*held)))

    return keyed.select("tk", "text").mapInArrow(run, "key bigint, tk bigint, at bigint, kind tinyint")


def _by_key(batches, judge):
    """judge(columns) for tables of whole groups, of batches that are sorted by their first column."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        held.append(tuple(x.to_numpy(zero_copy_only=False) for x in batch.columns))
        size += batch.num_rows
        if size >= HELD:
            cols = [np.concatenate(x) for x in zip(*held)]
            cut_at = int(np.searchsorted(cols[0], cols[0][-1]))  # the last group may go on
            if cut_at:
                yield from judge(*(x[:cut_at] for x in cols))
            held = [tuple(x[cut_at:] for x in cols)]
            size = 0
    if held and sum(len(x[0]) for x in held):
        yield from judge(*(np.concatenate(x) for x in zip(*held)))


def _sorted(found: DataFrame, run, schema: str, *columns: str) -> DataFrame:
    parts = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    return found.repartition(parts, columns[0]).sortWithinPartitions(*columns).mapInArrow(run, schema)


def _links(found: DataFrame) -> DataFrame:
    """(a, b, at): windows of one key in two texts a < b, at packs both places; and with no b the windows of frequent keys.

    Sorted by a within a task, which packs well as a table."""

    def judge(key, tk, at, kind):
        group = _groups(key)[0]
        often = np.zeros(group[-1] + 1, bool)
        often[group[kind == MARK]] = True
        out = [(tk[kind == PASS], at[kind == PASS])]
        rows = kind == ROW
        key, tk, at, often = key[rows], tk[rows], at[rows], often[group[rows]]
        if len(key):
            once = _once(key, tk, at)
            key, tk, at, often = key[once], tk[once], at[once], often[once]
            often |= _frequent(key, tk)
            out.append((tk[often], at[often]))
            key, tk, at = key[~often], tk[~often], at[~often]
            a, b = _all_pairs(key, tk)
            if len(a):
                yield _batch(tk[a], tk[b], at[a] >> 4, at[b] >> 4, at[a] & 7)
        tk, at = map(np.concatenate, zip(*out))
        if len(tk):
            yield pa.RecordBatch.from_arrays([pa.array(tk), pa.nulls(len(tk), pa.int64()), pa.array(at)], ["a", "b", "at"])

    return _sorted(found, lambda batches: _by_key(batches, judge), "a bigint, b bigint, at bigint", "key", "tk", "at", "kind").sortWithinPartitions("a", "b")


def _stretch_hashes(x: np.ndarray, least: int) -> np.ndarray:
    """A hash of the least elements from each place on, by doubling."""
    span = 1
    while span * 2 <= least:
        x = (x[:-span] * _BASE ^ x[:-span] >> np.uint64(31)) + x[span:]
        span *= 2
    n = len(x) - (least - span)
    return ((x[:n] * _MIX ^ x[:n] >> np.uint64(29)) + x[least - span :]) * _BASE


def surroundings(x: np.ndarray, anchors: list[tuple[int, int]], least: int, rare: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sub, j, place): the keys under which the anchors (c, j) of a text with shingle hashes x meet again.

    Equal stretches need a key only where more than ``rare`` functions may have a frequent key; else enough
    others agree on them by their own keys."""
    cs = np.unique([c for c, _ in anchors])
    functions = np.zeros(len(x), np.int32)  # how many have anchors in the stretch from each place on
    for j in {j for _, j in anchors}:
        of = np.array([c for c, k in anchors if k == j])
        inside = np.zeros(len(x) + 1, np.int32)
        np.add.at(inside, np.maximum(of - least + 1, 0), 1)
        np.add.at(inside, of + 1, -1)
        functions += inside.cumsum()[:-1] > 0
    at = np.flatnonzero(functions[: len(x) - least + 1] > rare)
    rows = [(_stretch_hashes(x, least)[at], np.full(len(at), EXACT), at)]
    zone = np.zeros(len(x), bool)  # anchors and what lies between near ones: what a frequent line leaves of itself
    zone[cs] = True
    for a, b in zip(cs, cs[1:]):
        if b - a <= least // 2:
            zone[a:b] = True
    near = []
    for m in salts(EXACT + NEAR_HASHES)[EXACT:]:
        h = x * m
        h ^= h >> np.uint64(31)
        far = np.where(zone, np.uint64(2**64 - 1), h)
        near += [(h, least // 2), (far, least - 1)]
    c, j = np.array(anchors, np.int64).T
    at = np.concatenate((np.zeros(least - 1, np.int32), functions))
    alone = at[c[:, None] + np.arange(least)].max(axis=1) < 2
    none = np.uint64(2**64 - 1)
    for k, (h, reach) in enumerate(near):
        edge = np.full(reach, none)
        h = np.concatenate((edge, h, edge))
        for side, first in enumerate((0, reach + 1)):
            v = h[c[:, None] + (first + np.arange(reach))].min(axis=1)
            ok = (v < none) & ~(alone & (k > 0))
            sub = v[ok] + x[c[ok]] * (16 * k + 8 * side + 3 + j[ok]).astype(np.uint64)
            rows.append((sub * _MIX, j[ok], c[ok]))
    return tuple(map(np.concatenate, zip(*rows)))


def _combine_equal(sub: np.ndarray, j: np.ndarray, tk: np.ndarray, c: np.ndarray, least: int) -> pa.RecordBatch:
    """Part of a map task's rows (key, tk, at, other): of equal stretches the first text's, and links from it (other <> tk) to the rest."""
    at = _pack(c, j, 0)
    order = np.lexsort((at, tk, sub))
    sub, tk, at = sub[order], tk[order], at[order]
    once = _once(sub, tk, at)
    sub, tk, at = sub[once].view(np.int64), tk[once], at[once]
    group, first, _ = _groups(sub)
    first = first[group]
    goes = (at & 7 != EXACT) | (tk == tk[first])
    rows = [(sub[goes], tk[goes], at[goes], tk[goes])]
    b = np.flatnonzero(~goes)
    a = first[b]
    if len(b):
        pa_, pb = at[a] >> 4, at[b] >> 4
        order = np.lexsort((pa_, pa_ - pb, tk[b], tk[a]))
        a, b, pa_, pb = a[order], b[order], pa_[order], pb[order]
        goes_on = (tk[a][1:] == tk[a][:-1]) & (tk[b][1:] == tk[b][:-1]) & (pa_[1:] == pa_[:-1] + 1) & (pb[1:] == pb[:-1] + 1)
        within = np.concatenate(([False], goes_on)) & np.concatenate((goes_on, [False]))
        keep = ~within | (pa_ % least == 0)  # of links along one stretch the ends, and some between
        a, b, pa_, pb = a[keep], b[keep], pa_[keep], pb[keep]
        place = ((tk[a].view(np.uint64) * _BASE) ^ tk[b].view(np.uint64)) * _MIX
        rows.append((place.view(np.int64), tk[a], _pack(pa_, EXACT, pb), tk[b]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows)], ["key", "tk", "at", "other"])


def _surrounding_links(anchored: DataFrame, least_words: int, rare: int) -> DataFrame:
    """(a, b, at) like _links, of the anchors of frequent keys. anchored: tk, text, anchors."""
    least = least_words - SHINGLE + 1

    def meet(batches):
        held, size = [], 0
        for b in batches:
            for tk, text, anchors in zip(b.column(0).to_pylist(), texts(b), b.column(2).to_pylist()):
                sub, j, c = surroundings(shingle_hashes(text.lower().split()), [(x >> 4 & PLACE, x & 7) for x in anchors], least, rare)
                held.append((sub, j, np.full(len(sub), tk), c))
                size += len(sub)
            if size >= CHUNK:
                yield _combine_equal(*map(np.concatenate, zip(*held)), least)
                held, size = [], 0
        if held:
            yield _combine_equal(*map(np.concatenate, zip(*held)), least)

    def judge(key, tk, at, other):
        done = tk != other
        if done.any():
            yield _batch(tk[done], other[done], at[done] >> 4 & PLACE, at[done] >> 34 & PLACE, at[done] & 7)
        key, tk, at = key[~done], tk[~done], at[~done]
        if not len(key):
            return
        once = _once(key, tk, at)
        key, tk, at = key[once], tk[once], at[once]
        group, first, _ = _groups(key)
        first = first[group]
        exact, often = at & 7 == EXACT, _frequent(key, tk)
        star = np.flatnonzero(exact & (tk != tk[first]))
        pairs = [(tk[first[star]], tk[star], at[first[star]], at[star])]
        for which, of in ((~exact & often, _neighbours), (~exact & ~often, _all_pairs)):
            k, t, p = key[which], tk[which], at[which]
            if len(k):
                a, b = of(k, t)
                pairs.append((t[a], t[b], p[a], p[b]))
        a, b, x, y = map(np.concatenate, zip(*pairs))
        if len(a):
            yield _batch(a, b, x >> 4, y >> 4, x & 7)

    rows = anchored.select("tk", "text", "anchors").mapInArrow(meet, "key bigint, tk bigint, at bigint, other bigint")
    return _sorted(rows, lambda batches: _by_key(batches, judge), "a bigint, b bigint, at bigint", "key", "tk", "at")


def sure_stretch(least: int, similarity: float) -> int:
    """How many shingles in a row two passages of at least least shingles have in common at least, repeats apart.

    Of n shingles up to k = n (1 - s) / (1 + s) may be missing; an edit between two common shingles takes SHINGLE, so that
    the others lie in k // SHINGLE + 1 stretches."""
    missing = [(n, int(n * (1 - similarity) / (1 + similarity) + 1e-9)) for n in range(least, 8 * least)]
    return max(1, min(-(-(n - k) // (k // SHINGLE + 1)) for n, k in missing))


def picked(x: np.ndarray, span: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sub, place) of stretches of span elements: the least hash of every window of them, so that equal stretches of span + window - 1 elements share one.

    Places of one hash no more than span apart are a stretch repeated without a break; of these the first and the last stand."""
    if len(x) < span:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = _stretch_hashes(x, span)
    window = min(window, len(h))
    views = np.lib.stride_tricks.sliding_window_view(h, window)
    at = np.unique(views.argmin(axis=1) + np.arange(len(views)))
    at = at[np.argsort(h[at], kind="stable")]
    on = (h[at][1:] == h[at][:-1]) & (np.diff(at) <= span)
    at = at[~(np.concatenate(([False], on)) & np.concatenate((on, [False])))]
    return h[at], at


def _around(words: np.ndarray, at: np.ndarray, span: int, reach: int) -> np.ndarray:
    """For each place the words of the stretch of span shingles there and of reach more on either side, as they are numbered; 0 beyond the text."""
    width = span + SHINGLE - 1 + 2 * reach
    edge = np.zeros(reach, words.dtype)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((edge, words, edge)), width)[at]


def _fewest(code: np.ndarray, least: int, span: int) -> np.ndarray:
    """For each row of shingles, 0 beyond the text: how many different ones a run of least of them has at least that holds the span in the middle."""
    n, width = code.shape
    order = np.argsort(code, axis=1, kind="stable")
    inner = np.take_along_axis(code, order, 1)
    last = np.full((n, width), -1)  # where each shingle stood before
    np.put_along_axis(last, order[:, 1:], np.where(inner[:, 1:] == inner[:, :-1], order[:, :-1], -1), 1)
    last[code == 0] = width + least  # no run may hold these
    middle, out = (width - span) // 2, np.full(n, 2 * width)
    for p in range(max(0, middle + min(span - least, 0)), middle + 1):
        run = last[:, p : p + least]
        out = np.where((run > width).any(axis=1), out, np.minimum(out, (run < p).sum(axis=1)))
    return out


def _codes(around: np.ndarray) -> np.ndarray:
    """Hashes of 40 bits of the shingles of rows of _around(), 0 beyond the text."""
    n, width = len(around), around.shape[1] - SHINGLE + 1
    code, whole = np.zeros((n, width), np.uint64), np.ones((n, width), bool)
    for k in range(SHINGLE):
        code = code * _BASE + around[:, k : k + width]
        whole &= around[:, k : k + width] > 0
    code = np.maximum((code ^ code >> np.uint64(29)) * _MIX >> np.uint64(24), np.uint64(1))
    code[~whole] = 0
    return code


def _in_common(around: np.ndarray, least: int, span: int):
    """Rows of _around(): a function that counts the common shingles of rows lo to hi and every row, _fewest() of each row, and which rows repeat a shingle."""
    n, width = len(around), around.shape[1] - SHINGLE + 1
    code = _codes(around)
    whole = code > 0
    low = np.uint64(2**24 - 1)
    both = np.sort((code << np.uint64(24) | np.arange(n, dtype=np.uint64)[:, None])[whole])
    again = both[1:] == both[:-1]
    repeats, fewest = np.zeros(n, bool), np.full(n, least)
    repeats[(both[1:][again] & low).astype(int)] = True
    fewest[repeats] = _fewest(code[repeats], least, span)
    both = both[np.concatenate(([True], ~again))[: len(both)]]
    value = both >> np.uint64(24)
    same = np.concatenate(([False], value[1:] == value[:-1], [False]))[: len(value) + 1]
    several = same[:-1] | same[1:]
    row, column = (both[several] & low).astype(int), (~same[:-1])[several].cumsum() - 1
    columns = int(column[-1]) + 1 if len(column) else 0
    some = max(1, 4 * CELLS // n)

    def count(lo, hi):
        out = np.zeros((hi - lo, n), np.float32)
        for c in range(0, columns, some):
            held = slice(*np.searchsorted(column, (c, c + some)))
            m = np.zeros((n, min(some, columns - c)), np.float32)
            m[row[held], column[held] - c] = 1
            out += m[lo:hi] @ m.T
        return out

    return count, fewest, repeats


def _in_a_passage(around: np.ndarray, before: np.ndarray, after: np.ndarray, least: int, span: int, similarity: float):
    """Rows of _around(), and how many shingles their texts have before and after these: a function that gives those of rows b that may be in one passage with row a.

    Passages X and Y of that similarity that hold the place have (1 + s) c >= s (|X| + |Y|), c shingles in common. From the first
    to the last common one that neither row repeats, X and Y have as many as these lie apart, less the repeats, and c is no more
    than the common ones between and those that a row repeats. So some first and last one must fulfil this, or the passages lie
    within fewer than least shingles of b, of which enough are common, as |X| and |Y| count least. What lies beyond the rows counts as
    common; an edit may shift one text over the edge of its row against the other."""
    code = _codes(around)
    n, width = code.shape
    value, ids = np.unique(np.concatenate((np.zeros(1, np.uint64), code.ravel())), return_inverse=True)
    ids = ids[1:].reshape(n, width)  # 0 beyond the text
    order = np.argsort(ids, axis=1, kind="stable")
    inner = np.take_along_axis(ids, order, 1)
    same = (inner[:, 1:] == inner[:, :-1]) & (inner[:, 1:] > 0)
    again, several, none = np.zeros((n, width), bool), np.zeros((n, width), bool), np.zeros((n, 1), bool)
    np.put_along_axis(again, order, np.hstack((none, same)), 1)
    np.put_along_axis(several, order, np.hstack((none, same)) | np.hstack((same, none)), 1)
    copies = again.sum(axis=1)
    s, reach = np.float32(similarity), (width - span) // 2
    end, q, inside = reach + span - 1, np.arange(width), slice(reach, reach + span)
    to = q[end:] - least + 1  # the last place where a run up to q may begin
    to = np.where(to < 0, -1, np.minimum(to, reach))
    place, twice = np.full(len(value), -1), np.zeros(len(value), bool)

    def edge(x, y):
        return np.where(np.maximum(x, y) > 0, (1 - s) * np.minimum(x, y) + (1 + s) * SHINGLE, -np.inf).astype(np.float32)

    def judge(a, b):
        place[ids[a]], twice[ids[a][several[a]]] = q, True
        place[0] = -1
        p = place[ids[b]]
        common = p >= 0
        alone = common & ~several[b] & ~twice[ids[b]]
        more = (common & ~alone & ~again[b]).sum(axis=1)
        place[ids[a]], twice[ids[a]] = -1, False
        alone[:, inside], p[:, inside] = True, q[inside]
        count = alone.cumsum(axis=1)
        score = (1 + s) * count.astype(np.float32) - s * (p + q)
        first = np.where(alone & (p <= reach), -score, -np.inf)[:, : reach + 1]
        first[:, 0] = np.maximum(first[:, 0], edge(before[a], before[b]) - (1 + s))
        last = np.where(alone & (p >= end), score, -np.inf)[:, end:]
        last[:, -1] = np.maximum(last[:, -1], (1 + s) * count[:, -1] - 2 * s * (width - 1) + edge(after[a], after[b]))
        repeats = copies[a] + copies[b]
        ok = (last + np.maximum.accumulate(first, axis=1)[:, to])[:, to >= 0].max(axis=1, initial=-np.inf) + (1 - s) + (1 + s) * more + s * repeats >= -0.01
        held = np.pad(count, ((0, 0), (1, 0)))
        low = np.arange(max(0, end - least + 2), reach + 1)
        ok |= (held[:, np.minimum(low + least - 1, width)] - held[:, low]).max(axis=1) + more >= s * (2 * least - repeats) / (1 + s) - 0.01
        return b[ok]

    return judge


def _across(key, deal, grid, tk, at, root, after, around, least, span, similarity):
    """Links of the pairs of one key, two texts and two roots, of rows sorted by key; in a cell off the grid's diagonal between its two sides.

    Passages X and Y of that similarity have (1 + similarity) |X & Y| >= similarity (|X| + |Y|), as sets of shingles. Rows whose
    common shingles around the place are too few for the fewest that X and Y may have are in no passage there. Where a row repeats
    shingles, a passage may go on by the same ones to others far away, so that such rows are left out if fewer than SHINGLE are common.
    All others are linked that _in_a_passage() leaves."""
    held, size, share = [], 0, similarity / (1 + similarity)

    for f, n in zip(*_groups(key)[1:]):
        rows = slice(f, n + 1)
        if root[rows].min() == root[rows].max() or tk[rows].min() == tk[rows].max():
            continue
        _, of, size_of = np.unique(root[rows], return_inverse=True, return_counts=True)
        rows = f + np.argsort(of == size_of.argmax(), kind="stable")  # rows of the most frequent root come last, as they have no pairs with one another
        d, g, t, p, r, behind = (v[rows] for v in (deal, grid, tk, at, root, after))
        words = np.frombuffer(b"".join(around[rows]), np.uint16).reshape(len(t), -1)
        count, fewest, repeats = _in_common(words, least, span)
        judge = None
        some = max(1, 4 * CELLS // len(t))
        for lo in range(0, len(t), some):
            x = slice(lo, min(lo + some, len(t)))
            pair = (t[x, None] != t) & (r[x, None] != r) & (~g[x, None] | (d[x, None] != d)) & (np.arange(len(t)) > np.arange(x.start, x.stop)[:, None])
            if pair.any():
                common = count(x.start, x.stop)
                pair &= (common >= share * (fewest[x, None] + fewest) - 1e-6) | ((repeats[x, None] | repeats) & (common >= SHINGLE))
                reach = (words.shape[1] - SHINGLE + 1 - span) // 2
                judge = judge or _in_a_passage(words, np.maximum(p - reach, 0), behind, least, span, similarity)
            for a in np.flatnonzero(pair.any(axis=1)):
                for b in np.array_split(np.flatnonzero(pair[a]), -(-pair[a].sum() // BLOCK)):
                    b = judge(a + lo, b)
                    held.append((np.full(len(b), t[a + lo]), t[b], np.full(len(b), p[a + lo]), p[b]))
                    size += len(b)
            if size >= CHUNK // 4:
                yield _batch(*map(np.concatenate, zip(*held)), EXACT)
                held, size = [], 0
    if size:
        yield _batch(*map(np.concatenate, zip(*held)), EXACT)


def _runs(sure: DataFrame) -> DataFrame:
    """(id, runs): the words of a text in passages found so far, as runs (start, end, root), in order; runs that passages connect have one root."""
    link = F.xxhash64(*sure.columns).alias("link")
    sides = [sure.select(link, *(F.col(f"{c}_{x}").alias(n) for c, n in (("doc_id", "id"), ("start", "start"), ("end", "end")))) for x in "ab"]
    by = Window.partitionBy("id").orderBy("start", "end")
    each = sides[0].union(sides[1]).withColumn("reach", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), F.col("start"))
    each = each.withColumn("run", F.last(new, True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    each = cut(each.select("link", "id", "start", "end", F.shiftright(F.xxhash64("id", "run"), 2).alias("node")))  # sums of two must not overflow
    roots = components(each.groupBy("link").agg(F.min("node").alias("a"), F.max("node").alias("b"))).select(F.col("a").alias("node"), F.col("b").alias("root"))
    runs = each.groupBy("id", "node").agg(F.min("start").alias("start"), F.max("end").alias("end")).join(roots, "node", "left")
    return runs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end", F.coalesce("root", "node").alias("root")))).alias("runs"))


def _rest(anchored: DataFrame, least_words: int, similarity: float) -> DataFrame:
    """(a, b, at) like _links: of texts with frequent keys, stretches that all near-duplicate passages have in common, where the passages found so far do not connect them.

    anchored: tk, text, runs."""
    least = least_words - SHINGLE + 1
    sure = sure_stretch(least, similarity)
    span = -(-2 * sure // 3) + 1
    reach = least_words + GAP + least  # beyond what a chain may leave out between two anchors, a passage more

    def keys(batches):
        """Rows of picked places, and one of each text's words, two bytes each."""
        for b in batches:
            out = []
            for tk, text, runs in zip(b.column(0).to_pylist(), texts(b), b.column(2)):
                words = word_hashes(text.lower().split())
                sub, at = picked(_shingled(words), span, sure - span + 1)
                if not len(at):
                    continue
                root = np.full(len(at), tk)
                if runs.is_valid and len(runs):
                    start, end, of = (runs.values.field(i).to_numpy() for i in range(3))
                    middle = at + (span + SHINGLE) // 2
                    run = np.searchsorted(start, middle, "right") - 1
                    root = np.where((run >= 0) & (middle < end[run]), of[run], root)
                out.append((sub, np.full(len(at), tk), at, root, (words % np.uint64(65535) + np.uint64(1)).astype(np.uint16).tobytes()))
            if out:
                *places, words = zip(*out)
                sub, tk, at, root = map(np.concatenate, places)
                names = ["key", "tk", "at", "root", "words"]
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (sub.view(np.int64), tk, at.astype(np.int64), root)), pa.nulls(len(at), pa.binary())], names)
                none = pa.nulls(len(words), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array([x[0] for x in places[1]]), none, none, pa.array(words, pa.binary())], names)

    def cut_out(batches):
        for b in batches:
            key, at, root, sides = b.column(0).flatten().flatten()
            n = np.diff(b.column(0).offsets.to_numpy())
            tk = np.repeat(b.column(2).to_numpy(), n)
            parts = np.split(at.to_numpy(), n.cumsum()[:-1])
            numbered = [np.frombuffer(x, np.uint16) for x in b.column(1).to_pylist()]
            around = [x.tobytes() for words, of in zip(numbered, parts) for x in _around(words, of, span, reach)]
            after = [np.maximum(len(words) - SHINGLE + 1 - span - reach - of, 0) for words, of in zip(numbered, parts)]
            yield pa.RecordBatch.from_arrays([key, pa.array(tk), at, root, sides, pa.array(np.concatenate(after), pa.int32()), pa.array(around, pa.binary())], ["key", "tk", "at", "root", "sides", "after", "around"])

    each = stored(anchored.select("tk", "text", "runs").mapInArrow(keys, "key bigint, tk bigint, at bigint, root bigint, words binary"))
    sizes = each.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key", F.ceil(F.col("n") / BLOCK).alias("sides"))
    met = each.select("key", "tk", "at", "root").join(sizes, "key").groupBy("tk").agg(F.collect_list(F.struct("key", "at", "root", "sides")).alias("places"))
    around = met.join(each.where("words is not null").select("tk", "words"), "tk").select("places", "words", "tk").mapInArrow(cut_out, "key bigint, tk bigint, at bigint, root bigint, sides bigint, after int, around binary")
    # A key of more than BLOCK rows is compared in cells of a grid, each by itself.
    cells = around.select("key", F.pmod(F.xxhash64("tk"), "sides").alias("deal"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)).alias("with"), "tk", "at", "root", "after", "around")
    cells = cells.select(F.xxhash64("key", F.least("deal", "with"), F.greatest("deal", "with")).alias("key"), "deal", (F.col("deal") != F.col("with")).alias("grid"), "tk", "at", "root", "after", "around")
    return _sorted(cells, lambda batches: _by_key(batches, lambda *rows: _across(*rows, least, span, similarity)), "a bigint, b bigint, at bigint", "key")


def _chains(anchors: list[tuple[int, int, int]], least: int) -> list[list[tuple[int, int, int]]]:
    """Anchors (ca, cb, j) in chains of neighbours whose diagonals hardly move."""
    chains: list[list[tuple[int, int, int]]] = []
    open_: list[list[tuple[int, int, int]]] = []
    for x in sorted(set(anchors)):
        open_ = [c for c in open_ if x[0] - c[-1][0] <= least + GAP]
        for c in open_:
            last = c[-1]
            step = x[0] - last[0]
            if abs((x[0] - x[1]) - (last[0] - last[1])) <= 4 + step // 5 and x[1] >= last[1]:
                c.append(x)
                break
        else:
            open_.append([x])
            chains.append(open_[-1])
    return chains


def _shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return set(zip(*(words[k:] for k in range(SHINGLE))))


def _similar(a: list[bytes], b: list[bytes]) -> float:
    x, y = _shingles(a), _shingles(b)
    both = len(x & y)
    return both / max(1, len(x) + len(y) - both)


def _resume(a: list[bytes], b: list[bytes], pa: int, pb: int, step: int, ends: tuple[int, int], need: int) -> tuple[int, int] | None:
    """The nearest places past an edit at pa and pb, up to EDIT words a side, from which need words agree in the direction of step."""
    back = need - 1 if step < 0 else 0
    for da, db in EDITS if need > 1 else EDITS[:1]:
        x, y = pa + step * da, pb + step * db
        if step * (ends[0] - x) < need - 1 or step * (ends[1] - y) < need - 1 or a[x] != b[y]:
            continue
        if a[x - back : x - back + need] == b[y - back : y - back + need]:
            return x, y
    return None


def _walk(a: list[bytes], b: list[bytes], pa: int, pb: int, step: int, ends: tuple[int, int], need: int) -> list[tuple[int, int, int, int]]:
    """Stretches (first a, last a, first b, last b) of equal words from pa and pb on, no farther than ends."""
    out = []
    at: tuple[int, int] | None = (pa, pb)
    while at is not None:
        x, y = at
        left = min(step * (ends[0] - x), step * (ends[1] - y))
        while left >= STRIDE:  # whole slices while they agree
            low = (1, 1 + STRIDE) if step > 0 else (-STRIDE, 0)
            if a[x + low[0] : x + low[1]] != b[y + low[0] : y + low[1]]:
                break
            x, y, left = x + step * STRIDE, y + step * STRIDE, left - STRIDE
        while left > 0 and a[x + step] == b[y + step]:
            x, y, left = x + step, y + step, left - 1
        out.append((min(at[0], x), max(at[0], x), min(at[1], y), max(at[1], y)))
        at = _resume(a, b, x + step, y + step, step, ends, need)
    return out


def _stretches(a: list[bytes], b: list[bytes], chain: list[tuple[int, int, int]], need: int) -> list[tuple[int, int, int, int]]:
    """Disjoint stretches of equal words (start_a, end_a, start_b, end_b) in order: through the chain's anchors, and past small edits around each."""
    out: list[tuple[int, int, int, int]] = []
    for ca, cb, _ in chain:
        floor = (out[-1][1], out[-1][3]) if out else (0, 0)
        if ca < floor[0] or cb < floor[1] or a[ca : ca + SHINGLE] != b[cb : cb + SHINGLE]:
            continue
        left = _walk(a, b, ca, cb, -1, floor, need)
        right = _walk(a, b, ca, cb, 1, (len(a) - 1, len(b) - 1), need)
        middle = (left[0][0], right[0][1], left[0][2], right[0][3])
        out += [(sa, ea + 1, sb, eb + 1) for sa, ea, sb, eb in (*left[:0:-1], middle, *right[1:])]
    return out


def _judge(a: list[bytes], b: list[bytes], parts: list[tuple[int, int, int, int]], least_words: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """The longest runs of neighbouring stretches that are passages, none inside another."""
    if not parts or min(parts[-1][1] - parts[0][0], parts[-1][3] - parts[0][2]) < least_words:
        return []
    sa, ea, sb, eb = np.array(parts, np.int64).T
    common = np.concatenate(([0], np.cumsum(np.maximum(ea - sa - SHINGLE + 1, 0))))
    found: list[tuple[int, int, int, int, float]] = []
    reach, n, low, rows = -1, len(parts), 0, 1
    if common[-1] * (1 + similarity) < 2 * similarity * (least_words - SHINGLE + 1):  # too little for any run; repeats may still make the whole similar
        s = _similar(a[sa[0] : ea[-1]], b[sb[0] : eb[-1]])
        return [(int(sa[0]), int(ea[-1]), int(sb[0]), int(eb[-1]), s)] if s >= similarity else []
    while low < n and reach < n - 1:  # some first stretches at once, against all last ones that may still count
        first = max(low, reach + 1)
        i, to = np.arange(low, min(n, low + rows))[:, None], np.arange(first, n)
        na, nb = ea[first:] - sa[i], eb[first:] - sb[i]
        both = common[first + 1 :] - common[i]
        long = (np.minimum(na, nb) >= least_words) & (to >= i)
        fits = long & (both >= similarity * (na + nb - 2 * (SHINGLE - 1) - both))  # repeats in a passage apart, this is the Jaccard similarity
        if low == 0:
            fits[0, -1] = long[0, -1]
        for r in np.flatnonzero(fits.any(axis=1)).tolist():
            for k in to[fits[r]][::-1].tolist():
                if k <= reach:
                    break
                x, y = a[sa[low + r] : ea[k]], b[sb[low + r] : eb[k]]
                s = 1.0 if x == y else _similar(x, y)
                if s >= similarity:
                    found.append((int(sa[low + r]), int(ea[k]), int(sb[low + r]), int(eb[k]), s))
                    reach = k
                    break
        low += rows
        rows = max(1, min(4 * rows, CELLS // n))
    return found


def passages(a: list[bytes], b: list[bytes], chain: list[tuple[int, int, int]], least_words: int, similarity: float, every: bool = False) -> list[tuple[int, int, int, int, float]]:
    """(start_a, end_a, start_b, end_b, similarity) of the passages that a chain of anchors leads to.

    They begin and end with equal words. Past the outermost anchors small edits are stepped over where
    SHINGLE words agree behind them, or for passages that would else be too short, one word. With ``every``
    anchors outside the passages found go on to be tried, by their diagonals and with one word."""
    found: set[tuple[int, int, int, int, float]] = set()
    for need in (SHINGLE, 1):
        judged = set()
        by_diagonal = defaultdict(list)
        for x in chain:
            by_diagonal[x[0] - x[1]].append(x)
        for ways in ([chain], by_diagonal.values() if len(by_diagonal) > 1 else []):
            for part in ways:
                parts = _stretches(a, b, part, need)
                if tuple(parts) not in judged:  # diagonals near each other often lead to the same stretches
                    judged.add(tuple(parts))
                    found.update(_judge(a, b, parts, least_words, similarity))
            if found:
                chain = [x for x in chain if not any(sa <= x[0] < ea and sb <= x[1] < eb for sa, ea, sb, eb, _ in found)] if every else []
                if not chain:
                    return sorted(found)
    return sorted(found)


def _found(docs: DataFrame, least_words: int, similarity: float, hashes: int, agree: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of class representatives and the passages that they share (PAIRS); the documents (doc_id, tk, words); the classes (tk, id, words, n)."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tk"))
    # Both joins of the verification with texts are on both columns and belong to one query, so that they share one exchange.
    texts_of = lambda x: keyed.select(F.col("doc_id").alias(f"id_{x}"), F.col("tk").alias(x), F.col("text").alias(f"text_{x}"))
    side = lambda x: classes.select(F.col("tk").alias(x), F.col("id").alias(f"id_{x}"))

    def count(batches):
        for b in batches:
            words = [len(x.split()) for x in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.int32())], ["doc_id", "tk", "words"])

    ids = stored(keyed.select("doc_id", "tk", "text").mapInArrow(count, "doc_id bigint, tk bigint, words int"))
    classes = ids.groupBy("tk").agg(F.min("doc_id").alias("id"), F.max("words").alias("words"), F.count("*").alias("n"))

    met = stored(_links(windows(keyed, least_words, hashes)))
    release(docs.sparkSession)
    often = met.where("b is null").groupBy("a").agg(F.collect_set("at").alias("anchors")).withColumnRenamed("a", "o").join(side("o"), "o")
    anchored = often.join(texts_of("o"), ["id_o", "o"]).select(F.col("o").alias("tk"), F.col("text_o").alias("text"), "anchors", "id_o")
    links = met.where("b is not null").unionByName(_surrounding_links(anchored, least_words, max(0, hashes - agree)))
    lists = links.groupBy("a", "b").agg(F.collect_set("at").alias("anchors"))
    functions = F.array_distinct(F.transform("anchors", lambda x: x.bitwiseAND(7)))
    pairs = stored(lists.where((F.size(functions) >= agree) | F.array_contains(functions, F.lit(EXACT).cast("long"))))
    release(docs.sparkSession)
    margin = MARGIN * least_words

    def clip(batches):
        """A row for each chain that enough functions support, with a's words in and around it."""
        seen, words = None, []
        for b in batches:
            out = []
            for ia, ib, tb, text, anchors in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), texts(b, "text_a"), b.column(4).to_pylist()):
                if ia != seen:  # rows of one text follow one another
                    seen, words = ia, text.lower().split()
                for chain in _chains([_unpack(x) for x in anchors], least_words):
                    functions = {j for _, _, j in chain}
                    if len(functions) >= agree or EXACT in functions:
                        at = max(0, chain[0][0] - margin)
                        ca, cb, js = zip(*chain)
                        out.append((ia, ib, tb, at, b" ".join(words[at : chain[-1][0] + SHINGLE + margin]), ca, [y - x for x, y in zip(ca, cb)], js))
            if out:
                kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int8())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id_a", "id_b", "b", "at", "words", "ca", "off", "js"])

    def verify(batches):
        seen, words = None, []
        for b in batches:
            out = []
            for ia, ib, at, part, text, ca, off, js in zip(*(b.column(i).to_pylist() for i in range(4)), texts(b, "text_b"), *(b.column(i).to_pylist() for i in range(5, 8))):
                if ib != seen:
                    seen, words = ib, text.lower().split()
                chain = [(x - at, x + y, j) for x, y, j in zip(ca, off, js)]
                for sa, ea, sb, eb, s in passages(part.split(), words, chain, least_words, similarity):
                    sa, ea = sa + at, ea + at
                    out.append((ia, ib, sa, ea, sb, eb, s) if ia < ib else (ib, ia, sb, eb, sa, ea, s))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 6 else pa.float64()) for i, c in enumerate(zip(*out))], [f.split()[0] for f in PAIRS.split(", ")])

    def verified(pairs):
        named = pairs.join(side("a"), "a").join(side("b"), "b")
        first = named.join(texts_of("a"), ["id_a", "a"]).select("id_a", "id_b", "b", "text_a", "anchors")
        clips = first.mapInArrow(clip, "id_a bigint, id_b bigint, b bigint, at bigint, words binary, ca array<int>, off array<int>, js array<tinyint>")
        whole = clips.join(texts_of("b"), ["id_b", "b"]).select("id_a", "id_b", "at", "words", "text_b", "ca", "off", "js")
        return whole.mapInArrow(verify, PAIRS).distinct()

    between = stored(verified(pairs))
    release(docs.sparkSession)
    open_ = anchored.join(_runs(between).withColumnRenamed("id", "id_o"), "id_o", "left")
    rest = stored(_rest(open_, least_words, similarity).groupBy("a", "b").agg(F.collect_set("at").alias("anchors")))
    release(docs.sparkSession)
    return between.unionByName(stored(verified(rest))).distinct(), ids, classes


def near_passages(docs: DataFrame, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY, hashes: int = HASHES, agree: int = AGREE) -> DataFrame:
    """A row for each pair of texts and passage that they share, and for each further copy of a text."""
    between, ids, classes = _found(docs, least_words, similarity, hashes, agree)
    many = classes.where((F.col("n") > 1) & (F.col("words") >= least_words)).select("tk", "id", "n")
    copies = matched(ids, many, ["tk"], "n").where("doc_id <> id").distinct()
    zero, end = F.lit(0).cast("long"), F.col("words").cast("long")
    members = copies.select(F.col("id").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"), zero.alias("start_a"), end.alias("end_a"), zero.alias("start_b"), end.alias("end_b"), F.lit(1.0).alias("similarity"))
    return between.unionByName(members)


def by_document(docs: DataFrame, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY, hashes: int = HASHES, agree: int = AGREE) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable by shared passages and copies), n_copies (rows of the same text besides),
    n_links (other texts that the text shares passages with), n_passages (runs of words in such passages) and shared_words (their words)."""
    between, ids, classes = _found(docs, least_words, similarity, hashes, agree)
    between = cut(between)
    release(docs.sparkSession)
    long = F.col("words") >= least_words
    held = matched(ids.select("doc_id", "tk"), classes, ["tk"], "n").select("doc_id", F.when(long, F.col("id")).otherwise(F.col("doc_id")).alias("node"), F.when(long, F.col("n")).otherwise(1).alias("n"), "words")
    each = cut(held.groupBy("doc_id").agg(F.min(F.struct("node", "n", "words")).alias("x"), F.max("node").alias("last")).select("doc_id", "x.*", "last"))
    several = each.where("node <> last").select("doc_id", F.col("node").alias("first"))

    pairs = between.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()
    roots = components(pairs.union(held.join(several, "doc_id").select(F.col("first").alias("a"), F.col("node").alias("b"))))
    sides = lambda x: [between.select(F.col(f"doc_id_{p}").alias("node"), *(F.col(f"{c}_{p}").alias(c) for c in x), F.col(f"doc_id_{q}").alias("other")) for p, q in ("ab", "ba")]
    links = sides([])[0].union(sides([])[1]).distinct().groupBy("node").agg(F.count("*").alias("n_links"))
    spans = sides(["start", "end"])[0].union(sides(["start", "end"])[1]).select("node", "start", "end").distinct()
    by = Window.partitionBy("node").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reach", F.coalesce(F.max("end").over(by), F.lit(-1).cast("long")))
    words = spans.groupBy("node").agg(F.sum((F.col("start") > F.col("reach")).cast("long")).alias("n_passages"), F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reach"))).alias("shared_words"))

    told = each.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").join(links, "node", "left").join(words, "node", "left")
    copied, none = F.col("n") > 1, F.lit(0).cast("long")
    return told.select(
        "doc_id", F.coalesce("root", "node").alias("component_id"), (F.col("n") - 1).alias("n_copies"), F.coalesce("n_links", none).alias("n_links"),
        F.when(copied, F.lit(1).cast("long")).otherwise(F.coalesce("n_passages", none)).alias("n_passages"),
        F.when(copied, F.col("words").cast("long")).otherwise(F.coalesce("shared_words", none)).alias("shared_words"),
    )


def drop_passages(found: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word): what to take out so that one passage of each pair stays."""
    return found.select(F.col("doc_id_b").alias("doc_id"), F.col("start_b").alias("start_word"), F.col("end_b").alias("end_word")).distinct()


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_document(table(spark, sf_dir, "documents"))
