"""Benchmark decontamination with a distributed positional inverted index.

Building: every task cuts its documents into segments of about SEGMENT tokens and stores, for each
segment, all of its terms with their position lists (sorted, delta coded) - nothing is shuffled, and
the index is a table that later test sets can be run against. A document of more than PIECE tokens is
stored in pieces that overlap by more than a match is long, so its length has no bound.

Querying: test texts become windows of WINDOW terms (a shorter text is one window). In each segment
the lists of a window's rarest terms are shifted by the terms' offsets, which gives the diagonals on
which it may stand; the lists of the other terms are intersected with those. A start at which all
terms stand exactly is a phrase match; one at which all but `misses` terms stand within SLOP of their
place is a proximity match. If at most m terms miss, one of the m + 1 rarest doesn't, so only their
lists give starts: nothing is lost. A window of n terms may miss n * (WINDOW - NEAR) // WINDOW.

All windows of a segment are worked on at once, in blocks of BLOCK diagonals. Test sets of more than
TEST_CHARS characters are run in slices of that size against the stored index; each slice sends its
terms (8 bytes each) to the tasks. Terms are told apart by 40 bits of their hash, so a match of n
terms is wrong with a chance of about 2 ** -40 for each different term, and isn't read again.

matches() reports items of any length. clean() drops documents for items of SHORTEST terms or more,
since fewer words are ordinary speech.

Defined cases
* null or blank text (on either side), texts without words: no terms, no match.
* very long texts: read a part at a time, stored in pieces; counts are of the whole document.
* null doc_id: reported with a null id; clean() drops such a row as well, since it goes by the text's hash.
* repeated documents: each row is reported; repeated test items are reported under each item_id once.
* null item_id: left out. Ties (several items or places): all are reported, the first token is the least.
* empty tables: no rows. Extra columns: ignored by matches(), passed through by clean().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, lean, parts_of, read_table, small_side, stored, unused

WORD = re.compile(r"\w+")
WINDOW, NEAR, SLOP, SHORTEST = 13, 11, 2, 5
SEGMENT, PIECE = 800_000, 500_000
#: Empty positions after each document; no match can bridge more than 2 * slop + misses of them.
GAP = 16
TEST_CHARS, BLOCK = 8_000_000, 1 << 16
_POS = 24  # bits of a position within a segment; the other 40 are the term
_LOW = np.uint64((1 << _POS) - 1)
INDEX = "doc_ids array<long>, text_keys array<long>, cut array<long>, offsets array<long>, starts binary, terms binary, counts binary, positions binary"
FOUND = "doc_id long, text_key long, cut long, item_id long, phrases array<int>, nears array<int>, phrase_windows int, near_windows int, first_token long, first_phrase long"


class _Terms(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w) >> _POS
        return h


def term_hashes(text: str, cache: _Terms) -> np.ndarray:
    out = []
    for part in parts_of(text):
        words = WORD.findall(part.lower())
        out.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint64)


def _pack(a: np.ndarray) -> bytes:
    """Bytes of one weight beside each other, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T))


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class _Segment:
    """The pieces gathered so far; one array, filled in place, holds term << 24 | position."""

    def __init__(self, size: int, gap: int) -> None:
        self.both, self.gap = np.empty(size, np.uint64), gap
        self.clear()

    def clear(self) -> None:
        self.n, self.end, self.ids, self.keys, self.cut, self.offsets, self.starts = 0, 0, [], [], [], [], []

    def fits(self, n: int) -> bool:
        return self.n + n <= len(self.both) and self.end + n + self.gap < 1 << _POS

    def add(self, i: int | None, key: int, cut: int, offset: int, terms: np.ndarray) -> None:
        into = self.both[self.n : self.n + len(terms)]
        np.left_shift(terms, np.uint64(_POS), out=into)
        into |= np.arange(self.end, self.end + len(terms), dtype=np.uint64)
        self.starts.append(self.end)
        self.n, self.end = self.n + len(terms), self.end + len(terms) + self.gap
        for to, v in ((self.ids, i), (self.keys, key), (self.cut, cut), (self.offsets, offset)):
            to.append(v)

    def row(self) -> pa.RecordBatch:
        both = self.both[: self.n]
        both.sort()
        positions = (both & _LOW).astype(np.uint32)
        both >>= np.uint64(_POS)
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        counts = np.diff(first, append=self.n).astype(np.uint32)
        terms = np.diff(both[first], prepend=np.uint64(0))
        positions[1:] -= positions[:-1].copy()  # wraps where the next term begins; cumsum wraps back
        data = [_pack(np.array([*self.starts, self.end], np.uint32)), _pack(terms), _pack(counts), _pack(positions)]
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (self.ids, self.keys, self.cut, self.offsets)]
        self.clear()
        return pa.RecordBatch.from_arrays([*lists, *(pa.array([x], pa.binary()) for x in data)], names=["doc_ids", "text_keys", "cut", "offsets", "starts", "terms", "counts", "positions"])


def _indexer(segment: int, gap: int, piece: int, overlap: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, some, number, task = _Terms(), _Segment(max(segment, piece + overlap), gap), 0, TaskContext.get()
        base = (task.partitionId() if task else 0) << 32
        for b in batches:
            for i, k, t in zip(b.column(0), b.column(1), b.column(2)):
                terms = term_hashes(t.as_py(), cache)
                long = len(terms) > piece
                number += long
                for offset in range(0, max(1, len(terms) - overlap) if long else 1, piece):
                    part = terms[offset : offset + piece + overlap] if long else terms
                    if not len(part):
                        continue
                    if not some.fits(len(part)):
                        yield some.row()
                    some.add(i.as_py(), k.as_py(), base + number if long else -1, offset, part)
        if some.n:
            yield some.row()

    return build


def build_index(docs: DataFrame, segment: int = SEGMENT, gap: int = GAP, piece: int = PIECE, overlap: int = WINDOW + 2 * SLOP + 4) -> DataFrame:
    """The stored index of all documents: one row per segment. Delete it with common.forget()."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("k"), "text").where("text is not null")
    return stored(rows.mapInArrow(lean(_indexer(segment, gap, piece, overlap)), INDEX), "positions")


def test_terms(items: list[tuple[int, str]], window: int = WINDOW, shortest: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of all items, each followed by `window` empty places; item of each window; where it begins; its number of terms)."""
    cache, flat, owner, at, sizes, n = _Terms(), [], [], [], [], 0
    for i, t in sorted({(i, t) for i, t in items if i is not None and t is not None}):
        h = term_hashes(t, cache)
        if len(h) < max(1, shortest):
            continue
        many = max(1, len(h) - window + 1)
        owner.append(np.full(many, i, np.int64))
        at.append(np.arange(n, n + many))
        sizes.append(np.full(many, min(window, len(h)), np.int64))
        flat += [h, np.full(window, np.uint64(1 << 40))]  # no term is 1 << 40
        n += len(h) + window
    if not flat:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(flat), np.concatenate(owner), np.concatenate(at), np.concatenate(sizes)


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0] .. lo[0] + n[0] - 1, lo[1] ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - n), n)


class _Lists:
    """The position lists of a segment as one sorted array of place-of-term << 32 | position."""

    def __init__(self, counts: np.ndarray, deltas: np.ndarray) -> None:
        self.begin = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.positions = np.cumsum(deltas, dtype=np.uint32).astype(np.int64)
        self.both = self.positions + (np.repeat(np.arange(len(counts), dtype=np.int64), counts) << 32)

    def off(self, term: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
        """How far the term's nearest position is from the place; most + 1 if farther than most, or if term < 0."""
        out = np.full(len(term), most + 1, np.int64)
        some = np.flatnonzero((term >= 0) & (place >= -most))
        key = (term[some] << 32) + np.maximum(place[some], 0)
        k = np.searchsorted(self.both, key)
        base = term[some] << 32
        for j in (np.minimum(k, len(self.both) - 1), np.maximum(k - 1, 0)):
            there = self.both[j] - base
            d = np.abs(there - place[some])
            d[(there < 0) | (there > 0xFFFFFFFF)] = most + 1
            out[some] = np.minimum(out[some], d)
        return out


def _rarest(number: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Mask of the free + 1 rarest of each row; places outside a window hold a number above all others."""
    place = np.argsort(np.argsort(number, axis=1, kind="stable"), axis=1, kind="stable")
    return place <= free[:, None]


def _search(lists: _Lists, term: np.ndarray, flat: np.ndarray, at: np.ndarray, sizes: np.ndarray, window: int, misses: int, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (window, start, is it exact) of every start at which a window matches in one segment."""
    distinct, of = np.unique(flat, return_inverse=True)
    k = np.minimum(np.searchsorted(term, distinct), len(term) - 1)
    tid = np.where(term[k] == distinct, k, -1)[of]
    count = np.where(tid >= 0, lists.begin[tid + 1] - lists.begin[tid], 0)
    free = sizes * misses // window
    absent = np.concatenate([[0], np.cumsum(tid < 0)])
    ws = np.flatnonzero(absent[at + sizes] - absent[at] <= free)
    span = np.arange(window)
    for lo in range(0, len(ws), BLOCK):
        w = ws[lo : lo + BLOCK]
        inside = span[None, :] < sizes[w][:, None]
        cells = at[w][:, None] + span
        rare = _rarest(np.where(inside, count[np.minimum(cells, len(flat) - 1)], 1 << 40), free[w]) & inside
        anchors = np.unique(cells[rare])
        anchors = anchors[count[anchors] > 0]
        wanted = np.zeros(len(flat), bool)
        wanted[at[w]] = True
        window_at = np.full(len(flat), -1, np.int64)
        window_at[at[w]] = w
        group = np.cumsum(count[anchors]) // BLOCK
        for a in np.split(anchors, np.flatnonzero(np.diff(group)) + 1):
            if len(a):
                yield from _anchored(lists, a, tid, count, wanted, window_at, at, sizes, free, window, slop)


def _anchored(lists, a, tid, count, wanted, window_at, at, sizes, free, window, slop) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    every = _ranges(lists.begin[tid[a]], count[a])
    anchor, diagonal = np.repeat(a, count[a]), lists.positions[every] - np.repeat(a, count[a])
    for lo in range(0, len(anchor), BLOCK):  # one term's list may be longer than a block
        an, di = anchor[lo : lo + BLOCK], diagonal[lo : lo + BLOCK]
        # on a diagonal that is at most slop off, each of the other terms is at most 2 * slop from its place
        hits = np.zeros((len(an), 2 * window - 1), np.int8)
        hits[:, window - 1] = 1
        live = np.arange(len(an))
        for step, d in enumerate(d for k in range(1, window) for d in (-k, k)):
            cell = an[live] + d
            ok = (cell >= 0) & (cell < len(tid))
            t = np.where(ok, tid[np.clip(cell, 0, len(tid) - 1)], -1)
            hits[live, window - 1 + d] = lists.off(t, di[live] + cell, 2 * slop) <= 2 * slop
            if step in (5, 11, 17):  # which could still be a match?
                some = hits[live]
                for j in range(step // 2 + 2, window):
                    some[:, window - 1 + j] = some[:, window - 1 - j] = 1
                live = live[_possible(some, an[live], wanted, window_at, sizes, free, window).any(1)]
                if not len(live):
                    break
        if not len(live):
            continue
        r, j = np.nonzero(_possible(hits[live], an[live], wanted, window_at, sizes, free, window))
        if not len(r):
            continue
        begins = an[live][r] - (window - 1) + j
        w, s = window_at[begins], di[live][r] + begins
        shift = np.arange(-slop, slop + 1)
        w, s = np.repeat(w, len(shift)), (s[:, None] + shift).ravel()
        pair = np.unique(np.stack([w, s], 1), axis=0)
        w, s = pair[:, 0], pair[:, 1]
        lost, exact = np.zeros(len(w), np.int64), np.ones(len(w), bool)
        for k in range(window):
            inside = k < sizes[w]
            off = lists.off(np.where(inside, tid[np.minimum(at[w] + k, len(tid) - 1)], -1), s + k, slop)
            lost += inside & (off > np.where(free[w] > 0, slop, 0))
            exact &= ~inside | (off == 0)
        on = lost <= free[w]
        if on.any():
            yield w[on], s[on], exact[on]


def _possible(hits: np.ndarray, an: np.ndarray, wanted: np.ndarray, window_at: np.ndarray, sizes: np.ndarray, free: np.ndarray, window: int) -> np.ndarray:
    """(anchor, j): may the window that begins j - (window - 1) places from the anchor match? Hits beyond a short window count as none of its own."""
    n = len(wanted)
    out = np.zeros((len(an), window), bool)
    total = np.concatenate([np.zeros((len(an), 1), np.int64), np.cumsum(hits, 1)], 1)
    for j in range(window):
        b = an - (window - 1) + j
        ok = (b >= 0) & (b < n)
        w = np.where(ok & wanted[np.clip(b, 0, n - 1)], window_at[np.clip(b, 0, n - 1)], -1)
        size = np.where(w >= 0, sizes[w], 0)
        got = total[np.arange(len(an)), j + size] - total[:, j]
        out[:, j] = (w >= 0) & (window - 1 - j < size) & (got >= size - free[w])
    return out


def _matcher(owner: np.ndarray, flat: np.ndarray, at: np.ndarray, sizes: np.ndarray, window: int, misses: int, slop: int):
    items, item_of = np.unique(owner, return_inverse=True)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, keys, cut, offsets = (b.column(c)[r].as_py() for c in range(4))
                starts, terms, counts, deltas = (_unpack(b.column(c)[r].as_py(), k) for c, k in ((4, np.uint32), (5, np.uint64), (6, np.uint32), (7, np.uint32)))
                starts, lists = starts.astype(np.int64), _Lists(counts, deltas)
                found: list[np.ndarray] = []
                for w, s, exact in _search(lists, np.cumsum(terms, dtype=np.uint64), flat, at, sizes, window, misses, slop):
                    doc = np.clip(np.searchsorted(starts, s + sizes[w] // 2, side="right") - 1, 0, len(ids) - 1)  # the middle is inside, whatever the slop
                    found.append(np.stack([doc, item_of[w], w, exact, np.maximum(0, s - starts[doc])], 1))
                if not found:
                    continue
                rows = np.concatenate(found)
                rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
                edges = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1), [True]]))
                out = []
                for lo, hi in zip(edges, edges[1:]):
                    d, i = rows[lo, 0], rows[lo, 1]
                    near, phrase = np.unique(rows[lo:hi, 2]), np.unique(rows[lo:hi, 2][rows[lo:hi, 3] == 1])
                    lists_too = (phrase.tolist(), near.tolist()) if cut[d] >= 0 else (None, None)
                    exact = rows[lo:hi, 4][rows[lo:hi, 3] == 1]
                    out.append((ids[d], keys[d], cut[d], int(items[i]), *lists_too, len(phrase), len(near), int(rows[lo:hi, 4].min()) + offsets[d], int(exact.min()) + offsets[d] if len(exact) else None))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], k) for c, k in enumerate(kinds)], names=[f.split()[0] for f in FOUND.split(", ")])

    return match


def matches(docs: DataFrame, tests: DataFrame, window: int = WINDOW, near: int = NEAR, slop: int = SLOP, shortest: int = 1, test_chars: int = TEST_CHARS, segment: int = SEGMENT, piece: int = PIECE) -> DataFrame:
    """One row per document and test item that match: how many of the item's windows stand in the document as phrases, how many as phrases or nearly, and the first token of a phrase, or of a near match (up to slop early) where there is none."""
    if 2 * slop + window - near >= GAP:
        raise ValueError("slop and misses would let a match bridge two documents")
    index = build_index(docs, segment, piece=piece, overlap=window + 2 * slop + 4)
    tests = tests.select("item_id", "text").where("item_id is not null and text is not null")
    chars = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    slices = -(-chars // test_chars) or 1
    out = docs.sparkSession.range(0).select(*[F.lit(None).cast(kind.replace("long", "bigint")).alias(name) for name, kind in map(str.split, FOUND.split(", "))])
    for s in range(slices):
        rows = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == s).collect()
        flat, owner, at, sizes = test_terms([(r.item_id, r.text) for r in rows], window, shortest)
        if len(owner):
            out = out.unionByName(index.mapInArrow(lean(_matcher(owner, flat, at, sizes, window, window - near, slop)), FOUND))
    found = stored(out, "found")
    forget(index)
    keys = ["doc_id", "text_key", "item_id"]
    whole = found.where("cut < 0").select(*keys, "phrase_windows", "near_windows", F.coalesce("first_phrase", "first_token").alias("first_token"))

    def distinct(c: str):
        return F.size(F.array_distinct(F.flatten(F.collect_list(c))))

    cut = found.where("cut >= 0").groupBy("cut", *keys).agg(distinct("phrases").alias("phrase_windows"), distinct("nears").alias("near_windows"), F.coalesce(F.min("first_phrase"), F.min("first_token")).alias("first_token"))
    return whole.unionByName(cut.drop("cut"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every match between a document and a benchmark item."""
    return matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("text_key")


def clean(docs: DataFrame, tests: DataFrame, shortest: int = SHORTEST, **options) -> DataFrame:
    """The documents without any match, whole."""
    (k,) = unused(docs, "text_key")
    leaks = stored(matches(docs, tests, shortest=shortest, **options).select(F.col("text_key").alias(k)).distinct(), "leaks")
    return docs.withColumn(k, F.xxhash64("text")).join(small_side(leaks, 16), k, "left_anti").drop(k)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, read_table(spark, sf_dir, "benchmark"))
