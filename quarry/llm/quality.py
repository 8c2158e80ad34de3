"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a clean labelled document over a rejected one) are scored by the logistic loss on
the difference of their feature vectors: P(i beats j) = sigmoid(w . (x_i - x_j)). The learned w
scores every document alone; documents under a quantile of the scores of labelled documents that the
fit hasn't seen are rejected. The quantile is a parameter; None takes the share that parts the two
sides of those documents best. The accuracy is that on a third part, which chose nothing.

Every labelled document takes part: terms are counted, the loss is that of all pairs, and the threshold
is a quantile of all scores of its part. A document's gradient over all of its pairs follows from its own score
and the distribution of the other side's, which is kept in BINS; so a step is two sums over documents, made
where their features are stored (or on the driver, if these take LOCAL_BYTES at most).

Features are whole-text: shares of byte classes, repetition, and the presence of terms (words and their
beginnings) whose document frequency differs between the two sides of the labelled documents. They are
made by numpy for about CHUNK characters of texts at a time: words are runs of letters, digits and
bytes beyond ASCII in the lower-case text, known by a 64-bit hash.

Defined cases
* null, empty or blank text: no features to judge, rejected (score is null).
* very long texts: whole; read a part of PART_CHARS characters at a time, at whose ends lines end too.
* null in another column: not looked at. A null quality counts as good, a null toxic as not toxic.
* labels that repeat a doc_id: the worst one holds. Labels of unknown documents: ignored.
* repeated documents: scored alike, all kept or all rejected; ties at the threshold are kept.
* no labels, or labels of only one side: there is no preference, so every non-blank document scores 0 and is kept.
* empty table: no rows. Extra columns: passed through by keep(); score_documents() returns its own three columns only.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_BYTES, distinct, forget, lean, parts_of, read_table, settle, small_side, stored, trim

#: Scores are told apart by a BINS-th of the range from -REACH to REACH, when pairs are summed.
BINS, REACH = 8192, 128.0
#: Features of labelled documents that the driver takes; of more the sums are made by the executors.
LOCAL_BYTES = 16 << 20
#: Bits of a term's hash by which it is counted first, and parts that these counts are sent in.
SLOT_BITS, SLOT_PARTS = 20, 64
#: Terms that the model knows (those that differ most), and the z score by which their document frequency must differ.
MAX_WORDS, MIN_Z = 1024, 4.0
#: Word beginnings of these many bytes are features too: inflected forms share them.
BEGINNINGS = (4, 5, 6)
CHUNK = 1 << 18

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 .,'"?;:- 7 other ASCII signs
_CLASS[range(ord("a"), ord("z") + 1)] = 1
_CLASS[range(ord("A"), ord("Z") + 1)] = 2
_CLASS[range(ord("0"), ord("9") + 1)] = 3
_CLASS[[32, 9, 13]] = 4
_CLASS[10] = 5
_CLASS[list(b".,'\"?;:-()")] = 6
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and c not in b".,'\"?;:-()"]] = 7
_WORD = np.zeros(256, bool)
_WORD[[c for c in range(256) if c >= 128 or chr(c).isalnum() or c == 95]] = True
SHAPE = ("upper", "digit", "line", "stop", "sign", "other", "distinct", "repeated_lines", "word_length", "short", "once")
_BASE, _SALT, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse modulo 2 ** 64, for i up to n."""
    global _powers
    if len(_powers[0]) <= n:
        _powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n + n // 4, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _powers


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of each range of bytes, from sums of byte * _BASE ** place."""
    h = (sums[end] - sums[start]) * _power(len(sums))[1][start] + np.uint64(salt * int(_SALT) & (1 << 64) - 1)
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def term(word: str, beginning: bool = False) -> int:
    """The hash by which a term is known."""
    raw = np.frombuffer(word.encode(), np.uint8).astype(np.uint64) + np.uint64(1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * _power(len(raw))[0][: len(raw)], dtype=np.uint64)])
    return int(_hash(sums, np.array([0]), np.array([len(raw)]), len(raw) if beginning else 0)[0])


def _sums(raw: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(len(raw))[0][: len(raw)], dtype=np.uint64)])


def _ends(flag: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, one past the last) of each run of flags, runs being cut where texts start."""
    cut = np.zeros(len(flag) + 1, bool)
    cut[starts] = cut[-1] = True
    before = np.concatenate([[False], flag[:-1]]) & ~cut[:-1]
    after = np.concatenate([flag[1:], [False]]) & ~cut[1:]
    return np.flatnonzero(flag & ~before), np.flatnonzero(flag & ~after) + 1


class _Features:
    """Of some texts: dense features (rows, SHAPE), and (row, hash) of the terms in each, every pair once; of terms known to the model only, if it is given."""

    def __init__(self, texts: list[str], known: np.ndarray | None = None) -> None:
        rows = len(texts)
        self.bytes, self.words, self.letters, self.lines = (np.zeros(n, np.int64) for n in (rows * 8, rows, rows, rows))
        self.rows, self.terms, self.known = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], known
        kinds, lines = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        some, owner, chars = [], [], 0
        for i, t in enumerate(texts):
            for part in parts_of(t):
                some.append(part)
                owner.append(i)
                chars += len(part)
                if chars >= CHUNK:
                    self._chunk(some, np.array(owner), kinds, lines)
                    some, owner, chars = [], [], 0
        if some:
            self._chunk(some, np.array(owner), kinds, lines)
        kinds, lines = (np.bincount((distinct(np.concatenate(x)) >> np.uint64(48)).astype(np.int64), minlength=rows) for x in (kinds, lines))
        at, terms = np.concatenate(self.rows), np.concatenate(self.terms)
        order = np.lexsort((terms, at))
        at, terms = at[order], terms[order]
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (terms[1:] != terms[:-1])])[: len(at)]
        self.row, self.term = at[new], terms[new]
        c = self.bytes.reshape(rows, 8)
        c = c / np.maximum(1, c.sum(1))[:, None]
        n = np.maximum(1, self.words)
        self.shape = np.stack([
            np.minimum(1.0, 4 * c[:, 2]), np.minimum(1.0, 8 * c[:, 3]), np.minimum(1.0, 20 * c[:, 5]), np.minimum(1.0, 10 * c[:, 6]), np.minimum(1.0, 8 * c[:, 7]), c[:, 0],
            np.where(n > 20, kinds / n, 1.0), 1 - lines / np.maximum(1, self.lines), np.minimum(2.0, self.letters / n / 8), (n < 20) * 1.0, np.minimum(1.0, n / 4000),
        ], 1)

    def _chunk(self, texts: list[str], owner: np.ndarray, kinds: list, lines: list) -> None:
        rows = len(self.words)
        raw = [t.encode("utf-8", "replace") for t in texts]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        self.bytes += np.bincount(np.repeat(owner * 8, size) + _CLASS[data], minlength=rows * 8)
        starts = np.cumsum(size) - size
        first = distinct(np.concatenate([starts[size > 0], np.flatnonzero(data[:-1] == 10) + 1])).astype(np.int64)
        whose = owner[np.searchsorted(starts, first, side="right") - 1]
        self.lines += np.bincount(whose, minlength=rows)
        sums = _sums(data)
        lines.append(distinct(self._key(whose, _hash(sums, first, np.concatenate([first[1:], [len(data)]])))))

        low = [t.lower().encode("utf-8", "replace") for t in texts]
        size = np.array([len(r) for r in low], np.int64)
        data = np.frombuffer(b"".join(low), np.uint8)
        starts = np.cumsum(size) - size
        lo, hi = _ends(_WORD[data], starts[size > 0])
        whose = owner[np.searchsorted(starts, lo, side="right") - 1]
        self.words += np.bincount(whose, minlength=rows)
        self.letters += np.bincount(whose, hi - lo, minlength=rows).astype(np.int64)
        sums = _sums(data)
        word = _hash(sums, lo, hi)
        kinds.append(distinct(self._key(whose, word)))
        for r, h in [(whose, word)] + [(whose[long], _hash(sums, lo[long], lo[long] + n, n)) for n in BEGINNINGS for long in [hi - lo >= n]]:
            if self.known is not None:
                if not len(self.known):
                    continue
                on = self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] == h
                r, h = r[on], h[on]
            order = np.lexsort((h, r))
            r, h = r[order], h[order]
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])[: len(r)]
            self.rows.append(r[new])
            self.terms.append(h[new])

    @staticmethod
    def _key(row: np.ndarray, h: np.ndarray) -> np.ndarray:
        return (row.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))


@dataclass
class Model:
    """terms: sorted hashes; weights: of SHAPE, then of the terms."""

    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(SHAPE)))
    threshold: float = -np.inf
    holdout_accuracy: float = float("nan")
    quantile: float = 0.0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The score of each text; NaN for null and blank ones."""
        out = np.full(len(texts), np.nan)
        for lo in range(0, len(texts), 16_384):
            some = [i for i in range(lo, min(len(texts), lo + 16_384)) if texts[i] is not None and texts[i].strip()]
            if some:
                f = _Features([texts[i] for i in some], self.terms)
                out[some] = f.shape @ self.weights[: len(SHAPE)] + np.bincount(f.row, self.weights[len(SHAPE) + np.searchsorted(self.terms, f.term)], minlength=len(some))
        return out

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def _z(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """By how many standard errors the shares a / n[0] and b / n[1] differ."""
    p = (a + b) / n.sum()
    return np.abs(a / n[0] - b / n[1]) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n).sum())


def _sparse(texts: list[str], good: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(dense features, row and place of each chosen term, chosen terms, sorted): the MAX_WORDS terms whose document frequency differs most between the two sides of the training rows, by MIN_Z standard errors at least.

    Counts by 20 bits of the hash come first, so that memory stays bounded; exact ones follow for the terms in slots that stand out."""
    n, step = np.array([(~good & train).sum(), (good & train).sum()], float), 256
    shapes, slots = [], np.zeros((2, 1 << 20), np.int64)
    for lo in range(0, len(texts), step):
        f = _Features(texts[lo : lo + step])
        shapes.append(f.shape)
        at = (f.term >> np.uint64(44)).astype(np.int64)
        for side in (0, 1):
            slots[side] += np.bincount(at[(train & (good == side))[lo + f.row]], minlength=1 << 20)
    hot = _z(slots[0], slots[1], n) >= MIN_Z - 1 if n.all() else np.zeros(1 << 20, bool)
    rows, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo in range(0, len(texts) if hot.any() else 0, step):
        f = _Features(texts[lo : lo + step])
        on = hot[(f.term >> np.uint64(44)).astype(np.int64)]
        rows.append(lo + f.row[on])
        terms.append(f.term[on])
    row, term = np.concatenate(rows), np.concatenate(terms)
    kinds, at = np.unique(term, return_inverse=True)
    a, b = (np.bincount(at, train[row] & (good[row] == side), minlength=len(kinds)) for side in (False, True))
    z = _z(a, b, n) if len(kinds) else np.zeros(0)
    some = np.flatnonzero((a + b >= 3) & (z >= MIN_Z))
    chosen = np.sort(some[np.argsort(-z[some], kind="stable")[:MAX_WORDS]])
    place = np.full(len(kinds), -1)
    place[chosen] = np.arange(len(chosen))
    on = place[at] >= 0
    return np.concatenate(shapes), row[on], place[at[on]], kinds[chosen]


@dataclass
class _Block:
    """Features of some labelled documents: part (of eight), good, shape, and the places of each one's terms one after the other, counts of them."""

    part: np.ndarray
    good: np.ndarray
    shape: np.ndarray
    counts: np.ndarray
    places: np.ndarray

    def scores(self, w: np.ndarray) -> np.ndarray:
        d = self.shape.shape[1]
        rows = np.repeat(np.arange(len(self.part)), self.counts)
        return self.shape @ w[:d] + np.bincount(rows, w[d:][self.places], minlength=len(self.part))

    def columns(self) -> list[bytes]:
        return [x.tobytes() for x in (self.part, self.good, self.shape, self.counts, self.places)]


_BLOCK = "part binary, good binary, shape binary, counts binary, places binary"


def _block(part: bytes, good: bytes, shape: bytes, counts: bytes, places: bytes) -> _Block:
    return _Block(np.frombuffer(part, np.int8), np.frombuffer(good, bool), np.frombuffer(shape, np.float32).reshape(-1, len(SHAPE)), np.frombuffer(counts, np.int32), np.frombuffer(places, np.uint16))


def _blocks(batch: pa.RecordBatch) -> Iterator[_Block]:
    return (_block(*row.values()) for row in batch.to_pylist())


def _tally(b: _Block, w: np.ndarray, parts: tuple[int, ...]) -> np.ndarray:
    """(2, BINS): documents of either side, good ones in the second row, by their scores; each is shared out between the two nearest bins."""
    mine = np.isin(b.part, parts)
    low, rest = _bins(b.scores(w)[mine])
    at = b.good[mine] * BINS + low
    return (np.bincount(at, 1 - rest, minlength=2 * BINS) + np.bincount(at + 1, rest, minlength=2 * BINS)).reshape(2, BINS)


def _bins(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.clip((s + REACH) * ((BINS - 1) / (2 * REACH)), 0, BINS - 1 - 1e-6)
    return x.astype(np.int64), x - x.astype(np.int64)


def _pull(b: _Block, w: np.ndarray, pulls: np.ndarray, parts: tuple[int, ...]) -> np.ndarray:
    """The sum of features, each document's times the pull at its score."""
    low, rest = _bins(b.scores(w))
    side = pulls[b.good.astype(np.int64)[:, None], np.stack([low, low + 1], 1)]
    a = np.where(np.isin(b.part, parts), side[:, 0] * (1 - rest) + side[:, 1] * rest, 0.0)
    return np.concatenate([a @ b.shape, np.bincount(b.places, np.repeat(a, b.counts), minlength=len(w) - b.shape.shape[1])])


def _over_pairs(f: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each bin u the sum of f(u - v) * h[v]; f is given at -(BINS - 1) to BINS - 1."""
    n = 4 * BINS
    return np.fft.irfft(np.fft.rfft(f, n) * np.fft.rfft(h, n), n)[BINS - 1 : 2 * BINS - 1]


def _fit_pairs(total: Callable, width: int, parts: tuple[int, ...], steps: int) -> np.ndarray:
    """The weights of least logistic loss over all pairs, with a little L2, by L-BFGS. total(f, *args): the sum of f(block, *args) over all blocks."""
    gap = np.arange(-(BINS - 1), BINS) * (2 * REACH / (BINS - 1))
    soft, lost = np.logaddexp(0, -gap), 1 / (1 + np.exp(np.clip(gap, -500, 500)))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        h = total(_tally, w, parts)
        h = h / h.sum(1)[:, None]
        return float(h[1] @ _over_pairs(soft, h[0])) + 5e-6 * float(w @ w), h

    def gradient(w: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        pulls = np.stack([_over_pairs(lost[::-1], h[1]) / n[0], -_over_pairs(lost, h[0]) / n[1]])  # f(u - v) of the bad ones is lost(v - u)
        return total(_pull, w, pulls, parts) + 1e-5 * w

    w, memory = np.zeros(width), []
    n = total(_tally, w, parts).sum(1)
    now, h = loss(w)
    g = gradient(w, h, n)
    for _ in range(steps):
        d, used = -g, []
        for ds, dg in reversed(memory):
            k = ds @ d / (ds @ dg)
            used.append(k)
            d = d - k * dg
        if memory:
            d = d * (memory[-1][0] @ memory[-1][1] / (memory[-1][1] @ memory[-1][1]))
        for (ds, dg), k in zip(memory, reversed(used)):
            d = d + ds * (k - dg @ d / (ds @ dg))
        slope, t = float(g @ d), 1.0
        while (new := loss(w + t * d))[0] > now + 1e-4 * t * slope and t > 1e-4:
            t /= 4
        if t <= 1e-4:
            break
        before, (now, h), w = (now, g), new, w + t * d
        g = gradient(w, h, n)
        if (g - before[1]) @ d > 1e-12:
            memory = [*memory, (t * d, g - before[1])][-10:]
        if before[0] - now < 1e-5 * before[0]:
            break
    return w


def _bradley_terry(x: np.ndarray, good: np.ndarray, steps: int = 60, seed: int = 0) -> np.ndarray:
    """The weights for a matrix of features, over all pairs; nothing is drawn, so any seed gives the same."""
    b = _Block(np.zeros(len(x), np.int8), good, x, np.zeros(len(x), np.int32), np.zeros(0, np.uint16))
    return _fit_pairs(lambda f, *args: f(b, *args), x.shape[1], (0,), steps)


def _held(b: _Block, w: np.ndarray) -> list[np.ndarray]:
    """[parts, scores, good] of the documents that the fit hasn't seen."""
    on = b.part >= 6
    return [b.part[on], b.scores(w)[on], b.good[on]]


def _model(terms: np.ndarray, total: Callable, gather: Callable, steps: int, quantile: float | None) -> Model:
    """total: see _fit_pairs. gather(f, w): f's arrays of all blocks, joined."""
    count = lambda *parts: total(_tally, np.zeros(len(SHAPE) + len(terms)), parts).sum(1)
    if not count(*range(8)).all():
        return Model()
    w = _fit_pairs(total, len(SHAPE) + len(terms), (0, 1, 2, 3, 4, 5) if count(0, 1, 2, 3, 4, 5).all() else tuple(range(8)), steps)
    part, s, good = gather(_held, w)

    def held(k: int) -> tuple[np.ndarray, np.ndarray]:
        for mine in (part == k, part >= 6):
            if good[mine].any() and (~good[mine]).any():
                return s[mine], good[mine]
        _, s_all, good_all = gather(lambda b, w: [b.part, b.scores(w), b.good], w)  # so few that a side is missing
        return s_all, good_all

    hs, hg = held(6)
    order = np.lexsort((hg, hs))
    if quantile is None:  # a share of clean documents lost counts three times as much as one of the others kept
        bad_under = np.cumsum(~hg[order]) / max(1, (~hg).sum())
        good_under = np.cumsum(hg[order]) / max(1, hg.sum())
        best = int(np.argmax(bad_under - 3 * good_under))
        quantile = (best + 1) / len(hs)
        threshold = float((hs[order[best]] + hs[order[min(best + 1, len(hs) - 1)]]) / 2)
    else:
        threshold = float(np.quantile(hs, quantile))
    ts, tg = held(7)
    return Model(terms, w, threshold, float(((ts >= threshold) == tg).mean()), float(quantile))


def fit_rows(rows: list[tuple[str, bool]], steps: int = 60, seed: int = 7, quantile: float | None = None) -> Model:
    """Fit on (text, preferred) rows: of eight documents of each side six give the pairs, one the threshold, one the accuracy.

    quantile: the share of scores under the threshold; None takes the one that parts the two sides best."""
    rows = [(t, g) for t, g in rows if t is not None and t.strip()]
    good = np.array([g for _, g in rows], bool)
    if not len(rows) or good.all() or not good.any():
        return Model()
    part = np.zeros(len(rows), np.int8)
    for side in (good, ~good):
        part[np.flatnonzero(side)] = np.arange(side.sum()) % 8
    dense, row, place, terms = _sparse([t for t, _ in rows], good, part < 6)
    order = np.argsort(row, kind="stable")
    b = _Block(part, good, dense, np.bincount(row, minlength=len(rows)), place[order])
    return _model(terms, lambda f, *args: f(b, *args), lambda f, w: f(b, w), steps, quantile)


def _all_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, _Features]]:
    """(good, features with all terms) of a few texts at a time: unchosen terms take many times the texts' memory."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            b = batch.slice(lo, 128)
            yield np.array(b.column(1).to_pylist(), bool), _Features(b.column(0).to_pylist())


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the documents with a term in each slot, bad ones first: SLOT_PARTS rows a task."""
    slots = np.zeros((2, 1 << SLOT_BITS), np.int32)
    for good, f in _all_terms(batches):
        np.add.at(slots, (good[f.row].astype(np.int64), (f.term >> np.uint64(64 - SLOT_BITS)).astype(np.int64)), 1)
    if slots.any():
        for k, part in enumerate(np.split(slots, SLOT_PARTS, 1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["k", "counts"])


def _hot_slots(n: np.ndarray):
    def hot(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros((2, (1 << SLOT_BITS) // SLOT_PARTS), np.int64)
        for b in batches:
            for x in b.column("counts"):
                c += np.frombuffer(zlib.decompress(x.as_py()), np.int32).reshape(c.shape)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(_z(c[0], c[1], n) >= MIN_Z - 1).tobytes()], pa.binary())], names=["k", "hot"])

    return hot


def _hot_terms(hot: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for good, f in _all_terms(batches):
            on = hot[(f.term >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
            terms, at = np.unique(f.term[on], return_inverse=True)
            of = good[f.row[on]]
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), *(pa.array(np.bincount(at[of == side], minlength=len(terms))) for side in (False, True))], names=["term", "a", "b"])

    return count


def _terms(train: DataFrame, n: np.ndarray) -> np.ndarray:
    """The chosen terms, sorted: see _sparse; counted over all training documents."""
    parts = train.mapInArrow(lean(_slots), "k int, counts binary").groupBy("k").applyInArrow(_hot_slots(n), "k int, hot binary").orderBy("k").collect()
    hot = np.unpackbits(np.frombuffer(b"".join(bytes(r.hot) for r in parts), np.uint8)).astype(bool)
    if not hot.any():
        return np.zeros(0, np.uint64)
    counts = train.mapInArrow(lean(_hot_terms(hot)), "term long, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a + b >= 3")
    share = (F.col("a") + F.col("b")) / float(n.sum())
    z = F.abs(F.col("a") / float(n[0]) - F.col("b") / float(n[1])) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * float((1 / n).sum()))
    best = counts.select("term", z.alias("z")).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "term").limit(MAX_WORDS).collect()
    return np.sort(np.array([r.term for r in best], np.int64).view(np.uint64))


def _features_of(terms: np.ndarray):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            f = _Features(b.column(0).to_pylist(), terms)
            block = _Block(b.column(2).to_numpy().astype(np.int8), np.array(b.column(1).to_pylist(), bool), f.shape.astype(np.float32), np.bincount(f.row, minlength=b.num_rows).astype(np.int32), np.searchsorted(terms, f.term).astype(np.uint16))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in block.columns()], names=["part", "good", "shape", "counts", "places"])

    return features


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, good, part of every labelled document that isn't blank, rows of the same id and text once. Stored."""
    worst = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(1))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    sides = stored(worst.select("doc_id", ((F.col("q") > 0) & (F.col("t") <= 0)).alias("good")), "sides")
    rows = docs.select("doc_id", "text").where(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]")).join(small_side(sides, 32), "doc_id").withColumn("key", F.xxhash64("text"))
    rows = stored(rows, "labelled")
    twice = stored(rows.groupBy("doc_id", "key").agg(F.count("*").alias("m")).where("m > 1").select("doc_id", "key"), "twice")
    if not twice.isEmpty():
        again = small_side(twice, 16)
        once = rows.join(again, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
        more = stored(rows.join(again, ["doc_id", "key"], "left_anti").unionByName(once), "labelled")
        forget(rows)
        rows = more
    forget(sides, twice)
    part = F.pmod(F.xxhash64("doc_id", "key"), F.lit(8)).cast("int")
    out = rows.select("text", "good", part.alias("part"))
    out.stored_at = rows.stored_at
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int | None = None, max_chars: int | None = None, steps: int = 60, seed: int = 7, quantile: float | None = None) -> Model:
    """Fit on all labelled documents, without their texts coming to the driver. Only a caller that gives max_labelled or max_chars gets a sample: those with the smallest hash of doc_id."""
    if max_labelled is not None or max_chars is not None:
        return _fit_sample(docs, labels, max_labelled or 1 << 30, max_chars or 1 << 60, steps=steps, seed=seed, quantile=quantile)
    rows = _labelled(docs, labels)
    train = rows.where("part < 6").select("text", "good")
    n = train.agg(F.count_if(~F.col("good")), F.count_if("good")).first()
    terms = _terms(train, np.array(n, float)) if all(n) else np.zeros(0, np.uint64)
    blocks = stored(rows.mapInArrow(lean(_features_of(terms)), _BLOCK), "features")
    forget(rows)
    size = blocks.agg(F.sum(F.length("shape") + F.length("counts") + F.length("places"))).first()[0] or 0
    if size <= LOCAL_BYTES:
        here = [_block(*map(bytes, r)) for r in blocks.collect()] or [_block(b"", b"", b"", b"", b"")]
        total = lambda f, *args: sum(f(b, *args) for b in here)
        gather = lambda f, w: [np.concatenate(x) for x in zip(*(f(b, w) for b in here))]
    else:
        total, gather = _apart(blocks)
    model = _model(terms, total, gather, steps, quantile)
    forget(blocks)
    return model


def _apart(blocks: DataFrame) -> tuple[Callable, Callable]:
    """total and gather over stored blocks, by the executors."""

    def total(f: Callable, *args) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                for b in _blocks(batch):
                    out = f(b, *args) if out is None else out + f(b, *args)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(out, np.float64).tobytes()], pa.binary())], names=["x"])

        parts = [np.frombuffer(bytes(r.x)) for r in blocks.mapInArrow(run, "x binary").collect()]
        out = sum(parts)
        return out.reshape(2, BINS) if f is _tally else out

    def gather(f: Callable, w: np.ndarray) -> list[np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in _blocks(batch):
                    part, s, good = f(b, w)
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (part, s, good)], names=["part", "s", "good"])

        found = blocks.mapInArrow(run, "part binary, s binary, good binary").collect()
        return [np.frombuffer(b"".join(bytes(r[k]) for r in found), t) for k, t in enumerate((np.int8, np.float64, bool))]

    return total, gather


def _fit_sample(docs: DataFrame, labels: DataFrame, max_labelled: int, max_chars: int, **options) -> Model:
    """Fit on at most max_labelled labelled documents, and max_chars of them (the first always). Their texts come to the driver."""
    worst = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(1))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    sample = worst.select("doc_id", ((F.col("q") > 0) & (F.col("t") <= 0)).alias("good"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(max_labelled)
    if max_labelled * 32 <= BROADCAST_BYTES:
        sample = F.broadcast(sample)
    some = docs.select("doc_id", "text").where("text is not null").join(sample, "doc_id")
    before = F.coalesce(F.sum(F.length("text")).over(Window.orderBy("h", "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = some.distinct().withColumn("before", before).where(F.col("before") < max_chars).select("text", "good").collect()  # the sample is bounded, so one task may order it
    return fit_rows([(r.text, r.good) for r in rows], **options)


def _scorer(model: Model):
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(model.scores(b.to_pylist()), pa.float64())
        trim()

    return score


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, whole, that score at the threshold or above."""
    settle(docs.sparkSession)
    s = F.nanvl(_scorer(model)("text"), F.lit(None).cast("double"))
    return docs.where(s >= F.lit(float(model.threshold)))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, kept of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64(), from_pandas=True), pa.array(s >= model.threshold)], names=["doc_id", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, score double, kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the documents that stay, with their scores."""
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, read_table(spark, sf_dir, "labels"))).where("kept").select("doc_id", F.round("score", 6).alias("score"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep(docs, fit(docs, read_table(spark, sf_dir, "labels")))
