"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks (runs of text between block-level tags). A bidirectional LSTM in numpy
reads, for every block of the page in order, the vector of its tag path (hashed tags and classes, by
depth), the mean vector of its hashed words, and a few numbers (length, share of linked text, place);
each block is labelled from both directions, hence from the whole document. The text of a page is
that of the blocks labelled as content.

There are no labelled blocks; the teacher is the landmark tags of pages that have them (article and
main hold content; nav, header, footer, aside and the like, and classes such as "ad", do not). While
training, landmarks are hidden in half of the pages, so that the words and the neighbours count too.

Defined cases
* null or empty html: a row with no blocks and an empty text. Null page_id: kept.
* not HTML at all: one block, labelled like any other. Unclosed tags, comments, scripts: as browsers do, roughly.
* repeated rows: one row each. Very long pages: whole, every block is labelled from the whole page.
* elements more than DEEPEST levels deep: siblings at that level, as in browsers. Paths are whole otherwise.
* no pages, or none with landmarks to learn from: an untrained model calls every block content.
* ties: a block with a chance of exactly 0.5 is content.
* extra columns: ignored. Empty table: no rows.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read_table

#: The model is fitted on so many different pages with landmarks at most, those with the smallest hash, and so many characters of them that come to the driver (the first page always does).
MAX_PAGES, MAX_CHARS = 500, 64 << 20
#: Training pages are cut into sequences of so many blocks, all of which are used.
SEQUENCE = 300
#: Blocks of a batch of pages with their padding, words and path elements of a batch, steps of the network whose inputs are made at once.
CELLS, WORDS, STEPS = 1 << 15, 1 << 20, 1024
PATH_BUCKETS, WORD_BUCKETS, PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 1024, 4096, 12, 12, 6, 16
DEPTH = 8  # the innermost tags of a path are told apart by their place; those further out by being there
DEEPEST = 512
SCHEMA = "page_id long, text string, blocks int, content_blocks int"

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|head)\b.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<![^>]*>|([^<]+|<)", re.S | re.I)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "em", "i", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var", "font", "label", "img", "wbr"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_CLOSED_BY = {"p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "footer", "nav"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_GOOD = {"article", "main"}
_BAD = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
_BAD_CLASS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|nav\w*|menu|sidebar|footer|header|promo\w*|cookies?|share|social|comments?|breadcrumbs?|related|sponsor\w*)(?:$|[\s_-])", re.I)
_WORDS = re.compile(r"\w+")
#: What a page needs for blocks of both labels; may hold by chance, and is tested again by the labels themselves.
HAS_GOOD = r"(?i)<(?:article|main)\b"
HAS_BAD = r"(?i)<(?:nav|header|footer|aside|form|menu|dialog)\b|(?:class|id|role)\s*=[^>]*(?:ad|banner|nav|menu|sidebar|footer|header|promo|cookie|share|social|comment|breadcrumb|related|sponsor)"


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: float
    label: int  # 1 content, 0 not, -1 unknown


def split_blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page, with the labels that its landmarks give."""
    out: list[Block] = []
    stack: list[tuple[str, str, int]] = []  # tag, its element with classes, the label that it gives
    buffer, linked, links = [], 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(buffer).split())
        if text:
            out.append(Block(text, tuple(s[1] for s in stack if s[0] not in _INLINE), min(1.0, linked / max(1, len(text))), stack[-1][2] if stack else -1))
        buffer.clear()
        linked = 0

    for m in _TOKEN.finditer(page or ""):
        if (text := m[5]) is not None:
            if "&" in text:
                text = entities.unescape(text)
            buffer.append(text)
            if links:
                linked += len(text.strip())
            continue
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            names = [s[0] for s in stack]
            if tag in names:
                if tag not in _INLINE:
                    flush()
                while stack:
                    gone = stack.pop()[0]
                    links -= gone == "a"
                    if gone == tag:
                        break
            continue
        if tag not in _INLINE:
            flush()
            while stack and tag in _CLOSED_BY.get(next((s[0] for s in reversed(stack) if s[0] not in _INLINE), ""), ()):
                links -= stack[-1][0] == "a"
                stack.pop()
        if tag in _VOID:
            continue
        classes = " ".join(a or b or c for a, b, c in _ATTR.findall(m[4] or "")).lower() if m[4] else ""
        label = stack[-1][2] if stack else -1
        if tag in _BAD or (classes and _BAD_CLASS.search(classes)):
            label = 0
        elif tag in _GOOD:
            label = 1
        if len(stack) >= DEEPEST:
            links -= stack.pop()[0] == "a"
        stack.append((tag, f"{tag}.{classes}" if classes else tag, label))
        links += tag == "a"
    flush()
    return out


class _Hashes(dict):
    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, w: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[w] = zlib.crc32(w.encode("utf-8", "replace")) % self.buckets
        return h


@dataclass
class Features:
    """Flat arrays over the blocks of many pages: hashed path elements and words with the block of each, and the numbers."""

    path: np.ndarray
    path_block: np.ndarray
    word: np.ndarray
    word_block: np.ndarray
    numbers: np.ndarray
    sizes: np.ndarray  # blocks of each page


def features(pages: list[list[Block]], words: _Hashes, paths: _Hashes, hidden: set[int] = frozenset(), part_of: list[tuple[int, int]] | None = None) -> Features:
    """hidden: pages whose landmark elements are left out of the paths. part_of: where each list begins in its page, and the page's blocks."""
    path, path_n, word, word_n, numbers = [], [], [], [], []
    for k, blocks in enumerate(pages):
        first, n = part_of[k] if part_of else (0, len(blocks))
        for i, b in enumerate(blocks, first):
            p = [e for e in b.path if k not in hidden or not (e.partition(".")[0] in _GOOD | _BAD or _BAD_CLASS.search(e.partition(".")[2]))]
            path += [paths[f"{min(d, DEPTH)}{e}"] for d, e in enumerate(reversed(p))]
            path_n.append(len(p))
            w = _WORDS.findall(b.text.lower())
            word += map(words.__getitem__, w)
            word_n.append(len(w))
            ends = b.text[-1] in ".!?:;\"'"
            numbers.append((min(2.0, np.log1p(len(w)) / 4), b.linked, 1.0 if ends else 0.0, i / n, min(1.0, n / 100), min(1.0, b.text.count(",") / 10)))
    total = len(path_n)
    return Features(np.array(path, np.int32), np.repeat(np.arange(total), path_n), np.array(word, np.int32), np.repeat(np.arange(total), word_n), np.array(numbers, np.float32).reshape(total, NUMBERS), np.array([len(b) for b in pages], np.int64))


def _mean(table: np.ndarray, at: np.ndarray, block: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.bincount(block, minlength=total).astype(np.float32)
    out = np.zeros((total, table.shape[1]), np.float32)
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        out[block[first]] = np.add.reduceat(table[at], first)
    return out / np.maximum(n, 1)[:, None], np.maximum(n, 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lstm(x: np.ndarray, w: np.ndarray, keep: bool = False):
    """x: (time, page, features); returns the hidden states, and what backward() needs."""
    t, b, d = x.shape
    h, c, out, memo = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32), np.zeros((t, b, HIDDEN), np.float32), []
    for k in range(t):
        if k % STEPS == 0:
            drive = (x[k : k + STEPS].reshape(-1, d) @ w[:d] + w[-1]).reshape(-1, b, 4 * HIDDEN)
        g = drive[k % STEPS] + h @ w[d : d + HIDDEN]
        s = _sigmoid(g[:, : 3 * HIDDEN])
        i, f, o, a = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
        before = (h, c)
        c = f * c + i * a
        q = np.tanh(c)
        h = o * q
        out[k] = h
        if keep:
            memo.append((i, f, o, a, q, *before))
    return out, memo


def _lstm_back(x: np.ndarray, w: np.ndarray, memo: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t, b, d = x.shape
    dw, dx = np.zeros_like(w), np.zeros_like(x)
    dh, dc = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
    for k in range(t - 1, -1, -1):
        i, f, o, a, q, h0, c0 = memo[k]
        dh = dh + dout[k]
        dc = dc + dh * o * (1 - q * q)
        dg = np.concatenate([dc * a * i * (1 - i), dc * c0 * f * (1 - f), dh * q * o * (1 - o), dc * i * (1 - a * a)], 1)
        dw[:d] += x[k].T @ dg
        dw[d : d + HIDDEN] += h0.T @ dg
        dw[-1] += dg.sum(0)
        dx[k] = dg @ w[:d].T
        dh, dc = dg @ w[d : d + HIDDEN].T, dc * f
    return dw, dx


class Labeller:
    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + NUMBERS
        self.p = {
            "path": rng.normal(0, 0.1, (PATH_BUCKETS, PATH_DIM)), "word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_DIM)),
            "right": rng.normal(0, 0.2, (d + HIDDEN + 1, 4 * HIDDEN)), "left": rng.normal(0, 0.2, (d + HIDDEN + 1, 4 * HIDDEN)), "out": np.zeros(2 * HIDDEN + 1),
        }
        for k in ("right", "left"):
            self.p[k][-1] = 0
            self.p[k][-1, HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.trained = False

    def _inputs(self, f: Features) -> np.ndarray:
        total = len(f.numbers)
        path, _ = _mean(self.p["path"], f.path, f.path_block, total)
        word, _ = _mean(self.p["word"], f.word, f.word_block, total)
        return np.concatenate([path, word, f.numbers], 1)

    @staticmethod
    def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(page, time, reversed time of each block, longest): a page's blocks begin at time 0 in both directions, padding follows."""
        page = np.repeat(np.arange(len(sizes)), sizes)
        time = np.arange(len(page)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return page, time, sizes[page] - 1 - time, int(sizes.max(initial=0))

    def _run(self, f: Features, keep: bool = False):
        x = self._inputs(f)
        page, time, back, t = self._places(f.sizes)
        xr, xl = (np.zeros((t, len(f.sizes), x.shape[1]), np.float32) for _ in range(2))
        xr[time, page], xl[back, page] = x, x
        (hr, mr), (hl, ml) = _lstm(xr, self.p["right"], keep), _lstm(xl, self.p["left"], keep)
        h = np.concatenate([hr[time, page], hl[back, page], np.ones((len(x), 1), np.float32)], 1)
        return h, (x, xr, xl, mr, ml, page, time, back)

    def label(self, pages: list[list[Block]], words: _Hashes, paths: _Hashes) -> list[np.ndarray]:
        """The chance that a block is content, for every block of every page. Pages of like length are run together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        if not self.trained:
            return [np.ones(len(p), np.float32) for p in pages]
        some: list[int] = []
        size = 0
        for i in sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i])):
            own = sum(len(b.path) + len(b.text) // 5 for b in pages[i])
            if some and ((len(some) + 1) * len(pages[i]) > CELLS or size + own > WORDS):
                self._label(some, pages, words, paths, out)
                some, size = [], 0
            some.append(i)
            size += own
        if some:
            self._label(some, pages, words, paths, out)
        return out

    def _label(self, some: list[int], pages: list[list[Block]], words: _Hashes, paths: _Hashes, out: list[np.ndarray]) -> None:
        f = features([pages[i] for i in some], words, paths)
        h, _ = self._run(f)
        for i, c in zip(some, np.split(_sigmoid(h @ self.p["out"]), np.cumsum(f.sizes)[:-1])):
            out[i] = c

    def fit(self, pages: list[list[Block]], steps: int = 150, batch: int = 32, rate: float = 0.01, seed: int = 11) -> Labeller:
        """Adam on the logistic loss of the blocks with a label, in whole epochs, for this number of steps at least."""
        parts = [(p[lo : lo + SEQUENCE], (lo, len(p))) for p in pages if {b.label for b in p} >= {0, 1} for lo in range(0, len(p), SEQUENCE)]
        parts = [x for x in parts if any(b.label >= 0 for b in x[0])]
        if not parts:
            return self
        pages, part_of = [p for p, _ in parts], [at for _, at in parts]
        rng, words, paths = np.random.default_rng(seed), _Hashes(WORD_BUCKETS), _Hashes(PATH_BUCKETS)
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        batches = [order[i : i + batch] for i in range(0, len(order), batch)]
        for _ in range(-(-steps // len(batches))):
            for k in rng.permutation(len(batches)):
                some = [pages[i] for i in batches[k]]
                f = features(some, words, paths, {i for i in range(len(some)) if rng.random() < 0.5}, [part_of[i] for i in batches[k]])
                y = np.array([b.label for p in some for b in p])
                h, (x, xr, xl, mr, ml, page, time, back) = self._run(f, keep=True)
                known = y >= 0
                e = np.where(known, _sigmoid(h @ self.p["out"]) - y, 0).astype(np.float32) / max(1, known.sum())
                g = {"out": h.T @ e}
                dh = e[:, None] * self.p["out"][None, :-1]
                dr, dl = (np.zeros((xr.shape[0], xr.shape[1], HIDDEN), np.float32) for _ in range(2))
                dr[time, page], dl[back, page] = dh[:, :HIDDEN], dh[:, HIDDEN:]
                g["right"], dxr = _lstm_back(xr, self.p["right"], mr, dr)
                g["left"], dxl = _lstm_back(xl, self.p["left"], ml, dl)
                dx = dxr[time, page] + dxl[back, page]
                for name, at, block, part in (("path", f.path, f.path_block, dx[:, :PATH_DIM]), ("word", f.word, f.word_block, dx[:, PATH_DIM : PATH_DIM + WORD_DIM])):
                    n = np.maximum(np.bincount(block, minlength=len(dx)), 1).astype(np.float32)
                    g[name] = np.zeros_like(self.p[name])
                    np.add.at(g[name], at, (part / n[:, None])[block])
                step += 1
                for name in self.p:
                    m[name] = 0.9 * m[name] + 0.1 * g[name]
                    v[name] = 0.999 * v[name] + 0.001 * g[name] ** 2
                    self.p[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self.trained = True
        return self


def fit(pages: DataFrame, max_pages: int = MAX_PAGES, max_chars: int = MAX_CHARS, **options) -> Labeller:
    """Fit on at most max_pages different pages with landmarks, and max_chars of them. Hashes and lengths are looked at first, then the html of those pages alone is brought to the driver."""
    told = pages.where(F.col("html").rlike(HAS_GOOD) & F.col("html").rlike(HAS_BAD)).select("html", F.xxhash64("html").alias("h"))
    first = told.groupBy("h").agg(F.max(F.length("html")).alias("n")).orderBy("h").limit(max_pages).collect()
    chosen, chars = [], 0
    for r in first:
        chars += r.n
        if chosen and chars > max_chars:
            break
        chosen.append(r.h)
    if not chosen:
        return Labeller()
    rows = told.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("html").alias("html")).collect()
    return Labeller().fit([split_blocks(r.html) for r in sorted(rows, key=lambda r: r.h)], **options)


def _extractor(model: Labeller):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, paths = _Hashes(WORD_BUCKETS), _Hashes(PATH_BUCKETS)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                pages = [split_blocks(h.as_py()) for h in part.column(1)]
                chances = model.label(pages, words, paths)
                text = ["\n".join(x.text for x, c in zip(p, cs) if c >= 0.5) for p, cs in zip(pages, chances)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string()), pa.array([len(p) for p in pages], pa.int32()), pa.array([int((c >= 0.5).sum()) for c in chances], pa.int32())], names=["page_id", "text", "blocks", "content_blocks"])

    return extract


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, text, blocks, content_blocks of every page."""
    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(lean(_extractor(model)), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the text of all pages."""
    pages = read_table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
