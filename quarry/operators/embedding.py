"""Sentence vectors: a pluggable encoder behind an Arrow map, with a registry of models.

Model weights aren't part of this repository. The hashing encoder needs none: it makes builds and
tests reproducible, and is not a replacement for a learned model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class ModelSpec:
    name: str
    pooling: str  # cls or mean
    query_prefix: str
    max_length: int
    dims: int


MODELS = {
    "bge-small": ModelSpec("bge-small", "cls", "Represent this sentence for searching relevant passages: ", 512, 384),
    "minilm-l6": ModelSpec("minilm-l6", "mean", "", 256, 384),
    "hashing": ModelSpec("hashing", "mean", "", 1 << 30, 64),
}
#: File of a model and bytes of a weight, by variant.
VARIANTS = {"fp32": ("model.onnx", 4.0), "fp16": ("model_fp16.onnx", 2.0), "int8": ("model_int8.onnx", 1.0), "uint8": ("model_uint8.onnx", 1.0), "q4": ("model_q4.onnx", 0.5)}


def variant(model: str, kind: str) -> tuple[ModelSpec, str]:
    """(model, file of its variant); an unknown one of either is an error that names those there are."""
    if model not in MODELS:
        raise KeyError(f"unknown model {model!r}; there are {', '.join(MODELS)}")
    if kind not in VARIANTS:
        raise KeyError(f"unknown variant {kind!r}; there are {', '.join(VARIANTS)}")
    return MODELS[model], VARIANTS[kind][0]


def pool(states: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """(batch, tokens, dims) to unit vectors: the first token, or the mean of those that aren't padding."""
    v = states[:, 0] if how == "cls" else (states * mask[..., None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1e-9)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC, _ONES = _crc_table(), np.uint32(0xFFFFFFFF)


def _crc_step(c: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _CRC[(c ^ byte) & 255] ^ (c >> 8)


class HashingEncoder:
    """Signed hashed words and letter triples, summed, of unit length. The sums of KEPT words at most are kept, since words recur."""

    KEPT, AT_ONCE, LONG = 1 << 17, 1 << 15, 100  # words kept, words met at a time, letters beyond which a word isn't kept

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims
        self._forget()

    def __getstate__(self) -> dict:
        return {"dims": self.dims}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _forget(self) -> None:
        self._places: dict[str, int] = {}
        self._sums = np.zeros((0, self.dims), np.float32)

    def _rows(self, words: list[str]) -> np.ndarray:
        """A row of sums for each word; the triples of all of them are hashed at a time."""
        from zlib import crc32

        coded = [w.encode() for w in words]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        letters, owner = np.frombuffer(b"".join(coded), np.uint8), np.repeat(np.arange(len(words)), size)
        first = np.append(np.flatnonzero((letters & 0xC0) != 0x80), len(letters))  # of each letter, and the end
        at = np.flatnonzero(owner[first[:-3]] == owner[first[2:-1]])
        start, length, h = first[at], first[at + 3] - first[at], np.full(len(at), _ONES)
        for k in range(length.max(initial=0)):
            some = slice(None) if k < 3 else np.flatnonzero(length > k)
            h[some] = _crc_step(h[some], letters[start[some] + k])
        h = np.concatenate([np.fromiter(map(crc32, coded), np.int64, len(coded)), (h ^ _ONES).astype(np.int64)])
        row = np.concatenate([np.arange(len(words)), owner[start]])
        return np.bincount(row * self.dims + h % self.dims, np.where(h & 0x10000, 1.0, -1.0), len(words) * self.dims).reshape(len(words), self.dims)

    def _learn(self, words: set[str]) -> None:
        """Sums of words that are needed now, AT_ONCE at most."""
        new = words.difference(self._places)
        if len(self._places) + len(new) > self.KEPT:
            self._forget()
            new = words
        some, at = list(new), len(self._places)
        if not some:
            return
        if len(self._sums) < at + len(some):
            self._sums = np.concatenate([self._sums, np.zeros((max(len(some), min(len(self._sums), self.KEPT - len(self._sums))), self.dims), np.float32)])
        self._sums[at : at + len(some)] = self._rows(some)
        self._places.update(zip(some, range(at, at + len(some))))

    def _add(self, pieces: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        words = set().union(*(words for _, words in pieces))
        long = {w for w in words if len(w) > self.LONG}
        self._learn(words - long)
        for at, words in pieces:
            if long and not long.isdisjoint(words):
                for w in filter(long.__contains__, words):
                    out[at] += self._rows([w])[0]
                words = [w for w in words if w not in long]
            out[at] += self._sums[np.fromiter(map(self._places.__getitem__, words), np.int64, len(words))].sum(0)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out, pieces, held = np.zeros((len(texts), self.dims)), [], 0
        for at, t in enumerate(texts):
            words = (t or "").lower().split()
            for lo in range(0, len(words), self.AT_ONCE):
                some = words[lo : lo + self.AT_ONCE]
                if held + len(some) > self.AT_ONCE:
                    self._add(pieces, out)
                    pieces, held = [], 0
                pieces.append((at, some))
                held += len(some)
        self._add(pieces, out)
        out = out.astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class OnnxEncoder:
    """A transformer in ONNX: tokenise, cut, pad to the longest of the batch, pool, normalise. Loaded once in each worker."""

    def __init__(self, model_path: str, tokenizer_path: str, spec: ModelSpec, open_session: Callable | None = None) -> None:
        self.model_path, self.tokenizer_path, self.spec, self._session, self._open = model_path, tokenizer_path, spec, open_session, None
        self.truncated = 0  # texts that filled the model's length

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self._open is None:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(self.tokenizer_path)
            tokenizer.enable_truncation(self.spec.max_length)
            tokenizer.enable_padding()
            if self._session is None:
                import onnxruntime

                self._session = onnxruntime.InferenceSession
            self._open = tokenizer, self._session(self.model_path)
        tokenizer, net = self._open
        coded = tokenizer.encode_batch(texts)
        ids, mask = (np.array([getattr(c, k) for c in coded], np.int64) for k in ("ids", "attention_mask"))
        self.truncated += int((mask.sum(1) >= self.spec.max_length).sum())
        feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        states = net.run(None, {i.name: feed[i.name] for i in net.get_inputs() if i.name in feed})[0]
        return pool(states, mask.astype(np.float32), self.spec.pooling)


def embed(contents: DataFrame, encoder: Callable[[list[str]], np.ndarray], batch: int = 32, query_prefix: str = "") -> DataFrame:
    """(content_hash, v) of (content_hash, text). Texts of like length share a batch, so little is padded; queries get their prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            order = np.argsort(np.asarray(pc.utf8_length(texts)), kind="stable")
            out: list = [None] * len(texts)
            for lo in range(0, len(order), batch):
                some = order[lo : lo + batch]
                for i, v in zip(some, encoder([query_prefix + t for t in texts.take(pa.array(some)).to_pylist()])):  # only these as Python's
                    out[i] = v.astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], names=["content_hash", "v"])

    return contents.select("content_hash", "text").mapInArrow(run, "content_hash string, v array<float>")
