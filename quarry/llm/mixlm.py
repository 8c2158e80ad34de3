"""Language-model scores (bits per byte) by online logistic context mixing.

Every bit of every byte is predicted in six hashed contexts: the last 0, 1, 2, 3 and 4 bytes, and the
current word's bytes (its last 4 at most, apart by how many there are). A context's counts of zeros and ones give a stretched probability; these are
combined by weights that a gate selects (bit position and how many of the long contexts are known),
and an adaptive map, by last byte and mixed probability, refines the result. The cost of a byte is
-log2 of the probability given to it; a document's score is its total cost over its bytes.

Gathering: counts of all contexts over all documents are summed (tables from every input split, by
adaptive fan-in), so what is gathered grows with the corpus while the tables keep their fixed size.
Scoring: documents are hashed into shards of about SHARD bytes. A shard starts from the counts of all
*other* shards (the total less its own), then runs through its documents in a fixed order, and after
each block adds what it has seen and moves the weights and the map. No document helps to predict
itself, and a score depends on the corpus only, not on how tasks are spread.

Within a block the model is fixed; equal 5-byte strings then cost the same, so each distinct one is
computed once. Blocks double from BLOCK bytes up to BLOCK_MOST, so that learning is quick at first; a
full shard has some 70 of them. A repeat within one block costs what the first one does.

Counts are summed and a shard's own are taken off as integers. A slot above COUNT is then scaled down to
it, so that what a shard adds still moves it, however large the corpus.

Defined cases
* null or empty text: 0 bytes, 0 bits, null bits per byte.
* null doc_id: scored under a null id. Repeated rows: one row each; later copies cost less, since the
  shard has seen the earlier ones (equal rows are in the same shard).
* very long texts: whole, across as many blocks as it takes. Extra columns: ignored. Empty table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read_table

SHARD, BLOCK, BLOCK_MOST, GATHER, COUNT = 16 << 20, 1 << 12, 1 << 18, 1 << 22, 1 << 20
BITS = (8, 16, 18, 19, 20, 19)  # size of each context's table; the last is the word
OFFSET = np.concatenate([[0], np.cumsum([1 << b for b in BITS])]).astype(np.int64)
SLOTS, CHUNK, FAN_IN = int(OFFSET[-1]), 1 << 15, 64
PAD = 4  # bytes before a document: contexts begin empty
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_SPACE = np.zeros(256, bool)
_SPACE[:33] = True


def stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with PAD zeros before each document, begin, end of each document in them)."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    end = np.cumsum(size + PAD)
    return np.frombuffer(b"".join(b"\0" * PAD + r for r in raw), np.uint8), end - size, end


def _inside(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Which bytes aren't padding."""
    out = np.ones(len(data), bool)
    out[(begin[:, None] - np.arange(1, PAD + 1)).ravel()] = False
    return out


def grams(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The gram of each byte of data[lo:hi]: the 4 bytes before it and the byte."""
    some = np.concatenate([np.zeros(PAD - min(PAD, lo), np.uint8), data[max(0, lo - PAD) : hi], np.zeros(8, np.uint8)])
    window = np.ndarray((hi - lo,), ">u8", some, strides=(1,))  # eight bytes from each place on
    key = window.astype(np.uint64)
    key >>= np.uint64(24)
    return key


def coded(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each gram among the distinct ones, those): grams of 40 bits and their places of 24 are sorted as one number."""
    both = (key << np.uint64(24)) | np.arange(len(key), dtype=np.uint64)
    both.sort()
    at = (both & np.uint64(0xFFFFFF)).astype(np.int64)
    both >>= np.uint64(24)
    first = np.ones(len(key), bool)
    np.not_equal(both[1:], both[:-1], out=first[1:])
    codes = np.empty(len(key), np.int32)
    codes[at] = np.cumsum(first, dtype=np.int32) - 1
    return codes, both[first]


def slots(gram: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(for each context the table slot of each bit, the bits); arrays are (grams, 8)."""
    x, past = gram & np.uint64(0xFF), gram >> np.uint64(8)
    shift = np.arange(8, 0, -1, dtype=np.uint64)
    node = (x[:, None] | np.uint64(256)) >> shift
    bit = ((x[:, None] >> (shift - np.uint64(1))) & np.uint64(1)).astype(np.int64)
    known = np.zeros(len(gram), np.uint64)  # bytes of the current word, at most 4
    alive = np.ones(len(gram), bool)
    for i in range(PAD):
        alive &= ~_SPACE[((past >> np.uint64(8 * i)) & np.uint64(0xFF)).astype(np.int64)]
        known += alive
    word = (past & ((np.uint64(1) << (known * np.uint64(8))) - np.uint64(1))) | (known << np.uint64(40))
    out = []
    for i, bits in enumerate(BITS):
        if i == 0:
            at = node
        elif i == 1:
            at = ((past & np.uint64(0xFF)) << np.uint64(8))[:, None] | node
        else:
            context = word if i == 5 else past & np.uint64((1 << (8 * i)) - 1)
            h = (context + np.uint64(i)) * _K[0]
            at = (((h ^ (h >> np.uint64(32)))[:, None] ^ (node * _K[1])) * _K[2]) >> np.uint64(64 - bits)
        out.append(at.astype(np.int64) + OFFSET[i])
    return out, bit


def add(table: np.ndarray, gram: np.ndarray, count: np.ndarray, sign: int = 1) -> None:
    """Add the bits of counted grams to the table of (zeros, ones) pairs."""
    at, bit = slots(gram)
    _add(table, at, bit, count * sign)


def _add(table: np.ndarray, at: list[np.ndarray], bit: np.ndarray, count: np.ndarray) -> None:
    each = np.repeat(count.astype(table.dtype), 8)
    for a in at:
        np.add.at(table, (2 * a + bit).ravel(), each)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts (zeros, ones of each slot) as float32, with a sum of COUNT at most."""
    both = counts.reshape(-1, 2)
    return (both * np.minimum(1.0, COUNT / np.maximum(1, both.sum(1)))[:, None]).astype(np.float32).ravel()


class Mixer:
    """Gated weights and the adaptive map; both move after each block."""

    GATES, EDGE, PART = 32, 6.0, 8192

    def __init__(self) -> None:
        self.w = np.full((self.GATES, len(BITS)), 0.25)
        self.seen = np.zeros((256, 25, 2))

    def block(self, table: np.ndarray, gram: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Bits of cost of each gram; then learns from the counted grams, and adds them to the table."""
        pairs = table.view(np.complex64)  # zeros and ones of a slot are fetched together
        w, old = self.w.astype(np.float32), [self.seen[..., k].astype(np.float32).ravel() for k in (0, 1)]
        up, down, adds = np.zeros((len(BITS), self.GATES)), np.zeros((len(BITS), self.GATES)), []
        cost = np.zeros(len(gram))
        for lo in range(0, len(gram), self.PART):  # parts fit the cache; what they learn is applied at the end
            part, c = gram[lo : lo + self.PART], np.repeat(count[lo : lo + self.PART].astype(np.float32), 8)
            at, bit = slots(part)
            inputs, level = [], np.zeros(bit.shape, np.int8)
            for i, a in enumerate(at):
                n = np.maximum(pairs.take(a).view(np.float32), 0)
                if i in (2, 3, 4):
                    level += (n[:, 0::2] + n[:, 1::2]) > 0
                n += np.float32(0.4)
                inputs.append(np.log(n[:, 1::2] / n[:, 0::2]))
            gate = (level * np.int8(8) + np.arange(8, dtype=np.int8)).astype(np.int64)
            z = w[:, 0].take(gate) * inputs[0]
            for i in range(1, len(inputs)):
                z += w[:, i].take(gate) * inputs[i]
            np.clip(z, -14, 14, out=z)
            p = 1 / (1 + np.exp(-z))
            place = np.rint((np.clip(z, -self.EDGE, self.EDGE) + np.float32(self.EDGE)) * 2).astype(np.int64)
            place += ((part >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64)[:, None] * 25
            zero, one = old[0].take(place), old[1].take(place)
            refined = (one + 40 * p) / (zero + one + 40)
            right = (p + refined) / 2
            np.subtract(1, right, out=right, where=bit == 0)
            cost[lo : lo + self.PART] = -np.log2(np.maximum(right, np.float32(1e-6))).sum(1, dtype=np.float64)

            g, err, var = gate.ravel(), c * (bit - p).ravel().astype(np.float32), c * (p * (1 - p)).ravel()
            for i, s in enumerate(inputs):
                s = s.ravel()
                up[i] += np.bincount(g, err * s, self.GATES)
                down[i] += np.bincount(g, var * s * s, self.GATES)
            adds.append(((place * 2 + bit).ravel().astype(np.int32), [(2 * a + bit).ravel().astype(np.int32) for a in at], c))
        self.w += (up / (down + 50) / len(BITS)).T
        for flat, at, c in adds:
            self.seen += np.bincount(flat, c, self.seen.size).reshape(self.seen.shape)
            for a in at:
                np.add.at(table, a.astype(np.int64), c)
        return cost


def blocks(size: int) -> list[tuple[int, int]]:
    out, at, step = [], 0, BLOCK
    while at < size:
        out.append((at, min(size, at + step)))
        at, step = at + step, min(BLOCK_MOST, step * 2)
    return out


def score_shard(texts: list[str | None], total: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(bits, bytes) of each text, in this order. total: counts over the whole corpus, this shard's included."""
    data, begin, end = stream(texts)
    counts = np.zeros(2 * SLOTS, np.int64) if total is None else total.astype(np.int64)
    inside = _inside(data, begin)
    work = []
    for lo, hi in blocks(len(data)):
        codes, gram = coded(grams(data, lo, hi))
        count = np.bincount(codes[inside[lo:hi]], minlength=len(gram))
        work.append((lo, hi, codes, gram, count))
    if total is not None and work:
        which, own = pd.factorize(np.concatenate([w[3] for w in work]))
        add(counts, own, np.bincount(which, np.concatenate([w[4] for w in work]), len(own)).astype(np.int64), -1)
    table = scaled(counts)
    del counts
    mixer, cost = Mixer(), np.zeros(len(data) + 1)
    for lo, hi, codes, gram, count in work:
        cost[lo:hi] = mixer.block(table, gram, count)[codes]
    bits, some = np.zeros(len(texts)), np.flatnonzero(end > begin)
    if len(some):
        edges = np.stack([begin[some], end[some]], 1).ravel()
        bits[some] = np.add.reduceat(cost, edges)[::2]
    return bits, end - begin


def corpus_counts(texts: list[str | None]) -> np.ndarray:
    table = np.zeros(2 * SLOTS, np.int64)
    _count(table, texts)
    return table


def _count(table: np.ndarray, texts: list[str | None]) -> None:
    data, begin, end = stream(texts)
    inside = _inside(data, begin)
    for lo in range(0, len(data), GATHER):
        hi = min(len(data), lo + GATHER)
        gram, count = np.unique(grams(data, lo, hi)[inside[lo:hi]], return_counts=True)
        add(table, gram, count)


def _chunks(table: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Parts of a table that hold anything: places and values of what isn't 0."""
    for k in range(0, len(table), CHUNK):
        part = table[k : k + CHUNK]
        at = np.flatnonzero(part)
        if len(at):
            yield k // CHUNK, zlib.compress(np.diff(at, prepend=0).astype(np.uint16).tobytes() + part[at].tobytes(), 1)


def _open_chunk(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = zlib.decompress(raw)
    n = len(b) // 10
    return np.cumsum(np.frombuffer(b, np.uint16, n).astype(np.int64)), np.frombuffer(b[2 * n :], np.int64, n)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, some, size = np.zeros(2 * SLOTS, np.int64), [], 0
    for b in batches:
        for t in b.column(0):
            some.append(t.as_py())
            size += len(some[-1] or "")
            if size > GATHER:
                _count(table, some)
                some, size = [], 0
    _count(table, some)
    rows = list(_chunks(table))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.binary())], names=["chunk", "counts"])


def _sum_chunks(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CHUNK, np.int64)
    for raw in pdf["counts"]:
        at, n = _open_chunk(raw)
        total[at] += n
    rows = [v for _, v in _chunks(total)]
    return pd.DataFrame({"chunk": [key[0]] * len(rows), "part": [key[1]] * len(rows), "counts": rows})


def gather(docs: DataFrame) -> np.ndarray:
    """The counts of all documents: a table of each split, summed FAN_IN at a time, then brought to the driver (its size is fixed)."""
    parts = docs.select("text").mapInArrow(lean(_tables), "chunk int, counts binary").withColumn("part", F.spark_partition_id())
    n = max(1, docs.select("text").rdd.getNumPartitions())
    while True:
        n = -(-n // FAN_IN)
        parts = parts.withColumn("part", (F.col("part") / FAN_IN).cast("int") if n > 1 else F.lit(0)).groupBy("chunk", "part").applyInPandas(_sum_chunks, "chunk int, part int, counts binary")
        if n == 1:
            break
    table = np.zeros(2 * SLOTS, np.int64)
    for r in parts.select("chunk", "counts").collect():
        at, c = _open_chunk(bytes(r.counts))
        table[r.chunk * CHUNK + at] += c
    return table


def score(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """doc_id, bytes, bits, bits_per_byte of every document."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard))
    total = docs.sparkSession.sparkContext.broadcast(gather(docs))
    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).alias("shard"), F.xxhash64("text").alias("o"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "doc_id", "text"], kind="stable")
        bits, n = score_shard(list(pdf["text"]), total.value)
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64").values, "bytes": n, "bits": np.round(bits, 4)})

    out = rows.groupBy("shard").applyInPandas(run, "doc_id long, bytes long, bits double")
    return out.withColumn("bits_per_byte", F.when(F.col("bytes") > 0, F.round(F.col("bits") / F.col("bytes"), 6)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the score of every document."""
    return score(read_table(spark, sf_dir, "documents"))
