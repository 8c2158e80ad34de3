"""Token-ID output as ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

Texts are tokenised whole with a public byte-level vocabulary (its path is a parameter; ids are
decoded back to the exact text). The query's rows are sorted by doc_id within each file, so that stripes
and row groups have narrow id ranges; the pipeline's stage keeps the order it is given, which is the
training order. Ids and counts are integer columns, which ORC run-length encodes. A
reader takes stripes in parallel, and skips stripes and row groups that minima and maxima or the Bloom
filters rule out (see read_ids, stripes and rows_read).

Defined cases
* null text: one row with 0 tokens and a null array; empty text: 0 tokens and an empty array.
* null doc_id: stored with a null id. Repeated rows: one row each.
* very long texts: one row, one array. Empty tables: a readable table without rows.
* extra columns: not stored. Text that looks like a special token is ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_file_order, lean, new_path, read_table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How text is cut before the merges of that vocabulary apply.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Row group of the row index, stripe size, false positives of the Bloom filters.
ORC = {"compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(64 << 20), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
SCHEMA = "doc_id long, n_tokens int, token_ids array<int>"
#: Characters that are tokenised before a batch is sent on.
BATCH_CHARS = 4_000_000
_loaded: dict[str, tiktoken.Encoding] = {}


def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    """The tokenizer, loaded once in each Python process."""
    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)

        def flush(ids: list, parts: list) -> pa.RecordBatch:
            sizes = [None if p is None else len(p) for p in parts]
            offsets = np.concatenate([[0], np.cumsum([n or 0 for n in sizes])]).astype(np.int32)
            flat = np.concatenate([p for p in parts if p is not None] or [np.zeros(0, np.uint32)]).astype(np.int32, copy=False)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([p is None for p in parts]))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([n or 0 for n in sizes], pa.int32()), lists], names=["doc_id", "n_tokens", "token_ids"])

        for b in batches:
            ids, parts, chars = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py()
                ids.append(i)
                parts.append(None if text is None else enc.encode_to_numpy(text, disallowed_special=()))
                chars += len(text or "")
                if chars > BATCH_CHARS:
                    yield flush(ids, parts)
                    ids, parts, chars = [], [], 0
            if ids:
                yield flush(ids, parts)

    return encode


def tokenise(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(lean(_encoder(path)), SCHEMA)


def write(docs: DataFrame, out: str, path: str = VOCABULARY, by_id: bool = True) -> str:
    """Tokenise docs into an ORC table at out; no shuffle. Sorted within each file, or in the order of docs."""
    rows = docs.select("doc_id", "text")
    tokenise(rows.sortWithinPartitions("doc_id") if by_id else rows, path).write.options(**ORC).orc(out)
    return out


def read(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(out)


def read_ids(spark: SparkSession, out: str, ids: list[int]) -> DataFrame:
    """The rows of some documents; the predicate reaches the ORC reader, which skips stripes and row groups."""
    return read(spark, out).where(F.col("doc_id").isin(list(ids)))


def _reader(spark: SparkSession, file: str):
    orc, fs = spark._jvm.org.apache.orc.OrcFile, spark._jvm.org.apache.hadoop.fs.Path(file)
    return orc.createReader(fs, orc.readerOptions(spark._jsc.hadoopConfiguration()))


def stripes(spark: SparkSession, out: str) -> DataFrame:
    """(file, stripe, begin, bytes, rows, low, high): the units that can be read in parallel, with the least and greatest doc_id, from the footers alone, through Hadoop's file system. One row a stripe; the driver opens the footers."""
    rows = []
    column = SCHEMA.split(", ").index("doc_id long") + 1
    for file in sorted(spark.read.orc(out).inputFiles()):
        r = _reader(spark, file)
        of = list(r.getStripeStatistics())
        for i, s in enumerate(r.getStripes()):
            c = of[i].getColumnStatistics()[column]
            known = c.getNumberOfValues() > 0
            rows.append((file, i, s.getOffset(), s.getLength(), s.getNumberOfRows(), c.getMinimum() if known else None, c.getMaximum() if known else None))
        r.close()
    return spark.createDataFrame(rows, "file string, stripe int, begin long, bytes long, rows long, low long, high long")


def rows_read(spark: SparkSession, file: str, ids: list[int] | None) -> int:
    """Rows that the ORC reader hands over for documents in one file, after it has skipped stripes and row groups by minima, maxima and Bloom filters. It's a measure, not a way to read."""
    r = _reader(spark, file)
    options = r.options()
    if ids:
        leaf = spark._jvm.org.apache.hadoop.hive.ql.io.sarg
        kind = getattr(spark._jvm, "org.apache.hadoop.hive.ql.io.sarg.PredicateLeaf$Type").LONG
        numbers = spark.sparkContext._gateway.new_array(spark._jvm.long, len(ids))
        for k, i in enumerate(ids):
            numbers[k] = i
        values = spark._jvm.java.util.stream.LongStream.of(numbers).boxed().toArray()
        options.searchArgument(getattr(leaf.SearchArgumentFactory.newBuilder().startAnd(), "in")("doc_id", kind, values).end().build(), None)
    batch, rows, n = r.getSchema().createRowBatch(), r.rows(options), 0
    while rows.nextBatch(batch):
        n += batch.count()
    rows.close()
    r.close()
    return n


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents, written as ORC and read from there."""
    return read(spark, write(read_table(spark, sf_dir, "documents"), new_path(spark, "tokens")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_file_order(read(spark, write(in_file_order(docs), new_path(spark, "tokens"), by_id=False)))
