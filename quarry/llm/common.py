"""What the operators share: the cluster's shared folder, stored tables, joins behind a size check."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its rows, counted, take no more than this.
BROADCAST_BYTES = 16 << 20
ARROW_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Characters of a text that are cut into words at a time.
PART_CHARS = 1 << 20
_NO_WORD = re.compile(r"\W")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A temporary one is set only where none is, and only if there is one machine (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
    return now.get().rstrip("/")


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was written to new paths meanwhile: for results that are stored elsewhere by then."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        delete(spark, *made)


def delete(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession | None = None) -> None:
    """Arrow batches of ARROW_BYTES at most to Python, from now on in this session: long texts must not pile up in a worker. It changes no result, and isn't set back, so that no concurrent query depends on when."""
    spark = spark or SparkSession.getActiveSession()
    if spark and int(re.sub(r"\D", "", spark.conf.get(_BATCH)) or 0) != ARROW_BYTES:
        spark.conf.set(_BATCH, str(ARROW_BYTES))


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: later jobs neither recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    settle(spark)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def distinct(a: np.ndarray) -> np.ndarray:
    """The different values, in order. Sorting numbers is several times as quick as numpy's own way, which hashes them."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])[: len(a)]]


def trim() -> None:
    """Give the memory that this Python worker no longer uses back to the system: workers are kept for later tasks, beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """function for mapInArrow, in small batches, with trim() after it."""
    settle()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            trim()

    return run


def parts_of(text: str) -> Iterator[str]:
    """The text in parts of about PART_CHARS characters that cut no word, so that the words of a very long text need not all be in memory."""
    at = 0
    while len(text) - at > PART_CHARS:
        m = _NO_WORD.search(text, at + PART_CHARS)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    if at < len(text):
        yield text[at:] if at else text


def forget(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote and that no plan will read any more."""
    for df in tables:
        delete(df.sparkSession, df.stored_at)


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit in limit; else as it is, for a shuffled join with AQE. df must be cheap to count (a stored table)."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def in_file_order(df: DataFrame) -> DataFrame:
    """The rows of a folder as its files hold them, one partition a file, in the order of their names; the reader alone packs files by size. df must be the folder as read; tables without files stay as they are."""
    names = sorted({f.rsplit("/", 1)[-1] for f in df.inputFiles()})
    if not names:
        return df
    at, block, row = unused(df, "file_number", "file_block", "row_read")
    meta = df.metadataColumn("_metadata")
    number = F.array_position(F.array(*map(F.lit, names)), meta["file_name"]) - 1
    rows = df.withColumns({at: number.cast("int"), block: meta["file_block_start"], row: F.monotonically_increasing_id()})
    return rows.repartitionById(len(names), F.col(at)).sortWithinPartitions(block, row).drop(at, block, row)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that clash with no column of df, whatever the case of the letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
