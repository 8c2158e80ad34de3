"""The binary files of a vector index: a 24-byte header, 8-bit rows, and for clusters a columnar JSON tail.

Readable as Spark data sources: spark.read.format("quarry_clusters").load(folder) has a partition for
each file. Parquet is the engine's own format; these files are for exchange.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER = struct.Struct("<4sHHIIII")
CENTROIDS, CLUSTER, VERSION = b"RFCV", b"RFCC", 1
SCHEMA = "cluster_id int, row int, doc_id string, offset long, length long, section string, title string, q array<tinyint>"


class Corrupt(ValueError):
    pass


def pack_header(magic: bytes, dims: int, count: int, ident: int, tail: int = 0) -> bytes:
    return HEADER.pack(magic, VERSION, dims, count, ident, tail, 0)


def open_file(raw: bytes, magic: bytes, dims: int | None = None, ident: int | None = None) -> tuple[np.ndarray, bytes, int]:
    """(rows, tail, ident) after all checks of the header against the bytes."""
    if len(raw) < HEADER.size:
        raise Corrupt("shorter than its header")
    got, version, d, count, number, tail, _ = HEADER.unpack_from(raw)
    if got != magic:
        raise Corrupt(f"magic {got!r}")
    if version != VERSION:
        raise Corrupt(f"version {version}")
    if dims is not None and d != dims:
        raise Corrupt(f"{d} dimensions, not {dims}")
    if ident is not None and number != ident:
        raise Corrupt(f"ident {number}, not {ident}")
    end = HEADER.size + count * d
    if len(raw) != end + tail:
        raise Corrupt(f"{len(raw)} bytes, not {end + tail}")
    return np.frombuffer(raw, np.int8, count * d, HEADER.size).reshape(count, d), raw[end:], number


def read_centroids(raw: bytes, dims: int | None = None) -> np.ndarray:
    return open_file(raw, CENTROIDS, dims)[0]


def write_centroids(q: np.ndarray, ident: int = 0) -> bytes:
    return pack_header(CENTROIDS, q.shape[1], len(q), ident) + q.astype(np.int8).tobytes()


def tail_of(rows: list[tuple]) -> dict:
    """(doc_id, offset, length, section, title) rows as columns with one table of strings, in order of first use, -1 for null."""
    strings: dict[str, int] = {}
    put = lambda s: -1 if s is None else strings.setdefault(s, len(strings))
    sec, title = [], []
    for r in rows:
        sec.append(put(r[3]))
        title.append(put(r[4]))
    number = lambda d: int(d) if str(d).isdigit() else d
    return {"n": len(rows), "rfc": [number(r[0]) for r in rows], "off": [r[1] for r in rows], "len": [r[2] for r in rows], "sec": sec, "title": title, "str": list(strings)}


def write_cluster(ident: int, q: np.ndarray, rows: list[tuple]) -> bytes:
    tail = json.dumps(tail_of(rows), ensure_ascii=False, separators=(",", ":")).encode()
    return pack_header(CLUSTER, q.shape[1], len(q), ident, len(tail)) + q.astype(np.int8).tobytes() + tail


def read_cluster(raw: bytes, dims: int | None = None, ident: int | None = None) -> Iterator[tuple]:
    """(cluster_id, row, doc_id, offset, length, section, title, q) rows."""
    q, tail, number = open_file(raw, CLUSTER, dims, ident)
    try:
        t = json.loads(tail)
    except ValueError as e:
        raise Corrupt(f"tail: {e}") from None
    columns = [t.get(k) for k in ("rfc", "off", "len", "sec", "title")]
    if t.get("n") != len(q) or any(not isinstance(c, list) or len(c) != len(q) for c in columns):
        raise Corrupt("tail and rows differ in number")
    strings = t.get("str", [])
    if any(not -1 <= i < len(strings) for c in columns[3:] for i in c):
        raise Corrupt("string out of range")
    at = lambda i: None if i < 0 else strings[i]
    for k, (doc, off, n, sec, title) in enumerate(zip(*columns)):
        yield number, k, str(doc), off, n, at(sec), at(title), [int(x) for x in q[k]]


def atomic_write(path: str, raw: bytes) -> None:
    """The whole file or none."""
    with open(f"{path}.tmp", "wb") as f:
        f.write(raw)
    os.replace(f"{path}.tmp", path)


def path_of(template: str, ident: int) -> str:
    """{id:04d} in a template, for ids of any width."""
    return template.format(id=ident)


class _File(InputPartition):
    pass


class ClusterReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.dims = options["path"].removeprefix("file:"), int(options["dims"]) if "dims" in options else None

    def partitions(self) -> list[InputPartition]:
        return [_File(os.path.join(self.folder, n)) for n in sorted(os.listdir(self.folder)) if n.endswith(".bin")] or [_File(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            with open(partition.value, "rb") as f:
                yield from read_cluster(f.read(), self.dims)


class ClusterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarry_clusters"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ClusterReader(dict(self.options))


def read_clusters(spark: SparkSession, folder: str, dims: int | None = None) -> DataFrame:
    spark.dataSource.register(ClusterSource)
    r = spark.read.format("quarry_clusters")
    return (r.option("dims", str(dims)) if dims else r).load(folder)


def write_clusters(vectors: DataFrame, folder: str, template: str = "{id:04d}.bin") -> None:
    """A file for each cluster of (cluster_id, id, doc_id, offset, length, section, title, q), rows ascending by id; files go to a folder that all executors share."""
    os.makedirs(folder, exist_ok=True)

    def put(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("id", kind="stable")
        rows = [(r.doc_id, int(r.offset), int(r.length), r.section, r.title) for r in pdf.itertuples()]
        atomic_write(os.path.join(folder, path_of(template, int(key[0]))), write_cluster(int(key[0]), np.array(list(pdf["q"]), np.int8), rows))
        return pd.DataFrame({"cluster_id": [int(key[0])], "rows": [len(rows)]})

    vectors.groupBy("cluster_id").applyInPandas(put, "cluster_id int, rows long").count()
