"""Integrity rules over builds: coverage, assignment, keys, references, floors. Each returns a table of findings or a row of flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_CLUSTERS = 9999
MAX_DANGLING, LEAST_ROWS = 25, 9000


def coverage(chunks: DataFrame, owners: DataFrame, key: str = "id") -> DataFrame:
    """One row (seen, missing, unknown, repeated, ok): is every chunk in exactly one cluster?"""
    n = owners.groupBy(key).agg(F.count("*").alias("n"))
    both = chunks.select(key, F.lit(1).alias("c")).join(n, key, "full_outer")
    out = both.agg(F.count("n").alias("seen"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("c").isNull()).alias("unknown"), F.count_if(F.col("n") > 1).alias("repeated"))
    return out.withColumn("ok", (F.col("missing") == 0) & (F.col("unknown") == 0) & (F.col("repeated") == 0))


def ascending(rows: DataFrame) -> DataFrame:
    """Rows (cluster_id, place, id) at which ids don't ascend within their cluster."""
    before = F.lag("id").over(Window.partitionBy("cluster_id").orderBy("place"))
    return rows.withColumn("before", before).where("before >= id")


def agreement(stored: DataFrame, again: DataFrame, sample: float | None = None) -> DataFrame:
    """One row (checked, equal, share) of stored and recomputed owners (id, cluster_id); sample: the share of ids to check, the same ones each time, None for all."""
    if sample is not None:
        stored = stored.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(sample * 1_000_000))
    j = stored.join(again.withColumnRenamed("cluster_id", "got"), "id")
    return j.agg(F.count("*").alias("checked"), F.count_if(F.col("cluster_id") == F.col("got")).alias("equal")).withColumn("share", F.col("equal") / F.col("checked"))


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def unknown(rows: DataFrame, docs: DataFrame, column: str, key: str) -> DataFrame:
    """Distinct values of a column that no document has."""
    return rows.select(F.col(column).alias(key)).distinct().join(docs.select(key), key, "left_anti")


def floors(docs: DataFrame, dangling: int, least: int = LEAST_ROWS, most: int = MAX_DANGLING) -> DataFrame:
    """One row (rows, enough, dangling, few)."""
    return docs.agg(F.count("*").alias("rows")).select("rows", (F.col("rows") >= least).alias("enough"), F.lit(dangling).alias("dangling"), F.lit(dangling <= most).alias("few"))


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def check_build(clusters: int, scale: float, shard_rows: int, chunk_rows: int, allow_partial: bool = False) -> None:
    """Rules that stop a build before anything is written."""
    require(clusters <= MAX_CLUSTERS, f"{clusters} clusters; file names hold {MAX_CLUSTERS}")
    require(scale > 0, "the scale must be positive")
    require(shard_rows <= chunk_rows, f"{shard_rows} vectors for {chunk_rows} chunks")
    require(allow_partial or shard_rows == chunk_rows, f"{shard_rows} vectors for {chunk_rows} chunks; allow partial builds to go on")
