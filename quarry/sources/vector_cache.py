"""The cache of vectors by content hash: rows in a fixed order, blocks and gathers, parts of a run that was cut off, fixed-size files.

A cache is a folder with `rows` (row_id, content_hash, v; written whole) and `pending` (content_hash, v;
appended batch by batch while new contents are encoded, so that a run which ends early loses one batch
at most). A batch counts once Spark has committed it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from ..functions.vectors import norm

ROWS_PER_FILE = 20_000
CACHE = "content_hash string, v array<float>"


class WrongDimensions(ValueError):
    pass


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """(content_hash, v) of everything that was finished, ordered rows first, each content once."""
    rows = _read(spark, f"{folder}/rows", "row_id long, " + CACHE).select("content_hash", "v", F.lit(0).alias("late"))
    both = rows.unionByName(_read(spark, f"{folder}/pending", CACHE).select("content_hash", "v", F.lit(1).alias("late")))
    return both.groupBy("content_hash").agg(F.min_by("v", "late").alias("v"))


def add_pending(vectors: DataFrame, folder: str) -> None:
    """Append one batch of new vectors."""
    vectors.select("content_hash", F.col("v").cast("array<float>").alias("v")).write.mode("append").parquet(f"{folder}/pending")


def resume(contents: DataFrame, folder: str, encode: Callable[[DataFrame], DataFrame], batches: int = 1) -> int:
    """Encode the contents (content_hash, text) that the cache lacks, in batches by hash, each appended when it's done. Returns how many batches had work."""
    spark, done = contents.sparkSession, 0
    for k in range(batches):
        part = contents.where(F.pmod(F.xxhash64("content_hash"), F.lit(batches)) == k)
        missing = part.dropDuplicates(["content_hash"]).join(load(spark, folder).select("content_hash"), "content_hash", "left_anti")
        if not missing.isEmpty():
            add_pending(encode(missing), folder)
            done += 1
    return done


def finish(order: DataFrame, folder: str, out: str, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Write the vectors of order (row_id, content_hash) to another folder in files of a fixed number of rows, in order of row_id; contents without a vector are an error. The rows.

    A folder is replaced as a whole, so no file of an older, longer run stays behind."""
    spark = order.sparkSession
    found = order.join(load(spark, folder), "content_hash", "left")
    lost = found.where("v is null").count()
    if lost:
        raise ValueError(f"{lost} contents have no vector")
    files = F.floor(F.col("row_id") / rows_per_file).cast("int")
    n = (found.agg(F.max("row_id")).first()[0] or 0) // rows_per_file + 1
    placed = found.select("row_id", "content_hash", "v").repartitionById(int(n), files).sortWithinPartitions("row_id")
    placed.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{out}/rows")
    return spark.read.parquet(f"{out}/rows")


def check_dims(rows: DataFrame, dims: int) -> DataFrame:
    """rows; a vector of another length is an error when it is read."""
    wrong = F.raise_error(F.concat(F.lit("wrong dimensions in row "), F.col("row_id").cast("string"))).cast("array<float>")
    return rows.withColumn("v", F.when(F.size("v") == dims, F.col("v")).otherwise(wrong))


def block(rows: DataFrame, lo: int, hi: int) -> DataFrame:
    """Rows lo .. hi - 1, in order; files outside are skipped by their minima and maxima."""
    return rows.where((F.col("row_id") >= lo) & (F.col("row_id") < hi)).orderBy("row_id")


def take(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(place, row_id, v) of wanted (place, row_id), in order of place; a row may be wanted more than once. A row that isn't there is an error."""
    lost = F.raise_error(F.concat(F.lit("no such row: "), F.col("row_id").cast("string"))).cast("array<float>")
    found = wanted.select("place", "row_id").join(rows.select("row_id", "v", F.lit(True).alias("there")), "row_id", "left")
    return found.select("place", "row_id", F.when(F.col("there"), F.col("v")).otherwise(lost).alias("v")).orderBy("place")


def places(ids: DataFrame) -> DataFrame:
    """(row_id, content_hash) in order of content_hash, counted from 0 within ranges that are sorted apart, so that no task sorts all."""
    sorted_ = ids.select("content_hash").distinct().repartitionByRange("content_hash").withColumn("part", F.spark_partition_id())
    sizes = sorted_.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each range
    at = F.row_number().over(Window.partitionBy("part").orderBy("content_hash")) - 1
    return sorted_.withColumn("at", at).join(F.broadcast(before), "part").select((F.col("before") + F.col("at")).alias("row_id"), "content_hash")


def unit_share(rows: DataFrame) -> DataFrame:
    """(n, unit): how many vectors, and the share that has unit length."""
    return rows.agg(F.count("*").alias("n"), F.avg((F.abs(norm(F.col("v")) - 1) < 1e-3).cast("double")).alias("unit"))
