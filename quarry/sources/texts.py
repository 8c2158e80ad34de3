"""Readers of source texts and of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "doc_id string, section string, title string, offset long, length long, seq int, text string"


def read_texts(spark: SparkSession, *paths: str, pattern: str = "*.txt") -> DataFrame:
    """(doc_id, doc_num, content, text, latin) of files and folders, in numeric order of their names. Bytes that aren't UTF-8 are Latin-1."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(list(paths))
    name = F.element_at(F.split("path", "/"), -1)
    ident = F.regexp_extract(name, r"(?i)^rfc(\d+[a-z]*)\.txt$", 1)
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(utf8, F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    doc = F.when(ident != "", ident).otherwise(name)
    out = raw.select(doc.alias("doc_id"), F.regexp_extract(doc, r"^(\d+)", 1).try_cast("int").alias("doc_num"), "content", text.alias("text"), (~utf8).alias("latin"))
    return out.orderBy(F.col("doc_num").asc_nulls_last(), "doc_id")


def read_chunks(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Chunks in JSON lines; blank lines are skipped, and only the asked columns are parsed."""
    df = spark.read.schema(CHUNK).option("mode", "FAILFAST").json(path)
    return df.select(*columns) if columns else df


def read_raw(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """(text): lines of a text file, or one field of JSON lines."""
    if field:
        return spark.read.schema(f"`{field}` string").json(path).select(F.col(f"`{field}`").alias("text"))
    return spark.read.text(path).where("value <> ''").select(F.col("value").alias("text"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines, characters beyond ASCII as they are."""
    chunks.write.mode("overwrite").json(path)


def source_digests(texts: DataFrame) -> DataFrame:
    """(doc_id, digest) by which changed documents are found."""
    return texts.select("doc_id", F.sha2("content", 256).alias("digest"))
