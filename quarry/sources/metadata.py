"""Readers of the document metadata: the XML index, hand-written tag files, JSON tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from ..functions import text as T

_IDS = S.StructType([S.StructField("doc-id", S.ArrayType(S.StringType()))])
ENTRY = S.StructType([
    S.StructField("doc-id", S.ArrayType(S.StringType())), S.StructField("title", S.ArrayType(S.StringType())), S.StructField("keywords", S.StructType([S.StructField("kw", S.ArrayType(S.StringType()))])),
    S.StructField("current-status", S.ArrayType(S.StringType())), S.StructField("stream", S.ArrayType(S.StringType())), S.StructField("area", S.ArrayType(S.StringType())), S.StructField("wg_acronym", S.ArrayType(S.StringType())),
    S.StructField("obsoletes", _IDS), S.StructField("obsoleted-by", _IDS), S.StructField("is-also", _IDS),
])
#: Elements that an entry has once; a second one is an error.
ONCE = ("doc-id", "title", "current-status", "stream", "area", "wg_acronym")
NO_GROUP = "NON WORKING GROUP"


def _one(name: str):
    c = F.col(f"`{name}`")
    return F.when(F.size(c) > 1, F.raise_error(F.lit(f"repeated element: {name}")).cast("string")).otherwise(F.trim(F.try_element_at(c, F.lit(1))))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the XML index: (doc_id, doc_num, status, level, stream, title, keywords, wg, area, obsoletes). Entries of other kinds don't count."""
    raw = spark.read.format("xml").option("rowTag", "rfc-entry").option("mode", "FAILFAST").schema(ENTRY).load(path)
    one = {n: _one(n) for n in ONCE}
    doc = T.doc_name(one["doc-id"])
    return raw.select(
        doc.alias("doc_id"), T.doc_number(one["doc-id"]).alias("doc_num"), F.when(F.size("`obsoleted-by`.`doc-id`") > 0, "obsoleted").otherwise("current").alias("status"),
        T.level(one["current-status"]).alias("level"), F.lower(one["stream"]).alias("stream"), one["title"].alias("title"),
        F.coalesce(F.transform("keywords.kw", F.trim), F.array().cast("array<string>")).alias("keywords"), F.nullif(one["wg_acronym"], F.lit(NO_GROUP)).alias("wg"), one["area"].alias("area"),
        F.transform("`obsoletes`.`doc-id`", T.doc_name).alias("obsoletes"),
    )


def read_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, bool]:
    """(table, whether it failed): a table that can't be read, or any of whose files isn't an object or a list of objects of the schema, is empty, and said to have failed."""
    rows = f"array<struct<{schema}>>" if "<" in schema or ":" in schema else f"array<struct<{', '.join(f'{n}:{k}' for n, k in (c.split() for c in schema.split(',')))}>>"
    empty = spark.createDataFrame([], schema)
    try:
        raw = spark.read.text(path, wholetext=True)
        text = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
        listed = F.when(F.startswith(text, F.lit("[")), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
        parsed = raw.select(F.from_json(listed, rows, {"mode": "PERMISSIVE"}).alias("rows"), F.try_parse_json(listed).isNull().alias("broken"))
        bad = parsed.where(F.col("broken") | F.col("rows").isNull() | F.exists(F.coalesce("rows", F.array().cast(rows)), lambda x: x.isNull())).limit(1).count()
    except AnalysisException:
        return empty, True
    return (empty, True) if bad else (parsed.select(F.inline("rows")), False)


def read_documents_json(spark: SparkSession, path: str) -> DataFrame:
    """The same columns from a JSON object keyed by document name."""
    entry = "struct<status:string,level:string,stream:string,title:string,keywords:array<string>,wg:string,area:string,obsoletes:array<string>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("k", "v"))
    return raw.select(T.doc_name(F.col("k")).alias("doc_id"), T.doc_number(F.col("k")).alias("doc_num"), "v.*").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, normative) from {document: {normative: [...], informative: [...]}}; numbers and names alike."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,array<string>>>")).alias("src", "kinds"))
    pairs = raw.select("src", F.explode("kinds").alias("kind", "to")).select("src", "kind", F.explode("to").alias("dst"))
    return pairs.select(T.doc_name(F.col("src")).alias("src"), T.doc_name(F.col("dst")).alias("dst"), (F.col("kind") == "normative").alias("normative"))


def read_tag_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(collections, members, rejects) of tag files: "RFCnnnn text", "name X", "colour #hex" lines; others are ignored.

    The first name (else the file's) and the first colour, in lower case, hold; of files with the same name the later one. Malformed document lines are rejected with a warning."""
    raw = spark.read.text(path, lineSep="\n").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.monotonically_increasing_id().alias("line_no"), T.strip_unicode(F.col("value")).alias("line"))
    line = raw.withColumn("field", F.lower(F.regexp_extract("line", r"^(\S+)", 1))).withColumn("rest", F.regexp_extract("line", r"^\S+\s+(.*)$", 1))
    number = F.regexp_extract("field", r"^rfc0*(\d+)$", 1)
    named = line.groupBy("file").agg(
        F.min_by(F.when(F.col("field").isin("name", "name:"), F.col("rest")), F.when(F.col("field").isin("name", "name:"), F.col("line_no"))).alias("given"),
        F.min_by(F.lower(F.when(F.col("field").isin("colour", "colour:"), F.col("rest"))), F.when(F.col("field").isin("colour", "colour:"), F.col("line_no"))).alias("colour"),
    )
    named = named.select("file", F.coalesce("given", "file").alias("tag_name"), "colour")
    latest = named.withColumn("r", F.row_number().over(Window.partitionBy("tag_name").orderBy(F.col("file").desc()))).where("r = 1").drop("r")
    docs = line.where(number != "").select("file", "line_no", F.concat(F.lit("RFC"), number).alias("doc_id"))
    members = docs.groupBy("file", "doc_id").agg(F.min("line_no").alias("line_no")).join(latest, "file").select("tag_name", "doc_id", "line_no")
    rejects = line.where(F.col("field").startswith("rfc") & (number == "")).select("file", "line")
    return latest.select("tag_name", "colour"), members, rejects


def describe_tag_lines(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """Tag lines (file, line_no, line) with the titles of their documents put in; lines without trailing text, and other lines, stay."""
    number = F.regexp_extract(F.lower("line"), r"^rfc0*(\d+)\s+\S", 1)
    known = docs.select(F.col("doc_id").alias("k"), "title")
    out = lines.withColumn("k", F.when(number != "", F.concat(F.lit("RFC"), number))).join(known, "k", "left")
    lost = F.raise_error(F.concat(F.lit("no such document: "), F.col("k"))).cast("string")
    return out.select("file", "line_no", F.when(F.col("k").isNull(), F.col("line")).when(F.col("title").isNull(), lost).otherwise(F.concat("k", F.lit(" "), "title")).alias("line"))


def write_tag_files(described: DataFrame, folder: str) -> list[str]:
    """Write described lines (file, line_no, line) back, a file at a time and at once; a file whose text doesn't change isn't touched. The names of those that were. The files are small, and lie where the driver can write."""
    written = []
    for r in described.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines")).orderBy("file").toLocalIterator():
        path, text = os.path.join(folder, r.file), "".join(f"{x.line}\n" for x in r.lines)
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                if f.read() == text:
                    continue
        with open(f"{path}.tmp", "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(f"{path}.tmp", path)
        written.append(r.file)
    return written
