"""The corpus pipeline: documents that pass the quality classifier, one of each group of near copies,
none that hold benchmark text, repeated to their sources' weights, as token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and reads
it again as the next stage's docs. All but the last return the columns of documents.

Defined cases
* null, empty or blank text: rejected by the first stage. Very long texts: whole in every stage.
* null doc_id: passes as far as its text allows; tokens are stored under a null id.
* rows with the same doc_id and text: one stays; the same doc_id with different texts: documents of their own.
* nulls in other columns: a null source is the source ''. Extra columns, whatever their names: kept until the last stage, which has three of its own.
* ties: see the operators. An empty table, or one of which nothing is left: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bottomk, curriculum, positional, quality, token_store
from quarry.llm.common import delete, new_path, swept

STAGES = [
    ("quality_classifier", quality.stage),
    ("minhash_near_dedup", bottomk.stage),
    ("benchmark_decontamination", positional.stage),
    ("source_mixing", curriculum.stage),
    ("token_output", token_store.stage),
]
#: A learned ranking and a tokenizer can't be written in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Earlier stages and the tables that they needed are deleted as soon as the next one is stored."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES:
        path = new_path(spark, name)
        with swept(spark):
            function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
