"""Retrieval metrics over ranked results. ranked: (query_id, doc_id, place); relevant: (query_id, doc_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard

MISSING = 1_000_000


def per_query(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, reciprocal, first): share of relevant documents among the first k, 1 / place of the first, that place (MISSING if none)."""
    hit = relevant.join(ranked, ["query_id", "doc_id"], "left")
    first = F.min("place")
    return hit.groupBy("query_id").agg((F.count(F.when(F.col("place") <= k, 1)) / F.count("*")).alias("recall"), F.coalesce(1 / first, F.lit(0.0)).alias("reciprocal"), F.coalesce(first, F.lit(MISSING)).alias("first"))


def per_query_of_sets(ranked: DataFrame, asked: DataFrame, members: DataFrame, k: int = 10) -> DataFrame:
    """per_query where the documents relevant to a query are those of its sets: only ranked ones are met with their query, the others counted by set.

    asked: (query_id, set_id), members: (set_id, doc_id). A query in several sets has the documents of any; one without documents is left out."""
    queries = asked.where("set_id IS NOT NULL").groupBy("query_id").agg(F.sort_array(F.collect_set("set_id")).alias("sets"))
    docs = queries.select("sets").distinct().select("sets", F.explode("sets").alias("set_id")).join(members, "set_id").select("sets", "doc_id").distinct()
    total = docs.groupBy("sets").agg(F.count("*").alias("total"))
    hit = ranked.join(queries, "query_id").join(docs, ["sets", "doc_id"])
    # a document ranked more than once counts as often as it is ranked, as in a join
    hits = hit.groupBy("query_id", "doc_id").agg((F.count("*") - 1).alias("more"), F.count_if(F.col("place") <= k).alias("top"), F.min("place").alias("first"))
    found = hits.groupBy("query_id").agg(F.sum("more").alias("more"), F.sum("top").alias("top"), F.min("first").alias("first"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return queries.join(total, "sets").join(found, "query_id", "left").select(
        "query_id", (zero("top") / (F.col("total") + zero("more"))).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal"), F.coalesce("first", F.lit(MISSING)).alias("first")
    )


def summary(scores: DataFrame, *by: Column) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("recall").alias("recall"), F.avg("reciprocal").alias("mrr"), F.percentile("first", F.lit(0.5)).cast("int").alias("median_rank"))


def hit_rate(scores: DataFrame, k: int = 10) -> DataFrame:
    """(hit_rate): share of queries with any relevant document among the first k; queries without labels don't count. scores: as from per_query."""
    return scores.agg(F.avg((F.col("first") <= k).cast("double")).alias("hit_rate"))


def pair_separation(top: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, separation): 1 - Jaccard of the results of the two queries of a pair; pairs of any other size are skipped. top: (query_id, ids), pairs: (query_id, pair_id)."""
    two = pairs.groupBy("pair_id").agg(F.count("*").alias("n"), F.min("query_id").alias("a"), F.max("query_id").alias("b")).where("n = 2")
    both = two.join(top.toDF("a", "ia"), "a").join(top.toDF("b", "ib"), "b")
    return both.select("pair_id", (1 - jaccard(F.col("ia"), F.col("ib"))).alias("separation"))


def nearest_rank(values: Column, fraction: float) -> Column:
    """The element at round(fraction * (n - 1)), half to even, of an array's sorted values."""
    return F.element_at(F.array_sort(values), F.rint(F.lit(fraction) * (F.size(values) - 1)).cast("int") + 1)


def size_report(sizes: DataFrame, column: str = "n") -> DataFrame:
    n = F.col(column)
    return sizes.agg(
        F.count("*").alias("clusters"), F.sum(n).alias("total"), F.avg(n).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"), F.percentile(n, F.lit(0.95)).alias("p95"),
        F.max(n).alias("most"), F.min(n).alias("least"), F.count_if(n == 0).alias("empty"),
    )


def separation_report(separations: DataFrame, worst: int = 5) -> tuple[DataFrame, DataFrame]:
    """((pairs, mean, least), the pairs that are least apart). separations: (pair_id, separation)."""
    return separations.agg(F.count("*").alias("pairs"), F.avg("separation").alias("mean"), F.min("separation").alias("least")), separations.orderBy("separation", "pair_id").limit(worst)


def chunk_report(chunks: DataFrame, docs: DataFrame, rejects: DataFrame, budget: int, per_token: float = 4.0) -> DataFrame:
    """One row about (doc_id, text) chunks of (doc_id) documents: files, chunks, chunks a file, characters of a chunk, files without chunks, errors, and the share of chunks above a budget of tokens at so many characters each."""
    size = F.length("text")
    each = docs.select(F.col("doc_id").cast("string").alias("doc_id")).join(chunks.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    files = each.agg(F.count("*").alias("files"), F.sum("n").alias("chunks"), F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"), F.min("n").alias("least"), F.count_if(F.col("n") == 0).alias("without"))
    quantiles = F.percentile_approx(size, F.array(*[F.lit(x) for x in (0.05, 0.5, 0.95)]))
    lengths = chunks.agg(quantiles.alias("lengths"), F.max(size).alias("longest"), F.avg((size > budget * per_token).cast("double")).alias("over_budget"))
    return files.crossJoin(lengths).crossJoin(rejects.agg(F.count("*").alias("errors")))  # one row each


def token_report(tokens: DataFrame, limit: int) -> DataFrame:
    """(texts, mean, p95, p99, most, truncated, truncated_share) of (n): truncated are those that a model of this limit would cut or fill."""
    n = F.col("n")
    return tokens.agg(F.count("*").alias("texts"), F.avg(n).alias("mean"), F.percentile(n, F.lit(0.95)).alias("p95"), F.percentile(n, F.lit(0.99)).alias("p99"), F.max(n).alias("most"), F.count_if(n >= limit).alias("truncated"), F.avg((n >= limit).cast("double")).alias("truncated_share"))
