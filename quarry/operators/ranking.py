"""From passage hits to documents: collapse, one hit a section, document scores and alternative schemes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import title_overlap

TITLE_WEIGHT, CITATION_WEIGHT, SHIPPED_TITLE_WEIGHT = 0.10, 0.02, 0.20


def one_hit_a_section(hits: DataFrame) -> DataFrame:
    """The best hit of each (query, document, section or else title). hits: (query_id, doc_id, section, title, score, rank)."""
    key = F.coalesce(F.nullif(F.col("section"), F.lit("")), F.nullif(F.col("title"), F.lit("")), F.lit(""))
    w = Window.partitionBy("query_id", "doc_id", key).orderBy("rank")
    return hits.withColumn("in_section", F.row_number().over(w)).where("in_section = 1").drop("in_section")


def document_hits(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, scores best first, first_rank)."""
    return hits.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"), F.min("rank").alias("first_rank"))


def sum_of(scores: Column, n: int) -> Column:
    return F.aggregate(F.slice(scores, 1, n), F.lit(0.0), lambda s, x: s + x)


def row_score(scores: Column, overlap: Column, refs: Column, title_weight: float = TITLE_WEIGHT) -> Column:
    """A third of the three best, missing ones as 0, with priors for title words and inherited references."""
    return sum_of(scores, 3) / 3 + F.lit(title_weight) * overlap + F.lit(CITATION_WEIGHT) * F.log1p(F.coalesce(refs, F.lit(0)).cast("double"))


def rank_documents(hits: DataFrame, docs: DataFrame, refs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, row_score, place): documents without metadata are dropped; ties keep the order of their first hits."""
    d = document_hits(hits).join(docs.select("doc_id", F.col("title").alias("doc_title")), "doc_id").join(refs, "doc_id", "left").join(queries.select("query_id", "query"), "query_id")
    d = d.withColumn("row_score", row_score(F.col("scores"), title_overlap(F.col("query"), F.col("doc_title")), F.col("refs")))
    w = Window.partitionBy("query_id").orderBy(F.col("row_score").desc(), "first_rank")
    return d.select("query_id", "doc_id", "row_score", F.row_number().over(w).alias("place"))


def schemes(scores: Column, overlap: Column, cited: Column) -> dict[str, Column]:
    """Alternative document scores; cited: direct citations."""
    three, prior = sum_of(scores, 3) / 3, F.log1p(F.coalesce(cited, F.lit(0)).cast("double"))
    out = {"best": F.element_at(scores, 1).cast("double"), "mean_top3": sum_of(scores, 3) / F.least(F.size(scores), F.lit(3)), "three": three}
    out |= {f"cited_{w:.2f}": three + F.lit(w) * prior for w in (0.02, 0.05)}
    out |= {f"title_{w:.2f}": three + F.lit(w) * overlap for w in (0.05, 0.10, 0.15, 0.20)}
    out["title_0.10_cited"] = three + F.lit(0.10) * overlap + F.lit(CITATION_WEIGHT) * prior
    out["shipped"] = three + F.lit(SHIPPED_TITLE_WEIGHT) * overlap + F.lit(CITATION_WEIGHT) * prior
    return out


def scheme_scores(docs: DataFrame, scores: str = "scores", overlap: str = "overlap", cited: str = "cited") -> DataFrame:
    """One row per document and scheme: (..., scheme, scheme_score)."""
    pairs = [F.struct(F.lit(n).alias("scheme"), c.alias("scheme_score")) for n, c in schemes(F.col(scores), F.col(overlap), F.col(cited)).items()]
    return docs.withColumn("s", F.explode(F.array(*pairs))).select("*", "s.scheme", "s.scheme_score").drop("s")
