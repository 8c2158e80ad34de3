"""The citation graph, and the chain of documents that replace one another.

Chains have no bound. Both walks double their length in every round, so a chain of n takes log2(n)
rounds; a graph with a cycle is refused, since its paths never end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import kept


class Cycle(ValueError):
    """A document that replaces itself, directly or not."""


def inbound_counts(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, refs): edges into each document, repeats counted, 0 where there are none. edges: (src, dst)."""
    counts = edges.groupBy(F.col("dst").alias("doc_id")).agg(F.count("*").alias("n"))
    return docs.select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("refs"))


def dangling(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges to documents that don't exist."""
    return edges.join(docs.select(F.col("doc_id").alias("dst")), "dst", "left_anti")


def _ends(step: int, nodes: int, cycle_of: DataFrame) -> None:
    if step > nodes:
        some = [r[0] for r in cycle_of.limit(3).collect()]
        raise Cycle(f"replaced without end: {some}")


def _known(docs: DataFrame, obsoletes: DataFrame) -> DataFrame:
    """The pairs (doc_id, old) whose both sides are documents of the table; what isn't one has no references and leads nowhere."""
    ids = docs.select("doc_id").distinct()
    return obsoletes.select("doc_id", "old").join(ids, "doc_id", "left_semi").join(ids.toDF("old"), "old", "left_semi").select("doc_id", "old")


def walk(docs: DataFrame, obsoletes: DataFrame) -> DataFrame:
    """(root, doc_id, depth, path): every path from a document to those that it replaces, directly or not; a diamond gives two.

    path has the documents after the root; in order of path a root's rows are depth first. obsoletes: (doc_id, old)."""
    pairs = _known(docs, obsoletes)
    empty = F.array().cast(f"array<{dict(pairs.dtypes)['old']}>")
    roots = docs.select(F.col("doc_id").alias("root"), "doc_id", F.lit(0).alias("depth"), empty.alias("path"))
    far = kept(pairs.select(F.col("doc_id").alias("root"), F.col("old").alias("doc_id"), F.array("old").alias("path")), "paths")  # of length step exactly
    nodes, step, within = pairs.select("doc_id").distinct().count(), 1, None  # within: of length 1 to step - 1
    while not far.isEmpty():
        _ends(step, nodes, far.select("root"))
        near = far if within is None else within.unionByName(far)
        ahead = far.toDF("root", "via", "first")
        grown = near.toDF("via", "doc_id", "rest")
        longer = ahead.join(grown, "via").select("root", "doc_id", F.concat("first", "rest").alias("path"))
        longer = kept(longer, "paths")
        within, far, step = near.unionByName(longer.where(F.size("path") < 2 * step)), longer.where(F.size("path") == 2 * step), 2 * step
    if within is None:
        return roots
    return roots.unionByName(within.select("root", "doc_id", F.size("path").alias("depth"), "path"))


def inherited_counts(docs: DataFrame, edges: DataFrame, obsoletes: DataFrame) -> DataFrame:
    """(doc_id, refs): a document's inbound edges and those of all it replaces, along every path.

    Paths aren't written out: sums over paths of up to n steps and the number of paths of n steps give those of 2 n."""
    own = inbound_counts(docs.select("doc_id").distinct(), edges)
    pairs = _known(docs, obsoletes)
    total = kept(own.select("doc_id", F.col("refs").cast("decimal(38,0)").alias("refs")), "sums")
    ways = kept(pairs.groupBy("doc_id", "old").agg(F.count("*").cast("decimal(38,0)").alias("ways")), "ways")
    nodes, step = pairs.select("doc_id").distinct().count(), 1
    while not ways.isEmpty():
        _ends(step, nodes, ways.select("doc_id"))
        more = ways.join(total.toDF("old", "refs"), "old").groupBy("doc_id").agg(F.sum((F.col("ways") * F.col("refs")).cast("decimal(38,0)")).alias("more"))
        total = kept(total.join(more, "doc_id", "left").select("doc_id", (F.col("refs") + F.coalesce("more", F.lit(0))).cast("decimal(38,0)").alias("refs")), "sums")
        then = ways.toDF("via", "old", "after")
        joined = ways.toDF("doc_id", "via", "before").join(then, "via").groupBy("doc_id", "old")
        ways, step = kept(joined.agg(F.sum((F.col("before") * F.col("after")).cast("decimal(38,0)")).cast("decimal(38,0)").alias("ways")), "ways"), 2 * step
    return docs.select("doc_id").join(total, "doc_id").select("doc_id", F.col("refs").cast("long").alias("refs"))


def inherited_list(docs: DataFrame, edges: DataFrame, obsoletes: DataFrame) -> DataFrame:
    """(doc_id, of, depth, src, normative, place): the edges behind inherited_counts, own ones first, then those of each document replaced, depth first."""
    found = walk(docs, obsoletes).join(edges, F.col("doc_id") == F.col("dst"))
    place = F.row_number().over(Window.partitionBy("root").orderBy("path", "src", "normative"))
    return found.select(F.col("root").alias("doc_id"), F.col("dst").alias("of"), "depth", "src", "normative", place.alias("place"))
