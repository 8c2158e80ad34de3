"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule w_s(t), piecewise linear over training time t in [0, 1]; at each
knot the weights are normalised to 1 over the sources. Its integral times the token budget is the
cumulative demand D_s(t). The documents of a source stand in a fixed pseudo-random order (md5 of
doc_id and text); the one that begins after c tokens of its source is due when D_s(t) = c, which is its
training position t. Documents are range-sorted by position. Because the weights add up to 1, the
positions are uniform in tokens, so equal ranges of t hold equal work and need no sampling.

A source whose demand exceeds its tokens is repeated (copy 1, 2, ...); one whose demand is less is
cut off. The default budget is the least by which every document is used once: only repeats occur.

The default schedule starts at the natural token shares and ends at shares ** ALPHA, normalised.
A token here is what stands between single white-space characters (countable in any engine).

Defined cases
* null or empty text, hence no tokens: takes no training time, left out.
* null source: the source ''. Null doc_id: ordered by its text. Other nulls and extra columns: passed through.
* repeated rows, also of one doc_id: each is a document of its own; the order among rows with equal id and text cannot be told apart.
* very long texts: whole; one document takes as much training time as it has tokens. Equal positions: in order of the copy, then of the md5.
* an empty table, or one without tokens: no rows.
* a source with weight 0 throughout is left out; where a weight is 0 over an interval, demand is flat
  there and a document that is due within it comes at its end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table, small_side, stored, unused

ALPHA = 0.8
#: Documents are summed within ranges of the md5 order, and the ranges' sums within a source. A range has so many tokens at most, on average; first sums are for so many hex digits.
RANGE_TOKENS, DIGITS = 1 << 20, 3


def tokens(text: Column) -> Column:
    dense = F.replace(F.replace(F.replace(text, F.lit(" ")), F.lit("\n")), F.lit("\t"))
    n = F.length(text) - F.length(dense) + 1
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(n).cast("long")


def natural_schedule(supply: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(source, t, weight): natural shares at 0, flattened ones at 1. supply: (source, supply)."""
    whole = Window.partitionBy(F.lit(0))
    share = supply.withColumn("share", F.col("supply") / F.sum("supply").over(whole)).withColumn("flat", F.pow("share", F.lit(alpha)))
    share = share.withColumn("flat", F.col("flat") / F.sum("flat").over(whole))
    return share.select("source", F.explode(F.array(F.struct(F.lit(0.0).alias("t"), F.col("share").alias("weight")), F.struct(F.lit(1.0).alias("t"), F.col("flat").alias("weight")))).alias("k")).select("source", "k.*")


def demand(schedule: DataFrame, supply: DataFrame, budget: float | None = None) -> DataFrame:
    """(source, supply, total, pieces): per source its demand over all of training and its linear pieces (t0, t1, w0, w1, d0), in tokens."""
    knot = schedule.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("t")))
    w = Window.partitionBy("source").orderBy("t")
    piece = knot.select("source", F.col("t").alias("t0"), F.lead("t").over(w).alias("t1"), F.col("weight").alias("w0"), F.lead("weight").over(w).alias("w1")).where("t1 is not null")
    area = (F.col("t1") - F.col("t0")) * (F.col("w0") + F.col("w1")) / 2
    before = Window.partitionBy("source").orderBy("t0").rowsBetween(Window.unboundedPreceding, -1)
    piece = piece.withColumn("area", area).withColumn("d0", F.coalesce(F.sum("area").over(before), F.lit(0.0)))
    per = piece.groupBy("source").agg(F.sum("area").alias("whole"), F.array_sort(F.collect_list(F.struct("t0", "t1", "w0", "w1", "d0", "area"))).alias("pieces"))
    per = per.join(supply, "source").where("whole > 0 and supply > 0")
    least = F.max(F.col("supply") / F.col("whole")).over(Window.partitionBy(F.lit(0))) if budget is None else F.lit(float(budget))
    return per.withColumn("budget", least).select("source", "supply", "budget", (F.col("budget") * F.col("whole")).alias("total"), "pieces")


def position(start: Column, budget: Column, pieces: Column) -> Column:
    """The t at which the cumulative demand reaches start: a quadratic in the piece that holds it."""
    c = start / budget
    p = F.coalesce(F.element_at(F.filter(pieces, lambda x: (x["d0"] + x["area"] > c) & (x["area"] > 0)), 1), F.element_at(pieces, -1))
    need, slope = c - p["d0"], (p["w1"] - p["w0"]) / (p["t1"] - p["t0"])
    root = F.sqrt(F.greatest(p["w0"] * p["w0"] + 2 * slope * need, F.lit(0.0)))
    below = p["w0"] + root
    return F.least(p["t0"] + F.when(below > 0, 2 * need / below).otherwise(F.lit(0.0)), F.lit(1.0))


def place(docs: DataFrame, schedule: DataFrame | None = None, budget: float | None = None, alpha: float = ALPHA, carry: bool = True) -> tuple[DataFrame, list[str]]:
    """The documents, one row per copy, with five more columns, whose names come back too: source, tokens, copy, position, md5.

    carry=False keeps doc_id and those five only, so that texts aren't shuffled."""
    names = unused(docs, "mix_source", "mix_tokens", "mix_copy", "mix_position", "mix_order", "mix_range", "mix_start", "mix_copies", "mix_budget", "mix_pieces", "mix_supply", "mix_total", "mix_before")
    src, n, copy, pos, order, part, start, copies, bud, pieces, sup, total, prior = names
    rows = docs.withColumn(src, F.coalesce("source", F.lit(""))).withColumn(n, tokens(F.col("text"))).where(F.col(n) > 0)
    rows = rows.withColumn(order, F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), "text").cast("binary")))
    if not carry:
        rows = stored(rows.select("doc_id", src, n, order), "placed")
    sums = stored(rows.groupBy(src, F.substring(order, 1, DIGITS).alias(part)).agg(F.sum(n).alias(total)), "ranges")
    largest = sums.groupBy(src).agg(F.sum(total).alias(total)).agg(F.max(total)).first()[0] or 1
    digits = max(1, math.ceil(math.log(max(1, largest / RANGE_TOKENS), 16)))
    rows = rows.withColumn(part, F.substring(order, 1, digits))
    if digits > DIGITS:
        sums = stored(rows.groupBy(src, part).agg(F.sum(n).alias(total)), "ranges")
    else:
        sums = sums.groupBy(src, F.substring(part, 1, digits).alias(part)).agg(F.sum(total).alias(total))
    supply = sums.groupBy(F.col(src).alias("source")).agg(F.sum(total).alias("supply"))
    wanted = demand(schedule if schedule is not None else natural_schedule(supply, alpha), supply, budget)
    wanted = stored(wanted.select(F.col("source").alias(src), F.col("supply").alias(sup), F.col("budget").alias(bud), F.col("total").alias(total), F.col("pieces").alias(pieces)), "demand")
    ranges = sums.withColumn(prior, F.sum(total).over(Window.partitionBy(src).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))).select(src, part, F.coalesce(prior, F.lit(0)).alias(prior))
    within = Window.partitionBy(src, part).orderBy(F.col(order), F.col(n)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(start, F.coalesce(F.sum(n).over(within), F.lit(0)))
    rows = rows.join(ranges, [src, part]).withColumn(start, F.col(start) + F.col(prior)).drop(prior)
    rows = rows.join(small_side(wanted, 600), src)
    rows = rows.withColumn(copies, F.ceil((F.col(total) - 0.5 - F.col(start)) / F.col(sup)).cast("int")).where(F.col(copies) > 0)
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
    rows = rows.withColumn(pos, position(F.col(start) + F.col(copy) * F.col(sup), F.col(bud), F.col(pieces)))
    return rows.drop(part, start, copies, bud, pieces, sup, total), [src, n, copy, pos, order]


def range_sorted(df: DataFrame, by: str, tie: list[str]) -> DataFrame:
    """Sorted by a position in [0, 1], uniform in work: the partition is known from the value, without sampling."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.least(F.floor(F.col(by) * parts), F.lit(parts - 1)).cast("int")
    return df.repartitionById(parts, at).sortWithinPartitions(by, *tie)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the training order: every use of a document, with its position."""
    placed, (src, n, copy, pos, _) = place(read_table(spark, sf_dir, "documents"), carry=False)
    placed = placed.select("doc_id", F.col(src).alias("source"), F.col(n).alias("tokens"), F.col(copy).alias("copy"), F.col(pos).alias("position"))
    return range_sorted(placed, "position", ["doc_id", "copy"]).withColumn("position", F.round("position", 6))


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || text) AS o,
         length(text) - length(translate(text, ' ' || chr(10) || chr(9), '')) + 1 AS n
  FROM documents WHERE text IS NOT NULL AND text <> ''),
c AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY o, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),
s AS (SELECT source, CAST(sum(n) AS BIGINT) AS supply FROM d GROUP BY source),
f AS (SELECT *, supply / sum(supply) OVER () AS w0, pow(supply / sum(supply) OVER (), {ALPHA}) AS flat FROM s),
g AS (SELECT *, flat / sum(flat) OVER () AS w1 FROM f),
t AS (SELECT *, max(supply / ((w0 + w1) / 2)) OVER () AS budget FROM g),
u AS (
  SELECT c.doc_id, c.source, c.n, c.start, t.supply, t.w0, t.w1, t.budget,
         unnest(range(CAST(ceil((t.budget * (t.w0 + t.w1) / 2 - 0.5 - c.start) / t.supply) AS BIGINT))) AS copy
  FROM c JOIN t ON c.source = t.source),
v AS (SELECT *, (start + copy * supply) / budget AS need FROM u)
SELECT doc_id, source, CAST(n AS BIGINT) AS tokens, CAST(copy AS INTEGER) AS copy,
       round(least(2 * need / (w0 + sqrt(greatest(w0 * w0 + 2 * (w1 - w0) * need, 0))), 1), 6) AS position
FROM v"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed, (_, _, copy, pos, order) = place(docs)
    return range_sorted(placed, pos, [copy, order]).select(*docs.columns)
