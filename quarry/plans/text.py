"""Queries of text structuring, incremental builds, checks and reports, over documents (a line is the paragraph unit there)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import checks, chunker, evaluation, incremental
from .registry import Tables, query

LINES = "l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents)"
PLACED = "p AS (SELECT doc_id, text, line, no, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM l)"


def lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "text", F.posexplode(F.split("text", "\n")).alias("no", "line"))


def placed(t: Tables) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    return lines(t).withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)))


@query("txt_lines_offsets", f"WITH {LINES}, {PLACED} SELECT doc_id, CAST(no AS INTEGER) AS no, start, start + length(line) AS stop, CAST(CASE WHEN trim(line) = '' THEN -1 ELSE length(line) - length(ltrim(line, ' ')) END AS INTEGER) AS indent FROM p")
def _(t):
    indent = F.when(F.trim("line") == "", -1).otherwise(F.length("line") - F.length(F.ltrim("line")))
    return placed(t).select("doc_id", "no", "start", (F.col("start") + F.length("line")).alias("stop"), indent.alias("indent"))


@query("txt_modal_indent", f"WITH {LINES}, i AS (SELECT doc_id, length(line) % 4 AS indent FROM l WHERE trim(line) <> ''), n AS (SELECT doc_id, indent, count(*) AS n FROM i GROUP BY ALL) SELECT doc_id, CAST(indent AS INTEGER) AS indent FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, indent) AS r FROM n) WHERE r = 1")
def _(t):
    # the length modulo 4 stands for the indentation, which these texts lack
    n = lines(t).where(F.trim("line") != "").groupBy("doc_id", (F.length("line") % 4).alias("indent")).agg(F.count("*").alias("n"))
    return n.groupBy("doc_id").agg(F.max_by("indent", F.struct("n", -F.col("indent"))).alias("indent"))


@query("txt_repeated_lines", f"WITH {LINES} SELECT doc_id, CAST(no AS INTEGER) AS no FROM (SELECT doc_id, no, count(*) OVER (PARTITION BY doc_id, line) AS n FROM l) WHERE n >= 2")
def _(t):
    return lines(t).withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "line"))).where("n >= 2").select("doc_id", "no")


@query("txt_byte_offsets", f"WITH {LINES}, {PLACED} SELECT doc_id, CAST(no AS INTEGER) AS no, CAST(strlen(substr(text, 1, start)) AS INTEGER) AS byte_start, CAST(strlen(line) AS INTEGER) AS byte_length FROM p")
def _(t):
    w = Window.partitionBy("doc_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("line") + 1).over(w), F.lit(0)).cast("int")
    return lines(t).select("doc_id", "no", start.alias("byte_start"), F.octet_length("line").alias("byte_length"))


FIRST = "string_split(text, '.')[1]"
KEY = f"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({FIRST}, ' ' || chr(9) || chr(10))), '[''’‘ʼ`]', '', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


@query("txt_normalise_heading", f"SELECT doc_id, {KEY} AS heading FROM documents")
def _(t):
    return t.documents.select("doc_id", T.heading_key(F.split_part("text", F.lit("."), F.lit(1))).alias("heading"))


SKIPS = "regexp_matches({0}, '^(?:the|a|of|and|in|\\d+)(?: (?:the|a|of|and|in|\\d+))*$')"


@query("txt_skip_sections", f"WITH h AS (SELECT doc_id, {KEY} AS heading FROM documents) SELECT doc_id, heading, heading <> '' AND ({SKIPS.format('heading')} OR heading IN ('the', 'of')) AS skipped FROM h")
def _(t):
    # the stop list of these texts' headings: qualifiers only, as in reference lists
    h = T.heading_key(F.split_part("text", F.lit("."), F.lit(1)))
    words = F.split(h, " ")
    allowed = F.forall(words, lambda w: w.isin("the", "a", "of", "and", "in") | w.rlike(r"^[0-9]+$"))
    return t.documents.select("doc_id", h.alias("heading"), ((h != "") & allowed).alias("skipped"))


SHORT = "length(line) < 60"


@query("txt_paragraph_islands", f"WITH {LINES}, s AS (SELECT doc_id, no, line, sum(CASE WHEN {SHORT} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM l) SELECT doc_id, CAST(coalesce(g, 0) AS BIGINT) AS paragraph, count(*) AS lines, CAST(min(no) AS INTEGER) AS first_line FROM s GROUP BY 1, 2")
def _(t):
    # a short line ends a paragraph
    w = Window.partitionBy("doc_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    g = F.coalesce(F.sum((F.length("line") < 60).cast("int")).over(w), F.lit(0))
    return lines(t).withColumn("paragraph", g).groupBy("doc_id", "paragraph").agg(F.count("*").alias("lines"), F.min("no").alias("first_line"))


@query("txt_section_spans", f"WITH {LINES}, h AS (SELECT doc_id, no, line FROM l WHERE {SHORT}) SELECT doc_id, CAST(no AS INTEGER) AS no, CAST(lead(no) OVER (PARTITION BY doc_id ORDER BY no) AS INTEGER) AS until FROM h")
def _(t):
    return lines(t).where("length(line) < 60").select("doc_id", "no", F.lead("no").over(Window.partitionBy("doc_id").orderBy("no")).alias("until"))


@query("txt_toc_blocks", f"WITH {LINES}, s AS (SELECT doc_id, no, line, no // 4 AS block FROM l) SELECT doc_id, CAST(block AS BIGINT) AS block, count(*) AS lines, round(avg(CASE WHEN regexp_matches(line, '(the|der|la|de)[ .]') THEN 1.0 ELSE 0.0 END), 6) AS share FROM s GROUP BY 1, 2 HAVING count(*) >= 4 AND avg(CASE WHEN regexp_matches(line, '(the|der|la|de)[ .]') THEN 1.0 ELSE 0.0 END) >= 0.7")
def _(t):
    s = lines(t).withColumn("block", F.floor(F.col("no") / 4)).groupBy("doc_id", "block")
    return s.agg(F.count("*").alias("lines"), F.round(F.avg(F.col("line").rlike("(the|der|la|de)[ .]").cast("double")), 6).alias("share")).where("lines >= 4 and share >= 0.7")


@query("txt_heading_candidates", f"WITH {LINES}, s AS (SELECT *, lag(line) OVER w AS before, lead(line) OVER w AS after FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY no)) SELECT doc_id, CAST(no AS INTEGER) AS no FROM s WHERE length(line) BETWEEN 1 AND 90 AND (before IS NULL OR length(before) > 60) AND (after IS NULL OR length(after) > 60) AND regexp_matches(line, '^[A-Z]') AND len(string_split(line, ' ')) <= 8")
def _(t):
    w = Window.partitionBy("doc_id").orderBy("no")
    s = lines(t).withColumn("before", F.lag("line").over(w)).withColumn("after", F.lead("line").over(w))
    apart = lambda c: F.col(c).isNull() | (F.length(c) > 60)
    return s.where(F.length("line").between(1, 90) & apart("before") & apart("after") & F.col("line").rlike("^[A-Z]") & (F.size(F.split("line", " ")) <= 8)).select("doc_id", "no")


@query("txt_min_length", f"WITH {LINES} SELECT doc_id, CAST(no AS INTEGER) AS no FROM l WHERE length(trim(line, ' ')) >= 24")
def _(t):
    return lines(t).where(F.length(F.trim("line")) >= chunker.SHORTEST).select("doc_id", "no")


@query("txt_greedy_pack", f"""
WITH RECURSIVE {LINES}, k AS (SELECT doc_id, no, length(line) AS n FROM l),
f AS (SELECT doc_id, no, n AS held, 0 AS chunk FROM k WHERE no = 0
  UNION ALL SELECT k.doc_id, k.no, CASE WHEN f.held >= 1200 OR f.held + 2 + k.n > 1600 THEN k.n ELSE f.held + 2 + k.n END, CASE WHEN f.held >= 1200 OR f.held + 2 + k.n > 1600 THEN f.chunk + 1 ELSE f.chunk END
  FROM f JOIN k ON k.doc_id = f.doc_id AND k.no = f.no + 1)
SELECT doc_id, chunk, count(*) AS lines, CAST(max(held) AS INTEGER) AS size FROM f GROUP BY 1, 2""")
def _(t):
    # a fold over the line lengths, in the JVM: the state is (held, chunks so far)
    start = F.struct(F.lit(0).alias("held"), F.lit(0).alias("lines"), F.array().cast("array<struct<lines:int,size:int>>").alias("done"))

    def step(s, n):
        full = (s["lines"] > 0) & ((s["held"] >= chunker.TARGET) | (s["held"] + 2 + n > chunker.CAP))
        joint = F.when(s["lines"] > 0, s["held"] + 2 + n).otherwise(n)
        closed = F.concat(s["done"], F.array(F.struct(s["lines"].alias("lines"), s["held"].alias("size"))))
        return F.struct(F.when(full, n).otherwise(joint).alias("held"), F.when(full, 1).otherwise(s["lines"] + 1).alias("lines"), F.when(full, closed).otherwise(s["done"]).alias("done"))

    end = lambda s: F.concat(s["done"], F.array(F.struct(s["lines"].alias("lines"), s["held"].alias("size"))))
    sizes = F.transform(F.split("text", "\n"), lambda x: F.length(x))
    packed = t.documents.select("doc_id", F.posexplode(F.aggregate(sizes, start, step, end)).alias("chunk", "c"))
    return packed.select("doc_id", "chunk", F.col("c.lines").cast("long").alias("lines"), F.col("c.size").alias("size"))


@query("txt_chunk_report")
def _(t):
    """The report on the chunks of all documents."""
    docs = t.documents.select("doc_id", "text")
    chunks, rejects = chunker.chunk_documents(docs)
    return evaluation.chunk_report(chunks, docs, rejects, 400)


@query("txt_sentence_split")
def _(t):
    @F.pandas_udf("array<int>")
    def ends(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: chunker.sentence_ends(x or ""))

    return t.documents.select("doc_id", ends("text").alias("ends"))


@query("txt_full_chunker")
def _(t):
    return chunker.chunk_documents(t.documents)[0]


@query("agg_chunk_stats", "WITH g AS (SELECT lang, source, count(*) AS chunks FROM documents GROUP BY ALL) SELECT lang, count(*) AS files, CAST(sum(chunks) AS BIGINT) AS chunks, round(avg(chunks), 6) AS mean, round(median(chunks), 6) AS median, max(chunks) AS most, min(chunks) AS least FROM g GROUP BY lang")
def _(t):
    g = t.documents.groupBy("lang", "source").agg(F.count("*").alias("chunks"))
    return g.groupBy("lang").agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"), F.round(F.avg("chunks"), 6).alias("mean"), F.round(F.percentile("chunks", F.lit(0.5)), 6).alias("median"), F.max("chunks").alias("most"), F.min("chunks").alias("least"))


WORDS = "len(list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda x: x <> ''))"


@query("agg_token_stats", f"WITH w AS (SELECT {WORDS} AS n FROM documents) SELECT count(*) AS texts, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS most, round(100.0 * count(CASE WHEN n > 512 THEN 1 END) / count(*), 6) AS over_limit FROM w")
def _(t):
    n = t.documents.select(F.size(F.filter(F.split("text", "[ \n\t]+"), lambda x: x != "")).alias("n"))
    pct = lambda f: F.round(F.percentile("n", F.lit(f)), 6)
    return n.agg(F.count("*").alias("texts"), F.round(F.avg("n"), 6).alias("mean"), pct(0.95).alias("p95"), pct(0.99).alias("p99"), F.max("n").cast("long").alias("most"), F.round(100.0 * F.count_if(F.col("n") > 512) / F.count("*"), 6).alias("over_limit"))


@query("agg_size_report", "WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT count(*) AS clusters, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean, round(median(n), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS most, min(n) AS least, count(CASE WHEN n = 0 THEN 1 END) AS empty FROM s")
def _(t):
    r = evaluation.size_report(t.documents.groupBy("source").agg(F.count("*").alias("n")))
    return r.withColumns({c: F.round(c, 6) for c, k in r.dtypes if k == "double"})


@query("agg_nearest_rank_percentile", "WITH s AS (SELECT lang, list_sort(list(n_chars)) AS v FROM documents GROUP BY lang) SELECT lang, v[CAST(round_even(0.5 * (len(v) - 1), 0) AS INTEGER) + 1] AS p50, v[CAST(round_even(0.95 * (len(v) - 1), 0) AS INTEGER) + 1] AS p95 FROM s")
def _(t):
    v = t.documents.groupBy("lang").agg(F.collect_list("n_chars").alias("v"))
    return v.select("lang", evaluation.nearest_rank(F.col("v"), 0.5).alias("p50"), evaluation.nearest_rank(F.col("v"), 0.95).alias("p95"))


@query("agg_bincount_with_empty", "SELECT CAST(k AS BIGINT) AS cluster_id, count(label) AS n FROM (SELECT unnest(range(12)) AS k) LEFT JOIN embeddings ON label = k GROUP BY k")
def _(t):
    n = t.embeddings.groupBy(F.col("label").cast("long").alias("cluster_id")).agg(F.count("*").alias("n"))
    return t.spark.range(12).toDF("cluster_id").join(n, "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("agg_max_numeric_id", "SELECT coalesce(max(TRY_CAST(split_part(p_brand, '#', 2) AS INTEGER)), 0) AS highest FROM part")
def _(t):
    return t.part.agg(F.coalesce(F.max(F.split_part("p_brand", F.lit("#"), F.lit(2)).try_cast("int")), F.lit(0)).alias("highest"))


@query("agg_over_budget_share", "SELECT lang, round(count(CASE WHEN n_chars > 1600 THEN 1 END) / count(*), 6) AS share, count(CASE WHEN n_chars >= 1600 THEN 1 END) AS cut FROM documents GROUP BY lang")
def _(t):
    return t.documents.groupBy("lang").agg(F.round(F.count_if(F.col("n_chars") > 1600) / F.count("*"), 6).alias("share"), F.count_if(F.col("n_chars") >= 1600).alias("cut"))


@query("win_prefix_sums", "SELECT source, n, CAST(sum(n) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS first_row FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def _(t):
    n = t.documents.groupBy("source").agg(F.count("*").alias("n"))  # a row a group: small
    return n.withColumn("first_row", F.sum("n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))


@query("inc_content_dedupe", "SELECT sha256(text) AS content_hash, count(*) AS docs, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy(incremental.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


@query("inc_todo_anti", "SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))")
def _(t):
    cache = t.documents.join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi").select(incremental.content_hash(F.col("text")).alias("content_hash"))
    return incremental.todo(t.documents, cache).select("content_hash")


@query("inc_hydrate_key_join", "SELECT min(d.doc_id) AS doc_id, sha256(text) AS content_hash FROM documents d JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 2")
def _(t):
    # the labelled good documents are the last build, the toxic ones have changed
    chunks = t.documents.select("doc_id", F.lit(0).alias("offset"), F.col("n_chars").alias("length"), "text")
    last = t.labels.where("quality = 1").select("doc_id").distinct().join(chunks, "doc_id").select("doc_id", "offset", "length", F.col("doc_id").alias("v"))
    none = t.spark.createDataFrame([], "content_hash string")
    same = incremental.hydrate(chunks, last, t.labels.where("toxic = 1").select("doc_id"), none)
    return same.join(chunks.select("doc_id", incremental.content_hash(F.col("text")).alias("content_hash")).join(last.select("doc_id"), "doc_id", "left_semi").join(t.labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti"), "content_hash").groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))


@query("inc_retention", "SELECT build, CAST(place AS INTEGER) AS place, place <= 2 AS kept FROM (SELECT build, row_number() OVER (ORDER BY build DESC) AS place FROM (SELECT strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS build FROM orders WHERE o_orderstatus = 'F' GROUP BY 1))")
def _(t):
    b = t.orders.where("o_orderstatus = 'F'").select(F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss'Z'").alias("build")).distinct()
    return incremental.retained(b.withColumn("complete", F.lit(True))).select("build", "place", "kept")


@query("chk_key_unique", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return checks.repeated_keys(t.lineitem, "l_orderkey", "l_partkey")


@query("chk_referential", "SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t):
    return checks.unknown(t.orders, t.customer.where("c_acctbal > 0"), "o_custkey", "c_custkey")


@query("chk_floors_and_dangling", "SELECT count(*) AS rows, count(*) >= 9000 AS enough, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)) AS dangling, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)) <= 25 AS few FROM part")
def _(t):
    lost = checks.unknown(t.lineitem, t.part, "l_partkey", "p_partkey").agg(F.count("*").alias("dangling"))
    rows = t.part.agg(F.count("*").alias("rows"))
    return rows.crossJoin(lost).select("rows", (F.col("rows") >= checks.LEAST_ROWS).alias("enough"), "dangling", (F.col("dangling") <= checks.MAX_DANGLING).alias("few"))  # one row each


@query("chk_key_join_complete", "SELECT count(*) AS lost FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def _(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("lost"))
