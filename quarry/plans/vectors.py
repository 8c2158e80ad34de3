"""Queries of the vector index, ranking and evaluation. Every vector of embeddings is also a query; labels stand for clusters and relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vectors as V
from ..operators import checks, clustering, embedding, evaluation, incremental, ranking, vector_index
from .registry import Tables, query

SCALE, DIMS, NPROBE = 0.0035588767115525373, 64, 9
Q = f"list_transform(embedding, lambda x: CAST(greatest(-127, least(127, round_even(CAST(x AS DOUBLE) / CAST({SCALE!r} AS DOUBLE), 0))) AS DOUBLE))"
VQ = f"v AS (SELECT vec_id AS id, label, embedding, {Q} AS q FROM embeddings)"
C = "c AS (SELECT v.label AS cluster_id, v.q AS cq FROM v JOIN (SELECT label, min(id) AS id FROM v GROUP BY label) m USING (id))"
PAIRS = "a AS (SELECT x.id AS query_id, y.id AS id, CAST(list_inner_product(x.q, y.q) AS BIGINT) AS score FROM v x, v y)"
PROBE = f"p AS (SELECT query_id, cluster_id, place FROM (SELECT v.id AS query_id, cluster_id, row_number() OVER (PARTITION BY v.id ORDER BY list_inner_product(q, cq) DESC, cluster_id) AS place FROM v, c) WHERE place <= {NPROBE})"
HITS = "h AS (SELECT * FROM (SELECT a.*, v.label AS cluster_id, row_number() OVER (PARTITION BY a.query_id ORDER BY a.score DESC, a.id) AS rank FROM a JOIN v ON v.id = a.id JOIN p ON p.query_id = a.query_id AND p.cluster_id = v.label) WHERE rank <= 20)"


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("cluster_id"), V.quantise(F.col("embedding"), SCALE).alias("q"), "embedding")


def centroids(t: Tables) -> DataFrame:
    """One member of each label, the first, stands for its centre, so that results are exact."""
    v = vectors(t)
    return v.join(v.groupBy("cluster_id").agg(F.min("id").alias("id")).select("id"), "id", "left_semi").select(F.col("cluster_id").alias("id"), "q")


def searched(t: Tables) -> DataFrame:
    return vector_index.ivf_search(vectors(t), vectors(t).select("id", "q"), centroids(t), NPROBE, 20)


@query("vec_quantise", f"WITH {VQ} SELECT id, array_to_string(list_transform(q, lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), ',') AS q FROM v")
def _(t):
    return vectors(t).select("id", F.array_join(F.transform("q", lambda x: x.cast("string")), ",").alias("q"))


@query("vec_dequantise_norm", f"WITH {VQ} SELECT id, round(sqrt(list_sum(list_transform(q, lambda x: x * x))) * {SCALE!r}, 6) AS norm FROM v")
def _(t):
    return vectors(t).select("id", F.round(V.norm(F.col("q")) * SCALE, 6).alias("norm"))


@query("vec_scale_candidates", """
WITH x AS (SELECT abs(CAST(unnest(embedding) AS DOUBLE)) AS x FROM embeddings),
s AS (SELECT unnest([100.0, 99.999, 99.99, 99.9, 99.5]) AS clip, unnest([quantile_cont(x, 1.0), quantile_cont(x, 0.99999), quantile_cont(x, 0.9999), quantile_cont(x, 0.999), quantile_cont(x, 0.995)]) / 127 AS scale FROM x),
r AS (SELECT CAST(clip AS DOUBLE) AS clip, scale, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v, list_transform(embedding, lambda e: CAST(greatest(-127, least(127, round_even(CAST(e AS DOUBLE) / scale, 0))) AS DOUBLE)) AS q FROM embeddings, s)
SELECT clip, round(max(scale), 6) AS scale, round(avg(list_cosine_similarity(v, q)), 6) AS cosine FROM r GROUP BY clip""")
def _(t):
    return vector_index.scale_candidates(t.embeddings, "embedding").select("clip", F.round("scale", 6).alias("scale"), F.round("cosine", 6).alias("cosine"))


@query("vec_exhaustive_topk", f"WITH {VQ}, {PAIRS} SELECT * FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM a) WHERE rank <= 10")
def _(t):
    v = vectors(t).select("id", "q")
    return vector_index.exact_topk(v, v, 10)


@query("vec_topk_per_query", f"WITH {VQ}, {PAIRS} SELECT * FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM a WHERE query_id <> id) WHERE rank <= 5")
def _(t):
    v = vectors(t).select("id", "q")
    return vector_index.exact_topk(v, v, 5, exclude_self=True)


@query("vec_probe_topk", f"WITH {VQ}, {C}, {PROBE} SELECT query_id, CAST(cluster_id AS BIGINT) AS cluster_id, CAST(place AS INTEGER) AS rank FROM p")
def _(t):
    return vector_index.probe(vectors(t).select("id", "q"), centroids(t), NPROBE)


@query("vec_ivf_search", f"WITH {VQ}, {C}, {PAIRS}, {PROBE}, {HITS} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM h")
def _(t):
    return searched(t)


@query("vec_assign_argmax", f"WITH {VQ}, {C} SELECT id, CAST(cluster_id AS BIGINT) AS cluster_id FROM (SELECT id, cluster_id, row_number() OVER (PARTITION BY id ORDER BY list_inner_product(q, cq) DESC, cluster_id) AS r FROM v, c) WHERE r = 1")
def _(t):
    return vector_index.assign(vectors(t), centroids(t))


@query("vec_hamming_topk", f"""
WITH s AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE -1.0 END) AS s FROM embeddings),
p AS (SELECT a.id AS query_id, b.id, CAST(({DIMS} + list_inner_product(a.s, b.s)) / 2 AS INTEGER) AS score FROM s a, s b)
SELECT * FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM p) WHERE rank <= 10""")
def _(t):
    # signs as +-1: their dot product is DIMS less twice the differing ones, so the block product applies
    s = t.embeddings.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(-1)).alias("q"))
    return vector_index.exact_topk(s, s, 10).withColumn("score", ((F.col("score") + DIMS) / 2).cast("int"))


@query("vec_sign_codes", f"WITH s AS (SELECT vec_id AS id, embedding FROM embeddings) SELECT id, CAST(list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)) AS INTEGER) AS ones FROM s")
def _(t):
    code = V.sign_code(F.col("embedding"), DIMS)
    return t.embeddings.select(F.col("vec_id").alias("id"), (DIMS - V.hamming_score(code, F.transform(code, lambda x: F.lit(0).cast("long")), DIMS)).alias("ones"))


@query("vec_recall_vs_exhaustive", f"""
WITH {VQ}, {C}, {PAIRS}, {PROBE}, {HITS}, e AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM a WHERE id <> query_id) WHERE r <= 10)
SELECT e.query_id, round(count(h.id) / 10.0, 6) AS recall FROM e LEFT JOIN h ON h.query_id = e.query_id AND h.id = e.id GROUP BY e.query_id""")
def _(t):
    v = vectors(t).select("id", "q")
    return vector_index.recall(searched(t).where("query_id <> id"), vector_index.exact_topk(v, v, 10, exclude_self=True)).withColumn("recall", F.round("recall", 6))


@query("vec_fetch_budget", f"WITH {VQ}, {C}, {PROBE}, b AS (SELECT label AS cluster_id, count(*) * {DIMS} AS bytes FROM v GROUP BY label) SELECT query_id, CAST(sum(bytes) AS BIGINT) AS bytes FROM p JOIN b USING (cluster_id) GROUP BY query_id")
def _(t):
    sizes = vectors(t).groupBy("cluster_id").agg((F.count("*") * DIMS).alias("bytes"))
    return vector_index.fetch_budget(vector_index.probe(vectors(t).select("id", "q"), centroids(t), NPROBE), sizes)


@query("vec_group_sums", f"WITH {VQ} SELECT label, CAST(d AS INTEGER) AS d, CAST(sum(x) AS BIGINT) AS total, count(*) AS n FROM (SELECT label, unnest(q) AS x, unnest(range(len(q))) AS d FROM v) GROUP BY label, d")
def _(t):
    v = vectors(t).select(F.col("cluster_id").cast("int").alias("label"), F.posexplode("q").alias("d", "x"))
    return v.groupBy("label", "d").agg(F.sum("x").alias("total"), F.count("*").alias("n"))


@query("vec_round_trip_cosine", f"WITH {VQ}, r AS (SELECT list_cosine_similarity(list_transform(embedding, lambda e: CAST(e AS DOUBLE)), q) AS c FROM v) SELECT round(avg(c), 6) AS mean, round(min(c), 6) AS least, round(quantile_cont(c, 0.01), 6) AS p01 FROM r")
def _(t):
    c = vectors(t).select(V.cosine(F.col("embedding"), F.col("q")).alias("c"))
    return c.agg(F.round(F.avg("c"), 6).alias("mean"), F.round(F.min("c"), 6).alias("least"), F.round(F.percentile("c", F.lit(0.01)), 6).alias("p01"))


@query("vec_fidelity", f"WITH {VQ} SELECT round(avg(list_inner_product(list_transform(embedding, lambda e: CAST(e AS DOUBLE)), q)) * {SCALE!r}, 6) AS fidelity FROM v")
def _(t):
    return vectors(t).agg(F.round(F.avg(V.dot(F.col("embedding"), F.col("q"))) * SCALE, 6).alias("fidelity"))


# passages belong to documents: id // 4 is the document, id % 3 the section; its metadata is a part
SECTION = "CASE WHEN id % 3 = 0 THEN CAST(id % 3 AS VARCHAR) END AS section, 't' || CAST(id % 2 AS VARCHAR) AS title"
PASSAGES = f"g AS (SELECT query_id, id // 4 AS doc_id, {SECTION}, score, rank FROM h)"
DEDUPED = "u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, coalesce(nullif(section, ''), nullif(title, ''), '') ORDER BY rank) AS r FROM g) WHERE r = 1)"
DOCS = "d AS (SELECT query_id, doc_id, list_sort(list(CAST(score AS DOUBLE) / 16129), 'DESC') AS s, min(rank) AS first_rank FROM u GROUP BY query_id, doc_id)"
BASE = f"WITH {VQ}, {C}, {PAIRS}, {PROBE}, {HITS}, {PASSAGES}, {DEDUPED}, {DOCS}"
THREE = "(coalesce(s[1], 0) + coalesce(s[2], 0) + coalesce(s[3], 0)) / 3"
OVERLAP = "(CASE WHEN contains(lower(p_name), 'red') THEN 1 ELSE 0 END + CASE WHEN contains(lower(p_name), 'bolt') THEN 1 ELSE 0 END) / 2.0"
FULL = f"m AS (SELECT d.*, {OVERLAP} AS overlap, (SELECT count(*) FROM lineitem WHERE l_partkey = d.doc_id) AS refs FROM d JOIN part ON p_partkey = d.doc_id)"
ROW = f"{THREE} + 0.1 * overlap + 0.02 * ln(1 + refs)"


def passages(t: Tables) -> DataFrame:
    section = F.when(F.col("id") % 3 == 0, (F.col("id") % 3).cast("string"))
    title = F.concat(F.lit("t"), (F.col("id") % 2).cast("string"))
    return searched(t).select("query_id", F.floor(F.col("id") / 4).alias("doc_id"), section.alias("section"), title.alias("title"), (F.col("score").cast("double") / 16129).alias("score"), "rank")


def ranked_documents(t: Tables) -> DataFrame:
    docs = t.part.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"))
    refs = t.lineitem.groupBy(F.col("l_partkey").alias("doc_id")).agg(F.count("*").alias("refs"))
    queries = t.embeddings.select(F.col("vec_id").alias("query_id"), F.lit("a red bolt").alias("query"))
    return ranking.rank_documents(ranking.one_hit_a_section(passages(t)), docs, refs, queries)


def scored(t: Tables) -> DataFrame:
    refs = t.lineitem.groupBy(F.col("l_partkey").alias("doc_id")).agg(F.count("*").alias("cited"))
    d = ranking.document_hits(ranking.one_hit_a_section(passages(t))).join(t.part.select(F.col("p_partkey").alias("doc_id"), "p_name"), "doc_id").join(refs, "doc_id", "left")
    return d.withColumn("overlap", T.title_overlap("a red bolt", F.col("p_name")))


@query("rnk_section_dedupe", f"WITH {VQ}, {C}, {PAIRS}, {PROBE}, {HITS}, {PASSAGES}, {DEDUPED} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM u")
def _(t):
    return ranking.one_hit_a_section(passages(t)).select("query_id", "doc_id", "rank")


@query("rnk_top3_doc_score", f"{BASE} SELECT query_id, doc_id, round({THREE}, 6) AS passages, CAST(first_rank AS INTEGER) AS first_rank FROM d")
def _(t):
    d = ranking.document_hits(ranking.one_hit_a_section(passages(t)))
    return d.select("query_id", "doc_id", F.round(ranking.sum_of(F.col("scores"), 3) / 3, 6).alias("passages"), "first_rank")


@query("rnk_title_overlap", f"SELECT p_partkey, round({OVERLAP}, 6) AS overlap FROM part")
def _(t):
    return t.part.select("p_partkey", F.round(T.title_overlap("a red bolt", F.col("p_name")), 6).alias("overlap"))


@query("rnk_row_score", f"{BASE}, {FULL} SELECT query_id, doc_id, round({ROW}, 6) AS row_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {ROW} DESC, first_rank) AS INTEGER) AS place FROM m")
def _(t):
    return ranked_documents(t).withColumn("row_score", F.round("row_score", 6))


SCHEMES = {"best": "s[1]", "mean_top3": "(coalesce(s[1], 0) + coalesce(s[2], 0) + coalesce(s[3], 0)) / least(len(s), 3)", "three": THREE, "cited_0.02": f"{THREE} + 0.02 * ln(1 + refs)", "cited_0.05": f"{THREE} + 0.05 * ln(1 + refs)"}
SCHEMES |= {f"title_{w}": f"{THREE} + {w} * overlap" for w in ("0.05", "0.10", "0.15", "0.20")}
SCHEMES |= {"title_0.10_cited": f"{THREE} + 0.10 * overlap + 0.02 * ln(1 + refs)", "shipped": f"{THREE} + 0.20 * overlap + 0.02 * ln(1 + refs)"}


@query("rnk_schemes", f"{BASE}, {FULL} " + " UNION ALL ".join(f"SELECT query_id, doc_id, '{n}' AS scheme, round({e}, 6) AS scheme_score FROM m" for n, e in SCHEMES.items()))
def _(t):
    return ranking.scheme_scores(scored(t)).select("query_id", "doc_id", "scheme", F.round("scheme_score", 6).alias("scheme_score"))


# relevant to a query: the documents of its label's first 20 vectors
REL = "rel AS (SELECT DISTINCT a.id AS query_id, b.id // 4 AS doc_id FROM v a JOIN v b ON a.label = b.label)"
EVAL = f"{BASE}, {FULL}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY {ROW} DESC, first_rank) AS place FROM m), {REL}, pq AS (SELECT rel.query_id, count(CASE WHEN place <= 10 THEN 1 END) / count(*) AS recall, coalesce(1 / min(place), 0) AS reciprocal, coalesce(min(place), 1000000) AS first FROM rel LEFT JOIN r USING (query_id, doc_id) GROUP BY rel.query_id)"
SUMMARY = "round(avg(recall), 6) AS recall, round(avg(reciprocal), 6) AS mrr, CAST(trunc(median(first)) AS INTEGER) AS median_rank"


def judged(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("label").alias("set_id"))
    return evaluation.per_query_of_sets(ranked_documents(t), e, e.select("set_id", F.floor(F.col("query_id") / 4).alias("doc_id")))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, k in df.dtypes if k == "double"})


@query("evl_recall_mrr_median", f"{EVAL} SELECT {SUMMARY} FROM pq")
def _(t):
    return rounded(evaluation.summary(judged(t)))


@query("evl_folds", f"{EVAL} SELECT query_id % 2 AS fold, {SUMMARY} FROM pq GROUP BY 1")
def _(t):
    return rounded(evaluation.summary(judged(t), (F.col("query_id") % 2).alias("fold")))


@query("evl_hit_rate", f"{EVAL} SELECT round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM pq")
def _(t):
    return rounded(evaluation.hit_rate(judged(t)))


@query("evl_pair_separation", f"""
WITH {VQ}, {PAIRS}, k AS (SELECT query_id, list(id) AS ids FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM a) WHERE r <= 10 GROUP BY query_id),
g AS (SELECT query_id // 2 AS pair_id, min(query_id) AS x, max(query_id) AS y FROM k GROUP BY 1 HAVING count(*) = 2)
SELECT pair_id, round(1 - CAST(len(list_intersect(p.ids, q.ids)) AS DOUBLE) / len(list_distinct(list_concat(p.ids, q.ids))), 6) AS separation FROM g JOIN k p ON p.query_id = x JOIN k q ON q.query_id = y""")
def _(t):
    v = vectors(t).select("id", "q")
    top = vector_index.exact_topk(v, v, 10).groupBy("query_id").agg(F.collect_list("id").alias("ids"))
    pairs = top.select("query_id", F.floor(F.col("query_id") / 2).alias("pair_id"))
    return rounded(evaluation.pair_separation(top, pairs))


@query("chk_assignment_agree", f"WITH {VQ}, {C}, w AS (SELECT id, label, cluster_id, row_number() OVER (PARTITION BY id ORDER BY list_inner_product(q, cq) DESC, cluster_id) AS r FROM v, c) SELECT count(*) AS checked, count(CASE WHEN label = cluster_id THEN 1 END) AS equal, round(count(CASE WHEN label = cluster_id THEN 1 END) / count(*), 6) AS share FROM w WHERE r = 1")
def _(t):
    return rounded(checks.agreement(vectors(t).select("id", "cluster_id"), vector_index.assign(vectors(t), centroids(t))))


@query("chk_coverage", "SELECT count(v) AS seen, count(*) FILTER (v IS NULL) AS missing, count(*) FILTER (d IS NULL) AS \"unknown\", 0 AS repeated, count(*) FILTER (v IS NULL) = 0 AND count(*) FILTER (d IS NULL) = 0 AS ok FROM (SELECT doc_id AS d FROM documents) FULL JOIN (SELECT DISTINCT doc_id AS v FROM labels) ON d = v")
def _(t):
    return checks.coverage(t.documents, t.labels.select("doc_id").distinct(), "doc_id").withColumn("repeated", F.col("repeated").cast("int"))


@query("chk_rows_ascending", "SELECT count(*) AS n FROM (SELECT vec_id, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) WHERE b >= vec_id")
def _(t):
    return checks.ascending(t.embeddings.select(F.col("label").alias("cluster_id"), F.col("vec_id").alias("place"), F.col("vec_id").alias("id"))).agg(F.count("*").alias("n"))


@query("vec_recall_report", f"""
WITH {VQ}, {C}, {PAIRS}, {PROBE}, {HITS}, e AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM a WHERE id <> query_id) WHERE r <= 10),
q AS (SELECT e.query_id, count(h.id) / 10.0 AS recall FROM e LEFT JOIN h ON h.query_id = e.query_id AND h.id = e.id GROUP BY e.query_id),
b AS (SELECT label AS cluster_id, count(*) AS m FROM v GROUP BY label), n AS (SELECT query_id, sum(m) AS n FROM p JOIN b USING (cluster_id) GROUP BY query_id)
SELECT count(*) AS queries, round(avg(recall), 6) AS recall, round(min(recall), 6) AS least_recall, round(avg(n), 6) AS mean_candidates, round(avg(n) / (SELECT count(*) FROM v), 6) AS scanned FROM q JOIN n USING (query_id)""")
def _(t):
    v = vectors(t)
    sizes = v.groupBy("cluster_id").agg(F.count("*").alias("bytes"))
    n = vector_index.fetch_budget(vector_index.probe(v.select("id", "q"), centroids(t), NPROBE), sizes).withColumnRenamed("bytes", "n")
    truth = vector_index.exact_topk(v.select("id", "q"), v.select("id", "q"), 10, exclude_self=True)
    return rounded(vector_index.recall_report(searched(t).where("query_id <> id"), truth, n, v.count())).withColumn("least_recall", F.round("least_recall", 6))


@query("ml_kmeans_cosine", "SELECT count(*) AS vectors, true AS nearest, true AS within_cap, true AS unit_length FROM embeddings")
def _(t):
    """Spherical k-means with the oversize split, as what must hold of it: every vector is in the cluster of its nearest centre, none is above the cap, centres have unit length."""
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    owner, centres, told = clustering.build(v, 12, SCALE)
    again = clustering.assign(v, centres, SCALE)
    same = owner.join(again.withColumnRenamed("cluster_id", "nearest"), "id").agg(F.count("*").alias("vectors"), F.bool_and(F.col("cluster_id") == F.col("nearest")).alias("nearest"))
    long = centres.agg(F.bool_and(F.abs(V.norm(F.col("v")) - 1) < 1e-5).alias("unit_length"))
    return same.withColumn("within_cap", F.lit(told["clusters"]["over_cap"] == 0)).crossJoin(F.broadcast(long))  # one row each


@query("emb_udf")
def _(t):
    """All documents through the encoder, each distinct text once."""
    vectors_ = embedding.embed(incremental.distinct_contents(t.documents), embedding.HashingEncoder())
    return incremental.attach(t.documents.select("doc_id", "text"), vectors_).select("doc_id", "content_hash", "v")
