"""Queries of lexical search, projections, set operations and the graph, on the star schema.

part stands for the documents: id p_partkey, title p_name, level p_type, stream p_brand; its keyword
phrases are the title as a whole, and its type with the word "goods", which no title holds. lineitem gives citations (order -> part), conversations the chain
of turns that replace one another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import graph, lexical
from .registry import Tables, query

CLEAN = "regexp_replace(lower({}), '[][().,?\"'']', '', 'g')"
DOCS = "docs AS (SELECT p_partkey AS doc_id, p_partkey AS doc_num, p_name AS title, p_type AS level, p_brand AS stream, CASE WHEN p_size > 40 THEN 'obsoleted' ELSE 'current' END AS status, p_type || ' goods' AS kw FROM part)"
REFS = "refs AS (SELECT p_partkey AS doc_id, count(l_orderkey) AS refs FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey)"


def docs(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("doc_id"), F.col("p_partkey").alias("doc_num"), F.col("p_name").alias("title"), F.array(F.col("p_name"), F.concat("p_type", F.lit(" goods"))).alias("keywords"), F.col("p_type").alias("level"),
        F.col("p_brand").alias("stream"), F.when(F.col("p_size") > 40, "obsoleted").otherwise("current").alias("status"), "p_size", "p_retailprice",
    )


def edges(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_returnflag") == "N").alias("normative"))


def word_sql(w: str) -> str:
    c = CLEAN.format("x")
    return f"(len(list_filter(list_transform(string_split(title, ' '), lambda x: {c}), lambda y: starts_with(y, '{w}'))) > 0 OR starts_with({CLEAN.format('title')}, '{w}') OR starts_with({CLEAN.format('kw')}, '{w}'))"


def known(t: Tables):
    return lambda n: not t.part.where(F.col("p_partkey") == n).isEmpty()


@query("lex_prefix_and", f"WITH {DOCS} SELECT doc_id, title FROM docs WHERE {word_sql('red')} AND {word_sql('wid')}")
def _(t):
    return lexical.search(docs(t), ["red", "Wid."], known(t)).select("doc_id", "title")


@query("lex_postings_and", f"WITH {DOCS} SELECT doc_id FROM docs WHERE {word_sql('blu')} AND {word_sql('bol')}")
def _(t):
    index = lexical.postings(docs(t))
    return lexical.lookup(index, "blu").select("doc_id").join(lexical.lookup(index, "bol").select("doc_id"), "doc_id", "left_semi")


@query("lex_keyword_only", f"WITH {DOCS} SELECT doc_id, title FROM docs WHERE {word_sql('promo')} AND {word_sql('bolt')}")
def _(t):
    return lexical.search(docs(t), ["promo", "bolt"], known(t)).select("doc_id", "title")


@query("lex_no_words_with_tag", f"WITH {DOCS} SELECT doc_id, title FROM docs WHERE level = 'PROMO' AND status <> 'obsoleted'")
def _(t):
    d = docs(t)
    return lexical.answer(d, lexical.derived_tags(d), lexical.Request(tags={"level": "PROMO"}), known(t)).select("doc_id", "title")


@query("lex_keyword_phrase_prefix", f"WITH {DOCS} SELECT doc_id, title FROM docs WHERE starts_with({CLEAN.format('title')}, 'hot ge') OR starts_with({CLEAN.format('kw')}, 'hot ge')")
def _(t):
    return docs(t).where(F.exists("keywords", lambda k: F.startswith(T.clean_token(k), F.lit("hot ge")))).select("doc_id", "title")


@query("lex_numeric_override", f"WITH {DOCS} SELECT doc_id, title FROM docs WHERE doc_num = 7")
def _(t):
    return lexical.search(docs(t), ["gear", "7"], known(t)).select("doc_id", "title")


@query("lex_short_word_rules", f"WITH {DOCS} SELECT doc_id, title FROM docs WHERE {word_sql('ring')}")
def _(t):
    return lexical.search(docs(t), ["a", "ring"], known(t)).select("doc_id", "title").unionByName(lexical.search(docs(t), ["ri"], known(t)).select("doc_id", "title"))


@query("lex_postings_build", f"""
WITH {DOCS}, tok AS (SELECT doc_id, 'title' AS field, {CLEAN.format("w")} AS token FROM (SELECT doc_id, unnest(string_split(title, ' ')) AS w FROM docs)
  UNION ALL SELECT doc_id, 'keyword', {CLEAN.format("title")} FROM docs UNION ALL SELECT doc_id, 'keyword', {CLEAN.format("kw")} FROM docs)
SELECT field, token[1:3] AS prefix3, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM tok WHERE length(token) >= 3 GROUP BY ALL""")
def _(t):
    return lexical.postings(docs(t)).groupBy("field", "prefix3").agg(F.countDistinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("lex_tag_conjunction", f"WITH {DOCS} SELECT doc_id, title FROM docs WHERE level = 'PROMO' AND stream = 'Brand#4'")
def _(t):
    d = docs(t)
    return lexical.with_tags(d, lexical.derived_tags(d), {"level": "PROMO", "stream": "Brand#4"}).select("doc_id", "title")


@query("lex_facets", f"""
WITH {DOCS}, hit AS (SELECT * FROM docs WHERE {word_sql("gea")} AND status <> 'obsoleted')
SELECT 'level' AS tag_type, level AS tag_name, count(*) AS docs FROM hit GROUP BY 2 UNION ALL SELECT 'stream', stream, count(*) FROM hit GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM hit GROUP BY 2
UNION ALL SELECT 'wg', 'none', 0""")
def _(t):
    d = docs(t)
    return lexical.facets(lexical.without_obsolete(lexical.search(d, ["gea"], known(t))), lexical.derived_tags(d), {"wg": "none"})


@query("lex_facet_grouping_sets", f"WITH {DOCS} SELECT level, stream, count(*) AS docs FROM docs GROUP BY GROUPING SETS ((level), (stream), ())")
def _(t):
    docs(t).createOrReplaceTempView("quarry_docs")
    return t.spark.sql("SELECT level, stream, count(*) AS docs FROM quarry_docs GROUP BY GROUPING SETS ((level), (stream), ())")


@query("lex_sort_refs_stable", f"""
WITH {DOCS}, {REFS} SELECT doc_id, refs, CAST(row_number() OVER (ORDER BY refs DESC, doc_id) AS INTEGER) AS place FROM docs JOIN refs USING (doc_id) WHERE {word_sql("bolt")}""")
def _(t):
    d = docs(t)
    hit = lexical.search(d, ["bolt"], known(t)).join(graph.inbound_counts(d, edges(t)), "doc_id")
    return hit.select("doc_id", "refs", F.row_number().over(Window.orderBy(F.col("refs").desc(), "doc_id")).alias("place"))


@query("lex_sort_number_desc", f"WITH {DOCS} SELECT doc_id, doc_num FROM docs WHERE {word_sql('cog')} OR {word_sql('nut')} ORDER BY doc_num DESC LIMIT 50")
def _(t):
    hit = docs(t).where(lexical.word_match(F.col("title"), F.col("keywords"), "cog") | lexical.word_match(F.col("title"), F.col("keywords"), "nut"))
    return lexical.top(hit, F.col("doc_num").desc())[0].select("doc_id", "doc_num")


@query("lex_cap_with_total", f"WITH {DOCS}, hit AS (SELECT * FROM docs WHERE status <> 'obsoleted') SELECT doc_id, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY doc_num DESC LIMIT 50")
def _(t):
    first, total = lexical.top(lexical.without_obsolete(docs(t)), F.col("doc_num").desc())
    return first.select("doc_id").crossJoin(F.broadcast(total))  # one row


@query("lex_not_obsolete", f"WITH {DOCS} SELECT doc_id, status FROM docs WHERE status <> 'obsoleted'")
def _(t):
    return lexical.without_obsolete(docs(t)).select("doc_id", "status")


@query("lex_rank_filtered", f"""
WITH {DOCS}, {REFS}, r AS (SELECT doc_id, row_number() OVER (ORDER BY refs DESC, doc_id) AS place FROM refs)
SELECT doc_id, CAST(place AS INTEGER) AS place FROM r WHERE doc_id IN (SELECT doc_id FROM docs WHERE level = 'SMALL')""")
def _(t):
    d = docs(t)
    ranked = graph.inbound_counts(d, edges(t)).select("doc_id", F.row_number().over(Window.orderBy(F.col("refs").desc(), "doc_id")).alias("place"))
    return lexical.with_tags(ranked, lexical.derived_tags(d), {"level": "SMALL"})


@query("lex_hits_with_metadata", "SELECT l_orderkey, l_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey AND p_size <= 40")
def _(t):
    return t.lineitem.join(t.part.where("p_size <= 40"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_partkey", "p_name")


@query("srt_offset_limit", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 50")
def _(t):
    return t.documents.select("doc_id", "n_chars").orderBy(F.col("n_chars").desc(), "doc_id").offset(50).limit(25)


@query("srt_worst_n", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 5")
def _(t):
    return t.documents.select("doc_id", "n_chars").orderBy("n_chars", "doc_id").limit(5)


@query("srt_length_layout", "SELECT lang, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INTEGER) AS place FROM documents")
def _(t):
    return t.documents.select("lang", "doc_id", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n_chars").desc(), "doc_id")).alias("place"))


@query("prj_level_lookup", "SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 'std' WHEN 'ECONOMY' THEN 'std' WHEN 'MEDIUM' THEN 'std' WHEN 'PROMO' THEN 'info' WHEN 'LARGE' THEN 'exp' WHEN 'SMALL' THEN 'hist' END AS level FROM part")
def _(t):
    return t.part.select("p_partkey", T.level(F.col("p_type"), {"STANDARD": "std", "ECONOMY": "std", "MEDIUM": "std", "PROMO": "info", "LARGE": "exp", "SMALL": "hist"}).alias("level"))


COLOUR = "'#' || lpad(to_hex(h & 255), 2, '0') || lpad(to_hex((h >> 8) & 255), 2, '0') || lpad(to_hex((h >> 16) & 255), 2, '0')"
HASHED = "SELECT p_partkey, p_name, p_brand, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM part"


@query("prj_colour_hash", f"SELECT p_partkey, h AS hash, lower({COLOUR}) AS colour FROM ({HASHED})")
def _(t):
    return t.part.select("p_partkey", T.string_hash(F.col("p_name")).alias("hash"), T.hash_colour(F.col("p_name")).alias("colour"))


LIN = "CASE WHEN {0} / 255.0 <= 0.03928 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END"
LUM = f"CAST(0.2126 AS DOUBLE) * ({LIN.format('(CAST(h & 255 AS DOUBLE))')}) + CAST(0.7152 AS DOUBLE) * ({LIN.format('(CAST((h >> 8) & 255 AS DOUBLE))')}) + CAST(0.0722 AS DOUBLE) * ({LIN.format('(CAST((h >> 16) & 255 AS DOUBLE))')})"


@query("prj_luminance_pick", f"SELECT p_partkey, round(lum, 6) AS luminance, CASE WHEN (lum + 0.05) / 0.05 > 1.05 / (lum + 0.05) THEN '#000000' ELSE '#ffffff' END AS ink FROM (SELECT p_partkey, {LUM} AS lum FROM ({HASHED}))")
def _(t):
    c = T.hash_colour(F.col("p_name"))
    return t.part.select("p_partkey", F.round(T.luminance(c), 6).alias("luminance"), T.text_colour(c).alias("ink"))


@query("prj_pad_template", "SELECT o_orderkey, CASE WHEN length(CAST(o_orderkey AS VARCHAR)) >= 4 THEN CAST(o_orderkey AS VARCHAR) ELSE lpad(CAST(o_orderkey AS VARCHAR), 4, '0') END AS padded FROM orders")
def _(t):
    return t.orders.select("o_orderkey", T.pad_left(F.col("o_orderkey"), 4).alias("padded"))


@query("prj_fixup_defaults", "SELECT p_partkey, lower(p_brand) AS stream, CASE WHEN p_size > 40 THEN 'obsoleted' ELSE 'current' END AS status, nullif(p_type, 'STANDARD') AS wg, CASE WHEN p_size > 25 THEN [p_name] ELSE [] END AS keywords FROM part")
def _(t):
    return t.part.select(
        "p_partkey", F.lower("p_brand").alias("stream"), F.when(F.col("p_size") > 40, "obsoleted").otherwise("current").alias("status"), F.nullif(F.col("p_type"), F.lit("STANDARD")).alias("wg"),
        F.coalesce(F.when(F.col("p_size") > 25, F.array("p_name")), F.array().cast("array<string>")).alias("keywords"),
    )


@query("prj_doc_name_normalise", "SELECT c_custkey, 'RFC' || CAST(CAST(regexp_extract('rfc' || split_part(c_name, '#', 2), '(?i)^\\s*(?:RFC)?(\\d+)', 1) AS INTEGER) AS VARCHAR) AS name, CAST(regexp_extract(split_part(c_name, '#', 2), '^(\\d+)', 1) AS INTEGER) AS number FROM customer")
def _(t):
    raw = F.concat(F.lit("rfc"), F.split_part("c_name", F.lit("#"), F.lit(2)))
    return t.customer.select("c_custkey", T.doc_name(raw).alias("name"), T.doc_number(raw).alias("number"))


@query("prj_tag_colour_precedence", f"SELECT p_partkey, CASE WHEN p_brand = 'Brand#4' THEN '#123456' WHEN p_type = 'PROMO' THEN '#abcdef' ELSE lower({COLOUR}) END AS colour FROM (SELECT a.*, b.p_type FROM ({HASHED}) a JOIN part b USING (p_partkey))")
def _(t):
    given, default = F.when(F.col("p_brand") == "Brand#4", "#123456").otherwise(""), F.when(F.col("p_type") == "PROMO", "#abcdef")
    return t.part.select("p_partkey", F.coalesce(F.nullif(given, F.lit("")), default, T.hash_colour(F.col("p_name"))).alias("colour"))


@query("prj_build_id", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS build FROM orders")
def _(t):
    return t.orders.select("o_orderkey", T.build_id(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("build"))


@query("prj_deep_link", "SELECT p_partkey, '/doc/' || lower(p_brand) || CASE WHEN p_size > 25 THEN '#section-' || CAST(p_size AS VARCHAR) ELSE '' END AS url, CASE WHEN p_size > 25 THEN '§' || CAST(p_size AS VARCHAR) || ' ' || p_name ELSE p_name END AS label FROM part")
def _(t):
    url, label = T.deep_link(F.col("p_brand"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")), F.col("p_name"))
    return t.part.select("p_partkey", url.alias("url"), label.alias("label"))


@query("prj_human_bytes", """SELECT doc_id, CASE WHEN b >= 1048576 THEN format('{:,.1f}', b / 1048576.0) || ' MiB' WHEN b >= 1024 THEN format('{:,.1f}', b / 1024.0) || ' KiB' ELSE CAST(b AS VARCHAR) || ' B' END AS size,
CASE WHEN n_chars = 1 THEN '' ELSE 's' END AS plural FROM (SELECT doc_id, n_chars, n_chars * 512 AS b FROM documents)""")
def _(t):
    return t.documents.select("doc_id", T.human_bytes(F.col("n_chars") * 512).alias("size"), T.plural(F.col("n_chars")).alias("plural"))


TITLE_HIT, WORD_HIT = f"SELECT doc_id FROM docs WHERE {word_sql('red')}", "SELECT doc_id FROM docs WHERE level = 'LARGE'"


@query("set_intersect", f"WITH {DOCS} {TITLE_HIT} INTERSECT {WORD_HIT}")
def _(t):
    d = docs(t)
    return d.where(lexical.word_match(F.col("title"), F.col("keywords"), "red")).select("doc_id").intersect(d.where("level = 'LARGE'").select("doc_id"))


@query("set_union_ordered", f"WITH {DOCS} SELECT doc_id, CAST(min(o) AS INTEGER) AS first_list FROM (SELECT doc_id, 0 AS o FROM ({TITLE_HIT}) UNION ALL SELECT doc_id, 1 FROM ({WORD_HIT})) GROUP BY doc_id")
def _(t):
    d = docs(t)
    a, b = d.where(lexical.word_match(F.col("title"), F.col("keywords"), "red")), d.where("level = 'LARGE'")
    return a.select("doc_id", F.lit(0).alias("o")).union(b.select("doc_id", F.lit(1).alias("o"))).groupBy("doc_id").agg(F.min("o").alias("first_list"))


@query("set_except", f"WITH {DOCS} {TITLE_HIT} EXCEPT {WORD_HIT}")
def _(t):
    d = docs(t)
    return d.where(lexical.word_match(F.col("title"), F.col("keywords"), "red")).select("doc_id").exceptAll(d.where("level = 'LARGE'").select("doc_id"))


@query("set_changed", "SELECT coalesce(o.doc_id, n.doc_id) AS doc_id FROM (SELECT doc_id, sha256('q' || CAST(quality AS VARCHAR)) AS h FROM labels) o FULL JOIN (SELECT doc_id, sha256('q1') AS h FROM documents) n ON o.doc_id = n.doc_id WHERE o.h IS DISTINCT FROM n.h")
def _(t):
    from ..operators.incremental import changed

    old = t.labels.select("doc_id", F.sha2(F.concat(F.lit("q"), F.col("quality").cast("string")), 256).alias("digest"))
    return changed(old, t.documents.select("doc_id", F.sha2(F.lit("q1"), 256).alias("digest")))


@query("gr_inbound_counts", f"WITH {REFS} SELECT doc_id, refs FROM refs")
def _(t):
    return graph.inbound_counts(docs(t), edges(t))


@query("agg_direct_citations", "SELECT l_partkey AS dst, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return edges(t).groupBy("dst").agg(F.count("*").alias("n"))


@query("gr_dangling_anti", "SELECT DISTINCT l_partkey AS dst FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def _(t):
    return graph.dangling(docs(t).where("p_size > 5"), edges(t)).select("dst").distinct()


CHAIN = "n AS (SELECT DISTINCT conv_id, turn, conv_id * 1000 + turn AS id FROM conversations), o AS (SELECT a.id AS doc_id, b.id AS old FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.turn IN (a.turn - 1, a.turn - 2)), e AS (SELECT o_orderkey AS src, o_custkey * 1000 AS dst FROM orders)"
WALKED = f"WITH RECURSIVE {CHAIN}, w AS (SELECT id AS root, id AS doc_id, 0 AS depth, CAST([] AS BIGINT[]) AS path FROM n UNION ALL SELECT w.root, o.old, w.depth + 1, list_append(w.path, o.old) FROM w JOIN o ON w.doc_id = o.doc_id)"


def chain(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = t.conversations.select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id")).distinct()
    b = n.select("conv_id", F.col("turn").alias("before"), F.col("doc_id").alias("old"))
    o = n.join(b, "conv_id").where((F.col("before") == F.col("turn") - 1) | (F.col("before") == F.col("turn") - 2)).select("doc_id", "old")
    e = t.orders.select(F.col("o_orderkey").alias("src"), (F.col("o_custkey") * 1000).alias("dst"), (F.col("o_orderstatus") == "F").alias("normative"))
    return n, e, o


@query("gr_inherited_counts", f"{WALKED}, c AS (SELECT dst, count(*) AS n FROM e GROUP BY dst) SELECT root AS doc_id, CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS refs FROM w LEFT JOIN c ON c.dst = w.doc_id GROUP BY root")
def _(t):
    return graph.inherited_counts(*chain(t))


@query("gr_inherited_list", f"{WALKED} SELECT root AS doc_id, dst AS \"of\", CAST(depth AS INTEGER) AS depth, src, CAST(row_number() OVER (PARTITION BY root ORDER BY path, src) AS INTEGER) AS place FROM w JOIN e ON e.dst = w.doc_id")
def _(t):
    return graph.inherited_list(*chain(t)).drop("normative")


@query("jon_enrich_left", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN p_name END AS title FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def _(t):
    return t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"), "left").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "N", F.col("p_name")).alias("title"))
