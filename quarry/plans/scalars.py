"""One query for each scalar function that the engine uses, with the equal SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from .registry import query, scalar

P = ("part", "p_partkey")
scalar("sca01_lower", *P, {"x": ("lower(p_brand)", "lower(p_brand)")})
scalar("sca02_upper_all_caps", *P, {"x": ("upper(p_name)", "upper(p_name)"), "caps": ("upper(p_type) = p_type", "upper(p_type) = p_type")})
scalar("sca03_split_blank", "documents", "doc_id", {"parts": ("cast(size(split(text, ' ')) as bigint)", "len(string_split(text, ' '))"), "words": ("cast(size(filter(split(text, ' '), w -> w <> '')) as bigint)", "len(list_filter(string_split(text, ' '), lambda w: w <> ''))")})
scalar("sca04_split_runs", "documents", "doc_id", {"n": (r"cast(size(split(text, r'[ \n\t]+')) as bigint)", r"len(regexp_split_to_array(text, '[ \n\t]+'))")})
scalar("sca05_first_field", *P, {"a": (r"regexp_extract(p_name, r'^(\S+)\s+(.*)$', 1)", r"regexp_extract(p_name, '^(\S+)\s+(.*)$', 1)"), "b": (r"regexp_extract(p_name, r'^(\S+)\s+(.*)$', 2)", r"regexp_extract(p_name, '^(\S+)\s+(.*)$', 2)")})
scalar("sca06_last_component", "pages", "page_id", {"x": ("element_at(split(url, '/'), -1)", "string_split(url, '/')[-1]")})
scalar("sca07_prefix_suffix", *P, {"a": ("startswith(p_name, 'red')", "starts_with(p_name, 'red')"), "b": ("endswith(p_name, 'bolt') OR endswith(p_name, 'ring')", "ends_with(p_name, 'bolt') OR ends_with(p_name, 'ring')"), "c": ("p_name rlike '[.:!?;]$'", "regexp_matches(p_name, '[.:!?;]$')")})
scalar("sca08_contains", *P, {"x": ("contains(p_name, 'ge')", "contains(p_name, 'ge')")})
scalar("sca09_substring", *P, {"a": ("substring(p_name, 2, 3)", "substr(p_name, 2, 3)"), "b": ("left(p_name, 3)", "left(p_name, 3)"), "c": ("right(p_brand, 2)", "right(p_brand, 2)")})
scalar("sca10_last_blank", *P, {"x": ("length(p_name) - instr(reverse(p_name), ' ') + 1", "CAST(length(p_name) - instr(reverse(p_name), ' ') + 1 AS INTEGER)")})
scalar("sca11_strip", *P, {"x": (r"regexp_replace('  ' || p_name || ' ', r'(?U)^\s+|\s+$', '')", r"regexp_replace('  ' || p_name || ' ', '^\s+|\s+$', '', 'g')")})
scalar("sca12_without_prefix", *P, {"x": ("regexp_replace(p_brand, '^Brand', '')", "regexp_replace(p_brand, '^Brand', '')")})
scalar("sca13_character_tests", "documents", "doc_id", {"a": ("text rlike '^[0-9]+$'", "regexp_matches(text, '^[0-9]+$')"), "b": (r"text rlike r'^\p{Lu}'", r"regexp_matches(text, '^\p{Lu}')"), "c": ("octet_length(text) = length(text)", "strlen(text) = length(text)")})
scalar("sca14_parse_int", *P, {"a": (r"try_cast(regexp_extract(split_part(p_brand, '#', 2), r'^\s*(\d+)', 1) as int)", r"TRY_CAST(regexp_extract(split_part(p_brand, '#', 2), '^\s*(\d+)', 1) AS INTEGER)"), "b": ("try_cast(p_brand as int)", "TRY_CAST(p_brand AS INTEGER)")})
scalar("sca15_pad", *P, {"x": ("case when length(cast(p_partkey as string)) >= 3 then cast(p_partkey as string) else lpad(cast(p_partkey as string), 3, '0') end", "CASE WHEN length(CAST(p_partkey AS VARCHAR)) >= 3 THEN CAST(p_partkey AS VARCHAR) ELSE lpad(CAST(p_partkey AS VARCHAR), 3, '0') END")})
scalar("sca16_format", "documents", "doc_id", {"a": ("format_number(n_chars * 1000, 0)", "format('{:,}', n_chars * 1000)"), "b": ("printf('%.1f%%', n_chars / 7.0D)", "printf('%.1f%%', CAST(n_chars AS DOUBLE) / 7)")})
scalar("sca17_replace_all", *P, {"x": ("regexp_replace(p_name, '[aeiou]', '-')", "regexp_replace(p_name, '[aeiou]', '-', 'g')")})
scalar("sca18_match", *P, {"a": ("p_name rlike 'e[a-d]'", "regexp_matches(p_name, 'e[a-d]')"), "b": ("p_name rlike '^[a-z]+ [a-z]+$'", "regexp_full_match(p_name, '[a-z]+ [a-z]+')")})
scalar("sca19_captures", "pages", "page_id", {"x": ("array_join(regexp_extract_all(url, '[a-z]+', 0), '|')", "array_to_string(regexp_extract_all(url, '[a-z]+'), '|')")})
scalar("sca20_join", *P, {"x": ("array_join(array(p_name, p_brand), ', ')", "array_to_string([p_name, p_brand], ', ')")})
scalar("sca21_digest", "documents", "doc_id", {"x": ("sha2(text, 256)", "sha256(text)"), "y": ("left(sha2(text, 256), 12)", "left(sha256(text), 12)")})
scalar("sca23_hex_byte", *P, {"x": ("lpad(lower(hex(p_size & 255)), 2, '0')", "lpad(lower(to_hex(p_size & 255)), 2, '0')")})
scalar("sca24_encode_decode", "documents", "doc_id", {"a": ("decode(encode(text, 'UTF-8'), 'UTF-8') = text", "decode(encode(text)) = text"), "b": ("is_valid_utf8(text)", "true"), "c": ("octet_length(encode(text, 'UTF-8'))", "CAST(octet_length(encode(text)) AS INTEGER)")})
scalar("sca25_half_even_clip", *P, {"a": ("rint(p_size / 2.0D)", "round_even(CAST(p_size AS DOUBLE) / 2, 0)"), "b": ("greatest(-127, least(127, p_size * 5 - 100))", "greatest(-127, least(127, p_size * 5 - 100))")})
scalar("sca26_arithmetic", *P, {"a": ("round(log1p(p_size), 6)", "round(ln(1 + p_size), 6)"), "b": ("round(pow(p_size, 0.5D), 6)", "round(pow(CAST(p_size AS DOUBLE), 0.5), 6)"), "c": ("ceil(p_retailprice / 7)", "CAST(ceil(p_retailprice / 7) AS BIGINT)"), "d": ("abs(p_size - 25)", "abs(p_size - 25)"), "e": ("least(p_size, 10) + greatest(p_size, 20)", "least(p_size, 10) + greatest(p_size, 20)")})
scalar("sca27_bits", *P, {"a": ("shiftleft(p_size, 3) & 63", "(p_size << 3) & 63"), "b": ("p_size ^ 21", "xor(p_size, 21)"), "c": ("bit_count(p_size)", "CAST(bit_count(p_size) AS INTEGER)")})
scalar("sca32_distinct_in_order", "pages", "page_id", {"x": ("array_join(array_distinct(split(url, '')), '')", "list_reduce(string_split(url, ''), lambda a, c: CASE WHEN contains(a, c) THEN a ELSE a || c END)")})
scalar("sca34_map_default", *P, {"x": ("coalesce(try_element_at(map('PROMO', 1, 'SMALL', 2), p_type), 0)", "CASE p_type WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 ELSE 0 END")})
scalar("sca35_binary_search", *P, {"x": ("size(filter(array(5, 11, 20, 33, 47), b -> b < p_size))", "CAST(len(list_filter([5, 11, 20, 33, 47], lambda b: b < p_size)) AS INTEGER)")})
scalar("sca36_json", "events", "event_id", {"k": ("from_json(props, 'k bigint').k", "CAST(json_extract(props, '$.k') AS BIGINT)"), "j": ("to_json(named_struct('k', from_json(props, 'k bigint').k))", "'{\"k\":' || json_extract_string(props, '$.k') || '}'")})
scalar("sca38_times", "orders", "o_orderkey", {"a": ("date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')"), "b": ("regexp_replace(date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), '[-:]', '')", "strftime(o_orderdate, '%Y%m%dT%H%M%SZ')"), "c": ("unix_millis(cast(o_orderdate as timestamp))", "epoch_ms(o_orderdate)")})
scalar("sca39_url", "pages", "page_id", {"host": ("parse_url(url, 'HOST')", "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"), "source": ("coalesce(parse_url(url, 'QUERY', 'utm_source'), '')", "regexp_extract(url, '[?&]utm_source=([^&#]*)', 1)")})


@query("sca22_character_hash", "SELECT p_partkey, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_brand, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM part")
def _(t):
    return t.part.select("p_partkey", T.string_hash(F.col("p_brand")).alias("h"))


@query("sca28_dot", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS x FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.round(V.dot(F.col("embedding"), F.col("embedding")), 6).alias("x"))


@query("sca29_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 9 * CAST(x AS DOUBLE)))), 6) AS n, 1.0::DOUBLE AS one FROM embeddings")
def _(t):
    three = F.transform("embedding", lambda x: x.cast("double") * 3)
    return t.embeddings.select("vec_id", F.round(V.norm(three), 6).alias("n"), F.round(V.norm(V.unit(three)), 6).alias("one"))


@query("sca30_argmax", "SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT AS place FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.array_position("embedding", F.array_max("embedding")).alias("place"))


@query("sca31_array_functions", "SELECT vec_id, round(list_sum(list_transform(embedding[1:3], lambda x: CAST(x AS DOUBLE))), 6) AS three, len(list_filter(embedding, lambda x: x > 0))::INTEGER AS positive, len(list_filter(embedding, lambda x: x > 0.4)) > 0 AS large FROM embeddings")
def _(t):
    three = F.aggregate(F.slice("embedding", 1, 3), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return t.embeddings.select("vec_id", F.round(three, 6).alias("three"), F.size(F.filter("embedding", lambda x: x > 0)).alias("positive"), F.exists("embedding", lambda x: x > F.lit(0.4).cast("float")).alias("large"))


@query("sca33_array_sets", "SELECT a.p_partkey, len(list_intersect(string_split(p_name, ' '), ['red', 'hot', 'bolt']))::INTEGER AS both, list_has_any(string_split(p_name, ' '), ['red', 'hot', 'bolt']) AS any_of FROM part a")
def _(t):
    w, s = F.split("p_name", " "), F.array(*map(F.lit, ("red", "hot", "bolt")))
    return t.part.select("p_partkey", F.size(F.array_intersect(w, s)).alias("both"), F.arrays_overlap(w, s).alias("any_of"))


@query("sca37_columnar_tail", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE (['std', 'exp', 'hist'])[p_size % 3 + 1] END AS section, p_size AS off FROM part")
def _(t):
    # a columnar tail: arrays of equal length with a table of strings, -1 for null
    tail = t.part.groupBy("p_type").agg(F.collect_list("p_partkey").alias("id"), F.collect_list("p_size").alias("off"), F.collect_list(F.when(F.col("p_size") % 3 == 0, -1).otherwise(F.col("p_size") % 3)).alias("sec"))
    rows = tail.select(F.explode(F.arrays_zip("id", "off", "sec")).alias("r"))
    table = F.array(*map(F.lit, ("std", "exp", "hist")))
    return rows.select(F.col("r.id").alias("p_partkey"), F.when(F.col("r.sec") >= 0, F.element_at(table, F.greatest(F.col("r.sec"), F.lit(0)) + 1)).alias("section"), F.col("r.off").alias("off"))


@query("sca41_title_overlap", "SELECT p_partkey, (CASE WHEN contains(p_name, 'hot') THEN 1 ELSE 0 END + CASE WHEN contains(p_name, 'gear') THEN 1 ELSE 0 END) / 2.0::DOUBLE AS x FROM part")
def _(t):
    return t.part.select("p_partkey", T.title_overlap("a hot Gear of", F.col("p_name")).alias("x"))


@query("sca42_jaccard", "SELECT p_partkey, round(len(list_intersect(string_split(p_name, ' '), ['red', 'bolt'])) / len(list_distinct(list_concat(string_split(p_name, ' '), ['red', 'bolt']))), 6) AS x FROM part")
def _(t):
    return t.part.select("p_partkey", F.round(T.jaccard(F.split("p_name", " "), F.array(F.lit("red"), F.lit("bolt"))), 6).alias("x"))
