"""Lexical search: prefix postings, word rules, tag filters, facets, order and cap."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PUNCTUATION, clean_token

TAG_TYPES = ("collection", "status", "stream", "level", "wg")
CAP = 50


def clean(word: str) -> str:
    return re.sub(PUNCTUATION, "", word.lower())


@dataclass
class Request:
    """What a user asks for: words, at most one tag of each type, whether obsolete documents are wanted, order."""

    words: list[str] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    obsolete: bool = False
    full_text: bool = False

    @classmethod
    def parse(cls, query_string: str) -> Request:
        """From a URL's query string; of several values for a tag type the last holds, an empty one clears it."""
        q = parse_qs(query_string.lstrip("?"), keep_blank_values=True)
        words = [w for w in " ".join(q.get("search", [])).split(" ") if w]
        tags = {}
        for k in TAG_TYPES:
            values = [v for x in q.get(k, []) for v in x.split(",")]
            if values and values[-1]:
                tags[k] = values[-1]
        return cls(words, tags, "obsolete" in q, "ft" in q)

    def unparse(self) -> str:
        out = {}
        if self.words:
            out["search"] = " ".join(self.words)
        if self.obsolete:
            out["obsolete"] = ""
        if self.full_text:
            out["ft"] = ""
        return urlencode(out | self.tags)

    def toggle(self, kind: str, name: str) -> Request:
        tags = {k: v for k, v in self.tags.items() if k != kind}
        if self.tags.get(kind) != name:
            tags[kind] = name
        return Request(self.words, tags, self.obsolete, self.full_text)

    def active(self) -> bool:
        """Is there enough to search for? Any tag; words in full-text mode; a first word that begins with a digit or has 3 letters."""
        if self.tags or (self.full_text and self.words):
            return True
        return bool(self.words) and (re.match(r"\s*[+-]?\d", self.words[0]) is not None or len(self.words[0]) >= 3)


def title_words(title: Column) -> Column:
    return F.transform(F.split(F.coalesce(title, F.lit("")), " "), clean_token)


def postings(docs: DataFrame) -> DataFrame:
    """(field, token, prefix3, doc_id) of title words and whole keyword phrases with 3 characters or more. Store it sorted by prefix3: a word then reads one range."""
    words = docs.select("doc_id", F.lit("title").alias("field"), F.explode(title_words(F.col("title"))).alias("token"))
    phrases = docs.select("doc_id", F.lit("keyword").alias("field"), F.explode(F.transform("keywords", clean_token)).alias("token"))
    return words.union(phrases).where(F.length("token") >= 3).select("field", "token", F.substring("token", 1, 3).alias("prefix3"), "doc_id").distinct()


def lookup(index: DataFrame, word: str) -> DataFrame:
    """(doc_id, by_title) of the documents with a token that begins with the word; nothing for fewer than 3 characters."""
    w = clean(word)
    hits = index.where((F.col("prefix3") == w[:3]) & F.startswith("token", F.lit(w))) if len(w) >= 3 else index.where(F.lit(False))
    return hits.groupBy("doc_id").agg(F.max((F.col("field") == "title").cast("int")).alias("by_title"))


def word_match(docs_title: Column, keywords: Column, word: str) -> Column:
    """The same as a predicate on a scanned row."""
    w = clean(word)
    if len(w) < 3:
        return F.lit(False)
    by_title = F.exists(title_words(docs_title), lambda t: F.startswith(t, F.lit(w)))
    return by_title | F.coalesce(F.exists(keywords, lambda k: F.startswith(clean_token(k), F.lit(w))), F.lit(False))


def plan_words(words: list[str], known_number) -> tuple[int | None, list[str]]:
    """(number of the document that replaces everything before it, words that still count). Short words count only when alone."""
    number, rest = None, []
    for w in words:
        if w.isdigit() and known_number(int(w)):
            number, rest = int(w), []
        elif len(w) >= 3 or len(words) == 1:
            rest.append(w)
    return number, rest


def search(docs: DataFrame, words: list[str], known_number) -> DataFrame:
    """Documents that match every word, in one scan; a word that names a document by number replaces what came before.

    No word that counts restricts nothing: whether to search at all is for Request.active() to say."""
    number, rest = plan_words(words, known_number)
    out = docs if number is None else docs.where(F.col("doc_num") == number)
    for w in rest:
        out = out.where(word_match(F.col("title"), F.col("keywords"), w))
    return out


def answer(docs: DataFrame, tags: DataFrame, request: Request, known_number) -> DataFrame:
    """What a request shows: nothing if it isn't active, else the documents with its words and tags, obsolete ones if wanted."""
    if not request.active():
        return docs.where(F.lit(False))
    return without_obsolete(with_tags(search(docs, request.words, known_number), tags, request.tags), request.obsolete)


def with_tags(found: DataFrame, tags: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """found, restricted to the documents with all wanted tags (one of a type). A tag that no document has is an error."""
    if not wanted:
        return found
    pairs = [(F.col("tag_type") == k) & (F.col("tag_name") == n) for k, n in wanted.items()]
    there = tags.agg(*[F.coalesce(F.bool_or(p), F.lit(False)) for p in pairs]).first()
    if unknown := [k for k, on in zip(wanted.items(), there) if not on]:
        raise KeyError(f"unknown tag: {unknown}")
    for p in pairs:
        found = found.join(tags.where(p).select("doc_id"), "doc_id", "left_semi")
    return found


def derived_tags(docs: DataFrame) -> DataFrame:
    """(tag_type, tag_name, doc_id) from the attributes of the documents."""
    kinds = [k for k in TAG_TYPES if k in docs.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("tag_type"), F.col(k).cast("string").alias("tag_name")) for k in kinds]))
    return docs.select("doc_id", pairs.alias("t")).select("t.tag_type", "t.tag_name", "doc_id").where("tag_name is not null")


def facets(found: DataFrame, tags: DataFrame, active: dict[str, str] | None = None) -> DataFrame:
    """(tag_type, tag_name, docs): the tags in a result, active ones always among them."""
    counted = tags.join(found.select("doc_id"), "doc_id", "left_semi").groupBy("tag_type", "tag_name").agg(F.count("*").alias("docs"))
    if active:
        always = found.sparkSession.createDataFrame(list(active.items()), "tag_type string, tag_name string").withColumn("docs", F.lit(0).cast("long"))
        counted = counted.unionByName(always).groupBy("tag_type", "tag_name").agg(F.max("docs").alias("docs"))
    return counted


def without_obsolete(found: DataFrame, wanted: bool = False) -> DataFrame:
    return found if wanted else found.where(F.coalesce(F.col("status"), F.lit("")) != "obsoleted")


def top(found: DataFrame, *order: Column, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """(the first rows, the total before the cap)."""
    return found.orderBy(*order).limit(cap), found.agg(F.count("*").alias("total"))
